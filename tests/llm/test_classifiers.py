import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import quality as ql
from scoreloom.llm import toxicity as tx
from scoreloom.llm.common import held_out
from scoreloom.llm.labelled import with_texts

SF = "/root/testdata/sf0.01"


def auc(y, s):
    """Area under the curve; tied scores share their mean rank."""
    _, place, n = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[place]
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / n1 / (len(y) - n1)


def test_risk_and_its_gradient():
    rng = np.random.default_rng(2)
    def rows(n):
        return [np.sort(rng.choice(7, rng.integers(0, 6), replace=False)) for _ in range(n)]
    pos, unl, prior = [np.append(r, 7) for r in rows(20)], rows(50), 0.3
    p, u = tx._Rows(pos), tx._Rows(unl)

    def dense(w, b):
        f = lambda r: b + sum(w[j] for j in r)
        l = lambda z: np.log1p(np.exp(-z))  # noqa: E731, E741
        ep, en, eu = (np.mean(x) for x in ([l(f(r)) for r in pos], [l(-f(r)) for r in pos], [l(-f(r)) for r in unl]))
        return prior * ep, eu - prior * en

    seen = set()
    for shift in (0.0, -4.0, -9.0):
        for _ in range(4):
            w, b = np.append(rng.normal(size=7), -2 * shift), shift
            positive, hidden, grad, grad_b = tx.risk(w, b, p, u, prior)
            assert np.allclose((positive, hidden), dense(w, b))
            seen.add(hidden >= 0)
            value = (lambda w, b: sum(dense(w, b))) if hidden >= 0 else (lambda w, b: -dense(w, b)[1])
            steps = np.eye(8) * 1e-6
            assert np.allclose(grad, [(value(w + e, b) - value(w - e, b)) / 2e-6 for e in steps], atol=1e-6)
            assert np.isclose(grad_b, (value(w, b + 1e-6) - value(w, b - 1e-6)) / 2e-6, atol=1e-6)
    assert seen == {True, False}


def test_screen_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(bool(i < 40), sorted(rng.choice(30, 6, replace=False).tolist() + ([77] if i < 25 or i % 19 == 0 else []))) for i in range(200)]
    df = spark.createDataFrame(rows, "positive boolean, ids array<int>")
    want = []
    for f in {i for _, r in rows for i in r}:
        a, n = sum(p and f in r for p, r in rows), sum(f in r for _, r in rows)
        q = n / 200
        if n >= tx.MIN_DOCS and abs(a / 40 - (n - a) / 160) / (np.sqrt(q * (1 - q) * (1 / 40 + 1 / 160)) + 1e-9) >= tx.MIN_SIGMA:
            want.append(f)
    assert 77 in want and tx.telling(df, 40, 160).tolist() == sorted(want)


def test_non_negative_risk_finds_the_telling_feature():
    rng = np.random.default_rng(0)
    def row(toxic):
        return np.sort(np.append(rng.choice(np.arange(1, 30), 5, replace=False), [0] if toxic else [])).astype(np.int64)
    pos = [row(True) for _ in range(60)]
    unl = [row(i < 20) for i in range(200)]
    w, b = tx.nn_pu(pos, unl, 30, 0.1, seed=1)
    assert w.argmax() == 0
    assert tx.sigmoid(b + w[0]) > 0.5 > tx.sigmoid(b)


def test_feature_ids():
    assert (tx.feature_ids("Scum, SCUM! scum") == tx.feature_ids("scum")).all()
    assert len(tx.feature_ids(None)) == len(tx.feature_ids(" \n")) == len(tx.feature_ids("!! --")) == 0
    # A word, and for either beginning one level: one, two and four words share it.
    assert [len(tx.feature_ids(t)) for t in ("abc", "abcdefgh", "abcdefgh abcdefgi", "abcdefgh abcdefgi abcdefgj abcdefgk")] == [1, 3, 6, 10]
    few, tx.CACHE_WORDS = tx.CACHE_WORDS, 3
    try:
        long = " ".join(f"word{i}" for i in range(50))
        got = [tx.feature_ids(t).tolist() for t in ("a b", "c d", long, "a b")]
    finally:
        tx.CACHE_WORDS = few
    assert got[0] == got[3] == tx.feature_ids("b a").tolist() and got[2] == tx.feature_ids(long).tolist()


def test_curve_is_the_nearest_rising_one():
    x, y = np.array([0.0, 1, 1, 2, 3, 4]), np.array([0.0, 1, 0, 0, 1, 1])
    at, p = ql.fit_curve(x, y, np.ones(6))
    # Steps 0, 1/3 and 1 with one observation of a half more: 1/4, 3/8 and 5/6.
    assert at.tolist() == [0, 1, 2, 3, 4]
    assert np.allclose(p, [1 / 4, 3 / 8 - 1 / 80, 3 / 8 + 11 / 240, 5 / 6 - 11 / 240, 5 / 6 + 1 / 60])
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    y = (x + rng.normal(size=300) > 0).astype(float)
    at, p = ql.fit_curve(x, y, np.ones(300))
    assert (np.diff(at) > 0).all() and (np.diff(p) >= 0).all() and 0 < p[0] and p[-1] < 1


def test_scores_equal_brute_force(spark):
    """Every row's score, from the fitted models, in plain Python."""
    import zstandard

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    m = ql.train(docs, labels)
    packs = [zstandard.ZstdCompressor(level=ql.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **({"dict_data": zstandard.ZstdCompressionDict(d)} if d else {})) for d in (m.good, m.bad, b"")]
    got = {r.doc_id: r.score for r in ql.score(docs.select("doc_id", "text"), m).collect()}
    assert got.keys() == texts.keys()
    for i, text in list(texts.items())[:200]:
        raw = text.encode()
        good, bad, plain = (sum(len(c.compress(raw[j : j + ql.PIECE_BYTES])) for j in range(0, len(raw), ql.PIECE_BYTES)) for c in packs)
        assert got[i] == pytest.approx(np.interp((bad - good) * plain / (len(raw) + 32) ** 2, m.at, m.probability))
    m = tx.train(docs, labels)
    weight = dict(zip(m.ids.tolist(), m.weights.tolist()))
    got = {r.doc_id: r.score for r in tx.score(docs.select("doc_id", "text"), m).collect()}
    for i, text in texts.items():
        assert got[i] == pytest.approx(1 / (1 + np.exp(-m.bias - sum(weight.get(f, 0) for f in tx.feature_ids(text).tolist()))))


@pytest.mark.parametrize("kind, column, least", [("toxic", "toxic", 0.85), ("quality", "quality", 0.95)])
def test_held_out_accuracy(spark, kind, column, least):
    """6 of the 70 held-out rows are toxic here; of these, those without a frequent toxic word rest on word beginnings."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = (tx.toxicity if kind == "toxic" else ql.quality)(docs, labels)
    assert out.count() == docs.count()
    got = out.where("held_out").join(labels, "doc_id").toPandas()
    assert auc(got[column].to_numpy(), got.score.to_numpy()) >= least
    assert got.score.between(0, 1).all()


def test_held_out_fold_is_crc32(spark):
    import zlib

    df = spark.range(50).withColumnRenamed("id", "doc_id")
    for r in df.select("doc_id", held_out().alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


EDGES = "doc_id long, text string, lang string, source string, n_chars long, score string, label string"


@pytest.mark.parametrize("op", [tx.toxicity, ql.quality])
def test_edge_rows(spark, op):
    rows = [(None, "no id", None, None, None, "s", "l"), (1, None, "en", "a", 0, "s", "l"), (2, "", None, "a", 0, None, None), (2, "", None, "a", 0, None, None), (3, "word " * 50_000, "en", "a", 1, "s", "l")]
    docs = spark.createDataFrame(rows, EDGES)
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (None, 1, 1), (3, None, None), (3, 0, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    assert op(docs, labels).count() == len(rows)
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op(docs, nothing).where("score is not null").count() == len(rows)
    assert op(docs.limit(0), labels).count() == 0


def test_filters_keep_columns(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = ql.keep_good(docs, labels)
    assert kept.columns == docs.columns
    clean = tx.drop_toxic(kept, labels)
    assert clean.columns == docs.columns
    clash = docs.withColumn("toxicity", F.lit("x")).withColumn("quality", F.lit(None).cast("int")).withColumn("_quality", F.lit(1))
    assert ql.keep_good(clash, labels).columns == tx.drop_toxic(clash, labels).columns == clash.columns
    bad = labels.where("quality = 0")
    assert kept.join(bad, "doc_id", "left_semi").count() < 0.2 * bad.count()
    assert clean.count() > 0.7 * docs.count()


def test_dictionary_of_too_little_text():
    assert ql.build_dictionary([]) == b""
    assert ql.build_dictionary([b"abc"]) == b"abc"


def repeated_ids(spark):
    """One labelled id, and one unlabelled id, at a third of all rows each."""
    rows = [(i, f"good text number {i} about trees", 1, i % 2) for i in range(100)]
    rows += [(1, f"row {j} of the same document", 1, 1) for j in range(100)] + [(1000, f"row {j} of another", None, None) for j in range(100)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(100)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_samples_have_no_more_rows_than_ids(spark):
    docs, labels = repeated_ids(spark)
    ids = labels.select("doc_id", "toxic").unionByName(spark.createDataFrame([(1000, None)], "doc_id long, toxic int"))
    got = with_texts(docs, ids).collect()
    assert len(got) == len({r.doc_id for r in got}) == 101
    assert {r.doc_id: r.text for r in with_texts(docs.repartition(7), ids).collect()} == {r.doc_id: r.text for r in got}
    out = tx.toxicity(docs, labels)
    assert out.count() == docs.count()
    assert ql.quality(docs, labels).count() == docs.count()


def test_dictionary_rows_within_bytes():
    rows = [(1, 0, 50), (2, 1, 70), (3, 0, 60), (4, 0, 50), (5, 1, 31), (6, 1, 30), (7, 0, 1)]
    assert ql.within(rows, 100) == [1, 2, 4, 6]


def test_dictionary_lines_count_once():
    texts = ["a\nb\na", "b\nc", "", "c", "d" * 5000]
    pieces = ql.once(texts)
    assert b"".join(pieces[:2]) == b"a\nb" + b"c" and b"".join(pieces[2:]) == b"d" * 5000
    assert all(0 < len(p) <= ql.PIECE_BYTES for p in pieces)
