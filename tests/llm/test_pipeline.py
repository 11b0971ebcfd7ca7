"""The pipeline on the smallest tables, stage by stage against plain Python."""

import corpus_pipeline as cp
from scoreloom.llm import decontaminate as dc
from scoreloom.llm.words import words

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    ws = words(text)
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} or ({tuple(ws)} if ws else set())


def test_edges(spark):
    """Nulls, empty and long texts, repeated rows and clashing names pass every stage with the results its docstring gives."""
    clash = ["row", "toxicity", "quality", "epoch", "__lang", "score", "id", "fp"]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in clash)
    good = next(r for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60 and length(text) > 800").orderBy("doc_id").collect())
    rows = [(None, good.text), (None, None), (1001, None), (1002, ""), (1002, ""), (1003, good.text), (1004, good.text), (1004, good.text), (1005, " ".join(f"word{i}" for i in range(20_000))), (1006, "\t\n")]
    docs = spark.createDataFrame([(i, t, None, None, None, *[f"{c}{n}" for c in clash]) for n, (i, t) in enumerate(rows)], schema)
    for name, stage in cp.STAGES:
        path = cp.scratch(spark, f"edges-{name}")
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        if name != "mixing":
            assert out.columns == docs.columns
        if name == "near_copies":
            kept = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
            # Of 1003 and its copy 1004 the first stays; rows without id or words are in no group.
            assert kept == sorted((r[0] or 0, r[1] or "") for n, r in enumerate(rows) if n not in (6, 7))
        if name == "decontamination":
            assert out.count() == docs.count()
        if name == "mixing":
            assert {"domain", "epoch", "tokens", "leaf_budget"} <= set(out.columns) and set(clash) <= set(out.columns)
        for r in out.collect():
            n = int(r.id[2:])
            assert (r.doc_id, r.text) == rows[n] and all(r[c] == f"{c}{n}" for c in clash if c != "epoch")
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["quality", "toxicity", "near_copies", "decontamination", "mixing"]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in cp.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        # Written and read again, as the next stage gets it.
        path = cp.scratch(spark, f"test-{name}")
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        rows = out.collect()
        after = {r.doc_id for r in rows}
        gone = set(before) - after
        assert after <= set(before)
        if name != "mixing":
            assert out.columns == columns
        if name == "quality":
            good = [d for d, x in labels.items() if x.quality == 1 and d in before]
            assert sum(d in gone for d in good) <= 0.1 * len(good)
        if name == "near_copies":
            sets = {d: shingles(t) for d, t in before.items()}
            root = {d: d for d in sets}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            ids = sorted(sets)
            for i, a in enumerate(ids):
                for b in ids[i + 1 :]:
                    if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[a]:
                        lo, hi = sorted((find(a), find(b)))
                        root[hi] = lo
            assert after == {d for d in ids if find(d) == d}
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            index = dc.Index(items, *dc.shingle_weights(items))
            whole = {tuple(words(t)) for _, t in items}
            holds = {d for d, t in before.items() if any(tuple(words(t)[i : i + len(w)]) == w for w in whole for i in range(len(words(t)) - len(w) + 1))}
            assert holds <= gone
            assert gone == {d for d, t in before.items() if index.matches(t, dc.LEAST)}
        docs = out
    assert rows and {"epoch", "tokens", "leaf_budget", "domain"} <= set(docs.columns)
