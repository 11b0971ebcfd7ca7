import random
import re

import numpy as np
import pytest

from scoreloom.llm.common import connected_components
from scoreloom.llm import jaccard_join as jj
from scoreloom.llm.jaccard_join import jaccard_components, keep_one
from scoreloom.llm.words import common, shingle_set


def brute(rows, k, t):
    """component and set size by comparing all pairs."""
    sets = {}
    for i, text in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} or ({tuple(ws)} if ws else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            union = len(sets[a] | sets[b])
            if union and 100 * both >= t * union:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, n):
    """Families of near copies, chains at the threshold, short texts and shared passages."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocab, k=30))
    texts = []
    while len(texts) < n:
        base = rng.choices(vocab, k=rng.choice([1, 3, 4, 5, 8, 9, 10, 12, 20, 30, 60, 150]))
        family = rng.choice([1, 1, 2, 5, 25])
        walk = list(base)
        for _ in range(family):
            text = list(walk if rng.random() < 0.4 else base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            if rng.random() < 0.2:
                text = text + rng.choices(vocab, k=1)
            walk = text
            out = " ".join(text)
            if rng.random() < 0.15:
                out = f"{out} {passage}"
            texts.append(out.upper() if rng.random() < 0.1 else out)
    texts += [None, "", " \n", "a", "a", passage]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed, k, t, boundary", [(1, 4, 85, None), (3, 4, 85, 60), (5, 2, 50, 10)])
def test_equals_brute_force(spark, seed, k, t, boundary):
    rows = corpus(seed, 200)
    df = spark.createDataFrame([(i, x, "other") for i, x in rows], "doc_id long, text string, n_shingles string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, k, t, boundary).collect()}
    assert got == brute(rows, k, t)


def test_outlines_never_rule_out_a_link():
    rows = corpus(11, 250)
    sets = [shingle_set(t, 4) for _, t in rows]
    sets = [s for s in sets if len(s)]
    outlines = [jj.outline(s) for s in sets]
    ruled_out = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = common(a, b)
            ok = jj.may_link(outlines[i], outlines[j], len(a), len(b), 85)
            ruled_out += not ok
            assert ok or 100 * both < 85 * (len(a) + len(b) - both)
    assert ruled_out


def test_keep_one(spark):
    rows = [(3, "a b c d e f g h", "x"), (2, "a b c d e f g h", "y"), (7, "other words altogether in this one", "x"), (7, "other words altogether in this one", "z"), (8, None, "x"), (8, None, "x"), (None, "a b c d e f g h", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 7, 8, 8]


def test_large_lists_go_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(jj, "STAR", 5)
    rng = random.Random(9)
    base = [f"x{i}" for i in range(200)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.choice([1, 2, 3, 5, 8])):
            text[rng.randrange(200)] = f"y{rng.randrange(10**6)}"
        rows.append((i + 1, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
    assert got == brute(rows, 4, 85)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, None), (3, "long " * 40_000)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_components(df).collect())
    assert got == [(0, 2, None), (1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 1, 3)]
    assert jaccard_components(df.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.v: r.c for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}}


def test_unlike_texts_that_share_phrases_are_not_compared(spark, monkeypatch):
    """A sketch that tells nothing leaves shared phrases among the keys; their lists show them to be frequent."""
    monkeypatch.setattr(jj, "STAR", 5)
    monkeypatch.setattr(jj, "_sketch", lambda docs, k: np.zeros(1 << jj.SKETCH_BITS, np.uint8))
    rng = random.Random(13)
    phrases = [" ".join(f"p{j}x{i}" for i in range(8)) for j in range(6)]
    rows = []
    for i in range(90):
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 140))]
        texts = [" ".join(own + phrases)] + [" ".join(own[:-1] + [f"e{i}", *phrases])] * (i % 30 == 0)
        rows += [(len(rows) + n + 1, x) for n, x in enumerate(texts)]
    rows += [(1000 + n, " ".join([f"c{j}" for j in range(100)] + [f"z{n}"] + phrases)) for n in range(9)]
    tested = []
    monkeypatch.setattr(jj, "materialise", lambda df, name, f=jj.materialise: tested.append(f(df, name)) or tested[-1] if name == "jaccard-tested" else f(df, name))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
    assert got == brute(rows, 4, 85)
    assert len({c for _, c in got.values()}) == 91
    assert sum(t.where("not linked").count() for t in tested) <= 30


def test_keys_with_late_elements_share_one_where_sets_link():
    rng = np.random.default_rng(3)
    base = np.sort(rng.integers(0, 2**63, 400, dtype=np.uint64))
    late = np.sort(base[rng.random(400) < 0.4] * jj._HEAVY)
    for drop in (0, 5, 25):
        a, b = np.delete(base, np.arange(drop)), np.delete(base, rng.integers(0, 400, drop))
        assert set(jj.keys(a, 85, 6, late)) & set(jj.keys(b, 85, 6, late))
        assert not set(jj.keys(a, 85, 6, late)) & set(late)
