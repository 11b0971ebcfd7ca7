import hashlib
import random

import pytest
from pyspark.sql import functions as F

from scoreloom.llm.mixing import leaf_budgets, mix


def fill(purse, children):
    """Shares of a purse: raise one level for all until it is spent; children are (weight, capacity)."""
    got = [0.0] * len(children)
    open_ = {i for i, (w, c) in enumerate(children) if w > 0 and c > 0}
    while open_ and purse > 1e-9:
        weight = sum(children[i][0] for i in open_)
        step = min([purse / weight] + [(children[i][1] - got[i]) / children[i][0] for i in open_])
        for i in open_:
            got[i] += step * children[i][0]
        purse -= step * weight
        open_ = {i for i in open_ if children[i][1] - got[i] > 1e-9}
    return got


def brute(leaves, weights, total, epochs):
    """Budgets by the same rule, recursively."""
    def alive(path):
        return all(weights.get(path[:d], 1.0) > 0 for d in (1, 2, 3))

    out = {}

    def down(prefix, purse):
        names = sorted({p[len(prefix)] for p in leaves if p[: len(prefix)] == prefix})
        paths = [(*prefix, n) for n in names]
        caps = [sum(t * epochs for p, t in leaves.items() if p[: len(q)] == q and alive(p)) for q in paths]
        for q, g in zip(paths, fill(purse, [(weights.get(q, 1.0), c) for q, c in zip(paths, caps)])):
            if len(q) == 3:
                out[q] = g
            else:
                down(q, g)

    down((), total)
    return out


@pytest.mark.parametrize("seed, share", [(1, 0.3), (2, 1.1), (3, 5.0)])
def test_budgets_equal_brute_force(spark, seed, share):
    rng = random.Random(seed)
    leaves = {(d, x, s): rng.choice([0, 5, 40, 300, 5000]) for d in "AB" for x in "xyz" for s in ("s1", "s2", "s3") if rng.random() < 0.8}
    weights = {("A",): 3.0, ("A", "x"): 0.0, ("B", "y"): 2.5, **{p: rng.choice([0.0, 0.5, 1.0, 4.0]) for p in leaves}}
    frames = {
        name: spark.createDataFrame([(*p, w) for p, w in weights.items() if len(p) == d + 1], ", ".join(f"{c} string" for c in ("domain", "lang", "source")[: d + 1]) + ", weight double")
        for d, name in enumerate(("domain", "lang", "source"))
    }
    df = spark.createDataFrame([(*p, t) for p, t in leaves.items()], "domain string, lang string, source string, tokens long")
    total = share * sum(leaves.values())
    got = {(r.domain, r.lang, r.source): r.budget for r in leaf_budgets(df, frames, total, 2).collect()}
    want = brute(leaves, weights, total, 2)
    assert got.keys() == want.keys()
    for p in want:
        assert got[p] == pytest.approx(want[p], abs=1e-3)


def test_prefixes_of_seeded_epochs(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(0, 30), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b"]), "clash", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens string, epoch int")
    got = mix(docs, F.lit("all"), 1.2, {"lang": spark.createDataFrame([("all", "en", 3.0)], "domain string, lang string, weight double")}, epochs=2, seed=3).collect()
    n = {r[0]: len(r[1].split()) for r in rows}
    taken, budget = {}, {}
    for r in got:
        assert r.tokens == n[r.doc_id]
        leaf = (r.lang, r.source)
        taken.setdefault(leaf, []).append((r.epoch, r.doc_id))
        budget[leaf] = r.leaf_budget
    for leaf, mine in taken.items():
        order = sorted(
            (e, int(hashlib.md5(f"3:{e}:{r[0]}".encode()).hexdigest()[:8], 16), r[0]) for r in rows for e in (1, 2) if (r[2], r[3]) == leaf
        )
        want, total = [], 0
        for e, _, i in order:
            total += n[i]
            if total > budget[leaf]:
                break
            want.append((e, i))
        assert sorted(mine) == sorted(want)
    assert sum(r.tokens for r in got) <= 1.2 * sum(n.values())


def test_clashing_names(spark):
    names = ["__lang", "__slice", "order", "slice", "before", "end", "row", "running", "LANG_", "slice_tokens", "usable"]
    docs = spark.createDataFrame([(i, "a b c", "en", "s", *[f"{n}{i}" for n in names], {"k": i}) for i in range(60)] * 2, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names) + ", extra map<string,long>")
    out = mix(docs, F.lit("d"), 0.5, epochs=1)
    assert out.columns == [*docs.columns, "domain", "epoch", "tokens", "leaf_budget"]
    rows = out.collect()
    assert len(rows) == 60 and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame([(None, None, None, None), (1, "", "en", "a"), (2, "a b", "en", "a"), (2, "a b", "en", "a")], schema)
    assert mix(docs, F.lit(None), 1.0, epochs=1).count() == 4
    assert mix(docs.limit(0), F.lit("d"), 1.0).count() == 0
