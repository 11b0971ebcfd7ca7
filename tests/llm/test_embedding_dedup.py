import numpy as np

from scoreloom.llm import embedding_dedup as ed
from scoreloom.llm.embedding_dedup import near_duplicates
from scoreloom.llm.hnsw import Graph, unit


def clusters(n, seed=0, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for _ in range(n // 8):
        a, b = rng.integers(0, n, 2)
        x[a] = x[b] + rng.normal(size=d) * rng.choice([0.0, 0.1, 0.25])
    x[:80] = x[0] + rng.normal(size=(80, d)) * 0.05
    return x.astype(np.float32)


def test_graph_search_recall():
    x = unit(clusters(1500))
    g = Graph.unpack(Graph.build(x, 3).pack())
    near = np.argsort(-(x @ x.T), axis=1, kind="stable")[:, :5]
    got, _ = g.search(x, 48)
    assert np.mean([len(set(a) & set(b[:5])) / 5 for a, b in zip(near.tolist(), got.tolist())]) > 0.9


def brute(ids, x, least=0.9):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= least
    np.fill_diagonal(linked, False)
    comp = list(range(len(ids)))
    for _ in range(len(ids)):
        new = [min([comp[i], *(comp[j] for j in np.flatnonzero(linked[i]))], key=lambda k: ids[k]) for i in range(len(ids))]
        if new == comp:
            break
        comp = new
    return linked.sum(axis=1), [ids[c] for c in comp]


def test_against_brute_force(spark):
    x = clusters(700, seed=5)
    ids = np.random.default_rng(1).permutation(5000)[:700].tolist()
    rows = [(int(i), [float(c) for c in v], 1, "x") for i, v in zip(ids, x)]
    odd = [(9001, None), (9002, [0.0] * 16), (9003, [None] * 16), (9004, [float("nan")] * 16), (9005, []), (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows + [(*o, 0, None) for o in odd], "vec_id long, embedding array<float>, label int, n_links string")
    got = {r.vec_id: r for r in near_duplicates(df, shard_rows=300).collect()}
    n, comp = brute(ids, x)
    total = sum(got[i].n_links for i in ids)
    assert 0.95 * n.sum() <= total <= n.sum()
    assert all(got[i].n_links <= k for i, k in zip(ids, n))
    assert np.mean([got[i].component_id == c for i, c in zip(ids, comp)]) > 0.95
    assert all(r.kept == (r.vec_id == r.component_id) for k, r in got.items() if k is not None)
    for i in range(9001, 9006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[9006].n_links, got[9007].component_id) == (1, 9006)
    assert got[None].component_id is None and not got[None].kept


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_counts_queries_and_not_links():
    truth = {i: (5000, 0.99) for i in range(120)} | {i: (1, 0.95) for i in range(120, 200)}
    got = {i: (5000, 0.99) for i in range(120)} | {i: (0, 0.5) for i in range(120, 200)}
    told = ed.recalls(truth, got)
    assert told["links from 4096"] == 1 and told["links from 1"] == 0 and told["links"] == 0.6
    # Without links the nearest neighbours are audited.
    assert ed.recalls({1: (0, 0.4), 2: (0, 0.3)}, {1: (0, 0.4), 2: (0, 0.1)}) == {"nearest": 0.5}


def test_a_link_found_from_one_end_counts_at_both():
    class Half:
        """A graph that finds nothing for one query."""

        def __init__(self, x, blind):
            self.x, self.blind = unit(x), blind

        def search(self, q, ef):
            sims = q @ self.x.T
            found = np.tile(np.arange(len(self.x)), (len(q), 1))
            found[self.blind] = -1
            return found, sims

        def flood(self, q, seeds, least):
            return seeds

    x = np.array([[1.0, 0.0], [1.0, 0.1], [0.0, 1.0]])
    a = {"ids": np.array([1, 2, 3]), "sizes": np.array([1, 4, 1]), "x": x, "graph": Half(x, 0)}
    (ids, n, _), = ed.ask_both(a, None, 3, 0.9)[0]
    assert dict(zip(ids.tolist(), n.tolist())) == {1: 4, 2: 1, 3: 0}
    b = {"ids": np.array([4, 5, 6]), "sizes": np.array([2, 1, 1]), "x": x, "graph": Half(x, 0)}
    ends, _ = ed.ask_both(a, b, 3, 0.9)
    assert [e[1].tolist() for e in ends] == [[1, 3, 1], [4, 5, 1]]


def test_small_groups_beside_a_large_one(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 64))
    x[:300] = x[0] + rng.normal(size=(300, 64)) * 0.05
    x[301:900:2] = x[300:900:2] + rng.normal(size=(300, 64)) * 0.15
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in near_duplicates(df, ef=2).collect()}
    n, _ = brute(list(range(900)), x)
    share = np.array([min(got[i], k) / k for i, k in enumerate(n) if k])
    assert share.mean() >= 0.97 and share[300:].mean() >= 0.97


def test_rare_links_among_many_vectors(spark):
    """One vector in 500 has a link: the audit draws on nearest neighbours, and the links are found."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 32))
    for i in range(4):
        x[1000 * i + 1] = x[1000 * i] + rng.normal(size=32) * 0.1
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in near_duplicates(df, shards=3).collect()}
    n, _ = brute(list(range(4000)), x)
    assert sum(k > 0 for k in n) == 8 and all(got[i] == k for i, k in enumerate(n) if k)
    assert all(got[i] <= k for i, k in enumerate(n))


def test_exact_where_no_beam_reaches_the_recall(spark):
    x = clusters(500, seed=9)
    ids = list(range(500))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in near_duplicates(df, ef=256, recall=1.1, shards=3).collect()}
    n, comp = brute(ids, x)
    assert [got[i].n_links for i in ids] == n.tolist()
    assert [got[i].component_id for i in ids] == comp
    assert {r.audited_recall for r in got.values()} == {1.0}
