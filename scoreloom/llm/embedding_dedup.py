"""Near-duplicate vectors by cosine, with a navigable small-world graph per shard.

Equal vectors are one class from the start. Classes are dealt to shards by
hash; a shard holds a bounded number, so its graph is built in one task.
Every class then asks every shard: a task holds two shards, which ask one
another. What a beam finds is checked by cosine in double precision; where a
beam is full of links, the chain of links is followed through the graph, so a
large group costs its links and no wider beam. A task reports a count for each
query, in which a link found from one end counts at both, and of its links
only a spanning forest, so that what is sent grows with the vectors and not
with the links.

The beam is found first: a bounded sample of queries is compared with all
vectors, and then asks every shard where it lies, with beams that double while
recall falls short. All vectors then ask once, with that beam, and each pair
of shards is sent once, in one shuffle. The number of shards follows the rows,
and for few rows the cores: what is sent is the vectors times the shards and
one, so shards are as large as a worker holds. Recall is
a mean over queries, for each power of two of links too, so that large groups
don't hide small ones; where few queries have a link, the nearest neighbours
of all count as well.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import connected_components, drop_scratch, materialise
from scoreloom.llm.hnsw import Graph, unit

LEAST = 0.9
#: Classes a shard holds at most, and at least where there are cores for more shards; queries searched at once;
#: tasks over pairs of shards at most.
SHARD_ROWS = 60_000
LEAST_ROWS = 4_000
BLOCK_ROWS = 4_096
PAIR_TASKS = 10_000
BEAM = 24
#: Queries of an audit, how many of them should have a link, the most that are drawn for that, and rows compared at once.
AUDIT = 200
AUDIT_LINKED = 100
AUDIT_MOST = 3_200
AUDIT_ROWS = 1_024
#: The recall at which beams stop widening.
RECALL = 0.98
SLACK = 1e-4


def _clean(v: list | None) -> np.ndarray | None:
    """A vector in double precision, or None where it can't have a cosine."""
    if v is None or len(v) == 0 or any(x is None for x in v):
        return None
    a = np.asarray(v, np.float64)
    return a if np.isfinite(a).all() and a.any() else None


def classes_of(rows: DataFrame) -> DataFrame:
    """vec_id, dim, key (digest of the vector) and vec (doubles); the last three are null for vectors without cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = [_clean(v) for v in b["embedding"].to_pylist()]
            raw = [None if v is None else (v + 0.0).tobytes() for v in vs]
            keys = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            dims = [None if v is None else len(v) for v in vs]
            yield pa.RecordBatch.from_arrays(
                [b["vec_id"], pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "dim", "key", "vec"]
            )

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(
        run, "vec_id long, dim int, key binary, vec binary"
    )


def _matrix(vecs: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float64) for v in vecs])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shard and length of vectors in a task."""
    got = list(batches)
    if got:
        t = pa.Table.from_batches(got)
        for key in t.group_by(["dim", "shard"]).aggregate([]).to_pylist():
            mine = pc.and_(pc.equal(t["dim"], key["dim"]), pc.equal(t["shard"], key["shard"]))
            yield from _pack_shard(t.filter(mine)).to_batches()


def _pack_shard(t: pa.Table) -> pa.Table:
    """One row a shard: ids, sizes and vectors of its classes, and the graph."""
    order = np.argsort(t["id"].to_numpy())
    ids, m = t["id"].to_numpy()[order], t["m"].to_numpy()[order]
    x = _matrix([t["vec"][int(i)].as_py() for i in order])
    graph = Graph.build(unit(x), seed=int(t["shard"][0].as_py()) + 1)
    return pa.table(
        {
            "dim": t["dim"].slice(0, 1),
            "shard": t["shard"].slice(0, 1),
            "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()),
            "sizes": pa.array([m.astype(np.int64).tobytes()], pa.binary()),
            "vecs": pa.array([_narrow(x).tobytes()], pa.binary()),
            "graph": pa.array([graph.pack(vectors=False)], pa.binary()),
        }
    )


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in half the bytes, where single precision holds all of them."""
    half = x.astype(np.float32)
    return half if (half == x).all() else x


def _shard(r: dict) -> dict:
    ids = np.frombuffer(r["ids"], np.int64)
    wide = len(r["vecs"]) == 8 * len(ids) * r["dim"]
    x = np.frombuffer(r["vecs"], np.float64 if wide else np.float32).reshape(len(ids), -1).astype(np.float64)
    return {"ids": ids, "x": x, "sizes": np.frombuffer(r["sizes"], np.int64), "graph": Graph.unpack(r["graph"], unit(x))}


class Found:
    """Which of ``n_x`` vectors each of ``n_q`` queries links with: keys for short lists, bits for long ones."""

    def __init__(self, n_q: int, n_x: int):
        self.n_x, self.keys, self.bits, self.row = n_x, [], [], np.full(n_q, -1, np.int64)

    def add(self, i: int, near: np.ndarray) -> None:
        if len(near) * 64 > self.n_x:
            mine = np.zeros(self.n_x, bool)
            mine[near] = True
            self.row[i] = len(self.bits)
            self.bits.append(np.packbits(mine, bitorder="little"))
        elif len(near):
            self.keys.append(i * self.n_x + np.sort(near))

    def close(self) -> Found:
        self.keys = np.sort(np.concatenate(self.keys)) if self.keys else np.zeros(0, np.int64)
        self.bits = np.stack(self.bits) if self.bits else np.zeros((0, 0), np.uint8)
        return self

    def has(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        row = self.row[i]
        long = row >= 0
        out[long] = (self.bits[row[long], j[long] >> 3] >> (j[long] & 7).astype(np.uint8)) & 1
        if len(self.keys):
            key = i[~long] * self.n_x + j[~long]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[~long] = self.keys[at] == key
        return out

    def lists(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All links as (query, vector), in parts."""
        yield self.keys // self.n_x, self.keys % self.n_x
        for i in np.flatnonzero(self.row >= 0):
            j = np.flatnonzero(np.unpackbits(self.bits[self.row[i]], count=self.n_x, bitorder="little"))
            yield np.full(len(j), i), j


def _forest():
    """A function that tells whether a link joins two parts."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        top = v
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[v] != top:
            root[v], v = top, root[v]
        return top

    def join(a: int, b: int) -> bool:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
        return a != b

    return join


def _all_near(shard: dict, qu: np.ndarray, q_ids: np.ndarray, least: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Vectors of a shard near each query, and the best cosine of each, by comparing them with all."""
    near, best = [np.zeros(0, np.int64)] * len(qu), np.full(len(qu), -2.0)
    u = unit(shard["x"])
    for at in range(0, len(qu), AUDIT_ROWS):
        sims = qu[at : at + AUDIT_ROWS] @ u.T
        sims[q_ids[at : at + AUDIT_ROWS, None] == shard["ids"][None, :]] = -2.0
        best[at : at + AUDIT_ROWS] = sims.max(axis=1)
        near[at : at + AUDIT_ROWS] = [np.flatnonzero(row >= least - SLACK) for row in sims]
    return near, best


def ask(shard: dict, asker: dict, ef: int | None, least: float, join):
    """Links of the vectors of a shard in another or the same: Found, edges that ``join`` parts, and the best cosine of each.

    Without a beam (``ef`` None) all are compared with all.
    """
    graph, x, ids, q, q_ids = shard["graph"], shard["x"], shard["ids"], asker["x"], asker["ids"]
    norm, q_norm = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
    links, edges, best = Found(len(q), len(x)), [], np.full(len(q), -2.0)
    for at in range(0, len(q), BLOCK_ROWS):
        qu = unit(q[at : at + BLOCK_ROWS])
        if ef is None:
            hits, best[at : at + len(qu)] = _all_near(shard, qu, q_ids[at : at + len(qu)], least)
            n_hit = np.array([len(h) for h in hits])
        else:
            found, sims = graph.search(qu, ef)
            other = np.where((found >= 0) & (ids[found] != q_ids[at : at + len(qu), None]), sims, -2.0)
            best[at : at + len(qu)] = other.max(axis=1)
            hit = (sims >= least - SLACK) & (found >= 0)
            n_hit = hit.sum(axis=1)
        for k in np.flatnonzero(n_hit):
            i = at + int(k)
            near = hits[k] if ef is None else found[k][hit[k]]
            if ef is not None and n_hit[k] * 2 >= found.shape[1]:
                near = graph.flood(qu[k], near, least - SLACK)
            exact = x[near] @ q[i] / (norm[near] * q_norm[i])
            near = near[(exact >= least) & (ids[near] != q_ids[i])]
            links.add(i, near)
            mine = int(q_ids[i])
            edges += [(mine, o) for o in ids[near].tolist() if join(mine, o)]
    return links.close(), edges, best


def ask_both(a: dict, b: dict | None, ef: int | None, least: float):
    """Links between two shards, or within one: (ids, n_links, best cosine) of each shard, and a spanning forest as edges.

    A link counts at both its ends, whichever end found it.
    """
    join = _forest()
    sides = [(a, b), (b, a)] if b else [(a, a)]
    told = [ask(shard, asker, ef, least, join) for asker, shard in sides]
    counts = [np.zeros(len(asker["ids"]), np.int64) for asker, _ in sides]
    for side, (asker, shard) in enumerate(sides):
        links, back = told[side][0], told[1 - side][0] if b else told[side][0]
        for i, j in links.lists():
            np.add.at(counts[side], i, shard["sizes"][j])
            missed = ~back.has(j, i)
            np.add.at(counts[len(sides) - 1 - side], j[missed], asker["sizes"][i[missed]])
    return [(asker["ids"], n, t[2]) for (asker, _), n, t in zip(sides, counts, told)], [e for t in told for e in t[1]]


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch[name][i].as_py() for name in batch.schema.names}


def _pass(graphs: DataFrame, n_shards: int, ef: int | None, least: float) -> DataFrame:
    """(a, b, n, near): n links and the best cosine of a with a shard (b null), or an edge of the forest (n null).

    Each shard is sent once for each partner's number, so nobody lists pairs;
    a shard whose partner has no rows of its length is read and left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for r in _rows_of(batches):
            # The two shards of a pair follow one another.
            if r["shard"] == r["partner"]:
                ends, edges = ask_both(_shard(r), None, ef, least)
            elif held.get("pair") == (r["pair"], r["dim"]):
                ends, edges = ask_both(held.pop("shard"), _shard(r), ef, least)
            else:
                held = {"pair": (r["pair"], r["dim"]), "shard": _shard(r)}
                continue
            left = np.concatenate([*(e[0] for e in ends), np.array([e[0] for e in edges], np.int64)])
            n_told = len(left) - len(edges)
            right = [*[None] * n_told, *(o for _, o in edges)]
            n = [*np.concatenate([e[1] for e in ends]).tolist(), *[None] * len(edges)]
            near = [*np.concatenate([e[2] for e in ends]).tolist(), *[None] * len(edges)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip((left, right, n, near), kinds)], ["a", "b", "n", "near"])

    tasks = max(1, min(n_shards * (n_shards + 1) // 2, PAIR_TASKS))
    low, high = F.least("shard", "partner"), F.greatest("shard", "partner")
    sent = graphs.withColumn("partner", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))))
    # Pairs (0, 0), (0, 1), (1, 1), (0, 2), ... by number.
    sent = sent.withColumn("pair", (high * (high + 1) / 2).cast("long") + low)
    rows = sent.repartitionById(tasks, F.pmod("pair", F.lit(tasks)).cast("int")).sortWithinPartitions("pair", "dim", "shard")
    return rows.mapInArrow(run, "a long, b long, n long, near double")


def probe(graphs: DataFrame, sample: list, ef: int, least: float) -> dict[int, tuple[int, float]]:
    """(links, best cosine) that the sampled (id, dim, vec) find by asking every shard, where it lies, with a beam."""
    by_dim = {dim: [s for s in sample if s["dim"] == dim] for dim in {s["dim"] for s in sample}}
    askers = {dim: {"ids": np.array([s["id"] for s in mine]), "x": _matrix([s["vec"] for s in mine])} for dim, mine in by_dim.items()}
    sent = graphs.sparkSession.sparkContext.broadcast(askers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows_of(batches):
            asker = sent.value.get(r["dim"])
            if asker is not None:
                shard = _shard(r)
                links, _, best = ask(shard, asker, ef, least, lambda a, b: False)
                n = np.zeros(len(best), np.int64)
                for i, j in links.lists():
                    np.add.at(n, i, shard["sizes"][j])
                yield pa.RecordBatch.from_arrays([pa.array(asker["ids"], pa.int64()), pa.array(n, pa.int64()), pa.array(best, pa.float64())], ["a", "n", "near"])

    told = graphs.mapInArrow(run, "a long, n long, near double").groupBy("a").agg(F.sum("n").alias("n"), F.max("near").alias("near"))
    got = {r["a"]: (r["n"], r["near"]) for r in told.collect()}
    sent.destroy()
    return got


def audit(classes: DataFrame, sample: list, least: float) -> DataFrame:
    """(a, truth, near): how many vectors the sampled (id, dim, vec) link with and their best cosine, by comparing them with all."""
    by_dim: dict[int, tuple] = {}
    for dim in {s["dim"] for s in sample}:
        mine = [s for s in sample if s["dim"] == dim]
        q = _matrix([s["vec"] for s in mine])
        by_dim[dim] = (np.array([s["id"] for s in mine]), q / np.linalg.norm(q, axis=1, keepdims=True))
    sent = classes.sparkSession.sparkContext.broadcast(by_dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, ids, m = b["dim"].to_numpy(), b["id"].to_numpy(), b["m"].to_numpy()
            left, n, near = [], [], []
            for dim, (q_ids, q) in sent.value.items():
                mine = np.flatnonzero(dims == dim)
                if not len(mine):
                    continue
                total, best = np.zeros(len(q_ids), np.int64), np.full(len(q_ids), -2.0)
                for at in range(0, len(mine), AUDIT_ROWS):
                    part = mine[at : at + AUDIT_ROWS]
                    x = _matrix([b["vec"][int(i)].as_py() for i in part])
                    sims = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ q.T
                    sims[ids[part][:, None] == q_ids[None, :]] = -2.0
                    total += m[part] @ (sims >= least)
                    best = np.maximum(best, sims.max(axis=0))
                left += q_ids.tolist()
                n += total.tolist()
                near += best.tolist()
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip((left, n, near), kinds)], ["a", "n", "near"])

    told = classes.select("id", "dim", "m", "vec").mapInArrow(run, "a long, n long, near double")
    return told.groupBy("a").agg(F.sum("n").alias("truth"), F.max("near").alias("near"))


def draw_audit(classes: DataFrame, n: int, least: float) -> tuple[list, dict[int, tuple[int, float]]]:
    """Sampled rows, and (links, best cosine) by id; the sample grows until enough have a link, or to its bound."""
    out: dict[int, tuple[int, float]] = {}
    size = AUDIT
    while True:
        sample = classes.orderBy(F.xxhash64("key", F.lit(2)), "id").limit(size).select("id", "dim", "vec").collect()
        fresh = [s for s in sample if s["id"] not in out]
        if fresh:
            out.update({r["a"]: (r["truth"], r["near"]) for r in audit(classes, fresh, least).collect()})
        if sum(t > 0 for t, _ in out.values()) >= AUDIT_LINKED or size >= min(n, AUDIT_MOST):
            return sample, out
        size = min(size * 4, AUDIT_MOST)


def recalls(truth: dict[int, tuple[int, float]], got: dict[int, tuple[int, float]]) -> dict[str, float]:
    """Mean share of its links that a query found: of all that have one, and of those of each power of two of links.

    Where too few sampled queries have a link, also the share of queries whose
    nearest other vector was found.
    """
    shares: dict[str, list[float]] = {}
    for a, (t, _) in truth.items():
        if t:
            share = min(got.get(a, (0, 0))[0], t) / t
            shares.setdefault("links", []).append(share)
            shares.setdefault(f"links from {1 << (t.bit_length() - 1)}", []).append(share)
    if len(shares.get("links", [])) < AUDIT_LINKED:
        near = [float(got.get(a, (0, -2.0))[1] >= best - SLACK) for a, (_, best) in truth.items() if best > -2.0]
        if near:
            shares["nearest"] = near
    return {k: float(np.mean(v)) for k, v in shares.items()}


def graph_cores(rows: DataFrame) -> int:
    """The number of shards whose pairs give each core one."""
    return math.ceil((math.sqrt(8 * rows.sparkSession.sparkContext.defaultParallelism + 1) - 1) / 2)


def near_duplicates(rows: DataFrame, least: float = LEAST, ef: int = BEAM, recall: float = RECALL, shard_rows: int = SHARD_ROWS, shards: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept and audited_recall of every row of ``rows`` (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, nor do vectors of different lengths with one another.
    Equal vectors link with one another; repeated rows of an id count as
    other vectors. A null vec_id gets no component and is not kept; its
    vector counts for no other. component_id is the smallest vec_id reachable
    by links that were found; all of them were checked. audited_recall is
    what the sample's queries found with the beam in the end, the least of
    the audited means; where the widest beam falls short, shards are compared
    whole, and it is 1. Other columns are ignored.
    """
    all_ = materialise(classes_of(rows), "vectors")
    valid = all_.where("key is not null and vec_id is not null")
    classes = materialise(
        valid.groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"), F.first("dim").alias("dim"), F.first("vec").alias("vec")), "vector-classes"
    )
    n = classes.count()
    cores = graph_cores(rows) if shards is None else 1
    n_shards = shards or max(1, math.ceil(n / shard_rows), min(cores, math.ceil(n / LEAST_ROWS)))
    placed = classes.select("id", "m", "dim", "vec", F.pmod(F.xxhash64("key"), F.lit(n_shards)).alias("shard"))
    shape = "dim int, shard long, ids binary, sizes binary, vecs binary, graph binary"
    # A task a shard, by its number.
    graphs = materialise(placed.repartitionById(n_shards, F.col("shard").cast("int")).select("dim", "shard", "id", "m", "vec").mapInArrow(_build, shape), "vector-graphs")
    sample, truth = draw_audit(classes, n, least)
    audited = 1.0
    while truth:
        audited = min(recalls(truth, probe(graphs, sample, ef, least)).values(), default=1.0)
        if audited >= recall:
            break
        if ef >= min(shard_rows, n):
            # No beam is wide enough: all vectors of a pair of shards are compared.
            ef, audited = None, 1.0
            break
        ef *= 2
    found = materialise(_pass(graphs, n_shards, ef, least), "vector-links")
    drop_scratch(graphs)
    counts = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("n_found"))
    labels = connected_components(found.where("b is not null").select("a", "b"), "vectors-cc")
    told = classes.select("key", "id", "m").join(counts, F.col("id") == F.col("a"), "left").join(labels, F.col("id") == F.col("v"), "left")
    told = materialise(told.select("key", (F.col("m") - 1 + F.coalesce("n_found", F.lit(0))).alias("links"), F.coalesce("c", "id").alias("c")), "vector-told")
    named = F.col("vec_id").isNotNull()
    return (
        all_.select("vec_id", "key")
        .join(told, "key", "left")
        .select("vec_id", F.when(named, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(named, F.coalesce("c", "vec_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
        .withColumn("audited_recall", F.lit(audited))
    )
