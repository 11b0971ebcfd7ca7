"""Jaccard join of word-shingle sets, size-aware with light and heavy sets.

Equal sets are one *class* from the start, so exact copies cost one row.
Between classes the join follows the size-aware scheme of Deng, Tao and Li
(2018). Two sets with ``100 * |A n B| >= t * |A u B|`` miss at most
``floor((1 - t/100) |A|)`` of A's elements, so under one global order of the
elements

* **heavy** sets share one of the first ``miss + 1`` elements: each such
  element has an inverted list, which is scanned;
* **light** sets share both of a pair from the first ``miss + 2`` elements:
  all subsets of the fixed size two are enumerated as keys, which few other
  sets have.

Light sets meet light sets by pairs, heavy sets meet all by lists; sets just
below the boundary are in both. The boundary is the size at which pairs get
dearer than lists, by the cost of both on a sample (it moves cost, never
results). The order puts frequent elements last: their counts come from a
sketch of fixed size over the whole corpus, so passages that many texts share
are no keys of any text that has enough words of its own. A counter of the
sketch stands for more elements the larger the corpus is, and then elements
that some dozens of unlike texts share look as rare as others. So the order is
mended by the lists themselves: elements of long lists most of whose classes
can't link with the list's leader are *late*, they come behind all others.
Only classes with a late element among their keys get other keys; their texts
are read again.

Lists of more than ``STAR`` classes are not paired up. Every class is compared
with its list's most typical class, the leader L; a list whose classes are now
one component is done, and one with few pairs across its components compares
these. In the others, two classes A and B that link have

    |A n B| <= min(|A n L|, |B n L|) + |(A - L) n (B - L)|,

so either the first part is enough, which is checked on numbers that are known
by then, or they share one of the first ``miss + 1`` elements outside L. These
elements make new lists, and the list goes round again without L's elements.
Near copies differ from L by little, so their new lists are short, and a large
group costs its members, not its pairs. Components so found are those of all
links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.common import connected_components, drop_scratch, fresh, materialise, release, slices
from scoreloom.llm.words import common, digest, shingle_set

#: Counters of the frequency sketch, and the parts in which it is summed.
SKETCH_BITS = 22
SKETCH_PARTS = 64
#: Longest list whose classes are all paired up at once.
STAR = 12
#: Rounds of comparison with leaders before lists are paired up whatever their length.
ROUNDS = 6
#: Rows of the sample that chooses the boundary, and the largest boundary.
COST_ROWS = 2_000
KEY_COST = 4
LARGEST_BOUNDARY = 400
#: Rounds in which elements of long lists of unlike classes become late, and the most of them, 8 bytes each in every worker.
REORDERS = 3
LATE = 1_000_000
#: Bits of a set of keys in which postings are looked up before a shuffle: 8 MB.
BITS = 26
#: Ids up to which the texts to compare are picked by a broadcast join: 16 MB of longs at most.
BROADCAST_IDS = 2_000_000
#: Copies (an id and a digest of 16 bytes) up to which they are broadcast: 64 MB at most.
BROADCAST_COPIES = 500_000


def most_missing(n: int, t: int) -> int:
    """Elements that a set of size n can lack in a partner's set and still link."""
    return (n * (100 - t)) // 100


# --- the frequency sketch -------------------------------------------------


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Frequency level (log2 of a hashed count) of every counter over all texts."""
    size, width = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // SKETCH_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for b in slices(batches):
            for t in b["text"].to_pylist():
                total[shingle_set(t, k) >> np.uint64(64 - SKETCH_BITS)] += 1
        press = zstandard.ZstdCompressor(level=1).compress
        rows = [(i, part) for i, part in enumerate(total.reshape(SKETCH_PARTS, width)) if part.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in rows], pa.int32()), pa.array([press(p.tobytes()) for _, p in rows], pa.binary())], ["part", "counts"]
        )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unpress = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for i, c in zip(b["part"].to_pylist(), b["counts"].to_pylist()):
                part = sums.setdefault(i, np.zeros(width, np.uint64))
                part += np.frombuffer(unpress(c), np.uint32)
        levels = [np.log2(np.maximum(v, 1)).astype(np.uint8).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["part", "levels"])

    parts = docs.select("text").mapInArrow(count, "part int, counts binary")
    got = parts.repartition(SKETCH_PARTS, "part").mapInArrow(total, "part int, levels binary").toArrow()
    levels = np.zeros((SKETCH_PARTS, width), np.uint8)
    for i, b in zip(got["part"].to_pylist(), got["levels"].to_pylist()):
        levels[i] = np.frombuffer(b, np.uint8)
    return levels.reshape(-1)


def ordered(s: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, float]:
    """A set in the global order, rare elements first, and its mean frequency level."""
    level = levels[s >> np.uint64(64 - SKETCH_BITS)]
    return s[np.argsort(level, kind="stable")], float(level.mean()) if len(s) else 0.0


# --- keys -----------------------------------------------------------------

_PAIR = np.uint64(0xBF58476D1CE4E5B9)
_HEAVY = np.uint64(0x94D049BB133111EB)
_TINY = np.uint64(0xC2B2AE3D27D4EB4F)
_NONE = np.zeros(0, np.uint64)


def behind(s: np.ndarray, late: np.ndarray) -> np.ndarray:
    """A set in the global order with its late elements last; ``late`` has their keys, sorted."""
    if not len(late):
        return s
    h = s * _HEAVY
    hit = late[np.minimum(np.searchsorted(late, h), len(late) - 1)] == h
    return np.concatenate([s[~hit], s[hit]])


def keys(s: np.ndarray, t: int, boundary: int, late: np.ndarray = _NONE) -> np.ndarray:
    """Keys of a set in the global order; sets that can only link with their equals have none."""
    n = len(s)
    if 100 * n < t * (n + 1):
        return s[:0]
    miss = most_missing(n, t)
    light = heavy = s[:0]
    if n <= boundary:
        p = s[: miss + 2]
        i, j = np.triu_indices(len(p), 1)
        light = (p[i] * _PAIR) ^ (p[j] + (p[i] >> np.uint64(29)))
    # Sets that a set above the boundary can link with are in the lists too.
    if 100 * n >= t * (boundary + 1):
        heavy = behind(s, late)[: miss + 1] * _HEAVY
    # A pair of elements can't be shared where one common element may do.
    tiny = s[: miss + 1] * _TINY if n * t <= 100 else s[:0]
    return np.concatenate([light, heavy, tiny])


def choose_boundary(docs: DataFrame, k: int, t: int, levels: Broadcast) -> int:
    """The size up to which pairs of elements cost less than lists, on a sample of the texts."""
    n = docs.count()
    if not n:
        return 0

    load = 2 * float(np.exp2(levels.value.astype(float)).mean())

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, longs = [], []
        for b in slices(batches):
            for text in b["text"].to_pylist():
                s, _ = ordered(shingle_set(text, k), levels.value)
                head = s[: most_missing(len(s), t) + 1]
                if len(head):
                    sizes.append(len(head) - 1)
                    # A counter holds many elements, so its mean load is no list's length.
                    lists = np.exp2(levels.value[head >> np.uint64(64 - SKETCH_BITS)].astype(float)) - load
                    longs.append(float(np.clip(lists, 0, STAR).mean()))
        yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(longs, pa.float64())], ["miss", "list"])

    rows = docs.select("text").sample(min(1.0, COST_ROWS / n), seed=5).mapInArrow(cost, "miss int, list double")
    best = 0
    for r in rows.where(f"miss <= {most_missing(LARGEST_BOUNDARY, t)}").groupBy("miss").agg(F.avg("list").alias("l")).collect():
        m = r["miss"]
        # A key is written, sorted and sent; an entry of a list is only read (of long lists, STAR at most).
        if KEY_COST * (m + 2) * (m + 1) / 2 <= (m + 1) * (KEY_COST + r["l"]):
            best = max(best, m)
    # The largest size with that many missing.
    size = 0
    while size < LARGEST_BOUNDARY and most_missing(size + 1, t) <= best:
        size += 1
    return size


# --- classes and postings -------------------------------------------------

SIZE_BITS = 40


def _size(info: str = "info") -> F.Column:
    return F.col(info).bitwiseAND(F.lit((1 << SIZE_BITS) - 1))



def shingle_rows(docs: DataFrame, k: int, t: int, levels: Broadcast, boundary: int) -> DataFrame:
    """doc_id, n_shingles, fp (digest of the set, null without words), info, keys and outline of every row.

    info is the mean frequency level in thousandths above the size, in one
    long that orders classes from least to most typical.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            size, fp, info, found, outlines = [], [], [], [], []
            for text in b["text"].to_pylist():
                s = shingle_set(text, k)
                size.append(len(s))
                fp.append(digest(s) if len(s) else None)
                outlines.append(outline(s))
                s, mean = ordered(s, levels.value)
                info.append(round(mean * 1000) << SIZE_BITS | len(s))
                found.append(keys(s, t, boundary).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(size, pa.int64()), pa.array(fp, pa.binary()), pa.array(info, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(outlines, pa.binary())],
                ["doc_id", "n_shingles", "fp", "info", "keys", "outline"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, fp binary, info long, keys array<long>, outline binary")


def outline(s: np.ndarray) -> bytes:
    """Numbers of elements by leading hash bits, some eight a number; 255 stands for any number from there on."""
    bits = min(12, max(4, int(np.ceil(np.log2(max(1, len(s)) / 8)))))
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def may_link(a: bytes, b: bytes, na: int, nb: int, t: int) -> bool:
    """Whether two sets can link by their outlines: no range has more common elements than its lesser number.

    Never false for sets that link; full ranges decide nothing.
    """
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (a, b))
    if (x == 255).any() or (y == 255).any():
        return True
    n = min(len(x), len(y))
    most = int(np.minimum(x.reshape(n, -1).sum(axis=1), y.reshape(n, -1).sum(axis=1)).sum())
    return (100 + t) * most >= t * (na + nb)


def _key_bits(postings: DataFrame) -> np.ndarray:
    """A bit for each value of the leading ``BITS`` bits of a key, set where ``postings`` (x) have one."""
    size, width = 1 << BITS - 3, (1 << BITS - 3) // SKETCH_PARTS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for b in batches:
            at = b["x"].to_numpy().view(np.uint64) >> np.uint64(64 - BITS)
            np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        press = zstandard.ZstdCompressor(level=1).compress
        rows = [(i, press(p.tobytes())) for i, p in enumerate(bits.reshape(SKETCH_PARTS, width)) if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], ["part", "bits"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        unpress = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for i, p in zip(b["part"].to_pylist(), b["bits"].to_pylist()):
                part = found.setdefault(i, np.zeros(width, np.uint8))
                part |= np.frombuffer(unpress(p), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], ["part", "bits"])

    parts = postings.select("x").mapInArrow(mark, "part int, bits binary")
    got = parts.repartition(SKETCH_PARTS, "part").mapInArrow(either, "part int, bits binary").toArrow()
    bits = np.zeros((SKETCH_PARTS, width), np.uint8)
    for i, b in zip(got["part"].to_pylist(), got["bits"].to_pylist()):
        bits[i] = np.frombuffer(b, np.uint8)
    return bits.reshape(-1)


def _having(classes: DataFrame, bits: Broadcast) -> DataFrame:
    """Postings (id, info, x) of the classes whose key has its bit set; all of a key or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            x = b["keys"].flatten().to_numpy().view(np.uint64)
            at = x >> np.uint64(64 - BITS)
            hit = np.flatnonzero(bits.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
            row = pa.array(np.repeat(np.arange(b.num_rows), b["keys"].value_lengths().to_numpy())[hit])
            yield pa.RecordBatch.from_arrays([b["id"].take(row), b["info"].take(row), pa.array(x[hit].view(np.int64))], ["id", "info", "x"])

    return classes.select("id", "info", "keys").mapInArrow(run, "id long, info long, x long")


def _plausible(pairs: DataFrame, outlines: DataFrame, t: int) -> DataFrame:
    """Pairs (a, b, star) without those that their outlines rule out; star pairs all stay."""
    left = outlines.select(F.col("id").alias("a"), F.col("outline").alias("oa"), F.col("n").alias("na"))
    right = outlines.select(F.col("id").alias("b"), F.col("outline").alias("ob"), F.col("n").alias("nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ok = [may_link(*r, t) for r in zip(*(b[c].to_pylist() for c in ("oa", "ob", "na", "nb")))]
            yield b.select(["a", "b", "star"]).filter(pa.array(ok, pa.bool_()))

    plain = pairs.where("not star").join(right, "b").join(left, "a").select("a", "b", "star", "oa", "ob", "na", "nb").mapInArrow(run, "a long, b long, star boolean")
    return plain.unionByName(pairs.where("star").select("a", "b", "star"))


# --- exact comparison -----------------------------------------------------


def compare(pairs: DataFrame, texts: DataFrame, k: int, t: int, levels: Broadcast) -> DataFrame:
    """Exact overlap of pairs (a, b, star) of class ids: a, b, both (size of the intersection), linked and rest.

    rest has the first ``miss + 1`` elements of b outside a, for star pairs.
    Each text travels as text, which the shuffle compresses well, and the
    left text's set is kept while rows share it.
    """
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in slices(batches, 64):
            both, linked, rest = [], [], []
            for a, star, text_a, text_b in zip(b["a"].to_pylist(), b["star"].to_pylist(), b["text_a"].to_pylist(), b["text_b"].to_pylist()):
                if a not in held:
                    if len(held) >= 16:
                        held.clear()
                    held[a] = shingle_set(text_a, k)
                mine, other = held[a], shingle_set(text_b, k)
                n = common(mine, other)
                union = len(mine) + len(other) - n
                both.append(n)
                linked.append(union > 0 and 100 * n >= t * union)
                outside = np.setdiff1d(other, mine, assume_unique=True) if star else other[:0]
                rest.append(ordered(outside, levels.value)[0][: most_missing(len(other), t) + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b["a"], b["b"], pa.array(both, pa.int64()), pa.array(linked, pa.bool_()), pa.array(rest, pa.list_(pa.int64()))], ["a", "b", "both", "linked", "rest"]
            )

    return pairs.select("a", "b", "star").join(right, "b").join(left, "a").select("a", "b", "star", "text_a", "text_b").mapInArrow(
        run, "a long, b long, both long, linked boolean, rest array<long>"
    )


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of the given class ids; the ids are broadcast while they are known to be few."""
    n = ids.count()
    picked = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    return docs.where("doc_id is not null").join(picked, docs.doc_id == ids.id, "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.max("text").alias("text"))


def _similar_size(a: str, b: str, t: int) -> F.Column:
    return 100 * F.least(a, b) >= t * F.greatest(a, b)


def _listed(postings: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Postings (x, id, info) of the keys that more than one class has, with n, m and the leader of the list.

    Where ``classes`` are what the postings come from, those of keys that one
    class has are dropped before they are shuffled a second time.
    """
    lists = materialise(
        postings.groupBy("x")
        .agg(F.count("*").alias("m"), F.max(F.struct("info", F.negative("id").alias("minus"))).alias("top"))
        .where("m > 1")
        .select("x", "m", (-F.col("top.minus")).alias("leader"), _size("top.info").alias("leader_n")),
        "jaccard-lists",
    )
    if classes is not None:
        release(classes.sparkSession)
        postings = _having(classes, classes.sparkSession.sparkContext.broadcast(_key_bits(lists)))
    listed = materialise(postings.join(lists, "x").select("x", "id", "info", _size().alias("n"), "m", "leader", "leader_n"), "jaccard-listed")
    drop_scratch(lists)
    return listed


def _unlike(listed: DataFrame, outlines: DataFrame, t: int, boundary: int) -> DataFrame:
    """Long lists (x, m) of heavy sets fewer than half of whose classes may link with the leader, or are it."""
    # Sets of these sizes have no other keys than elements.
    long = listed.where(F.col("m") > STAR)
    pairs = long.where((F.col("id") != F.col("leader")) & _similar_size("n", "leader_n", t)).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    alike = _plausible(pairs.withColumn("star", F.lit(False)), outlines, t).select("a", "b")
    rows = long.join(alike.distinct().hint("merge"), (F.col("leader") == F.col("a")) & (F.col("id") == F.col("b")), "left")
    lists = rows.groupBy("x").agg(F.first("m").alias("m"), F.count("a").alias("like"), F.min("n").alias("least"))
    return lists.where((2 * (F.col("like") + 1) < F.col("m")) & (F.col("least") > max(boundary, 100 // t))).select("x", "m")


def _moved(docs: DataFrame, ids: DataFrame, copies: DataFrame, k: int, t: int, levels: Broadcast, boundary: int, orders: Broadcast) -> DataFrame:
    """Postings (id, info, x) that the classes of ``ids`` have in the second of two orders but not in the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, late = orders.value
        for b in slices(batches, 128):
            fp, info, found = [], [], []
            for text in b["text"].to_pylist():
                s = shingle_set(text, k)
                fp.append(digest(s) if len(s) else None)
                s, mean = ordered(s, levels.value)
                info.append(round(mean * 1000) << SIZE_BITS | len(s))
                found.append(np.setdiff1d(keys(s, t, boundary, late), keys(s, t, boundary, before)).view(np.int64))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fp, pa.binary()), pa.array(info, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "fp", "info", "keys"])

    picked = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    rows = docs.where("doc_id is not null").join(picked, docs.doc_id == ids.id, "left_semi").select("doc_id", "text").mapInArrow(run, "doc_id long, fp binary, info long, keys array<long>")
    return rows.where("fp is not null").join(copies, ["doc_id", "fp"], "left_anti").select(F.col("doc_id").alias("id"), "info", F.explode("keys").alias("x"))


def _reordered(docs: DataFrame, classes: DataFrame, copies: DataFrame, listed: DataFrame, outlines: DataFrame, k: int, t: int, levels: Broadcast, boundary: int) -> DataFrame:
    """The lists after elements of long lists of unlike classes have become late.

    Which elements are late moves cost, never results, so there may be a most
    of them. A class without a late element among its keys keeps its keys, and
    the others lose these and get the next ones, whose lists are made anew
    from all classes that have them.
    """
    sc, late, extra = docs.sparkSession.sparkContext, _NONE, None
    for _ in range(REORDERS):
        unlike = materialise(_unlike(listed, outlines, t, boundary), "jaccard-unlike")
        if len(late) + unlike.count() > LATE:
            unlike = materialise(unlike.orderBy(F.desc("m"), "x").limit(LATE - len(late)), "jaccard-unlike")
        found = unlike.select("x").toArrow()["x"].to_numpy().view(np.uint64)
        if not len(found):
            break
        orders = sc.broadcast((late, np.union1d(late, found)))
        late = orders.value[1]
        ids = materialise(listed.join(F.broadcast(unlike.select("x")), "x").select("id").distinct(), "jaccard-moved")
        more = materialise(_moved(docs, ids, copies, k, t, levels, boundary, orders), "jaccard-more")
        xs = materialise(more.select("x").distinct(), "jaccard-more-keys")
        few = xs.count() <= BROADCAST_IDS
        had = _having(classes, sc.broadcast(_key_bits(more)))
        extra = more if extra is None else extra.unionByName(more)
        had = materialise(had.unionByName(extra).join(F.broadcast(xs) if few else xs.hint("merge"), "x", "left_semi"), "jaccard-had")
        added = _listed(had)
        gone = xs.union(unlike.select("x"))
        kept = listed.join(F.broadcast(gone) if few else gone.hint("merge"), "x", "left_anti")
        mended = materialise(kept.unionByName(added), "jaccard-listed")
        drop_scratch(listed, had, added, ids, unlike, xs)
        release(docs.sparkSession)
        listed = mended
    return listed


def _short_pairs(listed: DataFrame, t: int) -> DataFrame:
    """All pairs of the short lists, by an array of at most STAR classes; of different components where those are known."""
    rows = listed.where(F.col("m") <= STAR).groupBy("x").agg(F.sort_array(F.collect_list(F.struct("id", "n", "comp"))).alias("all"))
    pair = F.transform("all", lambda p: F.transform(F.filter("all", lambda q: (q["id"] > p["id"]) & (q["comp"] != p["comp"])), lambda q: F.struct(p["id"].alias("a"), p["n"].alias("na"), q["id"].alias("b"), q["n"].alias("nb"))))
    return rows.select(F.explode(F.flatten(pair)).alias("p")).select("p.*").where(_similar_size("na", "nb", t)).select("a", "b")


def _with_components(listed: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return listed.withColumn("comp", F.col("id"))
    return listed.join(labels, listed.id == labels.v, "left").withColumn("comp", F.coalesce("c", "id")).drop("v", "c")


def _numbers_suffice(mixed: DataFrame, tested: DataFrame, t: int) -> DataFrame:
    """Pairs of mixed lists that may link by their leader's elements alone.

    Such a pair needs as much in common with the leader as a link needs in
    all. One of the two is then smaller than the leader, or it would have
    linked with the leader itself; and one is outside the list's main
    component, so the join visits at most twice the pairs across.
    """
    own = tested.select(F.col("a").alias("leader"), F.col("b").alias("id"), "both")
    rows = mixed.join(own, ["leader", "id"], "left").withColumn("both", F.when(F.col("id") == F.col("leader"), F.col("n")).otherwise(F.coalesce("both", F.lit(0))))
    rows = materialise(rows.where(100 * F.col("both") >= t * F.col("n")).select("x", "id", "n", "comp", "main", "both", "leader_n"), "jaccard-near")
    other = rows.where("comp <> main").select("x", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("comp").alias("comp2"), F.col("both").alias("both2"))
    enough = t * (F.col("n") + F.col("n2")) <= (100 + t) * F.least("both", "both2")
    return (
        rows.join(other, "x")
        .where((F.col("comp") != F.col("comp2")) & (F.least("n", "n2") < F.col("leader_n")) & enough)
        .select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))
    )


def _mixed(rows: DataFrame) -> DataFrame:
    """Lists (x) whose classes lie in several components: main, the largest, and few, whether an entry has at most STAR pairs across."""
    parts = rows.groupBy("x", "comp").agg(F.count("*").alias("m"))
    return (
        parts.groupBy("x")
        .agg(F.count("*").alias("parts"), F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("squares"), F.max(F.struct("m", "comp")).alias("top"))
        .where("parts > 1")
        .select("x", F.col("top.comp").alias("main"), (F.col("all") * F.col("all") - F.col("squares") <= 2 * STAR * F.col("all")).alias("few"))
    )


def _all_across(mixed: DataFrame, t: int) -> DataFrame:
    """All pairs of mixed lists that lie in different components, exact at any length.

    One of the two is outside the list's main component, so the join visits
    at most twice the pairs across.
    """
    other = mixed.where("comp <> main").select("x", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("comp").alias("comp2"))
    return mixed.join(other, "x").where("comp <> comp2").where(_similar_size("n", "n2", t)).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))


def links(docs: DataFrame, classes: DataFrame, copies: DataFrame, k: int, t: int, levels: Broadcast, boundary: int) -> DataFrame:
    """(v, c): components of the classes that link with any other class.

    ``classes`` has id, info, keys and outline, one row a class; ``copies``
    has the rows (doc_id, fp) of ``docs`` that are none. An open list
    with at most ``STAR`` pairs an entry across its components is closed by
    comparing these; the others go round again.
    """
    outlines = classes.select("id", _size().alias("n"), "outline")
    postings = classes.select("id", "info", F.explode("keys").alias("x"))
    tested = labels = None
    for r in range(ROUNDS + 1):
        listed = _listed(postings, None if r else classes)
        if not r:
            listed = _reordered(docs, classes, copies, listed, outlines, k, t, levels, boundary)
        placed = _with_components(listed, labels)
        if labels is not None:
            placed = materialise(placed, "jaccard-placed")
            drop_scratch(listed)
        long = placed.where(F.col("m") > STAR)
        star = long.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).withColumn("star", F.lit(True))
        pairs = _short_pairs(placed, t).withColumn("star", F.lit(False)).unionByName(star)
        pairs = pairs.groupBy("a", "b").agg(F.max("star").alias("star"))
        tested, labels = _test(docs, pairs, outlines, tested, labels, k, t, levels)
        # Long lists whose classes still lie in more than one component.
        again = _with_components(long.drop("comp"), labels)
        mixed = materialise(_mixed(again), "jaccard-mixed")
        now, later = mixed.agg(F.count_if("few"), F.count_if(~F.col("few"))).first()
        if not now + later:
            break
        rows = materialise(again.join(mixed, "x"), "jaccard-open")
        drop_scratch(mixed)
        release(docs.sparkSession)
        if r == ROUNDS:
            now, later, closing = now + later, 0, rows
        else:
            closing, rows = rows.where("few"), rows.where("not few")
        more = [_all_across(closing, t)] if now else []
        if later:
            more.append(_numbers_suffice(rows, tested, t))
        more = reduce(DataFrame.unionByName, more).distinct().withColumn("star", F.lit(False))
        tested, labels = _test(docs, more, outlines, tested, labels, k, t, levels)
        if not later:
            break
        # The same lists without their leaders' elements.
        rest = tested.select(F.col("a").alias("leader"), F.col("b").alias("id"), "rest")
        postings = materialise(
            rows.select("leader", "id", "info").distinct().join(rest, ["leader", "id"]).select("id", "info", "leader", F.explode("rest").alias("e")).select("id", "info", F.xxhash64("leader", "e").alias("x")),
            "jaccard-rest",
        )
    return labels


def _test(docs, pairs, outlines, tested, labels, k, t, levels) -> tuple[DataFrame, DataFrame]:
    """Compare the pairs that were not compared before, or not as star pairs; all results, and the components."""
    if tested is not None:
        before = tested.select("a", "b", (F.size("rest") > 0).alias("had_rest"))
        pairs = pairs.join(before, ["a", "b"], "left").where(F.col("had_rest").isNull() | (F.col("star") & ~F.col("had_rest"))).select("a", "b", "star")
    pairs = materialise(_plausible(materialise(pairs, "jaccard-listed-pairs"), outlines, t), "jaccard-pairs")
    if tested is not None and pairs.isEmpty():
        return tested, labels
    texts = _candidate_texts(docs, pairs)
    got = materialise(compare(pairs, texts, k, t, levels), "jaccard-tested")
    drop_scratch(pairs, texts)
    release(docs.sparkSession)
    linked = not got.where("linked").isEmpty()
    tested = got if tested is None else materialise(tested.unionByName(got).groupBy("a", "b").agg(F.max("both").alias("both"), F.max("linked").alias("linked"), F.max("rest").alias("rest")), "jaccard-tested")
    if linked or labels is None:
        labels = connected_components(tested.where("linked"), "jaccard-cc")
    return tested, labels


def _candidate_texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    ids = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "jaccard-ids")
    return materialise(_texts_of(docs, ids), "jaccard-texts")


# --- the operator ---------------------------------------------------------


def jaccard_components(docs: DataFrame, k: int = 4, t: int = 85, boundary: int | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Texts are linked when their sets of distinct k-word shingles have
    ``100 * intersection >= t * union``; component_id is the smallest doc_id
    reachable. A text of fewer than k words is one shingle. Null and empty
    texts have size 0 and link with nothing. Rows with a null doc_id keep a
    null component and link with nothing. Repeated rows of one id and equal
    texts are copies of one class. An id that comes with several texts is one
    document: its rows share a component, all its texts are candidates, and
    its largest text is compared. Other columns are ignored.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    levels = spark.sparkContext.broadcast(_sketch(src, k))
    if boundary is None:
        boundary = choose_boundary(src, k, t, levels)
    rows = materialise(shingle_rows(src, k, t, levels, boundary), "jaccard-rows")
    named = rows.where("doc_id is not null and fp is not null")
    # One row a class: the smallest id stands for it. Rows of a class agree in all but the id.
    owner = materialise(named.groupBy("fp").agg(F.min("doc_id").alias("id")), "jaccard-owners")
    # All rows but the copies. The list of copies is broadcast while it is known to be short.
    copies = materialise(named.select("doc_id", "fp").join(owner, "fp").where("doc_id <> id").select("doc_id", "fp"), "jaccard-copies")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_COPIES else copies
    classes = named.join(copies, ["doc_id", "fp"], "left_anti").select(F.col("doc_id").alias("id"), "info", "keys", "outline")
    found = links(src, classes, copies, k, t, levels, boundary)
    placed = owner.join(found, owner.id == found.v, "left").select("fp", F.coalesce("c", "id").alias("component"))
    return (
        rows.select("doc_id", "n_shingles", "fp")
        .join(placed, "fp", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    )


def keep_one(docs: DataFrame, k: int = 5, t: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near copies, columns unchanged.

    The document with the smallest doc_id of each component stays, one row of
    it; rows without id or without words are in no group and all stay.
    """
    found = materialise(jaccard_components(docs, k, t), "jaccard-found")
    losers = materialise(found.where("doc_id <> component_id").select("doc_id").distinct(), "jaccard-losers")
    few = losers.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(losers) if few else losers, "doc_id", "left_anti").select(*docs.columns)
    again = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_shingles").alias("size")).where("n > 1 and size > 0").select("doc_id")
    again = materialise(again, "jaccard-again")
    n = again.count()
    if not n:
        return kept
    again = F.broadcast(again) if n <= BROADCAST_IDS else again
    first = Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*[F.col(c) for c in docs.columns]))
    row = fresh(docs.columns, "row")
    one = kept.join(again, "doc_id", "left_semi").withColumn(row, F.row_number().over(first)).where(F.col(row) == 1).select(*docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one)
