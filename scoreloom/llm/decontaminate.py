"""Benchmark items inside documents, by SimHash of item-sized windows.

For every item length, windows of so many words slide over a document; one
that is shorter than an item is compared with it as a whole. A window's fingerprint is the 64-bit SimHash of its weighted word shingles. The
items' fingerprints are indexed by multi-index Hamming blocks: with six blocks
of 10 or 11 bits and radius 23, two fingerprints within the radius differ by
at most three bits in some block, so listing every item under all values
within three bits of each block finds every item within the radius. What is
found is compared exactly, by weighted Jaccard similarity of shingle counts.

A shingle enters a fingerprint by the root of its weight: of distinct
shingles, two sets of weighted similarity 0.8 then have a cosine of 8/9 or
more whatever their weights, so some 10 bits differ, with a deviation near 3.
The README gives the measured recall; a shingle that a text repeats many
times can put fingerprints further apart.

A window that shares no shingle with an item of its length has similarity 0,
so only windows over such a shingle get a fingerprint; that skips no match.
Weights are whole numbers that grow with a shingle's rarity among the items.

Documents are only scanned: the index of a block of items is broadcast, its
size is bounded by the block, and larger benchmarks take several scans.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import slices
from scoreloom.llm.words import shingle_hashes, word_hashes, words

SHINGLE = 5
LEAST = 0.8
BLOCKS, RADIUS = 6, 23
#: First bit of each block, and the end.
EDGES = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
#: Items whose index is broadcast at once: some 1,300 keys of 16 bytes each, 21 MB a thousand.
ITEMS_PER_BLOCK = 1_000
#: Words of a document that are fingerprinted at once.
SEGMENT = 20_000
#: Pairs of a window and an item of its length that are looked up at once.
PAIRS = 1 << 20
_ONE = np.uint64(1)


def _masks(bits: int, radius: int) -> np.ndarray:
    """All values of so many bits with at most ``radius`` bits set."""
    out = [0]
    for r in range(1, radius + 1):
        out += [sum(1 << i for i in c) for c in combinations(range(bits), r)]
    return np.array(out, np.uint64)


def signed(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A row of 64 whole numbers a shingle: its weight, signed by its hash bits."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return (bits.astype(np.int32) * 2 - 1) * weight[:, None].astype(np.int32)


def pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").reshape(-1, 8).view("<u8").reshape(-1).astype(np.uint64)


def block_values(f: np.ndarray) -> np.ndarray:
    """(n, BLOCKS) values of the fingerprint blocks, tagged by block."""
    widths = np.diff(EDGES)
    return np.stack([(f >> np.uint64(EDGES[i])) & np.uint64((1 << int(widths[i])) - 1) | np.uint64(i << 32) for i in range(BLOCKS)], axis=1)


def turn(weight: np.ndarray) -> np.ndarray:
    """What a shingle of this weight counts in a fingerprint."""
    return np.round(64 * np.sqrt(weight)).astype(np.int32)


class Index:
    """Items of one block, ready for lookups; items without words are in no window."""

    def __init__(self, items: list[tuple[int, str]], weights: dict[int, int], rare: int, k: int = SHINGLE):
        self.k, self.rare = k, rare
        self.ids, self.counts, self.lengths = [], [], []
        prints, keyed = [], {}
        for item_id, text in items:
            ws = words(text)
            if not ws:
                continue
            n, size = len(self.ids), len(ws)
            h = shingle_hashes(word_hashes(ws), k)
            self.ids.append(item_id)
            self.lengths.append(size)
            self.counts.append(Counter(h.tolist()))
            prints.append(signed(h, turn(np.array([weights[x] for x in h.tolist()]))).sum(axis=0))
            for x in set(h.tolist()):
                keyed.setdefault((min(k, size), x), set()).add(size)
        self.totals = [sum(weights[x] * n for x, n in c.items()) for c in self.counts]
        self.of_length: dict[int, list[int]] = {}
        for i, size in enumerate(self.lengths):
            self.of_length.setdefault(size, []).append(i)
        self.prints = pack(np.array(prints)) if prints else np.zeros(0, np.uint64)
        self.weights = weights
        # By shingle length: sorted shingles with their weight and the lengths of the items that have them.
        self.shingles = {}
        for run in {r for r, _ in keyed}:
            hs = np.array(sorted(x for r, x in keyed if r == run), np.uint64)
            lens = [sorted(keyed[run, x]) for x in hs.tolist()]
            quick = np.zeros(1 << 20, bool)
            quick[hs & np.uint64((1 << 20) - 1)] = True
            self.shingles[run] = (hs, np.array([weights[x] for x in hs.tolist()]), lens, quick)
        # By item length: sorted block keys and the item of each.
        masks = [_masks(int(n), RADIUS // BLOCKS) for n in np.diff(EDGES)]
        self.blocks = {}
        for size, held in self.of_length.items():
            values = block_values(self.prints[held])
            keys = np.concatenate([(values[:, i, None] ^ m).reshape(-1) for i, m in enumerate(masks)])
            order = np.argsort(keys, kind="stable")
            self.blocks[size] = (keys[order], np.concatenate([np.repeat(held, len(m)) for m in masks])[order])

    def near(self, size: int, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of one length within the radius."""
        keys, items = self.blocks[size]
        windows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, PAIRS // len(self.of_length[size]))
        for i in range(0, len(f), step):
            asked = block_values(f[i : i + step]).reshape(-1)
            lo, hi = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
            n = hi - lo
            window = i + np.repeat(np.arange(len(asked)) // BLOCKS, n)
            item = items[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            close = np.bitwise_count(f[window] ^ self.prints[item]) <= RADIUS
            pair = np.unique(window[close] * len(self.ids) + item[close])
            windows.append(pair // len(self.ids))
            found.append(pair % len(self.ids))
        return np.concatenate(windows), np.concatenate(found)

    def similarity(self, window: Counter, item: int) -> float:
        """Weighted Jaccard similarity of shingle counts."""
        other, both, either = self.counts[item], 0, 0
        for x in window.keys() | other.keys():
            w = self.weights.get(x, self.rare)
            a, b = window.get(x, 0), other.get(x, 0)
            both += w * min(a, b)
            either += w * max(a, b)
        return both / either if either else 0.0

    def matches(self, text: str | None, least: float) -> list[tuple[int, float, int, int, int]]:
        """(item_id, best similarity, its first word, words, windows that match) of the items in a text."""
        h = word_hashes(words(text))
        best: dict[int, list] = {}
        for run, (hs, weight, lens, quick) in self.shingles.items():
            if len(h) < run:
                continue
            s = shingle_hashes(h, run)
            maybe = np.flatnonzero(quick[s & np.uint64((1 << 20) - 1)])
            at = np.searchsorted(hs, s[maybe])
            at[at == len(hs)] = 0
            real = hs[at] == s[maybe]
            hits, which = maybe[real], at[real]
            if not len(hits):
                continue
            by_size: dict[int, list[int]] = {}
            for p, w in zip(hits.tolist(), which.tolist()):
                for size in lens[w]:
                    by_size.setdefault(size, []).append(p)
            for size, where in by_size.items():
                if size <= len(h):
                    self._slide(s, hs, weight, run, size, np.array(where), least, best)
            self._whole(s, [size for size in by_size if size > len(h)], least, best)
        return [(self.ids[i], b[0], b[1], min(self.lengths[i], len(h)), b[2]) for i, b in sorted(best.items())]

    def _whole(self, s, sizes, least, best) -> None:
        """Compare a text with the longer items of these lengths, as one window."""
        if not sizes:
            return
        window = Counter(s.tolist())
        most = sum(self.weights.get(x, self.rare) * n for x, n in window.items())
        for size in sizes:
            for item in self.of_length[size]:
                # The shared part is at most the text's weight, the union at least the item's.
                if most >= least * self.totals[item]:
                    sim = self.similarity(window, item)
                    if sim >= least:
                        best[item] = [sim, 0, 1]

    def _slide(self, s, hs, weight, run, size, hits, least, best) -> None:
        m = size - run + 1
        # Window starts over a shared shingle, as runs of neighbours.
        last = len(s) - m
        cover = np.zeros(len(s) + 1, np.int32)
        np.add.at(cover, np.maximum(hits - m + 1, 0), 1)
        np.add.at(cover, np.minimum(hits, last) + 1, -1)
        starts = np.flatnonzero(np.cumsum(cover[: last + 1]) > 0)
        for i in range(0, len(starts), SEGMENT):
            part = starts[i : i + SEGMENT]
            for group in np.split(part, np.flatnonzero(np.diff(part) > m) + 1):
                lo, hi = group[0], group[-1] + m
                piece = s[lo:hi]
                at = np.searchsorted(hs, piece)
                at[at == len(hs)] = 0
                w = np.where(hs[at] == piece, weight[at], self.rare)
                run_sum = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(signed(piece, turn(w)), axis=0, dtype=np.int64)])
                f = pack(run_sum[group - lo + m] - run_sum[group - lo])
                for win, item in zip(*self.near(size, f)):
                    p = int(group[win])
                    sim = self.similarity(Counter(s[p : p + m].tolist()), int(item))
                    if sim >= least:
                        b = best.setdefault(int(item), [0.0, 0, 0])
                        b[2] += 1
                        if sim > b[0]:
                            b[0], b[1] = sim, p


def shingle_weights(items: list[tuple[int, str]], k: int = SHINGLE) -> tuple[dict[int, int], int]:
    """Whole-number weight of each item shingle, 16 * (1 + ln(items / items that have it)), and that of any other."""
    seen: Counter = Counter()
    for _, text in items:
        seen.update(set(shingle_hashes(word_hashes(words(text)), k).tolist()))
    n = max(1, len(items))
    return {x: round(16 * (1 + math.log(n / c))) for x, c in seen.items()}, round(16 * (1 + math.log(n)))


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, item_id, similarity, start_word, n_words and n_windows.

    One row for each pair of a row of ``docs`` (doc_id, text) and an item
    (item_id, text) with a window of similarity ``least`` or more; the best
    window is told, the first of equals; a text shorter than the item is one
    window. Null and empty texts hold nothing and
    are in nothing. Items with a null id are matched like others. Repeated
    document rows give repeated results; repeated items too. Items of fewer
    than k words are one shingle. Other columns are ignored.

    The benchmark is collected block by block; it must fit the driver once as
    text, the documents are never collected.
    """
    spark = docs.sparkSession
    items = [(r["item_id"], r["text"] or "") for r in benchmark.select("item_id", "text").collect()]
    items.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    weights, rare = shingle_weights(items, k)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, similarity double, start_word long, n_words int, n_windows int"
    out = None
    for i in range(0, max(1, len(items)), ITEMS_PER_BLOCK):
        index = spark.sparkContext.broadcast(Index(items[i : i + ITEMS_PER_BLOCK], weights, rare, k))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                rows = [(d, *m) for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()) for m in index.value.matches(t, least)]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.int32())
                names = ["doc_id", "item_id", "similarity", "start_word", "n_words", "n_windows"]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names)

        found = src.mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, columns unchanged; rows are judged by their own text."""
    spark = docs.sparkSession
    items = [(r["item_id"], r["text"] or "") for r in benchmark.select("item_id", "text").collect()]
    items.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    weights, rare = shingle_weights(items, k)
    for i in range(0, max(1, len(items)), ITEMS_PER_BLOCK):
        index = spark.sparkContext.broadcast(Index(items[i : i + ITEMS_PER_BLOCK], weights, rare, k))

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                yield b.filter(pa.array([not index.value.matches(t, least) for t in b["text"].to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
