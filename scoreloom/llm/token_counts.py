"""Token counts of whole texts, huge ones by overlapping chunks that are spliced.

Short texts are encoded whole. A huge text is cut into chunks that overlap;
each chunk is encoded on its own with offsets, and neighbours are spliced at
a boundary that both have. A boundary is *proven stable* when

* it starts a pre-token in both chunks, so the text after it is scanned
  afresh and no merge crosses it;
* it is at least ``margin`` characters from the chunk ends, so neither a look
  ahead nor a special string cut by the end can have moved it.

Where a pair of neighbours shares no such boundary (a run without any break,
say), the document goes round again with twice the overlap, and is encoded
whole once the overlap covers it. Chunks are rows of their own, so the chunks
of one document are encoded by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import materialise, slices

HUGE_CHARS = 60_000
CHUNK_CHARS = 30_000
OVERLAP_CHARS = 400
MARGIN_CHARS = 64
#: Chunks that a task sends on at once.
CUT_ROWS = 64
TOKEN_LIMIT = 512
#: Words whose tokens a worker keeps; a full cache starts afresh.
CACHE_WORDS = 100_000

_loaded: dict[str, tuple] = {}


def _tokenizer(path: str):
    """The tokenizer of a file and its cache of words; one of each a worker."""
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _loaded[path] = (tok, {})
    return _loaded[path]


def _spaced(word: str) -> bool:
    """Whether white space touches either end (or nothing is there), so that a break beside it isn't sure."""
    return not word or word[0].isspace() or word[-1].isspace()


def whole_counts(texts: list[str], path: str) -> list[int]:
    """Tokens of each text by the library.

    A single blank between two other characters always starts a pre-token of
    byte-level BPE, so a text is the sum of its blank-led words and each
    distinct word is encoded once. Texts with a doubtful blank go whole.
    """
    tok, cache = _tokenizer(path)
    if len(cache) > CACHE_WORDS:
        cache.clear()
    split = [t.split(" ") for t in texts]
    odd = {i for i, words in enumerate(split) if any(map(_spaced, words))}
    new = list({w for i, words in enumerate(split) if i not in odd for w in words[1:] if w not in cache})
    cache.update(zip(new, map(len, tok.encode_batch_fast([" " + w for w in new], add_special_tokens=False))))
    alone = [texts[i] if i in odd else split[i][0] for i in range(len(texts))]
    first = map(len, tok.encode_batch_fast(alone, add_special_tokens=False))
    return [n if i in odd else n + sum(map(cache.__getitem__, split[i][1:])) for i, n in enumerate(first)]


def starts(text: str, path: str) -> tuple[list[int], list[int], int]:
    """Character offsets at which pre-tokens start, the number of tokens before each, and the number of all."""
    tok, _ = _tokenizer(path)
    e = tok.encode(text, add_special_tokens=False)
    at, before, last = [], [], object()
    spans = e.offsets
    for i, w in enumerate(e.word_ids):
        # Added (special) tokens have no word of their own; each starts afresh.
        if w is None or w != last:
            at.append(spans[i][0])
            before.append(i)
        last = w if w is not None else object()
    return at, before, len(spans)


def chunk_rows(text: str, first: int, last: bool, core: int, overlap: int, margin: int, path: str) -> tuple:
    """What one encoded chunk tells its neighbours.

    The result holds the boundaries within the overlap at its head and at its
    tail as absolute offsets, with the number of tokens before each.
    """
    at, before, n = starts(text, path)
    head = [(first + p, b) for p, b in zip(at, before) if first and margin <= p <= overlap - margin]
    end = len(text)
    tail = [(first + p, b) for p, b in zip(at, before) if not last and end - overlap + margin <= p <= end - margin]
    return [h[0] for h in head], [h[1] for h in head], [t[0] for t in tail], [t[1] for t in tail], n


def splice(chunks: list[dict]) -> int | None:
    """Tokens of a text from its chunks in order; None if a pair of neighbours shares no boundary."""
    total, start = 0, 0
    for left, right in zip(chunks, chunks[1:]):
        mine = dict(zip(left["tail_at"], left["tail_before"]))
        theirs = dict(zip(right["head_at"], right["head_before"]))
        shared = [q for q in mine if q in theirs and mine[q] >= start]
        if not shared:
            return None
        q = max(shared)
        total += mine[q] - start
        start = theirs[q]
    return total + chunks[-1]["n"] - start


def cuts(chars: int, chunk: int, overlap: int) -> list[tuple[int, int, bool]]:
    """(first, end, whether it is the last) of the chunks of a text; a chunk within the overlap of the one before is none."""
    firsts = [f for f in range(0, chars, chunk) if f == 0 or f + overlap < chars]
    return [(f, min(f + chunk + overlap, chars), f + chunk + overlap >= chars) for f in firsts]


def _pieces(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(doc_key, no, first, last, piece, chars): the overlapping chunks of each text, cut in one walk over it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_key", "no", "first", "last", "piece", "chars"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int32()]
        for b in slices(batches, 1):
            key, text = b["doc_key"][0].as_py(), b["text"][0].as_py()
            rows = [(key, no, *c) for no, c in enumerate(cuts(len(text), chunk, overlap))]
            for at in range(0, len(rows), CUT_ROWS):
                some = [(k, no, first, last, text[first:end], len(text)) for k, no, first, end, last in rows[at : at + CUT_ROWS]]
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*some), kinds)], names)

    return docs.select("doc_key", "text").mapInArrow(cut, "doc_key string, no int, first int, last boolean, piece string, chars int")


def _chunk_counts(docs: DataFrame, path: str, chunk: int, overlap: int, margin: int) -> DataFrame:
    """(doc_key, n_tokens, n_chunks, chars) of huge texts; n_tokens is null where a splice failed."""
    # By a number, which adaptive execution leaves alone: a chunk is little data and much work.
    cut = _pieces(docs, chunk, overlap).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_key", "no")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [
                chunk_rows(p, f, last, chunk, overlap, margin, path)
                for p, f, last in zip(b["piece"].to_pylist(), b["first"].to_pylist(), b["last"].to_pylist())
            ]
            cols = [pa.array([o[i] for o in out], pa.list_(pa.int32())) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [b["doc_key"], b["no"], *cols, pa.array([o[4] for o in out], pa.int32()), b["chars"]],
                ["doc_key", "no", "head_at", "head_before", "tail_at", "tail_before", "n", "chars"],
            )

    told = cut.mapInArrow(
        encode,
        "doc_key string, no int, head_at array<int>, head_before array<int>, tail_at array<int>, tail_before array<int>, n int, chars int",
    )

    def join_up(rows):
        rows = rows.sort_values("no")
        n = splice(rows.to_dict("records"))
        return rows.head(1)[["doc_key", "chars"]].assign(n_tokens=n, n_chunks=len(rows)).astype({"n_tokens": "Int64"})

    return told.groupBy("doc_key").applyInPandas(join_up, "doc_key string, chars int, n_tokens long, n_chunks int")


def token_counts(
    docs: DataFrame,
    path: str,
    limit: int = TOKEN_LIMIT,
    huge: int = HUGE_CHARS,
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
    margin: int = MARGIN_CHARS,
) -> DataFrame:
    """Bytes and tokens of every text of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, n_bytes, n_tokens, over_limit and n_chunks, one row for
    each input row. A null text counts as empty: no bytes, no tokens. Repeated
    rows and repeated or null ids each keep their row. The tokenizer file must
    be readable under the same path on every executor.
    """
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    short = src.where(F.length("text") <= huge)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n = whole_counts(part["text"].to_pylist(), path)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["n_bytes"], pa.array(n, pa.int64()), pa.array([1] * len(n), pa.int32())],
                ["doc_id", "n_bytes", "n_tokens", "n_chunks"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = short.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInArrow(
        encode, f"doc_id {kind}, n_bytes long, n_tokens long, n_chunks int"
    )
    # Equal texts have equal counts, so a huge text is known by its digest and encoded once.
    huge_docs = src.where(F.length("text") > huge).withColumn("doc_key", F.sha2("text", 256))
    pending = huge_docs.groupBy("doc_key").agg(F.first("text").alias("text"))
    done = []
    while True:
        got = materialise(_chunk_counts(pending, path, chunk, overlap, margin), "token-chunks")
        done.append(got.where("n_tokens is not null").drop("chars"))
        failed = got.where("n_tokens is null")
        longest = failed.agg(F.max("chars")).first()[0]
        if longest is None:
            break
        overlap *= 2
        chunk = longest + 1 if overlap >= longest else max(chunk, overlap)
        pending = huge_docs.join(failed.select("doc_key"), "doc_key", "left_semi").groupBy("doc_key").agg(F.first("text").alias("text"))
    known = done[0]
    for d in done[1:]:
        known = known.unionByName(d)
    spliced = huge_docs.select("doc_id", "doc_key", F.octet_length("text").cast("long").alias("n_bytes")).join(known, "doc_key").select(
        "doc_id", "n_bytes", "n_tokens", "n_chunks"
    )
    return counted.unionByName(spliced).withColumn("over_limit", F.col("n_tokens") > limit)
