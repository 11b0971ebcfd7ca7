"""Fill-in-middle transformation of whole texts, on ropes.

A text of n units (runs of ASCII letters, or any other single code point) is
split at two unit ranks into prefix, middle and suffix, and put together anew
around sentinels: ``psm`` gives prefix, suffix, middle, ``spm`` suffix,
prefix, middle. Ranks and form come from a hash of the document's id, so they
are the same in every run. Moving the parts splits and joins subtrees of a
rope; its inverse finds the sentinels in the output, splits there and joins
the parts in their old order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from scoreloom.llm import rope
from scoreloom.llm.common import slices

#: Sentinels of the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, so many are transformed, and of 100 transformed texts so many have the suffix first.
TRANSFORMED = 90
SUFFIX_FIRST = 20
SEED = 1
#: Order of the sentinels in an output.
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}

_marks = {m: rope.leaf(m) for m in (PREFIX, SUFFIX, MIDDLE)}


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document: the first 8-digit groups of the hex SHA-256 of ``seed:doc_id`` (nothing after the colon for no id)."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in range(0, 32, 8))


def transform(text: str | None, doc_id: int | None, seed: int = SEED) -> tuple[rope.Rope, str, int, int | None, int | None]:
    """Output rope, form, units of the text, code points of prefix and middle (None where plain)."""
    r = rope.build(text or "")
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= TRANSFORMED or any(m in text for m in _marks):
        return r, "plain", r.units, None, None
    a, b = sorted((h1 % (r.units + 1), h2 % (r.units + 1)))
    head, suffix = rope.split(r, b)
    prefix, middle = rope.split(head, a)
    form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
    parts = {PREFIX: prefix, SUFFIX: suffix, MIDDLE: middle}
    out = rope.EMPTY
    for m in ORDER[form]:
        out = rope.concat(rope.concat(out, _marks[m]), parts[m])
    return out, form, r.units, prefix.chars, middle.chars


def invert(output: str | None, form: str | None) -> rope.Rope:
    """The text that an output of a form was made from.

    No sentinel can arise at a seam, since none ends as another begins, so
    the first of each is the one that was put in. An output that lacks a
    sentinel of its form, or has them in another order, is given back as it is.
    """
    whole = rope.build(output or "")
    if form not in ORDER:
        return whole
    places = [rope.find(whole, m) for m in ORDER[form]]
    if places[0] != 0 or sorted(places) != places or len(set(places)) < 3:
        return whole
    parts, rest = {}, whole
    for m, at in list(zip(ORDER[form], places))[::-1]:
        rest, tail = rope.split(rest, rope.unit_of(rest, at))
        parts[m] = rope.split(tail, _marks[m].units)[1]
    return rope.concat(rope.concat(parts[PREFIX], parts[MIDDLE]), parts[SUFFIX])


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every whole text of ``docs`` (doc_id, text).

    Other columns are ignored. A null text counts as empty; empty texts and
    texts that hold a sentinel stay as they are (form ``plain``, null
    lengths). Repeated rows each keep their row, and equal ids draw alike; so
    do all rows without id. A text is one row: a task holds it, and its
    rope, while it is at it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids = b["doc_id"].to_pylist()
            got = [transform(t, i, seed) for t, i in zip(b["text"].to_pylist(), ids)]
            yield pa.RecordBatch.from_arrays(
                [
                    b["doc_id"],
                    pa.array([g[2] for g in got], pa.int64()),
                    pa.array([g[1] for g in got], pa.string()),
                    pa.array([g[3] for g in got], pa.int64()),
                    pa.array([g[4] for g in got], pa.int64()),
                    pa.array([rope.text_of(g[0]) for g in got], pa.string()),
                ],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(outputs: DataFrame) -> DataFrame:
    """``outputs`` (output, form and whatever else) with the texts they came from as ``restored`` in place of a column of that name.

    It looks at output and form only. A null output gives an empty text.
    """
    kept = outputs.drop("restored")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [rope.text_of(invert(o, f)) for o, f in zip(b["output"].to_pylist(), b["form"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "restored"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("restored", StringType())]))
