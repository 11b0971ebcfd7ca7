import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from scoreloom.llm import fingerprints as fp
from scoreloom.llm import queries

SCHEMA = "doc_id long, text string, sketch int"


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def sketch(text, k=5, fraction=fp.FRACTION):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    if not words:
        return []
    hashes = set()
    for i in range(max(1, len(words) - k + 1)):
        h = 42
        for w in words[i : i + k]:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        hashes.add(signed(h))
    return sorted(h for h in hashes if h < int(fraction * 2**64) - 2**63) or [min(hashes)]


def alike(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def held(a, b):
    return len(set(a) & set(b)) / len(a) if a else 1.0


def text_hash(text):
    return signed(xxhash.xxh64_intdigest(text.encode(), seed=42))


def brute(rows):
    """Every returned row, by plain Python; of several rows of one id the text with the smallest hash is a next text."""
    rows = [(i, t or "") for i, t in rows]
    ids = sorted({i for i, _ in rows if i is not None})
    chosen = {i: min((t for j, t in rows if j == i), key=text_hash) for i in ids}
    out = []
    for i, t in rows:
        nxt = chosen[ids[(ids.index(i) + 1) % len(ids)]] if i is not None else ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = sketch(t), sketch(edited), sketch(nxt)
        name = lambda s: "".join(f"{h % 2**64:016x}" for h in s)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), name(a), name(b), alike(a, b), alike(a, c), held(a, b), held(a, c)))
    return out


def compare(df, rows):
    got = sorted(map(tuple, df.collect()), key=repr)
    want = sorted(brute(rows), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:])


def random_text(rng):
    return rng.choice(["", " ", "\n"]).join(rng.choice("ab cé世 dog Cat x\t").lower() for _ in range(rng.choice([0, 1, 3, 9, 60]))) + " ".join(rng.choice(["one", "two", "Three", "né", "世界", "\x0b"]) for _ in range(rng.choice([0, 1, 4, 5, 80])))


@pytest.mark.parametrize("partitions", [1, 9])
def test_against_brute_force(spark, partitions):
    rng = random.Random(partitions)
    rows = [(i * i, random_text(rng)) for i in range(150)] + [(-5, None), (10**12, ""), (10**12 + 1, "same words " * 40), (10**12 + 2, "same words " * 40), (10**12 + 3, "w é " * 30_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(partitions)
    compare(fp.fingerprints(df), rows)


def test_repeated_and_null_ids(spark):
    rows = [(3, "a b c d e f g")] * 40 + [(3, "other text of the same id here"), (4, "four " * 9), (1, "x y z " * 8), (None, "no id at all in this one"), (None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3)
    compare(fp.fingerprints(df), rows)


@pytest.mark.parametrize("rows", [[], [(7, "only one text here, it follows itself")], [(None, "none has an id")], [(7, None)]])
def test_small_tables(spark, rows):
    compare(fp.fingerprints(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)), rows)


def test_ids_of_text(spark):
    df = spark.createDataFrame([("b", "second text"), ("a", "first text"), ("c", "third text")], "doc_id string, text string")
    got = {r.doc_id: r.edited_sha256 for r in fp.fingerprints(df).collect()}
    assert got["c"] == hashlib.sha256(b"third" + b"first").hexdigest()
    assert got["a"] == hashlib.sha256(b"first" + b"secon").hexdigest()


def test_merged_sketch_is_the_sketch_of_the_union(spark):
    rng = random.Random(8)
    rows = [(i, i % 3, " ".join(rng.choice(["a", "b", "c", "d", "e"]) for _ in range(rng.choice([0, 3, 20])))) for i in range(60)] + [(98, 7, "a b"), (99, 7, "c"), (100, 8, "")]
    df = fp.with_sketch(spark.createDataFrame(rows, "doc_id long, team int, text string"))
    got = {}
    for r in fp.merged(df, ["team"]).collect():
        got.setdefault(r.team, []).append(r.hash)
    for team in {r[1] for r in rows}:
        every = {h for _, g, t in rows if g == team for h in sketch(t, fraction=1)}
        low = sorted(h for h in every if h < int(fp.FRACTION * 2**64) - 2**63)
        assert sorted(got.get(team, [])) == (low or sorted(every)[:1])


def test_containment_between_unequal_documents(spark):
    rng = random.Random(2)
    book = [f"w{rng.randrange(50_000)}" for _ in range(40_000)]
    chapter = book[1_000:3_000]
    mixed = chapter[:1_000] + [f"v{i}" for i in range(1_000)]
    df = spark.createDataFrame([(" ".join(book), " ".join(chapter), " ".join(mixed))], "a string, b string, c string")
    for c in "abc":
        df = fp.with_sketch(df, c, f"s{c}")
    inside, outside, part = df.select(fp.containment("sb", "sa"), fp.containment("sa", "sb"), fp.containment("sc", "sa")).first()
    assert inside == 1.0 and outside == pytest.approx(0.05, abs=0.01) and part == pytest.approx(0.5, abs=0.05)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = queries.op12_fingerprints(spark, sf)
    compare(out, rows)
    near = out.agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert near[0] > 0.25 > 0.05 > near[1]
