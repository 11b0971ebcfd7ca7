import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import infill, queries, rope

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
ALPHABET = "ab  cé世\n<PSM>İKſ9"


def random_text(rng):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 2, 5, 30, 300])))


def height(r):
    if isinstance(r, rope.Leaf):
        return 0
    a, b = height(r.left), height(r.right)
    assert abs(a - b) <= 1 and r.height == 1 + max(a, b)
    assert (r.units, r.chars) == (r.left.units + r.right.units, r.left.chars + r.right.chars)
    return r.height


@pytest.mark.parametrize("width", [1, 3, 2048])
def test_rope_against_lists(width):
    rng = random.Random(width)
    for _ in range(400):
        text = random_text(rng)
        units = UNIT.findall(text)
        r = rope.build(text, width)
        assert (r.units, r.chars, rope.text_of(r)) == (len(units), len(text), text)
        cut = rng.randint(0, len(units))
        a, b = rope.split(r, cut)
        assert (rope.text_of(a), rope.text_of(b), a.units) == ("".join(units[:cut]), "".join(units[cut:]), cut)
        joined = rope.concat(b, rope.concat(rope.leaf("<P>"), a))
        assert rope.text_of(joined) == "".join(units[cut:]) + "<P>" + "".join(units[:cut])
        for x in (r, a, b, joined):
            height(x)
        assert rope.find(r, "<P>") == text.find("<P>")
        assert rope.sha256(r) == hashlib.sha256(text.encode()).hexdigest()
        ends = [m.start() for m in UNIT.finditer(text)]
        for i, at in enumerate(ends):
            assert rope.unit_of(r, at) == i


def test_splits_share_what_they_dont_cut():
    r = rope.build("some words " * 20_000)
    known = {id(x) for x in rope.leaves(r)}
    a, b = rope.split(r, 12_345)
    assert sum(id(x) not in known for part in (a, b) for x in rope.leaves(part)) == 2


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_operator_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, random_text(rng), i) for i in range(400)]
    rows += [(7, "two rows of one id", 0), (7, "two rows of one id", 0), (None, "no id", 0), (None, None, 0), (1000, None, 0), (1001, "", 0), (1002, "x" * 200_000 + " end", 0), (1003, "é 世 " * 40_000, 0), (1004, "a <M> b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output long").repartition(5)
    out = infill.fill_in_middle(docs)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted(map(tuple, infill.restore(out).collect()), key=repr)
    want = sorted(((i, *brute(i, t), t or "") for i, t, _ in rows), key=repr)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_empty_and_broken(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert infill.restore(infill.fill_in_middle(empty)).collect() == []
    broken = spark.createDataFrame([("a<P>b<S>c<M>d", "psm"), ("<P>a<M>b<S>c", "psm"), (None, "spm"), ("<S>x<P>y", "spm"), ("<P>z", None)], "output string, form string")
    assert [r.restored for r in infill.restore(broken).collect()] == ["a<P>b<S>c<M>d", "<P>a<M>b<S>c", "", "<S>x<P>y", "<P>z"]


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    df = queries.op13_fill_in_middle(spark, sf)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = duck.execute(queries.ORACLES["op13_fill_in_middle"])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(rel.fetchall())
    assert df.where(F.col("restored_sha256") != F.col("output_sha256")).count() > 100
