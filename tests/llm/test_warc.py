import hashlib
import struct

import pytest
import zstandard

from scoreloom.llm import warc
from scoreloom.llm.common import scratch

SCHEMA = "page_id long, url string, html string, payload string"


def test_round_trip(spark):
    long = "<p>héllo</p>" * 40
    rows = [(5, "http://a/1", long, "x"), (3, "http://a/ü\n2", long, "x"), (9, None, long, "x"), (1, "u", "short", "x"), (2, "u", "short", "x"), (4, "u", None, "x"), (6, "u", "", "x"), (None, "u", long, "x"), (7, "u", "z" * 300_000, None)]
    path = scratch(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), path)
    got = warc.read_archives(spark, path).collect()
    assert all(r.problem is None for r in got)
    by = {r.page_id: r for r in got}
    assert len(got) == len(by) == len(rows)
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        assert by[i].payload_bytes == len(raw)
        assert by[i].payload_digest == hashlib.sha256(raw).hexdigest()
        assert by[i].payload == (None if by[i].record_type == "revisit" else raw)
    assert {i: r.refers_to for i, r in by.items() if r.record_type == "revisit"} == {5: 3, 9: 3}


def test_files_are_plain_zstandard(spark):
    path = scratch(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([(i, "u", f"<html>page {i} " + "text " * i) for i in range(300)], "page_id long, url string, html string").coalesce(1), path)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect() if r.length]
    data = files[0]
    magic, size = struct.unpack_from("<II", data)
    assert magic == warc.DICTIONARY_MAGIC
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    at, n = warc.frame_end(memoryview(data), 8 + size + 9), 0
    assert decoder.decompressobj().decompress(data[8 + size + 9 : at]).startswith(b"WARC/1.1\r\n")
    n = sum(1 for _ in warc.frames(data))
    assert n == 300


def test_broken_records_and_archives_are_told():
    good = warc.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    assert warc.parse(good)["payload"] == b"abc"
    for bad in (good[:-1], good.replace(b"abc", b"abd"), good.replace(b"WARC-Date", b"WARC-Dat"), b"nothing", good.replace(b"WARC/1.1", b"HTTP/1.1")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    frame = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(good)
    assert [c for _, c in warc.frames(frame + frame)] == [good, good]
    with pytest.raises(ValueError):
        list(warc.frames(frame[:-6]))
    with pytest.raises(ValueError):
        list(warc.frames(frame + b"garbage!"))


def test_an_empty_table(spark):
    path = scratch(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_archives(spark, path).count() == 0


def test_a_dictionary_whatever_the_first_page(spark):
    rows = [(i, f"<html><body>page {i} of many with words {i * 7}</body></html>" * 8) for i in range(200)]
    sizes = []
    for big in (0, 5_000_000):
        df = spark.createDataFrame([(i, h + "x" * (big if i % 3 == 0 and i < 9 else 0)) for i, h in rows] + [(5, "again")] * 60, "page_id long, html string")
        sizes.append(len(warc._dictionary(df)))
    assert min(sizes) > 1_000
