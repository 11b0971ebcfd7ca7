"""WARC archives in zstandard: one frame a record, the dictionary in a leading skippable frame.

Archives are written by Spark's own text writer, so any store that Spark can
write will do: a record is a row, and the line end after each row is the one
byte of a skippable frame whose header closes the row. The files are valid
zstandard streams. Reading takes whole files, finds the frames by their
headers, decodes one frame a record and checks what the headers claim.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm.common import scratch

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_FIRST = 0x184D2A50
SKIPPABLE_LAST = 0x184D2A5F
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = "WARC/1.1"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")

DATE = "2024-01-01T00:00:00Z"
REVISIT_BYTES = 100
DICTIONARY_BYTES = 64 * 1024
#: Bounds of the dictionary's sample: pages, and bytes of all of them.
SAMPLE_PAGES = 1_000
SAMPLE_BYTES = 4_000_000
#: First copies up to which they are broadcast: at some 100 bytes each, 10 MB.
BROADCAST_FIRSTS = 100_000

_LINE_END = struct.pack("<II", SKIPPABLE_FIRST, 1)


# --- one record -----------------------------------------------------------


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A response record, or a revisit where ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        VERSION,
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {'urn:url:none' if url is None else quote(url, safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise ValueError(f"header without a colon: {line[:60]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def _page(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def parse(raw: bytes) -> dict:
    """The fields of one decoded record; raises ValueError where headers or lengths are wrong."""
    top, gap, rest = raw.partition(b"\r\n\r\n")
    lines = top.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/1."):
        raise ValueError("no WARC header")
    h = _headers(lines[1:])
    for name in NEEDED:
        if name not in h:
            raise ValueError(f"header {name} is missing")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4:
        raise ValueError(f"content length {h['content-length']}, block of {len(rest) - 4} bytes")
    block, end = rest[:-4], rest[-4:]
    if end != b"\r\n\r\n":
        raise ValueError("record doesn't end in two line ends")
    if h.get("warc-block-digest", "").startswith("sha256:") and hashlib.sha256(block).hexdigest() != h["warc-block-digest"][7:]:
        raise ValueError("block digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no HTTP header")
    n = _headers(http.split(b"\r\n")[1:]).get("content-length", "")
    kind = h["warc-type"]
    if not n.isdigit() or kind == "response" and int(n) != len(payload) or kind == "revisit" and payload:
        raise ValueError(f"payload of {len(payload)} bytes, HTTP content length {n!r}")
    digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("payload digest differs")
    if kind == "revisit" and "warc-refers-to" not in h:
        raise ValueError("revisit without warc-refers-to")
    return {
        "page_id": _page(h["warc-record-id"]),
        "url": h.get("warc-target-uri"),
        "record_type": kind,
        "payload": payload if kind == "response" else None,
        "payload_bytes": int(n),
        "payload_digest": digest,
        "refers_to": _page(h.get("warc-refers-to")),
    }


# --- frames ---------------------------------------------------------------


def frame_end(data: memoryview, at: int) -> int:
    """Where the zstandard frame that starts at ``at`` ends, from its header and block headers."""
    flags = data[at + 4]
    single, checksum, dict_id, size = flags >> 5 & 1, flags >> 2 & 1, flags & 3, flags >> 6
    at += 5 + (not single) + (0, 1, 2, 4)[dict_id] + ((1 if single else 0), 2, 4, 8)[size]
    while True:
        if at + 3 > len(data):
            raise ValueError("frame is cut off")
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    at += 4 * checksum
    if at > len(data):
        raise ValueError("frame is cut off")
    return at


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each record frame, decoded with the dictionary of the leading frame."""
    view, at = memoryview(data), 0
    decoder = zstandard.ZstdDecompressor()
    while at < len(view):
        if at + 8 > len(view):
            raise ValueError("frame is cut off")
        magic, size = struct.unpack_from("<II", view, at)
        if SKIPPABLE_FIRST <= magic <= SKIPPABLE_LAST:
            if at + 8 + size > len(view):
                raise ValueError("skippable frame is cut off")
            if magic == DICTIONARY_MAGIC and at == 0:
                content = bytes(view[8 : 8 + size])
                if content[:4] == struct.pack("<I", FRAME_MAGIC):
                    content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = frame_end(view, at)
            yield at, decoder.decompressobj().decompress(view[at:end])
            at = end
        else:
            raise ValueError(f"no frame at byte {at}")


# --- Spark ----------------------------------------------------------------


def _dictionary(pages: DataFrame, seed: int = 3) -> bytes:
    """A dictionary from a bounded sample of payloads; empty where there is nothing to learn from."""
    told = pages.select("html", F.octet_length("html").alias("n"), F.xxhash64(F.lit(seed), F.col("page_id").cast("string")).alias("k"), F.xxhash64("html").alias("h"))
    told = told.where("n > 0")
    # Lengths first, one row an id: no text is sent that isn't learnt from. A page that doesn't fit is passed over.
    size, taken = 0, []
    for k, first in told.groupBy("k").agg(F.min(F.struct("n", "h")).alias("first")).orderBy("k").limit(SAMPLE_PAGES).collect():
        if size + first["n"] <= SAMPLE_BYTES:
            size += first["n"]
            taken.append((k, first["n"], first["h"]))
    chosen = pages.sparkSession.createDataFrame(taken, "k long, n int, h long")
    rows = told.join(F.broadcast(chosen), ["k", "n", "h"]).groupBy("k").agg(F.first("html").alias("html")).collect()
    texts = [r["html"].encode("utf-8", "surrogatepass") for r in sorted(rows)]
    total = sum(map(len, texts))
    if not total:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 8)), texts, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def with_first_copies(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest and refers_to: the smallest id with the same payload, where that is another."""
    base = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    firsts = (
        base.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .where("first <> last")
        .select("digest", "first")
    )
    path = scratch(pages.sparkSession, "warc-firsts")
    firsts.write.parquet(path)
    firsts = pages.sparkSession.read.parquet(path)
    few = firsts.count() <= BROADCAST_FIRSTS
    return base.join(F.broadcast(firsts) if few else firsts, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to")
    )


def write_archives(pages: DataFrame, path: str, level: int = 3, least: int = REVISIT_BYTES, date: str = DATE) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to archives below ``path``.

    A task writes one archive, so archives are about as large as input splits.
    Of equal payloads of at least ``least`` bytes the one with the smallest
    page_id is a response (each row of that id, if it repeats) and the others
    revisit it. A null html is an empty payload. A row without page_id is a
    response and no other refers to it. Other columns are ignored.
    """
    dictionary = _dictionary(pages)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        press = zstandard.ZstdCompressor(level=level, write_checksum=True, **options).compress
        head = [struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary + _LINE_END] if dictionary else []
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                out = [press(record(*row, date)) + _LINE_END for row in zip(*(b[c].to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")))]
                yield pa.RecordBatch.from_arrays([pa.array(head + out, pa.binary())], ["frame"])
                head = []

    rows = with_first_copies(pages, least).mapInArrow(pack, "frame binary")
    rows.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives below ``path``.

    Columns: archive, at (offset of the frame), page_id, url, record_type,
    payload (null for revisits and where not asked for), payload_bytes,
    payload_digest, refers_to and problem: what a check found wrong, else
    null. After a broken frame the rest of its archive can't be read; a
    broken record costs only itself. Empty archives hold no records.
    """
    names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
    types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

    def rows_of(archive: str, data: bytes) -> Iterator[list]:
        walk, at = frames(data), 0
        while True:
            try:
                at, raw = next(walk)
            except StopIteration:
                return
            except (ValueError, zstandard.ZstdError, IndexError) as e:
                yield [archive, at, *[None] * 7, f"archive: {e}"]
                return
            try:
                r = parse(raw)
            except ValueError as e:
                yield [archive, at, *[None] * 7, f"record: {e}"]
                continue
            if not payloads:
                r["payload"] = None
            yield [archive, at, *(r[n] for n in names), None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, kinds = ["archive", "at", *names, "problem"], [pa.string(), pa.int64(), *types, pa.string()]

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], columns)

        for b in batches:
            for archive, data in zip(b["path"].to_pylist(), b["content"]):
                rows = []
                for r in rows_of(archive, data.as_py()):
                    rows.append(r)
                    if len(rows) >= 500:
                        yield flush(rows)
                        rows = []
                yield flush(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(
        run,
        "archive string, at long, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, problem string",
    )
