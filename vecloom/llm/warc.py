"""WARC archives: writing page records with segmentation and chunked framing, and reassembling them.

Writing: a page becomes one HTTP response record whose body uses chunked transfer framing. A block longer than
``segment_bytes`` is split into a first segment and ``continuation`` records that name the first one in
``WARC-Segment-Origin-ID``; the last carries ``WARC-Segment-Total-Length``. Every record is its own gzip member. Files go
through Spark's text sink, whose line separator is an empty gzip member, so any store that Spark can write is a target
and each file is a plain ``.warc.gz`` stream.

Reading: files are streams of records, never held as a whole. What :func:`write_archive` wrote is cut at its separators, also
within a file; other archives (``.warc.gz``, one or many members) are inflated by Spark's text source and cut at record
heads, and lengths tell which heads are real. Only segments are grouped: by origin id, ordered by number, checked for gaps
and for the stated total length, joined, and the chunk framing is decoded. A group is one page, so no task holds more.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import lean, only, shared_path, stored, text_batches

SEGMENT_BYTES = 8192
CHUNK_BYTES = 4096
DEDUP_MIN_BYTES = 100
RECORDS_PER_FILE = 2000
#: A gzip member without content.
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" "0300" "00000000" "00000000")
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int) -> bytes:
    out = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    out.append(b"0\r\n\r\n")
    return b"".join(out)


def unchunked(body: bytes) -> bytes:
    """Decode chunked framing; chunk extensions and trailers are skipped. Raises ValueError if it is cut off."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line is missing")
        size = int(body[at:end].split(b";", 1)[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if at + size + 2 > len(body) or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        out.append(body[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    data = head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record_id(*parts: object) -> str:
    """A record's id from what it holds."""
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(repr(parts).encode()).hexdigest())}>"


def target(url: str | None) -> str:
    return quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~-._")


def page_records(page_id, url, payload: bytes, digest: str, refers_to, refers_url, archive: str, tag: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The gzip members of one page: a revisit, a whole response, or a segmented response.

    A response's id is made of the archive's name, page and payload, so a revisit can name it; ``tag`` tells repeated rows apart.
    """
    revisit = refers_to is not None
    rid = record_id(archive, page_id, digest, "revisit" if revisit else "response")
    base = [("WARC-Record-ID", rid), ("WARC-Date", DATE), ("WARC-Target-URI", target(url)), ("X-Page-ID", page_id), ("X-Row", tag), ("WARC-Payload-Digest", f"sha256:{digest}")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    kind = ("Content-Type", "application/http; msgtype=response")
    if revisit:
        first = [("WARC-Refers-To", record_id(archive, refers_to, digest, "response")), ("WARC-Refers-To-Target-URI", target(refers_url)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", refers_to)]
        yield record([("WARC-Type", "revisit"), *base, ("WARC-Profile", PROFILE), *first, kind], http)
        return
    block = http + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield record([("WARC-Type", "response"), *base, kind], block)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield record([("WARC-Type", "response"), *base, ("WARC-Segment-Number", 1), kind], parts[0])
    for n, part in enumerate(parts[1:], 2):
        own = record_id(archive, page_id, digest, "segment", n)
        total = len(block) if n == len(parts) else None
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", target(url)), ("X-Row", tag), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], part)


def write_archive(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, dedup_min_bytes: int = DEDUP_MIN_BYTES) -> None:
    """Write a record per row of ``pages(page_id, url, html)`` to WARC files under ``path``.

    Payload: ``html`` in UTF-8; null is empty. Of equal payloads of at least ``dedup_min_bytes``, rows with the smallest
    page_id are responses (repeated rows of that id too), the rest revisit it. Rows without page_id are written and read
    back with a null id; they are revisits if their payload has a page with an id. An empty table writes no record.
    """
    text_batches(pages.sparkSession)
    rows = only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # One row for each repeated payload, summed before the shuffle; stored, so that both join sides are plain exchanges
    # and adaptive execution can split the pages of a hot payload.
    first = stored(
        rows.filter(F.length("payload") >= dedup_min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("same"), "first_id", "first_url"),
        "warc-first",
    )
    whole = rows.join(first, F.col("digest") == F.col("same"), "left").select("page_id", "url", "payload", "digest", F.when(F.col("page_id").eqNullSafe(F.col("first_id")), None).otherwise(F.col("first_id")).alias("refers_to"), "first_url")
    archive = path.rpartition("/")[2]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, held = [], 0
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to", "first_url"))):
                n += 1
                for member in page_records(*row, archive, f"{part}/{n}", segment_bytes, chunk_bytes):
                    out.append(member)
                    held += len(member)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    members = whole.mapInArrow(lean(pack), "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def inflate(data: bytes) -> bytes:
    """All gzip members of ``data``, in linear time for any number of members."""
    view, out, at = memoryview(data), [], 0
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof and at < len(view):
            piece = view[at : at + 16384]
            out.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record in an uncompressed WARC stream, up to one without a whole head."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            key, _, value = line.partition(b":")
            fields[key.strip().lower().decode()] = value.strip().decode()
        size = int(fields.get("content-length", "-1"))
        if size < 0:
            return
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def payload_of(block: bytes) -> bytes:
    """The decoded entity body of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")) else body


#: What stands before the version of a WARC record.
HEAD = "WARC/1."


def member_records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of rows that hold whole gzip members."""
    for batch in batches:
        for value in batch.column("value"):
            yield from parse(inflate(value.as_py()))


def stream_records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of inflated files that were cut at ``HEAD``, in order: a cut inside a block is undone by the record's length. A
    file begins with an empty row; a record that its end cuts off is given with what there is."""
    held, need = b"", 0

    def length(data: bytes) -> int:
        end = data.find(b"\r\n\r\n")
        found = re.search(rb"(?im)^content-length:\s*(\d+)", data[: end + 2]) if end >= 0 else None
        return end + 4 + int(found[1]) if found else 0

    for batch in batches:
        for value in batch.column("value"):
            value = value.as_py()
            if held and (not value or need and len(held) >= need):
                yield from parse(held)
                held = b""
            if value:
                held += HEAD.encode() + value
                need = length(held)
    if held:
        yield from parse(held)


RECORDS = "origin string, row string, page_id long, record_type string, refers_to long, digest string, segment long, total long, payload_bytes long, actual string, block binary"
ROWS = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, valid boolean"


def read_archive(spark: SparkSession, path: str, own: bool = True) -> DataFrame:
    """Records under ``path``, reassembled: page_id, record_type, refers_to, payload_bytes, payload_digest, valid.

    ``own``: files of :func:`write_archive`; else other archives, plain or with the ending ``.gz``, whose records have no page_id
    and may have no digest. ``valid`` is false, and the payload columns are null, where a segment is missing or repeated, the
    total length differs, the framing or the record is cut off, or a SHA-256 digest in the header differs. A revisit takes length
    and digest from the record that it refers to. Records other than response, revisit and continuation are left out.
    """

    def number(x):
        return None if x is None else int(x)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("origin", pa.string()), ("row", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("payload_bytes", pa.int64()), ("actual", pa.string()), ("block", pa.binary())])
        rows, held = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

        for f, block in (member_records if own else stream_records)(batches):
            segment, kind = number(f.get("warc-segment-number")), f.get("warc-type")
            if kind not in ("response", "revisit", "continuation"):
                continue
            size = actual = None
            if kind == "response" and segment is None and len(block) == int(f["content-length"]):
                try:
                    payload = payload_of(block)
                    size, actual = len(payload), hashlib.sha256(payload).hexdigest()
                except ValueError:
                    pass
            said = f.get("warc-payload-digest", "")
            said = said.removeprefix("sha256:") if said.startswith("sha256:") else None
            rows.append((f.get("warc-segment-origin-id", f.get("warc-record-id")), f.get("x-row"), number(f.get("x-page-id")), kind, number(f.get("x-refers-to-page-id")), said, segment, number(f.get("warc-segment-total-length")), size, actual, None if segment is None else block))
            held += 0 if segment is None else len(block)
            if held > 4 << 20 or len(rows) >= 10_000:
                yield out()
                rows, held = [], 0
        if rows:
            yield out()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("valid", pa.bool_())])
        for batch in batches:
            rows = []
            for parts in batch.column("parts"):
                parts = parts.as_py()
                first, size, actual = parts[0], None, None
                block = b"".join(p["block"] for p in parts)
                if [p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and parts[-1]["total"] == len(block):
                    try:
                        payload = payload_of(block)
                        size, actual = len(payload), hashlib.sha256(payload).hexdigest()
                    except ValueError:
                        pass
                ok = first["record_type"] == "response" and size is not None and first["digest"] in (None, actual)
                rows.append((first["page_id"], first["record_type"], None, size if ok else None, actual if ok else None, ok))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    text_batches(spark)
    cut = {"lineSep": EMPTY_MEMBER.decode("latin-1"), "encoding": "ISO-8859-1"} if own else {"lineSep": HEAD}
    lines = spark.read.options(**cut).text(path).select(F.col("value").cast("binary").alias("value"))
    parts = stored(lines.mapInArrow(lean(scan), RECORDS), "warc-records")
    whole = parts.filter("segment IS NULL")
    good = F.col("actual").isNotNull() & (F.col("digest").isNull() | (F.col("digest") == F.col("actual"))) & (F.col("record_type") == "response")
    single = whole.filter("record_type <> 'revisit'").select("page_id", "record_type", F.lit(None).cast("long").alias("refers_to"), F.when(good, F.col("payload_bytes")).alias("payload_bytes"), F.when(good, F.col("actual")).alias("payload_digest"), good.alias("valid"))
    segments = parts.filter("segment IS NOT NULL").groupBy("origin", "row").agg(F.array_sort(F.collect_list(F.struct("segment", "total", "block", "page_id", "record_type", "digest"))).alias("parts")).select("parts")
    rows = stored(single.unionByName(segments.mapInArrow(lean(assemble), ROWS)), "warc-rows")
    target = rows.filter("valid").groupBy(F.col("page_id").alias("target"), F.col("payload_digest").alias("target_digest")).agg(F.max("payload_bytes").alias("target_bytes"))
    revisits = whole.filter("record_type = 'revisit'").join(stored(target, "warc-targets"), (F.col("refers_to") == F.col("target")) & (F.col("digest") == F.col("target_digest")), "left")
    revisits = revisits.select("page_id", "record_type", "refers_to", F.col("target_bytes").alias("payload_bytes"), F.when(F.col("target").isNotNull(), F.col("digest")).alias("payload_digest"), F.col("target").isNotNull().alias("valid"))
    return rows.unionByName(revisits)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS b, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE b >= 100 GROUP BY d)
SELECT p.page_id, CAST(p.b AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
