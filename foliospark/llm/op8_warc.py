"""WARC archives: write, index, read selected records by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._registry import keep, query, scratch, table

#: Payload bytes and records per archive file, before compression.
FILE_BYTES, FILE_RECORDS = 64 << 20, 50_000
#: Selected records closer than this are read as one range, of at most this length.
GAP_BYTES, RANGE_BYTES = 64 << 10, 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty gzip member; the writer puts it behind every record, readers pass over it.
CLOSING = bytes.fromhex("1f8b080000000000020303000000000000000000")
_BLOCK = 1 << 16


def record_member(rec_id: int | None, url: str, size: int, digest: str, payload: bytes | None, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member of its own; without a payload, a revisit."""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if rec_id is None else rec_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
    ]
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload or b'')}"]
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    out = press.compress("\r\n".join(head).encode() + b"\r\n\r\n")
    return out + press.compress(payload or b"") + press.compress(b"\r\n\r\n") + press.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size + 4:
        raise ValueError(f"record {fields.get('WARC-Record-ID')} has {len(rest) - 4} bytes, not {size}")
    return fields, rest[:size]


def _page(urn: str | None) -> int | None:
    number = (urn or "")[len("<urn:page:") : -1]
    return int(number) if number else None


def _one_line(col: Column) -> Column:
    """Header values end at a line break: control characters in a URL become spaces."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"[\x00-\x1F\x7F]", " ")


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``sha, size, last``: for payloads of at least ``min_bytes``, the largest page id that has them."""
    return (
        pages.filter((F.col("size") >= min_bytes) & F.col("page_id").isNotNull())
        .groupBy("sha", "size").agg(F.max(F.struct("page_id", "uh")).alias("last"))
    )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compress every payload as a response, before anything is shuffled."""
    for batch in batches:
        rows = batch.to_pydict()
        out = [
            record_member(i, u, len(p), base64.b32encode(bytes.fromhex(s)).decode(), p, None)
            for i, u, s, p in zip(rows["page_id"], rows["url"], rows["sha"], rows["payload"], strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("page_id", "uh", "sha", "url")), pa.array(map(len, rows["payload"]), pa.int64()),
             pa.array([1] * len(out), pa.int32()), pa.nulls(len(out), pa.int64()), pa.array(out, pa.binary())],
            ["page_id", "uh", "sha", "url", "size", "kind", "refers_to", "member"],
        )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records in order: a plan row (kind 0) tells that the equal rows behind it are revisits.

    Rows that repeat id, URL and payload: all but one of them revisit that one.
    """
    plan, seen = {}, None
    for batch in batches:
        rows, out = batch.to_pydict(), []
        for i, uh, sha, url, size, kind, to, member in zip(*(rows[c] for c in rows), strict=True):
            key = (i, uh, sha)
            if kind == 0:
                plan = {key: to}
                continue
            if i is not None and (key in plan or seen == key):
                member = record_member(i, url, size, base64.b32encode(bytes.fromhex(sha)).decode(), None, plan.get(key, i))
            seen = key
            out.append(member)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write one record per row of ``page_id, url, html`` below ``path``.

    Of records with equal payloads (SHA-1 and length) of at least
    ``min_bytes`` bytes, the one with the largest id is the response, the
    others are revisits without a payload. A null html is an empty payload, a
    null url an empty one; rows without an id are responses without an id.
    Other columns are ignored. An empty table writes no record.

    Payloads are compressed where they are read, so that only compressed
    records are shuffled, by the hash of the id; a file holds about
    ``FILE_BYTES`` of payload in id order. The text writer with an empty gzip
    member as separator makes each part a valid multi-member gzip file.
    """
    rows = pages.select(
        "page_id", _one_line(F.col("url")).alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("uh", F.xxhash64("url"))
    small = keep(
        rows.select("page_id", "uh", F.sha1("payload").alias("sha"), F.octet_length("payload").cast("long").alias("size")),
        "warc-digests",
    )
    total = small.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    files = max(1, -(-(total["b"] or 0) // FILE_BYTES), -(-total["n"] // FILE_RECORDS))
    revisits = (
        small.filter("page_id is not null").distinct().join(decide(small, min_bytes), ["sha", "size"])
        .filter(F.struct("page_id", "uh") != F.col("last"))
        .select(
            "page_id", "uh", "sha", F.lit("").alias("url"), "size", F.lit(0).alias("kind"),
            F.col("last.page_id").alias("refers_to"), F.lit(None).cast("binary").alias("member"),
        )
    )
    members = rows.withColumn("sha", F.sha1("payload")).mapInArrow(
        _members,
        "page_id long, uh long, sha string, url string, size long, kind int, refers_to long, member binary",
    )
    records = (
        members.unionByName(revisits).repartition(files, "page_id")
        .sortWithinPartitions("page_id", "uh", "sha", "kind").mapInArrow(_merged, "member binary")
    )
    records.select(F.col("member").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option(
        "lineSep", CLOSING.decode("latin-1")
    ).option("compression", "none").text(path)


def _open(uri: str):
    """A file by its URI, for range reads inside a task."""
    store, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return store.open_input_file(path)


def _walk(file) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Offset, length and headers of every record, reading the file once in blocks."""
    at, end, held = 0, file.size(), b""
    while at < end:
        start, unpack, head = at, zlib.decompressobj(31), b""
        while not unpack.eof:
            if not held:
                held = file.read(_BLOCK)
                if not held:
                    raise ValueError("the last record is cut off")
            plain = unpack.decompress(held)
            used = len(held) - len(unpack.unused_data)
            at, held = at + used, unpack.unused_data
            if b"\r\n\r\n" not in head:
                head += plain
        if head:
            yield start, at - start, dict(x.split(": ", 1) for x in head.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])


_INDEX = "file string, offset long, length long, page_id long, url string, digest string, size long, record_type string"


def index_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``file, offset, length, page_id, url, digest, size, record_type``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                with _open(uri) as file:
                    rows = [
                        (uri, at, n, _page(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Payload-Digest"][5:],
                         int(h["X-Payload-Length"]), h["WARC-Type"]) for at, n, h in _walk(file)
                    ]
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                        [c.split()[0] for c in _INDEX.split(", ")],
                    )

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.repartition(max(1, spark.sparkContext.defaultParallelism), "path").mapInArrow(scan, _INDEX)


def read_records(selected: DataFrame) -> DataFrame:
    """The records of index rows: ``page_id, url, record_type, refers_to, size, digest, payload``.

    Sorted by file and offset, neighbours no farther than ``GAP_BYTES`` from
    each other become one range, which is read with one request. A range ends
    at every ``RANGE_BYTES`` of its file, so none grows without bound. The
    payload of a response is checked against its digest.
    """
    part = F.floor(F.col("offset") / RANGE_BYTES)
    near = Window.partitionBy("file", "part").orderBy("offset")
    gap = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(near) > GAP_BYTES
    ranges = (
        selected.select("file", "offset", "length", part.alias("part"))
        .withColumn("new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(near))
        .groupBy("file", "part", "run")
        .agg(
            F.min("offset").alias("first"), F.max(F.col("offset") + F.col("length")).alias("last"),
            F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"),
        )
    )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["file"]) as file:
                    file.seek(row["first"])
                    block = file.read(row["last"] - row["first"])
                found = []
                for r in row["records"]:
                    at = r["offset"] - row["first"]
                    h, payload = parse_record(zlib.decompress(block[at : at + r["length"]], 31))
                    kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"][5:]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"record {h['WARC-Record-ID']} does not fit its digest")
                    found.append((_page(h["WARC-Record-ID"]), h["WARC-Target-URI"], kind, _page(h.get("WARC-Refers-To")),
                                  int(h["X-Payload-Length"]), digest, payload if kind == "response" else None))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                for at in range(0, len(found), 256):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*found[at : at + 256], strict=True), kinds, strict=True)],
                        ["page_id", "url", "record_type", "refers_to", "size", "digest", "payload"],
                    )

    return ranges.select("file", "first", "last", "records").mapInArrow(
        fetch, "page_id long, url string, record_type string, refers_to long, size long, digest string, payload binary"
    )


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_SHA = "CAST(('0x' || substr(h, {}, 5)) AS BIGINT)"
_DIGITS = " || ".join(
    f"substr('{_B32}', CAST(((({_SHA.format(5 * i + 1)}) >> {shift}) & 31) + 1 AS BIGINT), 1)"
    for i in range(8) for shift in (15, 10, 5, 0)
)
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS h,
  max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM q
"""


@query("op8_warc", ORACLE)
def op8_warc(spark, sf_dir):
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    index = keep(index_archives(spark, path), "warc-index")
    return read_records(index).select(
        "page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )
