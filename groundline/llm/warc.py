"""WARC archives: a distributed writer with revisit records, and a salvage reader.

Writing: records are built and written by Spark's own text writer, whose separator is the CRLF CRLF that ends a record,
so each part file is an archive and Spark's committer keeps it whole when executors are lost. Compressed archives have one
gzip member a record, so damage costs the records it stands in and no others. Reading: each file's bytes are parsed in a
worker. A record (or gzip member) that fails a check - version line, header, length, closing CRLF CRLF, block digest - is
given up; the reader searches on from the next byte for a gzip member or version line that passes all checks, and logs the
bytes between as a quarantined gap. Of a member that is damaged or does not end, the records that could still be inflated
and have a block digest that fits are kept; the gap is logged all the same.

Null payloads are empty payloads, null urls the empty url. Repeated rows are written as often as they stand. An empty
table gives no records. Page ids may repeat: each such row equals the least id of its payload's group or revisits it.
A null page id is written as ``null`` and read back as null.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.llm.tables import read, shared_dir

#: Fixed value: the alphabet of RFC 4648 base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = re.compile(rb"WARC/\d\.\d\r\n")
GZIP = b"\x1f\x8b\x08"
LEVEL = 6
#: Bytes that are inflated at a time; an empty gzip member.
PIECE = 1 << 16
NOTHING = gzip.compress(b"", mtime=0)
RECORD = "file string, kind string, offset long, length long, type string, record_id string, url string, refers_to string, payload_bytes long, payload_digest string, payload binary, reason string"


def base32_of_hex(sha1: Column) -> Column:
    """Base32 of 40 hex digits: five digits are four characters."""
    chunks = [F.conv(F.substring(sha1, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(c, s).bitwiseAND(31) + 1, F.lit(1)) for c in chunks for s in (15, 10, 5, 0)])


def records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(record): each row's WARC record without the CRLF CRLF that ends it.

    Of rows with equal payloads those with the least key are responses; the others revisit that key. Payloads are moved
    once at most: digests are grouped alone, and only rows that revisit are named in the join that follows.
    """
    p = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    body = F.col("payload").cast("binary")
    p = p.withColumn("digest", base32_of_hex(F.sha1(body))).withColumn("size", F.octet_length("payload"))
    first = p.select("key", "digest").groupBy("digest").agg(F.min("key").alias("first"))
    p = p.join(first, "digest", "left")
    again = ~F.col("key").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    name = F.coalesce(F.col("key").cast("string"), F.lit("null"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), name, F.lit(">"))),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        F.lit("WARC-Date: 2020-01-01T00:00:00Z\r\n"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.sha1(F.col("block").cast("binary"))))),
        F.when(again, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("first"), F.lit(">\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    return p.withColumn("block", block).select(F.concat(header, F.col("block")).alias("record"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as a gzip member without its last byte, which is zero.

    That byte is the highest of the content's length: for a record of 16 MB or more an empty member follows, which ends so.
    """
    for batch in batches:
        out, held = [], 0
        for record in batch.column("record"):
            member = gzip.compress(bytes(record.as_buffer()) + b"\r\n\r\n", LEVEL, mtime=0)
            member = member[:-1] if not member[-1] else member + NOTHING[:-1]
            out.append(member)
            held += len(member)
            if held > 4 << 20:
                yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])
                out, held = [], 0
        yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])


def write(pages: DataFrame, path: str, compress: bool = False, rows_per_file: int = 4_000, **columns: str) -> None:
    """Write an archive folder: part files of at most rows_per_file records, one gzip member a record if ``compress``."""
    out, end = records(pages, **columns), "\r\n\r\n"
    if compress:  # the text writer puts bytes as they are, and the byte that ends every member after each
        out, end = out.select(F.col("record").cast("binary").alias("record")).mapInArrow(_members, "value binary").select(F.col("value").cast("string")), "\0"
    name = {"lineSep": end, "maxRecordsPerFile": rows_per_file, "compression": "none"}
    out.write.mode("overwrite").options(**name).text(path)


def _record_at(data: bytes, at: int, proved: bool = False) -> tuple[int, dict] | str:
    """The record that begins here as (end, fields), or why there is none; ``proved``: only with a block digest."""
    if not VERSION.match(data, at):
        return "no version line"
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        return "header does not end"
    fields = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "malformed header line"
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not (size := fields.get("content-length", "")).isdecimal() or "warc-type" not in fields or "warc-record-id" not in fields:
        return "a required header field is missing"
    end = head + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        return "length does not fit"
    block = data[head + 4 : end]
    kind, _, digest = fields.get("warc-block-digest", "").partition(":")
    if kind == "sha1" and digest != base64.b32encode(hashlib.sha1(block).digest()).decode():
        return "block digest does not fit"
    if proved and kind != "sha1":
        return "no block digest in a damaged member"
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = len(payload)
        if fields["warc-type"] == "revisit" and (m := re.search(rb"(?im)^content-length:\s*(\d+)", http)):
            size = int(m[1])
    whole = fields["warc-type"] != "revisit"
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if whole else fields.get("warc-payload-digest", "").partition(":")[2]
    return end + 4, {
        "type": fields["warc-type"],
        "record_id": fields["warc-record-id"].strip("<>"),
        "url": fields.get("warc-target-uri"),
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload if whole else None,
    }


def _member_at(data: bytes, at: int) -> tuple[int, bytes, str]:
    """The gzip member that begins here as (end, content, ""), or as far as it can be inflated and why not to its end."""
    unzip, view, content = zlib.decompressobj(31), memoryview(data), []
    while at < len(data):
        before = unzip.copy()
        try:
            content.append(unzip.decompress(view[at : at + PIECE]))
        except zlib.error as error:
            for k in range(at, min(at + PIECE, len(data))):  # up to the byte that shows the damage
                try:
                    content.append(before.decompress(view[k : k + 1]))
                except zlib.error:
                    break
            return at, b"".join(content), f"gzip: {error}"
        at = min(at + PIECE, len(data))
        if unzip.eof:
            return at - len(unzip.unused_data), b"".join(content), ""
    return at, b"".join(content), "gzip member does not end"


def salvage(data: bytes, proved: bool = False) -> Iterator[tuple[str, int, int, dict | str]]:
    """('record', offset, length, fields) and ('gap', offset, length, reason), in order of offset.

    Records of a gzip member have the member's offset and length; a gap inside a member is told with the member's place.
    Records of a damaged member have its offset and the length of the gap that follows them.
    """
    at, lost, why, held = 0, None, "", []
    starts = re.compile(rb"WARC/\d\.\d\r\n|\x1f\x8b\x08")

    def gap(end: int) -> Iterator[tuple[str, int, int, dict | str]]:
        for inner in held:
            yield "record", lost, end - lost, inner
        held.clear()
        yield "gap", lost, end - lost, why

    while at < len(data):
        if data.startswith(GZIP, at):
            end, what, failed = _member_at(data, at)
            inside = [inner for kind, _, _, inner in salvage(what, True) if kind == "record"] if failed else []
            if inside and lost is not None:
                yield from gap(at)
                lost = None
            held += inside
            got = failed or (end, what)
        else:
            got = _record_at(data, at, proved)
        if isinstance(got, str):
            if lost is None:
                lost, why = at, got
            found = starts.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if lost is not None:
            yield from gap(at)
            lost = None
        end, what = got
        if isinstance(what, dict):
            yield "record", at, end - at, what
        else:
            for kind, offset, _, inner in salvage(what, proved):
                yield kind, at, end - at, inner if kind == "record" else f"{inner}, at {offset} of the member"
        at = end
    if lost is not None:
        yield from gap(len(data))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of every file under path, with the columns of RECORD; kind is record or gap."""
    names = [f.split()[0] for f in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k]) for n, k in (f.split() for f in RECORD.split(", "))])
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, held = [], 0
                for kind, offset, length, what in salvage(content.as_py()):
                    fields = what if kind == "record" else {"reason": what}
                    rows.append({"file": name.as_py(), "kind": kind, "offset": offset, "length": length, **fields})
                    held += length
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, RECORD).select(*names)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(read(spark, sf_dir, "pages"), path, compress=True)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    got = read_archives(spark, path).filter("kind = 'record'")
    return got.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS first,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('{BASE32}', 1 + CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS INTEGER) >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM d
"""
