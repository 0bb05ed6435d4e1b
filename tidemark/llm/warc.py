"""WARC archives as a chunked record table.

A payload is never one block: it is cut into segments, each a WARC record of its own (the first a response, the others continuation
records with the same origin and rising segment numbers). The table of chunks has a record id, a segment number, the segment's bytes
and the digest of the payload up to its end, carried from segment to segment. The writer takes a payload as Spark hands it over, one
cell, and goes over it once: segments are slices of that cell, handed on in batches of a few megabytes, so its time is in proportion to
the payload and it holds no second copy. The reader holds one segment.

Files are written by Spark's text sink with CRLF between lines: a record's text ends with one CRLF and the sink adds the second. They
are compressed whole, so that a file is read by one task from its start and no record can be fetched alone, with a reader that follows
Content-Length and carries each record's SHA-1 and length from segment to segment. Any file system that Spark reads will do.

Records with equal payloads: the one with the largest id is the response; the others become revisit records that name it.

Defined cases: a null payload is empty; equal payloads shorter than `least` bytes are all responses; rows that repeat the largest id
are all responses; a null id gives way to any other; an empty table gives an empty archive and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, join_small, rows_left_join, small_batches, text_or_empty

#: Bytes of a segment, and of the segments that are handed on at once.
SEGMENT, BATCH = 1 << 16, 4 << 20
CRLF = "\r\n"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of binary data in upper-case base 32: 160 bits are four times 40, and 40 bits are eight digits."""
    hexes = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexes, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(id: Column) -> Column:
    """A urn:uuid that depends on the id alone."""
    h = F.md5(F.concat(F.lit("record "), F.coalesce(id.cast("string"), F.lit("null"))).cast("binary"))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def planned(pages: DataFrame, *, id: str, url: str, payload: str, least: int) -> DataFrame:
    """pages as _id, _url, _payload, _sha1, _bytes, _refers_to (null for responses)."""
    body = text_or_empty(payload)
    read = pages.select(F.col(id).alias("_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("_url"), body.alias("_payload"), base32_sha1(body.cast("binary")).alias("_sha1"), F.octet_length(body).cast("long").alias("_bytes"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("_key"))
    groups = read.where(F.col("_bytes") >= least).groupBy("_key").agg(F.max("_id").alias("_last"), F.count("*").alias("_many")).where("_many > 1").select("_key", "_last")
    joined = rows_left_join(read, cut(groups), "_key")
    return joined.withColumn("_refers_to", F.when(~F.col("_last").eqNullSafe(F.col("_id")), F.col("_last"))).drop("_key", "_last")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def segments(payload: memoryview, segment: int) -> list[tuple[int, int]]:
    """Where the segments of a UTF-8 payload begin and end: `segment` bytes each, less where a character would be cut."""
    ends = [0]
    while ends[-1] < len(payload):
        end = min(ends[-1] + segment, len(payload))
        while ends[-1] + 1 < end < len(payload) and payload[end] & 0xC0 == 0x80:
            end -= 1
        ends.append(end)
    return list(zip(ends, ends[1:])) or [(0, 0)]


def chunks(plan: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The chunk table: _id, _url, _sha1, _bytes, _refers_to, _chunk (from 1), _chunks, _upto (base-32 SHA-1 of the payload up to the
    chunk's end), _data; a revisit has one empty chunk."""
    kept = plan.select("_id", "_url", "_sha1", "_bytes", "_refers_to", F.col("_payload").cast("binary").alias("_payload"))
    schema = T.StructType([*kept.drop("_payload").schema.fields, T.StructField("_chunk", T.IntegerType()), T.StructField("_chunks", T.IntegerType()), T.StructField("_upto", T.StringType()), T.StructField("_data", T.StringType())])
    width = len(kept.columns) - 1

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0

            def ready(rows) -> pa.RecordBatch:
                own = pa.array([r[0] for r in rows], pa.int64())
                return pa.RecordBatch.from_arrays([*(batch.column(i).take(own) for i in range(width)), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows]), pa.array([r[4] for r in rows], pa.binary()).cast(pa.string())], names=schema.names)

            for i in range(batch.num_rows):
                revisit = batch.column(width - 1)[i].is_valid
                payload = memoryview(b"" if revisit else batch.column(width)[i].as_buffer())
                places, digest = segments(payload, segment), hashlib.sha1()
                for k, (a, b) in enumerate(places):
                    digest.update(payload[a:b])
                    rows.append((i, k + 1, len(places), base32(digest.digest()), bytes(payload[a:b])))
                    held += b - a
                    if held >= BATCH:
                        yield ready(rows)
                        rows, held = [], 0
            if rows:
                yield ready(rows)

    return kept.mapInArrow(cut_up, schema)


def records(table: DataFrame, date: str) -> DataFrame:
    """One WARC record per chunk, as the text that the sink writes."""
    own = record_id(F.col("_id"))
    first, last = F.col("_chunk") == 1, F.col("_chunk") == F.col("_chunks")
    revisit = F.col("_refers_to").isNotNull()
    http = F.when(first, F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("_bytes"), F.lit(CRLF + CRLF))).otherwise("")
    block = F.concat(http, F.col("_data"))
    line = lambda name, value, when=None: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) if when is None else F.when(when, F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise("")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").when(first, "response").otherwise("continuation")),
        line("WARC-Record-ID", F.when(first, own).otherwise(F.concat(F.rtrim(own, F.lit(">")), F.lit("."), F.col("_chunk"), F.lit(">")))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.translate("_url", "\r\n", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_sha1")), first),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), revisit),
        line("WARC-Refers-To", record_id(F.col("_refers_to")), revisit),
        line("X-Source-ID", F.coalesce(F.col("_id").cast("string"), F.lit(""))),
        line("X-Refers-To-Source-ID", F.col("_refers_to").cast("string"), revisit),
        line("X-Payload-Length", F.col("_bytes").cast("string"), first),
        line("WARC-Segment-Number", F.col("_chunk").cast("string"), F.col("_chunks") > 1),
        line("WARC-Segment-Origin-ID", own, ~first),
        line("WARC-Segment-Total-Length", F.col("_bytes").cast("string"), last & ~first),
        line("X-Payload-Digest-So-Far", F.concat(F.lit("sha1:"), F.col("_upto")), ~revisit),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
    )
    return table.select(F.concat(head, block, F.lit(CRLF)).alias("value"))


def write_archives(pages: DataFrame, path: str, *, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, segment: int = SEGMENT, date: str = "2020-01-01T00:00:00Z") -> None:
    """Write pages as gzipped WARC files under path."""
    table = chunks(planned(pages, id=id, url=url, payload=payload, least=least), segment)
    with small_batches(pages.sparkSession):
        records(table, date).write.mode("overwrite").option("lineSep", CRLF).option("compression", "gzip").text(path)


class _Reader:
    """Follows WARC records over lines (without their CRLF), however the payload's own lines fall."""

    def __init__(self) -> None:
        self.head: dict[str, str] = {}
        self.left = -1  # bytes of the block that are still to come; -1: outside a block
        self.http = b""
        self.in_http = False
        self.open: dict | None = None

    def lines(self, lines) -> Iterator[dict]:
        for line in lines:
            if self.left < 0:
                yield from self._outside(line)
            else:
                yield from self._inside(line + b"\r\n")

    def _outside(self, line: bytes) -> Iterator[dict]:
        if line.startswith(b"WARC/") and not self.head:
            self.head = {"": line.decode()}
        elif self.head and line:
            name, _, value = line.decode("utf-8").partition(":")
            self.head[name.lower()] = value.strip()
        elif self.head:
            yield from self._begin()

    def _begin(self) -> Iterator[dict]:
        head, self.left = self.head, int(self.head["content-length"])
        self.head = {}
        kind = head["warc-type"]
        if kind != "continuation":
            if self.open:
                raise ValueError(f"record {self.open['id']} ends before its last segment")
            self.open = {"id": head["warc-record-id"], "kind": kind, "head": head, "sha": hashlib.sha1(), "bytes": 0, "segment": 0}
            self.in_http, self.http = True, b""
        elif not self.open or head["warc-segment-origin-id"] != self.open["id"]:
            raise ValueError(f"{head['warc-record-id']} continues another record")
        self.open["segment"] += 1
        if int(head.get("warc-segment-number", "1")) != self.open["segment"]:
            raise ValueError(f"{head['warc-record-id']} is out of order")
        self.open["upto"] = head.get("x-payload-digest-so-far", "").removeprefix("sha1:")
        self.open["last"] = "warc-segment-number" not in head or "warc-segment-total-length" in head
        if not self.left:
            yield from self._end()

    def _inside(self, data: bytes) -> Iterator[dict]:
        data, rest = data[: self.left], data[self.left :]
        self.left -= len(data)
        if self.in_http:
            self.http += data
            if b"\r\n\r\n" in self.http:
                data = self.http.partition(b"\r\n\r\n")[2]
                self.in_http = False
            else:
                data = b""
        self.open["sha"].update(data)
        self.open["bytes"] += len(data)
        if not self.left:
            yield from self._end()
            if rest not in (b"", b"\r\n"):
                raise ValueError("bytes after a block")

    def _end(self) -> Iterator[dict]:
        self.left = -1
        r = self.open
        if r["upto"] and base32(r["sha"].digest()) != r["upto"]:
            raise ValueError(f"{r['id']}: segment {r['segment']} isn't what its header says")
        if not r["last"]:
            return
        self.open = None
        head, told = r["head"], r["head"]["warc-payload-digest"].removeprefix("sha1:")
        if r["kind"] == "response" and (base32(r["sha"].digest()) != told or r["bytes"] != int(head["x-payload-length"])):
            raise ValueError(f"{r['id']}: the payload isn't what its header says")
        yield {"source_id": head["x-source-id"] or None, "payload_bytes": int(head["x-payload-length"]), "payload_digest": told, "record_type": r["kind"], "refers_to": head.get("x-refers-to-source-id"), "url": head["warc-target-uri"], "segments": r["segment"]}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit record: source_id, payload_bytes, payload_digest, record_type, refers_to, url, segments.
    The digest and length of every response are computed again over its segments and must agree with its headers; every revisit must
    name a response with its digest and length."""
    schema = pa.schema([("source_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("segments", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            yield pa.RecordBatch.from_pylist(list(reader.lines(x.as_py() for x in batch.column(0))), schema=schema)
        if reader.open or reader.left >= 0:
            raise ValueError("the archive ends inside a record")

    lines = spark.read.option("lineSep", CRLF).text(path).select(F.col("value").cast("binary"))
    rows = cut(lines.mapInArrow(read, "source_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, segments long"))
    named = rows.where("record_type = 'revisit'").select(F.col("refers_to").alias("_named")).distinct()
    there = cut(rows.where("record_type = 'response'").join(named, F.col("source_id") == F.col("_named"), "left_semi").select(F.col("source_id").alias("_named"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")).distinct())
    found = join_small(rows, there, (F.col("refers_to") == F.col("_named")) & (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes")), "left")
    lost = (F.col("record_type") == "revisit") & F.col("_named").isNull()
    return found.withColumn("payload_digest", F.when(lost, F.raise_error(F.concat(F.lit("no response with the payload of revisit "), F.coalesce("source_id", F.lit("null"))))).otherwise(F.col("payload_digest"))).drop("_named", "_digest", "_bytes")
