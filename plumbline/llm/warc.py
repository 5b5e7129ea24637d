"""WARC archives written and read back, with segment reassembly.

Writing: every page becomes a ``response`` record, or a ``revisit`` that refers
to the record of the page that keeps its payload. The HTTP message is framed in
chunks; messages longer than ``SEGMENT_CHARS`` are cut into a first record and
``continuation`` records that name its id, their number and, on the last, the
total length. One row is one record and the writer's line separator is the
record separator, so that the files are plain WARC files, packed by gzip, and no
task holds more than one record.

Reading: the files come as bytes, cut at blank lines (``*.gz``, in a stream) or
whole (``*.warc``). A record's border is where its Content-Length puts it,
whatever bytes it holds, so archives of others read too. Continuations are
grouped by the origin's id, put in order of their numbers, checked for gaps and
for the total length, and their chunks are decoded. A broken record or message
is returned with ``error`` set, never dropped.

Edge cases: null html is the empty payload; equal payloads of null ids and given
ids revisit the largest id; pages that repeat id and payload are all responses
with record ids of their own, and as many messages are read back; records without a digest are not held
against one; an empty table writes an empty archive, which reads as no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read, shared_folder, small_side

BREAK = "\r\n\r\n"
SEGMENT_CHARS, CHUNK_CHARS, LEAST_BYTES = 8192, 4096, 0
PAGE = "urn:page:"


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunked(payload: str, size: int = CHUNK_CHARS) -> str:
    """The payload in chunked transfer framing; borders lie between code points."""
    cuts = (payload[at : at + size] for at in range(0, len(payload), size))
    return "".join(f"{len(c.encode()):x}\r\n{c}\r\n" for c in cuts) + "0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        chunk = body[end + 2 : end + 2 + size]
        if len(chunk) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(chunk)
        at = end + 4 + size


def _records(page: dict, segment: int, date: str, number: str) -> Iterator[str]:
    """The records of one page, each without its closing separator. ``number`` is the page's own in this run; those that no record refers to have it in their ids."""
    data = page["payload"].encode()
    digest = b32(hashlib.sha1(data).digest())
    name = lambda n: f"{PAGE}{'none' if n is None else n}:{digest}"
    own = name(page["page_id"]) if page["named"] else f"{name(page['page_id'])}:{number}"
    common = [f"WARC-Date: {date}", f"WARC-Target-URI: {page['url']}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

    def record(kind: str, record_id: str, headers: list[str], block: str) -> str:
        return "\r\n".join(["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", *headers, f"Content-Length: {len(block.encode())}"]) + BREAK + block

    if page["refers_to"] is not None:
        yield record("revisit", own, [*common, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{name(page['refers_to'])}>"], f"{http}Content-Length: {len(data)}{BREAK}")
        return
    block = f"{http}Transfer-Encoding: chunked{BREAK}{chunked(page['payload'])}"
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        yield record("response", own, common, block)
        return
    yield record("response", own, [*common, "WARC-Segment-Number: 1"], parts[0])
    for k, part in enumerate(parts[1:], 2):
        last = [f"WARC-Segment-Total-Length: {len(block.encode())}"] * (k == len(parts))
        yield record("continuation", f"{own}:{k}", [common[0], common[1], f"WARC-Segment-Origin-ID: <{own}>", f"WARC-Segment-Number: {k}", *last], part)


def _spell(segment: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                pages = batch.slice(lo, 64).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([r for k, page in enumerate(pages, done) for r in _records(page, segment, date, f"{task}.{k}")], pa.string())], ["record"])
                done += len(pages)

    return run


def with_revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """pages with payload and ``refers_to``: of equal payloads of ``least`` bytes and more, the largest id keeps it; ``named`` is one row of those that are referred to.

    Which of rows that repeat id and payload is named, their place in the table decides: it has to be the same when read twice.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]", "%20").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    own = own.withColumn("same", F.concat(F.sha2("payload", 256), F.octet_length("payload").cast("string"))).withColumn("place", F.monotonically_increasing_id())
    top = F.max(F.struct("page_id", -F.col("place"))).alias("top")
    kept = own.where(F.octet_length("payload") >= least).groupBy("same").agg(top, F.count("*").alias("n")).where("n > 1 and top.page_id is not null")
    keeper = kept.select("same", F.col("top.page_id").alias("keeper"), (-F.col("top.col2")).alias("first"))
    other = ~F.coalesce(F.col("page_id") == F.col("keeper"), F.lit(False))
    told = F.when(F.col("keeper").isNotNull() & other, F.col("keeper")).alias("refers_to")
    return own.join(small_side(keeper), "same", "left").select("page_id", "url", "payload", told, F.coalesce(F.col("place") == F.col("first"), F.lit(False)).alias("named"))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT_CHARS, least: int = LEAST_BYTES) -> None:
    """Writes every page as WARC records to the folder ``path``."""
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    with_revisits(pages, least).mapInArrow(_spell(segment, date), "record string").write.option("lineSep", BREAK).option("compression", "gzip").text(path)


PARSED = "uid string, kind string, refers_to string, digest string, origin string, number int, total long, block binary, error string"
_KINDS = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string()]


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


class _Archive:
    """The records of one file, which comes in stretches that a blank line parted."""

    def __init__(self):
        self.fields: dict | None = None
        self.parts: list[bytes] = []
        self.size = 0

    def take(self, part: bytes) -> Iterator[tuple]:
        while True:
            if self.fields is None:
                part = part.lstrip(b"\r\n")
                if not part:
                    return
                fields = self._head(part)
                if fields is None:
                    yield self._row({}, part, "bytes outside of records")
                    return
                self.fields, self.parts, self.size = fields, [], -4
                return
            self.parts.append(part)
            self.size += 4 + len(part)
            need = int(self.fields["content-length"])
            if self.size < need:
                return
            whole = BREAK.encode().join(self.parts)
            block, rest = whole[:need], whole[need:]
            yield self._row(self.fields, block, None if not rest or rest.startswith(BREAK.encode()) else "the record's length is wrong")
            self.fields, part = None, rest
            if not rest:
                return

    def end(self) -> Iterator[tuple]:
        if self.fields is not None:
            yield self._row(self.fields, BREAK.encode().join(self.parts), "the record is cut off")
            self.fields = None

    @staticmethod
    def _head(part: bytes) -> dict | None:
        version, *lines = part.decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        return fields if version.startswith("WARC/") and (_number(fields.get("content-length")) or 0) >= 0 and "content-length" in fields else None

    @staticmethod
    def _row(fields: dict, block: bytes, error: str | None) -> tuple:
        bare = lambda k: fields.get(k, "").strip("<>") or None
        return (
            bare("warc-record-id"), fields.get("warc-type"), bare("warc-refers-to"), fields.get("warc-payload-digest"), bare("warc-segment-origin-id"),
            _number(fields.get("warc-segment-number")), _number(fields.get("warc-segment-total-length")), block, error,
        )


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from the stretches of files, which come file by file and in order."""
    names = [x.split()[0] for x in PARSED.split(", ")]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), _KINDS)], names)
    now, archive = None, _Archive()
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part, rows = batch.slice(lo, 256), []
            for path, value in zip(*(c.to_pylist() for c in part.columns)):
                if path != now:
                    rows += archive.end()
                    now, archive = path, _Archive()
                for stretch in value.split(BREAK.encode()):
                    rows += archive.take(stretch)
            yield batch_of(rows)
    yield batch_of(list(archive.end()))


def records_of(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives of a folder: ``*.gz`` in a stream (a packed file is one task), ``*.warc`` file by file in memory."""
    cut = spark.read.option("lineSep", BREAK).option("pathGlobFilter", "*.gz").text(path)
    whole = spark.read.option("pathGlobFilter", "*.warc").text(path, wholetext=True)
    cut, whole = (x.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value")) for x in (cut, whole))
    return cut.unionByName(whole).mapInArrow(_parse, PARSED)


def _decode(kind: str | None, block: bytes, error: str | None) -> tuple:
    """Payload, its length as a page has it, and what is wrong."""
    if not block.startswith(b"HTTP/"):
        return block, len(block), error
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip(): v.strip() for k, _, v in (line.lower().partition(b":") for line in head.split(b"\r\n")[1:])}
    try:
        if kind == "revisit":  # of a 304 the length may be missing
            return None, int(fields[b"content-length"]) if b"content-length" in fields else None, error
        payload = dechunk(body) if fields.get(b"transfer-encoding") == b"chunked" else body
        return payload, len(payload), error
    except (ValueError, KeyError) as wrong:
        return None, None, error or str(wrong)


MESSAGES = "page_id long, uid string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, error string"


def _page(uri: str | None) -> int | None:
    return _number(uri.removeprefix(PAGE).split(":")[0]) if uri and uri.startswith(PAGE) else None


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in MESSAGES.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            rows = []
            for r in batch.slice(lo, 64).to_pylist():
                payload, size, error = _decode(r["kind"], r["block"], r["error"])
                told = (r["digest"] or "").upper()
                told = told.removeprefix("SHA1:") if told.startswith("SHA1:") else None
                found = b32(hashlib.sha1(payload).digest()) if payload is not None else told
                differs = told is not None and found != told
                rows.append((_page(r["uid"]), r["uid"], r["kind"], _page(r["refers_to"]), payload, size, found, error or ("the digest differs" if differs else None)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per message in the archives, its segments put together and its chunks decoded."""
    records = records_of(spark, path)
    segmented = F.col("number").isNotNull() | F.col("origin").isNotNull()
    first = F.col("number") == 1
    parts = records.where(segmented).withColumn("uid", F.coalesce("origin", "uid"))
    joined = parts.groupBy("uid").agg(
        F.min(F.when(first, F.col("kind"))).alias("kind"), F.min("refers_to").alias("refers_to"), F.min(F.when(first, F.col("digest"))).alias("digest"),
        F.max("total").alias("total"), F.max("number").alias("top"), F.sum(F.when(first, 1).otherwise(0)).alias("copies"), F.min("error").alias("error"),
        F.array_sort(F.collect_set(F.struct("number", "block"))).alias("blocks"),
    )
    block = F.aggregate("blocks", F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b["block"]))
    gaps = F.when((F.col("top") != F.size("blocks")) | F.col("kind").isNull(), F.lit("segments are missing"))
    joined = joined.withColumn("block", block).withColumn("error", F.coalesce("error", gaps, F.when(F.col("total").isNull() | (F.octet_length("block") != F.col("total")), F.lit("the total length differs"))))
    fields = ["uid", "kind", "refers_to", "digest", "block", "error"]
    repeated = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))))
    return records.where(~segmented).select(fields).unionByName(repeated.select(fields)).mapInArrow(_messages, MESSAGES)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(read(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {i * 5 + 1}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
q AS (SELECT page_id, strlen(t) AS n, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to, NULL::VARCHAR AS error FROM q
"""
