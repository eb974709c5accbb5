"""WARC archives: written by Spark's text writer, read back by a salvage reader.

An archive is a chain of gzip members, one record each, so damage stays inside
a member. The writer packs the records of a task into archives of bounded size
and hands each as one row to Spark's text writer (one row a file), so archives
go to any file system Spark can write. The reader takes each archive whole,
checks every record, and after a failed check looks for the next member or
version line that passes all checks; what lies between is logged as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.common import arrow_limits, checked_broadcast, fresh, written
from symloom.session import new_folder

LEAST = 1000  # bytes from which equal payloads are stored once
ARCHIVE = 32 << 20  # bytes of an archive; a larger record gets one of its own
PIECE = 1 << 14  # bytes of an archive that are unpacked at once
DATE = "2020-01-01T00:00:00Z"
# Fixed values of the WARC format, version 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = zlib.compress(b"", 1, 31)

VERSION = re.compile(rb"WARC/1\.[01]\r\n")
LINE = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*([^\r\n]*(?:\r\n[ \t]+[^\r\n]*)*)\r\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
RECORDS = ("archive string, start long, stop long, problem string, record_type string, record_id string, target_uri string, "
           "refers_to_id string, fields map<string,string>, payload_bytes long, payload_digest string, payload binary")
ARROW = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("problem", pa.string()),
                   ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
                   ("refers_to_id", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()),
                   ("payload_digest", pa.string()), ("payload", pa.binary())])


class Record(NamedTuple):
    """A record that passed all checks; ``payload`` is None where the record holds none (revisits)."""

    fields: dict[str, str]
    payload: bytes | None
    payload_bytes: int
    payload_digest: str | None


class Damaged(Exception):
    """A check that failed; the text names it."""


# Writing

def record_bytes(kind: str, record_id: str, uri: str, payload: bytes, size: int, digest: str, fields: dict[str, str]) -> bytes:
    """One record. A revisit keeps the HTTP header of the full payload and its digest, but no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block += payload
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE, "WARC-Target-URI": uri, **fields,
             "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{hashlib.sha1(block).hexdigest()}",
             "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in lines.items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def clean_uri(uri: bytes | None, otherwise: str) -> str:
    """The URI with blanks, control and broken bytes percent-encoded, so it cannot end its header line."""
    if not uri:
        return otherwise
    return re.sub(rb"[\x00-\x20\x7f-\xff<>]", lambda m: b"%%%02X" % m[0][0], uri).decode()


def page_record(page_id: int | None, uri: bytes | None, payload: bytes, size: int, digest: str, revisits: bool, refers: int | None) -> bytes:
    name = f"urn:page:{'' if page_id is None else page_id}"
    fields = {} if page_id is None else {"X-Page-Id": str(page_id)}
    if not revisits:
        return record_bytes("response", f"{name}:{digest}", clean_uri(uri, name), payload, size, digest, fields)
    fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{'' if refers is None else refers}:{digest}>"}
    return record_bytes("revisit", f"urn:uuid:{uuid.uuid4()}", clean_uri(uri, name), b"", size, digest, fields)


def _packed(limit: int, compressed: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = bytearray()

        def closed() -> pa.RecordBatch:
            # The text writer ends the row with its separator, which is the last byte of the archive.
            if compressed and archive[-1]:
                archive.extend(EMPTY_MEMBER)
            return pa.RecordBatch.from_arrays([pa.array([bytes(archive[:-1])], pa.binary())], ["value"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record = page_record(*row)
                record = zlib.compress(record, 1, 31) if compressed else record
                if archive and len(archive) + len(record) > limit:
                    yield closed()
                    archive.clear()
                archive += record
        if archive:
            yield closed()

    return pack


def stored_once(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows to write: page_id, url, payload (none for revisits), payload_bytes, digest, revisits, refers.

    Equal payloads (SHA-1, length and a second hash) of ``least`` bytes or more
    are counted with map-side sums, and only those that repeat are joined back;
    hot ones are sent out while they are few, else Spark splits them by size.
    Of rows that share id and payload one is the response; they are told apart
    by counts, since nothing else tells them apart.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("binary").alias("url"),
                        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = (rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload")))
    key = ["digest", "payload_bytes", "check"]
    rows = rows.withColumn("check", F.when(F.col("payload_bytes") >= least, F.xxhash64("payload")))
    # Rows below the bound have no key, and null keys meet nothing.
    ids = rows.where("check IS NOT NULL").groupBy(*key, "page_id").agg(F.count("*").alias("same"))
    groups = (ids.groupBy(*key).agg(F.max(F.struct("page_id", "same")).alias("top"), F.sum("same").alias("n")).where("n > 1")
              .select(*key, F.col("top.page_id").alias("refers"), F.col("top.same").alias("same")))
    groups = written(groups, "warc-groups")
    joined = rows.join(checked_broadcast(groups, 128), key, "left")
    top = F.col("page_id").eqNullSafe(F.col("refers"))
    out = joined.withColumn("revisits", F.col("same").isNotNull() & ~top)
    tied = F.coalesce((F.col("same") > 1) & top, F.lit(False))
    columns = ["page_id", "url", "payload", "payload_bytes", "digest", "revisits", "refers"]
    single = out.where(~tied)
    if groups.where("same > 1").isEmpty():
        return single.select(*columns)
    ties = out.where(tied)
    by = ["page_id", *key, "refers"]
    response = ties.groupBy(*by).agg(F.min(F.struct(F.coalesce("url", F.lit(b"")).alias("url"), "payload")).alias("x"))
    again = (ties.groupBy(*by, F.coalesce("url", F.lit(b"")).alias("url")).agg(F.count("*").alias("n"))
             .join(response.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("x.url").alias("_url")),
                   [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]))
    again = again.withColumn("n", (F.col("n") - (F.col("url") == F.col("_url")).cast("int")).cast("int")).where("n > 0")
    again = again.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return (single.select(*columns)
            .unionByName(response.select("page_id", F.col("x.url").alias("url"), F.col("x.payload").alias("payload"), "payload_bytes",
                                         "digest", F.lit(False).alias("revisits"), "refers"))
            .unionByName(again.select("page_id", "url", F.lit(b"").alias("payload"), "payload_bytes", "digest",
                                      F.lit(True).alias("revisits"), "refers")))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, limit: int = ARCHIVE, compressed: bool = True) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) to archives in ``folder``.

    Null html: an empty payload. Null or empty url: the page's own name as URI.
    Null id: a record without a page id, below every id. Rows that repeat an id
    are records of their own. Empty table: no archive. Other columns are not
    looked at. No text is shuffled.
    """
    rows = stored_once(pages, least).withColumn("payload", F.when(F.col("revisits"), F.lit(b"")).otherwise(F.col("payload")))
    with arrow_limits(pages.sparkSession, 2000, 8):
        (rows.mapInArrow(_packed(limit, compressed), "value binary").select(F.col("value").cast("string").alias("value"))
         .write.option("lineSep", "\0" if compressed else "\n").option("maxRecordsPerFile", 1).text(folder))


# Reading

def _digest_fits(text: str, data: bytes) -> bool:
    """Whether a digest field agrees; digests other than SHA-1 are not judged."""
    name, _, value = text.partition(":")
    if name.lower().replace("-", "") != "sha1":
        return True
    found = hashlib.sha1(data)
    return value.lower() == found.hexdigest() or value.upper() == base64.b32encode(found.digest()).decode()


def read_record(data: bytes, at: int) -> tuple[int, Record]:
    """The record at ``at`` and where it ends, or Damaged with the check that failed."""
    version = VERSION.match(data, at)
    if not version:
        raise Damaged("version")
    fields, place = {}, version.end()
    while line := LINE.match(data, place):
        fields.setdefault(line[1].decode("latin-1").lower(), re.sub(r"\r\n[ \t]+", " ", line[2].decode("utf-8", "replace")).strip())
        place = line.end()
    if data[place:place + 2] != b"\r\n" or not {"warc-type", "warc-record-id", "warc-date"} <= fields.keys():
        raise Damaged("header")
    if not re.fullmatch("[0-9]{1,18}", fields.get("content-length", "")):
        raise Damaged("length")
    place += 2
    stop = place + int(fields["content-length"])
    if stop + 4 > len(data):
        raise Damaged("truncated")
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise Damaged("trailer")
    block = data[place:stop]
    if not _digest_fits(fields.get("warc-block-digest", ""), block):
        raise Damaged("block digest")
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        head, blank, payload = block.partition(b"\r\n\r\n")
        if not blank:
            raise Damaged("http header")
        said = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", head)
        size = int(said[1]) if said else len(payload)
    digest = fields.get("warc-payload-digest", "")
    if fields["warc-type"] == "revisit":
        return stop + 4, Record(fields, None, size, digest.partition(":")[2] or None)
    if not _digest_fits(digest, payload):
        raise Damaged("payload digest")
    return stop + 4, Record(fields, payload, len(payload), hashlib.sha1(payload).hexdigest())


def _read_member(data: bytes, at: int) -> tuple[int, bytes]:
    """Content of the gzip member at ``at`` and where it ends; its checksum and length are checked."""
    # What lies behind the end is copied by the library, so the archive is fed in pieces.
    member, parts, rest = zlib.decompressobj(31), [], memoryview(data)
    try:
        while not member.eof and at < len(data):
            parts.append(member.decompress(rest[at:at + PIECE]))
            at += PIECE
    except zlib.error:
        raise Damaged("member") from None
    if not member.eof:
        raise Damaged("truncated member")
    return min(at, len(data)) - len(member.unused_data), b"".join(parts)


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, Record | None]]:
    """(start, stop, problem, record) over all bytes of an archive, in order.

    A record has no problem; a gap has no record and names the first check that
    failed in it. After a failed check the next member or version line that
    passes every check is looked for, one byte behind the place that failed, so
    a wrong length cannot hide later records. Records inside a member carry the
    member's place. Every byte lies in a record's range or in a gap.
    """
    at = 0
    gap, problem = None, None
    while at < len(data):
        found: list[tuple[int, int, str | None, Record | None]] = []
        try:
            if data[at:at + 3] == b"\x1f\x8b\x08":
                stop, content = _read_member(data, at)
                inner = list(salvage(content))
                if gap is not None and not any(r for *_, r in inner):
                    raise Damaged("no record in the member")  # after damage, only a member with a record is trusted
                found = [(at, stop, p and f"in member: {p}", r) for _, _, p, r in inner]
            else:
                stop, record = read_record(data, at)
                found = [(at, stop, None, record)]
        except Damaged as failed:
            if gap is None:
                gap, problem = at, str(failed)
            following = START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield gap, at, problem, None
            gap = None
        yield from found
        at = stop
    if gap is not None:
        yield gap, len(data), problem, None


def _salvaged(payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                rows, held = [], 0
                for start, stop, problem, r in salvage(data.as_py()):
                    f = r.fields if r else {}
                    kept = r.payload if r and payloads else None
                    rows.append((path.as_py(), start, stop, problem, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-target-uri"),
                                 f.get("warc-refers-to"), list(f.items()), r and r.payload_bytes, r and r.payload_digest, kept))
                    held += len(kept or b"")
                    if held > 8 << 20 or len(rows) == 4000:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return read


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records and gaps of the archives in ``folder``, plain or gzip, written to a table.

    Columns: ``RECORDS``. ``problem`` is null for records; a gap has its range
    of bytes, the check that failed, and nulls else. An archive passes a task
    whole, so it has to be below Spark's 2 GB for a binary value. Empty
    archives have no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")
    with arrow_limits(spark, 1, 64):
        return written(files.where("length(content) > 0").mapInArrow(_salvaged(payloads), RECORDS), "warc-records")


def quarantined(records: DataFrame) -> DataFrame:
    """The gaps: archive, start, stop, problem."""
    return records.where("problem IS NOT NULL").select("archive", "start", "stop", "problem")


def archived_pages(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write ``pages`` to archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri.

    See ``write_archives`` for nulls, ties, repeated rows and other columns. An
    empty table has no archive and gives an empty result.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc-archives")
    write_archives(pages, folder, least)
    records = read_archives(spark, folder, payloads=False).where("problem IS NULL")
    page = F.expr("try_cast(fields['x-page-id'] AS BIGINT)")
    refers = F.expr("try_cast(split_part(refers_to_id, ':', 3) AS BIGINT)")
    return records.select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to"), "target_uri")


ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to
FROM (SELECT *, payload_bytes >= {LEAST} AND page_id < top AS again FROM g)
"""
