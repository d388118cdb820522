"""WARC writing, the normaliser of monolithic gzip archives, and reading by offset (operator 1)."""

from __future__ import annotations

import json
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pingtrail.llm.common import BATCH_BYTES, map_arrow_parts, shared_folder, stored

# Most bytes of one archive before compression, but for a single record that is larger, and most records.
ARCHIVE_BYTES = 128 << 20
RECORDS = 8192
# Records of up to so many bytes share archives; each class has as many records a file as the bytes above allow.
CLASSES = [ARCHIVE_BYTES // RECORDS << 4 * i for i in range(4)]
# Archive bytes that one task of the reader is given on average.
TASK_BYTES = 256 << 20
STEP = 1 << 18
END = "\r\n\r\n"
# The profile that the format names for revisits by payload digest, and the alphabet of base 32.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGITS, ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
GZIP = 31  # zlib's window bits for gzip members


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base-32 SHA-1: each 20 bits of the hash are four digits of base 32."""
    hashed = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hashed, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)]
    return F.translate(F.concat(*parts), DIGITS, ALPHABET)


def records(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0,
            date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Columns record, each page as a WARC record without the line ends behind it, and most_bytes, which it stays within.

    The payload is the html in UTF-8, empty if null. Of pages with equal payloads of ``least_bytes`` or more, those with the
    smallest page id are responses (null ids come last) and the others revisit it, with the HTTP head but no payload; smaller
    ones are all responses. So a page that occurs twice with the same id is a response twice. Line
    ends in an address are percent-encoded and a null address is empty. Only digests are grouped; the few
    digests of several pages are written down, so that the planner can see how small they are before it joins.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    pages = pages.select(F.col(page_id).cast("string").alias("id"), F.col(page_id).alias("number"),
                         F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("uri"),
                         payload.alias("payload"), payload_digest(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    groups = (pages.where(F.col("bytes") >= least_bytes).groupBy("digest")
              .agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"))
    joined = pages.join(stored(groups, "warc-groups"), "digest", "left")
    revisit = (F.col("bytes") >= least_bytes) & F.col("first").isNotNull() & ~F.col("number").eqNullSafe(F.col("first"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, head).otherwise(F.concat(head, "payload"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c, F.lit("null")), F.lit(">"))
    return joined.select(F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("id")), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("uri"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("first").cast("string")))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit(END), block).alias("record"),
        # heads are less than 2 KiB without the address
        (F.col("bytes") + F.octet_length("uri") + 2048).alias("most_bytes"))


def write_monolithic(warc_records: DataFrame, folder: str) -> str:
    """Write records as archives that are one gzip stream each; an empty table gives no archive.

    ``warc_records`` has the columns record and most_bytes. Spark's writer closes a file after a number of records, not of bytes.
    So records are written by classes of size, a job for each that occurs, with a number that keeps a file within
    ``ARCHIVE_BYTES``; beyond the last class a file holds one record. The classes are found from the lengths alone.
    """
    above = [F.col("most_bytes") > limit for limit in CLASSES]
    size = sum((c.cast("int") for c in above), F.lit(0))
    present = [r[0] for r in warc_records.select(size.alias("size")).distinct().collect()]  # len(CLASSES) + 1 at most
    for i in sorted(present) or [0]:
        most = ARCHIVE_BYTES // CLASSES[i] if i < len(CLASSES) else 1
        (warc_records.where(size == i).select("record").write.mode("append")
         .option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", most).text(folder))
    return folder


def inflated_records(data: bytes):
    """The records of gzip data of one or more members, inflated once from front to end in small steps.

    Each record comes with its closing line ends. Data that ends within a member or a record raises a ValueError.
    """
    stream, held, at = zlib.decompressobj(GZIP), bytearray(), 0
    while at < len(data):
        chunk = data[at:at + STEP]
        at += len(chunk)
        while chunk:
            held += stream.decompress(chunk)
            chunk = stream.unused_data
            if stream.eof:
                stream = zlib.decompressobj(GZIP) if chunk or at < len(data) else stream
        start = 0
        while (size := _record_size(held, start)) is not None and start + size <= len(held):
            yield bytes(held[start:start + size])
            start += size
        del held[:start]
    if held or (data and not stream.eof):
        raise ValueError("the archive ends within a record")


def _record_size(held: bytearray, start: int) -> int | None:
    end = held.find(END.encode(), start)
    if end < 0:
        return None
    return end - start + 2 * len(END) + int(fields(bytes(held[start:end]))["content-length"])


def fields(head: bytes) -> dict[str, str]:
    """Named fields of a record's or response's head, names in lower case."""
    pairs = (line.split(":", 1) for line in head.decode().split("\r\n")[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def member(record: bytes) -> bytes:
    """A gzip member whose last byte is zero; a record of 16 MiB or more is followed by an empty member for that."""
    coder = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    out = coder.compress(record) + coder.flush()
    return out if out[-1] == 0 else out + member(b"")


def slices(rows, names: tuple[str, ...]):
    """Rows, the last value of each being bytes, as columns in slices that end once they hold ``BATCH_BYTES`` or 1000 rows."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= BATCH_BYTES or len(held) == 1000:
            yield dict(zip(names, map(list, zip(*held, strict=True)), strict=True))
            held, size = [], 0
    if held:
        yield dict(zip(names, map(list, zip(*held, strict=True)), strict=True))


def normalise(spark: SparkSession, monolithic: str, folder: str) -> str:
    """Rewrite archives to one gzip member a record, with an index of the members' offsets beside each.

    Below ``folder`` lie ``kind=warc/archive=N`` with the members of one archive in order and ``kind=index/archive=N`` with its
    index, a gzip member that holds one JSON line a record: offset, length, record id and type. Each input file is
    inflated once, by one task, and its members leave the task in slices of bounded bytes. Spark's text writer is the only sink that takes bytes as they are; it must end
    every line with something, so each member's last byte, zero, is given to it as the line end.
    """
    files = spark.read.format("binaryFile").load(monolithic).select("path", "content")

    def make():
        def members(path: str, content: bytes):
            archive = path.rsplit("/", 1)[-1].split(".", 1)[0]
            offset, lines = 0, []
            for place, record in enumerate(inflated_records(content)):
                data = member(record)
                head = fields(record[:record.index(END.encode())])
                lines.append(json.dumps({"offset": offset, "length": len(data), "id": head["warc-record-id"], "type": head["warc-type"]}))
                yield "warc", archive, place, data[:-1]
                offset += len(data)
            yield "index", archive, 0, member("\n".join(lines).encode())[:-1]

        def work(batch: pa.RecordBatch):
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from slices(members(path, content.as_buffer().to_pybytes()), ("kind", "archive", "place", "bytes"))

        return work

    rows = map_arrow_parts(files, make, "kind string, archive string, place long, bytes binary")
    (rows.sortWithinPartitions("kind", "archive", "place").select("kind", "archive", F.col("bytes").cast("string").alias("value"))
     .write.partitionBy("kind", "archive").option("lineSep", "\0").text(folder))
    return folder


def read_by_index(spark: SparkSession, folder: str) -> DataFrame:
    """The records of normalised archives, each inflated by itself at its offset in the index.

    Columns: record_id, record_type, refers_to, uri, payload_digest, payload_bytes (of the full payload, also for revisits), payload.
    An archive meets its index in one task; the number of tasks grows with the bytes of all archives, and records leave a task
    in slices of bounded bytes.
    """
    schema = ("record_id string, record_type string, refers_to string, uri string, payload_digest string, "
              "payload_bytes long, payload binary")
    files = spark.read.format("binaryFile").load(folder)
    if "kind" not in files.columns:  # no archive at all
        return spark.createDataFrame([], schema)
    content = files.where("kind = 'warc'").select("archive", "content")
    index = files.where("kind = 'index'").select("archive", F.col("content").alias("index"))
    total = files.where("kind = 'warc'").agg(F.sum("length")).first()[0] or 0  # lengths only: contents are not read for it
    tasks = -(-total // TASK_BYTES)
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        content, index = content.repartition(tasks, "archive"), index.repartition(tasks, "archive")

    def make():
        def inflated(data: memoryview, lines: bytes):
            for line in zlib.decompress(lines, GZIP).decode().splitlines():
                at = json.loads(line)
                record = zlib.decompressobj(GZIP).decompress(data[at["offset"]:at["offset"] + at["length"]])
                head, rest = record[:-len(END)].split(END.encode(), 1)
                http, payload = rest.split(END.encode(), 1)
                named, inner = fields(head), fields(http)
                yield (named["warc-record-id"], named["warc-type"], named.get("warc-refers-to"), named["warc-target-uri"],
                       named["warc-payload-digest"], int(inner["content-length"]), payload)

        def work(batch: pa.RecordBatch):
            names = ("record_id", "record_type", "refers_to", "uri", "payload_digest", "payload_bytes", "payload")
            for data, lines in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                yield from slices(inflated(memoryview(data.as_buffer()), lines), names)

        return work

    return map_arrow_parts(content.join(index, "archive").select("content", "index"), make, schema)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write pages to monolithic archives, normalise these and read the result back by its index."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write_monolithic(records(pages, **options), f"{folder}/monolithic")
    normalise(spark, f"{folder}/monolithic", f"{folder}/members")
    return read_by_index(spark, f"{folder}/members")


def number_of(name: str) -> Column:
    """The id in a record name, null for that of a null id."""
    return F.regexp_extract(name, "^<urn:page:(.*)>$", 1).try_cast("long")
