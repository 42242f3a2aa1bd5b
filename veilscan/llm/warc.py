"""WARC archives: written as whole-file gzip streams, normalised to one gzip member per record.

``write_monoliths`` lets Spark's text sink write each partition as one gzip stream of WARC records.
``normalise`` takes such files of any size: Spark inflates each file once, as a stream of lines, a parser
puts the records together by their lengths, every record becomes a gzip member of its own in a new archive,
and a side table gets its file, offset and length. Memory holds one record and one batch of lines.
``read_records`` reads records by that table, each with one seek.

Archives are written with pyarrow's file systems (local, S3, GCS, HDFS) below the shared folder. A task
writes under a fresh name and only names of tasks that succeeded get into the side table, so repeated or
lost attempts leave unused files at most.

Equal payloads of ``MIN_REVISIT`` bytes or more are stored once: in the record with the largest page_id;
the others are revisits that refer to it. Rows that repeat that page_id are all responses; a null page_id
counts as smallest. A page without html has an empty payload.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm.common import shared_folder, small_batches

MIN_REVISIT = 1_000
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, record_type string, record_id string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def decided(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, bytes, digest, same`` with, for copies, the page that ``same`` names."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    ).select(
        "page_id",
        "url",
        F.col("payload").cast("string").alias("html"),
        F.octet_length("payload").cast("long").alias("bytes"),
        F.sha1("payload").alias("digest"),
        F.sha2("payload", 256).alias("key"),
    )
    copies = rows.where(F.col("bytes") >= MIN_REVISIT).groupBy("key").agg(F.max("page_id").alias("same"), F.count("*").alias("n"))
    # The side of the copies has one row per repeated payload; a hot payload's pages are split by AQE.
    return rows.join(copies.where("n > 1").select("key", "same"), "key", "left").drop("key")


def record_text(date: str) -> Column:
    """One WARC record without the two line ends after it."""
    is_revisit = F.col("same").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("same"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END)
    )
    block = F.concat(http, F.when(is_revisit, F.lit("")).otherwise(F.col("html")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("urn:unknown")), r"[\r\n]+", " ")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(is_revisit, F.concat(line("WARC-Refers-To", name(F.col("same"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_monoliths(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z") -> None:
    rows = decided(pages).select(record_text(date).alias("value"))
    rows.write.option("lineSep", END).option("compression", "gzip").text(path)


class Records:
    """Cuts a stream of bytes into records by their Content-Length."""

    def __init__(self):
        self.data, self.need = bytearray(), None

    def feed(self, more: bytes) -> Iterator[tuple[bytes, bytes]]:
        """(header with its blank line, block) of each record that is now whole."""
        self.data += more
        at = 0
        while True:
            if self.need is None:
                while self.data[at : at + 1] in (b"\r", b"\n"):
                    at += 1
                end = self.data.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                self.head = end + 4 - at
                self.need = self.head + int(fields(bytes(self.data[at:end])).get("content-length", 0))
            if len(self.data) - at < self.need:
                break
            whole = bytes(self.data[at : at + self.need])
            at += self.need
            self.need = None
            yield whole[: self.head], whole[self.head :]
        del self.data[:at]

    def rest(self) -> bytes:
        """What is left of a record that was cut off."""
        return bytes(self.data).strip(b"\r\n")


def fields(header: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first line is left out."""
    lines = header.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, colon, v in (line.partition(":") for line in lines) if colon}


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class Archive:
    """A new archive of one member per record."""

    def __init__(self, folder: str):
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        self.out, self.offset = system.open_output_stream(f"{path}/{self.name}", compression=None), 0

    def add(self, header: bytes, block: bytes, damaged: bool = False) -> tuple:
        data = member(header + block + b"\r\n\r\n")
        self.out.write(data)
        offset, self.offset = self.offset, self.offset + len(data)
        own = fields(header)
        kind = "damaged" if damaged else own.get("warc-type", "")
        return self.name, offset, len(data), kind, own.get("warc-record-id", "")


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite all archives below ``source`` to ``target`` and return the side table.

    A record that is cut off by the end of its file is kept as it is, in a member of its own, with
    record type ``damaged``.
    """
    small_batches(spark)
    lines = spark.read.option("lineSep", "\n").text(source)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    names = [c.split()[0] for c in INDEX.split(", ")]
    folder = f"{target}/archives"

    def run(batches):
        file, records, archive = None, None, None

        def closed() -> list[tuple]:
            rows = [archive.add(b"", records.rest(), True)] if records.rest() else []
            archive.out.close()
            return rows

        for batch in batches:
            rows = []
            files = batch.column(0).to_pylist()
            data = batch.column(1).to_pylist()
            at = 0
            while at < len(files):  # the lines of a file follow each other
                end = at + next((i for i, f in enumerate(files[at:]) if f != files[at]), len(files) - at)
                if files[at] != file:
                    rows += closed() if archive else []
                    file, records, archive = files[at], Records(), Archive(folder)
                rows += [archive.add(*r) for r in records.feed(b"\n".join(data[at:end]) + b"\n")]
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names) if rows else pa.RecordBatch.from_pylist([], EMPTY)
        if archive and (rows := closed()):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    lines.mapInArrow(run, INDEX).write.parquet(f"{target}/index")
    return spark.read.schema(INDEX).parquet(f"{target}/index")


EMPTY = pa.schema(
    [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string())]
)


def page_number(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def parsed(data: bytes) -> tuple:
    """One record as (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    whole = zlib.decompressobj(31).decompress(data)
    header, _, block = whole.partition(b"\r\n\r\n")
    own = fields(header)
    http, _, payload = block[: int(own["content-length"])].partition(b"\r\n\r\n")
    if own["warc-type"] == "revisit":
        size, digest = int(fields(http)["content-length"]), own["warc-payload-digest"].removeprefix("sha1:")
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return page_number(own["warc-record-id"]), size, digest, own["warc-type"], page_number(own.get("warc-refers-to"))


def read_records(index: DataFrame, target: str) -> DataFrame:
    """The records of a side table, damaged ones left out, read by offset."""
    folder = f"{target}/archives"
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        system, path = file_system(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["file"] != name:
                    name, file = row["file"], system.open_input_file(f"{path}/{row['file']}")
                rows.append(parsed(file.read_at(row["length"], row["offset"])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds) if rows else pa.RecordBatch.from_pylist([], kinds)

    wanted = index.where("record_type <> 'damaged'").select("file", "offset", "length")
    return wanted.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, normalise the archives, and return what the records say."""
    spark = pages.sparkSession
    path = shared_folder(spark)
    write_monoliths(pages, f"{path}/monoliths")
    return read_records(normalise(spark, f"{path}/monoliths", path), path)


ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
     g AS (SELECT d, n, max(page_id) AS same FROM p GROUP BY d, n)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> same THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> same THEN same END AS refers_to
FROM p JOIN g USING (d, n)
"""
