"""Scan state: an append-only log of per-file results, newest entry wins.

A batch is written to a folder with a fresh name, which nobody reads yet. It becomes visible by one small commit
file, put in place by a rename once the data is complete: a write that fails leaves all that was there before. A commit
names its folder and has a number one above all that its writer saw; of two writers that took the same
number at the same time, the commit's own name decides, for every reader alike. A batch that is
written again is replaced in its place in the sequence, so a replay changes nothing. Replacing
a file's results needs no rewrite either: its newer entry hides the older one together
with the older findings.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.operators.resume import newest
from veilscan.operators.risk import findings_of_results, has_error
from veilscan.sources.cache import FINDINGS_TYPE

RESULTS_SCHEMA = (
    "file_id string, file_name string, file_path string, owner string, mime_type string, "
    f"modified_time string, total_chars int, findings {FINDINGS_TYPE}, error string, "
    "last_scanned timestamp"
)


COMMITS_SCHEMA = "stream string, batch_id bigint, number bigint, commit string"
FIGURES_SCHEMA = "file_id string, error string, n_findings int, last_scanned timestamp, commit string"
TOTALS_SCHEMA = "covers string, files_done bigint, error_files bigint, total_findings bigint, last_activity bigint"


def sums() -> list[Column]:
    return [
        F.count("*").alias("files_done"),
        F.count_if(has_error(F.col("error"))).alias("error_files"),
        F.coalesce(F.sum("n_findings"), F.lit(0)).alias("total_findings"),
        F.max(F.unix_micros("last_scanned")).alias("last_activity"),
    ]


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Small files of one line each; names that begin with ``_`` are not read."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class ScanState:
    """The state kept below ``path``."""

    spark: SparkSession
    path: str

    @property
    def _log(self) -> str:
        return f"{self.path.rstrip('/')}/results"

    @property
    def _totals(self) -> str:
        return f"{self.path.rstrip('/')}/totals"

    @property
    def _commits(self) -> str:
        return f"{self.path.rstrip('/')}/commits"

    def write_batch(self, results: DataFrame, batch_id: int, stream: str = "main") -> None:
        """Store one batch of results (one row per file) of one stream."""
        commit = f"c{uuid.uuid4().hex}"
        schema = self.spark.createDataFrame([], RESULTS_SCHEMA).schema
        rows = results
        if "last_scanned" not in rows.columns:
            rows = rows.withColumn("last_scanned", F.current_timestamp())
        rows.select(
            *[
                (F.col(f.name) if f.name in rows.columns else F.lit(None))
                .cast(f.dataType)
                .alias(f.name)
                for f in schema
            ]
        ).withColumn("n_findings", F.coalesce(F.size("findings"), F.lit(0))).write.parquet(f"{self._log}/commit={commit}")
        last = read_json(self.spark, self._commits, COMMITS_SCHEMA).agg(F.max("number")).first()[0]
        self._put(self._commits, commit, {"stream": stream, "batch_id": batch_id, "number": (last or 0) + 1, "commit": commit})

    def _put(self, folder: str, name: str, entry: dict) -> None:
        """Write a small file under a name that readers skip, then rename it: it is there whole or not at all."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        hidden, name = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}{name}.json") for x in ("_", ""))
        files = name.getFileSystem(conf)
        out = files.create(hidden, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if not files.rename(hidden, name):
            raise OSError(f"could not commit {name}")

    def batches(self) -> DataFrame:
        """What is visible, a row per batch: ``stream, batch_id, commit`` (its folder), ``seq`` (its place, as text)."""
        place = F.struct("number", "commit")
        every = read_json(self.spark, self._commits, COMMITS_SCHEMA).groupBy("stream", "batch_id")
        # A replayed batch keeps the place of its first commit.
        first = F.min(place).alias("first")
        rows = every.agg(first, F.max(place)["commit"].alias("commit"))
        return rows.select("stream", "batch_id", "commit", F.format_string("%019d-%s", "first.number", "first.commit").alias("seq"))

    def log(self, before: int | None = None, stream: str = "main") -> DataFrame:
        """All entries; with ``before`` those that a batch of ``stream`` finds: not its own
        and later ones of the same stream."""
        visible = self.batches()
        if before is not None:
            visible = visible.where((F.col("stream") != stream) | (F.col("batch_id") < before))
        rows = read_table(self.spark, self._log, RESULTS_SCHEMA + ", commit string")
        return rows.join(visible, "commit").drop("commit")

    def results(self, before: int | None = None, stream: str = "main") -> DataFrame:
        """Newest results per file, optionally as they were before a batch."""
        return newest(self.log(before, stream), ["file_id"], F.col("seq")).drop("seq", "stream", "batch_id")

    def versions(self, before: int | None = None, stream: str = "main") -> DataFrame:
        """Newest ``file_id, modified_time`` only; reads three columns of the log."""
        rows = self.log(before, stream).select("file_id", "modified_time", "seq")
        return newest(rows, ["file_id"], F.col("seq")).drop("seq")

    def _figures(self, commits: DataFrame) -> DataFrame:
        """Newest figures per file among some batches (``commit, seq``); no findings are read."""
        rows = read_table(self.spark, self._log, FIGURES_SCHEMA).join(commits, "commit").drop("commit")
        return newest(rows, ["file_id"], F.col("seq")).drop("seq")

    def totals(self) -> DataFrame:
        """One row of figures over the newest results: files, errors, findings, last activity.

        Totals are kept with the list of batches that they cover, as a digest. The longest run of first batches
        with kept totals is taken as it is, and only what came later is added: the later batches' figures, less
        those of the same files before. A batch that was replayed or put in between changes the digests from its
        place on, so that what follows it is added anew. Batches are listed by the driver, one line each.
        """
        batches = self.batches().select("commit", "seq")
        order = [tuple(r) for r in batches.orderBy("seq").collect()]
        if not order:
            return self._figures(batches).agg(*sums()).withColumn("last_activity", F.timestamp_micros("last_activity"))
        digests = [digest := hashlib.sha256(b"").hexdigest()]
        for commit, _ in order:
            digests.append(digest := hashlib.sha256(f"{digest}{commit}".encode()).hexdigest())
        kept = {r.covers: r for r in read_json(self.spark, self._totals, TOTALS_SCHEMA).where(F.col("covers").isin(digests)).collect()}
        done = next((n for n in range(len(order), 0, -1) if digests[n] in kept), 0)
        if done == len(order):
            return self._kept(digests[done])
        seq = order[done][1]
        new = self._figures(batches.where(F.col("seq") >= seq))
        old = self._figures(batches.where(F.col("seq") < seq)).join(new.select("file_id"), "file_id", "left_semi")
        added, gone = new.agg(*sums()).first(), old.agg(*sums()).first()
        before = kept.get(digests[done])
        counts = {c: (before[c] if before else 0) + added[c] - gone[c] for c in ("files_done", "error_files", "total_findings")}
        last = max((x for x in (before and before.last_activity, added.last_activity) if x is not None), default=None)
        if before and gone.last_activity is not None and gone.last_activity == before.last_activity and last != added.last_activity:
            last = self._figures(batches).agg(*sums()).first().last_activity  # the file last done was done again, with an older time
        self._put(self._totals, f"t{uuid.uuid4().hex}", {"covers": digests[-1], **counts, "last_activity": last})
        return self._kept(digests[-1])

    def _kept(self, digest: str) -> DataFrame:
        rows = read_json(self.spark, self._totals, TOTALS_SCHEMA).where(F.col("covers") == digest).drop("covers").distinct()
        return rows.withColumn("last_activity", F.timestamp_micros("last_activity"))

    def findings(self) -> DataFrame:
        return findings_of_results(self.results())

    def compact(self, path: str) -> ScanState:
        """Copy the newest entries to a new place; switch to it once this returns."""
        compacted = ScanState(self.spark, path)
        compacted.write_batch(self.results(), 0, "compacted")
        return compacted
