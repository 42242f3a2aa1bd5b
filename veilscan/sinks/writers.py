"""Writing reports and tables."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.operators.risk import findings_of_results
from veilscan.plans import report
from veilscan.sources.workspace import save_table


def report_name(now: datetime | None = None) -> str:
    return f"scan_report_{(now or datetime.now(UTC)):%Y%m%d_%H%M%S}"


def write_json_report(
    results: DataFrame, folder: str, folder_id: str = "root", duration: float = 0.0
) -> str:
    """The report document as text parts; in name order they form one JSON document."""
    path = f"{folder}/{report_name()}.json"
    results = save_table(results, "results")  # read several times below
    report.document_lines(results, folder_id, duration).select("line").write.text(path)
    return path


def write_findings_log(results: DataFrame, folder: str) -> str:
    path = f"{folder}/{report_name()}.txt"
    results = save_table(results, "results")  # a sort samples its input first
    report.log_lines(results).select("line").write.text(path)
    return path


def write_tables(
    results: DataFrame, folder: str, folder_id: str = "root", duration: float = 0.0
) -> None:
    """Summary, flagged files and ledger, replacing those of the last run."""
    results = save_table(results, "results")  # read several times below
    for name, table in (
        ("summary", report.summary_row(results, folder_id, duration)),
        ("flagged_files", report.flagged_table(results)),
        ("all_findings", report.ledger(results)),
    ):
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_state_tables(results: DataFrame, folder: str) -> None:
    """The two normalised state tables."""
    results = save_table(results, "results")  # read twice below
    results.select(
        "file_id", "modified_time", "total_chars", "error", "last_scanned"
    ).write.mode("overwrite").parquet(f"{folder}/scan_results")
    findings_of_results(results).select(
        "file_id",
        "entity_type",
        "confidence",
        "masked_value",
        F.col("start").alias("start_index"),
        F.col("end").alias("end_index"),
    ).write.mode("overwrite").parquet(f"{folder}/findings")
