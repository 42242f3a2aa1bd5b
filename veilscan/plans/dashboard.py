"""Dashboard figures over the two state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.operators.risk import risk_level


def stats(scan_results: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: files scanned, findings, last activity."""
    files = scan_results.agg(
        F.count("*").alias("scanned_count"), F.max("last_scanned").alias("last_activity")
    )
    return files.withColumn("findings_count", findings.agg(F.count("*")).scalar())


def flagged(scan_results: DataFrame, findings: DataFrame) -> DataFrame:
    """Files with findings, whether or not they have an error; never CLEAN.

    Findings shrink to one row per file before they meet the files, and the inner join
    keeps exactly the files that have some.
    """
    per_file = (
        findings.groupBy("file_id", "entity_type")
        .agg(F.max("confidence").alias("top"), F.count("*").alias("n"))
        .groupBy("file_id")
        .agg(
            F.max("top").alias("risk_score"),
            F.sum("n").alias("total_findings"),
            F.map_from_entries(
                F.array_sort(F.collect_list(F.struct("entity_type", "n")))
            ).alias("findings"),
        )
    )
    return (
        scan_results.select("file_id", "modified_time")
        .join(per_file, "file_id")
        .withColumn("risk_level", risk_level(F.col("risk_score"), lowest="LOW"))
    )


def files_with_findings(scan_results: DataFrame, findings: DataFrame) -> DataFrame:
    """The files for which at least one finding exists."""
    return scan_results.join(findings.select("file_id"), "file_id", "left_semi")


def overview(scan_results: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: scanned, flagged, findings, CRITICAL and HIGH files, findings by entity."""
    files = flagged(scan_results, findings).agg(
        F.count("*").alias("total_flagged_files"),
        F.coalesce(F.sum("total_findings"), F.lit(0)).alias("total_pii_findings"),
        F.count_if(F.col("risk_level") == "CRITICAL").alias("critical"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high"),
    )
    kinds = findings.groupBy("entity_type").agg(F.count("*").alias("n"))
    breakdown = kinds.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))))
    return files.withColumns(
        {
            "total_files_scanned": scan_results.agg(F.count("*")).scalar(),
            "entity_breakdown": breakdown.scalar(),
        }
    )
