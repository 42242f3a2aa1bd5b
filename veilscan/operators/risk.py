"""Risk figures per file: score, level, counts per entity and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lowest score of each level, best first, and the icon shown for it.
RISK_LEVELS: tuple[tuple[str, float], ...] = (("CRITICAL", 0.85), ("HIGH", 0.70), ("MEDIUM", 0.50))
RISK_ICONS = {"CRITICAL": "!!!", "HIGH": "!! ", "MEDIUM": "!  ", "LOW": ".  ", "CLEAN": "OK "}


def risk_level(score: Column, lowest: str = "CLEAN") -> Column:
    """Level of a score. ``lowest`` names files without findings."""
    ladder = F
    for level, floor in RISK_LEVELS:
        ladder = ladder.when(score >= F.lit(floor), level)
    return ladder.when(score > F.lit(0.0), "LOW").otherwise(lowest)


def risk_icon(level: Column) -> Column:
    icons = F.create_map(*[F.lit(x) for pair in RISK_ICONS.items() for x in pair])
    return F.coalesce(F.try_element_at(icons, level), F.lit(""))


def risk_score(findings: Column) -> Column:
    """Highest confidence among the findings of one file; 0.0 without any."""
    return F.coalesce(F.array_max(F.transform(findings, lambda f: f["confidence"])), F.lit(0.0))


def entity_summary(findings: Column) -> Column:
    """Findings per entity as a map with sorted keys."""
    types = F.transform(findings, lambda f: f["entity_type"])
    return F.map_from_entries(
        F.transform(
            F.array_sort(F.array_distinct(types)),
            lambda t: F.struct(t, F.size(F.filter(types, lambda x: x == t))),
        )
    )


def entity_count(findings: Column, entity: str) -> Column:
    return F.size(F.filter(findings, lambda f: f["entity_type"] == F.lit(entity)))


def has_error(error: Column) -> Column:
    """An empty message is no error."""
    return F.coalesce(F.length(error) > 0, F.lit(False))


def with_risk(results: DataFrame) -> DataFrame:
    """Add ``risk_score, risk_level, total_findings, entity_summary, status`` per file.

    Needs ``findings`` (array) and ``error``. All figures come from the file's own row.
    """
    findings = F.col("findings")
    return (
        results.withColumns(
            {
                "risk_score": risk_score(findings),
                "total_findings": F.size(findings),
                "entity_summary": entity_summary(findings),
            }
        )
        .withColumn("risk_level", risk_level(F.col("risk_score")))
        .withColumn(
            "status",
            F.when(has_error(F.col("error")), "error")
            .when(F.col("total_findings") > 0, "flagged")
            .otherwise("clean"),
        )
    )


def findings_of_results(results: DataFrame) -> DataFrame:
    """The findings of per-file results as a table, one row per finding."""
    return results.select("file_id", F.explode("findings").alias("f")).select("file_id", "f.*")


def file_risk(findings: DataFrame) -> DataFrame:
    """Score, level and count per file from a findings table."""
    return (
        findings.groupBy("file_id")
        .agg(F.max("confidence").alias("risk_score"), F.count("*").alias("total_findings"))
        .withColumn("risk_level", risk_level(F.col("risk_score")))
    )


def entity_counts(findings: DataFrame) -> DataFrame:
    """Findings per file and entity."""
    return findings.groupBy("file_id", "entity_type").agg(F.count("*").alias("n"))
