"""Report tables over per-file results.

``results`` has one row per file: ``file_id, file_name, file_path, owner, mime_type,
modified_time, total_chars, findings, error``. Every table here reads it once and
aggregates or sorts; nothing is gathered on the driver. Store results first when more
than one table is wanted, or a sorted one (a sort samples its input before it reads it),
so that texts are scanned once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.operators.risk import entity_count, findings_of_results, risk_icon, with_risk

# The entity columns of the flagged-files table.
TABLE_ENTITIES = (
    "NPI", "PERSON", "PHONE_NUMBER", "EMAIL_ADDRESS", "LOCATION", "CREDIT_CARD", "US_SSN",
    "KR_RRN", "KR_PASSPORT", "KR_CARD_NUMBER", "KR_PHONE",
)
LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
SCANNER_VERSION = "1.0.0"
LOG_TITLE = ("Findings by file, highest risk first", "====================================", "")

BY_RISK = (F.desc, "risk_score"), (F.asc, "file_id")


def _by_risk() -> list[Column]:
    return [direction(name) for direction, name in BY_RISK]


def summary(results: DataFrame) -> DataFrame:
    """One row of totals: files by status, findings, flagged files by level."""
    flagged = F.col("status") == "flagged"
    return with_risk(results).agg(
        F.count("*").alias("total_files"),
        F.count_if(flagged).alias("flagged_files"),
        F.count_if(F.col("status") == "clean").alias("clean_files"),
        F.count_if(F.col("status") == "error").alias("error_files"),
        F.coalesce(F.sum(F.when(flagged, F.col("total_findings"))), F.lit(0)).alias(
            "total_pii_findings"
        ),
        *[
            F.count_if(flagged & (F.col("risk_level") == level)).alias(level.lower())
            for level in LEVELS
        ],
    )


def summary_row(results: DataFrame, folder_id: str, duration: float) -> DataFrame:
    """The 13-column summary tab."""
    return summary(results).select(
        F.date_format(
            F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd HH:mm:ss 'UTC'"
        ).alias("scan_timestamp"),
        F.lit(SCANNER_VERSION).alias("scanner_version"),
        F.lit(folder_id).alias("folder_id"),
        "total_files",
        "flagged_files",
        "clean_files",
        "error_files",
        "total_pii_findings",
        F.round(F.lit(float(duration)), 2).alias("duration_s"),
        *[level.lower() for level in LEVELS],
    )


def risk_distribution(results: DataFrame) -> DataFrame:
    """Flagged files per level, levels without files included."""
    counts = F.array(*[F.struct(F.lit(x).alias("risk_level"), F.col(x.lower()).alias("n")) for x in LEVELS])
    return summary(results).select(F.inline(counts))


def entity_totals(results: DataFrame) -> DataFrame:
    """Findings per entity over flagged files, most frequent first."""
    return (
        with_risk(results)
        .where("status = 'flagged'")
        .select(F.explode("entity_summary").alias("entity_type", "n"))
        .groupBy("entity_type")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "entity_type")
    )


def flagged_files(results: DataFrame) -> DataFrame:
    """Flagged files with their findings in text order, highest risk first."""
    in_order = F.transform(
        F.array_sort(
            F.transform(
                "findings",
                lambda f: F.struct(
                    f["start"].alias("start_index"),
                    f["entity_type"].alias("entity_type"),
                    f["end"].alias("end_index"),
                    f["confidence"].alias("confidence"),
                    f["masked_value"].alias("masked_value"),
                ),
            )
        ),
        lambda f: F.struct(
            f["entity_type"].alias("entity_type"),
            f["confidence"].alias("confidence"),
            f["masked_value"].alias("masked_value"),
            f["start_index"].alias("start_index"),
            f["end_index"].alias("end_index"),
        ),
    )
    return (
        with_risk(results)
        .where("status = 'flagged'")
        .select(
            "file_id",
            "file_name",
            "file_path",
            "mime_type",
            "modified_time",
            "risk_level",
            F.round("risk_score", 4).alias("risk_score"),
            "total_findings",
            F.col("entity_summary").alias("entity_breakdown"),
            in_order.alias("findings"),
        )
        .orderBy(*_by_risk())
    )


def flagged_table(results: DataFrame) -> DataFrame:
    """The flagged-files tab: one count column per entity, highest risk first."""
    return (
        with_risk(results)
        .where("status = 'flagged'")
        .select(
            "file_name",
            "file_path",
            "file_id",
            "mime_type",
            "risk_level",
            F.round("risk_score", 4).alias("risk_score"),
            "total_findings",
            *[entity_count(F.col("findings"), e).alias(e.lower()) for e in TABLE_ENTITIES],
            "modified_time",
        )
        .orderBy(*_by_risk())
    )


def ledger(results: DataFrame) -> DataFrame:
    """One row per finding with its file's name, path and owner."""
    return results.select(
        "file_id", "file_name", "file_path", "owner", F.explode("findings").alias("f")
    ).select("file_id", "file_name", "file_path", "owner", "f.*")


def clean_files(results: DataFrame) -> DataFrame:
    return with_risk(results).where("status = 'clean'").select("file_id", "file_name", "file_path")


def error_files(results: DataFrame) -> DataFrame:
    return (
        with_risk(results)
        .where("status = 'error'")
        .select("file_id", "file_name", "file_path", "error")
    )


def console_ranking(results: DataFrame) -> DataFrame:
    """Every file with findings, errors or not, highest risk first."""
    return (
        with_risk(results)
        .where("total_findings > 0")
        .select(
            risk_icon(F.col("risk_level")).alias("icon"),
            "risk_level",
            "file_id",
            "file_name",
            "file_path",
            "risk_score",
            "total_findings",
            "entity_summary",
        )
        .orderBy(*_by_risk())
    )


def scan_verdict(results: DataFrame) -> DataFrame:
    """2 if any file has findings, else 0."""
    found = F.coalesce(F.max(F.size("findings")), F.lit(0)) > 0
    return results.agg(F.when(found, 2).otherwise(0).alias("verdict"))


def entity_breakdown(findings: DataFrame) -> DataFrame:
    """Findings per entity over all findings."""
    return findings.groupBy("entity_type").agg(F.count("*").alias("n"))


def log_lines(results: DataFrame) -> DataFrame:
    """The findings log as lines: ``risk_score, file_id, line_no, line`` in reading order.

    The title comes first; its lines have no file and a score above all others.
    """
    line = F.transform(
        "findings",
        lambda f: F.format_string(
            "  - %-15s : %-30s (Pos: %d-%d)",
            f["entity_type"],
            f["masked_value"],
            f["start_index"],
            f["end_index"],
        ),
    )
    head = F.array(
        F.format_string("[%s] File: %s (ID: %s)", "risk_level", "file_name", "file_id"),
        F.concat(F.lit("Path: "), F.col("file_path")),
    )
    title = results.sparkSession.range(1).select(
        F.lit(2.0).alias("risk_score"),
        F.lit("").alias("file_id"),
        F.posexplode(F.array(*[F.lit(t) for t in LOG_TITLE])).alias("line_no", "line"),
    )
    lines = flagged_files(results).select(
        "risk_score", "file_id", F.posexplode(F.concat(head, line, F.array(F.lit("")))).alias("line_no", "line")
    )
    return title.unionByName(lines).orderBy(*_by_risk(), "line_no")


def document_lines(
    results: DataFrame, folder_id: str = "root", duration: float = 0.0
) -> DataFrame:
    """The JSON report as lines that read as one document in order of ``section, at``.

    Files become one line each and stay distributed; only the totals form a single row.
    """
    totals = entity_totals(results).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "entity_type", "n")))
    )
    head = summary(results).withColumn("t", totals.scalar()).select(
        F.to_json(
            F.struct(
                F.struct(
                    F.current_timestamp().alias("report_generated_at"),
                    F.lit(folder_id).alias("scan_folder_id"),
                    F.lit(SCANNER_VERSION).alias("scanner_version"),
                    F.round(F.lit(float(duration)), 2).alias("duration_seconds"),
                ).alias("metadata"),
                F.struct(
                    F.col("total_files").alias("total_files_scanned"),
                    "flagged_files",
                    "clean_files",
                    "error_files",
                    "total_pii_findings",
                    F.map_from_entries(
                        F.transform("t", lambda x: F.struct(x["entity_type"], x["n"]))
                    ).alias("entity_type_totals"),
                    F.struct(*[F.col(x.lower()).alias(x) for x in LEVELS]).alias("risk_distribution"),
                ).alias("summary"),
            )
        ).alias("json")
    )
    parts = [
        _line(head, 0, F.lit(0.0), F.lit(""), F.expr("left(json, length(json) - 1)")),
    ]
    for section, (name, rows) in enumerate(
        (
            ("flagged_files", flagged_files(results)),
            ("clean_files", clean_files(results)),
            ("errors", error_files(results)),
        ),
        start=1,
    ):
        score = F.col("risk_score") if name == "flagged_files" else F.lit(0.0)
        entry = F.to_json(F.struct(*[c for c in rows.columns]), {"ignoreNullFields": "false"})
        # A file may be listed more than once, even twice alike; equal entries share a line,
        # so that exactly one line of a section is the first.
        lines = rows.select((-score).alias("at"), "file_id", entry.alias("entry"))
        lines = lines.groupBy("at", "file_id", "entry").agg(F.count("*").cast("int").alias("n"))
        first = lines.agg(F.min(F.struct("at", "file_id", "entry")).alias("first"))
        marked = lines.join(F.broadcast(first), F.struct("at", "file_id", "entry").eqNullSafe(F.col("first")), "left")
        comma = F.when(F.col("first").isNotNull(), F.lit("")).otherwise(F.lit(","))
        text = F.concat(comma, F.array_join(F.array_repeat("entry", F.col("n")), ","))
        one = rows.sparkSession.range(1)
        parts.append(_line(one, 2 * section - 1, F.lit(0.0), F.lit(""), F.lit(f',"{name}": [')))
        parts.append(_line(marked, 2 * section, F.col("at"), F.col("file_id"), text, F.col("entry")))
        close = "]" if name != "errors" else "]}"
        parts.append(_line(one, 2 * section, F.lit(float("inf")), F.lit(""), F.lit(close)))
    return reduce(DataFrame.unionByName, parts).orderBy("section", "at", "file_id", "entry").drop("entry")


def _line(
    df: DataFrame, section: int, at: Column, file_id: Column, line: Column, entry: Column | None = None
) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), at.alias("at"), file_id.alias("file_id"), line.alias("line"),
        (F.lit("") if entry is None else entry).alias("entry"),
    )


__all__ = [
    "clean_files", "console_ranking", "document_lines", "entity_breakdown", "entity_totals",
    "error_files", "findings_of_results", "flagged_files", "flagged_table", "ledger",
    "log_lines", "risk_distribution", "scan_verdict", "summary", "summary_row",
]
