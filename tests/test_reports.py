import json

import pytest
from pyspark.sql import functions as F

from veilscan.operators import risk
from veilscan.plans import dashboard, report
from veilscan.sinks import writers
from veilscan.sources.state import RESULTS_SCHEMA


def finding(kind, confidence, start):
    return (kind, confidence, start, start + 9, "a*******b")


@pytest.fixture(scope="module")
def results(spark):
    def row(file_id, findings, error=None):
        return (file_id, f"{file_id}.txt", f"/x/{file_id}.txt", "o@x", "text/plain", "t", 10, findings, error, None)

    rows = [
        row("crit", [finding("NPI", 0.85, 30), finding("KR_PASSPORT", 0.45, 3), finding("NPI", 0.98, 60)]),
        row("high", [finding("KR_PHONE", 0.7, 1)]),
        row("med", [finding("PHONE_NUMBER", 0.5, 1)]),
        row("low", [finding("KR_RRN_WEAK", 0.35, 1)]),
        row("clean", []),
        row("empty_error", [finding("US_SSN", 0.65, 1)], ""),
        row("failed", [], "boom \"quoted\""),
        row("failed_with", [finding("NPI", 0.9, 1)], "late"),
    ]
    return spark.createDataFrame(rows, RESULTS_SCHEMA)


def test_status_and_levels(results):
    got = {r.file_id: (r.status, r.risk_level, r.risk_score) for r in risk.with_risk(results).collect()}
    assert got == {
        "crit": ("flagged", "CRITICAL", 0.98), "high": ("flagged", "HIGH", 0.7), "med": ("flagged", "MEDIUM", 0.5),
        "low": ("flagged", "LOW", 0.35), "clean": ("clean", "CLEAN", 0.0), "empty_error": ("flagged", "MEDIUM", 0.65),
        "failed": ("error", "CLEAN", 0.0), "failed_with": ("error", "CRITICAL", 0.9),
    }


def test_three_meanings_of_flagged(results):
    findings = risk.findings_of_results(results)
    assert report.summary(results).first().flagged_files == 5
    assert report.console_ranking(results).count() == 6
    assert dashboard.flagged(results, findings).count() == 6
    overview = dashboard.overview(results, findings).first()
    assert (overview.total_files_scanned, overview.total_pii_findings, overview.critical, overview.high) == (8, 8, 2, 1)


def test_orders(results):
    assert [r.file_id for r in report.flagged_table(results).collect()] == ["crit", "high", "empty_error", "med", "low"]
    assert [r.file_id for r in report.console_ranking(results).collect()][:2] == ["crit", "failed_with"]
    first = report.flagged_files(results).first()
    assert [f.start_index for f in first.findings] == [3, 30, 60]
    assert first.entity_breakdown == {"KR_PASSPORT": 1, "NPI": 2}
    assert [tuple(r) for r in report.entity_totals(results).collect()][0] == ("NPI", 2)


def test_flagged_table_columns(results):
    row = report.flagged_table(results).first().asDict()
    assert len(row) == 19 and (row["npi"], row["kr_passport"], row["person"]) == (2, 1, 0)
    low = report.flagged_table(results).where("file_id = 'low'").first()
    assert low.total_findings == 1 and low.kr_rrn == 0


def test_distribution_and_verdict(spark, results):
    assert {r.risk_level: r.n for r in report.risk_distribution(results).collect()} == {
        "CRITICAL": 1, "HIGH": 1, "MEDIUM": 2, "LOW": 1}
    none = results.where("file_id = 'clean'")
    assert {r.n for r in report.risk_distribution(none).collect()} == {0}
    assert report.scan_verdict(results).first().verdict == 2
    assert report.scan_verdict(none).first().verdict == 0
    assert report.scan_verdict(none.limit(0)).first().verdict == 0


def lines_of(path):
    return [line for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()]


def test_json_report_is_one_document(results, tmp_path):
    from pathlib import Path

    path = Path(writers.write_json_report(results.repartition(5), str(tmp_path), "root", 1.239))
    doc = json.loads("".join(lines_of(path)))
    assert [f["file_id"] for f in doc["flagged_files"]] == ["crit", "high", "empty_error", "med", "low"]
    assert doc["summary"]["risk_distribution"] == {"CRITICAL": 1, "HIGH": 1, "MEDIUM": 2, "LOW": 1}
    assert list(doc["summary"]["entity_type_totals"])[0] == "NPI"
    assert [f["file_id"] for f in doc["clean_files"]] == ["clean"]
    assert [f["error"] for f in doc["errors"]] == ['boom "quoted"', "late"]
    assert doc["metadata"]["duration_seconds"] == 1.24


def test_json_report_of_files_listed_twice(results, tmp_path):
    from pathlib import Path

    twice = results.unionByName(results).unionByName(results.withColumn("file_path", F.lit("/other")))
    doc = json.loads("".join(lines_of(Path(writers.write_json_report(twice.repartition(5), str(tmp_path))))))
    assert [len(doc[k]) for k in ("flagged_files", "clean_files", "errors")] == [15, 3, 6]
    assert [f["file_path"] for f in doc["flagged_files"][:3]] == ["/other", "/x/crit.txt", "/x/crit.txt"]


def test_json_report_without_files(results, tmp_path):
    from pathlib import Path

    path = Path(writers.write_json_report(results.limit(0), str(tmp_path)))
    doc = json.loads("".join(lines_of(path)))
    assert doc["flagged_files"] == doc["clean_files"] == doc["errors"] == []
    assert doc["summary"]["total_files_scanned"] == 0


def test_log(results, tmp_path):
    from pathlib import Path

    lines = lines_of(Path(writers.write_findings_log(results.repartition(3), str(tmp_path))))
    assert lines[:3] == list(report.LOG_TITLE)
    lines = lines[3:]
    assert lines[:4] == [
        "[CRITICAL] File: crit.txt (ID: crit)",
        "Path: /x/crit.txt",
        "  - KR_PASSPORT     : a*******b                      (Pos: 3-12)",
        "  - NPI             : a*******b                      (Pos: 30-39)",
    ]
    assert lines[5] == "" and lines[6].startswith("[HIGH]")


def test_tables_replace_those_of_the_last_run(spark, results, tmp_path):
    for rows in (results, results.where("file_id = 'crit'")):
        writers.write_tables(rows, str(tmp_path), "root", 2.0)
        writers.write_state_tables(rows.withColumn("last_scanned", F.current_timestamp()), str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "flagged_files")).count() == 1
    assert spark.read.parquet(str(tmp_path / "all_findings")).count() == 3
    assert len(spark.read.parquet(str(tmp_path / "summary")).columns) == 13
    assert spark.read.parquet(str(tmp_path / "findings")).columns[-2:] == ["start_index", "end_index"]
