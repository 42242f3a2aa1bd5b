import random

import pytest
from pyspark.sql import functions as F
from test_functions import random_texts
from yardstick import scan_text

from veilscan.functions import validators
from veilscan.operators.dedup import dedup_intervals
from veilscan.operators.scan import scan, scan_long_texts, scan_rows
from veilscan.params import ScanParams
from veilscan.rules import Rule

CLEAN = (
    "Annual Report — FY2024\nRevenue: $4.2M\nOperating margin: 18.3%\nHeadcount: 142 employees\n"
    "This document contains no personal information.\n"
)
HEALTH = (
    "Patient Record — Confidential\nPatient: John Smith\nEmail: john.smith@hospital.org\n"
    "Phone: 555-867-5309\nSSN: 123-45-6789\nBilling Provider NPI: 1234567893\n"
    "Location: 123 Main Street, New York, NY 10001\nCredit Card: 4532015112830366\n"
)
KOREAN = (
    "개인정보 처리방침 테스트\n이름: 홍길동\n주민등록번호: 900101-1234567\n연락처: 010-1234-5678\n"
    "여권번호: M12345678\n신용카드: 9410-0523-6120-0902\n이메일: hong@example.kr\n"
)
EXPECTED = {
    "clean": {("KR_PASSPORT", 38, 47, 0.45), ("KR_PASSPORT", 62, 71, 0.45), ("KR_PASSPORT", 77, 86, 0.45)},
    "health": {("EMAIL_ADDRESS", 57, 80, 0.85), ("PHONE_NUMBER", 88, 100, 0.5), ("US_SSN", 106, 117, 0.65),
               ("NPI", 140, 150, 0.98), ("PHONE_NUMBER", 140, 150, 0.5), ("CREDIT_CARD", 210, 226, 0.98)},
    "korean": {("PHONE_NUMBER", 37, 44, 0.5), ("KR_PHONE", 50, 63, 0.85), ("PHONE_NUMBER", 50, 58, 0.5),
               ("KR_PASSPORT", 70, 79, 0.6), ("EMAIL_ADDRESS", 111, 126, 0.85)},
}


def spark_scan(spark, texts, params):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    got = {i: [] for i in range(len(texts))}
    for r in scan(df, "id", "text", params).collect():
        got[r.id].append((r.entity_type, r.confidence, r.start, r.end, r.masked_value))
    return {i: sorted(v) for i, v in got.items()}


def test_samples(spark):
    rows = [("clean", CLEAN), ("health", HEALTH), ("korean", KOREAN)]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {}
    for r in scan(df, "id", "text").collect():
        got.setdefault(r.id, set()).add((r.entity_type, r.start, r.end, r.confidence))
    assert got == EXPECTED


def test_masked_values_and_nothing_raw(spark):
    found = spark_scan(spark, [HEALTH], ScanParams())[0]
    assert ("EMAIL_ADDRESS", 0.85, 57, 80, "j" + "*" * 21 + "g") in found
    assert all("*" in f[4] for f in found)


PARAMS = [
    ScanParams(),
    ScanParams(chunk_size=40, chunk_overlap=15),
    ScanParams(chunk_size=40, chunk_overlap=39),
    ScanParams(chunk_size=25, chunk_overlap=0, confidence_threshold=0.3),
    ScanParams(confidence_threshold=0.6),
    ScanParams(confidence_threshold=0.0, chunk_size=60, chunk_overlap=30),
    ScanParams(profile="recognizer", chunk_size=70, chunk_overlap=20),
    ScanParams(entities=("KR_PASSPORT", "PHONE_NUMBER"), chunk_size=30, chunk_overlap=25),
]


@pytest.mark.parametrize("params", PARAMS, ids=range(len(PARAMS)))
def test_random_texts_agree_with_plain_python(spark, params):
    rng = random.Random(11)
    words = ["passport ", "여권 ", "VISA ", "NPI", "연락처", "카드번호 ", "mobile", "rrn"]
    texts = ["".join(rng.choice([t, rng.choice(words)]) for t in random_texts(4, rng, 80)) for _ in range(400)]
    got = spark_scan(spark, texts, params)
    for i, text in enumerate(texts):
        assert got[i] == scan_text(text, params), text


def test_context_distance(spark):
    texts = []
    for gap in (49, 50, 51):
        texts += ["x" * 9 + " passport" + " " * (gap - 8) + "M12345678", "M12345678" + " " * gap + "passport"]
    params = ScanParams(entities=("KR_PASSPORT",))
    got = spark_scan(spark, texts, params)
    assert {i: v for i, v in got.items()} == {i: scan_text(t, params) for i, t in enumerate(texts)}


def test_keywords_count_for_rules_with_matches(spark):
    """Words of one rule boost no other, and are looked for only where a rule that has them matched."""
    words = ["passport", "medicare", "visa", "mobile", "rrn"]
    texts = [f"{w} M12345678 and 1234567893, {v}" for w in words for v in words] + ["visa abcdefghi", "passport abcdefghi", "passport"]
    params = ScanParams()
    assert spark_scan(spark, texts, params) == {i: scan_text(t, params) for i, t in enumerate(texts)}
    plan = scan(spark.createDataFrame([("a",)], "t string"), "t", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" in plan


def test_chunk_edges_change_results_like_in_plain_python(spark):
    text = ("word " * 1999 + "abcdefghijk" + " M12345678 passport ") * 2
    params = ScanParams()
    assert spark_scan(spark, [text], params)[0] == scan_text(text, params)


def test_long_text_with_hits_across_many_chunks(spark):
    rng = random.Random(3)
    text = "".join(random_texts(3000, rng, 50))
    params = ScanParams(chunk_size=300, chunk_overlap=80)
    assert spark_scan(spark, [text], params)[0] == scan_text(text, params)


def test_long_texts_give_the_same_findings(spark):
    rng = random.Random(9)
    texts = ["".join(random_texts(300, rng, 50)) for _ in range(5)] + [" ", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    params = ScanParams(chunk_size=200, chunk_overlap=120, confidence_threshold=0.3)
    one, other = scan(df, "id", "text", params), scan_long_texts(df, "id", "text", params, 6)
    assert one.columns == other.columns
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


def test_blank_and_missing_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n　")], "id int, text string")
    assert scan(df, "id", "text").count() == 0
    rows = {r.id: r for r in scan_rows(df, "text").collect()}
    assert {i: (r.total_chars, len(r.findings)) for i, r in rows.items()} == {1: (0, 0), 2: (0, 0), 3: (3, 0)}


def test_custom_rule_with_own_validator(spark):
    even = Rule(
        number=100, entity="TICKET", pattern=r"\bT-\d{4}\b", base=0.3,
        validator=lambda v: validators.digits_only(v).cast("int") % 2 == 0, keywords=("Ticket",),
    )
    params = ScanParams(entities=("TICKET",), custom_rules=(even,))
    got = spark_scan(spark, ["t-1234 T-1235", "ticket T-0002"], params)
    assert got == {0: [("TICKET", 0.85, 0, 6, "t****4")], 1: [("TICKET", 0.98, 7, 13, "T****2")]}


def test_scan_is_one_narrow_stage(spark):
    df = spark.createDataFrame([(1, CLEAN)], "id int, text string")
    plan = scan(df, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_filters_on_results_do_not_scan_twice(spark, tmp_path):
    spark.createDataFrame([(1, CLEAN)], "id int, text string").write.parquet(str(tmp_path / "t"))
    rows = scan_rows(spark.read.parquet(str(tmp_path / "t")), "text").where("size(findings) > 1")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    once = scan(spark.read.parquet(str(tmp_path / "t")), "id", "text")._jdf.queryExecution()
    assert plan.count("regexp_replace") == once.optimizedPlan().toString().count("regexp_replace")


@pytest.mark.parametrize("bits, fan", [(16, 64), (3, 64), (2, 3)])
def test_interval_dedup_over_blocks(spark, monkeypatch, bits, fan):
    from veilscan.operators import dedup

    monkeypatch.setattr(dedup, "BLOCK_BITS", bits)
    monkeypatch.setattr(dedup, "FAN", fan)
    rng = random.Random(11)
    rows = [(k, s, s + rng.choice([0, 3, 40]) if s is not None else 1) for k in ("a", None, "b") for s in rng.sample(range(500), 120)]
    df = spark.createDataFrame(rows, "k string, start int, end int").repartition(3)
    want = []
    for key in ("a", None, "b"):
        reach = None
        for _, s, e in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:]):
            if reach is None or s > reach:
                want.append((str(key), s, e))
                reach = e
    got = dedup_intervals(df, ["k"]).collect()
    assert sorted((str(r.k), r.start, r.end) for r in got) == sorted(want)
    assert dedup_intervals(df.limit(0), ["k"]).count() == 0


def test_interval_dedup_of_times_and_missing_ends(spark, monkeypatch):
    from veilscan.operators import dedup

    monkeypatch.setattr(dedup, "BLOCK_BITS", 2)
    monkeypatch.setattr(dedup, "FAN", 2)
    rng = random.Random(4)
    rows = [(k, s, rng.choice([None, s + 1, s + 30])) for k in (1, 2) for s in rng.sample(range(200), 60)]
    want = []
    for key in (1, 2):
        reach = None
        for _, s, e in sorted(r for r in rows if r[0] == key):
            if reach is None or s > reach:
                want.append((key, s, e))
                reach = e if e is not None else reach
    df = spark.createDataFrame(rows, "k int, start int, end int").repartition(3)
    for kind, back in (("timestamp", "unix_seconds(cast({} as timestamp))"), ("string", "cast({} as int)"), ("double", "cast({} as int)")):
        cast = "timestamp_seconds({0})" if kind == "timestamp" else "format_string('%05d', {0})" if kind == "string" else "cast({0} as double)"
        own = df.selectExpr("k", cast.format("start") + " AS start", f"CASE WHEN end IS NOT NULL THEN {cast.format('end')} END AS end")
        got = dedup_intervals(own, ["k"]).selectExpr("k", back.format("start"), back.format("end")).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_interval_dedup_collects_nothing():
    import inspect

    from veilscan.operators import dedup

    assert ".collect(" not in inspect.getsource(dedup) and "to_pylist" not in inspect.getsource(dedup)


def test_interval_dedup_agrees_with_naive_loop(spark):
    rng = random.Random(5)
    rows = []
    for key in range(300):
        for rule in range(rng.randrange(1, 30)):
            s = rng.randrange(60)
            rows.append((key, rng.choice("AB"), s, s + rng.randrange(1, 12), rng.choice([0.4, 0.5, 0.9]), rule))
    df = spark.createDataFrame(rows, "k int, t string, start int, end int, conf double, rule int")
    kept = dedup_intervals(df, ["k", "t"], best_first=[-F.col("conf"), F.col("rule")])
    want = []
    for r in sorted(rows, key=lambda r: (r[2], -r[4], r[5])):
        if not any(w[:2] == r[:2] and w[2] <= r[3] and r[2] <= w[3] for w in want):
            want.append(r)
    assert sorted(map(tuple, kept.collect())) == sorted(want)
