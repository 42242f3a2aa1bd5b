"""The batch form of the scan against the patterns themselves, the plain Python loop and the expressions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_functions import random_texts
from test_scan import PARAMS
from yardstick import CHECKS, compile_rules, digits_of, scan_text

from veilscan.functions import batches, validators
from veilscan.operators import batch_scan
from veilscan.operators.scan import findings_of, scan, scan_rows
from veilscan.params import ScanParams
from veilscan.rules import Rule

PIECES = [
    *"0112345678969()-. \n–　a_é٣K", "010", "02", "031", "000", "666", "+1", "+82", "10", "12", "19", "900101", "9001011",
    "9001012345678", "(555)", "@", "x.y", ".co", "a.b@c.de", "ABCDEFGHI", "가",
]
LOW, SMALL = ScanParams(confidence_threshold=0.3), ScanParams(chunk_size=90, chunk_overlap=40)


def dense_texts(n, rng):
    for _ in range(n):
        yield "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 30)))


def folded(text):
    codes = batches.fold_table()[[ord(c) for c in text]] if text else []
    return batches.Folded(np.concatenate([[0], codes, np.zeros(1 + batches.PAD)]).astype(np.uint8))


@pytest.mark.parametrize("pattern", list(batches.MATCHERS))
def test_matchers_find_what_the_pattern_finds(pattern):
    rng = random.Random(21)
    compiled, found = re.compile(pattern, re.IGNORECASE), 0
    for text in [*dense_texts(3000, rng), *random_texts(2000, rng)]:
        start, end = batches.MATCHERS[pattern](folded(text))
        want = [(m.start() + 1, m.end() + 1) for m in compiled.finditer(text)]
        assert list(zip(start.tolist(), end.tolist())) == want, text
        found += len(want)
    assert found > 10


@pytest.mark.parametrize("check", list(batches.CHECKS))
def test_checksums(check):
    rng = random.Random(8)
    values = ["4532-0151-1283-0366", "1234567893", "900101-1234568", "４５３２０１５１１２８３０３６６", "0" * 13, ""]
    values += ["".join(rng.choice("0123456789٣-") for _ in range(rng.choice([10, 13, 14, 16, 19, 20]))) for _ in range(3000)]
    values += ["1000" + f"{i:06}" for i in range(300)] + [f"900101-1{i:06}" for i in range(300)]
    b, begin = folded("|".join(values)), 1
    start, end = [], []
    for v in values:
        start.append(begin)
        end.append(begin + len(v))
        begin += len(v) + 1
    got = batches.CHECKS[check](b, np.array(start), np.array(end)).tolist()
    assert got == [CHECKS[check](digits_of(v)) for v in values]
    assert True in got and False in got


@pytest.mark.parametrize("slice_size", [200, 1 << 19])
@pytest.mark.parametrize("params", [*PARAMS, LOW, SMALL], ids=range(len(PARAMS) + 2))
def test_findings_agree_with_plain_python(monkeypatch, params, slice_size):
    """Whatever slices of texts and blocks of chunks are."""
    monkeypatch.setattr(batch_scan, "SLICE", slice_size)
    rng = random.Random(5)
    words = ["passport ", "여권 ", "VISA ", "NPİ ", "KR_cms", "연락처", "카드번호 ", "moBile", "rrn", "medicare"]
    texts = ["".join(rng.choice([t, rng.choice(words)]) for t in random_texts(4, rng, 80)) for _ in range(150)]
    texts += [None, "", " \n", "".join(random_texts(200, rng, 50)), *dense_texts(100, rng)]
    column = pa.array(["left out", *texts], pa.string()).slice(1)
    got = batch_scan.findings_of_column(column, batch_scan.Scanner(params)).to_pylist()
    rules = compile_rules(params)
    for text, found in zip(texts, got, strict=True):
        assert sorted(tuple(f.values()) for f in found) == scan_text(text, params, rules), text


def test_long_chains_of_overlaps():
    rng = random.Random(2)
    for gap in (0, 1):
        start = np.sort(np.array([rng.randrange(3000) for _ in range(1000)]))
        end = start + np.array([rng.randrange(1, 9) for _ in range(1000)])
        want, last = [], -1
        for s, e in zip(start.tolist(), end.tolist()):
            want.append(s >= last + gap)
            last = e if want[-1] else last
        assert batches.apart(start, end, gap).tolist() == want


@pytest.mark.parametrize("params", [ScanParams(), LOW, SMALL])
def test_catalogue_rules_are_scanned_in_batches(spark, params):
    """Time a text: a pass of Java's expressions per pattern took some ten times as long."""
    df = spark.createDataFrame([(1, "passport M12345678")], "id int, text string")
    for found in (scan(df, "id", "text", params), scan_rows(df, "text", params)):
        assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()


def test_own_rules_stay_expressions(spark):
    odd = Rule(100, "TICKET", r"\bT-\d{4}\b", 0.5)
    even = Rule(100, "NUMBER", batches.catalogue.NPI, 0.5, validator=lambda v: validators.digits_only(v).cast("long") % 2 == 0)
    cased = Rule(100, "WORD", batches.catalogue.NPI, 0.5, keywords=("Ärzte",))
    df = spark.createDataFrame([(1, "T-1234 1234567890 ÄRZTE 1234567893")], "id int, text string")
    want = [{("TICKET", 0.5, 0, 6)}, {("NUMBER", 0.95, 7, 17)}, {("WORD", 0.65, 7, 17), ("WORD", 0.65, 24, 34)}]
    for rule, expected in zip((odd, even, cased), want):
        found = scan(df, "id", "text", ScanParams(custom_rules=(rule,), entities=(rule.entity,)))
        assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
        assert {(r.entity_type, r.confidence, r.start, r.end) for r in found.collect()} == expected


def test_texts_that_are_no_utf8_are_scanned_by_expressions(spark):
    raw = [b"M12345678 passport", b"caf\xe9 M12345678 \xff passport", b"\xed\xa0\x80 1234567893 npi", b"", "여권 M12345678".encode()]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "id int, b binary")
    df = df.select("id", F.col("b").cast("string").alias("text")).repartition(2)
    rows = lambda d: sorted(map(tuple, d.collect()))
    by_expressions = df.select("id", F.explode(findings_of(F.col("text"))).alias("f")).select("id", "f.*")
    assert rows(scan(df, "id", "text")) == rows(by_expressions)
    assert {r[0] for r in rows(by_expressions)} == {0, 1, 2, 4}
