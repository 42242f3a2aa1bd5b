import random
import re

import pytest
from pyspark.sql import functions as F

from veilscan.functions import validators
from veilscan.functions.regex import to_java
from veilscan.functions.text import contains_any, has_content, mask
from veilscan.operators import findall
from veilscan.operators.chunks import chunk
from veilscan.params import ScanParams
from veilscan.rules import DEFAULT_RULES, RECOGNIZER_RULES, live_rules


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.orderBy("i").select(expression(F.col("v")).alias("x")).collect()]


CASES = [
    (validators.npi_luhn, ["1234567893", "1962233718"],
     ["1234567890", "1234567891", "abcdefghij", "123456789", "12345678901", "", None]),
    (validators.card_luhn,
     ["4532015112830366", "5425233430109903", "374251018720950", "6011111111111117",
      "4532 0151 1283 0366", "4532-0151-1283-0366", "４５３２０１５１１２８３０３６６"],
     ["1234567890123456", "123456789", "45320151128303660000", "9999999999999999", "", None]),
    (validators.rrn_checksum, ["900101-1234568", "9001011234568"],
     ["9001011234", "900101123456789", "9001011234ABC", "900101-1234567", "9001011234567", "", None]),
]


@pytest.mark.parametrize("check,valid,invalid", CASES)
def test_validators(spark, check, valid, invalid):
    assert column(spark, valid + invalid, check) == [True] * len(valid) + [False] * len(invalid)


def test_mask(spark):
    values = ["", "A", "AB", "ABC", "John Smith", "1234567890", "홍길동님", "𝐀b𝐂"]
    want = ["", "*", "**", "A*C", "J********h", "1********0", "홍**님", "𝐀*𝐂"]
    assert column(spark, values, mask) == want


def test_content_and_keywords(spark):
    blank = ["", " \t\n", " 　 \x1c", None]
    assert column(spark, blank + ["​", " x "], has_content) == [False] * 4 + [True] * 2
    words = ["passport number", "passport", "여권"]
    texts = ["a passport", "여권번호", "pass port", ""]
    assert column(spark, texts, lambda v: contains_any(v, words)) == [True, True, False, False]


@pytest.mark.parametrize(
    "text,size,overlap",
    [("Hello world", 100, 10), ("A" * 250, 100, 20), ("X" * 100, 100, 0),
     ("ABCDEFGHIJ" * 20, 100, 10), ("가나다𝐀é\n" * 33, 50, 30), ("abc" * 50, 7, 6), ("", 5, 1)],
)
def test_chunks(spark, text, size, overlap):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    rows = chunk(df, "id", "text", ScanParams(chunk_size=size, chunk_overlap=overlap)).collect()
    got = sorted((r.chunk_no, r.off, r.t) for r in rows)
    want, start = [], 0
    while start < len(text):
        want.append((len(want), start, text[start : start + size]))
        if start + size >= len(text):
            break
        start += size - overlap
    assert got == want


def test_bad_parameters_are_refused():
    for size, overlap in ((100, 100), (100, 150), (0, 0), (10, -1)):
        with pytest.raises(ValueError):
            ScanParams(chunk_size=size, chunk_overlap=overlap)
    with pytest.raises(ValueError):
        ScanParams(profile="unknown")


def test_rules_that_cannot_report_are_left_out():
    assert [r.number for r in live_rules(DEFAULT_RULES, 0.4)] == [0, 1, 2, 3, 4, 5, 6, 7, 9, 11, 12, 13, 14]
    assert 8 in [r.number for r in live_rules(DEFAULT_RULES, 0.35)]
    assert {r.number for r in live_rules(DEFAULT_RULES, 0.96)} == {0, 4, 5, 6, 7, 11}


ALPHABET = list("0123456789" * 4 + "abZ_-. +()@½²é한가𝐀😀́ 　０９–\nſK İı￾￿")
SEEDS = ["010-1234-5678", "02-345-6789", "+82 10 1234 5678", "900101-1234568", "M12345678",
         "a.b@c.example", "123-45-6789", "4532-0151-1283-0366", "4532015112830366", "1234567893",
         "(555) 867-5309", "+1 555.867.5309", "ABCDEFGHI", "여권"]


def random_texts(n, rng, longest=60):
    for _ in range(n):
        parts = []
        while sum(map(len, parts)) < rng.randrange(longest):
            parts.append(rng.choice(SEEDS) if rng.random() < 0.35 else rng.choice(ALPHABET))
        yield "".join(parts)


def test_matches_and_places_agree_with_python(spark):
    texts = list(random_texts(3000, random.Random(7)))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    for rule in {r.pattern: r for r in (*DEFAULT_RULES, *RECOGNIZER_RULES)}.values():
        java = to_java(rule.pattern, rule.opens)
        got = {}
        for r in findall.find_positions(df, "i", "v", java).collect():
            got.setdefault(r.i, []).append((r.start, r.end))
        pattern = re.compile(rule.pattern, re.IGNORECASE)
        for i, text in enumerate(texts):
            want = [m.span() for m in pattern.finditer(text)]
            assert sorted(got.get(i, [])) == want, (rule.number, text)


def test_many_matches_in_one_text(spark):
    rng = random.Random(4)
    texts = ["x" * n for n in (0, 511, 512, 513)] + ["".join(rng.choice("ab é") for _ in range(n)) for n in (900, 9000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    for pattern in (r"b", r"a+", r"\bb"):
        found = findall.find_positions(df, "i", "v", to_java(pattern)).collect()
        want = [(i, *m.span()) for i, t in enumerate(texts) for m in re.finditer(pattern, t)]
        assert sorted((r.i, r.start, r.end) for r in found) == want


def test_custom_patterns_keep_case_folding_and_boundaries(spark):
    texts = ["Code-12 CODE-7, xcode-9 code-1é", "ÀB", "code-٣"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    for pattern in (r"\bcode-\d+\b", r"à[b-]", r"[\w&]+", r"\bx?code"):
        found = findall.find_positions(df, "i", "v", to_java(pattern)).collect()
        want = [
            (i, *m.span()) for i, t in enumerate(texts) for m in re.finditer(pattern, t, re.IGNORECASE)
        ]
        assert sorted((r.i, r.start, r.end) for r in found) == want
