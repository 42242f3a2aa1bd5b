"""The rule catalogue: what is looked for, how it is scored and what confirms it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column

from veilscan.functions import validators

# How scores rise, and how far; characters looked at around a match.
CONTEXT_BOOST = 0.15
VALIDATED_BOOST = 0.55
VALIDATED_CAP = 0.95
CONTEXT_CAP = 0.98
CONTEXT_WINDOW = 50


@dataclass(frozen=True)
class Rule:
    """One detector.

    ``validator`` maps the column of matched text to a boolean column. A hit it does
    not confirm is dropped; a confirmed one gains ``VALIDATED_BOOST``. It runs inside a
    lambda, so it has to be built from Spark's own functions.

    ``opens`` is a class body of possible first characters, ``needs`` a cheap Spark
    test ('digits', '@' or None) that every text with a match passes. Both only save
    work. ``within`` names an earlier rule whose matches include all of this rule's.
    """

    number: int
    entity: str
    pattern: str
    base: float
    validator: Callable[[Column], Column] | None = None
    keywords: tuple[str, ...] = ()
    opens: str | None = None
    needs: str | None = None
    within: int | None = None

    @property
    def plain_score(self) -> float:
        if self.validator is None:
            return min(CONTEXT_CAP, self.base)
        return min(CONTEXT_CAP, min(VALIDATED_CAP, self.base + VALIDATED_BOOST))

    @property
    def context_score(self) -> float:
        if not self.keywords:
            return self.plain_score
        return min(CONTEXT_CAP, self.plain_score + CONTEXT_BOOST)


# Patterns (Python notation, case ignored), base scores and keywords.
NPI = r"\b\d{10}\b"
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
US_PHONE = r"\b(?:\+1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b"
SSN = r"\b(?!000|666|9\d{2})\d{3}[-\s]?(?!00)\d{2}[-\s]?(?!0000)\d{4}\b"
CARD_GROUPED = r"\b\d{4}[-\s]\d{4}[-\s]\d{4}[-\s]\d{4}\b"
CARD_PLAIN = r"\b[3-6]\d{12,18}\b"
RRN_HYPHEN = r"\b(\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])[-–]\s?[1-4]\d{6}\b"
RRN_PLAIN = r"\b(\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])[1-4]\d{6}\b"
PASSPORT = r"\b[A-Z][A-Z0-9]{8}\b"
PASSPORT_TWO = r"\b[A-Z]{2}[A-Z0-9]{7}\b"
KR_MOBILE = r"\b01[016789][-.\s]?\d{3,4}[-.\s]?\d{4}\b"
KR_LANDLINE = r"\b0[2-6][1-5]?[-.\s]?\d{3,4}[-.\s]?\d{4}\b"
KR_INTERNATIONAL = r"\+82[-.\s]?10[-.\s]?\d{4}[-.\s]?\d{4}\b"

DEFAULT_KEYWORDS: dict[str, tuple[str, ...]] = {
    "NPI": ("npi", "national provider", "provider identifier", "billing provider",
            "rendering provider", "medicare", "medicaid", "cms"),
    "KR_RRN": ("주민등록", "주민번호", "resident registration", "rrn"),
    "KR_PASSPORT": ("여권", "passport", "travel document"),
    "KR_CARD_NUMBER": ("카드번호", "신용카드", "체크카드", "card number"),
    "CREDIT_CARD": ("credit card", "debit card", "card number", "visa", "mastercard"),
    "KR_PHONE": ("전화번호", "연락처", "핸드폰", "휴대폰", "phone", "mobile"),
}

RECOGNIZER_KEYWORDS: dict[str, tuple[str, ...]] = {
    "NPI": ("npi", "national provider", "provider identifier", "provider number",
            "provider id", "billing provider", "rendering provider", "cms", "medicare",
            "medicaid"),
    "KR_RRN": ("주민등록번호", "주민번호", "resident registration", "rrn", "주민등록", "신분증"),
    "KR_RRN_WEAK": ("주민등록번호", "주민번호", "rrn", "주민등록"),
    "KR_PASSPORT": ("여권", "여권번호", "passport", "passport number"),
    "KR_CARD_NUMBER": ("카드번호", "카드", "신용카드", "체크카드", "credit card", "card number",
                       "visa", "mastercard", "삼성카드", "신한카드"),
    "KR_PHONE": ("전화번호", "연락처", "핸드폰", "휴대폰", "phone", "mobile"),
}

_DIGIT_START = {"opens": r"\d", "needs": "digits"}
_LETTER_START = {"opens": "A-Z"}


def _numbered(entries: Sequence[dict], keywords: dict[str, tuple[str, ...]]) -> tuple[Rule, ...]:
    return tuple(
        Rule(number=n, keywords=keywords.get(e["entity"], ()), **e) for n, e in enumerate(entries)
    )


DEFAULT_RULES = _numbered(
    [
        dict(entity="NPI", pattern=NPI, base=0.3, validator=validators.npi_luhn, **_DIGIT_START),
        dict(entity="EMAIL_ADDRESS", pattern=EMAIL, base=0.85, needs="@",
             opens=r"A-Z0-9._%+\-"),
        dict(entity="PHONE_NUMBER", pattern=US_PHONE, base=0.5, opens=r"+(\d", needs="digits"),
        dict(entity="US_SSN", pattern=SSN, base=0.65, **_DIGIT_START),
        dict(entity="CREDIT_CARD", pattern=CARD_GROUPED, base=0.7,
             validator=validators.card_luhn, **_DIGIT_START),
        dict(entity="CREDIT_CARD", pattern=CARD_PLAIN, base=0.4,
             validator=validators.card_luhn, opens="3-6", needs="digits"),
        dict(entity="KR_RRN", pattern=RRN_HYPHEN, base=0.75,
             validator=validators.rrn_checksum, **_DIGIT_START),
        dict(entity="KR_RRN", pattern=RRN_PLAIN, base=0.5,
             validator=validators.rrn_checksum, **_DIGIT_START),
        dict(entity="KR_RRN_WEAK", pattern=RRN_HYPHEN, base=0.35, **_DIGIT_START),
        dict(entity="KR_PASSPORT", pattern=PASSPORT, base=0.45, **_LETTER_START),
        dict(entity="KR_PASSPORT", pattern=PASSPORT_TWO, base=0.45, within=9, **_LETTER_START),
        dict(entity="KR_CARD_NUMBER", pattern=CARD_GROUPED, base=0.7,
             validator=validators.card_luhn, **_DIGIT_START),
        dict(entity="KR_PHONE", pattern=KR_MOBILE, base=0.7, opens="0", needs="digits"),
        dict(entity="KR_PHONE", pattern=KR_LANDLINE, base=0.6, opens="0", needs="digits"),
        dict(entity="KR_PHONE", pattern=KR_INTERNATIONAL, base=0.8, opens="+", needs="digits"),
    ],
    DEFAULT_KEYWORDS,
)

RECOGNIZER_RULES = _numbered(
    [
        dict(entity="NPI", pattern=NPI, base=0.3, validator=validators.npi_luhn, **_DIGIT_START),
        dict(entity="KR_RRN", pattern=RRN_HYPHEN, base=0.5,
             validator=validators.rrn_checksum, **_DIGIT_START),
        dict(entity="KR_RRN", pattern=RRN_PLAIN, base=0.4,
             validator=validators.rrn_checksum, **_DIGIT_START),
        dict(entity="KR_RRN_WEAK", pattern=RRN_HYPHEN, base=0.35, **_DIGIT_START),
        dict(entity="KR_PASSPORT", pattern=PASSPORT, base=0.4, **_LETTER_START),
        dict(entity="KR_PASSPORT", pattern=PASSPORT_TWO, base=0.4, within=4, **_LETTER_START),
        dict(entity="KR_CARD_NUMBER", pattern=CARD_GROUPED, base=0.5,
             validator=validators.card_luhn, **_DIGIT_START),
        dict(entity="KR_CARD_NUMBER", pattern=CARD_PLAIN, base=0.3,
             validator=validators.card_luhn, opens="3-6", needs="digits"),
        dict(entity="KR_PHONE", pattern=KR_MOBILE, base=0.5, opens="0", needs="digits"),
        dict(entity="KR_PHONE", pattern=KR_LANDLINE, base=0.4, opens="0", needs="digits"),
        dict(entity="KR_PHONE", pattern=KR_INTERNATIONAL, base=0.6, opens="+", needs="digits"),
    ],
    RECOGNIZER_KEYWORDS,
)

PROFILES: dict[str, tuple[Rule, ...]] = {
    "default": DEFAULT_RULES,
    "recognizer": RECOGNIZER_RULES,
}


def live_rules(rules: Sequence[Rule], threshold: float) -> list[Rule]:
    """Rules that can still produce a reported hit.

    Scores take only two values per rule, so both limits are known while the plan is
    built: a rule that stays under the threshold, or whose matches another live rule
    reports at the same score for the same entity, costs nothing at run time.
    """
    live = [r for r in rules if r.context_score >= threshold]
    by_number = {r.number: r for r in live}

    def repeated(rule: Rule) -> bool:
        other = by_number.get(rule.within) if rule.within is not None else None
        return (
            other is not None
            and other.entity == rule.entity
            and other.base == rule.base
            and other.validator == rule.validator
            and other.keywords == rule.keywords
        )

    return [r for r in live if not repeated(r)]
