"""Checksum validators as column functions (matched text in, boolean out)."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.text import let

# Fixed value: issuer prefix put before a provider number for its checksum.
NPI_PREFIX = "80840"
# Resident number weights for digits 1 to 12.
RRN_WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)


def _digit_table() -> tuple[str, str]:
    """Every non-ASCII decimal digit of Unicode and its ASCII counterpart."""
    chars = [chr(i) for i in range(128, sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Nd"]
    return "".join(chars), "".join(str(unicodedata.decimal(c)) for c in chars)


_WIDE, _ASCII = _digit_table()


def digits_only(value: Column) -> Column:
    """Keep the decimal digits, written in ASCII."""
    ascii_form = F.when(
        value.rlike("[^\\x00-\\x7F]"), F.translate(value, _WIDE, _ASCII)
    ).otherwise(value)
    return F.regexp_replace(ascii_form, "[^0-9]", "")


def card_luhn(value: Column) -> Column:
    """13 to 19 digits with a valid mod-10 checksum. NULL counts as invalid."""
    return let(
        digits_only(value),
        lambda d: F.coalesce(
            F.length(d).between(13, 19) & F.call_function("luhn_check", d), F.lit(False)
        ),
    )


def npi_luhn(value: Column) -> Column:
    """Exactly 10 digits, valid mod-10 behind the issuer prefix. NULL is invalid."""
    return let(
        digits_only(value),
        lambda d: F.coalesce(
            (F.length(d) == 10) & F.call_function("luhn_check", F.concat(F.lit(NPI_PREFIX), d)),
            F.lit(False),
        ),
    )


def rrn_checksum(value: Column) -> Column:
    """13 digits whose last one closes the weighted sum of the others."""

    def check(d: Column) -> Column:
        total = sum(
            (F.substring(d, i, 1).cast("int") * w for i, w in enumerate(RRN_WEIGHTS, start=1)),
            start=F.lit(0),
        )
        valid = F.pmod(F.lit(11) - total % 11, F.lit(10)) == F.substring(d, 13, 1).cast("int")
        return F.coalesce(F.when(F.length(d) == 13, valid), F.lit(False))

    return let(digits_only(value), check)
