"""Small text helpers as column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.regex import SPACE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def has_content(text: Column) -> Column:
    """True unless the text is NULL, empty or white space only (Unicode aware)."""
    return F.coalesce(text.rlike(f"[^{SPACE}]"), F.lit(False))


def mask(value: Column) -> Column:
    """First and last character with stars between; up to two characters: stars only."""
    n = F.length(value)
    return F.when(n <= 2, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(
            F.substring(value, 1, 1),
            F.repeat(F.lit("*"), n - 2),
            F.substring(value, -1, 1),
        )
    )


def contains_any(lowered: Column, words: Iterable[str]) -> Column:
    """True if any of the words occurs. Plain searches beat one pattern of alternatives."""
    lower = {w.lower() for w in words}
    # A word that contains another one adds nothing.
    needed = sorted(w for w in lower if not any(o != w and o in w for o in lower))
    return let(
        lowered,
        lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in needed]),
    )


def context_of(text: Column, start: Column, end: Column, window: int) -> Column:
    """Lower-cased slice around ``[start, end)``, clipped to the text."""
    first = F.greatest(start - window, F.lit(0))
    return F.lower(F.substring(text, first + 1, end + window - first))
