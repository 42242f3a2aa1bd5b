"""Matches of the catalogue's patterns and their checksums, over many texts at once.

Texts lie end to end in one buffer of folded characters: a byte each that tells all the patterns can tell
apart. A character that no pattern takes, and the gap between two texts, is 0. A pattern is then
a few NumPy steps over the places where it can start. What comes out is what the pattern itself finds, leftmost first and
without overlaps; ``tests/test_batches.py`` compares the two.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property, lru_cache

import numpy as np

from veilscan import rules as catalogue
from veilscan.functions import validators

GAP, WORDY, DASH, LETTER = 0, 1, 2, ord("A")
# Decimal digits beyond ASCII: 0x80 and their value, so that the low four bits are the value of any digit.
WIDE = 0x80
# Zeros behind the last text; no pattern looks further on.
PAD = 64


def _set(chars: str, *codes: int) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[*map(ord, chars), *codes]] = True
    return table


_WIDE_DIGITS = range(WIDE, WIDE + 10)
DIGIT = _set("0123456789", *_WIDE_DIGITS)
WORD = _set("0123456789_", *_WIDE_DIGITS, WORDY, LETTER)
ALNUM = _set("0123456789", LETTER)
LOCAL = _set("0123456789._%+-", LETTER)
BLANK, SEP, SEP_DOT = _set(" "), _set("- "), _set("-. ")
DOMAIN = re.compile(rb"[A0-9.\-]+\.A{2,}(?![A0-9_\x01\x80-\x89])")


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """The folded byte of every code point, by Python's own classes."""
    table = np.zeros(0x110000, dtype=np.uint8)
    everything = "".join(map(chr, range(0x110000)))
    for pattern, code in ((r"\w+", WORDY), (r"\s+", ord(" "))):
        for m in re.finditer(pattern, everything):
            table[m.start() : m.end()] = code
    for m in re.finditer(r"\d", everything):
        table[m.start()] = WIDE + int(m.group())
    for m in re.finditer("[a-z]+", everything, re.IGNORECASE):
        table[m.start() : m.end()] = LETTER
    for c in "0123456789_.%+-()@":
        table[ord(c)] = ord(c)
    table[ord("–")] = DASH
    return table


def apart(start: np.ndarray, end: np.ndarray, gap: int) -> np.ndarray:
    """Which of the spans, in order of their starts, begin ``gap`` or more behind the last one kept."""
    n = len(start)
    keep = np.ones(n, dtype=bool)
    keep[1:] = start[1:] >= np.maximum.accumulate(end)[:-1] + gap
    if keep.all():
        return keep
    # Spans that no earlier one reaches are kept; what hangs on each of them is looked at in turn.
    heads = np.flatnonzero(keep)
    sizes = np.diff(np.append(heads, n))
    for head, size in zip(heads[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        last = int(end[head]) + gap
        run = slice(head + 1, head + size)
        for i, (s, e) in enumerate(zip(start[run].tolist(), end[run].tolist()), head + 1):
            if s >= last:
                keep[i] = True
                last = e + gap
    return keep


class Folded:
    """A buffer of folded characters: 0 first, ``PAD`` zeros last."""

    def __init__(self, code: np.ndarray) -> None:
        self.code = code
        self.word = WORD[code]
        digit = DIGIT[code]
        edges = np.flatnonzero(digit[1:] != digit[:-1]) + 1
        first, last = edges[0::2], edges[1::2]
        # Digits from each place on, to the end of their run.
        at = np.flatnonzero(digit)
        self.run = np.zeros(len(code), dtype=np.int32)
        self.run[at] = np.repeat(last, last - first) - at
        # Runs of digits that no word character stands before, and their lengths.
        opens = ~self.word[first - 1]
        self.first, self.length = first[opens], (last - first)[opens]

    def runs(self, *lengths: int) -> np.ndarray:
        return self.first[np.isin(self.length, lengths)]

    def at(self, place: np.ndarray, char: str) -> np.ndarray:
        return self.code[place] == ord(char)

    def within(self, place: np.ndarray, first: str, last: str) -> np.ndarray:
        return (self.code[place] - np.uint8(ord(first))) <= ord(last) - ord(first)

    def skip(self, place: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Behind one character of the class, if there is one."""
        return place + table[self.code[place]]

    def ends(self, place: np.ndarray) -> np.ndarray:
        return ~self.word[place]

    @cached_property
    def bounds(self) -> np.ndarray:
        return np.flatnonzero(self.word[1:] != self.word[:-1]) + 1


Spans = tuple[np.ndarray, np.ndarray]


def _kept(start: np.ndarray, end: np.ndarray, ok: np.ndarray) -> Spans:
    start, end = start[ok], end[ok]
    keep = apart(start, end, 0)
    return start[keep], end[keep]


def npi(b: Folded) -> Spans:
    s = b.runs(10)
    return _kept(s, s + 10, b.ends(s + 10))


def ssn(b: Folded) -> Spans:
    s = b.runs(3, 5, 9)
    zeros = lambda place, n: np.logical_and.reduce([b.at(place + i, "0") for i in range(n)])
    sixes = np.logical_and.reduce([b.at(s + i, "6") for i in range(3)])
    p = b.skip(s + 3, SEP)
    q = b.skip(p + 2, SEP)
    ok = ~(zeros(s, 3) | sixes | b.at(s, "9")) & (b.run[p] >= 2) & ~zeros(p, 2)
    return _kept(s, q + 4, ok & (b.run[q] >= 4) & ~zeros(q, 4) & b.ends(q + 4))


def card_grouped(b: Folded) -> Spans:
    s = b.runs(4)
    ok = b.ends(s + 19)
    for i in (4, 9, 14):
        ok &= SEP[b.code[s + i]] & (b.run[s + i + 1] >= 4)
    return _kept(s, s + 19, ok)


def card_plain(b: Folded) -> Spans:
    many = (b.length >= 13) & (b.length <= 19)
    s = b.first[many]
    e = s + b.length[many]
    return _kept(s, e, b.within(s, "3", "6") & b.ends(e))


def _dated(b: Folded, s: np.ndarray) -> np.ndarray:
    """Six digits whose last four are a month and a day."""
    month = (b.at(s + 2, "0") & b.within(s + 3, "1", "9")) | (b.at(s + 2, "1") & b.within(s + 3, "0", "2"))
    day = (
        (b.at(s + 4, "0") & b.within(s + 5, "1", "9"))
        | b.within(s + 4, "1", "2")
        | (b.at(s + 4, "3") & b.within(s + 5, "0", "1"))
    )
    return month & day


def rrn_hyphen(b: Folded) -> Spans:
    s = b.runs(6)
    dash = b.code[s + 6]
    p = b.skip(s + 7, BLANK)
    ok = _dated(b, s) & ((dash == ord("-")) | (dash == DASH)) & b.within(p, "1", "4") & (b.run[p] >= 7)
    return _kept(s, p + 7, ok & b.ends(p + 7))


def rrn_plain(b: Folded) -> Spans:
    s = b.runs(13)
    return _kept(s, s + 13, _dated(b, s) & b.within(s + 6, "1", "4") & b.ends(s + 13))


def _nine_alnum(b: Folded, letters: int) -> Spans:
    first, last = b.bounds[0::2], b.bounds[1::2]
    s = first[last - first == 9]
    for i in range(9):
        c = b.code[s + i]
        s = s[c == LETTER if i < letters else ALNUM[c]]
    return s, s + 9


def passport(b: Folded) -> Spans:
    return _nine_alnum(b, 1)


def passport_two(b: Folded) -> Spans:
    return _nine_alnum(b, 2)


def _first_of(ends: list[np.ndarray]) -> np.ndarray:
    """The end the pattern tries first; -1 is none."""
    out = ends[-1]
    for e in ends[-2::-1]:
        out = np.where(e >= 0, e, out)
    return out


def _four_more(b: Folded, p: np.ndarray, digits: int) -> np.ndarray:
    r"""The end of ``\d{digits}[-.\s]?\d{4}\b``, or -1."""
    q = b.skip(p + digits, SEP_DOT)
    return np.where((b.run[p] >= digits) & (b.run[q] >= 4) & b.ends(q + 4), q + 4, -1)


def kr_mobile(b: Folded) -> Spans:
    s = b.runs(3, 6, 7, 10, 11)
    s = s[b.at(s, "0") & b.at(s + 1, "1") & (b.within(s + 2, "0", "1") | b.within(s + 2, "6", "9"))]
    p = b.skip(s + 3, SEP_DOT)
    e = _first_of([_four_more(b, p, 4), _four_more(b, p, 3)])
    return _kept(s, e, e >= 0)


def kr_landline(b: Folded) -> Spans:
    s = b.first[(b.length >= 2) & (b.length <= 11)]
    s = s[b.at(s, "0") & b.within(s + 1, "2", "6")]
    p, q = b.skip(s + 3, SEP_DOT), b.skip(s + 2, SEP_DOT)
    third = b.within(s + 2, "1", "5")
    e = _first_of(
        [np.where(third, _four_more(b, p, n), -1) for n in (4, 3)] + [_four_more(b, q, n) for n in (4, 3)]
    )
    return _kept(s, e, e >= 0)


def kr_international(b: Folded) -> Spans:
    s = np.flatnonzero(b.code == ord("+"))
    s = s[b.at(s + 1, "8") & b.at(s + 2, "2")]
    p = b.skip(s + 3, SEP_DOT)
    q = b.skip(p + 2, SEP_DOT)
    e = _four_more(b, q, 4)
    return _kept(s, e, b.at(p, "1") & b.at(p + 1, "0") & (e >= 0))


def us_phone(b: Folded) -> Spans:
    def number(p: np.ndarray) -> np.ndarray:
        area = p + b.at(p, "(")
        q = area + 3
        q = q + b.at(q, ")")
        tail = _four_more(b, b.skip(q, SEP_DOT), 3)
        return _first_of([np.where(b.run[area] >= 3, tail, -1), _four_more(b, p, 3)])

    s = b.runs(3, 6, 7, 10)
    # A word boundary before a bracket or plus sign: a word character stands there.
    opening = np.flatnonzero(b.code == ord("("))
    s = np.concatenate([s, opening[b.word[opening - 1]]])
    e = number(s)
    plus = np.flatnonzero(b.code == ord("+"))
    plus = plus[b.word[plus - 1] & b.at(plus + 1, "1")]
    s, e = np.concatenate([s, plus]), np.concatenate([e, number(b.skip(plus + 2, SEP_DOT))])
    order = np.argsort(s, kind="stable")
    s, e = s[order], e[order]
    return _kept(s, e, e >= 0)


def email(b: Folded) -> Spans:
    ats = np.flatnonzero(b.code == ord("@"))
    if not len(ats):
        return ats, ats
    # The local part begins at the first boundary in the run of its characters that ends here.
    other = np.flatnonzero(~LOCAL[b.code])
    opens = other[np.searchsorted(other, ats) - 1] + 1
    bounds = np.append(b.bounds, len(b.code))
    starts = bounds[np.searchsorted(bounds, opens)]
    data = b.code.tobytes()
    spans, last = [], 0
    for at, start in zip(ats.tolist(), starts.tolist()):
        if start < last:
            start = int(bounds[np.searchsorted(bounds, last)])
        if start < at and (m := DOMAIN.match(data, at + 1)):
            last = m.end()
            spans.append((start, last))
    found = np.array(spans, dtype=np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


MATCHERS: dict[str, Callable[[Folded], Spans]] = {
    catalogue.NPI: npi,
    catalogue.EMAIL: email,
    catalogue.US_PHONE: us_phone,
    catalogue.SSN: ssn,
    catalogue.CARD_GROUPED: card_grouped,
    catalogue.CARD_PLAIN: card_plain,
    catalogue.RRN_HYPHEN: rrn_hyphen,
    catalogue.RRN_PLAIN: rrn_plain,
    catalogue.PASSPORT: passport,
    catalogue.PASSPORT_TWO: passport_two,
    catalogue.KR_MOBILE: kr_mobile,
    catalogue.KR_LANDLINE: kr_landline,
    catalogue.KR_INTERNATIONAL: kr_international,
}


# --- checksums -----------------------------------------------------------------------


def _digits(b: Folded, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of each match, as values and as whether they are digits."""
    place = np.arange(int((end - start).max(initial=0)))
    code = b.code[start[:, None] + place]
    digit = DIGIT[code] & (place < (end - start)[:, None])
    return (code & 15) * digit, digit


def _mod10(value: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the digits, every second one from the right doubled, and their number."""
    rank = np.cumsum(digit[:, ::-1], axis=1)[:, ::-1]
    doubled = value * 2 - 9 * (value > 4)
    return np.where(rank % 2 == 0, doubled, value).sum(axis=1, dtype=np.int64), digit.sum(axis=1)


def card_luhn(b: Folded, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total, n = _mod10(*_digits(b, start, end))
    return (n >= 13) & (n <= 19) & (total % 10 == 0)


def npi_luhn(b: Folded, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total, n = _mod10(*_digits(b, start, end))
    # The issuer prefix stands before ten digits: its last one is not doubled.
    prefix = np.array([[int(c) for c in validators.NPI_PREFIX]])
    before, _ = _mod10(prefix, np.ones_like(prefix, dtype=bool))
    return (n == 10) & ((total + before) % 10 == 0)


def rrn_checksum(b: Folded, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    value, digit = _digits(b, start, end)
    rank = np.cumsum(digit, axis=1)
    weight = np.zeros(max(value.shape[1], 13) + 1, dtype=np.int64)
    weight[1:13] = validators.RRN_WEIGHTS
    total = (value * weight[rank]).sum(axis=1, dtype=np.int64)
    closing = (value * (rank == 13)).sum(axis=1, dtype=np.int64)
    return (digit.sum(axis=1) == 13) & ((11 - total % 11) % 10 == closing)


CHECKS: dict[Callable, Callable[[Folded, np.ndarray, np.ndarray], np.ndarray]] = {
    validators.card_luhn: card_luhn,
    validators.npi_luhn: npi_luhn,
    validators.rrn_checksum: rrn_checksum,
}
