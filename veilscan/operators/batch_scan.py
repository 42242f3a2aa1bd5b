"""The findings of many texts at once, in Arrow and NumPy.

Gives what the expressions in ``scan.py`` give, for rules whose patterns and checks come from the catalogue. Texts are
taken in slices of about ``SLICE`` bytes, their chunks in blocks of about as many characters, so memory is bounded
by these and by the longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Iterator

import numpy as np
import pyarrow as pa

from veilscan.functions.batches import CHECKS, MATCHERS, PAD, Folded, apart, fold_table
from veilscan.params import ScanParams
from veilscan.rules import CONTEXT_WINDOW, Rule

SLICE = 1 << 19
FINDINGS = pa.list_(
    pa.struct(
        [("entity_type", pa.string()), ("confidence", pa.float64()), ("start", pa.int32()), ("end", pa.int32()),
         ("masked_value", pa.string())]
    )
)


def _uncased(word: str) -> bool:
    """Whether text is lower-cased to this word's letters from A-Z (or the two letters like them) only."""
    return bool(word) and all(c.isascii() or c.lower() == c.upper() for c in word)


def in_batches(rules: Sequence[Rule]) -> bool:
    """Whether all rules have a form in NumPy. Patterns and checks of the user's own have none."""
    return all(
        r.pattern in MATCHERS and (r.validator is None or r.validator in CHECKS) and all(map(_uncased, r.keywords))
        for r in rules
    )


class Texts:
    """A slice of texts, end to end."""

    def __init__(self, text: str, start: np.ndarray) -> None:
        self.code_points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        # One more, for the gap behind the last text.
        self.folded = np.append(fold_table()[self.code_points], np.uint8(0))
        self.start = start
        self._lowered: str | None = None
        self._places: dict[str, np.ndarray] = {}

    @property
    def lowered(self) -> str:
        """Lower case as far as keywords go, a character for each one."""
        if self._lowered is None:
            c = self.code_points
            low = np.where((c - np.uint32(65)) < 26, c + np.uint32(32), c)
            low[c == 0x212A] = ord("k")
            self._lowered = low.tobytes().decode("utf-32-le")
        return self._lowered

    def places(self, word: str) -> np.ndarray:
        """Where a keyword begins."""
        if word not in self._places:
            # U+0130 becomes an i and a dot above: it can only close a word.
            lowered = self.lowered
            forms = [word, word[:-1] + "İ"] if word[-1] == "i" and "İ" in lowered else [word]
            found = []
            for form in forms:
                at = lowered.find(form)
                while at >= 0:
                    found.append(at)
                    at = lowered.find(form, at + 1)
            self._places[word] = np.sort(np.array(found, dtype=np.int64))
        return self._places[word]


def _near(texts: Texts, words: Sequence[str], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether a keyword lies within ``[first, last)``."""
    lower = {w.lower() for w in words}
    near = np.zeros(len(first), dtype=bool)
    for word in sorted(w for w in lower if not any(o != w and o in w for o in lower)):
        places = texts.places(word)
        if len(places):
            places = np.append(places, np.iinfo(np.int64).max - len(word))
            near |= places[np.searchsorted(places, first)] + len(word) <= last
    return near


def _join(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


class Scanner:
    """Rules and parameters, and what is done with a slice of texts."""

    def __init__(self, params: ScanParams) -> None:
        self.rules = params.rules
        self.size, self.step = params.chunk_size, params.step
        self.names = sorted({r.entity for r in self.rules})
        self.entity = np.array([self.names.index(r.entity) for r in self.rules], dtype=np.int64)
        # Confidences by rule, without and with a keyword near; NaN is under the threshold.
        reported = [round(r.plain_score, 4) if r.plain_score >= params.confidence_threshold else np.nan for r in self.rules]
        self.scores = np.array([reported, [round(r.context_score, 4) for r in self.rules]]).reshape(2, -1)
        # The better score sorts first.
        better = np.unique(-self.scores[~np.isnan(self.scores)])
        self.rank = np.searchsorted(better, -np.nan_to_num(self.scores))
        self.patterns: dict[str, list[int]] = {}
        self.keywords: dict[tuple[str, ...], list[int]] = {}
        for i, r in enumerate(self.rules):
            self.patterns.setdefault(r.pattern, []).append(i)
            if r.keywords:
                self.keywords.setdefault(tuple(r.keywords), []).append(i)

    def matches(self, b: Folded) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rule, start and end of every confirmed match."""
        rule, start, end = [], [], []
        for pattern, numbers in self.patterns.items():
            s, e = MATCHERS[pattern](b)
            confirmed: dict[Callable | None, np.ndarray] = {None: np.ones(len(s), dtype=bool)}
            for i in numbers if len(s) else ():
                check = self.rules[i].validator
                if check not in confirmed:
                    confirmed[check] = CHECKS[check](b, s, e)
                ok = confirmed[check]
                rule.append(np.full(int(ok.sum()), i, dtype=np.int64))
                start.append(s[ok])
                end.append(e[ok])
        return _join(rule), _join(start), _join(end)

    def chunks(self, texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of chunks: where each begins and ends in ``texts``."""
        n = np.diff(texts.start)
        count = np.where(n > self.size, -(-(n - self.size) // self.step) + 1, n > 0)
        text = np.repeat(np.arange(len(n)), count)
        offset = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * self.step
        first = texts.start[text] + offset
        last = np.minimum(first + self.size, texts.start[text + 1])
        room = np.append(0, np.cumsum(last - first + 1))
        at = 0
        while at < len(first):
            end = max(at + 1, int(np.searchsorted(room, room[at] + SLICE, side="right")) - 1)
            yield first[at:end], last[at:end]
            at = end

    def block(self, texts: Texts, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """Entity, start, end, rule and whether boosted, of the hits in some chunks without overlaps in a chunk."""
        length = last - first
        room = np.append(0, np.cumsum(length + 1))
        begin = room[:-1] + 1
        code = np.zeros(int(room[-1]) + 1 + PAD, dtype=np.uint8)
        if len(first) == 1:
            code[1 : 1 + length[0]] = texts.folded[first[0] : last[0]]
        else:
            source = np.arange(room[-1]) + np.repeat(first - room[:-1], length + 1)
            code[1 : 1 + room[-1]] = texts.folded[source]
            code[begin + length] = 0
        rule, start, end = self.matches(Folded(code))
        chunk = np.searchsorted(begin, start, side="right") - 1
        moved = first[chunk] - begin[chunk]
        boosted = np.zeros(len(rule), dtype=np.int64)
        for words, numbers in self.keywords.items():
            own = np.flatnonzero(np.isin(rule, numbers))
            if len(own):
                c = chunk[own]
                around = np.maximum(start[own] + moved[own] - CONTEXT_WINDOW, first[c])
                behind = np.minimum(end[own] + moved[own] + CONTEXT_WINDOW, last[c])
                boosted[own] = _near(texts, words, around, behind)
        # By entity, start, better score and rule; chunks have a gap between them, so one never touches another.
        span = len(code) + 1
        place = self.entity[rule] * span + start
        order = np.argsort((place * self.rank.size + self.rank[boosted, rule]) * len(self.rules) + rule)
        order = order[~np.isnan(self.scores[boosted, rule])[order]]
        order = order[apart(place[order], place[order] + (end - start)[order], 1)]
        return [x[order] for x in (self.entity[rule], start + moved, end + moved, rule, boosted)]

    def findings(self, texts: Texts) -> pa.ListArray:
        parts = [self.block(texts, *some) for some in self.chunks(texts)]
        entity, start, end, rule, boosted = [_join(x) for x in zip(*parts)] if parts else [_join([])] * 5
        text = np.searchsorted(texts.start, start, side="right") - 1
        if (np.diff(texts.start) > self.size).any():
            # Overlaps across chunks. Texts get a gap, too.
            span = int(texts.start[-1]) + len(texts.start) + 1
            place = entity * span + start + text
            order = np.lexsort((end, rule, self.rank[boosted, rule], place))
            order = order[apart(place[order], (place + end - start)[order], 1)]
            entity, start, end, rule, boosted, text = (x[order] for x in (entity, start, end, rule, boosted, text))
        order = np.lexsort((start, entity, text))
        entity, start, end, rule, boosted, text = (x[order] for x in (entity, start, end, rule, boosted, text))
        fields = [
            pa.array(self.names, pa.string()).take(pa.array(entity)),
            pa.array(self.scores[boosted, rule], pa.float64()),
            pa.array((start - texts.start[text]).astype(np.int32)),
            pa.array((end - texts.start[text]).astype(np.int32)),
            _masked(texts.code_points[start], texts.code_points[end - 1], end - start),
        ]
        rows = pa.StructArray.from_arrays(fields, fields=list(FINDINGS.value_type))
        offsets = np.searchsorted(text, np.arange(len(texts.start))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), rows, type=FINDINGS)


def _masked(first: np.ndarray, last: np.ndarray, n: np.ndarray) -> pa.StringArray:
    """First and last character with stars between; up to two characters: stars only."""
    if (first > 127).any() or (last > 127).any() or (n <= 2).any():
        ends = zip(first.tolist(), last.tolist(), n.tolist())
        return pa.array([chr(a) + "*" * (k - 2) + chr(z) if k > 2 else "*" * k for a, z, k in ends], pa.string())
    offsets = np.append(0, np.cumsum(n)).astype(np.int32)
    data = np.full(offsets[-1], ord("*"), dtype=np.uint8)
    data[offsets[:-1]] = first
    data[offsets[1:] - 1] = last
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(data))


def _slices(column: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
    """The bytes of some texts and where each begins in them; missing texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        own = offsets[at : end + 1] - offsets[at]
        yield (data[int(offsets[at]) : int(offsets[end])].to_pybytes() if own[-1] else b""), own
        at = end


def _decoded(data: bytes, offsets: np.ndarray) -> tuple[Texts, np.ndarray]:
    """The texts of a slice, and which of them are no UTF-8; these are left empty."""
    bad = np.zeros(len(offsets) - 1, dtype=bool)
    try:
        text = data.decode()
    except UnicodeDecodeError:
        texts = []
        for i in range(len(bad)):
            try:
                texts.append(data[offsets[i] : offsets[i + 1]].decode())
            except UnicodeDecodeError:
                texts.append("")
                bad[i] = True
        return Texts("".join(texts), np.append(0, np.cumsum([len(t) for t in texts]))), bad
    if len(text) == len(data):
        return Texts(text, offsets), bad
    begins = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
    return Texts(text, np.append(0, np.cumsum(begins))[offsets]), bad


def findings_of_column(column: pa.Array, scanner: Scanner) -> pa.Array:
    """The findings of each text; none for a missing text, null for one that is no UTF-8."""
    out = []
    for data, offsets in _slices(column):
        texts, bad = _decoded(data, offsets)
        found = scanner.findings(texts)
        if bad.any():
            found = pa.ListArray.from_arrays(found.offsets, found.values, type=FINDINGS, mask=pa.array(bad))
        out.append(found)
    return pa.concat_arrays(out) if out else pa.array([], FINDINGS)


def batch_findings(params: ScanParams) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """The function that a Python worker runs on the texts of a task."""
    scanner = Scanner(params)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield findings_of_column(column, scanner)

    return run
