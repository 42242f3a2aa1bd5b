"""The scan as a plain single-process Python loop: yardstick for results and speed."""

from __future__ import annotations

import re
import unicodedata

from veilscan.functions.validators import NPI_PREFIX, RRN_WEIGHTS, card_luhn, npi_luhn, rrn_checksum
from veilscan.params import ScanParams


def mod10(digits: list[int]) -> bool:
    doubled = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def digits_of(text: str) -> list[int]:
    return [unicodedata.decimal(c) for c in text if unicodedata.category(c) == "Nd"]


CHECKS = {
    card_luhn: lambda d: 13 <= len(d) <= 19 and mod10(d),
    npi_luhn: lambda d: len(d) == 10 and mod10([int(c) for c in NPI_PREFIX] + d),
    rrn_checksum: lambda d: len(d) == 13
    and (11 - sum(a * b for a, b in zip(d, RRN_WEIGHTS)) % 11) % 10 == d[12],
}


def thin_out(hits):
    """Hits are (entity, start, -confidence, rule, end, mask)."""
    kept, reach = [], {}
    for h in sorted(hits):
        if h[1] > reach.get(h[0], -1):
            kept.append(h)
            reach[h[0]] = h[4]
    return kept


def compile_rules(params: ScanParams):
    return [
        (r, re.compile(r.pattern, re.IGNORECASE), [k.lower() for k in r.keywords])
        for r in params.all_rules
        if params.entities is None or r.entity in params.entities
    ]


def scan_text(text: str, params: ScanParams, compiled=None):
    """Findings as (entity, confidence, start, end, masked)."""
    if not text or text.isspace():
        return []
    everything, offset = [], 0
    while True:
        piece = text[offset : offset + params.chunk_size]
        hits = []
        for rule, pattern, words in compiled or compile_rules(params):
            for m in pattern.finditer(piece):
                value = m.group()
                if rule.validator and not CHECKS[rule.validator](digits_of(value)):
                    continue
                around = piece[max(m.start() - 50, 0) : m.end() + 50].lower()
                near = any(w in around for w in words)
                score = rule.context_score if near else rule.plain_score
                if score < params.confidence_threshold:
                    continue
                stars = len(value) - 2
                masked = value[0] + "*" * stars + value[-1] if stars > 0 else "*" * len(value)
                hits.append((rule.entity, m.start(), -round(score, 4), rule.number, m.end(), masked))
        everything += [
            (e, s + offset, c, r, end + offset, m) for e, s, c, r, end, m in thin_out(hits)
        ]
        if offset + params.chunk_size >= len(text):
            break
        offset += params.step
    return sorted((e, -c, s, end, m) for e, s, c, _, end, m in thin_out(everything))
