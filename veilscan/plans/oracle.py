"""The scan written as plain SQL for another engine, to check Spark's results against.

Shares the rule data with the library but none of its expressions: matches come from a
lazy two-group pattern, overlaps from folds over sorted lists.
"""

from __future__ import annotations

import re

from veilscan.functions.validators import (
    NPI_PREFIX,
    RRN_WEIGHTS,
    card_luhn,
    npi_luhn,
    rrn_checksum,
)
from veilscan.params import ScanParams
from veilscan.rules import SSN, Rule

# No look-ahead in RE2: the same numbers, spelled out.
SSN_RE2 = (
    r"\b(?:00[1-9]|0[1-9]\d|[1-5]\d{2}|6[0-57-9]\d|66[0-57-9]|[78]\d{2})[-\s]?"
    r"(?:0[1-9]|[1-9]\d)[-\s]?(?:000[1-9]|00[1-9]\d|0[1-9]\d{2}|[1-9]\d{3})\b"
)
# RE2 knows ASCII word characters only; other letters become an underscore first.
LETTERS = "[À-ÖØ-öø-ɏͰ-ϿЀ-ӿ가-힣一-龥]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    if pattern == SSN:
        return SSN_RE2
    return re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)


def digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '', 'g')"


def luhn(d: str) -> str:
    n = f"CAST(substr({d}, i, 1) AS INT)"
    return (
        f"(list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE"
        f" WHEN (length({d}) - i) % 2 = 0 THEN {n}"
        f" WHEN {n} > 4 THEN {n} * 2 - 9 ELSE {n} * 2 END)) % 10 = 0)"
    )


def card_sql(d: str) -> str:
    return f"(length({d}) BETWEEN 13 AND 19 AND {luhn(d)})"


def npi_sql(d: str) -> str:
    return f"(length({d}) = 10 AND {luhn(f'({quoted(NPI_PREFIX)} || {d})')})"


def rrn_sql(d: str) -> str:
    total = " + ".join(
        f"CAST(substr({d}, {i}, 1) AS INT) * {w}" for i, w in enumerate(RRN_WEIGHTS, start=1)
    )
    return (
        f"(CASE WHEN length({d}) = 13"
        f" THEN (11 - ({total}) % 11) % 10 = CAST(substr({d}, 13, 1) AS INT) ELSE false END)"
    )


VALIDATOR_SQL = {card_luhn: card_sql, npi_luhn: npi_sql, rrn_checksum: rrn_sql}


def mask_sql(v: str) -> str:
    return (
        f"CASE WHEN length({v}) <= 2 THEN repeat('*', length({v}))"
        f" ELSE substr({v}, 1, 1) || repeat('*', length({v}) - 2) || substr({v}, length({v}), 1) END"
    )


def safe_sql(text: str) -> str:
    return f"regexp_replace({text}, '{LETTERS}', '_', 'g')"


def chunks_sql(source: str, params: ScanParams) -> str:
    size, step = params.chunk_size, params.step
    return (
        f"SELECT id, no, no * {step} AS off, substr(text, no * {step} + 1, {size}) AS t FROM ("
        f"SELECT id, text, unnest(range(0, CASE WHEN length(text) <= {size} THEN 1"
        f" ELSE 1 + CAST(ceil((length(text) - {size}) / {step}.0) AS BIGINT) END)) AS no"
        f" FROM ({source}) WHERE length(text) > 0)"
    )


def matches_sql(source: str, rules: list[Rule]) -> str:
    """``id, off, t, rule_no, s, e`` for ``source`` with ``id, off, t, safe``."""
    per_rule = []
    for rule in rules:
        both = quoted(f"(?is)(.*?)({re2(rule.pattern)})")
        per_rule.append(
            f"SELECT id, off, t, {rule.number} AS rule_no,"
            f" regexp_extract_all(safe, {both}, 1) AS pre, regexp_extract_all(safe, {both}, 2) AS hit"
            f" FROM {source}"
        )
    return (
        "SELECT id, off, t, rule_no, s, s + n AS e FROM ("
        " SELECT id, off, t, rule_no, length(hit[i]) AS n,"
        " CAST(list_sum(list_transform(pre[1:i], lambda x: length(x)))"
        " + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s"
        " FROM (SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM ("
        + " UNION ALL ".join(per_rule)
        + ")))"
    )


def _by_rule(rules: list[Rule], value, otherwise: str) -> str:
    arms = [f" WHEN {r.number} THEN {v}" for r in rules if (v := value(r)) is not None]
    return f"(CASE rule_no{''.join(arms)} ELSE {otherwise} END)" if arms else otherwise


def greedy_sql(source: str, keys: str, hit: str, order: str) -> str:
    """Leftmost-wins fold; ``hit`` is a struct with fields s and e."""
    return (
        f"SELECT {keys}, unnest(kept) AS h FROM (SELECT {keys}, list_reduce("
        f"list([{hit}] ORDER BY {order}), lambda a, x:"
        f" CASE WHEN x[1].s > a[len(a)].e THEN list_concat(a, x) ELSE a END) AS kept"
        f" FROM {source} GROUP BY {keys})"
    )


def scan_ctes(source: str, params: ScanParams | None = None, prefix: str = "") -> str:
    """CTEs ending in ``findings(id, entity_type, confidence, "start", "end", masked_value)``.

    ``source`` selects ``id, text``.
    """
    params = params or ScanParams()
    chosen = [r for r in params.all_rules if params.entities is None or r.entity in params.entities]
    entity = _by_rule(chosen, lambda r: quoted(r.entity), "NULL")
    valid = _by_rule(
        chosen, lambda r: VALIDATOR_SQL[r.validator]("d") if r.validator else None, "true"
    )
    near = _by_rule(
        chosen,
        lambda r: "(" + " OR ".join(f"contains(ctx, {quoted(k)})" for k in r.keywords) + ")"
        if r.keywords
        else None,
        "false",
    )
    # Scores from the base alone: a confirmed hit gains 0.55 up to 0.95, keywords 0.15 up to 0.98.
    base = _by_rule(chosen, lambda r: f"CAST({r.base!r} AS DOUBLE)", "NULL")
    confirmed = _by_rule(chosen, lambda r: "true" if r.validator else None, "false")
    has_words = _by_rule(chosen, lambda r: "true" if r.keywords else None, "false")
    plain = (
        f"least(0.98::DOUBLE, CASE WHEN {confirmed} THEN least(0.95::DOUBLE, {base} + 0.55::DOUBLE) ELSE {base} END)"
    )
    boosted = f"CASE WHEN {has_words} THEN least(0.98::DOUBLE, {plain} + 0.15::DOUBLE) ELSE {plain} END"
    hit = "{'s': s, 'e': e, 'c': c, 'r': rule_no, 'm': m}"
    again = "{'s': s, 'e': e, 'c': c, 'm': m}"
    return f"""
{prefix}chunks AS (SELECT id, off, t, {safe_sql('t')} AS safe FROM ({chunks_sql(source, params)})),
{prefix}matches AS ({matches_sql(prefix + 'chunks', chosen)}),
{prefix}scored AS (
  SELECT id, off, rule_no, s, e, {entity} AS entity_type, {mask_sql('raw')} AS m,
    CASE WHEN {near} THEN {boosted} ELSE {plain} END AS score
  FROM (SELECT *, {digits('raw')} AS d,
          lower(substr(t, greatest(s - 50, 0) + 1, e + 50 - greatest(s - 50, 0))) AS ctx
        FROM (SELECT *, substr(t, s + 1, e - s) AS raw FROM {prefix}matches))
  WHERE {valid}),
{prefix}hits AS (SELECT *, round(score, 4) AS c FROM {prefix}scored
  WHERE score >= {params.confidence_threshold}),
{prefix}within AS ({greedy_sql(prefix + 'hits', 'id, off, entity_type', hit, 's, c DESC, rule_no, e')}),
{prefix}placed AS (SELECT id, entity_type, h.s + off AS s, h.e + off AS e, h.c AS c, h.r AS r, h.m AS m
  FROM {prefix}within),
{prefix}across AS ({greedy_sql(prefix + 'placed', 'id, entity_type', again, 's, c DESC, r, e')}),
{prefix}findings AS (SELECT id, entity_type, h.c AS confidence, CAST(h.s AS INT) AS "start",
  CAST(h.e AS INT) AS "end", h.m AS masked_value FROM {prefix}across)"""


def level_sql(score: str, lowest: str = "CLEAN") -> str:
    return (
        f"CASE WHEN {score} >= 0.85 THEN 'CRITICAL' WHEN {score} >= 0.70 THEN 'HIGH'"
        f" WHEN {score} >= 0.50 THEN 'MEDIUM' WHEN {score} > 0 THEN 'LOW' ELSE '{lowest}' END"
    )
