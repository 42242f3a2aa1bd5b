"""The scan: text in, masked and scored findings out.

Everything up to the findings of one text is computed from that text's row, so
a scan is one narrow stage: no shuffle, no window, nothing gathered. Reports that need
only per-file figures read them off the row as well.

Rules of the catalogue are looked for in many texts at once (``batch_scan.py``); rules of the
user's own, and texts that are no UTF-8, by the expressions here.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.regex import to_java
from veilscan.functions.text import contains_any, context_of, has_content, let, mask
from veilscan.operators.batch_scan import batch_findings, in_batches
from veilscan.operators.chunks import chunk_array
from veilscan.operators.dedup import dedup_intervals
from veilscan.operators.findall import locate, mark_matches, without_mark
from veilscan.params import ScanParams
from veilscan.rules import CONTEXT_WINDOW, Rule
from veilscan.sources.workspace import save_table, small_batches

# Field order is the order of precedence: sorting hits sorts by entity and start first,
# then the higher confidence, the earlier rule and the shorter hit.
HIT_TYPE = (
    "struct<entity_type:string,start:int,neg:double,rule_no:int,end:int,"
    "masked_value:string,edge:boolean>"
)
FINDING_TYPE = (
    "struct<entity_type:string,confidence:double,start:int,end:int,masked_value:string>"
)


def _no_hits() -> Column:
    return F.array().cast(f"array<{HIT_TYPE}>")


def _case(rule: Column, rules: Sequence[Rule], key, branch, otherwise: Column) -> Column:
    """``CASE`` over the rule's index with one arm per distinct non-empty ``key``."""
    arms: dict = {}
    for i, r in enumerate(rules):
        if key(r):
            arms.setdefault(key(r), []).append(i)
    out = F
    for value, numbers in arms.items():
        out = out.when(rule.isin(numbers), branch(value))
    return out.otherwise(otherwise) if arms else otherwise


def _per_rule(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _matches(text: Column, rules: Sequence[Rule]) -> Column:
    """Confirmed matches as ``array<struct<rule, start, text>>``; ``rule`` is an index.

    Rules that share a pattern share its pass over the text, and the part that turns
    marked text into positions appears once in the plan, not once per rule.
    """
    digit_run = f"{to_java(r'\d')}{{4}}"

    def marked(p: Column) -> Column:
        guards = {"digits": p["digits"], "@": p["at"]}
        by_pattern: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            by_pattern.setdefault(r.pattern, []).append(i)
        passes = []
        for numbers in by_pattern.values():
            first = rules[numbers[0]]
            parts = mark_matches(p["t"], to_java(first.pattern, first.opens))
            if first.needs:
                parts = F.when(guards[first.needs], parts)
            passes.append(F.struct(_per_rule(numbers).alias("rules"), parts.alias("parts")))
        return F.array(*passes)

    prepared = F.struct(
        without_mark(text).alias("t"),
        text.rlike(digit_run).alias("digits"),
        F.contains(text, F.lit("@")).alias("at"),
    )
    with_hits = F.filter(
        let(prepared, marked), lambda x: F.coalesce(F.size(x["parts"]), F.lit(0)) > 1
    )

    def placed(x: Column) -> Column:
        return F.flatten(
            F.transform(
                x["rules"],
                lambda rule: F.transform(
                    locate(x["parts"]),
                    lambda m: F.struct(
                        rule.alias("rule"), m["start"].alias("start"), m["text"].alias("text")
                    ),
                ),
            )
        )

    found = F.flatten(F.transform(with_hits, placed))
    if all(r.validator is None for r in rules):
        return found
    return F.filter(
        found,
        lambda m: _case(
            m["rule"], rules, lambda r: r.validator, lambda v: v(m["text"]), F.lit(True)
        ),
    )


def chunk_hits(text: Column, rules: Sequence[Rule], threshold: float) -> Column:
    """All scored hits of all rules in one chunk, before overlaps are removed."""
    if not rules:
        return _no_hits()
    # Confidences are negated so that the better hit sorts first.
    plain = [-round(r.plain_score, 4) if r.plain_score >= threshold else None for r in rules]
    boosted = [-round(r.context_score, 4) for r in rules]

    def near_keyword(rule: Column, context: Column) -> Column:
        return _case(
            rule,
            rules,
            lambda r: r.keywords,
            lambda ks: contains_any(context, ks),
            F.lit(False),
        )

    def hits(matches: Column, any_keyword: Column | None) -> Column:
        def hit(m: Column) -> Column:
            end = m["start"] + F.length(m["text"])
            score = _per_rule(plain).cast("array<double>")[m["rule"]]
            if any_keyword is not None:
                near = let(
                    context_of(text, m["start"], end, CONTEXT_WINDOW),
                    lambda context: near_keyword(m["rule"], context),
                )
                score = F.when(any_keyword & near, _per_rule(boosted)[m["rule"]]).otherwise(score)
            return F.struct(
                _per_rule([r.entity for r in rules])[m["rule"]].alias("entity_type"),
                m["start"].alias("start"),
                score.alias("neg"),
                m["rule"].alias("rule_no"),
                end.alias("end"),
                mask(m["text"]).alias("masked_value"),
                F.lit(False).alias("edge"),
            )

        scored = F.transform(matches, hit)
        return F.filter(scored, lambda h: h["neg"].isNotNull()) if None in plain else scored

    if not any(r.keywords for r in rules):
        return hits(_matches(text, rules), None)
    # Most chunks hold no keyword at all, and a test per chunk and list of keywords tells. Only the lists of
    # rules with matches are looked for: each word is a pass over the chunk.
    lists: dict[tuple[str, ...], list[int]] = {}
    for i, r in enumerate(rules):
        if r.keywords:
            lists.setdefault(r.keywords, []).append(i)

    def matched(m: Column, numbers: list[int]) -> Column:
        return F.exists(m, lambda x: x["rule"].isin(numbers))

    def any_of(m: Column) -> Column:
        return let(
            F.lower(text),
            lambda t: reduce(
                lambda a, b: a | b,
                [matched(m, numbers) & contains_any(t, ks) for ks, numbers in lists.items()],
            ),
        )

    return let(
        _matches(text, rules),
        lambda m: let(
            F.when(F.size(m) > 0, any_of(m)).otherwise(False),
            lambda any_keyword: hits(m, any_keyword),
        ),
    )


def drop_overlaps(hits: Column) -> Column:
    """Leftmost wins per entity; touching counts as overlapping.

    In order of (entity, start, best first) a hit stays iff it starts after the end of
    the last one kept, because the ends of kept hits only grow.
    """
    start = F.struct(
        F.lit("").alias("entity_type"), F.lit(-1).alias("end"), _no_hits().alias("kept")
    )

    def step(acc: Column, h: Column) -> Column:
        stays = (acc["entity_type"] != h["entity_type"]) | (h["start"] > acc["end"])
        return F.when(
            stays,
            F.struct(
                h["entity_type"].alias("entity_type"),
                h["end"].alias("end"),
                F.array_append(acc["kept"], h).alias("kept"),
            ),
        ).otherwise(acc)

    return F.aggregate(F.array_sort(hits), start, step, lambda acc: acc["kept"])


def _placed(c: Column, hits: Column, params: ScanParams) -> Column:
    """Move chunk hits to text positions and mark those that reach another chunk."""
    reaches_back = lambda h: (c["off"] > 0) & (h["start"] <= params.chunk_overlap)
    reaches_on = lambda h: ~c["last"] & (h["end"] >= params.step)
    return F.transform(
        hits,
        lambda h: F.struct(
            h["entity_type"].alias("entity_type"),
            (h["start"] + c["off"]).alias("start"),
            h["neg"].alias("neg"),
            h["rule_no"].alias("rule_no"),
            (h["end"] + c["off"]).alias("end"),
            h["masked_value"].alias("masked_value"),
            (reaches_back(h) | reaches_on(h)).alias("edge"),
        ),
    )


def _by_boundary(chunks: Column, params: ScanParams) -> Column:
    """Edge hits listed by boundary: those that reach on from one chunk, and those that reach back from the next."""

    def reaches_back(h: Column, i: Column) -> Column:
        return (i > 0) & (h["start"] - i * params.step <= params.chunk_overlap)

    back = F.transform(chunks, lambda hits, i: F.filter(hits, lambda h: h["edge"] & reaches_back(h, i)))
    on = F.transform(chunks, lambda hits, i: F.filter(hits, lambda h: h["edge"] & ~reaches_back(h, i)))
    at = lambda lists, i: F.coalesce(F.get(lists, i), _no_hits())
    both = lambda b, o: F.transform(F.sequence(F.lit(0), F.size(b)), lambda i: F.concat(at(o, i - 1), at(b, i)))
    return let(back, lambda b: let(on, lambda o: both(b, o)))


def _apart(edges: Column, params: ScanParams) -> Column:
    """Edge hits of a text, listed by boundary, without overlaps.

    A hit reaches a bounded number of boundaries on. Wherever no hit of the ones before touches one that
    follows, a run ends. Runs are folded one by one: a fold copies what it has kept, and over
    a whole text it would do so for every hit.
    """
    reach = -(-params.chunk_size // params.step) + 1
    spans = F.transform(
        edges,
        lambda hits: F.struct(
            F.array_min(F.transform(hits, lambda h: h["start"])).alias("first"),
            F.array_max(F.transform(hits, lambda h: h["end"])).alias("last"),
        ),
    )

    def ends_before(s: Column, i: Column) -> Column:
        earlier = F.slice(s, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)))
        later = F.slice(s, i + 1, F.lit(reach))
        last = F.array_max(F.transform(earlier, lambda x: x["last"]))
        return F.coalesce(last < F.array_min(F.transform(later, lambda x: x["first"])), F.lit(True))

    def runs(s: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(edges) - 1), lambda i: ends_before(s, i))
        return let(heads, lambda h: F.flatten(F.transform(h, lambda a, k: run(a, F.coalesce(F.get(h, k + 1), F.size(edges))))))

    def run(a: Column, b: Column) -> Column:
        return drop_overlaps(F.flatten(F.slice(edges, a + 1, b - a)))

    return let(spans, runs)


def findings_of(text: Column, params: ScanParams | None = None) -> Column:
    """Findings of one text as ``array<struct<entity_type, confidence, start, end, masked_value>>``."""
    params = params or ScanParams()
    rules = params.rules
    per_chunk = F.transform(
        chunk_array(text, params),
        lambda c: _placed(
            c, drop_overlaps(chunk_hits(c["t"], rules, params.confidence_threshold)), params
        ),
    )

    def across(chunks: Column) -> Column:
        # Hits within one chunk are already apart, and one that reaches no other chunk
        # meets no hit of another: only those at chunk edges can still overlap.
        inner = F.flatten(F.transform(chunks, lambda hits: F.filter(hits, lambda h: ~h["edge"])))
        return F.concat(inner, let(_by_boundary(chunks, params), lambda e: _apart(e, params)))

    merged = F.when(
        F.length(text) <= params.chunk_size, F.flatten(per_chunk)
    ).otherwise(let(per_chunk, across))
    findings = F.transform(
        merged,
        lambda h: F.struct(
            h["entity_type"].alias("entity_type"),
            (-h["neg"]).alias("confidence"),
            h["start"].alias("start"),
            h["end"].alias("end"),
            h["masked_value"].alias("masked_value"),
        ),
    )
    return F.when(has_content(text), findings).otherwise(F.array().cast(f"array<{FINDING_TYPE}>"))


@lru_cache(maxsize=32)
def _cached_findings(text_col: str, params: ScanParams, session: str) -> Column:
    text = F.col(text_col)
    expression = findings_of(text, params)
    if not params.rules or not in_batches(params.rules):
        return expression
    in_python = F.arrow_udf(batch_findings(params), f"array<{FINDING_TYPE}>")
    # Null for a text that is no UTF-8.
    return F.coalesce(in_python(text), expression)


def _findings(df: DataFrame, text_col: str, params: ScanParams | None) -> Column:
    """The scan expression, built once per session for each column and set of parameters."""
    small_batches(df.sparkSession)
    session = df.sparkSession.sparkContext.applicationId
    return _cached_findings(text_col, params or ScanParams(), session)


def scan_rows(df: DataFrame, text_col: str, params: ScanParams | None = None) -> DataFrame:
    """``df`` with its text replaced by ``total_chars`` and ``findings`` (an array).

    The two leave as the output of a generator with exactly one row: filters on them stay
    above it, where a plain projection would let them push a second scan into the filter.
    """
    result = F.struct(
        F.coalesce(F.length(text_col), F.lit(0)).alias("total_chars"),
        _findings(df, text_col, params).alias("findings"),
    )
    return df.select(*[c for c in df.columns if c != text_col], F.inline(F.array(result)))


def scan(
    df: DataFrame, id_col: str | Sequence[str], text_col: str, params: ScanParams | None = None
) -> DataFrame:
    """One row per finding: the id columns and the finding's fields."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    found = F.explode(_findings(df, text_col, params)).alias("f")
    return df.select(*ids, found).select(*ids, "f.*")


def scan_long_texts(
    df: DataFrame, id_col: str, text_col: str, params: ScanParams | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """The findings of :func:`scan`, with the chunks of each text dealt out to all tasks.

    For tables of few, very long texts, where a row is too much work for one task. Only
    hits at chunk edges are shuffled by text; ids must be unique.
    """
    params = params or ScanParams()
    rules = params.rules
    pieces = df.where(has_content(F.col(text_col))).select(
        id_col, F.posexplode(chunk_array(F.col(text_col), params)).alias("no", "c")
    )
    keys = [id_col, "no"]
    dealt = pieces.repartition(partitions, *keys) if partitions else pieces.repartition(*keys)
    per_chunk = _placed(
        F.col("c"),
        drop_overlaps(chunk_hits(F.col("c.t"), rules, params.confidence_threshold)),
        params,
    )
    hits = save_table(
        dealt.select(id_col, F.explode(per_chunk).alias("h")).select(id_col, "h.*"), "hits"
    )
    across = dedup_intervals(
        hits.where("edge"), [id_col, "entity_type"], best_first=[F.col("neg"), F.col("rule_no")]
    )
    return (
        hits.where("not edge")
        .unionByName(across)
        .select(
            id_col, "entity_type", (-F.col("neg")).alias("confidence"), "start", "end", "masked_value"
        )
    )
