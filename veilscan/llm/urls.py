"""URL filters: rules first, and for all other urls a tree of path templates per host with labelled purity.

*Tree.* A host's urls start in its root and go down one path segment a level. A node of fewer than ``least`` urls is
not split: its urls end in ``/**``. In any other node each next segment is a branch; it keeps its text only if it
differs from all its siblings together, or has none. Two groups of urls differ when one of four shares does by more
than Hoeffding's bound for groups of their sizes: labelled bad, labelled good, path ends here, next segment has a
digit. All other branches are merged to one, written ``*``. So identifiers, each seen a few times, become a wildcard,
and so do words that lead to the same kind of pages, while a section with labels of its own stays apart. The tree
grows level by level, one stored table each, until no url is open; it has no greatest depth.

*Purity.* A template's purity is ``(bad + smooth / 2) / (labelled + smooth)``; it is rejected at ``purity`` or more. A
template without labels is at one half and passes.

*Rules* are a short list of the caller's, (verdict, host, path). A rule fits its host and all subdomains if the path
starts with its path. The longest wins; of equally long ones block wins. Urls that a rule decides are labels of the
tree; further ones may be given as a table.

A url without ``://``, or none, has an empty host and path; these are one host like others. Every row is judged by
itself, so repeated rows get repeated verdicts. An empty table gives no rows. Extra columns are not looked at. Counts
per branch are added up per task before they are shuffled, so neither a hot host nor a hot branch gathers in a task;
branches that are seen once are dropped before the test, which they cannot pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = "(?s)^.*?://([^/?#]*)([^?#]*)"

BLOCK, ALLOW = "block", "allow"
RULES = [(BLOCK, "net", "/"), (ALLOW, "example.net", "/en/"), (BLOCK, "example.com", "/de/"), (ALLOW, "org", "/fr/")]


@dataclass(frozen=True)
class Filter:
    """``bound`` is sqrt(ln(2 / a) / 2) for a chance of error a (1.36: one in twenty); purity is ``num / den``."""

    least: int = 8
    bound: float = 1.36
    smooth: int = 4
    num: int = 4
    den: int = 5


def located(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    host, path = (F.coalesce(F.regexp_extract(url, URL, group), F.lit("")) for group in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def ordered(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != BLOCK, r[1] + r[2]))


def chosen(rules: list[tuple[str, str, str]], value) -> Column:
    """``value(rule)`` of the rule that decides ``host`` and ``path``, null without one."""
    out = F.lit(None).cast("string")
    for rule in reversed(ordered(rules)):
        _, host, path = rule
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        out = F.when(fits & F.col("path").startswith(path), F.lit(value(rule))).otherwise(out)
    return out


def with_rules(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``page_id, host, path, rule, ruled``: the rule and its verdict."""
    host, path = located(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    return rows.withColumns({"rule": chosen(rules, lambda r: r[1] + r[2]), "ruled": chosen(rules, lambda r: r[0])})


def counted(ruled: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``host, path, n, bad, good``: all urls with their labels. ``labels`` has ``url, bad``; null labels say nothing."""
    one = lambda c: F.coalesce(c.cast("long"), F.lit(0))
    rows = ruled.select("host", "path", F.lit(1).alias("n"), one(F.col("ruled") == BLOCK).alias("bad"), one(F.col("ruled") == ALLOW).alias("good"))
    if labels is not None:
        host, path = located(F.col("url"))
        more = labels.select(host.alias("host"), path.alias("path"), F.lit(0).alias("n"), one(F.col("bad")).alias("bad"), one(~F.col("bad")).alias("good"))
        rows = rows.unionByName(more)
    return rows.groupBy("host", "path").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")])


#: What two groups of urls are compared by.
SHARES = ("bad", "good", "ends", "digit")


def level(rows: DataFrame, f: Filter) -> tuple[DataFrame, DataFrame]:
    """One level down: rows that have got their template, and rows that are still open.

    ``rows``: ``host, path, n, bad, good, node``, and ``rest``, the segments below the node.
    """
    at = ["host", "node"]
    more = F.size("rest") > 0
    weighed = {
        "ends": F.when(F.size("rest") == 1, F.col("n")).otherwise(0),
        "digit": F.when(F.get("rest", F.lit(1)).rlike("[0-9]"), F.col("n")).otherwise(0),
    }
    rows = rows.withColumn("seg", F.get("rest", F.lit(0)))
    seen = rows.withColumns(weighed).select(*at, "seg", "n", *SHARES)
    sums = [F.sum(c).alias(c) for c in ("n", *SHARES)]
    children = seen.where("seg IS NOT NULL").groupBy(*at, "seg").agg(*sums)
    total = F.sum("n").alias("total")
    inner = [F.coalesce(F.sum(F.when(F.col("seg").isNotNull(), F.col(c))), F.lit(0)).alias(f"all_{c}") for c in ("n", *SHARES)]
    nodes = seen.groupBy(*at).agg(total, *inner).where(F.col("total") >= f.least)
    n, others = F.col("n"), F.col("all_n") - F.col("n")
    bound = F.lit(f.bound) * (1 / F.sqrt(n.cast("double")) + 1 / F.sqrt(others.cast("double")))
    differs = F.lit(False)
    for c in SHARES:
        differs |= F.abs(F.col(c) / n - (F.col(f"all_{c}") - F.col(c)) / others) > bound
    own = F.when(others == 0, F.lit(True)).otherwise(differs)
    kept = children.where("n > 1").join(nodes, at).where(own).select(*at, "seg", F.lit(True).alias("kept"))
    rows = rows.join(nodes.select(*at, "total"), at, "left").join(kept, [*at, "seg"], "left")
    rows = rows.withColumns({"split": F.col("total").isNotNull() & more, "segment": F.when(F.col("kept"), F.col("seg")).otherwise("*")})
    columns = ["host", "path", "n", "bad", "good"]
    rows = store(
        rows.select(
            *columns, "split",
            F.when(F.col("split"), F.concat("node", F.lit("/"), "segment")).when(F.col("total").isNull(), F.concat("node", F.lit("/**"))).otherwise(F.col("node")).alias("node"),
            F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0))).alias("rest"),
        ),
        "level",
    )
    closed = rows.where(~F.col("split")).select(*columns, F.col("node").alias("template"))
    return closed, rows.where("split").drop("split")


def tree(counts: DataFrame, f: Filter) -> DataFrame:
    """``host, path, n, bad, good, template`` of all paths."""
    rest = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split(F.expr("substring(path, 2)"), "/"))
    rows = store(counts.withColumns({"node": F.lit(""), "rest": rest}), "paths")
    done, rows = level(rows, f)
    while not rows.isEmpty():
        closed, rows = level(rows, f)
        done = done.unionByName(closed)
    return done


def templates(placed: DataFrame, f: Filter) -> DataFrame:
    """``host, template, n, bad, good, rejected``: the templates of a tree."""
    sums = placed.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")])
    rejected = f.den * (2 * F.col("bad") + f.smooth) >= 2 * f.num * (F.col("bad") + F.col("good") + f.smooth)
    return sums.withColumn("rejected", rejected)


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labels: DataFrame | None = None, f: Filter = Filter()) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages`` (``page_id, url``)."""
    ruled = with_rules(pages, rules)
    placed = tree(counted(ruled, labels), f)
    rejected = templates(placed, f).where("rejected").select("host", "template")
    paths = placed.join(rejected, ["host", "template"], "left_semi").select("host", "path", F.lit(BLOCK).alias("template_verdict"))
    verdict = F.coalesce("ruled", "template_verdict", F.lit(ALLOW)).alias("verdict")
    return ruled.join(paths, ["host", "path"], "left").select("page_id", "host", "path", "rule", verdict)


def judged_sql(f: Filter = Filter(), depth: int = 6) -> str:
    """The same for the query's rules; ``depth`` levels are written out, more than any path of its table has."""
    host, path = (f"coalesce(regexp_extract(url, '{URL}', {g}), '')" for g in (1, 2))
    fits = [(f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')", v, h + p) for v, h, p in ordered(RULES)]
    case = lambda k: "CASE " + " ".join(f"WHEN {x[0]} THEN '{x[k]}'" for x in fits) + " END"
    sql = f"""
WITH u AS (SELECT page_id, translate({host}, '{UPPER}', '{LOWER}') AS host, {path} AS path FROM pages),
r AS (SELECT *, {case(2)} AS rule, {case(1)} AS ruled FROM u),
l0 AS (SELECT host, path, count(*) AS n, count_if(ruled = 'block') AS bad, count_if(ruled = 'allow') AS good, '' AS node, true AS split,
              CASE WHEN path = '' THEN [] ELSE string_split(path[2:], '/') END AS rest FROM r GROUP BY host, path)"""
    for k in range(1, depth + 1):
        differs = " OR ".join(f"abs(c.{x} / c.n - (m.{x} - c.{x}) / (m.n - c.n)) > {f.bound}::DOUBLE * (1 / sqrt(c.n) + 1 / sqrt(m.n - c.n))" for x in SHARES)
        sums = ", ".join(f"sum({x}) FILTER (seg IS NOT NULL) AS {x}" for x in ("n", *SHARES))
        sql += f""",
s{k} AS (SELECT host, path, n, bad, good, node, rest, rest[1] AS seg, CASE WHEN len(rest) = 1 THEN n ELSE 0 END AS ends,
                CASE WHEN regexp_matches(rest[2], '[0-9]') THEN n ELSE 0 END AS digit FROM l{k - 1} WHERE split),
m{k} AS (SELECT host, node, sum(n) AS total, {sums} FROM s{k} GROUP BY host, node HAVING sum(n) >= {f.least}),
c{k} AS (SELECT host, node, seg, {", ".join(f"sum({x}) AS {x}" for x in ("n", *SHARES))} FROM s{k} WHERE seg IS NOT NULL GROUP BY host, node, seg),
k{k} AS (SELECT c.host, c.node, c.seg FROM c{k} c JOIN m{k} m USING (host, node) WHERE c.n > 1 AND CASE WHEN m.n = c.n THEN true ELSE {differs} END),
l{k} AS (SELECT s.host, s.path, s.n, s.bad, s.good, total IS NOT NULL AND len(s.rest) > 0 AS split,
                CASE WHEN total IS NULL THEN s.node || '/**' WHEN len(s.rest) = 0 THEN s.node WHEN k.seg IS NULL THEN s.node || '/*' ELSE s.node || '/' || s.seg END AS node,
                s.rest[2:] AS rest
         FROM s{k} s LEFT JOIN m{k} m USING (host, node) LEFT JOIN k{k} k ON k.host = s.host AND k.node = s.node AND k.seg = s.seg)"""
    placed = " UNION ALL ".join(f"SELECT host, path, bad, good, node FROM l{k} WHERE NOT split" for k in range(1, depth + 1))
    return f"""{sql},
p AS ({placed}),
t AS (SELECT host, node FROM p GROUP BY host, node
      HAVING {f.den} * (2 * sum(bad) + {f.smooth}) >= {2 * f.num} * (sum(bad) + sum(good) + {f.smooth})),
b AS (SELECT p.host, p.path FROM p JOIN t USING (host, node))
SELECT page_id, r.host, r.path, rule, coalesce(ruled, CASE WHEN b.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM r LEFT JOIN b ON b.host = r.host AND b.path = r.path
"""
