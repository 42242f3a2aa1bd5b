"""Chat formatting from every participant's point of view, with built-in expressions only.

Each dialogue is rendered once per participant: that speaker as the assistant, system turns as they are,
everybody else as a named user. ``mask`` has the spans to train on, the assistant's texts with the end
marks after them, in code points of the rendered text.

A dialogue's turns are all its rows, repeated ones too, in the order of turn number (nulls first), role and
MD5 of the text; the number of a turn is its place in that order. It is rendered in parts of ``PART`` turns
each, one row per part: the texts of the parts, put together in order, are the whole, and the spans of all
parts count from the start of the whole, so nothing depends on where parts begin. No row or task grows with
the length of a dialogue: turns are numbered by their place within a range of the sorted rows and the sizes of
the ranges before it, and only figures of parts are brought together.

A null role counts as ``unknown``, a null or empty text as empty. Rows without a conv_id belong to no dialogue:
each is one by itself. A dialogue with system turns only has no participant and no rows. Further columns of
the input are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.common import store

PART = 256
BLOCK = 1_024  # parts added up together
SYSTEM = "system"


OWN_HEAD = "<|assistant|>\n"


def head(role: Column) -> Column:
    """What stands before a turn of somebody else."""
    named = F.concat(F.lit("<|user name="), role, F.lit("|>\n"))
    return F.when(role == SYSTEM, F.lit("<|system|>\n")).otherwise(named)


def body(text: Column) -> Column:
    """The turn itself; a mark inside of it is no mark."""
    return F.concat(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))


def rendered(turns: Column, perspective: Column, base: Column) -> Column:
    """Struct of the text and the mask's spans of one part that begins at ``base``."""

    def turn(t: Column) -> Column:
        own = t["role"] == perspective
        return F.struct(own.alias("own"), F.when(own, OWN_HEAD).otherwise(head(t["role"])).alias("head"), body(t["text"]).alias("body"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        span = F.struct(start.alias("start"), (end - 1).alias("end"))  # without the line's end
        return F.struct(end.alias("at"), F.when(t["own"], F.concat(acc["mask"], F.array(span))).otherwise(acc["mask"]).alias("mask"))

    parts = F.transform(turns, turn)
    none = F.struct(base.alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask"))
    return F.struct(
        F.array_join(F.transform(parts, lambda t: F.concat(t["head"], t["body"])), "").alias("text"),
        F.aggregate(parts, none, step)["mask"].alias("mask"),
    )


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``width`` and ``range``: sorted ranges of about equal size, whatever a dialogue has of them."""
    keyed = rows.select(
        "*",
        F.md5(F.col("text").cast("binary")).alias("digest"),
        F.length(F.concat(head(F.col("role")), body(F.col("text")))).cast("long").alias("width"),
        F.monotonically_increasing_id().alias("copy"),  # deals out repeated rows
    )
    ranges = keyed.repartitionByRange("conv_id", "turn", "role", "digest", "copy").drop("copy")
    return store(ranges.withColumn("range", F.spark_partition_id()), "turns")


def numbered(rows: DataFrame, first: DataFrame) -> DataFrame:
    """``rows`` with the number of each turn in its dialogue, ``no``, and its ``part``."""
    inside = Window.partitionBy("conv_id", "range").orderBy("turn", "role", "digest")
    no = F.col("first") + F.row_number().over(inside) - 1
    done = rows.join(first, ["conv_id", "range"]).withColumn("no", no)
    return done.withColumn("part", F.expr(f"no div {PART}"))


def bases(turns: DataFrame) -> DataFrame:
    """``conv_id, part, perspective, base``: where in the whole each part begins, for each speaker."""
    counts = turns.groupBy("conv_id", "part", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("width").alias("width"))
    counts = store(counts, "counts")
    parts = counts.groupBy("conv_id", "part").agg(F.sum("width").alias("width"))
    named = counts.where(F.col("role") != SYSTEM).withColumnRenamed("role", "perspective")
    speakers = named.select("conv_id", "perspective").distinct()
    each = parts.join(speakers, "conv_id").join(named.select("conv_id", "part", "perspective", "n"), ["conv_id", "part", "perspective"], "left")
    # A speaker's own turns have another head.
    change = F.lit(len(OWN_HEAD)) - F.length(head(F.col("perspective")))
    each = each.withColumn("width", F.col("width") + F.coalesce("n", F.lit(0)) * change).withColumn("block", F.expr(f"part div {BLOCK}"))
    keys = ["conv_id", "perspective", "block"]
    each = store(each.select("part", "width", *keys), "widths")
    before = lambda w: F.coalesce(F.sum("width").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = each.groupBy(*keys).agg(F.sum("width").alias("width"))
    blocks = blocks.select(*keys, before(Window.partitionBy("conv_id", "perspective").orderBy("block")).alias("earlier"))
    each = each.withColumn("inside", before(Window.partitionBy(*keys).orderBy("part")))
    return each.join(blocks, keys).select("conv_id", "part", "perspective", (F.col("earlier") + F.col("inside")).alias("base"))


def perspectives(turns: DataFrame) -> DataFrame:
    """``conv_id, perspective, part, n_turns, text, mask`` of rows ``conv_id, turn, role, text``."""
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ranges = placed(rows.where(F.col("conv_id").isNotNull()))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = ranges.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    first = first.select("conv_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    begin = bases(numbered(ranges.drop("text"), first))
    # At most PART turns come together in a row.
    one = F.struct("no", "role", "text")
    parts = numbered(ranges, first).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    lone = rows.where(F.col("conv_id").isNull() & (F.col("role") != SYSTEM)).select(
        "conv_id",
        F.lit(0).cast("long").alias("part"),
        F.array(F.struct(F.lit(0).cast("long").alias("no"), "role", "text")).alias("turns"),
        F.col("role").alias("perspective"),
        F.lit(0).cast("long").alias("base"),
    )
    every = parts.join(begin, ["conv_id", "part"]).select("conv_id", "part", "turns", "perspective", "base").unionByName(lone)
    r = rendered(F.col("turns"), F.col("perspective"), F.col("base")).alias("r")
    done = every.select("conv_id", "perspective", "part", F.size("turns").cast("long").alias("n_turns"), r)
    return done.select("conv_id", "perspective", "part", "n_turns", F.col("r.text").alias("text"), F.col("r.mask").alias("mask"))


def listed(turns: DataFrame) -> DataFrame:
    """``perspectives`` with the spans as a text."""
    done = perspectives(turns)
    spans = F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return done.select("conv_id", "perspective", "part", "n_turns", "text", F.array_join(spans, ",").alias("mask"))


LISTED_SQL = """
WITH d AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
                  CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM conversations),
     r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST, role, md5(text)) - 1 AS no FROM d),
     s AS (SELECT DISTINCT conv_id, lone, role AS perspective FROM r WHERE role <> 'system'),
     t AS (SELECT r.*, no // 256 AS part, s.perspective, r.role = s.perspective AS own,
                  CASE WHEN r.role = s.perspective THEN '<|assistant|>' || chr(10)
                       WHEN r.role = 'system' THEN '<|system|>' || chr(10)
                       ELSE '<|user name=' || r.role || '|>' || chr(10) END AS head,
                  replace(r.text, '<|', '< |') || '<|end|>' || chr(10) AS body
           FROM r JOIN s ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.lone IS NOT DISTINCT FROM s.lone),
     o AS (SELECT *, sum(length(head) + length(body)) OVER (
                  PARTITION BY conv_id, lone, perspective ORDER BY no) AS till FROM t)
SELECT conv_id, perspective, part, count(*) AS n_turns,
       string_agg(head || body, '' ORDER BY no) AS text,
       coalesce(string_agg(CAST(till - length(body) AS BIGINT) || ':' || CAST(till - 1 AS BIGINT), ',' ORDER BY no) FILTER (own), '') AS mask
FROM o GROUP BY conv_id, lone, part, perspective
"""
