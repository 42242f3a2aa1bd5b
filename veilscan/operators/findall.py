"""Positional find-all: every non-overlapping match with its place in the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.text import let

# Two Unicode noncharacters. The first marks match edges; where a text happens to
# contain it, the second stands in for it (same length, and no rule can tell them apart).
MARK, STAND_IN = "\uffff", "\ufffe"
FOUND_TYPE = "array<struct<start:int,text:string>>"
# Even, so that every block starts with a gap.
BLOCK = 512


def without_mark(text: Column) -> Column:
    return F.replace(text, F.lit(MARK), F.lit(STAND_IN))


def mark_matches(text: Column, java_pattern: str) -> Column:
    """Text cut at both sides of every match: gap, match, gap, match, ..., gap."""
    return F.split(F.regexp_replace(text, java_pattern, f"{MARK}$0{MARK}"), MARK, -1)


def locate(parts: Column) -> Column:
    """Matches with their places from cut text, as ``array<struct<start, text>>``."""
    start = F.struct(
        F.lit(0).alias("pos"), F.lit(False).alias("inside"), F.array().cast(FOUND_TYPE).alias("found")
    )

    def step(acc: Column, part: Column) -> Column:
        hit = F.struct(acc["pos"].alias("start"), part.alias("text"))
        return F.struct(
            (acc["pos"] + F.length(part)).alias("pos"),
            (~acc["inside"]).alias("inside"),
            F.when(acc["inside"], F.array_append(acc["found"], hit))
            .otherwise(acc["found"])
            .alias("found"),
        )

    return F.aggregate(parts, start, step, lambda acc: acc["found"])


def _locate_in_blocks(parts: Column) -> Column:
    """:func:`locate` for many matches: blocks are located apart, then moved into place.

    Appending to one array copies it each time, so its length has to stay bounded.
    """
    last = F.floor((F.size(parts) - 1) / F.lit(BLOCK)).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), last), lambda b: F.slice(parts, b * BLOCK + 1, F.lit(BLOCK))
    )
    measured = F.transform(
        blocks,
        lambda block: F.struct(
            locate(block).alias("found"),
            F.aggregate(block, F.lit(0), lambda n, part: n + F.length(part)).alias("n"),
        ),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("offsets"))

    def offsets(all_blocks: Column) -> Column:
        return F.aggregate(
            all_blocks,
            zero,
            lambda acc, block: F.struct(
                (acc["at"] + block["n"]).alias("at"),
                F.array_append(acc["offsets"], acc["at"]).alias("offsets"),
            ),
            lambda acc: acc["offsets"],
        )

    def moved(block: Column, offset: Column) -> Column:
        return F.transform(
            block["found"],
            lambda m: F.struct((m["start"] + offset).alias("start"), m["text"].alias("text")),
        )

    return let(measured, lambda m: F.flatten(F.zip_with(m, offsets(m), moved)))


def find_all(text: Column, java_pattern: str) -> Column:
    """All matches as ``array<struct<start, text>>``, positions in characters.

    Spark returns matched strings but not where they are. One pass of the pattern
    puts a mark on both sides of each match; splitting at the mark then alternates
    between gap and match, and lengths add up to positions. Pass text through
    :func:`without_mark` first.
    """
    return let(
        mark_matches(text, java_pattern),
        lambda parts: F.when(F.size(parts) <= BLOCK, locate(parts)).otherwise(
            _locate_in_blocks(parts)
        ),
    )


def find_positions(df: DataFrame, id_col: str, text_col: str, java_pattern: str) -> DataFrame:
    """One row per match over whole texts: ``id_col, start, end, text``."""
    found = find_all(without_mark(F.col(text_col)), java_pattern)
    return df.select(F.col(id_col), F.explode(found).alias("m")).select(
        id_col,
        F.col("m.start").alias("start"),
        (F.col("m.start") + F.length("m.text")).alias("end"),
        F.col("m.text").alias("text"),
    )
