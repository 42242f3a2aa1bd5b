"""Cutting texts into overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.text import let
from veilscan.params import ScanParams

CHUNK_TYPE = "array<struct<off:int,t:string,last:boolean>>"


def chunk_array(text: Column, params: ScanParams) -> Column:
    """Chunks of one text: ``array<struct<off, t, last>>``; empty for an empty text.

    A text that fits one chunk is passed on as it is. A longer one is cut into
    step-long pieces in one pass over its characters; a chunk is then its own piece
    plus the head of the following ones, so the cost stays linear in the text.
    """
    size, step = params.chunk_size, params.step
    following = -(-size // step)

    def cut(pieces: Column) -> Column:
        # A chunk that reaches the end is the last one, even if pieces remain.
        n = F.length(text)
        count = F.greatest(F.lit(1), F.ceil((n - size) / F.lit(step)) + 1).cast("int")
        return let(count, lambda m: chunks(pieces, m))

    def chunks(pieces: Column, count: Column) -> Column:
        return F.transform(
            F.slice(pieces, F.lit(1), count),
            lambda _, i: F.struct(
                (i * step).alias("off"),
                F.substring(F.array_join(F.slice(pieces, i + 1, F.lit(following)), ""), 1, size)
                .alias("t"),
                (i == count - 1).alias("last"),
            ),
        )

    long = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), cut)
    short = F.array(F.struct(F.lit(0).alias("off"), text.alias("t"), F.lit(True).alias("last")))
    n = F.length(text)
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, F.array().cast(CHUNK_TYPE))
        .when(n <= size, short)
        .otherwise(long)
    )


def chunk(df: DataFrame, id_col: str, text_col: str, params: ScanParams | None = None) -> DataFrame:
    """One row per chunk: ``id_col, chunk_no, off, t``. A narrow step, no shuffle."""
    params = params or ScanParams()
    return df.select(
        F.col(id_col), F.posexplode(chunk_array(F.col(text_col), params)).alias("chunk_no", "c")
    ).select(id_col, "chunk_no", "c.off", "c.t")
