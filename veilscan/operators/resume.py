"""Incremental rescans: what to reuse, what to scan, and keeping the newest state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT_COLUMNS = ("total_chars", "findings", "error")


def timed(rows: DataFrame) -> DataFrame:
    """``rows`` with an unknown modification time as ''."""
    return rows.withColumn("modified_time", F.coalesce("modified_time", F.lit("")))


def _usable(cache: DataFrame, columns: Sequence[str]) -> DataFrame:
    return timed(cache).select("file_id", "modified_time", *columns)


def cached_results(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose cached result still holds: same id, same modification time.

    File metadata comes from the listing, the result (errors included) from the cache.
    """
    hits = timed(files).join(_usable(cache, RESULT_COLUMNS), ["file_id", "modified_time"])
    return hits.withColumns(
        {
            "total_chars": F.coalesce("total_chars", F.lit(0)),
            "findings": F.coalesce("findings", F.array().cast(cache.schema["findings"].dataType)),
        }
    )


def files_to_scan(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files that are new or whose modification time differs from the cached one."""
    return timed(files).join(_usable(cache, ()), ["file_id", "modified_time"], "left_anti")


def pick_changed(texts: DataFrame, known: DataFrame | None) -> DataFrame:
    """Texts whose newest version is not among ``known`` (``file_id, modified_time``).

    Nothing known (None) and no file twice: these are all texts. An unknown time counts as ''.
    The choice is made on keys alone. Texts meet only the keys chosen: where few have
    changed these are small enough to be broadcast, and no text is shuffled.
    """
    texts = timed(texts)
    keys = texts.select("file_id", "modified_time")
    if known is None:
        if keys.groupBy("file_id").count().where("count > 1").isEmpty():
            return texts
        known = keys.where("false")
    versions = newest(keys, ["file_id"], F.col("modified_time"))
    return texts.join(files_to_scan(versions, known), ["file_id", "modified_time"], "left_semi")


def newest(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Last row per key. Older ones are dropped map-side, before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    if len(rest) == 1:
        return rows.groupBy(*keys).agg(F.max_by(rest[0], order).alias(rest[0])).select(*rows.columns)
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_b"))
    return best.select(
        *[F.col(c) if c in keys else F.col("_b")[c].alias(c) for c in rows.columns]
    )


def upsert(old: DataFrame, new: DataFrame, key: str = "file_id") -> DataFrame:
    """``old`` with every key of ``new`` replaced by the rows of ``new``.

    Serves both state tables: one row per file, or all findings of a file, where the
    keys to replace are those of the new results rather than of the new findings.
    """
    return replace_keys(old, new, new.select(key), key)


def replace_keys(old: DataFrame, new: DataFrame, replaced: DataFrame, key: str) -> DataFrame:
    return old.join(replaced.select(key).distinct(), key, "left_anti").unionByName(
        new, allowMissingColumns=True
    )
