"""File inventory: folder trees, owners, users and files shared between users."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.params import FOLDER_MIME, ScanParams
from veilscan.sources.workspace import save_table

# Stand-ins for missing names.
NO_OWNER = "Shared Drive / External"
OWNER_WITHOUT_EMAIL = "Unknown"
ROOT_ID, ROOT_NAME = "root", "My Drive"


def owner_of(owners: Column) -> Column:
    """E-mail of the first owner, with stand-ins for no owner and no e-mail."""
    return F.when(
        F.coalesce(F.size(owners), F.lit(0)) > 0,
        F.coalesce(F.get(owners, 0)["emailAddress"], F.lit(OWNER_WITHOUT_EMAIL)),
    ).otherwise(F.lit(NO_OWNER))


def as_files(items: DataFrame) -> DataFrame:
    """Inventory items with the defaults for missing size, time and owners filled in."""
    return items.select(
        F.col("id").alias("file_id"),
        "name",
        F.col("mimeType").alias("mime_type"),
        "path",
        owner_of(F.col("owners")).alias("owner"),
        F.coalesce(F.col("size").cast("bigint"), F.lit(0)).alias("size"),
        F.coalesce("modifiedTime", F.lit("")).alias("modified_time"),
        F.coalesce("parents", F.array().cast("array<string>")).alias("parents"),
    )


def folder_paths(folders: DataFrame, root_id: str) -> DataFrame:
    """Full path of every folder below ``root_id``, once per way to reach it.

    One equi-join per level over folders alone; files never enter the loop. Each
    level is written out, so a lost executor costs one level and plans stay small.
    A folder that contains itself is not entered again.
    """
    spark = folders.sparkSession
    edges = folders.select("id", "name", F.explode("parents").alias("parent"))
    root_name = F.lit(ROOT_NAME if root_id == ROOT_ID else root_id)
    one = spark.range(1).select(F.lit(root_id).alias("id"))
    level = (
        one.join(folders.select("id", "name").dropDuplicates(["id"]), "id", "left")
        .select(
            "id",
            F.concat(
                F.lit("/"),
                root_name if root_id == ROOT_ID else F.coalesce("name", root_name),
            ).alias("path"),
            F.array("id").alias("trail"),
        )
    )
    levels = []
    while True:
        level = save_table(level, "folder_level")
        if level.isEmpty():
            break
        levels.append(level)
        up = level.select(
            F.col("id").alias("parent"), F.col("path").alias("above"), F.col("trail").alias("seen")
        )
        level = edges.join(up, "parent").where(~F.array_contains("seen", F.col("id"))).select(
            "id",
            F.concat("above", F.lit("/"), "name").alias("path"),
            F.array_append("seen", F.col("id")).alias("trail"),
        )
    return reduce(DataFrame.unionByName, levels).select("id", "path")


def list_files(items: DataFrame, params: ScanParams | None = None) -> DataFrame:
    """Every wanted file below the chosen folder, once per parent in scope."""
    params = params or ScanParams()
    live = items.where(~F.coalesce("trashed", F.lit(False)))
    folders = live.where(F.col("mimeType") == FOLDER_MIME)
    files = live.where(F.col("mimeType").isin(*params.mime_types))
    paths = folder_paths(folders, params.folder_id).select(
        F.col("id").alias("_parent"), F.col("path").alias("_above")
    )
    placed = (
        files.withColumn("_parent", F.explode("parents"))
        .join(paths, "_parent")
        .withColumn("path", F.concat("_above", F.lit("/"), "name"))
    )
    return as_files(placed)


def active_users(users: DataFrame) -> DataFrame:
    """E-mail addresses of users neither suspended nor archived, in order."""
    return (
        users.where(
            ~F.coalesce("suspended", F.lit(False)) & ~F.coalesce("archived", F.lit(False))
        )
        .select(F.col("primaryEmail").alias("email"))
        .orderBy("email")
    )


def visible_to(listing: DataFrame, users: DataFrame, fallback: str | None = None) -> DataFrame:
    """Listings (``email, file_id, path, ...``) of the active users only.

    Without any active user those of ``fallback`` remain. A user without a listing
    simply contributes nothing.
    """
    chosen = active_users(users)
    if fallback is not None:
        nobody = chosen.agg(F.count("*")).scalar() == 0
        alone = users.sparkSession.range(1).select(F.lit(fallback).alias("email")).where(nobody)
        chosen = chosen.unionByName(alone)
    return listing.join(chosen, "email", "left_semi")


def union_listings(listings: Sequence[DataFrame]) -> DataFrame:
    """Listings of several users in order, each row tagged with its ``user_rank``."""
    ranked = [df.withColumn("user_rank", F.lit(i)) for i, df in enumerate(listings)]
    return reduce(DataFrame.unionByName, ranked)


def first_listing_wins(
    listing: DataFrame, key: str = "file_id", order: Sequence[str] = ("user_rank", "path")
) -> DataFrame:
    """One row per file: the one of the first user that lists it.

    An aggregate instead of a window, so copies are dropped before the shuffle and a
    file shared with everybody does not gather in one task.
    """
    rest = [c for c in listing.columns if c != key and c not in order]
    sort_key = F.struct(*order, *rest)
    best = listing.groupBy(key).agg(F.min(sort_key).alias("_b"))
    return best.select(*[F.col(c) if c == key else F.col("_b")[c].alias(c) for c in listing.columns])
