"""Collections: counts, ranked thumbnails, membership changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.operators.library import best_key


def with_thumbnails(members: DataFrame, per: str, order: list[tuple[str, bool]], thumb: str, private: str) -> DataFrame:
    """(per, count, thumb, safe_thumb): the best thumbnail of all members and of those that are not private.
    order: (column, descending), ending in a unique column."""
    place = best_key(members, order)
    open_ = ~F.coalesce(F.col(private), F.lit(False))
    return members.groupBy(per).agg(F.count("*").alias("count"), F.min_by(thumb, place).alias("thumb"), F.min_by(thumb, F.when(open_, place)).alias("safe_thumb"))


def add(membership: DataFrame, rows: DataFrame) -> DataFrame:
    """Union without repeats."""
    return membership.unionByName(rows).dropDuplicates(["collection_id", "asset_id"])


def remove(membership: DataFrame, rows: DataFrame) -> DataFrame:
    return membership.join(rows.select("collection_id", "asset_id"), ["collection_id", "asset_id"], "left_anti")


def move(membership: DataFrame, assets: DataFrame, source: str, target: str) -> DataFrame:
    """The assets leave source, where they are in it, and join target."""
    here = membership.filter(F.col("collection_id") == source).join(assets.select("asset_id"), "asset_id", "left_semi").select("collection_id", "asset_id")
    return add(remove(membership, here), here.withColumn("collection_id", F.lit(target)))


def sort_collections(rows: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Unknown values come last in both directions."""
    return rows.orderBy(F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last(), "collection_id")
