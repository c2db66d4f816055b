"""A change feed of folders as micro-batches: coalescing, filtering, incremental facet refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CHANGES = "seq long, kind string, path string"
WATCHED = r"(?i)\.(png|jpe?g|webp|mp4|webm|mov|m4v|mkv|db|db-wal)$|\.workflow\.json$"


def targets(changes: DataFrame) -> DataFrame:
    """Changes of watched files outside thumbnail folders."""
    return changes.filter(F.col("path").rlike(WATCHED) & ~F.lower("path").rlike(r"[/\\]\.?thumb(?:nail)?s?[/\\]"))


def folder_of(path: str) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def coalesce(changes: DataFrame) -> DataFrame:
    """(kind, path, old_path): a rename_to takes the oldest rename_from before it that no other took, else it is a create; a
    rename_from that none takes is a remove; repeats go. Changes carry seq, and folder if several are watched.

    How many wait is a walk that a from steps up and a to steps down, not below zero; the k-th to that finds one gets
    the k-th from. Folders are numbered apart.
    """
    folder = F.col("folder") if "folder" in changes.columns else folder_of("path")
    rows = changes.withColumn("__folder", folder)
    by_folder = Window.partitionBy("__folder").orderBy("seq")
    before = by_folder.rowsBetween(Window.unboundedPreceding, -1)
    sides = rows.filter(F.col("kind").isin("rename_from", "rename_to")).withColumn("__from", F.col("kind") == "rename_from")
    sides = sides.withColumn("__walk", F.sum(F.when(F.col("__from"), 1).otherwise(-1)).over(by_folder))
    sides = sides.withColumn("__finds", F.col("__walk") >= F.least(F.lit(0), F.coalesce(F.min("__walk").over(before), F.lit(0))))
    sides = sides.withColumn("n", F.sum((F.col("__from") | F.col("__finds")).cast("int")).over(Window.partitionBy("__folder", "__from").orderBy("seq")))
    a = sides.filter("__from").select("__folder", "n", F.col("path").alias("old_path"))
    b = sides.filter("not __from").select("__folder", F.when(F.col("__finds"), F.col("n")).alias("n"), F.col("path").alias("new_path"))
    pairs = a.join(b, ["__folder", "n"], "full")
    kind = F.when(F.col("new_path").isNull(), "remove").when(F.col("old_path").isNull(), "create").otherwise("rename")
    renames = pairs.select(kind.alias("kind"), F.coalesce("new_path", "old_path").alias("path"), F.when(kind == "rename", F.col("old_path")).alias("old_path"))
    others = rows.filter(~F.col("kind").isin("rename_from", "rename_to")).select("kind", "path", F.lit(None).cast("string").alias("old_path"))
    return others.unionByName(renames).dropDuplicates()


def watch(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], *, once: bool = False) -> StreamingQuery:
    """Runs handle on the coalesced changes of every micro-batch of JSON change logs in folder.

    One query handles one batch at a time, so work that arrives meanwhile is merged into the next.
    """
    feed = spark.readStream.schema(CHANGES).json(folder)
    writer = feed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: handle(coalesce(targets(batch)), n))
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime="1 second").start()


def apply_changes(assets: DataFrame, changes: DataFrame) -> DataFrame:
    """The asset table (path, ...) after a coalesced batch: removes go, renames move, creates are left to the import."""
    moved = changes.filter("kind = 'rename'").select(F.col("old_path").alias("path"), F.col("path").alias("__to"))
    gone = changes.filter("kind = 'remove'").select("path")
    out = assets.join(gone, "path", "left_anti").join(moved, "path", "left")
    return out.select(*[F.coalesce("__to", "path").alias("path") if c == "path" else F.col(c) for c in assets.columns])


def sync_since(rows: DataFrame, mark: str | None, created: str = "created", updated: str = "updated") -> tuple[DataFrame, DataFrame]:
    """(rows newer than the mark, a one-row table with the next mark)."""
    newest = F.greatest(F.col(created), F.coalesce(updated, created))
    fresh = rows if mark is None else rows.filter(newest > F.lit(mark).cast("timestamp"))
    return fresh, rows.agg(F.max(newest).alias("mark"))
