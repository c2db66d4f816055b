"""Folders that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one is set only in a local session that has none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomery-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder path below the shared folder."""
    return f"{shared_dir(spark)}/loomery/{name}-{uuid.uuid4().hex}"


#: Bytes of one Arrow batch in sessions that have not chosen their own: whole texts of a batch must fit
#: into a worker beside what is made of them.
BATCH_BYTES = "8m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_SPARK_DEFAULT = "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, or as the session has chosen."""
    if spark.conf.get(_BATCH, _SPARK_DEFAULT) == _SPARK_DEFAULT:
        spark.conf.set(_BATCH, BATCH_BYTES)


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written to the shared folder as Parquet and read back: no lineage, safe against lost executors."""
    bound_batches(df.sparkSession)
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def read_texts(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Columns of a table of texts. A table in fewer files than the cluster has cores, which so few tasks would read
    and work on, is dealt over all cores."""
    rows = spark.read.parquet(path).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def drop(*frames: DataFrame) -> None:
    """Deletes tables of saved() that nothing will read again."""
    for frame in frames:
        fs, path = filesystem(frame.saved_path)
        fs.delete_dir(path)


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """drop(), and lets Spark delete the shuffle files of finished jobs, which it keeps until the driver
    collects its garbage."""
    drop(*frames)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a shared path and the path within it."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of rows in one shard of a range-dealt table, and keys at most that its cut points are taken from.
SHARD_BYTES, SAMPLE_KEYS = 512 << 20, 1 << 20


def shard_count(spark: SparkSession, total: int | None) -> int:
    """Shards for so many bytes: as many as a shuffle has partitions, or more so that none is large."""
    return max(shuffle_width(spark), -(-(total or 0) // SHARD_BYTES))


def range_bounds(keys: DataFrame, key: str, shards: int, per_shard: int = 64) -> list[int]:
    """At most shards - 1 ascending cut points of an integer key, the same for the same rows in any order.

    The distinct keys whose hashes are smallest are a uniform sample that needs no random
    numbers; it has 64 keys a shard, or SAMPLE_KEYS of very many shards. It balances the shards
    and decides nothing else: every row still lands in exactly one shard.
    """
    if shards <= 1:
        return []
    sample = (
        keys.select(F.col(key).cast("long").alias("k"))
        .where("k is not null")
        .groupBy("k")
        .agg(F.lit(1).alias("one"))
        .orderBy(F.xxhash64("k"), "k")
        .limit(min(shards * per_shard, SAMPLE_KEYS))
        .collect()
    )
    found = sorted(r.k for r in sample)
    if not found:
        return []
    cuts = {found[(i * len(found)) // shards] for i in range(1, shards)}
    return sorted(cuts)


def commit_files(pending: DataFrame, out: str, name: str) -> DataFrame:
    """Moves the files that a pending manifest names from temp to file below out, and saves the final manifest.

    A move that an executor finished before it was lost is found done; files of attempts that
    no manifest names are deleted at the end.
    """

    def move(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(out)
        for frame in frames:
            for file, temp in zip(frame["file"], frame["temp"], strict=True):
                if fs.get_file_info(f"{root}/{temp}").type.name == "File":
                    fs.move(f"{root}/{temp}", f"{root}/{file}")
                elif fs.get_file_info(f"{root}/{file}").type.name != "File":
                    raise FileNotFoundError(f"{root}/{temp}")
            yield frame

    committed = saved(pending.mapInPandas(move, pending.schema), name)
    fs, root = filesystem(out)
    if fs.get_file_info(f"{root}/_temporary").type.name == "Directory":
        fs.delete_dir(f"{root}/_temporary")
    return committed


def shard_udf(bounds: list[int]):
    """The shard of an integer key between ascending cut points; null keys are in the last one."""
    cuts = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def shard(key: pd.Series) -> pd.Series:
        out = np.full(len(key), len(cuts), dtype=np.int32)
        there = key.notna().to_numpy()
        out[there] = np.searchsorted(cuts, key[there].astype("int64").to_numpy(), side="right")
        return pd.Series(out)

    return shard
