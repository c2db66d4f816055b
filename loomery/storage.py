"""Tables in the folder that the driver and all executors share: saved steps, and keyed tables in versions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one is made only in a local session that has none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomery-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/loomery/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, whatever happens to an executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.saved_path = path
    return found


def side_session(spark: SparkSession, **conf: str) -> SparkSession:
    """A session of the same application with settings of its own (a__b for a.b), so that the caller's stay as they are."""
    side = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.checkpoint.dir"):
        value = spark.conf.get(key, None)
        if value is not None and side.conf.get(key, None) != value:
            side.conf.set(key, value)
    for key, value in conf.items():
        side.conf.set(key.replace("__", "."), value)
    return side


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


class KeyedTable:
    """A table in hash partitions of its key; a commit writes only the partitions it changes.

    Layout below path: data/bucket=B/version=V/*.parquet, notes/version=V (what a commit has to say of itself), and
    versions/version=V/*.parquet with one row (bucket, held) for each bucket: the version in which it was last
    written. A version counts once its list of buckets is complete, so a commit that stops half way changes nothing that is read, readers of an older
    version are not disturbed, and a commit that is run again replaces what the first run left behind. One
    writer commits at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = 64) -> KeyedTable:
        """A table of rows (one a key) as version 0. Choose as many buckets as files of a good size come of it."""
        table = cls(rows.sparkSession, path, key)
        table._write(rows.withColumn("bucket", table.bucket(buckets)), 0)
        table._commit(rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).alias("held")), 0)
        return table

    def bucket(self, buckets: int) -> Column:
        """The partition of a row; null keys are in one partition too."""
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def version(self) -> int:
        """The newest version whose list of buckets is complete."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        fs = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [status.getPath().getName() for status in fs.listStatus(place)]
        found = sorted((int(n.partition("=")[2]) for n in names if n.startswith("version=")), reverse=True)
        return next(v for v in found if _exists(self.spark, f"{self.path}/versions/version={v}/_SUCCESS"))

    def listing(self, version: int | None = None) -> dict[int, int]:
        """{bucket: version in which it was last written}: as many entries as there are buckets."""
        v = self.version() if version is None else version
        return {r.bucket: r.held for r in self.spark.read.schema("bucket int, held int").parquet(f"{self.path}/versions/version={v}").collect()}

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, of some buckets if given; only their folders are listed and read."""
        held = self.listing(version)
        some = held if buckets is None else {b: held[b] for b in buckets}
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        paths = [p for b, v in sorted(some.items()) if _exists(self.spark, p := f"{self.path}/data/bucket={b}/version={v}")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def notes(self, kind: str) -> list[str]:
        """The notes of a kind of all versions, oldest first."""
        version = self.version()
        if not _exists(self.spark, f"{self.path}/notes"):
            return []
        rows = self.spark.read.schema("kind string, note string, version int").parquet(f"{self.path}/notes")
        return [r.note for r in rows.where((F.col("kind") == kind) & (F.col("version") <= version)).orderBy("version", "note").collect()]

    def merge(self, rows: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], notes: list[tuple[str, str]] | None = None) -> dict[str, int]:
        """One commit of combine(stored, incoming), which returns the merged rows with __change: new, changed,
        same or untouched, for the buckets that rows fall into. Buckets without a new or changed row keep their
        files. notes: (kind, note) that hold exactly if this commit does. Returns how many rows there were of each change."""
        held = self.listing()
        rows = rows.withColumn("bucket", self.bucket(len(held)))
        touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # at most one a bucket
        if not touched:
            if notes:
                self._commit(self._listed(held), self._noted(notes))
            return {}
        merged = saved(combine(self.read(buckets=touched), rows.drop("bucket")).withColumn("bucket", self.bucket(len(held))), "merge")
        counts = merged.groupBy("bucket", "__change").agg(F.count("*").alias("n")).collect()
        dirty = sorted({r.bucket for r in counts if r["__change"] in ("new", "changed")})
        if dirty or notes:
            v = self._noted(notes or [])
            if dirty:
                self._write(merged.where(F.col("bucket").isin(dirty)).drop("__change"), v)
            self._commit(self._listed(held | dict.fromkeys(dirty, v)), v)
        out: dict[str, int] = {}
        for r in counts:
            out[r["__change"]] = out.get(r["__change"], 0) + r.n
        return out

    def _listed(self, held: dict[int, int]) -> DataFrame:
        return self.spark.createDataFrame(sorted(held.items()), "bucket int, held int")

    def _noted(self, notes: list[tuple[str, str]]) -> int:
        """The next version, its notes written; what a commit that stopped had noted for it is replaced."""
        v = self.version() + 1
        if notes or _exists(self.spark, f"{self.path}/notes/version={v}"):
            self.spark.createDataFrame(notes, "kind string, note string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/notes/version={v}")
        return v

    def _write(self, rows: DataFrame, version: int) -> None:
        plain = rows.drop("bucket")
        if not _exists(self.spark, f"{self.path}/schema"):
            plain.limit(0).write.parquet(f"{self.path}/schema")
        dealt = rows.repartition("bucket").withColumn("version", F.lit(version))
        dealt.write.partitionBy("bucket", "version").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/data")

    def _commit(self, buckets: DataFrame, version: int) -> None:
        buckets.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/version={version}")
