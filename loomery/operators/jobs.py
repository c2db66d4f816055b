"""Work over a keyed table that may stop and go on: marks, ledgers of what is done, jobs in steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery import storage
from loomery.operators import lifecycle

_MARK, _BATCH, _STEP = "sync mark", "facet batch", "reparse step"


def newest_of(created: str, updated: str) -> Column:
    return F.greatest(F.col(created), F.coalesce(updated, created))


def sync(table: storage.KeyedTable, source: DataFrame, created: str = "created", updated: str = "updated") -> int:
    """Takes over the rows of source that changed since the last time; returns how many were taken.

    The mark is the newest time taken over so far. It is noted in the commit that takes the rows, so the rows that have
    it are those of the table itself: a row that comes later with the mark's own time is taken, one that is there
    already is not. A run that stops before its commit is the same as none. Rows without a time are not taken.
    """
    at, key = newest_of(created, updated), table.key
    marks = table.notes(_MARK)
    fresh = source.where(at.isNotNull())
    if marks:
        mark = F.lit(marks[-1]).cast("timestamp")
        there = table.read().where(at == mark).select(key)
        fresh = fresh.where(at > mark).unionByName(fresh.where(at == mark).join(there, key, "left_anti").select(*source.columns))
    fresh = storage.saved(fresh, "fresh")
    seen = fresh.agg(F.count("*").alias("n"), F.date_format(F.max(at), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("mark")).first()
    if seen.n:
        table.merge(fresh, lambda old, new: lifecycle.upsert(old, new, key), [(_MARK, seen.mark)])
    return seen.n


@dataclass
class FacetQueue:
    """Counts of facet keys in a keyed table (key, count), and batches of changes (key, delta) that wait for it.

    A batch has an id. It is kept until it is counted, and counts once however often it is put in or counted: the ids
    are noted in the commit that counts them. All that wait are summed up and counted in one commit.
    """

    table: storage.KeyedTable

    def put(self, changes: DataFrame, batch_id: int) -> None:
        """Keeps a batch; putting it again replaces it with the same."""
        changes.select("key", F.col("delta").cast("long").alias("delta")).write.mode("overwrite").parquet(f"{self.table.path}/waiting/batch={batch_id}")

    def counted(self) -> set[int]:
        return set(map(int, self.table.notes(_BATCH)))

    def waiting(self) -> DataFrame:
        """(key, delta, batch) of the batches that are not counted yet."""
        rows = self.table.spark.read.schema("key string, delta long, batch int").parquet(f"{self.table.path}/waiting")
        return rows.where(~F.col("batch").isin(sorted(self.counted())))

    def drain(self) -> int:
        """Counts all that wait in one commit; returns how many batches there were."""
        rows = storage.saved(self.waiting(), "waiting")
        batches = sorted(r.batch for r in rows.select("batch").distinct().collect())  # one short row a batch
        if batches:
            sums = rows.groupBy("key").agg(F.sum("delta").alias("count")).where("count <> 0")
            self.table.merge(sums, lambda old, new: lifecycle.upsert(old, new, "key", {"count": lambda a, b: a + b}), [(_BATCH, str(b)) for b in batches])
        return len(batches)


def reparse(table: storage.KeyedTable, parse: Callable[[DataFrame], DataFrame], version: int, *, job: str, buckets_a_step: int = 4, **options) -> Iterator[dict]:
    """Parses the outdated rows of a table again, some partitions at a time; yields a progress row after each step.

    Every step is one commit that notes which partitions it did, so a job that was cancelled, or whose driver was lost,
    goes on where it stopped when it is run again under its name. Spark jobs of a step carry the name as a tag:
    spark.interruptTag or SparkContext.cancelJobsWithTag ends the step that runs, and with it the job. options are
    those of lifecycle.reparse.
    """
    spark, every = table.spark, sorted(table.listing())
    done = {int(n.rpartition(":")[2]) for n in table.notes(_STEP) if n.rpartition(":")[0] == f"{job}:{version}"}
    todo = [b for b in every if b not in done]
    parsed = changed = 0
    for at in range(0, len(todo), buckets_a_step):
        some = todo[at : at + buckets_a_step]
        spark.sparkContext.addJobTag(job)
        try:
            rows = table.read(buckets=some)
            out, diff = lifecycle.reparse(rows, parse, version, **options)
            due = out.join(rows.select(F.col(table.key).alias("__id"), F.col("parser_version").alias("__was")), F.col(table.key) == F.col("__id")).where(~F.col("parser_version").eqNullSafe(F.col("__was"))).drop("__id", "__was")
            due = storage.saved(due, "reparsed")
            n, moved = due.count(), diff.select("id").distinct().count()
            table.merge(due, lambda old, new: lifecycle.upsert(old, new, table.key), [(_STEP, f"{job}:{version}:{b}") for b in some])
        finally:
            spark.sparkContext.removeJobTag(job)
        parsed, changed = parsed + n, changed + moved
        yield {"job": job, "done": len(done) + at + len(some), "of": len(every), "parsed": parsed, "changed": changed}
