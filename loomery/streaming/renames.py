"""Renames whose two halves arrive in different micro-batches: a queue of old paths for each folder, kept as state.

An old path waits for the next new path of its folder. A new path takes the oldest one that waits, or else is a
create; an old path that waits longer than allowed is a remove.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from loomery.streaming import changes

LOG = "seq long, kind string, path string, at timestamp"
RESOLVED = "kind string, path string, old_path string"
#: Milliseconds that half a rename waits for the other, and that a folder is idle before it is flushed.
WAIT_MS = 250


class RenameQueue(StatefulProcessor):
    """The old paths of one folder that wait, oldest first, each with the time until which it does."""

    def __init__(self, wait_ms: int, by_event: bool) -> None:
        self.wait_ms, self.by_event = wait_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "path string, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        queue = [(path, until) for path, until in self.waiting.get()] if self.waiting.exists() else []
        had, out = queue[0][1] if queue else None, []
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            now = r.at_ms if self.by_event else timerValues.getCurrentProcessingTimeInMs()
            while queue and queue[0][1] < now:
                out.append(("remove", queue.pop(0)[0], None))
            if r.kind == "rename_from":
                queue.append((r.path, now + self.wait_ms))
            elif r.kind == "rename_to":
                out.append(("rename", r.path, queue.pop(0)[0]) if queue else ("create", r.path, None))
        self._keep(queue, had)
        yield pd.DataFrame(out, columns=["kind", "path", "old_path"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() if self.by_event else timerValues.getCurrentProcessingTimeInMs()
        queue = [(path, until) for path, until in self.waiting.get()] if self.waiting.exists() else []
        out = [("remove", path, None) for path, until in queue if until < now]
        self._keep([x for x in queue if x[1] >= now], None)
        yield pd.DataFrame(out, columns=["kind", "path", "old_path"])

    def _keep(self, queue: list[tuple[str, int]], had: int | None) -> None:
        if had is not None and (not queue or queue[0][1] != had):
            self.handle.deleteTimer(had + 1)
        if queue:
            self.waiting.put(queue)
            if queue[0][1] != had:
                self.handle.registerTimer(queue[0][1] + 1)
        else:
            self.waiting.clear()


def resolved(log: DataFrame, *, wait_ms: int = WAIT_MS, by_event: bool = False) -> DataFrame:
    """(kind, path, old_path) of a stream of changes (LOG) of watched files, renames put together across batches.

    Time is that of processing, or with by_event that of the changes, which then are late by no more than a batch:
    a row of any kind with a later time lets what waits in every folder expire. Null paths are left out.
    """
    seen = log.withWatermark("at", "0 seconds") if by_event else log
    watched = changes.targets(seen).withColumn("folder", changes.folder_of("path"))
    halves = watched.where(F.col("kind").isin("rename_from", "rename_to")).select("folder", "seq", "kind", "path", "at", F.unix_millis("at").alias("at_ms"))
    paired = halves.groupBy("folder").transformWithStateInPandas(RenameQueue(wait_ms, by_event), RESOLVED, "Append", "EventTime" if by_event else "ProcessingTime")
    others = watched.where(~F.col("kind").isin("rename_from", "rename_to")).select("kind", "path", F.lit(None).cast("string").alias("old_path"))
    return others.unionByName(paired)


def watch(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], *, wait_ms: int = WAIT_MS, by_event: bool = False, files_a_batch: int | None = None, once: bool = False) -> StreamingQuery:
    """Runs handle on the resolved changes of every micro-batch of JSON change logs in folder, repeats within it left out.

    The state is in Spark's checkpoint, so a query that is started again goes on with the halves that wait.
    """
    reader = spark.readStream.schema(LOG)
    reader = reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader
    found = resolved(reader.json(folder), wait_ms=wait_ms, by_event=by_event)
    writer = found.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: handle(batch.dropDuplicates(), n))
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime=f"{wait_ms} milliseconds").start()


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session whose streams keep state in the store that keyed state with timers needs."""
    from loomery import storage

    return storage.side_session(spark, spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
