"""Incremental arrival: files, facts, log events and states as streams.

Every stream runs with ``availableNow``: it takes what has arrived since the
last run and stops. Its checkpoint remembers what was taken.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from almanac.operators import registry
from almanac.sources import fact_store


def event_time(column: str) -> Column:
    """Watermarks need an instant, the logs carry local times."""
    return F.col(column).cast("timestamp")


def read_arrivals(spark: SparkSession, pattern: str, schema: T.StructType, files_per_batch: int = 1_000) -> DataFrame:
    """Parquet files as they land below a path pattern."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


#: The state store that state with timers and lists needs.
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(
    stream: DataFrame, checkpoint: str, each_batch: Callable[[DataFrame, int], None], mode: str = "append", keyed: bool = False
) -> None:
    """Hand every micro-batch of what is available to ``each_batch``, then stop. ``keyed`` streams have processors with state of their own."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    if keyed:
        conf.set(name, _ROCKS)
    try:
        running = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .foreachBatch(each_batch)
            .trigger(availableNow=True)
            .start()
        )
        running.awaitTermination()
    finally:
        conf.set(name, before)


def _batch_path(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id:09d}"


def inc_ingest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append new rows. A replayed batch overwrites its own folder, so nothing doubles."""

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_path(path, batch_id))

    run_available(stream, checkpoint, append)


def stored_batches(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The rows of the batches written so far, optionally only of those before a batch."""
    df = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    df = df if before is None else df.where(F.col("batch") < before)
    return df.drop("batch")


def inc_load_facts(
    stream: DataFrame, path: str, checkpoint: str, order: list[str], buckets: int = fact_store.BUCKETS, bits: int = fact_store.BITS
) -> None:
    """Facts with first-write-wins across batches, into the store of ``fact_store``.

    A batch only sees batches before its own, so replaying it gives the same
    rows again. What it reads of the store depends on its own keys, not on how many batches there were.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        fact_store.load_facts(batch, path, order, batch_id, buckets, bits)

    run_available(stream, checkpoint, load)


def stream_dedupe(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """One row per key; the state of a key is dropped once it cannot come again."""
    return (
        stream.withColumn("_at", event_time(time))
        .withWatermark("_at", late)
        .dropDuplicatesWithinWatermark(keys)
        .drop("_at")
    )


def stream_errors_window(
    stream: DataFrame, time: str, width: str = "15 minutes", slide: str | None = None, late: str = "1 hour"
) -> DataFrame:
    """Errors per window; a window closes when the watermark passes it."""
    at = event_time(time)
    window = F.window("_at", width, slide) if slide else F.window("_at", width)
    return (
        stream.withColumn("_at", at)
        .withWatermark("_at", late)
        .groupBy(window.alias("w"))
        .agg(F.count("*").alias("errors"))
        .select(F.col("w.start").alias("window_start"), "errors")
    )


class LatestStatus(StatefulProcessor):
    """Keeps the newest status of a key and returns it when it changes; forgets the key when the watermark has passed it by ``keep``."""

    def __init__(self, fields: list[str], keep_ms: int):
        self.fields, self.keep_ms = fields, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at timestamp, id long, status string, timer long")

    def handleInputRows(self, key, rows, timerValues):
        old = self.newest.get() if self.newest.exists() else None
        best = old and (old[0], old[1], old[2])
        for batch in rows:
            top = batch.sort_values(["at", "id"]).iloc[-1]
            found = (top["at"].to_pydatetime(), int(top["id"]), str(top["status"]))
            best = found if best is None or found[:2] > best[:2] else best
        due = int(best[0].timestamp() * 1000) + self.keep_ms
        if old is None or due != old[3]:
            if old is not None:
                self.handle.deleteTimer(old[3])
            self.handle.registerTimer(due)
        self.newest.update((*best, due))
        if old is None or best != (old[0], old[1], old[2]):
            yield pd.DataFrame([(*key, *best)], columns=self.fields)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.newest.clear()
        yield from ()

    def close(self) -> None:
        pass


class RetryRoute(StatefulProcessor):
    """Keeps the log entries of a file until it is sent back; then they are cleared.

    Of entries and files that come together, entries come first. Entries expire when the watermark has passed the newest
    of their file by ``keep_ms``.
    """

    def __init__(self, past: list[str], keep_ms: int):
        self.past, self.keep_ms = past, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.logs = handle.getListState("logs", "log_id long, at timestamp, step string")
        self.due = handle.getValueState("due", "timer long")

    def handleInputRows(self, key, rows, timerValues):
        files, fresh = [], []
        for batch in rows:
            for r in batch.itertuples(index=False):
                if r.kind == "file":
                    files.append(r)
                else:
                    fresh.append((int(r.log_id), r.at.to_pydatetime(), r.step))
        if not files:
            self._keep(fresh)
            return
        kept = [*((x[0], x[1], x[2]) for x in self.logs.get()), *fresh] if self.logs.exists() else fresh
        step = max(kept, key=lambda x: (x[1], x[0]))[2] if kept else None
        out = []
        for f in files:
            reached = step in self.past or (not f.file_url and step is not None)
            out.append(("file", *key, "bronze" if reached else "pending", None))
        out += [("cleared", *key, None, i) for i, _, _ in kept]
        self._forget()
        yield pd.DataFrame(out, columns=["kind", "file_id", "pipeline_status", "log_id"]).astype({"log_id": "Int64"})

    def _keep(self, fresh: list[tuple]) -> None:
        if not fresh:
            return
        self.logs.appendList(fresh)
        due = int(max(x[1] for x in fresh).timestamp() * 1000) + self.keep_ms
        old = self.due.get()[0] if self.due.exists() else None
        if old is None or due > old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(due)
            self.due.update((due,))

    def _forget(self) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        self.due.clear()
        self.logs.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.due.clear()
        self.logs.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_status_latest(stream: DataFrame, key: str, status: str, at: str, order: str, keep: str = "30 days") -> DataFrame:
    """(key, at, order, status): the current status of a key whenever it changes, for update mode and ``keyed`` runs.

    ``at`` is the time of a change and ``order`` decides between equal times. A key's state goes when the watermark
    has passed its last change by ``keep``; a change that comes later still is reported as the key's first one. A reader takes the newest row of a key.
    """
    schema = stream.schema
    rows = stream.select(key, event_time(at).alias("at"), F.col(order).cast("long").alias("id"), F.col(status).alias("status"))
    changes = rows.withWatermark("at", keep).groupBy(key).transformWithStateInPandas(
        LatestStatus([key, "at", "id", "status"], _milliseconds(keep)),
        T.StructType([schema[key], T.StructField("at", T.TimestampType()), T.StructField("id", T.LongType()), T.StructField("status", T.StringType())]),
        "Update", "EventTime",
    )
    return changes.select(key, F.col("at").alias(at), F.col("id").alias(order), F.col("status").alias(status))


def _milliseconds(span: str) -> int:
    n, unit = span.split()
    return int(n) * {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def stream_retry_route(files: DataFrame, logs: DataFrame, path: str, checkpoint: str, keep: str = "90 days") -> None:
    """Failed files as they come, sent back to the step that can take them up again; their log entries are cleared.

    Both sides are streams. Below ``path`` stand the routed files and the cleared entries of each batch, see
    ``routed_files`` and ``kept_logs``. Entries that come after their file are kept for its next failure, for ``keep`` at most.
    """
    none = lambda kind: F.lit(None).cast(kind)
    failed = files.where(F.col("pipeline_status") == "failed").select(
        F.col("file_id").cast("string").alias("file_id"), F.lit("file").alias("kind"), none("long").alias("log_id"),
        none("timestamp").alias("at"), none("string").alias("step"), "file_url",
    )
    entries = logs.select(
        "file_id", F.lit("log").alias("kind"), F.col("id").alias("log_id"), event_time("log_time").alias("at"), "step",
        none("string").alias("file_url"),
    )
    # a file has no time of its own, so it moves no watermark and is never late
    moves = failed.unionByName(entries).withWatermark("at", keep).groupBy("file_id").transformWithStateInPandas(
        RetryRoute(registry.PAST_BRONZE, _milliseconds(keep)), _MOVES, "Append", "EventTime"
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_path(path, batch_id))

    run_available(moves, checkpoint, store, keyed=True)


_MOVES = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("kind", "file_id", "pipeline_status")] + [T.StructField("log_id", T.LongType())]
)


def routed_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, pipeline_status) of the files that were sent back."""
    moves = stored_batches(spark, path, _MOVES).where("kind = 'file'")
    return moves.select(F.col("file_id").cast("int").alias("file_id"), "pipeline_status")


def kept_logs(spark: SparkSession, path: str, logs: DataFrame) -> DataFrame:
    """``logs`` (with ``id``) without the entries that a retry has cleared."""
    cleared = stored_batches(spark, path, _MOVES).where("kind = 'cleared'").select(F.col("log_id").alias("id"))
    return logs.join(cleared, "id", "left_anti")
