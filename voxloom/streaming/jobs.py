"""Incremental forms of batch operators as Structured Streaming jobs.

Each job reads a folder of Parquet files as a stream, works through what is
there, and stops (``availableNow``); with the same checkpoint folder it goes on
with new files only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators import transcript
from ..sources import index as store

#: Statuses after which nothing more is expected of a call.
SETTLED = ("complete", "error")


def source(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; ``files`` bounds the files of a batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def _run(writer, checkpoint: str) -> None:  # noqa: ANN001
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest(segments: DataFrame, out: str, checkpoint: str) -> None:
    """Segments as they arrive, with terms corrected, appended as Parquet; exactly once by the sink's log."""
    _run(transcript.correct_terms(segments).writeStream.format("parquet").option("path", out), checkpoint)


def upsert_index(changes: DataFrame, index: str, checkpoint: str, every: int = 8, buckets: int = 64) -> None:
    """Changes merged into the index at ``index``, batch by batch; see ``sources.index``.

    A batch that is replayed finds itself in the manifest and changes nothing. A
    new checkpoint counts its batches from 0 again, so it is refused for an index
    that has some.
    """
    spark = changes.sparkSession
    if store.newest(spark, index) and not store.exists(spark, f"{checkpoint}/offsets"):
        raise ValueError(f"{index} has batches of another checkpoint")
    _run(changes.writeStream.foreachBatch(lambda batch, number: store.add(batch, index, number, every, buckets)), checkpoint)


def once_per_call(events: DataFrame, out: str, checkpoint: str, delay: str = "1 day") -> None:
    """The first event of each call within the watermark."""
    kept = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["call_id"])
    _run(kept.writeStream.format("parquet").option("path", out), checkpoint)


class Progress(StatefulProcessor):
    """The latest status of a call and one timer: when a running call counts as lost, and when a settled one is forgotten."""

    def __init__(self, lost: int, forgotten: int):
        self.lost, self.forgotten = lost, forgotten

    def init(self, handle: StatefulProcessorHandle) -> None:
        """Declares the state of a call."""
        self.handle = handle
        self.latest = handle.getValueState("latest", "at long, status string, due long")

    def _told(self, key: tuple, at: int, status: str, timer: int | None) -> Iterator[pd.DataFrame]:
        """Keeps a status, moves the timer, and tells the status."""
        due = at // 1000 + (self.forgotten if status in SETTLED else self.lost)
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)
        self.latest.update((at, status, due))
        yield pd.DataFrame({"call_id": [key[0]], "at": [at], "status": [status]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Takes the latest of the rows; those before the state that is known change nothing."""
        known = self.latest.get()
        before = (known[0], known[1]) if known else None
        best = before
        for frame in rows:
            times = frame["ts"].astype("datetime64[us]").astype("int64")
            for event in zip(times.tolist(), frame["status"].tolist(), strict=True):
                best = event if best is None or event > best else best
        if best is not None and best != before:
            yield from self._told(key, *best, known[2] if known else None)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """A running call becomes an error as of the timer; a settled one is forgotten."""
        at, status, due = self.latest.get()
        if status in SETTLED:
            self.latest.clear()
        else:
            yield from self._told(key, at + self.lost * 1000, "error", None)

    def close(self) -> None:
        """Nothing to close."""


def progress(events: DataFrame, out: str, checkpoint: str, orphan_after: str = "1 hour", delay: str = "10 minutes", keep: str = "7 days") -> None:
    """The status of each call (call_id, at in microseconds, status) whenever it changes, appended; of a call the row of greatest (at, status) holds.

    Events may come out of order by ``delay``; later ones are dropped. A call that
    isn't complete or an error and is silent for ``orphan_after`` of event time
    becomes an error as of the end of that time; a later event takes it up again.
    A complete or failed call is forgotten after ``keep``; an event after that
    begins it anew. Events without time or status are left out; those without
    call_id are one call. State is in RocksDB, saved under the checkpoint.
    """
    rows = events.select("call_id", F.col("ts").cast("timestamp").alias("ts"), "status").where("ts is not null and status is not null")
    step = Progress(*[int(pd.Timedelta(x).total_seconds() * 1000) for x in (orphan_after, keep)])
    told = rows.withWatermark("ts", delay).groupBy("call_id").transformWithStateInPandas(step, "call_id long, at long, status string", "append", "eventTime")
    conf, name = events.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        _run(told.writeStream.outputMode("append").format("parquet").option("path", out), checkpoint)
    finally:
        conf.set(name, before)


def running_stats(events: DataFrame, out: str, checkpoint: str, window: str = "1 hour", delay: str = "10 minutes") -> None:
    """Counts and sums for each window of event time, appended when the watermark has passed it."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    _run(counted.select(F.col("window.start").alias("start"), "event_type", "n", "total").writeStream.outputMode("append").format("parquet").option("path", out), checkpoint)
