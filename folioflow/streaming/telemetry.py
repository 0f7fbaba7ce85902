"""Structured Streaming forms of the monitoring operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioflow.runtime import scratch

LOSS_SCHEMA = "worker_id string, kind string, at timestamp, gap_seconds double"


def windowed_load(beats: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Average load and queue of all workers per event-time window; later rows than ``late`` are dropped."""
    timed = beats.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size).alias("w")).agg(F.avg("cpu_percent").alias("cpu"), F.avg("ram_percent").alias("memory"), F.sum("queue_depth").alias("queue"), F.approx_count_distinct("worker_id").alias("workers")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "cpu", "memory", "queue", "workers"
    )


def latest_by_worker(beats: DataFrame) -> DataFrame:
    """Newest beat of each worker (update or complete mode); an unknown state counts as active."""
    known = F.col("state").isin("active", "idle", "overloaded", "shutting_down", "lost")
    state = F.when(known, F.col("state")).otherwise("active")
    return beats.withColumn("state", state).groupBy("worker_id").agg(F.max_by(F.struct("ts", "cpu_percent", "ram_percent", "queue_depth", "state"), "ts").alias("last")).select("worker_id", "last.*")


def sessions(beats: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    timed = beats.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("worker_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("beats")).select("worker_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "beats")


def lost_workers(beats: DataFrame, timeout_seconds: float = 15.0, late: str = "30 seconds") -> DataFrame:
    """LOST once a worker's gap in event time passes the timeout, RECONNECTED at its next beat.

    State is one timestamp a worker. A worker never seen is never lost; a gap of exactly the
    timeout is no loss; beats older than the last one change nothing.
    """

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, lost = state.get if state.exists else (None, False)
        out = []
        if state.hasTimedOut:
            if last is not None and not lost:
                out.append((key[0], "LOST", pd.Timestamp(last, unit="us") + pd.Timedelta(seconds=timeout_seconds), timeout_seconds))
                lost = True
            state.update((last, lost))
        else:
            times = sorted(int(t.value // 1000) if hasattr(t, "value") else int(t) for b in batches for t in pd.to_datetime(b["ts"]))
            for t in times:
                if last is not None and t > last:
                    gap = (t - last) / 1e6
                    if gap > timeout_seconds or lost:
                        if not lost:
                            out.append((key[0], "LOST", pd.Timestamp(last, unit="us") + pd.Timedelta(seconds=timeout_seconds), gap))
                        out.append((key[0], "RECONNECTED", pd.Timestamp(t, unit="us"), gap))
                        lost = False
                last = t if last is None else max(last, t)
            state.update((last, lost))
            deadline = last // 1000 + int(timeout_seconds * 1000) + 1
            state.setTimeoutTimestamp(max(deadline, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["worker_id", "kind", "at", "gap_seconds"])

    timed = beats.select("worker_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("worker_id").applyInPandasWithState(step, LOSS_SCHEMA, "last bigint, lost boolean", "append", GroupStateTimeout.EventTimeTimeout)


def complete_documents(pages: DataFrame, expected: DataFrame, late: str = "1 hour") -> DataFrame:
    """Different pages seen of each document against the expected number (update mode); ``expected`` is static.

    A page that comes again within ``late`` counts once; later ones are dropped by the watermark.
    """
    once = pages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["document_id", "page_number"])
    seen = once.groupBy("document_id").agg(F.count("*").alias("seen"))
    return seen.join(expected, "document_id").withColumn("complete", F.col("seen") >= F.col("expected"))


def fan_out(events: DataFrame, handlers: dict[str, list], anything: list):  # noqa: ANN201
    """A writer for ``foreachBatch``: every batch goes to the handlers of its event types and to those of any.

    A handler that fails does not keep the others from their rows.
    """

    def deliver(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for kind, some in [*handlers.items(), (None, anything)]:
                for handler in some:
                    try:
                        handler(batch if kind is None else batch.filter(F.col("event_type") == kind), number)
                    except Exception:  # noqa: BLE001, S112 - by contract
                        continue
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(deliver)


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_once(spark: SparkSession, stream: DataFrame, mode: str) -> str:
    """Run a stream over all that is there and stop; the folder its last result was written to.

    In complete mode each batch replaces the one before, in append mode it adds to it.
    """
    out = scratch(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def append_stream_log(stream: DataFrame, path: str) -> str:
    """Append the columns that are not nested, and none of free text, of a stream of events to a CSV log; the log's folder."""
    flat = stream.select("event_id", "ts", "user_id", "event_type", "value")
    options = {"checkpointLocation": f"{path}/offsets", "header": "true"}
    flat.writeStream.format("csv").options(**options).outputMode("append").trigger(availableNow=True).start(f"{path}/log").awaitTermination()
    return f"{path}/log"


def every(stream: DataFrame, seconds: float, step, offsets: str):  # noqa: ANN001, ANN201
    """A periodic loop: ``step(batch, number)`` on what has come every so many seconds (steal or poll loop); returns the writer."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", offsets).trigger(processingTime=f"{seconds} seconds")
