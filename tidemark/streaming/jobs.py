"""Structured Streaming counterparts of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark import fixed_values as fx
from tidemark.sources.event_log import clean_events


def read_stream(spark: SparkSession, folder: str, schema, file_glob: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Files of a folder as they come. A batch takes all there are; ``files_per_trigger`` makes batches of so many."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def run_available(stream: DataFrame, out: str, mode: str, each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Process what is there and return what was written, with the batch number as ``batch``.

    Every batch overwrites its own folder, so a repeated batch leaves no second copy.
    """
    spark = stream.sparkSession

    def write(df: DataFrame, batch: int) -> None:
        (each(df) if each else df).write.mode("overwrite").parquet(f"{out}/data/batch={batch}")

    q = (stream.writeStream.outputMode(mode).foreachBatch(write)
         .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{out}/data")


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need an instant; wall-clock columns are read in the session zone (UTC)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def weekly_sums(raw: DataFrame, keys: list[str], delay: str = "35 days", ts: str = "ts") -> DataFrame:
    """Sums, means and counts per Monday week; late rows within ``delay`` update their week.

    Start offset of four days: the epoch was a Thursday.
    """
    week = F.window(ts, "7 days", "7 days", "4 days")
    return (event_time(raw, ts).withWatermark(ts, delay).groupBy(*keys, week, "series")
            .agg(F.sum("value").alias("total"), F.avg("value").alias("mean"), F.count("value").alias("n"))
            .select(*keys, F.to_date("window.start").alias("week_start"), "series", "total", "mean", "n"))


def latest_update(written: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Update mode writes a key once per change: the last batch holds its value."""
    last = F.max_by(F.struct(*values), F.col("batch"))
    return written.groupBy(*keys).agg(last.alias("_l")).select(*keys, "_l.*")


def dedupe(raw: DataFrame, keys: list[str], ts: str = "ts", delay: str = "35 days") -> DataFrame:
    return event_time(raw, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def clean_log(log: DataFrame) -> DataFrame:
    return clean_events(log, clip=True)


def _watch(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep the newest heartbeat (microseconds) of a started run; speak once when its timer passes first."""
    last, over = state.get if state.exists else (0, False)
    if state.hasTimedOut:
        if not over:
            state.update((last, True))
            yield pd.DataFrame({"run": [str(key[0])], "last_heartbeat": [pd.Timestamp(last, unit="us")], "code": ["TIMEOUT"]})
        return
    for frame in frames:
        started = frame[frame["state"] != fx.LIVE_STATES[0]]
        if len(started):
            last = max(last, started["heartbeat_at"].max().value // 1000)
            over = over or bool(started["state"].isin(fx.FINAL_STATES).any())
    if not last:
        return
    state.update((last, over))
    if not over:
        due = last // 1000 + fx.HEARTBEAT_MINUTES * 60_000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))


def stale_heartbeats(beats: DataFrame, delay: str = "1 minute") -> DataFrame:
    """One TIMEOUT row per run that has started and shows no heartbeat for ten minutes.

    ``beats``: (run, state, heartbeat_at), ``run`` naming one attempt. Queued runs have no heartbeat to miss. State is
    a number and a flag per run; the flag stays after a final state or a timeout, so that a late heartbeat arms
    no second one.
    """
    return (event_time(beats, "heartbeat_at").withWatermark("heartbeat_at", delay).groupBy("run").applyInPandasWithState(
        _watch, "run string, last_heartbeat timestamp, code string", "last long, over boolean", "append",
        GroupStateTimeout.EventTimeTimeout))


def latest_states(changes: DataFrame) -> DataFrame:
    """Furthest legal state per run in a batch of changes ``(run, attempt, state, at)``.

    States only move forward within an attempt and a new attempt starts over, so the furthest
    (attempt, rank) is the state whatever order the changes arrive in. The first final state of an attempt is its
    last: a later one changes nothing.
    """
    rank = F.lit(None).cast("int")
    for i, s in enumerate(fx.LIVE_STATES):
        rank = F.when(F.col("state") == s, i).otherwise(rank)
    for s in fx.FINAL_STATES:
        rank = F.when(F.col("state") == s, len(fx.LIVE_STATES)).otherwise(rank)
    r = changes.withColumn("rank", rank).where(F.col("rank").isNotNull())
    moment = F.unix_micros(F.col("at").cast("timestamp"))
    newest = F.when(F.col("rank") == len(fx.LIVE_STATES), -moment).otherwise(moment)
    best = F.max_by(F.struct("attempt", "rank", "state", "at"), F.struct("attempt", "rank", newest, "state"))
    return r.groupBy("run").agg(best.alias("_b")).select("run", "_b.*")


def merge_states(written: DataFrame) -> DataFrame:
    """Latest state over all batches."""
    return latest_states(written.drop("rank", "batch")).drop("rank")
