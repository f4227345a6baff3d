"""Streams that hold state of their own: heartbeats with timers, run states with a start, weekly sums with late rows kept apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark import fixed_values as fx
from tidemark.session import SETTINGS
from tidemark.streaming.jobs import event_time

STORE = "spark.sql.streaming.stateStore.providerClass"

MINUTE = 60_000
TIMEOUTS = "run string, last_heartbeat timestamp, code string"
BEAT = T.StructType([T.StructField("last", T.LongType()), T.StructField("over", T.BooleanType())])
#: Runs share state in so many buckets. A checkpoint keeps the number it was begun with: another one finds no run again.
BUCKETS = 4096
DEALT = "bucket int, run {run}, attempt int, state string, at long, gaps int, refused string"
NO_RUN, NO_ATTEMPT, NO_AT = 1, 2, 4
RANKS = {**{s: i for i, s in enumerate(fx.LIVE_STATES)}, **{s: len(fx.LIVE_STATES) for s in fx.FINAL_STATES}}
FINAL = len(fx.LIVE_STATES)


def run_batches(source: Callable[[], DataFrame], out: str, mode: str, each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process what a stream has now, into a folder per batch; called again, it goes on from its checkpoint.

    A repeated batch overwrites its own folder. ``each`` writes a batch by itself. State variables need the RocksDB store,
    which is not Spark's default: the stream is started with it, and the session has its own setting back at once.
    """
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/data/batch={batch}")

    df = source()
    conf = df.sparkSession.conf
    own = conf.get(STORE, None)
    conf.set(STORE, SETTINGS[STORE])
    try:  # a stream keeps the settings it is started with
        q = (df.writeStream.outputMode(mode).foreachBatch(each or write)
             .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    finally:
        if own is None:
            conf.unset(STORE)
        else:
            conf.set(STORE, own)
    q.awaitTermination()


def state_rows(spark: SparkSession, out: str, variable: str) -> DataFrame:
    """What a stream holds now, from its checkpoint: the key's and the state's columns."""
    held = (spark.read.format("statestore").option("stateVarName", variable).load(f"{out}/checkpoint"))
    return held.select("key.*", "value.*")


class Heartbeats(StatefulProcessor):
    """Newest heartbeat per attempt. A timer in event time speaks once; a second one forgets an attempt that is over."""

    def __init__(self, patience: int, keep: int):
        self.patience, self.keep = patience, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.beat = handle.getValueState("beat", BEAT)

    def _rearm(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, over = self.beat.get() if self.beat.exists() else (0, False)
        for frame in rows:
            started = frame[frame["state"] != fx.LIVE_STATES[0]]
            if len(started):
                last = max(last, started["heartbeat_at"].max().value // 1000)
                over = over or bool(started["state"].isin(fx.FINAL_STATES).any())
        if last:
            self.beat.update((last, over))
            due = last // 1000 + (self.keep if over else self.patience)
            self._rearm(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, over = self.beat.get()
        if over:
            self.beat.clear()
            return iter(())
        self.beat.update((last, True))
        self._rearm(max(last // 1000 + self.keep, timerValues.getCurrentWatermarkInMs() + 1))
        return iter([pd.DataFrame({"run": [str(key[0])], "last_heartbeat": [pd.Timestamp(last, unit="us")], "code": ["TIMEOUT"]})])

    def close(self) -> None:
        pass


def heartbeat_timeouts(beats: DataFrame, delay: str = "1 minute", patience: int = fx.HEARTBEAT_MINUTES, keep: int = 30 * 24 * 60) -> DataFrame:
    """One TIMEOUT row per attempt that has started and shows no heartbeat for ``patience`` minutes of event time.

    ``beats``: (run, state, heartbeat_at), ``run`` naming one attempt. Queued attempts have no heartbeat to miss. An
    attempt that is over, by a final state or a timeout, is remembered for ``keep`` minutes after its last heartbeat, so
    that late heartbeats arm nothing, and then forgotten: state does not grow with the attempts there ever were.
    """
    return (event_time(beats, "heartbeat_at").withWatermark("heartbeat_at", delay).groupBy("run").transformWithStateInPandas(
        Heartbeats(patience * MINUTE, keep * MINUTE), TIMEOUTS, "append", "EventTime"))


class RunStates(StatefulProcessor):
    """The furthest (attempt, rank) of each run of a bucket. Of two final states of an attempt the earlier stands.

    Each key and each look at the state costs some calls to the JVM, far more than a change does: a bucket's runs are held
    in one value, as a list per column.
    """

    def __init__(self, run: T.DataType):
        self.schema = T.StructType([T.StructField("run", T.ArrayType(run)), T.StructField("attempt", T.ArrayType(T.IntegerType())),
                                    T.StructField("rank", T.ArrayType(T.IntegerType())), T.StructField("state", T.ArrayType(T.StringType())),
                                    T.StructField("at", T.ArrayType(T.LongType()))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", self.schema)

    def _held(self) -> dict:
        """(attempt, rank, time, state) by run, in an order in which the further is the greater: final times are negative."""
        if not self.latest.exists():
            return {}
        return {run: (attempt, rank, -at if rank == FINAL else at, state) for run, attempt, rank, state, at in zip(*self.latest.get())}

    def _hold(self, held: dict) -> None:
        attempts, ranks, times, states = zip(*held.values())
        self.latest.update((list(held), list(attempts), list(ranks), list(states), [-t if r == FINAL else t for r, t in zip(ranks, times)]))

    def _lead(self, held: dict, frame: pd.DataFrame) -> tuple[bool, dict[int, str]]:
        """Takes a frame's changes into ``held``: whether one was held, and by row why it was refused."""
        moved, refused = False, {}
        rows = zip(frame["run"].tolist(), frame["attempt"].tolist(), frame["state"].tolist(), frame["at"].tolist(), frame["gaps"].tolist())
        for i, (run, attempt, state, at, gaps) in enumerate(rows):
            rank = RANKS.get(state)
            if rank is None or gaps & (NO_ATTEMPT | NO_AT):
                refused[i] = "unknown_state"
                continue
            was, new = held.get(run), (attempt, rank, -at if rank == FINAL else at, state)
            if was is None or new > was:
                held[run], moved = new, True
            elif at > (-was[2] if was[1] == FINAL else was[2]):
                if attempt < was[0]:
                    refused[i] = "earlier_attempt"
                elif was[1] == FINAL:
                    refused[i] = "after_final"
                elif rank < was[1]:
                    refused[i] = "backwards"
        return moved, refused

    def handleInitialState(self, key, initialState, timerValues) -> None:
        held = self._held()  # a bucket's rows may come in several frames
        if self._lead(held, initialState)[0]:
            self._hold(held)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, changed = self._held(), False
        for frame in rows:
            moved, refused = self._lead(held, frame)
            changed = changed or moved
            if refused:
                yield frame.iloc[list(refused)].assign(bucket=int(key[0]), refused=list(refused.values()))
        if changed:
            self._hold(held)

    def close(self) -> None:
        pass


def _dealt(changes: DataFrame, run: T.DataType) -> DataFrame:
    """The changes by bucket and without nulls, for which pandas would make whole numbers floats: ``gaps`` says where they were.

    Changes without a run are a bucket of their own.
    """
    run_, attempt, at = F.col("run").cast(run), F.col("attempt").cast("int"), F.unix_micros(F.col("at").cast("timestamp"))
    gap = lambda c, bit: F.when(c.isNull(), bit).otherwise(0)
    return changes.select(F.when(run_.isNull(), -1).otherwise(F.pmod(F.xxhash64(run_), F.lit(BUCKETS))).cast("int").alias("bucket"),
                          F.coalesce(run_, F.lit(0).cast(run)).alias("run"), F.coalesce(attempt, F.lit(0)).alias("attempt"),
                          "state", F.coalesce(at, F.lit(0)).alias("at"), (gap(run_, NO_RUN) + gap(attempt, NO_ATTEMPT) + gap(at, NO_AT)).alias("gaps"))


def run_states(changes: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Holds each run's state and gives the changes it refused: (run, attempt, state, at, refused).

    ``changes`` and ``initial`` (the runs known before the stream starts): (run, attempt, state, at). States only move
    forward within an attempt, a new attempt starts over, and an attempt's first final state is its last; what is held
    does not depend on the order of arrival. A change is refused, and named, when its state is unknown or when it claims
    to come after something it cannot follow: ``after_final``, ``backwards`` or ``earlier_attempt``. A change that merely
    arrives late is neither held nor refused. Read what is held with :func:`held_states`.
    """
    run = changes.schema["run"].dataType
    start = None if initial is None else _dealt(initial, run).groupBy("bucket")
    refused = _dealt(changes, run).groupBy("bucket").transformWithStateInPandas(
        RunStates(run), DEALT.format(run=run.simpleString()), "append", "None", start)
    kept = lambda c, bit: F.when(F.col("gaps").bitwiseAND(bit) == 0, c)
    return refused.select(kept(F.col("run").cast("long"), NO_RUN).alias("run"), kept(F.col("attempt"), NO_ATTEMPT).alias("attempt"), "state",
                          kept(F.timestamp_micros("at"), NO_AT).alias("at"), "refused")


def held_states(spark: SparkSession, out: str) -> DataFrame:
    """(run, attempt, state, at) that :func:`run_states` holds, read from its checkpoint."""
    held = state_rows(spark, out, "latest").select("bucket", F.inline(F.arrays_zip("run", "attempt", "state", "at")))
    return held.select(F.when(F.col("bucket") >= 0, F.col("run")).alias("run"), "attempt", "state", F.timestamp_micros("at").alias("at"))


# --- weekly sums whose late rows are kept ----------------------------------------------------------

def week_batches(raw: Callable[[], DataFrame], out: str, keys: list[str], delay_days: int = 35, ts: str = "ts") -> None:
    """Weekly sums of a stream, as one table of partial sums and one of the rows that came too late.

    A batch's rows belong to their week unless the newest time of all batches before it, less ``delay_days``, had passed
    that week's end; such rows go to ``late`` as they are and change no sum. Both tables have a folder per batch, which a
    repeated batch overwrites. ``raw``: (keys, series, ts, value); rows without a time are late.
    """
    spark = None

    def write(df: DataFrame, batch: int) -> None:
        nonlocal spark
        spark = df.sparkSession
        newest = None
        if batch:
            marks = spark.read.schema("newest timestamp, batch int").parquet(f"{out}/marks")
            newest = marks.where(F.col("batch") < batch).agg(F.max("newest")).first()[0]
        rows = event_time(df, ts).withColumn("week_start", F.to_date(F.date_trunc("week", ts))).persist()
        gone = F.col(ts).isNull()
        if newest is not None:
            gone = gone | (F.date_add("week_start", 7).cast("timestamp") <= F.lit(newest) - F.expr(f"interval {delay_days} days"))
        rows.where(gone).write.mode("overwrite").parquet(f"{out}/late/batch={batch}")
        sums = rows.where(~gone).groupBy(*keys, "week_start", "series").agg(F.sum("value").alias("total"), F.count("value").alias("n"))
        sums.write.mode("overwrite").parquet(f"{out}/sums/batch={batch}")
        rows.agg(F.max(ts).alias("newest")).write.mode("overwrite").parquet(f"{out}/marks/batch={batch}")
        rows.unpersist()

    run_batches(raw, out, "append", write)


def week_sums(spark: SparkSession, out: str, keys: list[str], with_late: bool = False) -> DataFrame:
    """(keys, week_start, series, total, mean, n) of what :func:`week_batches` wrote; ``with_late`` adds the late rows, which
    gives what a batch over all rows would give."""
    parts = spark.read.parquet(f"{out}/sums").drop("batch")
    if with_late:
        late = spark.read.parquet(f"{out}/late").where("week_start IS NOT NULL")
        parts = parts.unionByName(late.groupBy(*keys, "week_start", "series").agg(F.sum("value").alias("total"), F.count("value").alias("n")))
    sums = parts.groupBy(*keys, "week_start", "series").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return sums.select(*keys, "week_start", "series", "total", (F.col("total") / F.nullif(F.col("n"), F.lit(0))).alias("mean"), "n")


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/late")
