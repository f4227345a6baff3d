"""Streams in several micro-batches: one timeout per attempt, states in any order, late rows kept apart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import jobs as st, stateful as sf

T0 = dt.datetime(2024, 3, 4, 12, 0)


def minute(m):
    return T0 + dt.timedelta(minutes=m)


def feed(spark, folder, batches, schema, run):
    """Write one batch of rows, run the stream to its end, then the next."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/batch-{k}")
        run()


BEATS = [
    [("a", "sampling", 0), ("b", "sampling", 0), ("q", "queued", 0), ("c", "sampling", 1), ("d", "completed", 1)],
    [("a", "sampling", 8), ("c", "completed", 9), ("e", "sampling", 10)],
    [("e", "sampling", 14), ("f", "sampling", 15), ("k", "sampling", 13)],
    [("a", "sampling", 16), ("g", "sampling", 30), ("f", "failed", 30), ("b", "sampling", 25)],     # b had its timeout when the mark passed 10
    [("h", "sampling", 90)],
]


def test_one_timeout_per_attempt_over_five_batches(spark, tmp_path):
    schema = "run string, state string, heartbeat_at timestamp"
    out = str(tmp_path / "out")

    def run():
        stream = st.read_stream(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema)
        sf.run_batches(lambda: sf.heartbeat_timeouts(stream, keep=40), out, "append")

    feed(spark, tmp_path, [[(r, s, minute(m)) for r, s, m in b] for b in BEATS], schema, run)
    got = sorted((r["run"], r["last_heartbeat"]) for r in spark.read.parquet(f"{out}/data").collect())
    # after the second batch the mark is at 9: nothing is due; after the third at 14: b (0) is; after the fourth at 29: a, e and k; at 89: g
    assert got == [("a", minute(16)), ("b", minute(0)), ("e", minute(14)), ("g", minute(30)), ("k", minute(13))]
    held = {r["run"]: r["over"] for r in sf.state_rows(spark, out, "beat").collect()}
    # those over for 40 minutes are forgotten; g spoke at the last mark and goes with the next one
    assert held == {"g": True, "h": False}


def test_states_in_any_order_and_refusals(spark, tmp_path):
    schema = "run long, attempt int, state string, at timestamp"
    rng = random.Random(1)
    names = ["queued", "validating", "sampling", "completed", "failed", "nonsense"]
    rows = [(rng.randrange(30), rng.randrange(2), rng.choice(names), minute(rng.randrange(500))) for _ in range(400)]
    rows += [(100, 1, None, minute(1)), (101, None, "queued", minute(1)), (102, 1, "queued", None)]
    want = {r["run"]: (r["attempt"], r["state"], r["at"]) for r in st.latest_states(
        spark.createDataFrame([r for r in rows if r[1] is not None and r[3] is not None], schema)).collect()}
    for seed in (0, 1):
        random.Random(seed).shuffle(rows)
        folder, out = tmp_path / f"s{seed}", str(tmp_path / f"o{seed}")
        initial = spark.createDataFrame([r for r in rows[:50] if r[1] is not None and r[3] is not None and r[2] != "nonsense"], schema)

        def run():
            stream = st.read_stream(spark, f"{folder}/in/*", initial.schema)
            sf.run_batches(lambda: sf.run_states(stream, initial), out, "append")

        feed(spark, folder, [rows[i::4] for i in range(4)], schema, run)
        held = {r["run"]: (r["attempt"], r["state"], r["at"]) for r in sf.held_states(spark, out).collect()}
        assert held == want
        refused = spark.read.parquet(f"{out}/data")
        assert refused.where("refused = 'unknown_state'").count() == sum(r[2] in ("nonsense", None) or r[1] is None or r[3] is None for r in rows)


def test_refused_changes_are_named(spark, tmp_path):
    schema = "run long, attempt int, state string, at timestamp"
    batches = [[(1, 1, "sampling", minute(1)), (2, 1, "completed", minute(1)), (3, 2, "queued", minute(5))],
               [(1, 1, "queued", minute(2)), (2, 1, "failed", minute(9)), (3, 1, "sampling", minute(6)), (3, 1, "validating", minute(1))]]

    def run():
        stream = st.read_stream(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema)
        sf.run_batches(lambda: sf.run_states(stream), str(tmp_path / "out"), "append")

    feed(spark, tmp_path, batches, schema, run)
    got = {(r["run"], r["state"], r["refused"]) for r in spark.read.parquet(f"{tmp_path}/out/data").collect()}
    assert got == {(1, "queued", "backwards"), (2, "failed", "after_final"), (3, "sampling", "earlier_attempt")}


def test_runs_share_the_state_of_a_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sf, "BUCKETS", 8, raising=False)
    schema = "run long, attempt int, state string, at timestamp"
    runs = [None, 2**60 + 1, 2**60 + 2, *range(200)]
    known = [(r, 1, s, minute(m)) for s, m in (("sampling", 5), ("validating", 9)) for r in runs[:100]]  # in several frames of a bucket
    batches = [[(r, 1, "validating", minute(1)) for r in runs] + [(None, None, "queued", None)], [(r, 1, "queued", minute(8)) for r in runs]]
    initial, rows = spark.createDataFrame(known, schema), "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(rows)
    spark.conf.set(rows, "16")

    def run():
        stream = st.read_stream(spark, f"{tmp_path}/in/*", initial.schema)
        sf.run_batches(lambda: sf.run_states(stream, initial), str(tmp_path / "out"), "append")

    try:
        feed(spark, tmp_path, batches, schema, run)
    finally:
        spark.conf.set(rows, own)
    held = {r["run"]: (r["attempt"], r["state"], r["at"]) for r in sf.held_states(spark, str(tmp_path / "out")).collect()}
    assert held == {r: (1, "sampling", minute(5)) for r in runs[:100]} | {r: (1, "validating", minute(1)) for r in runs[100:]}
    refused = [(r["run"], r["attempt"], r["state"], r["at"], r["refused"]) for r in spark.read.parquet(f"{tmp_path}/out/data").collect()]
    assert len(refused) == len(runs) + 1
    assert set(refused) == {(r, 1, "queued", minute(8), "backwards") for r in runs} | {(None, None, "queued", None, "unknown_state")}
    # a key of the state costs calls to the JVM per batch: there are no more of them than buckets, and one for changes without a run
    assert sf.state_rows(spark, str(tmp_path / "out"), "latest").count() <= 9


def test_late_rows_and_sums_make_the_batch(spark, tmp_path):
    schema = "panel string, series string, ts timestamp, value double"
    day = lambda d: T0 + dt.timedelta(days=d)
    batches = [[("p", "s", day(0), 1.0), ("p", "s", day(40), 2.0)],
               [("p", "s", day(20), 4.0), ("p", "s", day(3), 8.0), ("p", "s", day(60), 16.0), ("p", "s", None, 32.0)],   # all within 35 days
               [("p", "s", day(21), 64.0), ("p", "s", day(17), 128.0), ("p", "s", day(1), 256.0), ("p", "s", day(61), None)]]
    out = str(tmp_path / "out")

    def run():
        stream = lambda: st.read_stream(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema)
        sf.week_batches(stream, out, ["panel"])

    feed(spark, tmp_path, batches, schema, run)
    late = {r["value"] for r in sf.late_rows(spark, out).collect()}
    assert late == {32.0, 128.0, 256.0}                          # the mark of the third batch is day 25: weeks that end by then are shut
    both = {(r["week_start"]): (r["total"], r["n"]) for r in sf.week_sums(spark, out, ["panel"], with_late=True).collect()}
    rows = spark.createDataFrame([r for b in batches for r in b], schema).where("ts IS NOT NULL")
    want = rows.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("w")).agg(F.sum("value").alias("t"), F.count("value").alias("n")).collect()
    assert both == {r["w"]: (r["t"], r["n"]) for r in want}
    alone = sf.week_sums(spark, out, ["panel"]).agg(F.sum("total")).first()[0]
    assert alone == pytest.approx(sum(v for b in batches for *_, v in b if v) - sum(late))


@pytest.fixture
def default_store(spark):
    """The session as a caller has it who sets no state store."""
    own = spark.conf.get(sf.STORE)
    spark.conf.unset(sf.STORE)
    spark.conf.set(sf.STORE, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    yield spark.conf.get(sf.STORE)
    spark.conf.set(sf.STORE, own)


def test_state_variables_under_the_default_store(spark, tmp_path, default_store):
    beats, changes = "run string, state string, heartbeat_at timestamp", "run long, attempt int, state string, at timestamp"

    def timeouts():
        stream = st.read_stream(spark, f"{tmp_path}/b/in/*", spark.createDataFrame([], beats).schema)
        sf.run_batches(lambda: sf.heartbeat_timeouts(stream), f"{tmp_path}/b/out", "append")

    def states():
        stream = st.read_stream(spark, f"{tmp_path}/c/in/*", spark.createDataFrame([], changes).schema)
        sf.run_batches(lambda: sf.run_states(stream), f"{tmp_path}/c/out", "append")

    feed(spark, tmp_path / "b", [[("a", "sampling", minute(0))], [("b", "sampling", minute(30))]], beats, timeouts)
    assert [r["run"] for r in spark.read.parquet(f"{tmp_path}/b/out/data").collect()] == ["a"]
    feed(spark, tmp_path / "c", [[(1, 1, "queued", minute(0))], [(1, 1, "sampling", minute(1))]], changes, states)
    assert [tuple(r) for r in sf.held_states(spark, f"{tmp_path}/c/out").collect()] == [(1, 1, "sampling", minute(1))]
    assert spark.conf.get(sf.STORE) == default_store
