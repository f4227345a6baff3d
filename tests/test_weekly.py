import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality as ql, weekly as wk
from tidemark.plans import master as ms

K = ["panel"]
SCHEMA = "panel string, source string, ts date, series string, role string, value double"


def days(start, n, source, series, role, value, panel="p1"):
    d0 = dt.date.fromisoformat(start)
    return [(panel, source, d0 + dt.timedelta(days=i), series, role, value) for i in range(n)]


@pytest.fixture
def three_sources(spark):
    rows = []
    for p in ("p1", "p2"):
        rows += days("2022-01-03", 84, "shop", "revenue", "kpi", 1000.0, p)
        rows += days("2022-01-03", 84, "google", "google", "spend", 50.0, p)
        rows += days("2022-02-07", 49, "facebook", "facebook", "spend", 30.0, p)
        rows += days("2021-12-06", 147, "price", "price", "control", 9.99, p)
    return spark.createDataFrame(rows, SCHEMA)


def test_three_sources(three_sources):
    m = ms.weekly_master(three_sources, K, ["shop", "google", "facebook"])
    w = m.window.where("panel='p1'").first()
    assert str(w["window_start"]) == "2022-02-07" and w["problem"] is None
    rows = m.data.where("panel='p2'").collect()
    assert len({r["week_start"] for r in rows}) == 7
    assert {r["value"] for r in rows if r["series"] == "google"} == {350.0}
    assert {r["value"] for r in rows if r["series"] == "facebook"} == {210.0}
    assert all(abs(r["value"] - 9.99) < 1e-9 for r in rows if r["series"] == "price")
    trim = {r["source"]: r for r in wk.window_trim_report(m.weekly, m.window, K).where("panel='p1'").collect()}
    assert trim["google"]["weeks_before"] == 5 and trim["facebook"]["pins_start"] and not trim["google"]["pins_start"]


def test_no_overlap(spark):
    rows = days("2022-01-03", 7, "a", "a", "kpi", 1.0) + days("2022-06-06", 7, "b", "b", "spend", 1.0)
    m = ms.weekly_master(spark.createDataFrame(rows, SCHEMA), K, ["a", "b"])
    assert m.window.first()["problem"] == "no_overlap" and m.data.count() == 0
    none = wk.overlap_window(wk.source_spans(m.weekly, K), K, ["c"])
    assert none.first()["problem"] == "no_essential_data"


def test_kpi_gap_is_reported_not_filled(spark):
    rows = [r for r in days("2022-01-03", 28, "a", "rev", "kpi", 10.0) if not dt.date(2022, 1, 17) <= r[2] <= dt.date(2022, 1, 23)]
    rows += days("2022-01-03", 28, "b", "tv", "spend", 1.0)
    m = ms.weekly_master(spark.createDataFrame(rows, SCHEMA), K, ["a", "b"])
    g = wk.gap_report(m.gappy, K).collect()
    assert [(r["code"], r["n"], str(r["first_week"])) for r in g] == [("kpi_gaps", 1, "2022-01-17")]


def test_all_null_week(spark):
    rows = [("p1", "a", dt.date(2022, 1, 3), "rev", "kpi", None), ("p1", "a", dt.date(2022, 1, 3), "px", "control", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    r = {x["series"]: x["value"] for x in wk.aggregate_weeks(df, K).collect()}
    assert r == {"rev": 0.0, "px": None}
    assert {x["value"] for x in wk.aggregate_weeks(df, K, null_weeks="keep").collect()} == {None}


def test_identical_rows(spark):
    weekly = [("p1", dt.date(2022, 1, 3) + dt.timedelta(days=7 * i), 10.0) for i in range(10)]
    daily = [("p2", dt.date(2022, 1, 3) + dt.timedelta(days=i), 10.0) for i in range(90)]
    df = spark.createDataFrame(weekly + weekly[3:4] + daily + daily[8:9], "panel string, ts date, v double")
    out = wk.drop_identical_rows(df, K, "ts", ["panel", "ts", "v"])
    n = {r["panel"]: r["count"] for r in out.groupBy("panel").count().collect()}
    assert n == {"p1": 10, "p2": 91}
    codes = {r["panel"]: r["code"] for r in wk.identical_row_issues(df, K, "ts", ["panel", "ts", "v"]).collect()}
    assert codes == {"p1": "duplicate_rows_dropped", "p2": "duplicate_rows"}


def test_identical_rows_by_bounded_tasks(spark, monkeypatch):
    """What a task holds follows ROWS_OF_TASK, not the table: more rows, more tasks, the same result."""
    rows = [(f"p{i % 40}", dt.date(2022, 1, 3) + dt.timedelta(days=7 * (i // 80)), 1.0) for i in range(2400)]
    df = spark.createDataFrame(rows, "panel string, ts date, v double")
    monkeypatch.setattr(wk, "ROWS_OF_TASK", 100)
    out = wk.drop_identical_rows(df, K, "ts", ["panel", "ts", "v"])
    assert out.count() == 1200 and "REPARTITION_BY_NUM" in out._jdf.queryExecution().toString()


def test_rules_on_days_give_the_same(spark):
    rows = [("p1", dt.datetime(2022, 1, 3, h) + dt.timedelta(days=d), float(v), n) for d in range(60) for h, v, n in ((1, d, 1), (5, d % 3, 1 + d % 2))]
    rows = spark.createDataFrame(rows[:-1] + [("p2", None, 1.0, 3), ("p2", dt.datetime(2022, 1, 3), 2.0, 2)], "panel string, ts timestamp, v double, _copies long")
    days = wk.rows_per_day(rows, K, "ts")
    for rule in (wk.bad_date_issues, wk.copy_issues, wk.keeps_copies, lambda r, k, t: ql.duplicate_dates(r, k, t, []), ql.partial_edge_weeks, ql.coarse_cadence):
        a, b = (sorted(map(str, rule(x.where("ts IS NOT NULL") if rule is not wk.bad_date_issues else x, K, "ts").collect())) for x in (rows, days))
        assert a == b
    assert days.count() < rows.count()


FILLS = {
    "zero": [0, 1, 0, 0, 4, 0], "ffill": [1, 1, 1, 1, 4, 4], "bfill": [1, 1, 4, 4, 4, 4],
    "interpolate": [1, 1, 2, 3, 4, 4], "mean": [2.5, 1, 2.5, 2.5, 4, 2.5], "median": [2.5, 1, 2.5, 2.5, 4, 2.5],
}


@pytest.mark.parametrize("how", list(FILLS))
def test_fills(weekly, how):
    m = weekly(shift=0.0, x=("control", [None, 1, None, None, 4, None]))
    r = wk.fill_missing(m, K, how).where("panel='p2'").orderBy("week_start").collect()
    assert [x["value"] for x in r] == [float(v) for v in FILLS[how]]


def test_event_dummy(spark, weekly):
    m = weekly(kpi=("kpi", range(5)))
    ev = spark.createDataFrame([("p1", "sale", 2024, 2), ("p1", "late", 2030, 1)], "panel string, name string, iso_year int, iso_week int")
    d = wk.event_dummies(m, ev, K)
    assert [r["value"] for r in d.where("series='sale'").orderBy("week_start").collect()] == [0, 1, 0, 0, 0]
    codes = {r["series"]: r["code"] for r in wk.event_issues(d, m.select("panel", "series"), K).collect()}
    assert codes == {"late": "event_dummy_outside_window"}


def test_trending_kpi_with_spike(spark):
    values = list(np.linspace(550, 950, 156))
    values[99] += 400
    d0 = dt.date(2021, 1, 4)
    m = spark.createDataFrame([("p1", d0 + dt.timedelta(days=7 * i), "rev", "kpi", float(v)) for i, v in enumerate(values)],
                              "panel string, week_start date, series string, role string, value double")
    r = ql.outlier_weeks(m, K, kpi=True).collect()
    assert len(r) == 1 and r[0]["n"] == 1 and r[0]["first_week"] == d0 + dt.timedelta(days=7 * 99)
    assert ql.year_end_anomalies(m, K).count() == 0


def test_quality_rules(weekly):
    n = 20
    m = weekly(shift=0.0, rev=("kpi", range(1, n + 1)), a=("spend", [(-1) ** i * 5 for i in range(n)]), b=("spend", [0] * n),
               c=("spend", [i % 2 for i in range(n)]), px=("control", [3] * n))
    codes = {(r["series"], r["code"], r["severity"]) for r in ql.degenerate_columns(m, K).where("panel='p1'").collect()}
    assert codes == {("a", "negative_spend", "warning"), ("b", "all_zero_channel", "warning"),
                     ("c", "binary_column_as_spend", "error"), ("px", "zero_variance_column", "warning")}
    over = ql.over_parameterised(m, K).where("panel='p1'").first()
    assert over["severity"] == "warning" and abs(over["weeks_per_channel"] - 20 / 3) < 1e-9


def test_near_identical_and_vif(weekly):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(1, 9, 40), rng.uniform(1, 9, 40)
    m = weekly(shift=0.0, a=("spend", a), b=("spend", b), c=("spend", a + b + rng.normal(0, 0.05, 40)), d=("spend", a * 1.001))
    pairs = {(r["a"], r["b"]) for r in ql.near_identical(m, K, ["a", "b", "c", "d"]).where("panel='p1'").collect()}
    assert ("a", "d") in pairs and ("a", "b") not in pairs
    v = {r["series"]: r["vif"] for r in ql.vif(m, K, ["a", "b", "c"]).where("panel='p2'").collect()}
    x = np.column_stack([a, b, a + b])
    assert min(v.values()) > 10
    assert {r["series"] for r in ql.multicollinearity(m, K, ["a", "b", "c"]).where("panel='p1'").collect()} == {"a", "b", "c"}


def test_edges_cadence_duplicates(spark):
    rows = [("p1", dt.date(2022, 1, 9))] + [("p1", dt.date(2022, 1, 10) + dt.timedelta(days=i)) for i in range(28)]
    df = spark.createDataFrame(rows, "panel string, ts date")
    e = ql.partial_edge_weeks(df, K, "ts").collect()
    assert [(str(r["week_start"]), r["rows"]) for r in e] == [("2022-01-03", 1)]
    monthly = spark.createDataFrame([("p1", dt.date(2022, m, 1)) for m in range(1, 9)], "panel string, ts date")
    assert ql.coarse_cadence(monthly, K, "ts").first()["monthly"]
    dup = spark.createDataFrame([("p1", dt.date(2022, 1, 24), 10.0), ("p1", dt.date(2022, 1, 24), 999.0), ("p1", dt.date(2022, 1, 31), 1.0)], "panel string, ts date, v double")
    assert ql.duplicate_dates(dup, K, "ts", ["panel", "ts", "v"]).first()["n_rows"] == 2


def test_build_master_and_verdict(three_sources):
    m, issues = ms.build_master(three_sources, K, ["shop", "google", "facebook"], {"price": "ffill"})
    v = {r["panel"]: r["verdict"] for r in ms.quality_verdict(issues, m.data, K).collect()}
    assert set(v) == {"p1", "p2"} and v["p1"] == "not_usable"  # 7 weeks for 2 channels
