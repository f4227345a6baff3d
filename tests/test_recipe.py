import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import weekly as wk
from tidemark.plans import recipe as rc

K = ["panel"]
SF = "/root/testdata/sf0.001"
RECIPE = {
    "sources": [
        {"name": "orders", "date_column": "booked", "columns": [{"name": "turnover", "role": "kpi"}],
         "transforms": [{"op": "rename", "params": {"from": "total", "to": "turnover"}}]},
        {"name": "clicks", "columns": [{"name": "cost", "role": "spend", "output_name": "click_cost"}, {"name": "absent", "role": "spend"}]},
        {"name": "stock", "essential": False, "columns": [{"name": "level", "role": "control", "fill": "interpolate"}]},
    ],
    "event_dummies": [{"name": "spring_sale", "weeks": [[1995, 20]]}],
    "features": [{"name": "cost_before", "op": "lag", "inputs": ["click_cost"], "params": {"weeks": 1}}],
}
FIRST, LAST = dt.date(1995, 5, 1), dt.date(1995, 7, 9)


def frames(spark):
    """Orders of the test table, with a cost a day and a stock level every other week beside them."""
    o = spark.read.parquet(f"{SF}/orders.parquet").where(F.col("o_orderdate").between(str(FIRST), str(LAST)))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    orders = o.select(F.col("o_orderstatus").alias("panel"), day.alias("booked"), F.format_string("€ %.2f", "o_totalprice").alias("total"))
    panels = orders.select("panel").distinct()
    bad = panels.select("panel", F.lit("no date").alias("booked"), F.lit("1").alias("total"))
    days = panels.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit((LAST - FIRST).days))))
    at = F.date_format(F.date_add(F.lit(FIRST), F.col("i")), "yyyy-MM-dd")
    return {"orders": orders.unionByName(bad), "clicks": days.where("i >= 7").select("panel", at.alias("date"), F.lit("3").alias("cost")),
            "stock": days.where("i % 14 = 0").select("panel", at.alias("date"), F.col("i").cast("double").alias("level"))}


def test_recipe_builds_a_dataset(spark):
    source = frames(spark)
    ds = rc.build_dataset(source, rc.parse_recipe(RECIPE), K)
    panel = source["orders"].groupBy("panel").count().orderBy(F.desc("count"), "panel").first()["panel"]
    cells = {(x["series"], x["week_start"]): x["value"] for x in ds.data.where(F.col("panel") == panel).collect()}
    weeks = sorted({w for _, w in cells})
    assert weeks[0] >= FIRST + dt.timedelta(days=7) and all(b - a == dt.timedelta(days=7) for a, b in zip(weeks, weeks[1:]))
    money = {}
    for r in source["orders"].where((F.col("panel") == panel) & (F.col("booked") != "no date")).collect():
        d = dt.date.fromisoformat(r["booked"])
        money[d - dt.timedelta(days=d.weekday())] = money.get(d - dt.timedelta(days=d.weekday()), 0.0) + float(r["total"][2:])
    for w in weeks:
        assert w not in money or abs(cells["turnover", w] - money[w]) < 0.01
        assert cells["click_cost", w] == 21.0
        assert cells["level", w] == min(max((w - FIRST).days, 14), 56) and cells["spring_sale", w] == float(w == dt.date.fromisocalendar(1995, 20, 1))
    assert [cells["cost_before", w] for w in weeks[:2]] == [0.0, 21.0]
    codes = {x["code"] for x in ds.issues.collect()}
    assert {"currency_parsed", "unparseable_dates", "missing_column", "transform_applied", "feature_added"} <= codes
    assert ds.roles["cost_before"] == "control" and ds.verdict.count() >= 1


def test_names_used_twice_are_prefixed(spark):
    doc = {"sources": [{"name": s, "columns": [{"name": "spend", "role": "spend"}]} for s in ("a", "b")]}
    df = spark.createDataFrame([("p", "2024-01-01", 1.0), ("p", "2024-01-08", 2.0)], "panel string, week string, spend double")
    ds = rc.build_dataset({"a": df, "b": df}, rc.parse_recipe(doc), K)
    assert {x["series"] for x in ds.data.collect()} == {"a_spend", "b_spend"}


def test_recipe_without_sources():
    with pytest.raises(ValueError):
        rc.parse_recipe({"sources": []})


def weekly_source(spark, values, start=dt.date(2022, 1, 3), name="v"):
    """One source of a panel: a row a week."""
    rows = [("p", (start + dt.timedelta(days=7 * i)).isoformat(), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"panel string, date string, {name} double")


def dataset(spark, **sources):
    """(role, frame, column) by source name, built with a date column named ``date``."""
    doc = {"sources": [{"name": n, "date_column": "date", "columns": [{"name": c, "role": role}]} for n, (role, _, c) in sources.items()]}
    return rc.build_dataset({n: f for n, (_, f, _) in sources.items()}, rc.parse_recipe(doc), K)


def test_window_edges_and_lost_weeks_are_reported(spark):
    wiggle = [100 + (i * 37) % 23 for i in range(40)]
    ds = dataset(spark, rev=("kpi", weekly_source(spark, wiggle, name="revenue"), "revenue"),
                 google=("spend", weekly_source(spark, wiggle[4:38], dt.date(2022, 1, 31), "spend"), "spend"))
    found = {(r["code"], r["source"], r["column"]) for r in ds.issues.where("code IN ('window_boundary', 'source_window_trimmed')").collect()}
    assert found == {("window_boundary", "google", "start"), ("window_boundary", "google", "end"), ("source_window_trimmed", "rev", None)}
    assert ds.data.agg(F.min("week_start")).first()[0] == dt.date(2022, 1, 31)


def test_dependent_channels_are_flagged_and_others_not(spark):
    rng = np.random.default_rng(1)
    a, b, noise, kpi = rng.uniform(10, 100, 40), rng.uniform(10, 100, 40), rng.normal(0, 0.01, 40), 1000 + rng.normal(0, 20, 40)
    for c, flagged in ((a + b + noise, True), (rng.uniform(10, 100, 40), False)):
        ds = dataset(spark, rev=("kpi", weekly_source(spark, kpi, name="revenue"), "revenue"),
                     **{n: ("spend", weekly_source(spark, x, name=f"spend_{n}"), f"spend_{n}") for n, x in (("a", a), ("b", b), ("c", c))})
        assert (ds.issues.where("code = 'multicollinearity'").count() > 0) == flagged


def test_a_flag_booked_as_spend_stops_the_build_and_a_hint_does_not(spark):
    kpi = weekly_source(spark, [100 + (i * 37) % 23 for i in range(60)], name="revenue")
    flag = weekly_source(spark, [i % 2 for i in range(60)], name="campaign")
    ds = dataset(spark, rev=("kpi", kpi, "revenue"), flag=("spend", flag, "campaign"))
    issue = ds.issues.where("code = 'binary_column_as_spend' AND `column` = 'campaign'").first()
    assert issue["severity"] == "error" and ds.verdict.first()["verdict"] == "not_usable"
    rising = weekly_source(spark, range(1000, 1060), name="revenue")
    ds = dataset(spark, rev=("kpi", rising, "revenue"), ads=("spend", weekly_source(spark, [5 + (i * 31) % 17 for i in range(60)], name="ads"), "ads"))
    hint = ds.issues.where("code = 'looks_like_identifier'").first()
    assert hint["severity"] == "warning" and ds.verdict.first()["verdict"] != "not_usable"


def test_copies_count_by_cadence(spark):
    """Identical rows are bookings where rows are daily, and copies where they are weekly."""
    days = [("daily", (dt.date(2022, 1, 3) + dt.timedelta(days=i)).isoformat(), 1.0) for i in range(70) for _ in range(2)]
    weeks = [("weekly", (dt.date(2022, 1, 3) + dt.timedelta(days=7 * i)).isoformat(), 5.0 + i) for i in range(10) for _ in range(3)]
    nulls = [("weekly", "2022-01-03", None), ("weekly", "2022-01-03", None), (None, "2022-01-03", 4.0)]
    df = spark.createDataFrame(days + weeks + nulls, "panel string, date string, revenue double")
    ds = dataset(spark, rev=("kpi", df, "revenue"))
    got = {(r["panel"], r["week_start"]): r["value"] for r in ds.data.collect()}
    assert got["daily", dt.date(2022, 1, 10)] == 14.0 and got["weekly", dt.date(2022, 1, 10)] == 6.0 and got["weekly", dt.date(2022, 1, 3)] == 5.0
    codes = {(r["panel"], r["code"]) for r in ds.issues.collect()}
    assert ("daily", "duplicate_rows") in codes and ("weekly", "duplicate_rows_dropped") in codes


def test_a_source_is_read_once(spark, tmp_path):
    weekly_source(spark, [100 + (i * 37) % 23 for i in range(30)], name="revenue").write.parquet(f"{tmp_path}/rev")
    source = spark.read.parquet(f"{tmp_path}/rev")
    ds = dataset(spark, rev=("kpi", source, "revenue"))
    for part in (ds.data, ds.issues, ds.verdict):
        assert str(tmp_path) not in part._jdf.queryExecution().executedPlan().toString()


def test_different_rows_tell_nulls_apart(spark):
    rows = [("p", "a", None, 1), ("p", None, "a", 1), ("p", "a", None, 1), ("p", "", None, 1)]
    df = spark.createDataFrame(rows, "panel string, x string, y string, ts int")
    got = sorted((r["x"] or "-", r["y"] or "-", r["_copies"]) for r in wk.different_rows(df, K, "ts", ["panel", "x", "y", "ts"], ["x", "y"]).collect())
    assert got == [("-", "-", 1), ("-", "a", 1), ("a", "-", 2)]
