"""Marketing-mix inputs drawn from the TPC-H-like test tables, in Spark and in SQL.

A panel is a market (region). ``orders`` gives the outcome, ``lineitem`` the channels (return
flag x line status) and two controls. Amounts are whole cents, so sums are exact in any order
and both engines agree to the last bit. Draw tables follow from the weekly table by fixed
arithmetic.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.frames import stored
from tidemark.functions.response import hill_effect
from tidemark.operators.features import row_index
from tidemark.operators.weekly import aggregate_weeks
from tidemark.plans.master import Master, from_weekly

KEYS = ["panel"]
ESSENTIAL = ["shop", "media"]
CHANNELS = ["ch_a_f", "ch_a_o", "ch_n_f", "ch_n_o", "ch_r_f", "ch_r_o"]
CONTROLS = ["avg_qty", "rare_tax"]
DRAWS = 40


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def markets(spark, sf) -> DataFrame:
    return (table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("n_nationkey").alias("nation"), F.col("r_name").alias("panel")))


def shop(spark, sf) -> DataFrame:
    """One row per order: (panel, order_id, ts, amount in cents, status, priority)."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return (table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .join(markets(spark, sf), F.col("c_nationkey") == F.col("nation"))
            .select("panel", F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("ts"),
                    F.round(F.col("o_totalprice") * 100).alias("cents"),
                    F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")))


def media(spark, sf) -> DataFrame:
    """One row per line: (panel, ts, channel, spend in hundredths of a cent, qty, tax in cents, line)."""
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    channel = F.lower(F.concat(F.lit("ch_"), "l_returnflag", F.lit("_"), "l_linestatus"))
    return (table(spark, sf, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(markets(spark, sf), F.col("s_nationkey") == F.col("nation"))
            .select("panel", F.col("l_shipdate").alias("ts"), channel.alias("channel"),
                    F.round(F.col("l_extendedprice") * F.col("l_discount") * 10000).alias("spend"),
                    F.col("l_quantity").alias("qty"), F.round(F.col("l_tax") * 100).alias("tax"),
                    F.col("l_linenumber").alias("line")))


def raw_long(spark, sf) -> DataFrame:
    """All raw rows in long form. A line yields its series side by side, so lines are scanned once
    and map-side aggregation folds them before anything moves."""
    def cell(source, series, role, value):
        return F.struct(F.lit(source).alias("source"), series.alias("series"), F.lit(role).alias("role"), value.alias("value"))

    rare = F.col("channel").startswith("ch_r") & (F.col("line") == 7)
    of_line = F.array(cell("media", F.col("channel"), "spend", F.col("spend")),
                      cell("context", F.lit("avg_qty"), "control", F.col("qty")),
                      F.when(rare, cell("context", F.lit("rare_tax"), "control", F.col("tax"))))
    lines = media(spark, sf).select("panel", "ts", F.explode(of_line).alias("_c")).where("_c IS NOT NULL").select("panel", "_c.source", "ts", "_c.series", "_c.role", "_c.value")
    orders = shop(spark, sf).select("panel", F.lit("shop").alias("source"), "ts", F.lit("revenue").alias("series"),
                                    F.lit("kpi").alias("role"), F.col("cents").alias("value"))
    return orders.unionByName(lines)


_BUILT: dict[tuple, DataFrame] = {}


def built(spark, sf, name: str, build) -> DataFrame:
    """A derived table, stored on first use: master and draws are stored tables in practice."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _BUILT:
        _BUILT[key] = stored(build(), name)
    return _BUILT[key]


def once(spark, sf, name: str, build):
    """What ``build`` gives, built on first use; for results that store their own tables."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def forget() -> None:
    """Drop what was built, so that the next query pays for it again."""
    _BUILT.clear()


def master(spark, sf) -> Master:
    """The weekly master over stored weekly sums; its gap-free data is stored as well."""
    weekly = built(spark, sf, "weekly", lambda: aggregate_weeks(raw_long(spark, sf), KEYS))
    m = from_weekly(weekly, KEYS, ESSENTIAL)
    return replace(m, data=built(spark, sf, "master", lambda: m.data))


def channel_index(series):
    """A small whole number per channel name, used to spread the derived draws."""
    return (F.ascii(F.substring(series, 4, 1)) + F.ascii(F.substring(series, 6, 1))) % 7 + 1


def params(spark, sf) -> DataFrame:
    """(panel, series, draw, beta, half_sat, slope, alpha, x_max, y_max, current)."""
    return built(spark, sf, "params", lambda: _params(spark, sf))


def _params(spark, sf) -> DataFrame:
    m = master(spark, sf).data
    y = m.where(F.col("role") == "kpi").groupBy("panel").agg(F.max("value").alias("y_max"))
    x = m.where(F.col("role") == "spend").groupBy("panel", "series").agg(
        F.max("value").alias("x_max"), F.avg("value").alias("current"))
    i, d = F.col("idx").cast("double"), F.col("draw").cast("double")
    return (x.join(y, "panel").withColumn("idx", channel_index(F.col("series")))
            .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))
            .select("panel", "series", "draw", "idx",
                    (F.lit(0.02) * i * (F.lit(1.0) + F.lit(0.3) * F.sin(d * i))).alias("beta"),
                    (F.lit(0.3) + F.lit(0.05) * F.cos(d + i)).alias("half_sat"),
                    F.lit(1.0).alias("slope"),
                    (F.lit(0.3) + F.lit(0.05) * i + F.lit(0.02) * F.sin(d * 0.5)).alias("alpha"),
                    "x_max", "y_max", "current"))


def contributions(spark, sf) -> DataFrame:
    """(panel, week_start, series, draw, contrib, spend, y_max): scaled effect per week and draw."""
    spend = (master(spark, sf).data.where(F.col("role") == "spend")
             .select("panel", "week_start", "series", F.col("value").alias("spend")))
    p = params(spark, sf)
    effect = F.col("beta") * hill_effect(F.col("spend") / F.col("x_max"), F.col("half_sat"), F.col("slope"))
    return (spend.join(p, ["panel", "series"])
            .select("panel", "week_start", "series", "draw", effect.alias("contrib"), "spend", "y_max", "alpha"))


def baselines(spark, sf) -> DataFrame:
    """(panel, week_start, draw, level, season, base, actual, y_max): the non-media part."""
    k = (master(spark, sf).data.where((F.col("role") == "kpi"))
         .withColumn("y_max", F.max("value").over(Window.partitionBy("panel")))
         .withColumn("t", row_index(KEYS)))
    actual = F.coalesce("value", F.lit(0.0))
    d = F.col("draw").cast("double")
    level = F.lit(0.4) * actual / F.col("y_max") + F.lit(0.02) * F.sin(d)
    season = F.lit(0.01) * F.cos(F.col("t") * 0.12 + d)
    return (k.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))
            .select("panel", "week_start", "draw", level.alias("level"), season.alias("season"),
                    (level + season).alias("base"), actual.alias("actual"), "y_max", "t"))


def expected(spark, sf) -> DataFrame:
    """(panel, week_start, draw, base, media, mu, actual, y_max): total per week and draw.

    Draw sums are rounded to 12 digits so that the order of addition cannot show.
    """
    c = contributions(spark, sf).groupBy("panel", "week_start", "draw").agg(F.round(F.sum("contrib"), 12).alias("media"))
    b = baselines(spark, sf)
    return (b.join(c, ["panel", "week_start", "draw"])
            .withColumn("mu", F.col("base") + F.col("media")))


# --- the same inputs in SQL ---------------------------------------------------------------

RAW_SQL = """
shop AS (SELECT r_name AS panel, o_orderkey AS order_id, o_orderdate AS ts, round(o_totalprice*100) AS cents,
    o_orderstatus AS status, o_orderpriority AS priority
  FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey
  JOIN region ON n_regionkey=r_regionkey),
media AS (SELECT r_name AS panel, l_shipdate AS ts, lower('ch_'||l_returnflag||'_'||l_linestatus) AS channel,
    round(l_extendedprice*l_discount*10000) AS spend, l_quantity AS qty, round(l_tax*100) AS tax, l_linenumber AS line
  FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey
  JOIN region ON n_regionkey=r_regionkey),
raw_long AS (
  SELECT panel, 'shop' AS source, ts, 'revenue' AS series, 'kpi' AS role, cents AS value FROM shop
  UNION ALL SELECT panel, 'media', ts, channel, 'spend', spend FROM media
  UNION ALL SELECT panel, 'context', ts, 'avg_qty', 'control', qty FROM media
  UNION ALL SELECT panel, 'context', ts, 'rare_tax', 'control', tax FROM media WHERE channel LIKE 'ch_r%' AND line=7)"""

WEEKLY_SQL = RAW_SQL + """,
weekly AS (SELECT panel, source, CAST(date_trunc('week', ts) AS DATE) AS week_start, series, role,
    CASE WHEN role='control' THEN avg(value) ELSE coalesce(sum(value),0) END AS value
  FROM raw_long GROUP BY panel, source, CAST(date_trunc('week', ts) AS DATE), series, role)"""

MASTER_SQL = WEEKLY_SQL + """,
spans AS (SELECT panel, source, min(week_start) AS lo, max(week_start) AS hi FROM weekly GROUP BY 1,2),
win AS (SELECT panel, max(lo) AS window_start, min(hi) AS window_end FROM spans
  WHERE source IN ('shop','media') GROUP BY 1),
grid AS (SELECT s.panel, s.series, s.role,
    CAST(unnest(generate_series(w.window_start, w.window_end, INTERVAL 7 DAY)) AS DATE) AS week_start
  FROM (SELECT DISTINCT panel, series, role FROM weekly) s JOIN win w ON s.panel=w.panel),
gappy AS (SELECT g.panel, g.week_start, g.series, g.role, k.value FROM grid g
  LEFT JOIN weekly k ON g.panel=k.panel AND g.series=k.series AND g.week_start=k.week_start),
master AS (SELECT panel, week_start, series, role,
    CASE WHEN role='spend' THEN coalesce(value,0.0) ELSE value END AS value FROM gappy)"""

DRAWS_SQL = MASTER_SQL + f""",
ymax AS (SELECT panel, max(value) AS y_max FROM master WHERE role='kpi' GROUP BY 1),
chan AS (SELECT m.panel, series, max(value) AS x_max, avg(value) AS current_spend, any_value(y_max) AS y_max,
    (ascii(substr(series,4,1)) + ascii(substr(series,6,1))) % 7 + 1 AS idx
  FROM master m JOIN ymax y ON m.panel=y.panel WHERE role='spend' GROUP BY 1,2),
params AS (SELECT panel, series, draw, idx, 0.02::DOUBLE*idx*(1.0::DOUBLE+0.3::DOUBLE*sin(draw::DOUBLE*idx)) AS beta,
    0.3::DOUBLE+0.05::DOUBLE*cos(draw::DOUBLE+idx) AS half_sat, 1.0::DOUBLE AS slope,
    0.3::DOUBLE+0.05::DOUBLE*idx+0.02::DOUBLE*sin(draw*0.5::DOUBLE) AS alpha, x_max, y_max, current_spend AS current
  FROM (SELECT *, unnest(generate_series(0, {DRAWS - 1})) AS draw FROM chan)),
contributions AS (SELECT s.panel, s.week_start, s.series, draw,
    beta*(pow(value/x_max+1e-6,slope)/(pow(half_sat,slope)+pow(value/x_max+1e-6,slope))
      - pow(1e-6::DOUBLE,slope)/(pow(half_sat,slope)+pow(1e-6::DOUBLE,slope))) AS contrib, value AS spend, y_max, alpha
  FROM master s JOIN params p ON s.panel=p.panel AND s.series=p.series WHERE role='spend'),
kp AS (SELECT m.panel, week_start, coalesce(value,0.0) AS actual, y_max,
    CAST(row_number() OVER (PARTITION BY m.panel ORDER BY week_start)-1 AS DOUBLE) AS t
  FROM master m JOIN ymax y ON m.panel=y.panel WHERE role='kpi'),
baselines AS (SELECT panel, week_start, draw, actual, y_max, t,
    0.4::DOUBLE*actual/y_max+0.02::DOUBLE*sin(draw::DOUBLE) AS level, 0.01::DOUBLE*cos(t*0.12::DOUBLE+draw::DOUBLE) AS season,
    (0.4::DOUBLE*actual/y_max+0.02::DOUBLE*sin(draw::DOUBLE)) + 0.01::DOUBLE*cos(t*0.12::DOUBLE+draw::DOUBLE) AS base
  FROM (SELECT *, unnest(generate_series(0, {DRAWS - 1})) AS draw FROM kp)),
expected AS (SELECT b.*, c.media, b.base + c.media AS mu FROM baselines b JOIN
    (SELECT panel, week_start, draw, round(sum(contrib),12) AS media FROM contributions GROUP BY 1,2,3) c
  ON b.panel=c.panel AND b.week_start=c.week_start AND b.draw=c.draw)"""
