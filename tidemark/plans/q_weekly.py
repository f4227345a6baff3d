"""Queries: from raw rows to the weekly master table."""

from pyspark.sql import functions as F

from tidemark import fixed_values as fx
from tidemark.frames import WEEK, to_wide
from tidemark.functions.dates import iso_week, iso_year, parse_date, week_start
from tidemark.operators import quality as ql, weekly as wk
from tidemark.plans import master as ms, recipe as rc
from tidemark.plans.inputs import (CHANNELS, ESSENTIAL, KEYS, MASTER_SQL, RAW_SQL, WEEKLY_SQL, master, media,
                                   raw_long, shop, table)
from tidemark.plans.q_transforms import date_texts
from tidemark.plans.registry import query


@query("drop_bad_dates", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders
 WHERE o_orderpriority <> '4-NOT SPECIFIED'""")
def _(spark, sf):
    df = date_texts(spark, sf).withColumn("day", F.to_date(parse_date(F.col("raw"))))
    return wk.drop_bad_dates(df, "day").select("o_orderkey", "day")


@query("median_day_gap", """WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders),
 g AS (SELECT o_custkey, day - lag(day) OVER (PARTITION BY o_custkey ORDER BY day) AS gap FROM d)
 SELECT o_custkey, CASE WHEN count(*)>=3 THEN quantile_cont(gap::DOUBLE,0.5) END AS median_gap FROM g GROUP BY 1""")
def _(spark, sf):
    return wk.median_day_gap(table(spark, sf, "orders").select("o_custkey", "o_orderdate"), ["o_custkey"], "o_orderdate")


def supplier_weeks(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", week_start(F.col("l_shipdate")).alias("week"), "l_returnflag")


SUPPLIER_WEEKS = """rows AS (SELECT l_suppkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, l_returnflag FROM lineitem),
 d AS (SELECT DISTINCT l_suppkey, week FROM rows),
 gaps AS (SELECT l_suppkey, CASE WHEN count(*)>=3 THEN quantile_cont(gap::DOUBLE,0.5) END AS g FROM
   (SELECT l_suppkey, week - lag(week) OVER (PARTITION BY l_suppkey ORDER BY week) AS gap FROM d) GROUP BY 1)"""


@query("drop_identical_rows", f"""WITH {SUPPLIER_WEEKS}
 SELECT DISTINCT rows.* FROM rows JOIN gaps USING (l_suppkey) WHERE coalesce(g,5)>=5
 UNION ALL SELECT rows.* FROM rows JOIN gaps USING (l_suppkey) WHERE g<5""")
def _(spark, sf):
    return wk.drop_identical_rows(supplier_weeks(spark, sf), ["l_suppkey"], "week", ["l_suppkey", "week", "l_returnflag"])


@query("agg_week", f"WITH {WEEKLY_SQL} SELECT * FROM weekly")
def _(spark, sf):
    return wk.aggregate_weeks(raw_long(spark, sf), KEYS)


@query("join_sources_outer", f"""WITH {WEEKLY_SQL} SELECT panel, week_start,
 max(value) FILTER (series='revenue') AS revenue, {', '.join(f"max(value) FILTER (series='{c}') AS {c}" for c in CHANNELS)}
 FROM weekly WHERE source<>'context' GROUP BY 1,2""")
def _(spark, sf):
    weekly = master(spark, sf).weekly
    left = to_wide(weekly.where(F.col("source") == "shop"), KEYS, ["revenue"])
    right = to_wide(weekly.where(F.col("source") == "media"), KEYS, CHANNELS)
    return wk.join_sources_wide([left, right], KEYS)


@query("window_overlap", f"WITH {MASTER_SQL} SELECT panel, window_start, window_end FROM win")
def _(spark, sf):
    return master(spark, sf).window.drop("problem")


@query("window_trim_report", f"""WITH {MASTER_SQL}, w AS (SELECT DISTINCT panel, source, week_start FROM weekly)
 SELECT w.panel, source, count(*) FILTER (week_start<window_start) AS weeks_before,
  count(*) FILTER (week_start>window_end) AS weeks_after, min(week_start)=any_value(window_start) AS pins_start,
  max(week_start)=any_value(window_end) AS pins_end FROM w JOIN win ON w.panel=win.panel GROUP BY 1,2""")
def _(spark, sf):
    m = master(spark, sf)
    return wk.window_trim_report(m.weekly, m.window, KEYS)


@query("grid_reindex", f"WITH {MASTER_SQL} SELECT panel, week_start, series, role, value FROM gappy")
def _(spark, sf):
    return master(spark, sf).gappy


@query("impute_spend_zero", f"WITH {MASTER_SQL} SELECT panel, week_start, series, role, value FROM master")
def _(spark, sf):
    return master(spark, sf).data


@query("gap_report", f"""WITH {MASTER_SQL} SELECT panel, series, role, count(*) AS n, min(week_start) AS first_week,
 max(week_start) AS last_week, role||'_gaps' AS code FROM gappy WHERE value IS NULL AND role<>'spend' GROUP BY 1,2,3""")
def _(spark, sf):
    return wk.gap_report(master(spark, sf).gappy, KEYS).drop("weeks")


B = "(PARTITION BY panel, series ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
A = "(PARTITION BY panel, series ORDER BY week_start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
P = "(PARTITION BY panel, series)"
LAST, NEXT = f"last_value(value IGNORE NULLS) OVER {B}", f"first_value(value IGNORE NULLS) OVER {A}"
D0 = f"last_value(CASE WHEN value IS NOT NULL THEN week_start END IGNORE NULLS) OVER {B}"
D1 = f"first_value(CASE WHEN value IS NOT NULL THEN week_start END IGNORE NULLS) OVER {A}"
FILL_SQL = {
    "zero": "coalesce(value, 0.0)",
    "ffill": f"coalesce(value, {LAST}, {NEXT})",
    "bfill": f"coalesce(value, {NEXT}, {LAST})",
    "interpolate": f"coalesce(value, {LAST}+({NEXT}-{LAST})*(week_start-{D0})/nullif({D1}-{D0},0), {LAST}, {NEXT})",
    "mean": f"coalesce(value, avg(value) OVER {P})",
    "median": f"coalesce(value, quantile_cont(value,0.5) OVER {P})",
}


def _fill_query(strategy):
    @query(f"fill_{strategy}", f"""WITH {MASTER_SQL} SELECT panel, week_start, series, role,
      round({FILL_SQL[strategy]}, 9) AS value FROM gappy WHERE role='control'""")
    def _(spark, sf):
        controls = master(spark, sf).gappy.where(F.col("role") == "control")
        return wk.fill_missing(controls, KEYS, strategy).withColumn("value", F.round("value", 9))


for _s in FILL_SQL:
    _fill_query(_s)


def big_orders(spark, sf):
    """Event weeks: one event name per status, on weeks of very large orders."""
    d = F.col("ts")
    return (shop(spark, sf).where(F.col("cents") > 49900000)
            .select("panel", F.lower(F.concat(F.lit("event_"), "status")).alias("name"),
                    iso_year(d).alias("iso_year"), iso_week(d).alias("iso_week")))


@query("event_dummy", f"""WITH {MASTER_SQL},
 e AS (SELECT DISTINCT panel, lower('event_'||status) AS name, CAST(date_trunc('week', ts) AS DATE) AS week_start FROM shop WHERE cents>49900000),
 n AS (SELECT DISTINCT panel, name FROM e), w AS (SELECT DISTINCT panel, week_start FROM master)
 SELECT n.panel, w.week_start, n.name AS series, 'control' AS role, CASE WHEN e.name IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS value
 FROM n JOIN w ON n.panel=w.panel LEFT JOIN e ON e.panel=n.panel AND e.name=n.name AND e.week_start=w.week_start""")
def _(spark, sf):
    return wk.event_dummies(master(spark, sf).data, big_orders(spark, sf), KEYS)


@query("master_build", f"""WITH {MASTER_SQL} SELECT panel, week_start, series, role,
  CASE WHEN series='rare_tax' THEN coalesce(value, {LAST}, {NEXT}) ELSE value END AS value FROM master
 UNION ALL SELECT n.panel, w.week_start, n.name, 'control', CASE WHEN e.name IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE
 FROM (SELECT DISTINCT panel, lower('event_'||status) AS name FROM shop WHERE cents>49900000) n
 JOIN (SELECT DISTINCT panel, week_start FROM master) w ON n.panel=w.panel
 LEFT JOIN (SELECT DISTINCT panel, lower('event_'||status) AS name, CAST(date_trunc('week', ts) AS DATE) AS week_start
   FROM shop WHERE cents>49900000) e ON e.panel=n.panel AND e.name=n.name AND e.week_start=w.week_start""")
def _(spark, sf):
    m, _issues = ms.build_master(raw_long(spark, sf), KEYS, ESSENTIAL, {"rare_tax": "ffill"}, big_orders(spark, sf))
    return m.data


@query("master_verdict", f"""WITH {MASTER_SQL}, issues AS (
  SELECT panel, 1 AS level FROM gappy WHERE value IS NULL AND role<>'spend'
  UNION ALL SELECT panel, 0 FROM gappy WHERE value IS NULL AND role='spend'
  UNION ALL SELECT panel, CASE WHEN w<4*c THEN 2 ELSE 1 END FROM (SELECT panel, count(DISTINCT week_start) AS w,
    count(DISTINCT series) FILTER (role='spend') AS c FROM master GROUP BY 1) WHERE w<8*c)
 SELECT p.panel, CASE coalesce(max(level),0) WHEN 2 THEN 'not_usable' WHEN 1 THEN 'usable_with_warnings' ELSE 'usable' END AS verdict
 FROM (SELECT DISTINCT panel FROM master) p LEFT JOIN issues i ON p.panel=i.panel GROUP BY 1""")
def _(spark, sf):
    m = master(spark, sf)
    gaps = wk.gap_report(m.gappy, KEYS).select("panel", F.lit("warning").alias("severity"))
    zero = wk.imputation_report(m.gappy, KEYS).select("panel", F.lit("info").alias("severity"))
    over = ql.over_parameterised(m.data, KEYS).select("panel", "severity")
    return ms.quality_verdict(gaps.unionByName(zero).unionByName(over), m.data, KEYS)


RECIPE = {
    "sources": [
        {"name": "shop", "columns": [{"name": "cents", "role": "kpi", "output_name": "revenue"}]},
        {"name": "media", "date_column": "ts", "columns": [{"name": "spend", "role": "spend", "output_name": "media_spend"},
                                                           {"name": "tax", "role": "control", "output_name": "tax", "fill": "ffill"}]},
    ],
    "event_dummies": [{"name": "launch", "weeks": [[1997, 10], [1999, 1]]}],
    "features": [{"name": "spend_lag1", "op": "lag", "inputs": ["media_spend"], "params": {"weeks": 1}}],
}


@query("recipe_build", f"""WITH {RAW_SQL}, a AS (SELECT panel, CAST(date_trunc('week', ts) AS DATE) AS week_start, sum(cents) AS v FROM shop GROUP BY 1,2),
 b AS (SELECT panel, CAST(date_trunc('week', ts) AS DATE) AS week_start, sum(spend) AS s, avg(tax) AS t FROM media GROUP BY 1,2),
 w AS (SELECT a.panel, greatest(min(a.week_start), any_value(lo)) AS lo, least(max(a.week_start), any_value(hi)) AS hi FROM a JOIN (SELECT panel, min(week_start) AS lo, max(week_start) AS hi FROM b GROUP BY 1) x ON a.panel=x.panel GROUP BY 1),
 g AS (SELECT panel, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week_start FROM w),
 j AS (SELECT g.panel, g.week_start, v, coalesce(s,0.0) AS s, t FROM g LEFT JOIN a ON g.panel=a.panel AND g.week_start=a.week_start LEFT JOIN b ON g.panel=b.panel AND g.week_start=b.week_start)
 SELECT panel, week_start, 'revenue' AS series, 'kpi' AS role, v AS value FROM j UNION ALL SELECT panel, week_start, 'media_spend', 'spend', s FROM j
 UNION ALL SELECT panel, week_start, 'tax', 'control', coalesce(t, last_value(t IGNORE NULLS) OVER (PARTITION BY panel ORDER BY week_start), first_value(t IGNORE NULLS) OVER (PARTITION BY panel ORDER BY week_start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) FROM j
 UNION ALL SELECT panel, week_start, 'launch', 'control', CASE WHEN (isoyear(week_start), week(week_start)) IN ((1997,10),(1999,1)) THEN 1.0 ELSE 0.0 END FROM j
 UNION ALL SELECT panel, week_start, 'spend_lag1', 'control', coalesce(lag(s) OVER (PARTITION BY panel ORDER BY week_start),0) FROM j""")
def _(spark, sf):
    frames = {"shop": shop(spark, sf).select("panel", "order_id", "ts", "cents"), "media": media(spark, sf).drop("channel", "line")}
    return rc.build_dataset(frames, rc.parse_recipe(RECIPE), KEYS).data


def _raw_rules(name, rows):
    """The rules on the raw rows of one source as SQL; ``rows`` is its table."""
    return f"""{name}_m AS (SELECT *, count(*) AS copies FROM {rows} GROUP BY ALL),
 {name}_g AS (SELECT panel, CASE WHEN count(*)>=3 THEN quantile_cont(gap::DOUBLE,0.5) END AS g FROM (SELECT panel, day-lag(day) OVER (PARTITION BY panel ORDER BY day) AS gap FROM (SELECT DISTINCT panel, CAST(ts AS DATE) AS day FROM {name}_m)) GROUP BY 1),
 {name}_d AS (SELECT panel, sum(k) AS n FROM (SELECT panel, CAST(ts AS DATE) AS day, count(*) AS k FROM {name}_m GROUP BY 1,2 HAVING count(*)>1) GROUP BY 1),
 {name}_w AS (SELECT panel, CAST(date_trunc('week', ts) AS DATE) AS week_start, sum(copies) AS k FROM {name}_m GROUP BY 1,2),
 {name}_e AS (SELECT *, week_start=min(week_start) OVER (PARTITION BY panel) AS f, week_start=max(week_start) OVER (PARTITION BY panel) AS l FROM {name}_w),
 {name}_t AS (SELECT panel, count(*) AS n, quantile_cont(k::DOUBLE,0.5) FILTER (NOT f AND NOT l) AS md FROM {name}_e GROUP BY 1),
 {name}_i AS (SELECT m.panel, CASE WHEN g<5 THEN 'duplicate_rows' ELSE 'duplicate_rows_dropped' END AS code FROM (SELECT panel, sum(copies-1) AS x FROM {name}_m GROUP BY 1 HAVING x>0) m JOIN {name}_g g ON m.panel=g.panel
   UNION ALL SELECT panel, 'duplicate_dates_aggregated' FROM {name}_d
   UNION ALL SELECT e.panel, 'partial_edge_week' FROM {name}_e e JOIN {name}_t t ON e.panel=t.panel WHERE (f OR l) AND n>=3 AND md>=2 AND k<0.6*md
   UNION ALL SELECT panel, 'coarse_cadence' FROM {name}_g WHERE g>10)"""


RAW_CODES = ("duplicate_rows", "duplicate_rows_dropped", "duplicate_dates_aggregated", "partial_edge_week", "coarse_cadence", "unparseable_dates", "source_window_trimmed",
             "window_boundary", *fx.BLOCKING_ROLE_CODES)


@query("recipe_raw_issues", f"""WITH {RAW_SQL}, sr AS (SELECT panel, order_id, ts, cents FROM shop), mr AS (SELECT panel, ts, spend, qty, tax FROM media), {_raw_rules('sh', 'sr')}, {_raw_rules('me', 'mr')},
 sp AS (SELECT panel, 'shop' AS source, week_start FROM sh_w UNION ALL SELECT panel, 'media', week_start FROM me_w),
 wi AS (SELECT panel, max(lo) AS a, min(hi) AS z FROM (SELECT panel, source, min(week_start) AS lo, max(week_start) AS hi FROM sp GROUP BY 1,2) GROUP BY 1 HAVING a<=z),
 ed AS (SELECT sp.panel, source, count(*) FILTER (week_start<a OR week_start>z) AS lost, min(week_start)=any_value(a) AS pa, max(week_start)=any_value(z) AS pz FROM sp JOIN wi ON sp.panel=wi.panel GROUP BY 1,2)
 SELECT panel, code, CASE WHEN code LIKE '%window%' THEN 'info' ELSE 'warning' END AS severity, source, "column" FROM (
  SELECT DISTINCT panel, code, 'shop' AS source, NULL AS "column" FROM sh_i UNION ALL SELECT DISTINCT panel, code, 'media', NULL FROM me_i
  UNION ALL SELECT panel, 'source_window_trimmed', source, NULL FROM ed WHERE lost>0 UNION ALL SELECT panel, 'window_boundary', source, 'start' FROM ed WHERE pa UNION ALL SELECT panel, 'window_boundary', source, 'end' FROM ed WHERE pz)""")
def _(spark, sf):
    """What a recipe build finds in the raw rows, the declared columns and the shared window."""
    frames = {"shop": shop(spark, sf).select("panel", "order_id", "ts", "cents"), "media": media(spark, sf).drop("channel", "line")}
    found = rc.build_dataset(frames, rc.parse_recipe(RECIPE), KEYS).issues
    return found.where(F.col("code").isin(*RAW_CODES)).select("panel", "code", "severity", "source", "column").distinct()
