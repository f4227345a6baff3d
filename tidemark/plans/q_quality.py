"""Queries: quality rules on raw rows and on the weekly table."""

from itertools import combinations

from pyspark.sql import functions as F

from tidemark import fixed_values as fx
from tidemark.frames import WEEK
from tidemark.functions.dates import week_start
from tidemark.operators import quality as ql, weekly as wk
from tidemark.plans.inputs import CHANNELS, CONTROLS, ESSENTIAL, KEYS, MASTER_SQL, RAW_SQL, master, media, raw_long, shop, table
from tidemark.plans import master as ms
from tidemark.plans.q_features import WIDE_SQL
from tidemark.plans.registry import query


@query("q_duplicate_dates", f"""WITH {RAW_SQL}, d AS (SELECT DISTINCT panel, ts, status, priority FROM shop),
 g AS (SELECT panel, CAST(ts AS DATE) AS day, count(*) AS k FROM d GROUP BY 1,2 HAVING count(*)>1)
 SELECT panel, CAST(sum(k) AS BIGINT) AS n_rows, count(*) AS n_dates, 'duplicate_dates_aggregated' AS code, 'warning' AS severity FROM g GROUP BY 1""")
def _(spark, sf):
    return ql.duplicate_dates(shop(spark, sf), KEYS, "ts", ["panel", "ts", "status", "priority"])


@query("q_partial_edge_week", f"""WITH r AS (SELECT l_suppkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS week_start, count(*) AS "rows" FROM lineitem GROUP BY 1,2),
 e AS (SELECT *, week_start=min(week_start) OVER (PARTITION BY l_suppkey) AS f, week_start=max(week_start) OVER (PARTITION BY l_suppkey) AS l FROM r),
 t AS (SELECT l_suppkey, count(*) AS n, quantile_cont("rows"::DOUBLE,0.5) FILTER (NOT f AND NOT l) AS median_rows FROM e GROUP BY 1)
 SELECT e.l_suppkey, week_start, "rows", median_rows, 'partial_edge_week' AS code, 'warning' AS severity FROM e JOIN t USING (l_suppkey)
 WHERE (f OR l) AND n>=3 AND median_rows>=2 AND "rows"<0.6*median_rows""")
def _(spark, sf):
    return ql.partial_edge_weeks(table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate"), ["l_suppkey"], "l_shipdate")


@query("q_coarse_cadence", """WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders),
 g AS (SELECT o_custkey, day - lag(day) OVER (PARTITION BY o_custkey ORDER BY day) AS gap FROM d),
 m AS (SELECT o_custkey, CASE WHEN count(*)>=3 THEN quantile_cont(gap::DOUBLE,0.5) END AS median_gap FROM g GROUP BY 1)
 SELECT o_custkey, median_gap, median_gap>=24 AS monthly, 'coarse_cadence' AS code, 'warning' AS severity FROM m WHERE median_gap>10""")
def _(spark, sf):
    return ql.coarse_cadence(table(spark, sf, "orders").select("o_custkey", "o_orderdate"), ["o_custkey"], "o_orderdate")


PAIRS = " UNION ALL ".join(
    f"SELECT panel, '{a}' AS a, '{b}' AS b, corr({a},{b}) AS r FROM wide GROUP BY panel" for a, b in combinations(CHANNELS, 2))


@query("q_near_identical", f"""WITH {WIDE_SQL}, p AS ({PAIRS})
 SELECT panel, a, b, round(r,6) AS r, 'near_identical_channels' AS code, 'warning' AS severity FROM p WHERE abs(r)>=0.05""")
def _(spark, sf):
    return ql.near_identical(master(spark, sf).data, KEYS, CHANNELS, 0.05).withColumn("r", F.round("r", 6))


Z_SQL = """med AS (SELECT panel, series, quantile_cont(value,0.5) AS med, count(value) AS n_values, stddev_pop(value) AS sd FROM master GROUP BY 1,2),
 dev AS (SELECT m.*, med, n_values, sd, value-med AS d FROM master m JOIN med USING (panel, series)),
 mad AS (SELECT panel, series, quantile_cont(abs(d),0.5)*1.4826 AS mad FROM dev GROUP BY 1,2),
 rz AS (SELECT dev.panel, week_start, dev.series, role, value, n_values, d/CASE WHEN mad>0 THEN mad WHEN sd>0 THEN sd END AS robust_z
   FROM dev JOIN mad ON dev.panel=mad.panel AND dev.series=mad.series)"""


@query("q_outlier_global", f"""WITH {MASTER_SQL}, {Z_SQL} SELECT panel, week_start, series, round(robust_z,6) AS robust_z FROM rz WHERE abs(robust_z)>3.5""")
def _(spark, sf):
    return ql.global_outliers(master(spark, sf).data, KEYS, 3.5).select("panel", WEEK, "series", F.round("robust_z", 6).alias("robust_z"))


@query("q_year_end", f"""WITH {MASTER_SQL}, {Z_SQL} SELECT panel, series, week_start, value, round(robust_z,6) AS robust_z,
 'year_end_anomaly' AS code, 'warning' AS severity FROM rz WHERE role='kpi' AND abs(robust_z)>1.5 AND n_values>=8 AND week(week_start) IN (1,52,53)""")
def _(spark, sf):
    return ql.year_end_anomalies(master(spark, sf).data, KEYS, 1.5).withColumn("robust_z", F.round("robust_z", 6))


NINE = "(PARTITION BY panel, series ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)"
LOCAL_SQL = f"""l1 AS (SELECT *, CASE WHEN count(value) OVER {NINE}>=4 THEN quantile_cont(value,0.5) OVER {NINE} END AS mid FROM master),
 l2 AS (SELECT *, abs(value-mid) AS dev FROM l1),
 l3 AS (SELECT *, CASE WHEN count(dev) OVER {NINE}>=4 THEN quantile_cont(dev,0.5) OVER {NINE} END*1.4826 AS scale FROM l2),
 loc AS (SELECT panel, week_start, series, role, value, coalesce(scale>0 AND dev/nullif(scale,0)>5, false) AS is_outlier,
   count(value) OVER (PARTITION BY panel, series) AS n_values FROM l3)"""


@query("q_outlier_local", f"WITH {MASTER_SQL}, {LOCAL_SQL} SELECT panel, week_start, series, is_outlier FROM loc")
def _(spark, sf):
    return ql.local_outliers(master(spark, sf).data, KEYS).select("panel", WEEK, "series", "is_outlier")


def _outliers(name, kpi, test, code, severity):
    @query(name, f"""WITH {MASTER_SQL}, {LOCAL_SQL} SELECT panel, series, role, count(*) AS n, min(week_start) AS first_week,
      '{code}' AS code, '{severity}' AS severity FROM loc WHERE is_outlier AND n_values>=8 AND {test} GROUP BY 1,2,3""")
    def _(spark, sf):
        return ql.outlier_weeks(master(spark, sf).data, KEYS, kpi).drop("points")


_outliers("q_kpi_outliers", True, "role='kpi'", "kpi_outlier_weeks", "warning")
_outliers("q_predictor_outliers", False, "role<>'kpi'", "predictor_outlier_weeks", "info")


@query("q_vif")
def _(spark, sf):
    m = wk.fill_missing(master(spark, sf).data, KEYS, "mean")
    return ql.vif(m, KEYS, [*CHANNELS, *CONTROLS]).withColumn("vif", F.round("vif", 6))


@query("q_degenerate", f"""WITH {MASTER_SQL}, m AS (SELECT panel, week_start, series, role, CASE WHEN series='ch_a_f' THEN CASE WHEN value>0 THEN 1.0 ELSE 0.0 END
    WHEN series='ch_n_f' THEN 0.0 WHEN series='ch_r_o' THEN -value WHEN series='avg_qty' THEN 7.0 ELSE value END AS value FROM master),
 s AS (SELECT panel, series, role, count(value) AS n, count(*) FILTER (value<0) AS neg, min(value) AS lo, max(value) AS hi,
   count(*) FILTER (value IS NOT NULL AND value NOT IN (0,1)) AS other FROM m GROUP BY 1,2,3)
 SELECT panel, series, 'negative_spend' AS code, 'warning' AS severity FROM s WHERE role='spend' AND neg>0
 UNION ALL SELECT panel, series, 'all_zero_channel', 'warning' FROM s WHERE role='spend' AND coalesce(lo=0 AND hi=0, true)
 UNION ALL SELECT panel, series, 'binary_column_as_spend', 'error' FROM s WHERE role='spend' AND n>0 AND other=0 AND lo<hi
 UNION ALL SELECT panel, series, 'zero_variance_column', 'warning' FROM s WHERE role<>'spend' AND n>=2 AND lo=hi""")
def _(spark, sf):
    s, v = F.col("series"), F.col("value")
    broken = (F.when(s == "ch_a_f", F.when(v > 0, 1.0).otherwise(0.0)).when(s == "ch_n_f", 0.0)
              .when(s == "ch_r_o", -v).when(s == "avg_qty", 7.0).otherwise(v))
    return ql.degenerate_columns(master(spark, sf).data.withColumn("value", broken), KEYS)


@query("q_over_param", f"""WITH w AS (SELECT p_brand, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS week_start, p_type AS series FROM lineitem JOIN part ON l_partkey=p_partkey),
 n AS (SELECT p_brand, count(DISTINCT week_start) AS n_weeks, count(DISTINCT series) AS n_channels FROM w GROUP BY 1)
 SELECT p_brand, n_weeks, n_channels, n_weeks/n_channels AS weeks_per_channel,
  CASE WHEN n_weeks/n_channels<4 THEN 'error' ELSE 'warning' END AS severity, 'too_many_parameters' AS code FROM n WHERE n_weeks/n_channels<8""")
def _(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_shipdate").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    spend = lines.select("p_brand", F.to_date(F.date_trunc("quarter", "l_shipdate")).alias(WEEK), F.col("p_type").alias("series"), F.lit("spend").alias("role"))
    kpi = spend.withColumn("series", F.lit("units")).withColumn("role", F.lit("kpi"))
    return ql.over_parameterised(spend.unionByName(kpi), ["p_brand"])


INFO = ",".join(f"('{c}','{t}','{a}')" for c, (_, t, a) in fx.ISSUE_INFO.items())


@query("q_issue_join", f"""WITH {MASTER_SQL}, i AS (SELECT panel, series, role||'_gaps' AS code FROM gappy WHERE value IS NULL AND role='control'
   UNION SELECT panel, series, 'spend_imputed_zero' FROM gappy WHERE value IS NULL AND role='spend')
 SELECT i.panel, i.series, i.code, explanation, action FROM i LEFT JOIN (VALUES {INFO}) t(code, explanation, action) ON i.code=t.code""")
def _(spark, sf):
    g = master(spark, sf).gappy
    gaps = wk.gap_report(g.where(F.col("role") == "control"), KEYS).select("panel", "series", "code")
    zero = wk.imputation_report(g, KEYS).select("panel", "series", "code")
    return ql.explain_issues(gaps.unionByName(zero))


@query("set_union_issues", f"""WITH {MASTER_SQL} SELECT panel, series, role||'_gaps' AS code, count(*) AS n, 0 AS check_no FROM gappy WHERE value IS NULL AND role='control' GROUP BY 1,2,3
 UNION ALL SELECT panel, series, 'spend_imputed_zero', count(*), 1 FROM gappy WHERE value IS NULL AND role='spend' GROUP BY 1,2""")
def _(spark, sf):
    g = master(spark, sf).gappy
    parts = [wk.gap_report(g.where(F.col("role") == "control"), KEYS).select("panel", "series", "code", "n"),
             wk.imputation_report(g, KEYS).select("panel", "series", "code", "n")]
    return ql.collect_issues(parts)


JUDGED = ["ch_a_f", "ch_n_o", "ch_r_f"]       # three predictors: their variance inflation has a closed form
R = {(a, b): f"corr({a},{b})" for a in JUDGED for b in JUDGED}


def _inflation(a, b, c):
    ab, ac, bc = R[a, b], R[a, c], R[b, c]
    return f"1/(1-({ab}*{ab}+{ac}*{ac}-2*{ab}*{ac}*{bc})/(1-{bc}*{bc}))"


VIF_SQL = " UNION ALL ".join(f"SELECT panel, '{a}' AS series, {_inflation(a, b, c)} AS vif FROM wide GROUP BY panel"
                             for a, b, c in (JUDGED, JUDGED[1:] + JUDGED[:1], JUDGED[2:] + JUDGED[:2]))


@query("q_vif_three", f"WITH {WIDE_SQL}, v AS ({VIF_SQL}) SELECT panel, series, round(vif,6) AS vif FROM v")
def _(spark, sf):
    return ql.vif(master(spark, sf).data, KEYS, JUDGED).withColumn("vif", F.round("vif", 6))


DEGENERATE_SQL = """SELECT panel, 'negative_spend' AS code, 'warning' AS severity, series FROM s WHERE role='spend' AND neg>0
 UNION ALL SELECT panel, 'all_zero_channel', 'warning', series FROM s WHERE role='spend' AND coalesce(lo=0 AND hi=0, true)
 UNION ALL SELECT panel, 'binary_column_as_spend', 'error', series FROM s WHERE role='spend' AND n>0 AND other=0 AND lo<hi
 UNION ALL SELECT panel, 'zero_variance_column', 'warning', series FROM s WHERE role<>'spend' AND n>=2 AND lo=hi"""


@query("master_issues", f"""WITH {WIDE_SQL}, {Z_SQL}, {LOCAL_SQL}, v AS ({VIF_SQL}), p AS ({PAIRS}),
 s AS (SELECT panel, series, role, count(value) AS n, count(*) FILTER (value<0) AS neg, min(value) AS lo, max(value) AS hi, count(*) FILTER (value IS NOT NULL AND value NOT IN (0,1)) AS other FROM master GROUP BY 1,2,3),
 t AS (SELECT w.panel, source, count(*) FILTER (week_start<window_start OR week_start>window_end) AS lost, min(week_start)=any_value(window_start) AS a, max(week_start)=any_value(window_end) AS z
   FROM (SELECT DISTINCT panel, source, week_start FROM weekly) w JOIN win ON w.panel=win.panel GROUP BY 1,2)
 SELECT DISTINCT * FROM (SELECT panel, role||'_gaps' AS code, 'warning' AS severity, series FROM gappy WHERE value IS NULL AND role<>'spend'
  UNION ALL SELECT panel, 'spend_imputed_zero', 'info', series FROM gappy WHERE value IS NULL AND role='spend'
  UNION ALL SELECT panel, 'year_end_anomaly', 'warning', series FROM rz WHERE role='kpi' AND abs(robust_z)>5 AND n_values>=8 AND week(week_start) IN (1,52,53)
  UNION ALL SELECT panel, CASE WHEN role='kpi' THEN 'kpi_outlier_weeks' ELSE 'predictor_outlier_weeks' END, CASE WHEN role='kpi' THEN 'warning' ELSE 'info' END, series FROM loc WHERE is_outlier AND n_values>=8
  UNION ALL {DEGENERATE_SQL}
  UNION ALL SELECT panel, 'too_many_parameters', CASE WHEN w<4*c THEN 'error' ELSE 'warning' END, NULL FROM (SELECT panel, count(DISTINCT week_start) AS w, count(DISTINCT series) FILTER (role='spend') AS c FROM master GROUP BY 1) WHERE w<8*c
  UNION ALL SELECT panel, 'source_window_trimmed', 'info', source FROM t WHERE lost>0
  UNION ALL SELECT panel, 'window_boundary', 'info', source FROM t WHERE (a OR z) AND source IN ('shop','media')
  UNION ALL SELECT panel, 'near_identical_channels', 'warning', a FROM p WHERE abs(r)>=0.95 AND a IN ('{"','".join(JUDGED)}') AND b IN ('{"','".join(JUDGED)}')
  UNION ALL SELECT panel, 'multicollinearity', 'warning', series FROM v WHERE vif>=10)""")
def _(spark, sf):
    """Every finding of a master build, with the collinearity of three channels."""
    _built, issues = ms.build_master(raw_long(spark, sf), KEYS, ESSENTIAL, predictors=JUDGED)
    return issues.select("panel", "code", "severity", "series").distinct()
