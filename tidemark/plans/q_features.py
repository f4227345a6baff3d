"""Queries: derived weekly features."""

from pyspark.sql import Window, functions as F

from tidemark import fixed_values as fx
from tidemark.frames import WEEK, to_wide
from tidemark.operators import features as ft
from tidemark.plans.inputs import CHANNELS, KEYS, MASTER_SQL, master, shop
from tidemark.plans.registry import query
from tidemark.types import Feature

W = "(PARTITION BY panel, series ORDER BY week_start)"
P = "(PARTITION BY panel, series)"
Z = "coalesce({}, 0.0)"


def _feature(name, column, sql, digits=None, controls_only=False):
    """Register a feature; ``controls_only`` rounds controls, as whole amounts are exact anyway."""
    value = f"round({sql}, {digits})" if digits is not None else sql
    if controls_only:
        value = f"CASE WHEN role='control' THEN {value} ELSE {sql} END"

    @query(name, f"WITH {MASTER_SQL} SELECT panel, week_start, series, {value} AS feature FROM master")
    def _(spark, sf):
        c = column() if digits is None else F.round(column(), digits)
        if controls_only:
            c = F.when(F.col("role") == "control", c).otherwise(column())
        return master(spark, sf).data.select("panel", WEEK, "series", c.alias("feature"))


FOUR = "(PARTITION BY panel, series ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
_feature("ft_lag", lambda: ft.lag(KEYS, 2), f"coalesce(lag(value,2) OVER {W}, 0)")
_feature("ft_rolling_mean", lambda: ft.rolling_mean(KEYS, 4), Z.format(f"avg(value) OVER {FOUR}"), 7, True)
_feature("ft_rolling_sum", lambda: ft.rolling_sum(KEYS, 4), Z.format(f"sum(value) OVER {FOUR}"), 7, True)
_feature("ft_diff", lambda: ft.diff(KEYS, 1), Z.format(f"value - lag(value,1) OVER {W}"))
_feature("ft_log1p", lambda: ft.log1p(), Z.format("sign(value)*ln(1+abs(value))"), 6)
_feature("ft_zscore", lambda: ft.zscore(KEYS), Z.format(
    f"CASE WHEN stddev_pop(value) OVER {P} > 0 THEN (value-avg(value) OVER {P})/stddev_pop(value) OVER {P} END"), 6)
_feature("ft_winsorize", lambda: ft.winsorize(KEYS), Z.format(
    f"CASE WHEN value IS NOT NULL THEN least(greatest(value, quantile_cont(value,0.01) OVER {P}), quantile_cont(value,0.99) OVER {P}) END"), 2)
_feature("ft_recurring_week", lambda: ft.recurring_week([1, 30, 48]), "CAST(week(week_start) IN (1,30,48) AS INTEGER)::DOUBLE")

WIDE_SQL = MASTER_SQL + """,
wide AS (SELECT panel, week_start, max(value) FILTER (series='revenue') AS revenue, """ + ", ".join(
    f"max(value) FILTER (series='{c}') AS {c}" for c in [*CHANNELS, "avg_qty", "rare_tax"]) + """
 FROM master GROUP BY 1,2)"""


def wide(spark, sf):
    return to_wide(master(spark, sf).data, KEYS, ["revenue", *CHANNELS, "avg_qty", "rare_tax"])


def _wide_feature(name, column, sql):
    @query(name, f"WITH {WIDE_SQL} SELECT panel, week_start, {sql} AS feature FROM wide")
    def _(spark, sf):
        return wide(spark, sf).select("panel", WEEK, column().alias("feature"))


_wide_feature("ft_ratio", lambda: F.round(ft.ratio(F.col("ch_a_f"), F.col("rare_tax")), 4),
              "round(coalesce(CASE WHEN rare_tax<>0 THEN ch_a_f/rare_tax END, 0), 4)")
_wide_feature("ft_product", lambda: ft.product(F.col("ch_a_f"), F.col("rare_tax")), "coalesce(ch_a_f,1)*coalesce(rare_tax,1)")
_wide_feature("ft_sum", lambda: ft.total(F.col("ch_a_f"), F.col("ch_n_o"), F.col("ch_r_f")),
              "coalesce(ch_a_f,0)+coalesce(ch_n_o,0)+coalesce(ch_r_f,0)")


@query("ft_date_span", f"""WITH {MASTER_SQL}, d AS (SELECT DISTINCT panel, CAST(date_trunc('week', ts) AS DATE) AS week_start
  FROM shop WHERE cents>49500000), w AS (SELECT DISTINCT panel, week_start FROM master)
 SELECT w.panel, w.week_start, CASE WHEN d.panel IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS value
 FROM w LEFT JOIN d ON w.panel=d.panel AND w.week_start=d.week_start""")
def _(spark, sf):
    days = shop(spark, sf).where(F.col("cents") > 49500000).select("panel", F.col("ts").alias("date"))
    return ft.date_span(master(spark, sf).data, days, KEYS)


INDEX_SQL = MASTER_SQL + """, idx AS (SELECT panel, week_start, CAST(row_number() OVER (PARTITION BY panel ORDER BY week_start)-1 AS DOUBLE) AS t,
  count(*) OVER (PARTITION BY panel) AS n FROM master WHERE role='kpi')"""


def indexed(spark, sf):
    n = F.count(F.lit(1)).over(Window.partitionBy("panel"))
    return master(spark, sf).data.where(F.col("role") == "kpi").select("panel", WEEK, ft.row_index(KEYS).alias("t"), n.alias("n"))


@query("ft_fourier", f"""WITH {INDEX_SQL} SELECT panel, week_start, round(sin(2*pi()*t/52.0),9)+0.0::DOUBLE AS sin_1, round(cos(2*pi()*t/52.0),9)+0.0::DOUBLE AS cos_1,
 round(sin(2*pi()*2*t/52.0),9)+0.0::DOUBLE AS sin_2, round(cos(2*pi()*2*t/52.0),9)+0.0::DOUBLE AS cos_2 FROM idx""")
def _(spark, sf):
    waves = ft.fourier(F.col("t"), 52.0, 2)
    return indexed(spark, sf).select("panel", WEEK, *[(F.round(c, 9) + F.lit(0.0)).alias(k) for k, c in waves.items()])


@query("ft_changepoint", f"""WITH {INDEX_SQL} SELECT panel, week_start, round(greatest(t/(n-1)-0.2,0),9) AS cp_1, round(greatest(t/(n-1)-0.4,0),9) AS cp_2,
 round(greatest(t/(n-1)-0.6,0),9) AS cp_3, round(greatest(t/(n-1)-0.8,0),9) AS cp_4 FROM idx""")
def _(spark, sf):
    t = F.col("t") / (F.col("n") - 1)
    return indexed(spark, sf).select("panel", WEEK, *[F.round(c, 9).alias(k) for k, c in ft.changepoints(t, 4).items()])


CALENDAR = ",".join(f"('{n}',{w})" for n, w in fx.CALENDAR_WEEKS if w is not None)


@query("ft_calendar", f"""WITH {MASTER_SQL}, w AS (SELECT DISTINCT panel, week_start FROM master)
 SELECT panel, week_start, c.name AS series, CAST(week(week_start)=c.wk AS INTEGER)::DOUBLE AS value
 FROM w, (VALUES {CALENDAR}) c(name, wk)""")
def _(spark, sf):
    return ft.calendar(master(spark, sf).data, KEYS)


@query("ft_apply_all", f"""WITH {WIDE_SQL} SELECT *, coalesce(lag(ch_a_f,1) OVER (PARTITION BY panel ORDER BY week_start),0) AS a_lag1,
 coalesce(ch_a_f,0)+coalesce(lag(ch_a_f,1) OVER (PARTITION BY panel ORDER BY week_start),0) AS a_two FROM wide""")
def _(spark, sf):
    specs = [Feature("a_lag1", "lag", ("ch_a_f",), {"weeks": 1}), Feature("ch_a_o", "log1p", ("ch_a_f",)),
             Feature("bad", "ratio", ("ch_a_f", "nowhere")), Feature("a_two", "sum", ("ch_a_f", "a_lag1"))]
    return ft.apply_features(wide(spark, sf), specs, KEYS)[0]
