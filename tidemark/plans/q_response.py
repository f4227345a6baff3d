"""Queries: carry-over, saturation, dataset measurement, priors."""

from itertools import combinations_with_replacement

from pyspark.sql import Window, functions as F

from tidemark import fixed_values as fx
from tidemark.frames import WEEK, to_wide
from tidemark.functions import response as rf
from tidemark.operators import measure as me, response as rs, weekly as wk
from tidemark.plans.inputs import CHANNELS, CONTROLS, DRAWS_SQL, KEYS, MASTER_SQL, master, params
from tidemark.plans.q_profile import intent
from tidemark.plans.registry import query

W = "(PARTITION BY panel, series ORDER BY week_start)"
LAGGED = [f"coalesce(lag(value,{i}) OVER {W},0)" if i else "value" for i in range(12)]
GEO = lambda i: f"pow(0.6::DOUBLE,{i})"
PEAK = lambda i: f"pow(0.6::DOUBLE,pow({i}-2.0::DOUBLE,2))"


def _stock(weight):
    raw = "+".join(weight(i) for i in range(12))
    return "(" + "+".join(f"({weight(i)})*{x}" for i, x in enumerate(LAGGED)) + f")/({raw})"


def spend(spark, sf):
    return master(spark, sf).data.where(F.col("role") == "spend").drop("role")


@query("as_geometric", f"""WITH {MASTER_SQL} SELECT panel, week_start, series, value, round({_stock(GEO)}, 0) AS adstock FROM master WHERE role='spend'""")
def _(spark, sf):
    return rs.geometric_adstock(spend(spark, sf), KEYS, F.lit(0.6)).withColumn("adstock", F.round("adstock", 0))


@query("as_delayed", f"""WITH {MASTER_SQL} SELECT panel, week_start, series, value, round({_stock(PEAK)}, 0) AS adstock FROM master WHERE role='spend'""")
def _(spark, sf):
    return rs.delayed_adstock(spend(spark, sf), KEYS, F.lit(0.6), F.lit(2.0)).withColumn("adstock", F.round("adstock", 0))


@query("as_lag_matrix", f"""WITH {MASTER_SQL} SELECT panel, week_start, series, {LAGGED[0]} AS x0, {LAGGED[1]} AS x1, {LAGGED[2]} AS x2, {LAGGED[3]} AS x3 FROM master WHERE role='spend'""")
def _(spark, sf):
    m = rs.lag_matrix(spend(spark, sf), KEYS, 4)
    return m.select("panel", WEEK, "series", *[F.col("lags")[i].alias(f"x{i}") for i in range(4)])


@query("as_direct_fraction", f"""WITH {MASTER_SQL}, s AS (SELECT panel, week_start, series, value, {_stock(GEO)} AS stock FROM master WHERE role='spend')
 SELECT panel, week_start, series, round(CASE WHEN stock>0 THEN value/({'+'.join(GEO(i) for i in range(12))})/stock ELSE 0 END, 9) AS direct_fraction FROM s""")
def _(spark, sf):
    w = rf.weights(F.lit(0.6))
    out = rs.direct_fraction(spend(spark, sf), KEYS, w)
    return out.select("panel", WEEK, "series", F.round("direct_fraction", 9).alias("direct_fraction"))


@query("as_alpha_halflife", f"""WITH {DRAWS_SQL} SELECT panel, series, draw, round(ln(0.5)/ln(alpha),9) AS half_life, round(pow(0.5::DOUBLE,1/(ln(0.5)/ln(alpha))),9) AS alpha FROM params""")
def _(spark, sf):
    h = rf.half_life_from_alpha(F.col("alpha"))
    return params(spark, sf).select("panel", "series", "draw", F.round(h, 9).alias("half_life"),
                                    F.round(rf.alpha_from_half_life(h), 9).alias("alpha"))


def _weights(name, theta, power):
    @query(name, f"""WITH {DRAWS_SQL}, l AS (SELECT panel, series, draw, alpha, CAST(unnest(generate_series(0,11)) AS INTEGER) AS lag FROM params),
      w AS (SELECT *, pow(alpha, {power}) AS raw FROM l)
     SELECT panel, series, draw, lag, round(raw/sum(raw) OVER (PARTITION BY panel, series, draw),9) AS weight FROM w""")
    def _(spark, sf):
        p = params(spark, sf).select("panel", "series", "draw", "alpha", F.lit(2.0).alias("theta"))
        return (rs.weight_table(p, "alpha", "theta" if theta else None)
                .select("panel", "series", "draw", "lag", F.round("weight", 9).alias("weight")))


_weights("as_weights", False, "lag::DOUBLE")
_weights("as_delayed_weights", True, "pow(lag-2.0::DOUBLE,2)")


@query("as_decay_curve", f"""WITH {DRAWS_SQL}, h AS (SELECT panel, series, quantile_cont(ln(0.5)/ln(alpha),0.5) AS half_life FROM params GROUP BY 1,2),
 l AS (SELECT *, pow(0.5::DOUBLE,1/greatest(half_life,0.1)) AS a, CAST(unnest(generate_series(0,9)) AS INTEGER) AS lag FROM h)
 SELECT panel, series, lag, round(pow(a,lag)/sum(pow(a,lag)) OVER (PARTITION BY panel, series),9) AS share FROM l""")
def _(spark, sf):
    h = (params(spark, sf).groupBy("panel", "series")
         .agg(F.percentile(rf.half_life_from_alpha(F.col("alpha")), F.lit(0.5)).alias("half_life")))
    return rs.decay_curve(h, "half_life").select("panel", "series", "lag", F.round("share", 9).alias("share"))


SCALED_SQL = MASTER_SQL + """, scaled AS (SELECT panel, week_start, series, value/max(value) OVER (PARTITION BY panel, series) AS x FROM master WHERE role='spend')"""


def scaled(spark, sf):
    top = F.max("value").over(Window.partitionBy("panel", "series"))
    return spend(spark, sf).select("panel", WEEK, "series", (F.col("value") / top).alias("x"))


@query("sat_hill", f"WITH {SCALED_SQL} SELECT panel, week_start, series, round(pow(x,1.5)/(pow(0.3::DOUBLE,1.5)+pow(x,1.5)),9) AS effect FROM scaled")
def _(spark, sf):
    return scaled(spark, sf).select("panel", WEEK, "series", F.round(rf.hill(F.col("x"), F.lit(0.3), F.lit(1.5)), 9).alias("effect"))


@query("sat_logistic", f"WITH {SCALED_SQL} SELECT panel, week_start, series, round((1-exp(-3*x))/(1+exp(-3*x)),9) AS effect FROM scaled")
def _(spark, sf):
    return scaled(spark, sf).select("panel", WEEK, "series", F.round(rf.logistic(F.col("x"), F.lit(3.0)), 9).alias("effect"))


@query("sat_eps", f"""WITH {SCALED_SQL} SELECT panel, week_start, series, round(pow(x+1e-6,1.5)/(pow(0.3::DOUBLE,1.5)+pow(x+1e-6,1.5))
 - pow(1e-6::DOUBLE,1.5)/(pow(0.3::DOUBLE,1.5)+pow(1e-6::DOUBLE,1.5)),9) AS effect FROM scaled""")
def _(spark, sf):
    return scaled(spark, sf).select("panel", WEEK, "series", F.round(rf.hill_effect(F.col("x"), F.lit(0.3), F.lit(1.5)), 9).alias("effect"))


@query("sat_half_point", f"""WITH {DRAWS_SQL} SELECT panel, series, draw, round(CASE WHEN series LIKE '%_f' THEN half_sat ELSE ln(3.0)/(1/half_sat) END * x_max, 2) AS half_point FROM params""")
def _(spark, sf):
    kind = F.when(F.col("series").endswith("_f"), "hill").otherwise("logistic")
    point = rf.half_point(kind, F.col("half_sat"), 1 / F.col("half_sat")) * F.col("x_max")
    return params(spark, sf).select("panel", "series", "draw", F.round(point, 2).alias("half_point"))


STATS_SQL = MASTER_SQL + """, st AS (SELECT panel, series, max(value) AS max_weekly, quantile_cont(value,0.5) AS median_weekly,
   coalesce(quantile_cont(value,0.5) FILTER (value>0),0) AS active_median_weekly, avg(value) AS mean_weekly, stddev_pop(value) AS std_weekly, sum(value) AS total,
   count(*) FILTER (value>0) AS n_active_weeks, count(*) AS n_weeks, min(value) AS min_weekly, count(*)-count(value) AS n_missing FROM master WHERE role='spend' GROUP BY 1,2),
 stats AS (SELECT *, CASE WHEN max_weekly>0 THEN CASE WHEN n_active_weeks>0 THEN active_median_weekly ELSE median_weekly END/max_weekly ELSE 0 END AS median_scaled,
   CASE WHEN mean_weekly>0 THEN std_weekly/mean_weekly ELSE 0 END AS cv,
   CASE WHEN max_weekly<=0 THEN 'no_activity' WHEN n_active_weeks<8 THEN 'few_active_weeks' WHEN CASE WHEN mean_weekly>0 THEN std_weekly/mean_weekly ELSE 0 END<0.05 THEN 'no_variation' END AS degenerate_reason FROM st)"""


@query("ms_channel_stats", f"""WITH {STATS_SQL} SELECT panel, series, max_weekly, median_weekly, active_median_weekly, total, n_active_weeks, n_weeks,
 round(mean_weekly,2) AS mean_weekly, round(std_weekly,2) AS std_weekly, round(median_scaled,9) AS median_scaled, round(cv,9) AS cv, degenerate_reason FROM stats""")
def _(spark, sf):
    s = me.channel_stats(master(spark, sf).data, KEYS)
    return s.select("panel", "series", "max_weekly", "median_weekly", "active_median_weekly", "total", "n_active_weeks", "n_weeks",
                    F.round("mean_weekly", 2).alias("mean_weekly"), F.round("std_weekly", 2).alias("std_weekly"),
                    F.round("median_scaled", 9).alias("median_scaled"), F.round("cv", 9).alias("cv"), "degenerate_reason")


def broken_spend(spark, sf):
    """Spend with one negative, one empty, one constant and one rarely active channel."""
    s, v, t = F.col("series"), F.col("value"), F.unix_date(WEEK)
    first = F.min(WEEK).over(Window.partitionBy("panel"))
    value = (F.when(s == "ch_a_f", -v).when(s == "ch_a_o", 0.0).when(s == "ch_n_f", 5.0)
             .when(s == "ch_n_o", F.when(F.date_diff(F.col(WEEK), first) < 35, v).otherwise(0.0)).otherwise(v))
    return master(spark, sf).data.withColumn("value", F.when(F.col("role") == "spend", value).otherwise(v))


@query("fit_channel_guard", f"""WITH {STATS_SQL}, b AS (SELECT panel, week_start, series, CASE series WHEN 'ch_a_f' THEN -value WHEN 'ch_a_o' THEN 0 WHEN 'ch_n_f' THEN 5
    WHEN 'ch_n_o' THEN CASE WHEN week_start-min(week_start) OVER (PARTITION BY panel)<35 THEN value ELSE 0 END ELSE value END AS value FROM master WHERE role='spend'),
  g AS (SELECT panel, series, count(*)-count(value) AS n_missing, min(value) AS lo, max(value) AS hi, count(*) FILTER (value>0) AS act, avg(value) AS m, stddev_pop(value) AS sd FROM b GROUP BY 1,2)
 SELECT panel, series, refused FROM (SELECT panel, series, CASE WHEN n_missing>0 THEN 'missing_values' WHEN lo<0 THEN 'negative' WHEN hi<=0 THEN 'no_activity'
   WHEN act<8 THEN 'few_active_weeks' WHEN sd/m<0.05 THEN 'no_variation' END AS refused FROM g) WHERE refused IS NOT NULL""")
def _(spark, sf):
    return me.channel_guard(me.channel_stats(broken_spend(spark, sf), KEYS)).select("panel", "series", "refused")


@query("ms_is_constant", f"""WITH {STATS_SQL} SELECT panel, series, stddev_pop(CASE WHEN series='avg_qty' THEN 7.0 ELSE value END)<=1e-9*greatest(abs(avg(CASE WHEN series='avg_qty' THEN 7.0 ELSE value END)),1) AS is_constant FROM master GROUP BY 1,2""")
def _(spark, sf):
    v = F.when(F.col("series") == "avg_qty", 7.0).otherwise(F.col("value"))
    return (master(spark, sf).data.withColumn("value", v).groupBy("panel", "series")
            .agg(me.is_constant("value").alias("is_constant")))


@query("ms_kpi_stats", f"""WITH {MASTER_SQL}, k AS (SELECT panel, series, count(*) AS n_weeks, count(*)-count(value) AS n_missing, max(value) AS kpi_max, quantile_cont(value,0.5) AS kpi_median,
   stddev_pop(value) AS kpi_std, bool_and(value=round(value)) AS kpi_is_integer, count(*) FILTER (value=0) AS n_zero_weeks FROM master WHERE role='kpi' GROUP BY 1,2)
 SELECT panel, series, n_weeks, n_missing, kpi_max, kpi_median, round(kpi_median/kpi_max,9) AS kpi_median_scaled, round(kpi_std/kpi_max,9) AS kpi_std_scaled, kpi_is_integer, n_zero_weeks,
  CASE WHEN n_missing>0 THEN 'missing_values' WHEN kpi_max<=0 THEN 'no_positive_values' WHEN n_weeks<2 THEN 'too_short' END AS refused FROM k""")
def _(spark, sf):
    return (me.kpi_stats(master(spark, sf).data, KEYS).drop("kpi_std")
            .withColumn("kpi_median_scaled", F.round("kpi_median_scaled", 9)).withColumn("kpi_std_scaled", F.round("kpi_std_scaled", 9)))


TREND_SQL = MASTER_SQL + """, yt AS (SELECT panel, value/max(value) OVER (PARTITION BY panel) AS y,
   CAST(row_number() OVER (PARTITION BY panel ORDER BY week_start)-1 AS DOUBLE)/(count(*) OVER (PARTITION BY panel)-1) AS t FROM master WHERE role='kpi')"""


@query("ms_trend", f"WITH {TREND_SQL} SELECT panel, round(regr_slope(y,t),9) AS trend_slope, round(regr_intercept(y,t),9) AS trend_intercept FROM yt GROUP BY 1")
def _(spark, sf):
    t = me.trend(master(spark, sf).data, KEYS)
    return t.select("panel", F.round("trend_slope", 9).alias("trend_slope"), F.round("trend_intercept", 9).alias("trend_intercept"))


@query("fit_scale", f"""WITH {MASTER_SQL} SELECT panel, week_start, series, round(CASE role WHEN 'control' THEN (value-avg(value) OVER (PARTITION BY panel, series))/stddev_pop(value) OVER (PARTITION BY panel, series)
  ELSE value/max(value) OVER (PARTITION BY panel, series) END, 8) AS scaled FROM master""")
def _(spark, sf):
    from tidemark.operators import fit as ft
    m = master(spark, sf).data
    return ft.scale(m, ft.scalers(m, KEYS), KEYS).select("panel", WEEK, "series", F.round("scaled", 8).alias("scaled"))


@query("ms_season_amplitude")
def _(spark, sf):
    return me.season_amplitude(master(spark, sf).data, KEYS)


@query("ms_residual")
def _(spark, sf):
    m = wk.fill_missing(master(spark, sf).data, KEYS, "ffill", CONTROLS)
    return me.residual_stats(m, KEYS, CHANNELS, CONTROLS)


@query("ols_fit", f"""WITH {TREND_SQL} SELECT panel, 'one' AS term, round(regr_intercept(y,t),6) AS coef FROM yt GROUP BY 1 UNION ALL SELECT panel, 't', round(regr_slope(y,t),6) FROM yt GROUP BY 1""")
def _(spark, sf):
    df, _ = me.season_design(master(spark, sf).data, KEYS)
    return me.ols(df, KEYS, ["one", "t"], "y").withColumn("coef", F.round("coef", 6))


# --- priors ---------------------------------------------------------------------------------

@query("pr_likelihood", """WITH s AS (SELECT p_brand, p_size, count(*) AS n, quantile_cont(l_quantity,0.5) AS med, bool_and(l_quantity=round(l_quantity)) AS whole, kurtosis_pop(l_extendedprice) AS k
   FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2)
 SELECT p_brand, p_size, CASE WHEN p_size%2=0 AND whole AND med<=50 THEN 'negative_binomial' WHEN p_size%2=0 THEN 'normal' WHEN k>-0.4 THEN 'student_t' ELSE 'normal' END AS likelihood
 FROM s""")
def _(spark, sf):
    from tidemark.plans.inputs import table
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice")
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    s = (lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "p_size").agg(
        F.percentile(F.col("l_quantity"), F.lit(0.5)).alias("med"),
        F.min((F.col("l_quantity") == F.round("l_quantity")).cast("int")).alias("whole"),
        F.kurtosis("l_extendedprice").alias("k")))
    kind = F.when(F.col("p_size") % 2 == 0, "orders").otherwise("revenue")
    # the kurtosis of these near-uniform prices is below zero; shift it to straddle the limit
    return s.select("p_brand", "p_size", me.likelihood(kind, F.col("whole") == 1, F.col("med"), F.col("k") + 1.9).alias("likelihood"))


@query("pr_burn_in", f"""WITH {DRAWS_SQL}, h AS (SELECT panel, series, greatest(avg(ln(0.5)/ln(alpha)),0.1) AS h FROM params GROUP BY 1,2),
 l AS (SELECT panel, series, pow(pow(0.5::DOUBLE,1/h), CASE WHEN series LIKE '%_f' THEN pow(lag-2.0::DOUBLE,2) ELSE lag END) AS w, lag FROM h, generate_series(0,11) g(lag)),
 c AS (SELECT panel, series, lag, sum(w) OVER (PARTITION BY panel, series ORDER BY lag)/sum(w) OVER (PARTITION BY panel, series) AS cum FROM l),
 r AS (SELECT panel, series, min(lag) AS need FROM c WHERE cum>=0.95 GROUP BY 1,2), n AS (SELECT panel, count(DISTINCT week_start) AS n FROM master GROUP BY 1)
 SELECT r.panel, CAST(least(max(need), max(floor(n*0.2))) AS INTEGER) AS burn_in_weeks FROM r JOIN n ON r.panel=n.panel GROUP BY 1""")
def _(spark, sf):
    n = master(spark, sf).data.groupBy("panel").agg(F.count_distinct(WEEK).alias("n_weeks"))
    ch = (params(spark, sf).groupBy("panel", "series")
          .agg(F.greatest(F.avg(rf.half_life_from_alpha(F.col("alpha"))), F.lit(0.1)).alias("half_life")).join(n, "panel")
          .withColumn("delayed", F.col("series").endswith("_f")).withColumn("theta", F.lit(2.0)))
    return me.burn_in(ch, KEYS, "half_life", "n_weeks", delayed="delayed", theta="theta")


def prior_table(spark, sf):
    m = master(spark, sf).data
    panel = me.kpi_stats(m, KEYS).select("panel", "kpi_median_scaled", F.lit("moderate").alias("media_share"), F.lit("normal").alias("likelihood"))
    return me.channel_priors(intent(spark, sf), me.channel_stats(m, KEYS), panel, KEYS)


PRIORS_SQL = STATS_SQL + """, kp AS (SELECT panel, quantile_cont(value,0.5)/max(value) AS kms FROM master WHERE role='kpi' GROUP BY 1),
 it AS (SELECT DISTINCT panel, series, CASE WHEN series LIKE 'ch_r%' THEN 'grp' ELSE 'currency' END AS unit, CASE WHEN series LIKE '%_f' THEN 2.0 ELSE 1.0 END::DOUBLE AS w, series LIKE '%_f' AS f FROM master WHERE role='spend'),
 sh AS (SELECT *, w/sum(w) OVER (PARTITION BY panel)*0.3 AS slice FROM it),
 priors AS (SELECT sh.panel, sh.series, unit, n_weeks, greatest(slice*kms/(sqrt(2/pi())*(1/(1+1.3))),1e-6) AS beta_sigma, CASE WHEN f THEN 5.0 ELSE 2.5 END::DOUBLE AS half_life,
   CASE WHEN f THEN 15.0 ELSE 6.0 END::DOUBLE AS adstock_concentration, greatest(median_scaled*1.3,1e-4) AS halfsat_log_center, 0.9::DOUBLE AS halfsat_log_sigma,
   greatest(ln(3.0)/greatest(median_scaled*1.3,1e-4),1e-3) AS logistic_lam_sigma, 'geometric' AS adstock, CASE WHEN n_weeks>=52 AND n_active_weeks>=20 THEN 'hill' ELSE 'logistic' END AS saturation,
   CAST(least(12, greatest(4, n_weeks//4)) AS INTEGER) AS l_max FROM sh JOIN stats ON sh.panel=stats.panel AND sh.series=stats.series JOIN kp ON sh.panel=kp.panel)"""


@query("pr_derive", f"""WITH {PRIORS_SQL} SELECT panel, series, unit, n_weeks, round(beta_sigma,9) AS beta_sigma, half_life, adstock_concentration, round(halfsat_log_center,9) AS halfsat_log_center,
  halfsat_log_sigma, round(logistic_lam_sigma,9) AS logistic_lam_sigma, adstock, saturation, l_max FROM priors""")
def _(spark, sf):
    p = prior_table(spark, sf)
    return p.select("panel", "series", "unit", "n_weeks", F.round("beta_sigma", 9).alias("beta_sigma"), "half_life", "adstock_concentration",
                    F.round("halfsat_log_center", 9).alias("halfsat_log_center"), "halfsat_log_sigma",
                    F.round("logistic_lam_sigma", 9).alias("logistic_lam_sigma"), "adstock", "saturation", "l_max")


@query("pr_baseline", f"""WITH {TREND_SQL}, k AS (SELECT panel, count(*) AS n_weeks, quantile_cont(value,0.5)/max(value) AS kms, stddev_pop(value)/max(value) AS kss FROM master WHERE role='kpi' GROUP BY 1),
 t AS (SELECT panel, regr_slope(y,t) AS slope FROM yt GROUP BY 1)
 SELECT k.panel, round(0.7*kms,9) AS intercept_mu, round(greatest(0.05,0.5*0.3*kms),9) AS intercept_sigma, round(greatest(0.05,3*abs(slope)),9) AS trend_sigma,
  round(CASE WHEN n_weeks>=60 THEN greatest(0.01,2*0.02) ELSE 0.1 END,9)::DOUBLE AS season_sigma, round(greatest(0.05,1.5*kss),9) AS control_sigma, round(greatest(0.005,2*0.04),9)::DOUBLE AS noise_sigma,
  round(greatest(0.01,0.3*greatest(0.05,3*abs(slope))),9) AS changepoint_scale, CASE WHEN n_weeks<60 THEN 0 WHEN n_weeks<90 THEN 1 ELSE 2 END AS fourier_modes, CAST(least(6,greatest(1,n_weeks//20)) AS INTEGER) AS n_changepoints
 FROM k JOIN t ON k.panel=t.panel""")
def _(spark, sf):
    m = master(spark, sf).data
    panel = (me.kpi_stats(m, KEYS).join(me.trend(m, KEYS), KEYS)
             .withColumns({"media_share": F.lit(None).cast("string"), "seasonality": F.lit("unknown"),
                           "seasonal_amplitude": F.lit(0.02), "residual_sd": F.lit(0.04)}))
    out = me.baseline_priors(panel)
    cols = ["intercept_mu", "intercept_sigma", "trend_sigma", "season_sigma", "control_sigma", "noise_sigma", "changepoint_scale"]
    return out.select("panel", *[F.round(c, 9).alias(c) for c in cols], "fourier_modes", "n_changepoints")


@query("pr_widen", f"""WITH {PRIORS_SQL} SELECT panel, series, round(beta_sigma*2,9) AS beta_sigma, greatest(adstock_concentration/2,2) AS adstock_concentration,
  halfsat_log_sigma*2 AS halfsat_log_sigma, round(logistic_lam_sigma*2,9) AS logistic_lam_sigma FROM priors""")
def _(spark, sf):
    w = me.widen(prior_table(spark, sf))
    return w.select("panel", "series", F.round("beta_sigma", 9).alias("beta_sigma"), "adstock_concentration", "halfsat_log_sigma",
                    F.round("logistic_lam_sigma", 9).alias("logistic_lam_sigma"))


@query("spec_bounds", f"""WITH {PRIORS_SQL} SELECT panel, series, 'beta_sigma' AS parameter, round(beta_sigma*1000,6) AS value FROM priors WHERE beta_sigma*1000>50
 UNION ALL SELECT panel, series, 'adstock_concentration', adstock_concentration-6 FROM priors WHERE adstock_concentration-6<0.5""")
def _(spark, sf):
    p = (prior_table(spark, sf).withColumn("beta_sigma", F.col("beta_sigma") * 1000)
         .withColumn("adstock_concentration", F.col("adstock_concentration") - 6))
    return me.bound_violations(p, ["panel", "series"]).withColumn("value", F.round("value", 6))


@query("spec_clamp", """SELECT o_orderkey, CAST(least(greatest(o_custkey::DOUBLE,250),4000) AS INTEGER) AS draws, CAST(least(greatest(o_orderkey%7,2),4) AS INTEGER) AS chains,
 least(greatest(o_totalprice/500000,0.9),0.995) AS target_accept FROM orders""")
def _(spark, sf):
    from tidemark.plans.inputs import table
    return me.clamp_sample(table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("draws"), (F.col("o_orderkey") % 7).alias("chains"), (F.col("o_totalprice") / 500000).alias("target_accept")))


@query("spec_hash")
def _(spark, sf):
    return me.spec_hash(prior_table(spark, sf).select("panel", "series", "unit", "half_life", "adstock", "saturation", "l_max"))


@query("pr_issues", f"""WITH {STATS_SQL}, i AS (SELECT DISTINCT panel, series FROM master WHERE role='spend' UNION ALL SELECT DISTINCT panel, 'ghost' FROM master)
 SELECT panel, series, 'unknown_channel' AS code, 'error' AS severity FROM i WHERE series='ghost'
 UNION ALL SELECT panel, series, 'channel_not_estimable', 'error' FROM stats WHERE degenerate_reason IS NOT NULL
 UNION ALL SELECT panel, NULL, 'few_weeks_per_channel', 'warning' FROM stats GROUP BY panel HAVING max(n_weeks)/count(*)<8 AND max(n_weeks)/count(*)>=4""")
def _(spark, sf):
    m = master(spark, sf).data
    known = m.where(F.col("role") == "spend").select("panel", "series").distinct()
    ghost = m.select("panel").distinct().withColumn("series", F.lit("ghost"))
    return me.prior_issues(known.unionByName(ghost), me.channel_stats(m, KEYS), KEYS)
