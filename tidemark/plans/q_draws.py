"""Queries: attribution, fit diagnostics, identifiability and verdict from draw tables."""

from itertools import combinations

from pyspark.sql import Window, functions as F

from tidemark import fixed_values as fx
from tidemark.frames import WEEK
from tidemark.functions import normal as nm, response as rf
from tidemark.operators import draws as dr, evaluate as ev, identify as idn, response as rs, verdict as vd
from tidemark.plans.inputs import (CHANNELS, DRAWS, DRAWS_SQL, KEYS, MASTER_SQL, baselines, contributions, expected, master, params)
from tidemark.plans.registry import query

PW = ["panel", WEEK]
PS = ["panel", "series"]


def rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


def q(v, p):
    return f"quantile_cont({v},{p})"


@query("dr_interval", f"""WITH {DRAWS_SQL} SELECT panel, week_start, round({q('mu','0.03')},9) AS p3, round({q('mu','0.5')},9) AS p50, round({q('mu','0.97')},9) AS p97 FROM expected GROUP BY 1,2""")
def _(spark, sf):
    return rounded(dr.interval(expected(spark, sf), PW, "mu"), 9, "p3", "p50", "p97")


ADD_SQL = DRAWS_SQL + """, add_ch AS (SELECT panel, week_start, draw, series AS component, contrib*y_max AS value FROM contributions),
 attr AS (SELECT * FROM add_ch UNION ALL SELECT e.panel, e.week_start, e.draw, 'baseline', e.mu*e.y_max-m.v FROM expected e
   JOIN (SELECT panel, week_start, draw, sum(value) AS v FROM add_ch GROUP BY 1,2,3) m ON e.panel=m.panel AND e.week_start=m.week_start AND e.draw=m.draw)"""


def attribution(spark, sf):
    return dr.attribute_additive(expected(spark, sf), contributions(spark, sf), KEYS)


@query("dr_attr_additive", f"""WITH {ADD_SQL} SELECT panel, week_start, component, round({q('value','0.5')},2) AS p50 FROM attr GROUP BY 1,2,3""")
def _(spark, sf):
    a = attribution(spark, sf).groupBy("panel", WEEK, "component").agg(F.percentile("value", F.lit(0.5)).alias("p50"))
    return rounded(a, 2, "p50")


CNT_SQL = DRAWS_SQL + """, lf AS (SELECT c.panel, c.week_start, c.draw, series, e.mu, contrib, exp(e.mu)-exp(e.mu-contrib) AS lift,
   exp(e.mu)-exp(e.mu-sum(contrib) OVER (PARTITION BY c.panel, c.week_start, c.draw)) AS media FROM contributions c JOIN expected e ON c.panel=e.panel AND c.week_start=e.week_start AND c.draw=e.draw),
 tot AS (SELECT *, sum(lift) OVER (PARTITION BY panel, week_start, draw) AS t FROM lf)"""


@query("dr_attr_count", f"""WITH {CNT_SQL} SELECT panel, week_start, component, round({q('value','0.5')},9) AS p50 FROM (
  SELECT panel, week_start, series AS component, CASE WHEN t>0 THEN lift*media/t ELSE 0 END AS value FROM tot
  UNION ALL SELECT panel, week_start, 'baseline', max(exp(mu))-max(media) FROM tot GROUP BY panel, week_start, draw) GROUP BY 1,2,3""")
def _(spark, sf):
    a = dr.attribute_count(expected(spark, sf), contributions(spark, sf), KEYS)
    return rounded(a.groupBy("panel", WEEK, "component").agg(F.percentile("value", F.lit(0.5)).alias("p50")), 9, "p50")


@query("dr_baseline_parts", f"""WITH {DRAWS_SQL} SELECT panel, week_start, part, round({q('v','0.5')},2)+0.0::DOUBLE AS p50 FROM (
  SELECT panel, week_start, 'level' AS part, level*y_max AS v FROM baselines UNION ALL SELECT panel, week_start, 'season', season*y_max FROM baselines) GROUP BY 1,2,3""")
def _(spark, sf):
    return rounded(dr.baseline_parts(baselines(spark, sf), KEYS, ["level", "season"]), 2, "p50")


@query("dr_baseline_parts_count", f"""WITH {DRAWS_SQL}, r AS (SELECT panel, week_start, draw, exp(base) AS b, exp(base)-exp(level+season-level) AS a1, exp(base)-exp(level+season-season) AS a2 FROM baselines)
 SELECT panel, week_start, part, round({q('v','0.5')},9)+0.0::DOUBLE AS p50 FROM (SELECT panel, week_start, 'level' AS part, CASE WHEN abs(a1+a2)>1e-12 THEN a1/(a1+a2)*b ELSE 0 END AS v FROM r
  UNION ALL SELECT panel, week_start, 'season', CASE WHEN abs(a1+a2)>1e-12 THEN a2/(a1+a2)*b ELSE 0 END FROM r) GROUP BY 1,2,3""")
def _(spark, sf):
    b = baselines(spark, sf).withColumn("level_total", F.exp("base"))
    return rounded(dr.baseline_parts_count(b, KEYS, ["level", "season"], "level_total"), 9, "p50")


W = "(PARTITION BY panel, series, draw ORDER BY week_start)"
X = [f"coalesce(lag(spend,{i}) OVER {W},0)" if i else "spend" for i in range(4)]
RESULT_SQL = DRAWS_SQL + f""", f AS (SELECT panel, week_start, series, draw, contrib*y_max AS value, spend, spend/({'+'.join(f"{x}*pow(alpha,{i})" for i, x in enumerate(X))}) AS frac FROM contributions),
 obs AS (SELECT panel, week_start FROM kp WHERE t>=4),
 d AS (SELECT f.panel, series, draw, sum(value) AS total, sum(value*coalesce(CASE WHEN isfinite(frac) THEN frac END,0)) AS direct, sum(spend) AS spend FROM f JOIN obs ON f.panel=obs.panel AND f.week_start=obs.week_start GROUP BY 1,2,3),
 kt AS (SELECT panel, sum(actual) AS kpi_total FROM kp WHERE t>=4 GROUP BY 1), j AS (SELECT d.*, kpi_total FROM d JOIN kt ON d.panel=kt.panel)"""


def observed_contributions(spark, sf, burn_in=4):
    """Contributions in KPI units on observed weeks, with the same-week share of the stock."""
    c = contributions(spark, sf).withColumn("value", F.col("spend"))
    keyed = [*KEYS, "draw"]
    c = rs.direct_fraction(c, keyed, rf.weights(F.col("alpha"), 4))
    weeks = baselines(spark, sf).where((F.col("draw") == 0) & (F.col("t") >= burn_in)).select("panel", WEEK)
    return (c.withColumn("value", F.col("contrib") * F.col("y_max")).join(weeks, PW, "left_semi"))


def kpi_totals(spark, sf, burn_in=4):
    return (baselines(spark, sf).where((F.col("draw") == 0) & (F.col("t") >= burn_in))
            .groupBy("panel").agg(F.sum("actual").alias("kpi_total")))


def channel_result(spark, sf):
    return dr.channel_results(observed_contributions(spark, sf), kpi_totals(spark, sf), KEYS)


BANDS = (("3", "0.03"), ("50", "0.5"), ("97", "0.97"))
RES_COLS = {"contribution_": "total", "share_": "total/kpi_total", "return_": "CASE WHEN spend>0 THEN total/spend END", "direct_": "direct",
            "carryover_": "total-direct", "direct_share_": "least(greatest(CASE WHEN abs(total)>1e-12 THEN direct/total ELSE 1 END,0),1)"}
RES_DIGITS = {"contribution_": 1, "share_": 9, "return_": 9, "direct_": 1, "carryover_": 1, "direct_share_": 7}


@query("dr_channel_result", f"WITH {RESULT_SQL} SELECT panel, series, " + ", ".join(
    f"round({q(e, p)},{RES_DIGITS[k]}) AS {k}p{n}" for k, e in RES_COLS.items() for n, p in BANDS) + ", max(spend) AS total_spend FROM j GROUP BY 1,2")
def _(spark, sf):
    r = channel_result(spark, sf)
    return r.select(*PS, *[F.round(f"{k}p{n}", RES_DIGITS[k]).alias(f"{k}p{n}") for k in RES_COLS for n, _ in BANDS], "total_spend")


@query("dr_channel_shape", f"""WITH {DRAWS_SQL} SELECT panel, series, round({q('ln(0.5)/ln(alpha)','0.5')},9) AS half_life_p50, round({q('half_sat*x_max','0.5')},2) AS half_point_p50 FROM params GROUP BY 1,2""")
def _(spark, sf):
    p = params(spark, sf)
    r = p.groupBy(*PS).agg(F.percentile(rf.half_life_from_alpha(F.col("alpha")), F.lit(0.5)).alias("half_life_p50"),
                           F.percentile(F.col("half_sat") * F.col("x_max"), F.lit(0.5)).alias("half_point_p50"))
    return rounded(rounded(r, 9, "half_life_p50"), 2, "half_point_p50")


@query("dr_weekly", f"""WITH {DRAWS_SQL} SELECT panel, week_start, max(actual) AS actual, round({q('mu*y_max','0.03')},2) AS p3, round({q('mu*y_max','0.5')},2) AS p50, round({q('mu*y_max','0.97')},2) AS p97,
  round({q('base*y_max','0.5')},2) AS baseline_p50, max(t)<4 AS is_burn_in FROM expected GROUP BY 1,2""")
def _(spark, sf):
    e = expected(spark, sf).withColumn("value", F.col("mu") * F.col("y_max"))
    bands = dr.weekly_bands(e, KEYS)
    rest = e.groupBy(*PW).agg(F.max("actual").alias("actual"), F.percentile(F.col("base") * F.col("y_max"), F.lit(0.5)).alias("baseline_p50"),
                              (F.max("t") < 4).alias("is_burn_in"))
    return rounded(bands.join(rest, PW), 2, "p3", "p50", "p97", "baseline_p50")


def unit_sql(k):
    return f"((('0x'||substr(md5(concat_ws('|', '{10 + k}', panel, CAST(week_start AS DATE)::VARCHAR, draw::VARCHAR)),1,12))::BIGINT+0.5)/281474976710656.0)"


def band_sql(noise):
    e = f"(mu*y_max+0.08*({noise})*cos(2*pi()*{unit_sql(2)})*y_max)"
    return (f"WITH {DRAWS_SQL} SELECT panel, week_start, round({q(e, '0.03')},2) AS p3, round({q(e, '0.5')},2) AS p50, "
            f"round({q(e, '0.97')},2) AS p97 FROM expected GROUP BY 1,2")


@query("dr_predictive", band_sql(f"sqrt(-2*ln({unit_sql(1)}))"))
def _(spark, sf):
    e = dr.predictive_normal(expected(spark, sf).withColumn("sigma", F.lit(0.08)), KEYS, "sigma", "y_max")
    return rounded(dr.interval(e, PW, "predicted"), 2, "p3", "p50", "p97")


@query("dr_predictive_t", band_sql(f"sqrt(4*(pow({unit_sql(1)},-0.5)-1))"))
def _(spark, sf):
    e = dr.predictive_t(expected(spark, sf).withColumn("sigma", F.lit(0.08)), KEYS, "sigma", "y_max", 4.0)
    return rounded(dr.interval(e, PW, "predicted"), 2, "p3", "p50", "p97")


def later_unit_sql(k):
    return (f"((('0x'||substr(md5(concat_ws('|', CAST({k}+1000 AS VARCHAR), panel, CAST(week_start AS DATE)::VARCHAR, draw::VARCHAR)),1,12))::BIGINT+0.5)"
            "/281474976710656.0)")


def counts_sql(rate, before=""):
    """Counts drawn by the same hashes: small rates by summing probabilities, others by transformed rejection."""
    return f"""WITH {DRAWS_SQL}{before}, ra AS (SELECT panel, week_start, draw, {rate} AS rate, {later_unit_sql(91)} AS u0 FROM {'gam' if before else 'expected'}),
 inv AS (SELECT *, list_reduce(list_transform(range(0,61), lambda k: {{'n':0.0::DOUBLE,'p':exp(-least(rate,10)),'cum':exp(-least(rate,10)),'k':k::DOUBLE}}),
   lambda acc, e: {{'n':acc.n+CASE WHEN u0>acc.cum THEN 1.0 ELSE 0.0 END,'p':acc.p*least(rate,10)/e.k,'cum':acc.cum+acc.p*least(rate,10)/e.k,'k':e.k}}).n AS small,
   greatest(rate,10) AS l, 0.931+2.53*sqrt(greatest(rate,10)) AS b FROM ra),
 con AS (SELECT *, -0.059+0.02483*b AS a, 1.1239+1.1328/(b-3.4) AS ia, 0.9277-3.6224/(b-2) AS vr FROM inv),
 tr AS (SELECT *, list_transform(range(0,12), lambda i: {{'u':{later_unit_sql('i*2+100')}-0.5,'v':{later_unit_sql('i*2+101')}}}) AS t FROM con),
 tx AS (SELECT *, list_transform(t, lambda e: {{'us':0.5-abs(e.u),'v':e.v,'x':floor((2*a/(0.5-abs(e.u))+b)*e.u+l+0.43)}}) AS c FROM tr),
 ok AS (SELECT *, list_filter(c, lambda e: (e.us>=0.07 AND e.v<=vr) OR (e.x>=0 AND (e.us>=0.013 OR e.v<=e.us)
   AND ln(e.v)+ln(ia)-ln(a/(e.us*e.us)+b)<=-l+greatest(e.x,0)*ln(l)-lgamma(greatest(e.x,0)+1))) AS f FROM tx),
 dr AS (SELECT panel, week_start, CASE WHEN rate<10 THEN small ELSE coalesce(f[1].x, round(l)) END AS v FROM ok)
 SELECT panel, week_start, {', '.join(f"round({q('v', p)},4) AS p{n}" for n, p in (('3', '0.03'), ('50', '0.5'), ('97', '0.97')))} FROM dr GROUP BY 1,2"""


GAMMA_SQL = f""", ga AS (SELECT *, list_transform(range(0,12), lambda i: {{'z':sqrt(-2*ln({later_unit_sql('i*3+1')}))*cos(2*pi()*{later_unit_sql('i*3+2')}),'u':{later_unit_sql('i*3+3')}}}) AS g,
   5-1.0/3::DOUBLE AS d FROM expected),
 gam AS (SELECT panel, week_start, draw, mu, coalesce(d*list_filter(list_transform(g, lambda e: {{'z':e.z,'u':e.u,'v':pow(1+e.z/sqrt(9*d),3)}}),
   lambda e: e.v>0 AND ln(e.u)<0.5*e.z*e.z+d-d*e.v+d*ln(CASE WHEN e.v>0 THEN e.v ELSE 1 END))[1].v, 5) AS g FROM ga)"""


@query("dr_predictive_count", counts_sql("exp(mu)*10/5*g", GAMMA_SQL))
def _(spark, sf):
    e = expected(spark, sf).withColumns({"mean": F.exp("mu") * 10, "disp": F.lit(5.0)})
    return rounded(dr.interval(dr.predictive_count(e, KEYS, "mean", "disp"), PW, "predicted"), 4, "p3", "p50", "p97")


@query("dr_predictive_poisson", counts_sql("exp(mu)*10"))
def _(spark, sf):
    e = expected(spark, sf).withColumn("mean", F.exp("mu") * 10)
    return rounded(dr.interval(dr.predictive_count(e, KEYS, "mean"), PW, "predicted"), 4, "p3", "p50", "p97")


# noisy draws by fixed arithmetic, so both engines see the same band
NOISE_SQL = "mu*y_max+0.2*sin(draw*1.3+t)*y_max"


def noisy(spark, sf):
    n = F.lit(0.2) * F.sin(F.col("draw") * 1.3 + F.col("t")) * F.col("y_max")
    return expected(spark, sf).withColumn("predicted", F.col("mu") * F.col("y_max") + n)


COVER_SQL = DRAWS_SQL + f""", b AS (SELECT panel, week_start, max(actual) AS a, {', '.join(f"{q(NOISE_SQL, p)} AS q{n}" for n, p in (('3','0.03'),('97','0.97'),('10','0.10'),('90','0.90'),('25','0.25'),('75','0.75')))} FROM expected GROUP BY 1,2),
 cov AS (SELECT panel, avg(CAST(a BETWEEN q3 AND q97 AS INTEGER)) AS coverage_94, avg(CAST(a BETWEEN q10 AND q90 AS INTEGER)) AS coverage_80, avg(CAST(a BETWEEN q25 AND q75 AS INTEGER)) AS coverage_50 FROM b GROUP BY 1)"""


@query("dr_coverage", f"WITH {COVER_SQL} SELECT panel, round(coverage_94,9) AS coverage_94, round(coverage_80,9) AS coverage_80, round(coverage_50,9) AS coverage_50 FROM cov")
def _(spark, sf):
    return rounded(dr.coverage(noisy(spark, sf), KEYS), 9, "coverage_94", "coverage_80", "coverage_50")


@query("dr_coverage_check", f"""WITH {COVER_SQL} SELECT panel, band, round(actual,9) AS actual, nominal, abs(actual-nominal)<=0.1 AS ok FROM (SELECT panel, 'coverage_94' AS band, coverage_94 AS actual, 0.94::DOUBLE AS nominal FROM cov
  UNION ALL SELECT panel, 'coverage_80', coverage_80, 0.8 FROM cov UNION ALL SELECT panel, 'coverage_50', coverage_50, 0.5 FROM cov)""")
def _(spark, sf):
    return rounded(dr.coverage_check(dr.coverage(noisy(spark, sf), KEYS), KEYS), 9, "actual")


@query("dr_decomp_check", f"""WITH {ADD_SQL}, w AS (SELECT e.panel, e.week_start, avg(e.mu*e.y_max) AS total FROM expected e GROUP BY 1,2), p AS (SELECT panel, week_start, sum(value)/{DRAWS} AS parts FROM attr GROUP BY 1,2)
 SELECT w.panel, round(max(abs(total-parts))/greatest(avg(abs(total)),1e-12),6)+0.0::DOUBLE AS max_relative_error, max(abs(total-parts))/greatest(avg(abs(total)),1e-12)<=1e-3 AS ok FROM w JOIN p ON w.panel=p.panel AND w.week_start=p.week_start GROUP BY 1""")
def _(spark, sf):
    total = expected(spark, sf).groupBy(*PW).agg(F.avg(F.col("mu") * F.col("y_max")).alias("total"))
    parts = attribution(spark, sf).groupBy(*PW).agg((F.sum("value") / DRAWS).alias("parts"))
    return rounded(dr.decomposition_check(total.join(parts, PW), KEYS, "total", "parts"), 6, "max_relative_error")


FITTED_SQL = DRAWS_SQL + ", fw AS (SELECT panel, week_start, max(actual) AS actual, avg(mu*y_max) AS fitted FROM expected WHERE t>=4 GROUP BY 1,2)"


def fitted_weeks(spark, sf):
    return (expected(spark, sf).where(F.col("t") >= 4).groupBy(*PW)
            .agg(F.max("actual").alias("actual"), F.avg(F.col("mu") * F.col("y_max")).alias("fitted")))


R2_SQL = FITTED_SQL + """, c AS (SELECT *, actual-avg(actual) OVER (PARTITION BY panel) AS cc, actual-fitted AS e FROM fw),
 gd AS (SELECT panel, 1-sum(e*e)/CASE WHEN sum(cc*cc)=0 THEN 1 ELSE sum(cc*cc) END AS r2, avg(CASE WHEN actual<>0 THEN abs(e/actual) END) AS mape FROM c GROUP BY 1)"""


@query("dr_r2", f"WITH {R2_SQL} SELECT panel, round(r2,8) AS r2 FROM gd")
def _(spark, sf):
    return rounded(dr.goodness(fitted_weeks(spark, sf), KEYS).select("panel", "r2"), 8, "r2")


@query("dr_mape", f"WITH {R2_SQL} SELECT panel, round(mape,8) AS mape FROM gd")
def _(spark, sf):
    return rounded(dr.goodness(fitted_weeks(spark, sf), KEYS).select("panel", "mape"), 8, "mape")


@query("dr_lag1_autocorr", f"""WITH {FITTED_SQL}, e AS (SELECT panel, week_start, actual-fitted-avg(actual-fitted) OVER (PARTITION BY panel) AS c FROM fw),
 n AS (SELECT *, lead(c) OVER (PARTITION BY panel ORDER BY week_start) AS nx FROM e) SELECT panel, round(sum(c*nx)/sum(c*c),8) AS lag1_autocorrelation FROM n GROUP BY 1""")
def _(spark, sf):
    w = fitted_weeks(spark, sf).withColumn("residual", F.col("actual") - F.col("fitted"))
    return rounded(dr.lag1_autocorrelation(w, KEYS, "residual"), 8, "lag1_autocorrelation")


def chains(spark, sf):
    """The draws as four chains of ten."""
    return (params(spark, sf).select(*PS, (F.col("draw") % 4).alias("chain"), F.floor(F.col("draw") / 4).cast("int").alias("draw"), F.col("beta").alias("value")))


@query("dr_rhat", f"""WITH {DRAWS_SQL}, c AS (SELECT panel, series, draw%4 AS chain, draw//4 AS draw, beta AS value FROM params),
 h AS (SELECT panel, series, chain, draw*2>=10 AS hf, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM c GROUP BY 1,2,3,4),
 g AS (SELECT panel, series, avg(v) AS w, var_samp(m) AS b, avg(n) AS n FROM h GROUP BY 1,2) SELECT panel, series, round(sqrt(((n-1)/n*w+b)/w),7) AS r_hat FROM g""")
def _(spark, sf):
    return rounded(dr.split_rhat(chains(spark, sf), PS), 7, "r_hat")


def polynomial_sql(x, terms):
    out = repr(terms[0]) + "::DOUBLE"
    for t in terms[1:]:
        out = f"({out}*{x}+({t!r}))"
    return out


def score_sql(p):
    """The inverse normal distribution function as SQL."""
    tail = lambda x: f"{polynomial_sql(x, nm.TAIL_UP)}/{polynomial_sql(x, nm.TAIL_DOWN)}"
    square = f"(({p}-0.5)*({p}-0.5))"
    return (f"CASE WHEN {p}<{nm.TAIL} THEN {tail(f'sqrt(-2*ln({p}))')} WHEN {p}>1-{nm.TAIL} THEN -{tail(f'sqrt(-2*ln(1-{p}))')} "
            f"ELSE ({p}-0.5)*{polynomial_sql(square, nm.CENTRAL_UP)}/{polynomial_sql(square, nm.CENTRAL_DOWN)} END")


def rank_rhat_sql(source, name):
    of = "(PARTITION BY panel, series)"
    return f"""{name}r AS (SELECT *, (rank() OVER (PARTITION BY panel, series ORDER BY v)+(count(*) OVER (PARTITION BY panel, series, v)-1)/2.0-0.375)/(count(*) OVER {of}+0.25) AS p FROM {source}),
 {name}h AS (SELECT panel, series, chain, draw*2>=10 AS hf, avg({score_sql('p')}) AS m, var_samp({score_sql('p')}) AS s, count(*) AS n FROM {name}r GROUP BY 1,2,3,4),
 {name} AS (SELECT panel, series, sqrt(((avg(n)-1)/avg(n)*avg(s)+var_samp(m))/avg(s)) AS r FROM {name}h GROUP BY 1,2)"""


@query("dr_rhat_rank", f"""WITH {DRAWS_SQL}, c AS (SELECT panel, series, draw%4 AS chain, draw//4 AS draw, beta AS v FROM params),
 f AS (SELECT panel, series, chain, draw, abs(v-quantile_cont(v,0.5) OVER (PARTITION BY panel, series)) AS v FROM c), {rank_rhat_sql('c', 'bulk')}, {rank_rhat_sql('f', 'tail')}
 SELECT bulk.panel, bulk.series, round(bulk.r,6) AS r_hat_bulk, round(tail.r,6) AS r_hat_tail, round(greatest(bulk.r,tail.r),6) AS r_hat FROM bulk JOIN tail ON bulk.panel=tail.panel AND bulk.series=tail.series""")
def _(spark, sf):
    return rounded(dr.rank_rhat(chains(spark, sf), PS), 6, "r_hat_bulk", "r_hat_tail", "r_hat")


@query("dr_ess")
def _(spark, sf):
    return dr.effective_samples(chains(spark, sf), PS)


@query("dr_sampler_health", f"""WITH {DRAWS_SQL}, c AS (SELECT panel, series, draw%4 AS chain, draw//4 AS draw, 100*half_sat AS energy, beta>0.024*idx AS diverging, 5+idx AS depth FROM params),
 d AS (SELECT *, energy-lag(energy) OVER (PARTITION BY panel, series, chain ORDER BY draw) AS dd FROM c),
 g AS (SELECT panel, series, chain, sum(dd*dd)/count(*)/nullif(var_pop(energy),0) AS bfmi, count(*) FILTER (diverging) AS nd, count(*) FILTER (depth>=10) AS nt FROM d GROUP BY 1,2,3)
 SELECT panel, series, CAST(sum(nd) AS BIGINT) AS n_divergences, round(min(bfmi),7) AS min_e_bfmi, CAST(sum(nt) AS BIGINT) AS n_max_treedepth FROM g GROUP BY 1,2""")
def _(spark, sf):
    s = params(spark, sf).select(*PS, (F.col("draw") % 4).alias("chain"), F.floor(F.col("draw") / 4).alias("draw"), (F.col("half_sat") * 100).alias("energy"),
                                 (F.col("beta") > F.lit(0.024) * F.col("idx")).alias("diverging"), (F.col("idx") + 5).alias("tree_depth"))
    return rounded(dr.sampler_health(s, PS), 7, "min_e_bfmi")


# --- identifiability ------------------------------------------------------------------------

PRIOR_SQL = DRAWS_SQL + ", pri AS (SELECT panel, series, abs(0.05::DOUBLE*sin(draw*0.7::DOUBLE))*idx AS value FROM params)"


def prior_and_posterior(spark, sf):
    p = params(spark, sf)
    prior = p.select(*PS, (F.abs(F.lit(0.05) * F.sin(F.col("draw") * 0.7)) * F.col("idx")).alias("value"))
    return prior, p.select(*PS, F.col("beta").alias("value"))


OVERLAP_SQL = PRIOR_SQL + """, bo AS (SELECT panel, series, value, 0 AS s FROM pri UNION ALL SELECT panel, series, beta, 1 FROM params),
 sp AS (SELECT panel, series, min(value) AS lo, max(value) AS hi, count(*) FILTER (s=0) AS na, count(*) FILTER (s=1) AS nb FROM bo GROUP BY 1,2),
 ce AS (SELECT bo.panel, bo.series, CASE WHEN hi>lo THEN least(floor((value-lo)/(hi-lo)*80),79) ELSE 0 END AS bin, na, nb, count(*) FILTER (s=0) AS ca, count(*) FILTER (s=1) AS cb FROM bo JOIN sp ON bo.panel=sp.panel AND bo.series=sp.series GROUP BY 1,2,3,4,5),
 ov AS (SELECT panel, series, sum(least(ca/na, cb/nb)) AS overlap FROM ce GROUP BY 1,2)"""


@query("id_overlap", f"WITH {OVERLAP_SQL} SELECT panel, series, round(overlap,9) AS overlap FROM ov")
def _(spark, sf):
    return rounded(idn.overlap(*prior_and_posterior(spark, sf), PS), 9, "overlap")


TOTALS_SQL = DRAWS_SQL + ", td AS (SELECT panel, series, draw, sum(contrib) AS total FROM contributions GROUP BY 1,2,3)"


def totals(spark, sf):
    return contributions(spark, sf).groupBy(*PS, "draw").agg(F.sum("contrib").alias("total"))


@query("id_rel_width", f"""WITH {TOTALS_SQL}, i AS (SELECT panel, series, {q('total','0.03')} AS a, {q('total','0.5')} AS m, {q('total','0.97')} AS b FROM td GROUP BY 1,2)
 SELECT panel, series, round(CASE WHEN abs(m)>=1e-12 THEN (b-a)/(2*abs(m)) END,8) AS relative_width FROM i""")
def _(spark, sf):
    i = dr.interval(totals(spark, sf), PS, "total")
    return i.select(*PS, F.round(idn.relative_width(F.col("p3"), F.col("p50"), F.col("p97")), 8).alias("relative_width"))


PAIR_SQL = TOTALS_SQL + ", wd AS (SELECT panel, draw, " + ", ".join(f"max(total) FILTER (series='{c}') AS {c}" for c in CHANNELS) + " FROM td GROUP BY 1,2), pr AS (" + " UNION ALL ".join(
    f"SELECT panel, '{a}' AS a, '{b}' AS b, corr({a},{b}) AS r FROM wd GROUP BY 1" for a, b in combinations(CHANNELS, 2)) + ")"


def correlations(spark, sf):
    return idn.contribution_correlations(totals(spark, sf), KEYS, CHANNELS)


@query("id_contrib_corr", f"WITH {PAIR_SQL} SELECT panel, a, b, round(r,7) AS r FROM pr")
def _(spark, sf):
    return rounded(correlations(spark, sf), 7, "r")


@query("id_groups", f"""WITH RECURSIVE {PAIR_SQL}, ed AS (SELECT panel, a, b FROM pr WHERE abs(r)>=0.1 UNION SELECT panel, b, a FROM pr WHERE abs(r)>=0.1),
 rc(panel, series, label) AS (SELECT panel, a, a FROM ed UNION SELECT rc.panel, ed.b, rc.label FROM rc JOIN ed ON rc.panel=ed.panel AND rc.series=ed.a)
 SELECT panel, series, min(label) AS group_label FROM rc GROUP BY 1,2""")
def _(spark, sf):
    return idn.inseparable_groups(correlations(spark, sf), KEYS, 0.1)


SHIFT_SQL = """ws AS (SELECT panel, series, avg(total) AS a, avg(total*(1+0.1::DOUBLE*(ascii(substr(series,4,1))%7))) AS b FROM td GROUP BY 1,2),
 sft AS (SELECT panel, series, abs(a-b)/greatest(abs(a),abs(b)) AS shift FROM ws)"""


def shift(spark, sf):
    t = totals(spark, sf)
    grow = 1 + F.lit(0.1) * (F.ascii(F.substring("series", 4, 1)) % 7)
    base = t.groupBy(*PS).agg(F.avg("total").alias("share"))
    return idn.prior_shift(base, t.groupBy(*PS).agg(F.avg(F.col("total") * grow).alias("share")), KEYS)


@query("id_prior_shift", f"WITH {TOTALS_SQL}, {SHIFT_SQL} SELECT panel, series, round(shift,8) AS shift FROM sft")
def _(spark, sf):
    return rounded(shift(spark, sf), 8, "shift")


@query("id_prior_samples")
def _(spark, sf):
    from tidemark.plans.q_response import prior_table
    return dr.interval(idn.prior_samples(prior_table(spark, sf), KEYS, 400), PS)


def identified(spark, sf):
    return idn.identifiability(dr.interval(totals(spark, sf), PS, "total"), correlations(spark, sf), KEYS,
                               idn.overlap(*prior_and_posterior(spark, sf), PS), shift(spark, sf))


VERDICT_SQL = OVERLAP_SQL + PAIR_SQL[len(DRAWS_SQL):] + f""", {SHIFT_SQL},
 two AS (SELECT panel, a AS series, b AS partner, r FROM pr UNION ALL SELECT panel, b, a, r FROM pr),
 wp AS (SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY panel, series ORDER BY abs(r) DESC, partner DESC)=1),
 iv AS (SELECT panel, series, {q('total','0.03')} AS a, {q('total','0.5')} AS m, {q('total','0.97')} AS b FROM td GROUP BY 1,2),
 lv AS (SELECT iv.panel, iv.series, partner, r, (b-a)/(2*abs(m)) AS relative_width, overlap, shift, CASE WHEN abs(r)>=0.7 THEN 2 WHEN abs(r)>=0.5 THEN 1 ELSE 0 END AS c,
   CASE WHEN (b-a)/(2*abs(m))>=2 THEN 2 WHEN (b-a)/(2*abs(m))>=1 THEN 1 ELSE 0 END AS w, CASE WHEN overlap>=0.9 THEN 2 WHEN overlap>=0.7 THEN 1 ELSE 0 END AS o, CASE WHEN shift>=0.5 THEN 2 WHEN shift>=0.25 THEN 1 ELSE 0 END AS s
   FROM iv JOIN wp ON iv.panel=wp.panel AND iv.series=wp.series JOIN ov ON iv.panel=ov.panel AND iv.series=ov.series JOIN sft ON iv.panel=sft.panel AND iv.series=sft.series),
 vdt AS (SELECT *, ['identified','weak','not_identified'][greatest(c,w,o,s)+1] AS verdict FROM lv)"""


@query("id_verdict", f"""WITH {VERDICT_SQL} SELECT panel, series, verdict, round(r,7) AS max_correlation, partner AS most_correlated_with, round(relative_width,8) AS relative_width, round(overlap,9) AS overlap, round(shift,8) AS shift,
  concat_ws(',', CASE WHEN c>0 THEN 'correlated' END, CASE WHEN w>0 THEN 'wide_interval' END, CASE WHEN o>0 THEN 'prior_unmoved' END, CASE WHEN s>0 THEN 'prior_sensitive' END) AS reasons FROM vdt""")
def _(spark, sf):
    return rounded(rounded(rounded(identified(spark, sf), 7, "max_correlation"), 8, "relative_width", "shift"), 9, "overlap")


# --- evaluation and verdict -----------------------------------------------------------------

@query("ev_splits", f"""WITH {MASTER_SQL}, n AS (SELECT panel, count(DISTINCT week_start) AS n_weeks FROM master GROUP BY 1), s AS (SELECT panel, n_weeks, CAST(unnest(generate_series(104, n_weeks-26, 26)) AS INTEGER) AS train_end FROM n WHERE n_weeks>=130)
 SELECT panel, n_weeks, CAST((train_end-104)/26 AS INTEGER) AS fold, train_end, train_end+26 AS test_end FROM s""")
def _(spark, sf):
    n = master(spark, sf).data.groupBy("panel").agg(F.count_distinct(WEEK).alias("n_weeks"))
    return ev.expanding_splits(n, "n_weeks", 104, 26)


@query("ev_prior_gate", f"""WITH {DRAWS_SQL}, p AS (SELECT panel, {q(NOISE_SQL + '*2','0.005')} AS prior_lo, {q(NOISE_SQL + '*2','0.995')} AS prior_hi FROM expected GROUP BY 1), o AS (SELECT panel, min(actual) AS lo, max(actual) AS hi FROM kp GROUP BY 1)
 SELECT p.panel, round(prior_lo,2) AS prior_lo, round(prior_hi,2) AS prior_hi, lo, hi, prior_lo<=lo AND prior_hi>=hi AS covers, (prior_hi-prior_lo)/greatest(hi-lo,1e-9)<=20 AS width_ok,
  prior_lo<=lo AND prior_hi>=hi AND (prior_hi-prior_lo)/greatest(hi-lo,1e-9)<=20 AS passed FROM p JOIN o ON p.panel=o.panel""")
def _(spark, sf):
    n = F.lit(0.2) * F.sin(F.col("draw") * 1.3 + F.col("t")) * F.col("y_max") * 2
    prior = expected(spark, sf).withColumn("value", F.col("mu") * F.col("y_max") + n)
    seen = baselines(spark, sf).groupBy("panel").agg(F.min("actual").alias("lo"), F.max("actual").alias("hi"))
    return rounded(ev.prior_gate(prior, seen, KEYS), 2, "prior_lo", "prior_hi")


DIAG_SQL = """dg AS (SELECT o_custkey AS run, 1.0::DOUBLE+(sum(o_orderkey)%13)/100.0::DOUBLE AS max_r_hat, CAST(sum(o_orderkey)%3*(count(*)%4) AS BIGINT) AS n_divergences, 100 AS n_samples, 200.0::DOUBLE+sum(o_orderkey)%700 AS min_ess_bulk,
   CASE WHEN sum(o_orderkey)%5<>0 THEN 300.0::DOUBLE+sum(o_orderkey)%500 END AS min_ess_tail, 0.2::DOUBLE+(sum(o_orderkey)%9)/10.0::DOUBLE AS min_e_bfmi, sum(o_orderkey)%17<>0 AS decomposition_ok, (sum(o_orderkey)%11)/10.0::DOUBLE AS r2,
   0.8::DOUBLE+(sum(o_orderkey)%21)/100.0::DOUBLE AS coverage_94, 0.7::DOUBLE+(sum(o_orderkey)%21)/100.0::DOUBLE AS coverage_80, 0.4::DOUBLE+(sum(o_orderkey)%21)/100.0::DOUBLE AS coverage_50, (sum(o_orderkey)%31)/100.0::DOUBLE AS mape,
   (sum(o_orderkey)%12)/20.0::DOUBLE-0.1::DOUBLE AS autocorrelation, CASE WHEN count(*)%2=0 THEN (sum(o_orderkey)%37)/100.0::DOUBLE END AS holdout_mape, CASE WHEN count(*)%3=0 THEN (sum(o_orderkey)%7)/100.0::DOUBLE END AS placebo_share FROM orders GROUP BY 1),
 chv AS (SELECT o_custkey AS run, o_orderstatus AS series, ['identified','weak','not_identified'][1+CAST(sum(o_orderkey)%3 AS INTEGER)] AS verdict, (sum(o_orderkey)%20)/100.0::DOUBLE AS share FROM orders GROUP BY 1,2),
 dd AS (SELECT dg.*, n_channels, n_unusable, typical FROM dg LEFT JOIN (SELECT run, count(*) AS n_channels, count(*) FILTER (verdict='not_identified') AS n_unusable, abs(quantile_cont(share,0.5)) AS typical FROM chv GROUP BY 1) x ON dg.run=x.run),
 checks AS (SELECT run, code, passed, severity, value FROM (
  SELECT run, 'converged' AS code, max_r_hat<=1.1 AS passed, 'blocking' AS severity, max_r_hat AS value, true AS used FROM dd
  UNION ALL SELECT run, 'convergence_tight', false, 'warning', max_r_hat, max_r_hat>1.05 AND max_r_hat<=1.1 FROM dd
  UNION ALL SELECT run, 'few_divergences', n_divergences/n_samples<=0.02, 'blocking', n_divergences/n_samples, true FROM dd
  UNION ALL SELECT run, 'some_divergences', false, 'warning', n_divergences, n_divergences>0 AND n_divergences/n_samples<=0.02 FROM dd
  UNION ALL SELECT run, 'enough_effective_samples', min_ess_bulk>=400, 'warning', min_ess_bulk, true FROM dd
  UNION ALL SELECT run, 'enough_tail_samples', min_ess_tail>=400, 'warning', min_ess_tail, min_ess_tail IS NOT NULL FROM dd
  UNION ALL SELECT run, 'energy_ok', min_e_bfmi>=0.3, 'warning', min_e_bfmi, true FROM dd
  UNION ALL SELECT run, 'decomposition_adds_up', decomposition_ok, 'blocking', NULL, true FROM dd
  UNION ALL SELECT run, 'explains_the_data', r2>=0.3, 'blocking', r2, true FROM dd
  UNION ALL SELECT run, 'explains_the_data_weakly', false, 'warning', r2, r2>=0.3 AND r2<0.5 FROM dd
  UNION ALL SELECT run, 'uncertainty_is_calibrated', NOT (abs(coverage_94-94/100)>0.1 OR abs(coverage_80-80/100)>0.1 OR abs(coverage_50-50/100)>0.1), 'warning', coverage_94, true FROM dd
  UNION ALL SELECT run, 'prediction_error_ok', mape<=0.25, 'warning', mape, true FROM dd
  UNION ALL SELECT run, 'no_leftover_structure', abs(autocorrelation)<=0.4, 'warning', autocorrelation, true FROM dd
  UNION ALL SELECT run, 'generalises', holdout_mape<=0.3, 'warning', holdout_mape, holdout_mape IS NOT NULL FROM dd
  UNION ALL SELECT run, 'placebo_clean', placebo_share<=0.05 AND coalesce(placebo_share<typical,true), 'blocking', placebo_share, placebo_share IS NOT NULL FROM dd
  UNION ALL SELECT run, 'any_channel_identifiable', n_unusable<n_channels, 'blocking', NULL, n_channels IS NOT NULL FROM dd
  UNION ALL SELECT run, 'all_channels_identifiable', false, 'warning', NULL, n_unusable>0 AND n_unusable<n_channels FROM dd) WHERE used),
 lvl AS (SELECT k.run, CASE WHEN bool_or(NOT passed AND severity='blocking') THEN 'not_usable'
   WHEN bool_or(NOT passed AND code IN ('uncertainty_is_calibrated','explains_the_data_weakly','prediction_error_ok','no_leftover_structure')) THEN 'technically_completed'
   WHEN any_value(u.has) AND bool_or(code='generalises' AND passed) AND NOT bool_or(NOT passed AND severity='warning' AND code<>'all_channels_identifiable') THEN 'usable_for_decisions' ELSE 'statistically_valid' END AS level
   FROM checks k JOIN (SELECT run, bool_or(verdict<>'not_identified') AS has FROM chv GROUP BY 1) u ON k.run=u.run GROUP BY 1)"""


def diagnostics(spark, sf):
    """One row of diagnostics per customer, spread over the rules by arithmetic on their orders."""
    from tidemark.plans.inputs import table
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.sum("o_orderkey").alias("s"), F.count(F.lit(1)).alias("k"))
    s = F.col("s")

    def part(m, d):
        return (s % m) / F.lit(float(d))

    return o.select(
        "run", (F.lit(1.0) + part(13, 100)).alias("max_r_hat"), (s % 3 * (F.col("k") % 4)).alias("n_divergences"), F.lit(100).alias("n_samples"),
        (F.lit(200.0) + s % 700).alias("min_ess_bulk"), F.when(s % 5 != 0, F.lit(300.0) + s % 500).alias("min_ess_tail"),
        (F.lit(0.2) + part(9, 10)).alias("min_e_bfmi"), (s % 17 != 0).alias("decomposition_ok"), part(11, 10).alias("r2"),
        (F.lit(0.8) + part(21, 100)).alias("coverage_94"), (F.lit(0.7) + part(21, 100)).alias("coverage_80"), (F.lit(0.4) + part(21, 100)).alias("coverage_50"),
        part(31, 100).alias("mape"), (part(12, 20) - F.lit(0.1)).alias("autocorrelation"),
        F.when(F.col("k") % 2 == 0, part(37, 100)).alias("holdout_mape"), F.when(F.col("k") % 3 == 0, part(7, 100)).alias("placebo_share"))


def channel_verdicts(spark, sf):
    from tidemark.plans.inputs import table
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run"), F.col("o_orderstatus").alias("series")).agg(F.sum("o_orderkey").alias("s"))
    names = F.array(*[F.lit(r) for r in idn.RANKS])
    return o.select("run", "series", F.element_at(names, (F.col("s") % 3).cast("int") + 1).alias("verdict"), ((F.col("s") % 20) / F.lit(100.0)).alias("share"))


def run_checks(spark, sf):
    ch = channel_verdicts(spark, sf)
    return vd.validity_checks(diagnostics(spark, sf), ["run"], ch, ch)


def run_levels(spark, sf):
    return vd.verdict_level(run_checks(spark, sf), ["run"], channel_verdicts(spark, sf))


@query("vd_checks", f"WITH {DIAG_SQL} SELECT run, code, passed, severity, value::DOUBLE AS value FROM checks")
def _(spark, sf):
    return run_checks(spark, sf)


@query("vd_level", f"WITH {DIAG_SQL} SELECT run, level FROM lvl")
def _(spark, sf):
    return run_levels(spark, sf)


ALLOWED_VALUES = ",".join(f"('{k}','{o}')" for k, v in fx.ALLOWED_OUTPUTS.items() for o in v)


@query("vd_outputs", f"WITH {DIAG_SQL} SELECT run, lvl.level, output FROM lvl JOIN (VALUES {ALLOWED_VALUES}) a(level, output) ON lvl.level=a.level")
def _(spark, sf):
    return vd.allowed_outputs(run_levels(spark, sf), ["run"])


@query("vd_trust_layers", f"""WITH {DIAG_SQL}, r AS (SELECT run, CASE WHEN max_r_hat>1.1 THEN 2 WHEN max_r_hat>1.05 OR n_divergences>0 OR min_ess_bulk<400 THEN 1 ELSE 0 END AS s,
  CASE WHEN NOT decomposition_ok OR r2<0.3 THEN 2 WHEN abs(coverage_94-0.94)>0.1 OR r2<0.5 OR mape>0.2 THEN 1 ELSE 0 END AS f FROM dg)
 SELECT run, ['good','caution','weak'][s+1] AS sampler, ['good','caution','weak'][f+1] AS fit, ['good','caution','weak'][greatest(s,f)+1] AS overall FROM r""")
def _(spark, sf):
    return vd.trust_layers(diagnostics(spark, sf), ["run"])


UNMEASURED = {"max_r_hat": 5, "n_divergences": 7, "min_ess_bulk": 9, "decomposition_ok": 11, "r2": 13, "coverage_94": 15}
GAPS_SQL = DIAG_SQL.replace("dg AS (", "full_dg AS (", 1).replace(" chv AS (", f""" dg AS (SELECT * REPLACE ({', '.join(
    f"CASE WHEN run%{m}<>0 THEN {c} END AS {c}" for c, m in UNMEASURED.items())}), run%2=0 AS sampled FROM full_dg),
 chv AS (""", 1)
MISSING_SQL = "+".join(f"CASE WHEN {c} IS NULL{' AND sampled' if c in ('max_r_hat', 'n_divergences') else ''} THEN 1 ELSE 0 END" for c in UNMEASURED)


def diagnostics_with_gaps(spark, sf):
    gaps = {c: F.when(F.col("run") % m != 0, F.col(c)) for c, m in UNMEASURED.items()}
    return diagnostics(spark, sf).withColumns({**gaps, "sampled": F.col("run") % 2 == 0})


@query("vd_trust_unmeasured", f"""WITH {GAPS_SQL}, r AS (SELECT run, CASE WHEN max_r_hat>1.1 THEN 3 WHEN max_r_hat>1.05 OR n_divergences>0 OR min_ess_bulk<400 THEN 2
   WHEN (max_r_hat IS NULL OR n_divergences IS NULL) AND sampled OR min_ess_bulk IS NULL THEN 1 ELSE 0 END AS s,
  CASE WHEN NOT decomposition_ok OR r2<0.3 THEN 3 WHEN abs(coverage_94-0.94)>0.1 OR r2<0.5 OR mape>0.2 THEN 2 WHEN decomposition_ok IS NULL OR r2 IS NULL OR coverage_94 IS NULL THEN 1 ELSE 0 END AS f FROM dg)
 SELECT run, ['good','unmeasured','caution','weak'][s+1] AS sampler, ['good','unmeasured','caution','weak'][f+1] AS fit, ['good','unmeasured','caution','weak'][greatest(s,f)+1] AS overall FROM r""")
def _(spark, sf):
    return vd.trust_layers(diagnostics_with_gaps(spark, sf), ["run"])


@query("vd_unmeasured", f"WITH {GAPS_SQL} SELECT run, ({MISSING_SQL})::DOUBLE AS n_missing, false AS at_top FROM dg WHERE ({MISSING_SQL})>0")
def _(spark, sf):
    """Runs that lack a measure a verdict needs, how many, and that none of them reaches the top level."""
    checks = vd.validity_checks(diagnostics_with_gaps(spark, sf), ["run"], channel_verdicts(spark, sf))
    levels = vd.verdict_level(checks, ["run"], channel_verdicts(spark, sf))
    found = checks.where("code = 'all_measured'").select("run", F.col("value").alias("n_missing"))
    return found.join(levels, "run").select("run", "n_missing", (F.col("level") == "usable_for_decisions").alias("at_top"))


@query("ev_placebo_judge", f"""WITH {DIAG_SQL}, s AS (SELECT run, CASE series WHEN 'P' THEN 'placebo' ELSE series END AS series, share FROM chv),
 g AS (SELECT run, max(abs(share)) FILTER (series='placebo') AS placebo_share, quantile_cont(abs(share),0.5) FILTER (series<>'placebo') AS typical_share FROM s GROUP BY 1)
 SELECT *, placebo_share<=0.05 AND coalesce(placebo_share<typical_share,true) AS clean FROM g""")
def _(spark, sf):
    s = channel_verdicts(spark, sf).withColumn("series", F.when(F.col("series") == "P", "placebo").otherwise(F.col("series")))
    return ev.judge_placebo(s, ["run"])
