"""Queries: curves, allocation, scenarios and report tables."""

from pyspark.sql import Window, functions as F

from tidemark import fixed_values as fx
from tidemark.frames import WEEK
from tidemark.operators import draws as dr, planning as pl, reporting as rp
from tidemark.plans.inputs import CHANNELS, DRAWS_SQL, KEYS, MASTER_SQL, contributions, expected, master, params
from tidemark.plans.q_draws import BANDS, PS, RESULT_SQL, attribution, ADD_SQL, channel_result, kpi_totals, q, rounded
from tidemark.plans.registry import query

EPS = "1e-6"


def effect(s, b="beta", h="half_sat", sl="slope", x="x_max"):
    return f"({b}*(pow(({s})/{x}+{EPS},{sl})/(pow({h},{sl})+pow(({s})/{x}+{EPS},{sl}))-pow({EPS}::DOUBLE,{sl})/(pow({h},{sl})+pow({EPS}::DOUBLE,{sl}))))"


def bands(expr, digits, cols="p{n}"):
    return ", ".join(f"round({q(expr, p)},{digits})+0.0::DOUBLE AS {cols.format(n=n)}" for n, p in BANDS)


@query("pl_contribution", f"WITH {DRAWS_SQL} SELECT panel, series, draw, round({effect('current')}*y_max,2) AS additive, round(exp(0.5::DOUBLE+{effect('current')})-exp(0.5::DOUBLE),9) AS count_link FROM params")
def _(spark, sf):
    p = params(spark, sf)
    return p.select(*PS, "draw", F.round(pl.contribution(F.col("current")), 2).alias("additive"),
                    F.round(pl.contribution(F.col("current"), F.lit(0.5)), 9).alias("count_link"))


STEADY_SQL = DRAWS_SQL + """, bl AS (SELECT panel, draw, avg(base) AS baseline_log FROM expected GROUP BY 1,2),
 ol AS (SELECT c.panel, series, c.draw, avg(mu-contrib) AS other_log FROM contributions c JOIN expected e ON c.panel=e.panel AND c.week_start=e.week_start AND c.draw=e.draw GROUP BY 1,2,3)"""


@query("pl_steady_refs", f"WITH {STEADY_SQL} SELECT ol.panel, series, ol.draw, round(other_log,8) AS other_log, round(baseline_log,8) AS baseline_log FROM ol JOIN bl ON ol.panel=bl.panel AND ol.draw=bl.draw")
def _(spark, sf):
    base, other = pl.steady_references(expected(spark, sf), contributions(spark, sf), KEYS)
    return rounded(other.join(base, ["panel", "draw"]), 8, "other_log", "baseline_log")


CURVE_SQL = DRAWS_SQL + f""", cg AS (SELECT *, CAST(unnest(generate_series(0,24)) AS INTEGER) AS step FROM params), cs AS (SELECT *, x_max*1.2::DOUBLE*step/24 AS weekly_spend FROM cg),
 curves AS (SELECT panel, series, step, max(weekly_spend) AS weekly_spend, max(x_max) AS top, {', '.join(f"{q(effect('weekly_spend') + '*y_max', p)} AS p{n}" for n, p in BANDS)} FROM cs GROUP BY 1,2,3)"""


def curves(spark, sf):
    return pl.response_curve(params(spark, sf), KEYS)


@query("pl_response_curve", f"WITH {CURVE_SQL} SELECT panel, series, step, round(weekly_spend,2) AS weekly_spend, round(p3,2) AS p3, round(p50,2) AS p50, round(p97,2) AS p97, weekly_spend>top AS extrapolated FROM curves")
def _(spark, sf):
    return rounded(curves(spark, sf), 2, "weekly_spend", "p3", "p50", "p97")


H = "greatest(x_max*1e-4,1e-6)"


@query("pl_marginal", f"WITH {DRAWS_SQL} SELECT panel, series, {bands(f'({effect(f'current+{H}')}-{effect(f'greatest(current-{H},0)')})*y_max/(current+{H}-greatest(current-{H},0))', 6)} FROM params GROUP BY 1,2")
def _(spark, sf):
    return rounded(pl.marginal_return(params(spark, sf), KEYS, "current"), 6, "p3", "p50", "p97")


@query("pl_average_return", f"WITH {DRAWS_SQL} SELECT panel, series, {bands(f'{effect('current')}*y_max/current', 9)} FROM params GROUP BY 1,2")
def _(spark, sf):
    return rounded(pl.average_return(params(spark, sf), KEYS, "current"), 9, "p3", "p50", "p97")


def current(spark, sf):
    return params(spark, sf).where(F.col("draw") == 0).select(*PS, F.col("current").alias("spend"))


@query("pl_total", f"WITH {DRAWS_SQL}, d AS (SELECT panel, draw, sum({effect('current')}*y_max) AS t FROM params GROUP BY 1,2) SELECT panel, {bands('t', 1)} FROM d GROUP BY 1")
def _(spark, sf):
    return rounded(pl.total_contribution(params(spark, sf), current(spark, sf), KEYS), 1, "p3", "p50", "p97")


N = 60


def alloc_sql(budget, low="0.0::DOUBLE", scenario="'now'"):
    """Greedy step allocation in SQL: ranges, step gains, the best N steps."""
    return f""", md AS (SELECT panel, series, {q('beta','0.5')} AS beta, {q('half_sat','0.5')} AS half_sat, {q('slope','0.5')} AS slope, max(x_max) AS x_max, max(y_max) AS y_max, max(current) AS current FROM params GROUP BY 1,2),
 bud AS (SELECT panel, {scenario} AS scenario, {budget} AS budget FROM md GROUP BY ALL),
 rg AS (SELECT md.*, scenario, budget, {low} AS low, greatest(x_max*1.2::DOUBLE,{low}) AS high FROM md JOIN bud ON md.panel=bud.panel),
 r2 AS (SELECT *, greatest(least(budget, sum(high) OVER (PARTITION BY panel, scenario)), sum(low) OVER (PARTITION BY panel, scenario)) AS feasible, sum(low) OVER (PARTITION BY panel, scenario) AS lows FROM rg),
 r3 AS (SELECT *, (feasible-lows)/{N} AS delta, CAST(least(CASE WHEN feasible>lows THEN floor((high-low)/((feasible-lows)/{N})+1e-9) ELSE 0 END,{N}) AS INTEGER) AS n_fit FROM r2),
 ks AS (SELECT *, unnest(generate_series(1,n_fit)) AS k FROM r3), gn AS (SELECT *, round(({effect('low+k*delta')}-{effect('low+k*delta-delta')})*y_max,9) AS gain FROM ks),
 pk AS (SELECT panel, scenario, series, count(*) AS taken FROM (SELECT * FROM gn QUALIFY row_number() OVER (PARTITION BY panel, scenario ORDER BY gain DESC, series, k)<={N}) GROUP BY 1,2,3),
 sp AS (SELECT r3.*, low+coalesce(taken,0)*delta AS spend0 FROM r3 LEFT JOIN pk ON r3.panel=pk.panel AND r3.scenario=pk.scenario AND r3.series=pk.series),
 rm AS (SELECT *, greatest(high-spend0,0) AS room, greatest(feasible-sum(spend0) OVER (PARTITION BY panel, scenario),0) AS rest FROM sp),
 gr AS (SELECT *, round(({effect('spend0+least(room,rest)')}-{effect('spend0')})*y_max,9) AS fill FROM rm),
 bf AS (SELECT *, coalesce(sum(room) OVER (PARTITION BY panel, scenario ORDER BY fill DESC, series ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS ahead FROM gr),
 a2 AS (SELECT *, spend0+least(greatest(rest-ahead,0),room) AS spend FROM bf),
 al AS (SELECT panel, scenario, series, spend, feasible, spend>=high*(1-1e-9) AS at_cap, current FROM a2)"""


def ranges(spark, sf, steps=N):
    budgets = pl.scaled_budgets(current(spark, sf), KEYS, (1.0,)).withColumn("scenario", F.lit("now"))
    return pl.allocation_ranges(pl.median_params(params(spark, sf), KEYS), budgets, KEYS, None, steps)


def allocation(spark, sf):
    return pl.allocate(ranges(spark, sf), KEYS)


ALLOC_SQL = DRAWS_SQL + alloc_sql("sum(current)")


@query("pl_allocate", f"WITH {ALLOC_SQL} SELECT panel, scenario, series, round(spend,0) AS spend, round(feasible,0) AS feasible, at_cap FROM al")
def _(spark, sf):
    return rounded(allocation(spark, sf), 0, "spend", "feasible")


@query("pl_allocate_sum", f"""WITH {DRAWS_SQL}, md AS (SELECT panel, series, max(x_max) AS x_max, max(current) AS current FROM params GROUP BY 1,2),
 f AS (SELECT unnest([0.5,1.0,1.5,2.0]::DOUBLE[]) AS factor) SELECT panel, CAST(factor AS VARCHAR) AS scenario, round(least(sum(current)*factor, sum(x_max)*1.2::DOUBLE),0) AS spent FROM md, f GROUP BY panel, factor""")
def _(spark, sf):
    budgets = pl.scaled_budgets(current(spark, sf), KEYS, (0.5, 1.0, 1.5, 2.0))
    split = pl.allocate(pl.allocation_ranges(pl.median_params(params(spark, sf), KEYS), budgets, KEYS, None, N), KEYS)
    return split.groupBy("panel", "scenario").agg(F.round(F.sum("spend"), 0).alias("spent"))


SPENT_SQL = "least(greatest((sqrt(c.v*c.k/(exp({s})*c.x))-c.k-1e-6)*c.x,0),c.x*1.2)"
SMOOTH_SQL = f"""WITH RECURSIVE {DRAWS_SQL}, md AS (SELECT panel, series, {q('beta', '0.5')} AS beta, {q('half_sat', '0.5')} AS half_sat, max(x_max) AS x_max, max(y_max) AS y_max, max(current) AS current FROM params GROUP BY 1,2),
 f AS (SELECT unnest([0.5,1.0,1.5,2.0]::DOUBLE[]) AS factor),
 bis AS (SELECT panel, factor, least(sum(current)*factor, sum(x_max)*1.2) AS feasible, list({{'series':series,'v':beta*y_max,'k':half_sat,'x':x_max}}) AS cs,
   ln(max(beta*y_max/half_sat/x_max))+1-80 AS lo, ln(max(beta*y_max/half_sat/x_max))+1 AS hi, 0 AS n FROM md, f GROUP BY panel, factor
  UNION ALL SELECT panel, factor, feasible, cs, CASE WHEN list_sum(list_transform(cs, lambda c: {SPENT_SQL.format(s='(lo+hi)/2')}))>feasible THEN (lo+hi)/2 ELSE lo END,
   CASE WHEN list_sum(list_transform(cs, lambda c: {SPENT_SQL.format(s='(lo+hi)/2')}))>feasible THEN hi ELSE (lo+hi)/2 END, n+1 FROM bis WHERE n<100),
 sp AS (SELECT panel, factor, feasible, hi, unnest(cs) AS c FROM bis WHERE n=100)
 SELECT panel, CAST(factor AS VARCHAR) AS scenario, c.series AS series, round(greatest({SPENT_SQL.format(s='hi')},0)/feasible,7) AS share FROM sp"""


@query("pl_allocate_smooth", SMOOTH_SQL)
def _(spark, sf):
    budgets = pl.scaled_budgets(current(spark, sf), KEYS, (0.5, 1.0, 1.5, 2.0))
    split = pl.allocate_smooth(pl.allocation_ranges(pl.median_params(params(spark, sf), KEYS), budgets, KEYS), KEYS)
    return split.select("panel", "scenario", "series", (F.round(F.col("spend") / F.col("feasible"), 7) + F.lit(0.0)).alias("share"))


@query("pl_refusals", f"""WITH {DRAWS_SQL}, md AS (SELECT panel, series, max(x_max) AS x_max, max(current) AS current FROM params GROUP BY 1,2),
 b AS (SELECT panel, CAST(f AS VARCHAR) AS scenario, sum(current)*f AS budget FROM md, (SELECT unnest([-1.0,0.0,0.2,1.0]::DOUBLE[]) AS f) GROUP BY panel, f),
 l AS (SELECT panel, series, CASE WHEN series='ch_a_f' AND panel<'B' THEN 2*x_max ELSE current*0.4::DOUBLE END AS lo, x_max*1.2 AS hi FROM md)
 SELECT l.panel, scenario, series, 'minimum_above_cap' AS code FROM l JOIN b ON l.panel=b.panel WHERE lo>hi*(1+1e-9)
 UNION ALL SELECT panel, scenario, NULL, CASE WHEN budget<=0 THEN 'budget_not_positive' ELSE 'minimums_above_budget' END FROM (SELECT b.panel, scenario, budget, sum(lo) AS lo FROM b JOIN l ON b.panel=l.panel GROUP BY 1,2,3)
  WHERE budget<=0 OR lo>budget*(1+1e-9)""")
def _(spark, sf):
    med, now = pl.median_params(params(spark, sf), KEYS), current(spark, sf)
    low = F.when((F.col("series") == "ch_a_f") & (F.col("panel") < "B"), F.col("x_max") * 2).otherwise(F.col("spend") * 0.4)
    limits = med.join(now, PS).select(*PS, low.alias("min_spend"), F.lit(None).cast("double").alias("max_spend"))
    return pl.allocation_refusals(med, pl.scaled_budgets(now, KEYS, (-1.0, 0.0, 0.2, 1.0)), KEYS, limits)


@query("pl_allocate_exact", f"""WITH {ALLOC_SQL} SELECT al.panel, al.scenario, round(sum({effect('al.spend','md.beta','md.half_sat','md.slope','md.x_max')}*md.y_max),2) AS best FROM al JOIN md ON al.panel=md.panel AND al.series=md.series GROUP BY 1,2""")
def _(spark, sf):
    out = pl.allocate_exact(ranges(spark, sf), KEYS)
    med = pl.median_params(params(spark, sf), KEYS)
    value = F.round(F.sum(pl.own_effect(F.col("spend")) * F.col("y_max")), 2)
    return out.join(med, PS).groupBy("panel", "scenario").agg(value.alias("best"))


@query("pl_allocate_count", f"""WITH {STEADY_SQL}{alloc_sql("sum(current)")}, jo AS (SELECT p.panel, scenario, p.draw, sum({effect('spend')}) AS own FROM params p JOIN al ON p.panel=al.panel AND p.series=al.series GROUP BY 1,2,3)
 SELECT jo.panel, scenario, {bands('exp(baseline_log+own)-exp(baseline_log)', 8)} FROM jo JOIN bl ON jo.panel=bl.panel AND jo.draw=bl.draw GROUP BY 1,2""")
def _(spark, sf):
    base, _other = pl.steady_references(expected(spark, sf), contributions(spark, sf), KEYS)
    return rounded(pl.total_contribution(params(spark, sf), allocation(spark, sf), KEYS, ["scenario"], base), 8, "p3", "p50", "p97")


FACTORS = "['" + "','".join(str(f) for f in fx.FRONTIER_FACTORS) + "']"
FRONT_SQL = alloc_sql("sum(current)*f.f::DOUBLE", scenario="f.f").replace("FROM md GROUP BY ALL)", f"FROM md, (SELECT unnest({FACTORS}) AS f) f GROUP BY panel, f.f)")
FRONTIER_SQL = DRAWS_SQL + FRONT_SQL + f""", ft AS (SELECT p.panel, scenario, p.draw, sum({effect('spend')}*y_max) AS t FROM params p JOIN al ON p.panel=al.panel AND p.series=al.series GROUP BY 1,2,3),
 fs AS (SELECT panel, scenario, max(feasible) AS total_budget FROM al GROUP BY 1,2), fr AS (SELECT ft.panel, ft.scenario, any_value(total_budget) AS total_budget, {', '.join(f"{q('t', p)} AS p{n}" for n, p in BANDS)} FROM ft JOIN fs ON ft.panel=fs.panel AND ft.scenario=fs.scenario GROUP BY 1,2)"""


def front(spark, sf):
    return pl.frontier(params(spark, sf), current(spark, sf), KEYS, N)


@query("pl_frontier", f"WITH {FRONTIER_SQL} SELECT panel, scenario, round(total_budget,0) AS total_budget, round(p3,1) AS p3, round(p50,1) AS p50, round(p97,1) AS p97 FROM fr")
def _(spark, sf):
    return rounded(rounded(front(spark, sf), 0, "total_budget"), 1, "p3", "p50", "p97")


@query("pl_frontier_count", f"""WITH {STEADY_SQL}{FRONT_SQL}, jo AS (SELECT p.panel, scenario, p.draw, sum({effect('spend')}) AS own, max(feasible) AS total_budget FROM params p JOIN al ON p.panel=al.panel AND p.series=al.series GROUP BY 1,2,3)
 SELECT jo.panel, scenario, round(max(total_budget),0) AS total_budget, {bands('exp(baseline_log+own)-exp(baseline_log)', 8)} FROM jo JOIN bl ON jo.panel=bl.panel AND jo.draw=bl.draw GROUP BY 1,2""")
def _(spark, sf):
    base, _other = pl.steady_references(expected(spark, sf), contributions(spark, sf), KEYS)
    f = pl.frontier(params(spark, sf), current(spark, sf), KEYS, N, base)
    return rounded(rounded(f, 8, "p3", "p50", "p97"), 0, "total_budget")


@query("pl_incremental", f"WITH {DRAWS_SQL}{alloc_sql('sum(current)*1.25::DOUBLE', 'current', repr('plus'))} SELECT panel, scenario, series, round(spend,0) AS spend, round(feasible,0) AS feasible, at_cap FROM al")
def _(spark, sf):
    cur = current(spark, sf)
    extra = cur.groupBy("panel").agg((F.sum("spend") * 0.25).alias("extra")).withColumn("scenario", F.lit("plus"))
    return rounded(pl.incremental(params(spark, sf), cur, extra, KEYS, N), 0, "spend", "feasible")


UNIT = "CASE WHEN series LIKE 'ch_r%' THEN 'grp' ELSE 'currency' END"
STUCK = "series IN ('ch_a_o','ch_n_f')"


def units(df):
    return df.withColumn("unit", F.when(F.col("series").startswith("ch_r"), "grp").otherwise("currency"))


def verdicts(spark, sf):
    stuck = F.when(F.col("series").isin("ch_a_o", "ch_n_f"), "not_identified").otherwise("identified")
    return current(spark, sf).select(*PS, stuck.alias("verdict"))


@query("pl_tradeable", f"WITH {DRAWS_SQL} SELECT panel, series, current AS spend, {UNIT} AS unit, {UNIT}='currency' AND NOT {STUCK} AS can_move FROM params WHERE draw=0")
def _(spark, sf):
    return pl.tradeable(units(current(spark, sf)), verdicts(spark, sf), KEYS)


SC_SQL = "sc AS (SELECT panel, 'more' AS scenario, series, current*1.3::DOUBLE AS spend FROM params WHERE draw=0 AND series LIKE 'ch_a%' UNION ALL SELECT panel, 'far', series, current*9.0::DOUBLE FROM params WHERE draw=0 AND series LIKE 'ch_n%')"


def chosen(spark, sf):
    c = current(spark, sf)
    more = c.where(F.col("series").startswith("ch_a")).select(*PS, F.lit("more").alias("scenario"), (F.col("spend") * 1.3).alias("spend"))
    far = c.where(F.col("series").startswith("ch_n")).select(*PS, F.lit("far").alias("scenario"), (F.col("spend") * 9.0).alias("spend"))
    return more.unionByName(far)


def read_sql(name, src, spend, curve="curves", x="weekly_spend", key="series", y="p50"):
    """Linear read of a curve in SQL: the segment holding the spend, flat beyond the ends."""
    kj = f"AND s.{key}=c.{key}" if key else ""
    part = f"panel, {key}" if key else "panel"
    return f"""{name}_seg AS (SELECT *, lead({x}) OVER (PARTITION BY {part} ORDER BY {x}) AS x1, lead({y}) OVER (PARTITION BY {part} ORDER BY {x}) AS y1,
   min({x}) OVER (PARTITION BY {part}) AS lo, max({x}) OVER (PARTITION BY {part}) AS hi FROM {curve}),
 {name} AS (SELECT s.*, CASE WHEN s.{spend}<=c.lo OR s.{spend}>=c.hi THEN c.{y} ELSE c.{y}+(s.{spend}-c.{x})/(c.x1-c.{x})*(c.y1-c.{y}) END AS read_y,
   s.{spend}<c.lo-1e-6 OR s.{spend}>c.hi+1e-6 AS outside FROM {src} s JOIN {name}_seg c ON s.panel=c.panel {kj}
   AND ((s.{spend}<=c.lo AND c.{x}=c.lo) OR (s.{spend}>=c.hi AND c.{x}=c.hi) OR (s.{spend}>c.lo AND s.{spend}<c.hi AND s.{spend}>c.{x} AND s.{spend}<=c.x1)))"""


@query("pl_curve_read", f"WITH {CURVE_SQL}, {SC_SQL}, {read_sql('rd', 'sc', 'spend')} SELECT panel, scenario, series, round(spend,2) AS spend, round(read_y,2) AS p50, outside FROM rd")
def _(spark, sf):
    return rounded(pl.read_curve(chosen(spark, sf), curves(spark, sf), PS, "spend"), 2, "spend", "p50")


FR2 = FRONTIER_SQL + ", bq AS (SELECT panel, sum(current)*1.4::DOUBLE AS budget FROM params WHERE draw=0 GROUP BY 1)"


@query("pl_frontier_read", f"WITH {FR2}, {read_sql('rd', 'bq', 'budget', 'fr', 'total_budget', '')} SELECT panel, round(budget,0) AS budget, round(read_y,1) AS optimal_contribution FROM rd")
def _(spark, sf):
    b = current(spark, sf).groupBy("panel").agg((F.sum("spend") * 1.4).alias("budget"))
    return rounded(rounded(pl.frontier_read(b, front(spark, sf), KEYS, "budget"), 0, "budget"), 1, "optimal_contribution")


@query("pl_scenario", f"""WITH {CURVE_SQL}, {SC_SQL}, nm AS (SELECT DISTINCT panel, scenario FROM sc),
 rows0 AS (SELECT nm.panel, nm.scenario, p.series, p.current AS base, coalesce(sc.spend, p.current) AS spend FROM nm JOIN params p ON nm.panel=p.panel AND p.draw=0 LEFT JOIN sc ON sc.panel=nm.panel AND sc.scenario=nm.scenario AND sc.series=p.series),
 {read_sql('r1', 'rows0', 'base')}, r1b AS (SELECT panel, scenario, series, base, spend, read_y AS base_kpi FROM r1), {read_sql('r2', 'r1b', 'spend')},
 t AS (SELECT panel, scenario, sum(base) AS base_spend, sum(spend) AS scenario_spend, sum(base_kpi) AS base_marketing, sum(read_y) AS scenario_marketing, bool_or(outside) AS any_outside FROM r2 GROUP BY 1,2)
 SELECT panel, scenario, weeks, any_outside, round((scenario_marketing-base_marketing)*weeks,0) AS kpi_delta, round((scenario_spend-base_spend)*weeks,1) AS spend_delta, round((scenario_marketing-base_marketing)*weeks*0.4::DOUBLE-(scenario_spend-base_spend)*weeks,0) AS net
 FROM t, (SELECT CAST(unnest([1,4,13,52]) AS INTEGER) AS weeks)""")
def _(spark, sf):
    zero = current(spark, sf).select("panel").distinct().withColumn("baseline_weekly", F.lit(0.0))
    s = pl.scenarios(chosen(spark, sf), curves(spark, sf), current(spark, sf), zero, KEYS, 0.4)
    return s.select("panel", "scenario", "weeks", "any_outside", F.round("kpi_delta", 0).alias("kpi_delta"), F.round("spend_delta", 1).alias("spend_delta"), F.round("net", 0).alias("net"))


# --- report tables ---------------------------------------------------------------------------

CH_SQL = RESULT_SQL + ", ch AS (SELECT panel, series, " + UNIT + " AS unit, max(spend) AS total_spend, any_value(kpi_total) AS kpi_total, " + ", ".join(
    f"{q('total', p)} AS contribution_p{n}, {q('total/kpi_total', p)} AS share_p{n}, {q('total/spend', p)} AS return_p{n}" for n, p in BANDS) + " FROM j GROUP BY 1,2)"


def channels(spark, sf):
    return units(channel_result(spark, sf))


@query("rp_money_kpis", f"""WITH {CH_SQL}, m AS (SELECT panel, coalesce(sum(total_spend) FILTER (unit='currency'),0) AS total_spend, sum(contribution_p3) AS a, sum(contribution_p50) AS b, sum(contribution_p97) AS c, max(kpi_total) AS k FROM ch GROUP BY 1)
 SELECT panel, total_spend, round(a,1) AS marketing_p3, round(b,1) AS marketing_p50, round(c,1) AS marketing_p97, round(b/total_spend,9) AS blended_return, round((b*0.4::DOUBLE-total_spend)/total_spend*100,6) AS roi_pct, round(0.6::DOUBLE*k/k*100,6) AS baseline_share_pct FROM m""")
def _(spark, sf):
    totals = kpi_totals(spark, sf).withColumn("baseline_p50", F.col("kpi_total") * 0.6)
    m = rp.money_kpis(channels(spark, sf), totals, KEYS, 0.4)
    m = rounded(rounded(rounded(m, 1, "marketing_p3", "marketing_p50", "marketing_p97"), 9, "blended_return"), 6, "roi_pct", "baseline_share_pct")
    return m.drop("kpi_total", "baseline_p50")


@query("rp_channel_sets", f"WITH {CH_SQL} SELECT panel, series, unit, CASE WHEN unit='currency' THEN 'money' WHEN total_spend>0 THEN 'volume' ELSE 'idle' END AS channel_set, NOT {STUCK} AS reportable FROM ch")
def _(spark, sf):
    return rp.channel_sets(channels(spark, sf), verdicts(spark, sf), KEYS).select(*PS, "unit", "channel_set", "reportable")


@query("rp_unreportable", f"WITH {CH_SQL} SELECT panel, count(*) AS n_unreportable, round(sum(contribution_p50),1) AS unreportable_p50 FROM ch WHERE {STUCK} GROUP BY 1")
def _(spark, sf):
    sets = rp.channel_sets(channels(spark, sf), verdicts(spark, sf), KEYS)
    return rounded(rp.unreportable_total(sets, KEYS), 1, "unreportable_p50")


@query("rp_confidence", f"WITH {CURVE_SQL} SELECT panel, series, step, CASE WHEN abs(p50)<1e-9 THEN 'low' WHEN (p97-p3)/(2*abs(p50))<0.4 THEN 'high' WHEN (p97-p3)/(2*abs(p50))<1 THEN 'mid' ELSE 'low' END AS confidence FROM curves")
def _(spark, sf):
    c = curves(spark, sf)
    return c.select(*PS, "step", rp.confidence(F.col("p3"), F.col("p50"), F.col("p97")).alias("confidence"))


def alloc_with_current(spark, sf):
    return allocation(spark, sf).join(current(spark, sf).withColumnRenamed("spend", "current"), PS)


@query("rp_actions", f"""WITH {CH_SQL}{CURVE_SQL[len(DRAWS_SQL):]}{FRONTIER_SQL[len(DRAWS_SQL):]}, a1 AS (SELECT panel, series, spend, current FROM al WHERE scenario='1.0'), {read_sql('rc', 'a1', 'current')},
 mv AS (SELECT panel, sum(read_y) AS cur, arg_max(series, (spend-current, series)) AS up_s, max(spend-current) AS up_d, arg_min(series, (spend-current, series)) AS dn_s, min(spend-current) AS dn_d FROM rc GROUP BY 1),
 pd AS (SELECT * FROM fr WHERE scenario='1.0'), sh AS (SELECT mv.*, p3, p50, p97, total_budget, p50-cur AS gain, p50-cur>greatest(1,cur*0.02) AND up_d>0 AND dn_d<0 AS ok FROM mv JOIN pd ON mv.panel=pd.panel),
 mo AS (SELECT f.* FROM fr f JOIN pd ON f.panel=pd.panel QUALIFY row_number() OVER (PARTITION BY f.panel ORDER BY abs(f.total_budget-pd.total_budget*1.3), f.total_budget)=1),
 lo AS (SELECT ch.panel, string_agg(ch.series, ',' ORDER BY ch.series) AS s FROM ch JOIN rc ON ch.panel=rc.panel AND ch.series=rc.series WHERE unit='currency' AND return_p97<=100 AND total_spend>0 AND NOT rc.spend-rc.current>0 GROUP BY 1)
 SELECT panel, 1 AS priority, CASE WHEN ok THEN 'shift' ELSE 'hold' END AS kind, CASE WHEN ok THEN dn_s||'>'||up_s END AS subject, round(CASE WHEN ok THEN least(up_d,-dn_d) END,1) AS amount, round(gain,0) AS kpi_gain,
   CASE WHEN abs(p50)<1e-9 THEN 'low' WHEN (p97-p3)/(2*abs(p50))<0.4 THEN 'high' WHEN (p97-p3)/(2*abs(p50))<1 THEN 'mid' ELSE 'low' END AS confidence FROM sh
 UNION ALL SELECT mo.panel, 2, 'scale', CASE WHEN (mo.p50-pd.p50)*0.01::DOUBLE/(mo.total_budget-pd.total_budget)>1 THEN 'pays' ELSE 'flat' END, round(mo.total_budget-pd.total_budget,1), round(mo.p50-pd.p50,0),
   CASE WHEN (mo.p97-mo.p3)/(2*abs(mo.p50))<0.4 THEN 'high' WHEN (mo.p97-mo.p3)/(2*abs(mo.p50))<1 THEN 'mid' ELSE 'low' END FROM mo JOIN pd ON mo.panel=pd.panel WHERE mo.total_budget>pd.total_budget*1.01
 UNION ALL SELECT panel, 3, 'cut', s, NULL, NULL, 'high' FROM lo""")
def _(spark, sf):
    f = front(spark, sf).persist()  # a few points per panel, read four times below
    now = f.where(F.col("scenario") == "1.0").select("panel", F.col("total_budget").alias("budget"), "p3", "p50", "p97")
    a = rp.actions(channels(spark, sf), alloc_with_current(spark, sf), now, curves(spark, sf), f, KEYS, margin=0.01, most=fx.MAX_ACTIONS)
    return rounded(rounded(a, 1, "amount"), 0, "kpi_gain")


@query("rp_frontier_insight", f"""WITH {FRONTIER_SQL}, pd AS (SELECT * FROM fr WHERE scenario='1.0'), mo AS (SELECT f.* FROM fr f JOIN pd ON f.panel=pd.panel QUALIFY row_number() OVER (PARTITION BY f.panel ORDER BY abs(f.total_budget-pd.total_budget*1.5), f.total_budget)=1)
 SELECT mo.panel, round(mo.total_budget-pd.total_budget,1) AS extra_spend, round(mo.p50-pd.p50,1) AS extra_kpi FROM mo JOIN pd ON mo.panel=pd.panel WHERE mo.total_budget>pd.total_budget*1.01""")
def _(spark, sf):
    f = front(spark, sf).persist()  # a few points per panel, read three times below
    now = f.where(F.col("scenario") == "1.0").select("panel", F.col("total_budget").alias("budget"))
    return rounded(rp.frontier_step(f, now, KEYS, 1.5).select("panel", "extra_spend", "extra_kpi"), 1, "extra_spend", "extra_kpi")


WEEK_SQL = ADD_SQL + f", wk AS (SELECT panel, week_start, component, {q('value','0.5')} AS value FROM attr GROUP BY 1,2,3)"


def weekly_medians(spark, sf):
    return attribution(spark, sf).groupBy("panel", WEEK, "component").agg(F.percentile("value", F.lit(0.5)).alias("value"))


@query("rp_mix_share", f"WITH {WEEK_SQL} SELECT panel, week_start, component, round(greatest(value,0)/coalesce(nullif(sum(greatest(value,0)) OVER (PARTITION BY panel, week_start),0),1)*100,7) AS share_pct FROM wk WHERE component<>'baseline'")
def _(spark, sf):
    w = rp.mix_share(weekly_medians(spark, sf).where(F.col("component") != "baseline"), KEYS)
    return w.select("panel", WEEK, "component", F.round("share_pct", 7).alias("share_pct"))


PARTS = ["baseline", *CHANNELS]


@query("rp_buildup", f"WITH {WEEK_SQL} SELECT panel, week_start, {', '.join(f"round(max(greatest(value,0)) FILTER (component='{c}'),1) AS {c}" for c in PARTS)} FROM wk GROUP BY 1,2")
def _(spark, sf):
    return rounded(rp.buildup(weekly_medians(spark, sf), KEYS, PARTS), 1, *PARTS)


@query("rp_roas_rolling", f"""WITH {WEEK_SQL}, s AS (SELECT wk.panel, wk.week_start, component AS series, wk.value AS c, m.value AS spend, row_number() OVER (PARTITION BY wk.panel, component ORDER BY wk.week_start) AS i FROM wk JOIN master m ON wk.panel=m.panel AND wk.week_start=m.week_start AND wk.component=m.series)
 SELECT panel, week_start, series, round(CASE WHEN i>=4 AND sum(spend) OVER w>1e-6 THEN sum(c) OVER w/sum(spend) OVER w END,8) AS rolling_return FROM s WINDOW w AS (PARTITION BY panel, series ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    spend = master(spark, sf).data.select("panel", WEEK, "series", F.col("value").alias("spend"))
    w = weekly_medians(spark, sf).withColumnRenamed("component", "series").join(spend, ["panel", WEEK, "series"])
    return rp.rolling_return(w, KEYS, "value", "spend").select("panel", WEEK, "series", F.round("rolling_return", 8).alias("rolling_return"))


@query("rp_waterfall", f"""WITH {CH_SQL}, o AS (SELECT panel, series, contribution_p50 AS v, 0.6::DOUBLE*kpi_total AS b, row_number() OVER (PARTITION BY panel ORDER BY contribution_p50 DESC, series) AS n FROM ch),
 r AS (SELECT *, b+sum(v) OVER (PARTITION BY panel ORDER BY n) AS t FROM o)
 SELECT panel, 0 AS position, 'baseline' AS bar, 0.0::DOUBLE AS start, round(max(b),0) AS height FROM o GROUP BY panel UNION ALL SELECT panel, n, series, round(least(t,t-v),0), round(abs(v),0) FROM r
 UNION ALL SELECT panel, max(n)+1, 'total', 0.0, round(arg_max(t,n),0) FROM r GROUP BY panel""")
def _(spark, sf):
    base = kpi_totals(spark, sf).select("panel", (F.col("kpi_total") * 0.6).alias("p50"))
    w = rp.waterfall(channels(spark, sf).select(*PS, F.col("contribution_p50").alias("p50")), base, KEYS)
    return rounded(w, 0, "start", "height")


@query("rp_budget_vs_effect", f"""WITH {CH_SQL}, p AS (SELECT * FROM ch WHERE unit='currency')
 SELECT panel, series, round(total_spend/sum(total_spend) OVER (PARTITION BY panel)*100,7) AS budget_pct, round(greatest(contribution_p50,0)/sum(greatest(contribution_p50,0)) OVER (PARTITION BY panel)*100,7) AS effect_pct FROM p""")
def _(spark, sf):
    return rounded(rp.budget_vs_effect(channels(spark, sf), KEYS), 7, "budget_pct", "effect_pct")


@query("rp_spend_vs_return", f"""WITH {CH_SQL} SELECT panel, series, total_spend AS cost, round(greatest(contribution_p50,0)*0.4::DOUBLE,1) AS value, round(greatest(contribution_p50-contribution_p3,0)*0.4::DOUBLE,1) AS arm_down,
 round(greatest(contribution_p97-contribution_p50,0)*0.4::DOUBLE,1) AS arm_up FROM ch""")
def _(spark, sf):
    return rounded(rp.spend_vs_return(channels(spark, sf), KEYS, 0.4), 1, "value", "arm_down", "arm_up")


@query("rp_marginal_1000", f"""WITH {CURVE_SQL}, sg AS (SELECT *, lag(weekly_spend) OVER (PARTITION BY panel, series ORDER BY step) AS x0, lag(p50) OVER (PARTITION BY panel, series ORDER BY step) AS y0 FROM curves)
 SELECT p.panel, p.series, round((p50-y0)/(weekly_spend-x0)*1000,4) AS per_extra FROM params p JOIN sg ON p.panel=sg.panel AND p.series=sg.series AND p.draw=0 AND p.current>x0 AND p.current<=weekly_spend""")
def _(spark, sf):
    s = pl.segment_slope(current(spark, sf), curves(spark, sf), PS, "spend")
    return rounded(s.drop("spend"), 4, "per_extra")


LEVELS = "CASE panel WHEN 'ASIA' THEN 'not_usable' WHEN 'EUROPE' THEN 'statistically_valid' ELSE 'usable_for_decisions' END"


def levels(spark, sf):
    level = F.when(F.col("panel") == "ASIA", "not_usable").when(F.col("panel") == "EUROPE", "statistically_valid").otherwise("usable_for_decisions")
    return kpi_totals(spark, sf).select("panel", level.alias("level"))


@query("rp_headline", f"""WITH {CH_SQL}, m AS (SELECT panel, sum(total_spend) FILTER (unit='currency') AS s, sum(contribution_p50) AS b FROM ch GROUP BY 1)
 SELECT panel, 'marketing_driven' AS figure, round(b,1) AS value FROM m WHERE {LEVELS}<>'not_usable' UNION ALL SELECT panel, 'return_per_unit', round(b/s,1) FROM m WHERE {LEVELS}<>'not_usable'
 UNION ALL SELECT panel, 'net_return_pct', round((b*0.4::DOUBLE-s)/s*100,1) FROM m WHERE {LEVELS}<>'not_usable'""")
def _(spark, sf):
    totals = kpi_totals(spark, sf).withColumn("baseline_p50", F.col("kpi_total") * 0.6)
    money = rp.money_kpis(channels(spark, sf), totals, KEYS, 0.4)
    return rounded(rp.headline(money, levels(spark, sf), KEYS), 1, "value")


@query("rp_strongest", f"""WITH {CH_SQL} SELECT panel, series, round(share_p50,8) AS share, CASE WHEN share_p97-share_p3>greatest(0.1,share_p50) THEN 'wide' ELSE 'narrow' END AS band FROM ch
 WHERE NOT {STUCK} AND {LEVELS}<>'not_usable' QUALIFY row_number() OVER (PARTITION BY panel ORDER BY share_p50 DESC, series DESC)=1""")
def _(spark, sf):
    return rounded(rp.strongest(channels(spark, sf), verdicts(spark, sf), levels(spark, sf), KEYS), 8, "share")


@query("asof_year_ago", f"""WITH {MASTER_SQL}, h AS (SELECT a.panel, a.series, a.week_start, b.week_start AS d, b.value AS v, abs(a.week_start-b.week_start-364) AS gap FROM master a JOIN master b ON a.panel=b.panel AND a.series=b.series AND b.value IS NOT NULL AND a.week_start-b.week_start BETWEEN 354 AND 374),
 n AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY panel, series, week_start ORDER BY gap, d)=1)
 SELECT m.panel, m.series, m.week_start, m.value, n.d AS year_ago_day, n.v AS year_ago_value FROM master m LEFT JOIN n ON m.panel=n.panel AND m.series=n.series AND m.week_start=n.week_start""")
def _(spark, sf):
    return rp.year_ago(master(spark, sf).data.drop("role"), PS)
