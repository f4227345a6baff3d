"""From parameter draws to contributions, curves, allocations, frontiers and scenarios.

``params``: one row per (keys, series, draw) with beta, half_sat, slope, x_max, y_max and, for
logistic channels, ``saturation`` and ``lam``. Normalised carry-over is the identity at a steady
weekly spend, so planning needs no weekly window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import fixed_values as fx
from tidemark.frames import over
from tidemark.functions.response import hill_effect, logistic_effect
from tidemark.operators.draws import interval_columns


def own_effect(spend: Column, logistic: bool = False) -> Column:
    """Scaled effect of a weekly spend under the row's parameters."""
    u = over(spend, F.col("x_max"))
    shape = hill_effect(u, F.col("half_sat"), F.col("slope"))
    if logistic:
        shape = F.when(F.col("saturation") == "logistic", logistic_effect(u, F.col("lam"))).otherwise(shape)
    return F.col("beta") * shape


def has_logistic(df: DataFrame) -> bool:
    """Whether rows say which saturation they have; without that all are Hill curves."""
    return "saturation" in df.columns


def contribution(spend: Column, other_log: Column | None = None, logistic: bool = False) -> Column:
    """KPI from a weekly spend; under a log link on top of what else drives the KPI. A row without ``other_log`` is additive."""
    own = own_effect(spend, logistic)
    if other_log is None:
        return own * F.col("y_max")
    return F.when(other_log.isNull(), own * F.col("y_max")).otherwise(F.exp(other_log + own) - F.exp(other_log))


def steady_references(expected: DataFrame, contributions: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Log-link levels per draw, averaged over weeks: without any channel, and without each one."""
    at = [*keys, "week_start", "draw"]
    media = contributions.groupBy(*at).agg(F.sum("contrib").alias("_m"))
    base = (expected.select(*at, "mu").join(media, at).groupBy(*keys, "draw")
            .agg(F.avg(F.col("mu") - F.col("_m")).alias("baseline_log")))
    other = (contributions.select(*at, "series", "contrib").join(expected.select(*at, "mu"), at)
             .groupBy(*keys, "series", "draw").agg(F.avg(F.col("mu") - F.col("contrib")).alias("other_log")))
    return base, other


def response_curve(params: DataFrame, keys: list[str], points: int = fx.CURVE_POINTS,
                   cap: float = fx.CAP_FACTOR) -> DataFrame:
    """Interval per point from 0 to 1.2 times the largest seen spend."""
    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    grid = params.withColumn("step", step).withColumn(
        "weekly_spend", F.col("x_max") * F.lit(cap) * F.col("step") / (points - 1))
    other = F.col("other_log") if "other_log" in params.columns else None
    out = grid.groupBy(*keys, "series", "step").agg(
        F.max("weekly_spend").alias("weekly_spend"), F.max("x_max").alias("_top"),
        *interval_columns(contribution(F.col("weekly_spend"), other, has_logistic(params))))
    return out.withColumn("extrapolated", F.col("weekly_spend") > F.col("_top")).drop("_top")


def marginal_return(params: DataFrame, keys: list[str], spend: str) -> DataFrame:
    """Central difference of the contribution at ``spend``; its low end never goes below 0."""
    h = F.greatest(F.col("x_max") * fx.MARGINAL_STEP, F.lit(fx.SHAPE_EPS))
    hi, lo = F.col(spend) + h, F.greatest(F.col(spend) - h, F.lit(0.0))
    other = F.col("other_log") if "other_log" in params.columns else None
    logistic = has_logistic(params)
    slope = (contribution(hi, other, logistic) - contribution(lo, other, logistic)) / (hi - lo)
    return params.groupBy(*keys, "series").agg(*interval_columns(slope))


def average_return(params: DataFrame, keys: list[str], spend: str) -> DataFrame:
    ratio = F.when(F.col(spend) > 0, contribution(F.col(spend), logistic=has_logistic(params)) / F.col(spend))
    return params.groupBy(*keys, "series").agg(*interval_columns(ratio))


def total_contribution(params: DataFrame, allocation: DataFrame, keys: list[str], scenario: list[str] = (),
                       baseline_log: DataFrame | None = None) -> DataFrame:
    """Interval of the joint contribution of an allocation ``(keys, scenario, series, spend)``.

    With ``baseline_log`` the link of the panels in it is the exponential and channels act together.
    """
    j = params.join(allocation.select(*keys, *scenario, "series", "spend"), [*keys, "series"])
    effect = own_effect(F.col("spend"), has_logistic(params))
    per_draw = j.groupBy(*keys, *scenario, "draw").agg(F.sum(effect).alias("_own"), F.sum(effect * F.col("y_max")).alias("_t"))
    if baseline_log is not None:
        joint = F.exp(F.col("baseline_log") + F.col("_own")) - F.exp("baseline_log")
        per_draw = per_draw.join(baseline_log, [*keys, "draw"], "left").withColumn("_t", F.when(F.col("baseline_log").isNull(), F.col("_t")).otherwise(joint))
    return per_draw.groupBy(*keys, *scenario).agg(*interval_columns(F.col("_t")))


# --- allocation on a step grid --------------------------------------------------------------

def median_params(params: DataFrame, keys: list[str]) -> DataFrame:
    names = ("beta", "half_sat", "slope") + (("lam",) if has_logistic(params) else ())
    kind = [F.max("saturation").alias("saturation")] if has_logistic(params) else []
    return params.groupBy(*keys, "series").agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in names], *kind,
                                               F.max("x_max").alias("x_max"), F.max("y_max").alias("y_max"))


def allocation_ranges(medians: DataFrame, budgets: DataFrame, keys: list[str], limits: DataFrame | None = None,
                      steps: int = 100, cap: float = fx.CAP_FACTOR) -> DataFrame:
    """Per (keys, scenario, channel): low, high, the step size, how many steps fit, and the number of steps in all.

    ``budgets``: (keys, scenario, budget); ``limits``: (keys, series, min_spend, max_spend). The
    spendable total is clipped to what the channels can take.
    """
    m = medians
    if limits is None:
        m = m.withColumns({"min_spend": F.lit(0.0), "max_spend": F.lit(None).cast("double")})
    else:
        m = m.join(limits, [*keys, "series"], "left")
    low = F.greatest(F.coalesce("min_spend", F.lit(0.0)), F.lit(0.0))
    high = F.least(F.col("x_max") * cap, F.coalesce("max_spend", F.col("x_max") * cap))
    j = (m.withColumn("low", low).withColumn("high", F.greatest(high, F.col("low"))).drop("min_spend", "max_spend")
         .join(budgets, keys))
    w = Window.partitionBy(*keys, "scenario")
    total = F.greatest(F.least(F.col("budget"), F.sum("high").over(w)), F.sum("low").over(w))
    j = j.withColumn("feasible", total).withColumn("delta", (total - F.sum("low").over(w)) / steps)
    fit = F.when(F.col("delta") > 0, F.floor((F.col("high") - F.col("low")) / F.col("delta") + 1e-9)).otherwise(0)
    return j.withColumn("n_fit", F.least(fit, F.lit(steps)).cast("int")).withColumn("steps", F.lit(steps))


def require_money(channels: DataFrame, unit: str = "unit") -> DataFrame:
    """Only money can be moved between channels."""
    return channels.where(F.col(unit) == fx.MONEY_UNIT)


def tradeable(channels: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Channels with ``can_move``: measured in money and told apart by the model."""
    stuck = verdicts.where(F.col("verdict") == "not_identified").select(*keys, "series").distinct().withColumn("_stuck", F.lit(True))
    j = channels.join(stuck, [*keys, "series"], "left")
    return j.withColumn("can_move", (F.col("unit") == fx.MONEY_UNIT) & F.col("_stuck").isNull()).drop("_stuck")


def allocate(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Best split of each budget for concave curves: (keys, scenario, series, spend, at_cap).

    Steps with the largest gains are taken until the budget is spent. Gains of a concave curve
    never rise, so what is taken of each channel is a prefix and the split is exact on the grid.
    Money that whole steps leave over goes to channels with room, so that spend adds up to ``feasible``.
    A window holds channels x steps rows, whatever the number of panels. For S-curves use
    :func:`allocate_exact`.
    """
    k = ranges.where(F.col("n_fit") > 0).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_fit"))))
    at = F.col("low") + F.col("k") * F.col("delta")
    logistic = has_logistic(ranges)
    gain = (own_effect(at, logistic) - own_effect(at - F.col("delta"), logistic)) * F.col("y_max")
    w = Window.partitionBy(*keys, "scenario").orderBy(F.desc("gain"), "series", "k")
    picks = (k.withColumn("gain", F.round(gain, 9)).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.col("steps"))
             .groupBy(*keys, "scenario", "series").agg(F.count(F.lit(1)).alias("taken")))
    return _allocated(ranges, picks, keys)


def _allocated(ranges: DataFrame, picks: DataFrame, keys: list[str]) -> DataFrame:
    """Spend of the steps taken, then what is left of the budget by the largest gain of filling a channel's room."""
    at, on = [*keys, "scenario"], [*keys, "scenario", "series"]
    j = ranges.join(picks, on, "left").withColumn("_spend", F.col("low") + F.coalesce("taken", F.lit(0)) * F.col("delta"))
    j = j.withColumn("_room", F.greatest(F.col("high") - F.col("_spend"), F.lit(0.0)))
    j = j.withColumn("_left", F.greatest(F.col("feasible") - F.sum("_spend").over(Window.partitionBy(*at)), F.lit(0.0)))
    logistic = has_logistic(ranges)
    gain = (own_effect(F.col("_spend") + F.least("_room", "_left"), logistic) - own_effect(F.col("_spend"), logistic)) * F.col("y_max")
    before = Window.partitionBy(*at).orderBy(F.desc("_gain"), "series").rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("_gain", F.round(gain, 9)).withColumn("_before", F.coalesce(F.sum("_room").over(before), F.lit(0.0)))
    spend = F.col("_spend") + F.least(F.greatest(F.col("_left") - F.col("_before"), F.lit(0.0)), F.col("_room"))
    return j.select(*on, spend.alias("spend"), "feasible", (spend >= F.col("high") * (1 - 1e-9)).alias("at_cap"))


def allocate_exact(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Best split on the grid for curves of any shape, one channel folded in at a time.

    A budget is one row that carries its channels' values per step count. The state is the best
    value for every number of steps, and a channel is added by trying all its step counts: work
    of channels x steps^2 inside the row, no shuffle beyond gathering the channels.
    """
    at = [*keys, "scenario"]
    effects = F.transform(F.sequence(F.lit(0), F.col("n_fit")), lambda k: own_effect(F.col("low") + k * F.col("delta"), has_logistic(ranges)) * F.col("y_max"))
    rows = ranges.select(*at, "series", "steps", effects.alias("v")).groupBy(*at).agg(
        F.array_sort(F.collect_list(F.struct("series", "v"))).alias("_ch"), F.max("steps").alias("steps"))
    kind = "array<struct<best:double,picks:array<int>>>"
    start = F.transform(F.sequence(F.lit(0), F.col("steps")), lambda b: F.struct(F.lit(0.0).alias("best"), F.slice(F.array(b), 1, 0).alias("picks"))).cast(kind)

    def add(state: Column, channel: Column) -> Column:
        v = channel["v"]

        def best_with(b: Column) -> Column:
            options = F.transform(F.sequence(F.lit(0), F.least(F.size(v) - 1, b)), lambda k: F.struct(
                (F.get(state, b - k)["best"] + F.get(v, k)).alias("best"),
                F.array_append(F.get(state, b - k)["picks"], k).alias("picks")))
            return F.array_max(options)

        return F.transform(F.sequence(F.lit(0), F.col("steps")), best_with).cast(kind)

    done = rows.withColumn("_s", F.aggregate("_ch", start, add)).select(
        *at, F.arrays_zip(F.transform("_ch", lambda c: c["series"]).alias("series"), F.get("_s", F.col("steps"))["picks"].alias("taken")).alias("_z"))
    picks = done.select(*at, F.explode("_z").alias("_p")).select(
        *at, F.col("_p")["series"].alias("series"), F.col("_p")["taken"].alias("taken"))
    return _allocated(ranges, picks, keys)


def allocation_refusals(medians: DataFrame, budgets: DataFrame, keys: list[str], limits: DataFrame | None = None,
                        cap: float = fx.CAP_FACTOR) -> DataFrame:
    """(keys, scenario, series, code) of what makes a budget impossible to split; a panel without rows here may be allocated.

    ``budget_not_positive`` (or missing) and ``minimums_above_budget`` concern the whole budget, their series is NULL;
    ``minimum_above_cap`` names the channel whose minimum is above what it may take.
    """
    m = medians if limits is None else medians.join(limits, [*keys, "series"], "left")
    low = F.greatest(F.coalesce("min_spend", F.lit(0.0)), F.lit(0.0)) if limits is not None else F.lit(0.0)
    top = F.col("x_max") * cap
    high = F.least(top, F.coalesce("max_spend", top)) if limits is not None else top
    j = m.select(*keys, "series", low.alias("_low"), high.alias("_high")).join(budgets, keys)
    above = j.where(F.col("_low") > F.col("_high") * (1 + 1e-9)).select(*keys, "scenario", "series", F.lit("minimum_above_cap").alias("code"))
    whole = j.groupBy(*keys, "scenario", "budget").agg(F.sum("_low").alias("_low"))
    code = (F.when(~F.coalesce(F.col("budget") > 0, F.lit(False)), "budget_not_positive")
            .when(F.col("_low") > F.col("budget") * (1 + 1e-9), "minimums_above_budget"))
    return above.unionByName(whole.select(*keys, "scenario", F.lit(None).cast("string").alias("series"), code.alias("code")).where("code IS NOT NULL"))


BISECTIONS = 100


def _spend_where(slope: Column, c: Column) -> Column:
    """The spend at which a channel's next unit still brings ``slope``, for curves that only flatten; within its bounds.

    Hill curves of slope 1 and logistic ones are solved; Hill curves of a smaller slope are halved in on.
    """
    x, eps = c["x_max"], F.lit(fx.SHAPE_EPS)
    hill = (F.sqrt(c["value"] * c["half_sat"] / (slope * x)) - c["half_sat"] - eps) * x
    # d/du of (1 - e)/(1 + e), e = exp(-lam u), is 2 lam e/(1 + e)^2: a quadratic in e
    ratio = 2 * c["value"] * c["lam"] / (slope * x) - 2
    e = (ratio - F.sqrt(F.greatest(ratio * ratio - 4, F.lit(0.0)))) / 2
    logistic = F.when(ratio > 2, -F.log(F.greatest(e, F.lit(1e-300))) / c["lam"] * x).otherwise(0.0)

    def marginal(spend):
        u = spend / x + eps
        p, k = F.pow(u, c["slope"]), F.pow(c["half_sat"], c["slope"])
        return c["value"] * c["slope"] * k * p / (u * (k + p) * (k + p)) / x

    halved = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(c["low"].alias("a"), c["high"].alias("b")), lambda s, _: F.when(
        marginal((s["a"] + s["b"]) / 2) > slope, F.struct(((s["a"] + s["b"]) / 2).alias("a"), s["b"].alias("b"))).otherwise(
        F.struct(s["a"].alias("a"), ((s["a"] + s["b"]) / 2).alias("b"))))["a"]
    spend = F.when(c["value"] <= 0, c["low"]).when(c["logistic"], logistic).when(c["slope"] == 1, hill).otherwise(halved)
    return F.least(F.greatest(spend, c["low"]), c["high"])


def allocate_smooth(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Best split of each budget without a step grid: (keys, scenario, series, spend, feasible, at_cap).

    At the best split every channel that is at neither bound brings the same for its next unit. One row per budget holds
    its channels; that common return is halved in on over its logarithm, and each channel's spend follows from it. What
    the last halving leaves goes to channels with room, so that spend adds up to ``feasible``. Curves must only flatten:
    Hill of slope 1 or below, or logistic; panels with a steeper Hill curve give no row and belong to
    :func:`allocate_exact`. Channels without an effect take money only when no other has room.
    """
    at = [*keys, "scenario"]
    logistic = F.coalesce(F.col("saturation") == "logistic", F.lit(False)) if has_logistic(ranges) else F.lit(False)
    lam = F.col("lam") if has_logistic(ranges) else F.lit(None).cast("double")
    cell = F.struct("series", "low", "high", (F.col("beta") * F.col("y_max")).alias("value"), F.coalesce("half_sat", F.lit(1.0)).alias("half_sat"),
                    F.coalesce(F.col("slope").cast("double"), F.lit(1.0)).alias("slope"), F.coalesce(lam, F.lit(1.0)).alias("lam"), logistic.alias("logistic"), "x_max")
    rows = ranges.groupBy(*at).agg(F.array_sort(F.collect_list(cell)).alias("_c"), F.max("feasible").alias("feasible"))
    rows = rows.where(~F.exists("_c", lambda c: ~c["logistic"] & (c["slope"] > 1)))

    def spent(slope):
        return F.aggregate("_c", F.lit(0.0), lambda total, c: total + _spend_where(slope, c))

    # the return of a first unit is largest at no spend; an infinite one (slope below 1) is cut off by the shapes' epsilon
    steepest = F.array_max(F.transform("_c", lambda c: F.when(c["logistic"], c["value"] * c["lam"] / 2).otherwise(
        c["value"] * c["slope"] * F.pow(F.lit(fx.SHAPE_EPS), c["slope"] - 1) / F.pow(c["half_sat"], c["slope"])) / c["x_max"]))
    top = F.log(F.greatest(steepest, F.lit(1e-200))) + 1.0
    rows = rows.withColumn("_top", top)
    halved = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), F.struct((F.col("_top") - 80.0).alias("a"), F.col("_top").alias("b")),
                         lambda s, _: F.when(spent(F.exp((s["a"] + s["b"]) / 2)) > F.col("feasible"),
                                             F.struct(((s["a"] + s["b"]) / 2).alias("a"), s["b"].alias("b"))).otherwise(
                                             F.struct(s["a"].alias("a"), ((s["a"] + s["b"]) / 2).alias("b"))))
    rows = rows.withColumn("_slope", F.exp(halved["b"]))
    split = rows.select(*at, "feasible", "_slope", F.explode("_c").alias("c")).select(
        *at, "feasible", F.col("c.series").alias("series"), F.col("c.high").alias("high"), (F.col("c.value") > 0).alias("_live"),
        _spend_where(F.col("_slope"), F.col("c")).alias("_spend"))
    w = Window.partitionBy(*at)
    split = split.withColumn("_left", F.greatest(F.col("feasible") - F.sum("_spend").over(w), F.lit(0.0))).withColumn(
        "_room", F.greatest(F.col("high") - F.col("_spend"), F.lit(0.0)))
    before = w.orderBy(F.desc("_live"), F.desc("_room"), "series").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.least(F.greatest(F.col("_left") - F.coalesce(F.sum("_room").over(before), F.lit(0.0)), F.lit(0.0)), F.col("_room"))
    spend = F.col("_spend") + taken
    return split.select(*at, "series", spend.alias("spend"), "feasible", (spend >= F.col("high") * (1 - 1e-9)).alias("at_cap"))


def scaled_budgets(current: DataFrame, keys: list[str], factors: tuple = fx.FRONTIER_FACTORS) -> DataFrame:
    """(keys, scenario, budget): the current total times each factor."""
    f = F.explode(F.array(*[F.lit(float(x)) for x in factors]))
    return (current.groupBy(*keys).agg(F.sum("spend").alias("_t")).withColumn("factor", f)
            .select(*keys, F.col("factor").cast("string").alias("scenario"), (F.col("_t") * F.col("factor")).alias("budget")))


def frontier(params: DataFrame, current: DataFrame, keys: list[str], steps: int = 100,
             baseline_log: DataFrame | None = None) -> DataFrame:
    """Best total at each multiple of today's budget, all budgets in one query."""
    ranges = allocation_ranges(median_params(params, keys), scaled_budgets(current, keys), keys, None, steps)
    split = allocate(ranges, keys)
    total = total_contribution(params, split, keys, ["scenario"], baseline_log)
    spent = split.groupBy(*keys, "scenario").agg(F.max("feasible").alias("total_budget"))
    return total.join(spent, [*keys, "scenario"])


def incremental(params: DataFrame, current: DataFrame, extra: DataFrame, keys: list[str], steps: int = 100) -> DataFrame:
    """Where extra money goes when today's spend is the floor. ``extra``: (keys, scenario, extra)."""
    floor = current.select(*keys, "series", F.col("spend").alias("min_spend"), F.lit(None).cast("double").alias("max_spend"))
    total = current.groupBy(*keys).agg(F.sum("spend").alias("_t"))
    budgets = extra.join(total, keys).select(*keys, "scenario", (F.col("_t") + F.col("extra")).alias("budget"))
    return allocate(allocation_ranges(median_params(params, keys), budgets, keys, floor, steps), keys)


# --- reading curves -----------------------------------------------------------------------

def curve_arrays(curves: DataFrame, keys: list[str], x: str = "weekly_spend", ys: tuple[str, ...] = ("p50",)) -> DataFrame:
    """One row per curve with its points in order (tens of points, by construction)."""
    return curves.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), *[F.col(y).alias(y) for y in ys]))).alias("points"))


def read_curve(at: DataFrame, curves: DataFrame, keys: list[str], spend: str, x: str = "weekly_spend",
               ys: tuple[str, ...] = ("p50",)) -> DataFrame:
    """Linear interpolation on each curve, flat beyond its ends, with ``outside``.

    The points travel as one array per curve, so this is an equi-join instead of a range join.
    """
    j = at.join(curve_arrays(curves, keys, x, ys), keys)
    s, p, n = F.col(spend), F.col("points"), F.size("points")
    above = F.size(F.filter("points", lambda q: q["x"] < s))
    i = F.greatest(F.least(above, n - 1), F.lit(1))
    a, b = F.get(p, i - 1), F.get(p, F.least(i, n - 1))
    lo, hi = F.get(p, F.lit(0)), F.get(p, n - 1)
    gap = b["x"] - a["x"]
    t = (s - a["x"]) / F.when(gap == 0, 1.0).otherwise(gap)
    out = {y: F.when(s <= lo["x"], lo[y]).when(s >= hi["x"], hi[y]).otherwise(a[y] + t * (b[y] - a[y])) for y in ys}
    outside = (s < lo["x"] - 1e-6) | (s > hi["x"] + 1e-6)
    return j.withColumns({**out, "outside": outside}).drop("points")


def segment_slope(at: DataFrame, curves: DataFrame, keys: list[str], spend: str, extra: float = 1000.0) -> DataFrame:
    """Slope of the curve segment at ``spend``, per ``extra`` more."""
    j = at.join(curve_arrays(curves, keys), keys)
    s, p, n = F.col(spend), F.col("points"), F.size("points")
    above = F.size(F.filter("points", lambda q: q["x"] < s))
    i = F.greatest(F.least(above, n - 1), F.lit(1))
    a, b = F.get(p, i - 1), F.get(p, i)
    gap = b["x"] - a["x"]
    return j.withColumn("per_extra", F.when((n >= 2) & (gap > 0), (b["p50"] - a["p50"]) / gap * extra)).drop("points")


def scenarios(chosen: DataFrame, curves: DataFrame, current: DataFrame, baseline: DataFrame, keys: list[str],
              margin: float | None = None, front: DataFrame | None = None) -> DataFrame:
    """Base against chosen spend per scenario and horizon.

    ``chosen``: (keys, scenario, series, spend) for changed channels; ``current``: (keys, series,
    spend); ``baseline``: (keys, baseline_weekly); ``front``: (keys, total_budget, p50).
    """
    on = [*keys, "series"]
    names = chosen.select(*keys, "scenario").distinct()
    rows = (names.join(current.withColumnRenamed("spend", "base"), keys)
            .join(chosen, [*keys, "scenario", "series"], "left")
            .withColumn("spend", F.coalesce("spend", "base")))
    base = read_curve(rows, curves, on, "base").withColumnRenamed("p50", "base_kpi").drop("outside")
    both = read_curve(base, curves, on, "spend")
    t = both.groupBy(*keys, "scenario").agg(
        F.sum("base").alias("base_spend"), F.sum("spend").alias("scenario_spend"), F.sum("base_kpi").alias("base_marketing"),
        F.sum("p50").alias("scenario_marketing"), F.max("outside").alias("any_outside"))
    t = (t.join(baseline, keys).withColumn("base_kpi", F.col("baseline_weekly") + F.col("base_marketing"))
         .withColumn("scenario_kpi", F.col("baseline_weekly") + F.col("scenario_marketing")))
    if front is not None:
        t = read_curve(t, front, keys, "scenario_spend", "total_budget").drop("outside").withColumnRenamed("p50", "optimal_marketing")
        gap = F.col("optimal_marketing") - F.col("scenario_marketing")
        t = t.withColumn("leaves_on_table", gap > F.greatest(F.lit(1.0), F.col("scenario_marketing") * fx.SHIFT_GAIN))
    h = F.explode(F.array(*[F.lit(x) for x in fx.HORIZONS]))
    t = t.withColumn("weeks", h)
    kpi = (F.col("scenario_kpi") - F.col("base_kpi")) * F.col("weeks")
    cost = (F.col("scenario_spend") - F.col("base_spend")) * F.col("weeks")
    t = t.withColumn("kpi_delta", kpi).withColumn("spend_delta", cost)
    return t if margin is None else t.withColumn("net", F.col("kpi_delta") * margin - F.col("spend_delta"))


def frontier_read(at: DataFrame, front: DataFrame, keys: list[str], budget: str) -> DataFrame:
    return read_curve(at, front, keys, budget, "total_budget").drop("outside").withColumnRenamed("p50", "optimal_contribution")
