"""From a weekly dataset to verdict and plan: priors, fit, draws, attribution, evidence, diagnostics, curves.

Every step is an operator of this package; this module only says in which order. Tables that
several later steps read (design, shapes, draws, contributions) are stored once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from tidemark import fixed_values as fx
from tidemark.frames import WEEK, over, stored, union_all
from tidemark.operators import channel_fit as cf, draws as dr, evaluate as ev, fit, identify as idn, measure as me, planning as pl, verdict as vd

WIDER = 2.0           # by how much priors are widened for the sensitivity refit
PRIOR_DRAWS = 60


@dataclass(frozen=True)
class Beliefs:
    """What a user states beforehand; what is not stated is ``unknown``.

    ``channels``: (keys, series, channel_role, strength, carryover, saturation, unit). ``panels``: (keys, media_share,
    seasonality). Rows may be missing. ``likelihood`` overrides the choice from the data.
    """

    kpi_type: str = "revenue"
    channels: DataFrame | None = None
    panels: DataFrame | None = None
    likelihood: str | None = None


@dataclass(frozen=True)
class ModelRun:
    best: DataFrame
    params: DataFrame
    contributions: DataFrame
    expected: DataFrame
    channels: DataFrame
    diagnostics: DataFrame
    identifiability: DataFrame
    checks: DataFrame
    levels: DataFrame
    refused: DataFrame
    terms: DataFrame
    folds: DataFrame
    sensitivity: DataFrame
    prior_gate: DataFrame
    baseline_log: DataFrame


def prior_tables(data: DataFrame, keys: list[str], kpi: str, channels: list[str], controls: list[str], beliefs: Beliefs) -> tuple[DataFrame, DataFrame]:
    """(baseline priors with likelihood and kpi_max, channel priors), from measured scale and stated beliefs."""
    data = data.where((F.col("series") == kpi) | (F.col("role") != "kpi"))
    panel = (me.kpi_stats(data, keys).join(me.trend(data, keys), keys).join(me.season_amplitude(data, keys), keys)
             .join(me.residual_stats(data, keys, channels, controls), keys))
    if beliefs.panels is not None:
        panel = panel.join(beliefs.panels.select(*keys, "media_share", "seasonality"), keys, "left")
    else:
        panel = panel.withColumns({"media_share": F.lit(None).cast("string"), "seasonality": F.lit(None).cast("string")})
    chosen = me.likelihood(F.lit(beliefs.kpi_type), F.col("kpi_is_integer"), F.col("kpi_median"), F.col("excess_kurtosis"))
    panel = panel.withColumns({"seasonality": F.coalesce("seasonality", F.lit("unknown")),
                               "likelihood": chosen if beliefs.likelihood is None else F.lit(beliefs.likelihood)})
    names = ["channel_role", "strength", "carryover", "saturation", "unit"]
    intent = data.where((F.col("role") == "spend") & F.col("series").isin(*channels)).select(*keys, "series").distinct()
    if beliefs.channels is not None:
        intent = intent.join(beliefs.channels.select(*keys, "series", *names), [*keys, "series"], "left")
    else:
        intent = intent.withColumns({n: F.lit(None).cast("string") for n in names})
    for name, default in (("channel_role", "mixed"), ("strength", "unknown"), ("carryover", "unknown"), ("saturation", "unknown"), ("unit", fx.MONEY_UNIT)):
        intent = intent.withColumn(name, F.coalesce(name, F.lit(default)))
    base = stored(me.baseline_priors(panel), "baseline-priors")
    stats = me.channel_stats(data.where(F.col("series").isin(*channels)), keys)
    of_panel = base.select(*keys, "media_share", "likelihood", "kpi_median_scaled")
    return base, stored(me.channel_priors(intent, stats, of_panel, keys), "channel-priors")


def shares(chosen: DataFrame, fitted: DataFrame, terms: DataFrame, keys: list[str], free: list[str], channels: list[str], burn_in: int) -> DataFrame:
    """(keys, series, share of the outcome) of a fit: what goes without the channel, over the outcome."""
    weeks = chosen.where((F.col("idx") >= burn_in) & F.col("actual").isNotNull()).join(fitted.select(*keys, "coef"), keys).join(terms.select(*keys, "likelihood"), keys)
    mu = F.lit(0.0)
    for i, c in enumerate([*free, *[f"x_{c}" for c in channels]]):
        mu = mu + F.get("coef", F.lit(i)) * F.col(c)
    weeks = weeks.withColumn("_mu", mu)
    count = F.col("likelihood").isin(*cf.COUNTS)

    def lift(i, c):
        own = F.get("coef", F.lit(len(free) + i)) * F.col(f"x_{c}")
        return F.when(count, F.exp("_mu") - F.exp(F.col("_mu") - own)).otherwise(own * F.col("y_max"))

    sums = weeks.groupBy(*keys).agg(F.sum("actual").alias("_y"), *[F.sum(lift(i, c)).alias(f"_l{i}") for i, c in enumerate(channels)])
    return sums.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("series"), over(F.col(f"_l{i}"), F.col("_y")).alias("share")) for i, c in enumerate(channels)])))


def on_unseen_weeks(data: DataFrame, folds: DataFrame, keys: list[str], kpi: str, channels: list[str], controls: list[str], shapes: list[cf.Shape],
                    beliefs: Beliefs, burn_in: int) -> DataFrame:
    """(keys, fold, week, actual, fitted) of each fold's test weeks; scale, priors, shapes and fit see its training weeks alone.

    ``folds``: (keys, fold, train_end, test_end). All folds of all panels are fitted at once.
    """
    at = [*keys, "fold"]
    weeks = data.select(*keys, WEEK).distinct().withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(WEEK)) - 1)
    dealt = stored(data.join(weeks, [*keys, WEEK]).join(folds.select(*at, "train_end", "test_end"), keys).where(F.col("_i") < F.col("test_end"))
                   .select(*at, WEEK, "series", "role", "value", "_i", "train_end"), "folds")
    train = dealt.where(F.col("_i") < F.col("train_end"))
    base, chan = prior_tables(train, at, kpi, channels, controls, beliefs)
    design, free = cf.weekly_design(dealt, at, kpi, channels, controls, shapes, sizes=fit.scalers(train, at), n_train="train_end")
    design = stored(design.join(folds.select(*at, "train_end"), at).withColumn("is_train", F.col("idx") < F.col("train_end")), "fold-design")
    terms = cf.prior_terms(base, chan, at, free, channels, shapes)
    fitted = stored(cf.fit_channels(design, at, free, channels, shapes, terms, burn_in), "fold-fits")
    tests = cf.with_choice(design.where(~F.col("is_train")), fitted, at, channels, len(shapes))
    mu = cf.expected_weeks(tests, fitted, at, free, channels).join(base.select(*at, "likelihood"), at)
    return mu.where(F.col("actual").isNotNull()).select(*at, WEEK, "actual", cf.in_outcome(F.col("mu"), F.col("likelihood"), F.col("y_max")).alias("fitted"))


def run_model(master: DataFrame, keys: list[str], kpi: str, channels: list[str], controls: list[str],
              shapes: list[cf.Shape] | None = None, replicates: int = 100, burn_in: int = 4, beliefs: Beliefs = Beliefs(),
              cv_train: int = 104, cv_horizon: int = 26) -> ModelRun:
    """Fit every panel that may be fitted and judge the result.

    Every channel has its own shape out of ``shapes``. Priors come from ``beliefs`` and the panel's own scale, and the
    likelihood from the outcome (counts get a log link). Evidence: a refit under wider priors, a holdout, expanding folds of
    ``cv_horizon`` weeks from ``cv_train`` on, a refit with a random channel, and what the priors alone imply.
    A panel with a channel that cannot support its own parameters is left out and listed in ``refused``.
    """
    shapes = shapes or cf.shape_grid(lams=(1.5, 3.0, 6.0), thetas=(None, 1.0, 2.0))
    stats = me.channel_stats(master.where(F.col("series").isin(*channels)), keys)
    refused = me.channel_guard(stats).select(*keys, "series", "refused")
    data = master.join(refused.select(*keys).distinct(), keys, "left_anti")
    base, chan = prior_tables(data, keys, kpi, channels, controls, beliefs)
    design, free = cf.weekly_design(data, keys, kpi, channels, controls, shapes)
    design = stored(design, "design")
    terms = stored(cf.prior_terms(base, chan, keys, free, channels, shapes), "terms")
    best = stored(cf.fit_channels(design, keys, free, channels, shapes, terms, burn_in), "best")
    chosen = stored(cf.with_choice(design, best, keys, channels, len(shapes)), "chosen")
    draws = stored(cf.fit_draws(chosen, best, keys, free, channels, replicates, terms, burn_in), "coefs")
    kinds = terms.select(*keys, "likelihood")
    count = F.col("likelihood").isin(*cf.COUNTS)

    expected = stored(cf.expected_weeks(chosen.where((F.col("idx") >= burn_in) & F.col("actual").isNotNull()), draws, keys, free, channels, ["draw"])
                      .join(kinds, keys), "expected")
    at = {c: len(free) + i for i, c in enumerate(channels)}
    betas = F.inline(F.array(*[F.struct(F.lit(c).alias("series"), F.get("coef", F.lit(i)).alias("beta")) for c, i in at.items()]))
    facts = F.array(*[F.struct(F.lit(s.half_life).alias("half_life"), F.lit(s.half_sat).cast("double").alias("half_sat"), F.lit(float(s.slope)).alias("slope"),
                               F.lit(s.lam).cast("double").alias("lam"), F.lit(s.theta).cast("double").alias("theta"),
                               F.lit("hill" if s.lam is None else "logistic").alias("saturation")) for s in shapes])
    picked = F.inline(F.array(*[F.struct(F.lit(c).alias("series"), F.get(facts, F.get("choice", F.lit(i))).alias("shape")) for i, c in enumerate(channels)]))
    x_max = data.where(F.col("role") == "spend").groupBy(*keys, "series").agg(F.max("value").alias("x_max"), F.avg("value").alias("current"))
    y_max = design.groupBy(*keys).agg(F.max("y_max").alias("y_max"))
    plain = (draws.select(*keys, "draw", betas).join(best.select(*keys, picked).select(*keys, "series", "shape.*"), [*keys, "series"])
             .join(x_max, [*keys, "series"]).join(y_max, keys))

    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("series"), F.col(f"x_{c}").alias("effect"), F.col(f"d_{c}").alias("direct_fraction")) for c in channels]))
    effects = chosen.where((F.col("idx") >= burn_in) & F.col("actual").isNotNull()).select(*keys, WEEK, cells)
    spend = data.where(F.col("role") == "spend").select(*keys, WEEK, "series", F.col("value").alias("spend"))
    parts = (effects.join(spend, [*keys, WEEK, "series"]).join(plain.select(*keys, "series", "draw", "beta", "y_max"), [*keys, "series"]).join(kinds, keys)
             .withColumn("contrib", F.col("effect") * F.col("beta")))
    parts = stored(parts.select(*keys, WEEK, "series", "draw", "contrib", "spend", "y_max", "direct_fraction", "likelihood"), "parts")
    additive = dr.attribute_additive(expected.where(~count), parts.where(~count), keys)
    logged = dr.attribute_count(expected.where(count), parts.where(count), keys)
    components = stored(additive.unionByName(logged), "components")
    on = [*keys, WEEK, "series", "draw"]
    values = components.where(F.col("component") != "baseline").withColumnRenamed("component", "series")
    contributions = stored(parts.drop("likelihood").join(values, on), "contributions")

    base_log, other_log = pl.steady_references(expected.where(count), parts.where(count), keys)
    base_log = stored(base_log, "baseline-log")
    params = stored(plain.join(other_log, [*keys, "series", "draw"], "left"), "params")
    observed = chosen.where((F.col("idx") >= burn_in) & F.col("actual").isNotNull())
    totals = observed.groupBy(*keys).agg(F.sum("actual").alias("kpi_total"))
    results = dr.channel_results(contributions, totals, keys)

    outcome = cf.in_outcome(F.col("mu"), F.col("likelihood"), F.col("y_max"))
    weeks = stored(expected.groupBy(*keys, WEEK).agg(F.max("actual").alias("actual"), F.avg(outcome).alias("fitted")), "weeks")
    noisy = expected.join(best.select(*keys, "sigma", "dispersion"), keys)
    seen = [*keys, WEEK, "draw", "actual", "predicted"]
    predicted = union_all([
        dr.predictive_normal(noisy.where("likelihood = 'normal'"), keys, "sigma", "y_max").select(*seen),
        dr.predictive_t(noisy.where("likelihood = 'student_t'"), keys, "sigma", "y_max", cf.STUDENT_T_NU).select(*seen),
        dr.predictive_count(noisy.where(count).withColumn("_mean", F.exp("mu")), keys, "_mean", "dispersion").select(*seen)])
    cover = dr.coverage(predicted, keys)
    sums = contributions.groupBy(*keys, "series", "draw").agg(F.sum("value").alias("total"))
    added = components.groupBy(*keys, WEEK).agg((F.sum("value") / replicates).alias("parts"))
    whole = dr.decomposition_check(weeks.join(added, [*keys, WEEK]), keys, "fitted", "parts")

    # evidence by refitting
    n_weeks = data.groupBy(*keys).agg(F.count_distinct(WEEK).cast("int").alias("n"))
    held = ev.holdout_folds(n_weeks, "n", burn_in).withColumn("fold", F.lit(-1))
    folds = held.unionByName(ev.expanding_splits(n_weeks, "n", cv_train, cv_horizon))
    scores = stored(dr.goodness(on_unseen_weeks(data, folds, keys, kpi, channels, controls, shapes, beliefs, burn_in), [*keys, "fold"]), "scores")
    cv = ev.cv_means(scores.where("fold >= 0"), keys)
    fake = ev.add_placebo(data, keys)
    names = [*channels, "placebo"]
    fake_base, fake_chan = prior_tables(fake, keys, kpi, names, controls, beliefs)
    fake_design = stored(cf.weekly_design(fake, keys, kpi, names, controls, shapes)[0], "placebo")
    fake_terms = stored(cf.prior_terms(fake_base, fake_chan, keys, free, names, shapes), "placebo-terms")
    fake_fit = stored(cf.fit_channels(fake_design, keys, free, names, shapes, fake_terms, burn_in), "placebo-fit")
    placebo = ev.judge_placebo(shares(cf.with_choice(fake_design, fake_fit, keys, names, len(shapes)), fake_fit, fake_terms, keys, free, names, burn_in), keys)
    wide_terms = cf.prior_terms(me.widen(base, WIDER), me.widen(chan, WIDER), keys, free, channels, shapes)
    wide_fit = stored(cf.fit_channels(design, keys, free, channels, shapes, wide_terms, burn_in), "wide-fit")
    sensitivity = stored(idn.prior_shift(shares(chosen, best, terms, keys, free, channels, burn_in),
                                         shares(cf.with_choice(design, wide_fit, keys, channels, len(shapes)), wide_fit, terms, keys, free, channels, burn_in), keys), "sensitivity")
    span = observed.groupBy(*keys).agg(F.min("actual").alias("lo"), F.max("actual").alias("hi"))
    gate = stored(ev.prior_gate(cf.prior_outcomes(design, terms, keys, free, channels, PRIOR_DRAWS, burn_in), span, keys), "prior-gate")

    residual = F.col("actual") - F.col("fitted")
    d = dr.goodness(weeks, keys).join(dr.lag1_autocorrelation(weeks.withColumn("_r", residual), keys, "_r"), keys)
    d = d.join(cover, keys).join(whole.select(*keys, F.col("ok").alias("decomposition_ok")), keys)
    d = d.join(scores.where("fold = -1").select(*keys, F.col("mape").alias("holdout_mape")), keys, "left")
    d = d.join(cv.select(*keys, F.col("n_folds").alias("cv_folds"), F.col("mean_mape").alias("cv_mape")), keys, "left")
    d = d.join(placebo.select(*keys, "placebo_share"), keys, "left").join(gate.select(*keys, F.col("passed").alias("prior_gate_ok")), keys, "left")
    d = d.join(sensitivity.groupBy(*keys).agg(F.max("shift").alias("max_prior_shift")), keys, "left").join(kinds, keys)
    # bootstrap draws are independent: as many effective samples as draws. There are no chains and no sampler, so
    # what only those can show stays NULL, and ``sampled`` says that nothing is missing there
    diagnostics = stored(d.withColumnRenamed("lag1_autocorrelation", "autocorrelation").withColumns({
        "max_r_hat": F.lit(None).cast("double"), "n_divergences": F.lit(None).cast("int"), "n_samples": F.lit(replicates), "min_ess_bulk": F.lit(float(replicates)),
        "min_ess_tail": F.lit(None).cast("double"), "min_e_bfmi": F.lit(None).cast("double"), "sampled": F.lit(False)}), "diagnostics")
    overlaps = idn.overlap(idn.prior_samples(chan, keys, replicates), params.select(*keys, "series", F.col("beta").alias("value")), [*keys, "series"])
    found = stored(idn.identifiability(dr.interval(sums, [*keys, "series"], "total"), idn.contribution_correlations(sums, keys, channels), keys,
                                       overlaps, sensitivity), "identified")
    checks = stored(vd.validity_checks(diagnostics, keys, found, results.select(*keys, "series", F.col("share_p50").alias("share"))), "checks")
    return ModelRun(best, params, contributions, expected, results, diagnostics, found, checks, vd.verdict_level(checks, keys, found), refused,
                    terms, scores, sensitivity, gate, base_log)


def plan(run: ModelRun, keys: list[str], units: DataFrame, output: str = "response_curves") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Curves, allocation of today's budget and frontier, only for panels whose verdict allows it.

    ``units``: (keys, series, unit). Channels that are not money or not told apart stay fixed.
    """
    allowed = vd.allowed_outputs(run.levels, keys).where(F.col("output") == output).select(*keys)
    params = run.params.join(allowed, keys, "left_semi")
    moving = pl.tradeable(units, run.identifiability, keys).where("can_move").select(*keys, "series")
    movable = params.join(moving, [*keys, "series"], "left_semi")
    current = movable.groupBy(*keys, "series").agg(F.max("current").alias("spend"))
    now = pl.scaled_budgets(current, keys, (1.0,))
    split = pl.allocate_smooth(pl.allocation_ranges(pl.median_params(movable, keys), now, keys), keys)
    return pl.response_curve(params, keys), split, pl.frontier(movable, current, keys, baseline_log=run.baseline_log)
