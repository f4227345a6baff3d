"""Queries: fitting many panels, draws by bootstrap, prediction, evaluation."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.frames import WEEK, stored
from tidemark.functions.dates import week_start
from tidemark.operators import channel_fit as cf, draws as dr, evaluate as ev, fit as ft, identify as idn, measure as me, weekly as wk
from tidemark.plans.inputs import CHANNELS, CONTROLS, KEYS, MASTER_SQL, master, once, shop
from tidemark.plans.model import Beliefs, prior_tables, run_model, shares
from tidemark.plans.registry import query

GRID = ft.candidate_grid(half_lives=(0.5, 2.5), half_sats=(0.2, 0.5))
BURN_IN = 4


def prepared(spark, sf, extra=None):
    m = wk.fill_missing(master(spark, sf).data, KEYS, "ffill", CONTROLS)
    return m if extra is None else extra(m)


def design(spark, sf, channels=CHANNELS, extra=None):
    return ft.design_table(prepared(spark, sf, extra), KEYS, "revenue", channels, CONTROLS, GRID)


def fitted(spark, sf):
    d, cols, free = design(spark, sf)
    d = stored(d, "design")  # read by the choice of a shape and by the fits after it
    best = stored(ft.grid_fit(d, KEYS, cols, free, BURN_IN), "best")
    return d, cols, free, best


OVER_WEEKS = "OVER (PARTITION BY panel, series ORDER BY week_start)"
SHAPED_SQL = f"""WITH {MASTER_SQL}, x AS (SELECT panel, week_start, series, value/nullif(max(value) OVER (PARTITION BY panel, series),0) AS v FROM master WHERE role='spend'),
 l AS (SELECT panel, week_start, series, [{', '.join(f"coalesce(lag(v,{i}) {OVER_WEEKS},0)" if i else "coalesce(v,0)" for i in range(12))}] AS lags FROM x),
 c(cand, h, k) AS (VALUES {', '.join(f"({i},{c.half_life}::DOUBLE,{c.half_sat}::DOUBLE)" for i, c in enumerate(GRID))}),
 w AS (SELECT cand, k, list_transform(range(0,12), lambda i: pow(pow(0.5::DOUBLE,1/h),i)) AS raw FROM c),
 s AS (SELECT panel, week_start, series, cand, k, list_dot_product(lags, raw)/list_sum(raw) AS stock, lags[1]*raw[1]/list_sum(raw) AS own FROM l CROSS JOIN w)
 SELECT panel, week_start, series, cand, round((stock+1e-6)/(k+stock+1e-6)-1e-6/(k+1e-6),9) AS effect, round(CASE WHEN stock>0 THEN own/stock ELSE 0 END,9) AS direct FROM s"""


@query("fit_candidates", SHAPED_SQL)
def _(spark, sf):
    spend = ft.scale(master(spark, sf).data, ft.scalers(master(spark, sf).data, KEYS), KEYS).where(F.col("role") == "spend")
    return ft.shaped(spend, KEYS, GRID).withColumns({c: F.round(c, 9) for c in ("effect", "direct")})


@query("fit_grid")
def _(spark, sf):
    return fitted(spark, sf)[3]


@query("fit_bootstrap_draws")
def _(spark, sf):
    d, cols, free, best = fitted(spark, sf)
    return ft.bootstrap_draws(d, best, KEYS, cols, free, 40, burn_in=BURN_IN)


@query("fit_calibrate")
def _(spark, sf):
    d, cols, free, best = fitted(spark, sf)
    m = master(spark, sf).data
    y = m.where(F.col("role") == "kpi").groupBy("panel").agg(F.max("value").alias("y_max"))
    spend = m.where(F.col("role") == "spend").groupBy("panel", "series").agg(F.sum("value").alias("total_spend")).join(y, "panel")
    tests = spend.where(F.col("series") == "ch_a_f").select("panel", "series", F.lit(0.02).alias("roas"), F.lit(0.005).alias("sd"))
    pulls = ft.calibration_pulls(d, best, spend, tests, KEYS, cols, BURN_IN)
    return ft.refit(d, best, KEYS, cols, free, BURN_IN, pulls=pulls)


@query("predict_weeks")
def _(spark, sf):
    d, cols, free, best = fitted(spark, sf)
    draws = ft.bootstrap_draws(d, best, KEYS, cols, free, 20, burn_in=BURN_IN)
    p = ft.predict(d, draws, KEYS, cols, ["draw"])
    return dr.interval(p, ["panel", WEEK], "mu")


def one_candidate(spark, sf):
    """Design of each panel's first candidate, with the weeks of each panel."""
    d, cols, free = design(spark, sf)
    return d.where(F.col("cand") == 0), cols, free


def panel_weeks(d):
    return d.groupBy("panel").agg(F.max("n_weeks").cast("int").alias("n_weeks"))


def unseen(spark, sf, folds):
    m = prepared(spark, sf)
    weeks = m.groupBy("panel").agg(F.count_distinct(WEEK).cast("int").alias("n_weeks"))
    return dr.goodness(ft.on_unseen_weeks(m, folds(weeks), KEYS, "revenue", CHANNELS, CONTROLS, GRID, BURN_IN), ["panel", "fold"])


@query("ev_cv")
def _(spark, sf):
    return ev.cv_means(unseen(spark, sf, lambda w: ev.expanding_splits(w, "n_weeks", 156, 52)), KEYS)


@query("ev_holdout")
def _(spark, sf):
    return unseen(spark, sf, lambda w: ev.holdout_folds(w, "n_weeks", BURN_IN)).select("panel", F.col("mape").alias("holdout_mape"))


@query("ev_placebo_add")
def _(spark, sf):
    return ev.add_placebo(master(spark, sf).data, KEYS)


@query("ev_placebo_refit")
def _(spark, sf):
    """Refit with the random channel and judge the share it is given."""
    m = ev.add_placebo(prepared(spark, sf), KEYS)
    return ev.judge_placebo(ft.placebo_shares(m, KEYS, "revenue", CHANNELS, CONTROLS, GRID, BURN_IN), KEYS)


@query("udf_fit_predict")
def _(spark, sf):
    """A caller's own model: the mean of the last year of training weeks."""
    def last_year(pdf):
        train, test = pdf[~pdf["is_test"]], pdf[pdf["is_test"]]
        out = test[["panel", "fold", WEEK]].copy()
        out["actual"], out["fitted"] = test["y"], np.nanmean(train.sort_values("idx")["y"].to_numpy(float)[-52:])
        return out

    d, _cols, _free = one_candidate(spark, sf)
    folds = ev.expanding_splits(panel_weeks(d), "n_weeks", 156, 52)
    return ev.cross_validate(d, folds, KEYS, last_year, ev.fold_schema(d, KEYS))


# --- a shape of its own per channel, likelihoods, priors -------------------------------------------

SHAPES = cf.shape_grid((0.5, 1.5, 4.0), (0.15, 0.4, 1.0), lams=(1.5, 4.0))
SHAPES_SQL = f"""WITH {MASTER_SQL}, x AS (SELECT panel, week_start, series, value/nullif(max(value) OVER (PARTITION BY panel, series),0) AS v FROM master WHERE role='spend'),
 l AS (SELECT panel, week_start, series, [{', '.join(f"coalesce(lag(v,{i}) {OVER_WEEKS},0)" if i else "coalesce(v,0)" for i in range(12))}] AS lags FROM x),
 c(shape, h, k, lam) AS (VALUES {', '.join(f"({i},{c.half_life}::DOUBLE,{c.half_sat or 'NULL'}::DOUBLE,{c.lam or 'NULL'}::DOUBLE)" for i, c in enumerate(SHAPES))}),
 w AS (SELECT shape, k, lam, list_transform(range(0,12), lambda i: pow(pow(0.5::DOUBLE,1/h),i)) AS raw FROM c),
 s AS (SELECT panel, week_start, series, shape, k, lam, list_dot_product(lags, raw)/list_sum(raw) AS stock FROM l CROSS JOIN w)
 SELECT panel, week_start, series, CAST(shape AS INTEGER) AS shape, round(CASE WHEN lam IS NULL THEN (stock+1e-6)/(k+stock+1e-6)-1e-6/(k+1e-6) ELSE (1-exp(-lam*stock))/(1+exp(-lam*stock)) END,9) AS effect FROM s"""


@query("fit_dictionary", SHAPES_SQL)
def _(spark, sf):
    """Every channel through every shape, one row each."""
    m = master(spark, sf).data
    spend = ft.scale(m, ft.scalers(m, KEYS), KEYS).where(F.col("role") == "spend")
    return (cf.shape_effects(spend, KEYS, SHAPES).select("panel", WEEK, "series", F.posexplode("effects").alias("shape", "effect"))
            .withColumn("effect", F.round("effect", 9) + F.lit(0.0)))


def shaped_fit(spark, sf, kind="normal", kpi="revenue", m=None):
    """(design, free terms, prior terms, fit) of the test panels, every channel with its own shape."""
    m = prepared(spark, sf) if m is None else m
    design, free = cf.weekly_design(m, KEYS, kpi, CHANNELS, CONTROLS, SHAPES)
    design = stored(design, "design")
    base, chan = prior_tables(m, KEYS, kpi, CHANNELS, CONTROLS, Beliefs(likelihood=kind))
    terms = stored(cf.prior_terms(base, chan, KEYS, free, CHANNELS, SHAPES), "terms")
    return design, free, terms, stored(cf.fit_channels(design, KEYS, free, CHANNELS, SHAPES, terms, BURN_IN), "fit")


def order_counts(spark, sf):
    """The master with the number of orders as its outcome."""
    counts = (shop(spark, sf).groupBy("panel", week_start("ts").alias(WEEK)).agg(F.count(F.lit(1)).cast("double").alias("value"))
              .select("panel", WEEK, F.lit("orders").alias("series"), F.lit("kpi").alias("role"), "value"))
    m = prepared(spark, sf)
    weeks = m.where(F.col("series") == "revenue").select("panel", WEEK)
    found = weeks.join(counts, ["panel", WEEK], "left").withColumns({"series": F.lit("orders"), "role": F.lit("kpi"), "value": F.coalesce("value", F.lit(0.0))})
    return m.where(F.col("role") != "kpi").select("panel", WEEK, "series", "role", "value").unionByName(found.select("panel", WEEK, "series", "role", "value"))


FREE = ["one", "t", "sin_1", "cos_1", *[f"z_{c}" for c in CONTROLS]]


def gradients(fit, free):
    """Per free term, the log posterior's gradient over what one observation may add to it."""
    rows = F.arrays_zip(F.array(*[F.lit(f) for f in free]).alias("term"), F.slice("gradient", 1, len(free)).alias("g"))
    unit = F.coalesce("sigma", F.lit(1.0)) / F.col("n_obs")
    return fit.select("panel", F.explode(rows).alias("r"), unit.alias("u")).select(
        "panel", F.col("r.term").alias("term"), (F.round(F.abs(F.col("r.g") * F.col("u")), 5)).alias("gradient"))


def gradient_sql(free):
    return f"WITH {MASTER_SQL} SELECT DISTINCT panel, unnest(['{chr(39).join(free).replace(chr(39), chr(39) + ',' + chr(39))}']) AS term, 0.0::DOUBLE AS gradient FROM master"


@query("fit_count_gradient", gradient_sql(FREE))
def _(spark, sf):
    """At the best count fit under a log link, nothing is left to climb for the free terms."""
    _design, free, _terms, fit = shaped_fit(spark, sf, "negative_binomial", "orders", order_counts(spark, sf))
    return gradients(fit, free)


@query("fit_student_t_gradient", gradient_sql(FREE))
def _(spark, sf):
    _design, free, _terms, fit = shaped_fit(spark, sf, "student_t")
    return gradients(fit, free)


@query("fit_shapes")
def _(spark, sf):
    """Each channel's shape and effect."""
    _design, free, _terms, fit = shaped_fit(spark, sf)
    facts = F.array(*[F.struct(F.lit(s.half_life).alias("half_life"), F.lit(s.half_sat).cast("double").alias("half_sat"), F.lit(s.lam).cast("double").alias("lam"))
                      for s in SHAPES])
    rows = F.array(*[F.struct(F.lit(c).alias("series"), F.get(facts, F.get("choice", F.lit(i))).alias("shape"), F.get("coef", F.lit(len(free) + i)).alias("beta"))
                     for i, c in enumerate(CHANNELS)])
    return fit.select("panel", F.inline(rows)).select("panel", "series", "shape.*", "beta")


@query("fit_shape_draws")
def _(spark, sf):
    """Draws of the coefficients at each channel's own shape."""
    design, free, terms, fit = shaped_fit(spark, sf)
    chosen = cf.with_choice(design, fit, KEYS, CHANNELS, len(SHAPES))
    return cf.fit_draws(chosen, fit, KEYS, free, CHANNELS, 40, terms, BURN_IN)


@query("fit_prior_sensitivity")
def _(spark, sf):
    """How far each channel's share moves when the priors are twice as wide."""
    m = prepared(spark, sf)
    design, free, terms, fit = shaped_fit(spark, sf)
    base, chan = prior_tables(m, KEYS, "revenue", CHANNELS, CONTROLS, Beliefs(likelihood="normal"))
    wide = cf.prior_terms(me.widen(base), me.widen(chan), KEYS, free, CHANNELS, SHAPES)
    again = stored(cf.fit_channels(design, KEYS, free, CHANNELS, SHAPES, wide, BURN_IN), "wide")
    of = [shares(cf.with_choice(design, f, KEYS, CHANNELS, len(SHAPES)), f, terms, KEYS, free, CHANNELS, BURN_IN) for f in (fit, again)]
    return idn.prior_shift(of[0], of[1], KEYS)


@query("ev_prior_predictive")
def _(spark, sf):
    """Do the priors alone imply outcomes that hold what was seen?"""
    design, free, terms, _fit = shaped_fit(spark, sf)
    seen = design.where(F.col("idx") >= BURN_IN).groupBy(*KEYS).agg(F.min("actual").alias("lo"), F.max("actual").alias("hi"))
    return ev.prior_gate(cf.prior_outcomes(design, terms, KEYS, free, CHANNELS, 60, BURN_IN), seen, KEYS)


def whole_run(spark, sf):
    """The whole run on the test panels; its tables are stored, and the queries below read them."""
    return once(spark, sf, "run", lambda: run_model(prepared(spark, sf), KEYS, "revenue", CHANNELS, CONTROLS, SHAPES, 40, BURN_IN, cv_train=156, cv_horizon=52))


@query("model_verdict")
def _(spark, sf):
    """The whole run: priors, fit, draws, attribution, evidence, diagnostics, verdict per market."""
    run = whole_run(spark, sf)
    return run.levels.join(run.diagnostics, KEYS)


@query("model_channels")
def _(spark, sf):
    run = whole_run(spark, sf)
    return run.channels.join(run.identifiability, ["panel", "series"])


@query("model_counts")
def _(spark, sf):
    """The whole run with the number of orders as outcome: a count likelihood under a log link."""
    run = once(spark, sf, "count-run", lambda: run_model(order_counts(spark, sf), KEYS, "orders", CHANNELS, CONTROLS, SHAPES, 20, BURN_IN,
                                                         Beliefs("orders"), cv_train=156, cv_horizon=52))
    return run.diagnostics.join(run.levels, KEYS)
