"""Shapes per channel, likelihoods and priors: planted parameters come back, solves agree with plain versions."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from testkit import monday
from tidemark.operators import channel_fit as cf, measure as me

K = ["panel"]
SHAPES = cf.shape_grid((0.5, 2.5, 5.0), (0.15, 0.3, 0.6), lams=(2.0, 6.0), thetas=(None, 2.0))
N = 156


def carried(x, half_life, theta=None, l_max=12):
    i = np.arange(l_max)
    w = (0.5 ** (1 / half_life)) ** (i if theta is None else (i - theta) ** 2)
    w = w / w.sum()
    return np.array([sum(w[k] * x[t - k] for k in range(l_max) if t >= k) for t in range(len(x))])


def hill(u, k=0.3, s=1.0):
    return (u + 1e-6) ** s / (k ** s + (u + 1e-6) ** s) - 1e-6 ** s / (k ** s + 1e-6 ** s)


def planted(seed, kind="normal"):
    """Two channels of different carry-over: a lives half a week, b five weeks."""
    rng = np.random.default_rng(seed)
    a = rng.gamma(2, 50, N) * (rng.uniform(size=N) < 0.7)
    b = rng.gamma(1, 80, N) * (rng.uniform(size=N) < 0.3)
    ea, eb = hill(carried(a / a.max(), 0.5)), hill(carried(b / b.max(), 5.0))
    t = np.arange(N)
    season = np.sin(2 * np.pi * t / 52)
    if kind in cf.COUNTS:
        mu = np.exp(3.0 + 0.2 * t / N + 0.1 * season + 1.0 * ea + 0.8 * eb)
        y = rng.poisson(mu if kind == "poisson" else rng.gamma(20.0, mu / 20.0)).astype(float)
        return a, b, y, mu
    mu = 2000 + 300 * t / N + 150 * season + 1500 * ea + 900 * eb
    return a, b, mu + rng.normal(0, 15, N), mu


def weekly(spark, rows):
    out = []
    for panel, (a, b, y, _) in rows.items():
        for i in range(len(y)):
            w = monday(i, dt.date(2020, 1, 6))
            out += [(panel, w, "a", "spend", float(a[i])), (panel, w, "b", "spend", float(b[i])), (panel, w, "rev", "kpi", float(y[i]))]
    return spark.createDataFrame(out, "panel string, week_start date, series string, role string, value double")


def fitted(spark, rows, **how):
    design, free = cf.weekly_design(weekly(spark, rows), K, "rev", ["a", "b"], [], SHAPES)
    design = design.persist()
    return design, free, cf.fit_channels(design, K, free, ["a", "b"], SHAPES, burn_in=6, **how).persist()


def test_each_channel_finds_its_own_half_life(spark):
    rows = {f"p{s}": planted(s) for s in (1, 2)}
    design, free, fit = fitted(spark, rows)
    for r in fit.collect():
        a, b = (SHAPES[k] for k in r["choice"])
        assert (a.half_life, b.half_life) == (0.5, 5.0) and a.theta is None and b.theta is None
        assert r["sigma"] * rows[r["panel"]][2].max() == pytest.approx(15, rel=0.3)
    chosen = cf.with_choice(design, fit, K, ["a", "b"], len(SHAPES))
    weeks = cf.expected_weeks(chosen, fit, K, free, ["a", "b"]).where("idx >= 6")
    for r in weeks.groupBy("panel").agg((1 - F.sum((F.col("y") - F.col("mu")) ** 2) / (F.var_pop("y") * F.count("y"))).alias("r2")).collect():
        assert r["r2"] > 0.95
    shares = chosen.groupBy("panel").agg(F.sum("x_a").alias("a"), F.sum("x_b").alias("b")).collect()
    for r in shares:
        coef = fit.where(F.col("panel") == r["panel"]).first()["coef"]
        y = rows[r["panel"]][2].max()
        for name, beta in (("a", 1500), ("b", 900)):
            x = rows[r["panel"]][0 if name == "a" else 1]
            want = beta * hill(carried(x / x.max(), 0.5 if name == "a" else 5.0)).sum()
            assert coef[len(free) + (name == "b")] * r[name] * y == pytest.approx(want, rel=0.2)


def test_all_shapes_equal_their_definition(spark):
    rows = {"p": planted(3)}
    design, _ = cf.weekly_design(weekly(spark, rows), K, "rev", ["a", "ghost", "b"], [], SHAPES)
    got = np.stack([r["effects"] for r in design.orderBy("idx").collect()]).reshape(N, 3, len(SHAPES))
    for c, x in ((0, rows["p"][0]), (2, rows["p"][1])):
        for k, s in enumerate(SHAPES):
            u = carried(x / x.max(), s.half_life, s.theta)
            want = hill(u, s.half_sat, s.slope) if s.lam is None else (1 - np.exp(-s.lam * u)) / (1 + np.exp(-s.lam * u))
            assert np.allclose(got[:, c, k], want, atol=1e-9)
    assert not got[:, 1].any()


def test_counts_are_recovered_under_a_log_link(spark):
    rows = {"nb": planted(5, "negative_binomial"), "po": planted(6, "poisson")}
    for kind in cf.COUNTS:
        design, free, fit = fitted(spark, rows, likelihood=kind)
        for r in fit.collect():
            inner = [g for g, b in zip(r["gradient"], r["coef"]) if b != 0]
            assert np.abs(inner).max() < 1e-4 * r["n_obs"]
            assert all(g <= 1e-6 for g, b in zip(r["gradient"][len(free):], r["coef"][len(free):]) if b == 0)
        chosen = cf.with_choice(design, fit, K, ["a", "b"], len(SHAPES))
        weeks = cf.expected_weeks(chosen, fit, K, free, ["a", "b"]).withColumn("fit", F.exp("mu"))
        for panel, (_, _, y, mu) in rows.items():
            got = np.array([r["fit"] for r in weeks.where(F.col("panel") == panel).orderBy("idx").collect()])
            assert np.median(np.abs(got[6:] / mu[6:] - 1)) < 0.06
    nb = fit.where("panel = 'nb'").first()
    assert nb["sigma"] is None and nb["dispersion"] == math.inf       # the last fit was Poisson


def test_outliers_do_not_move_a_student_t_fit(spark):
    a, b, y, mu = planted(7)
    bad = y.copy()
    bad[[40, 90, 130]] += [3000, -1500, 2500]
    rows = {"clean": (a, b, y, mu), "bad": (a, b, bad, mu)}
    # both are scaled by the same maximum, so that coefficients compare
    top = max(y.max(), bad.max())
    for panel in rows:
        rows[panel] = (*rows[panel][:2], np.where(np.arange(N) == 0, top, rows[panel][2]), mu)
    moved = {}
    for kind in ("normal", "student_t"):
        design, free, fit = fitted(spark, rows, likelihood=kind)
        chosen = cf.with_choice(design, fit, K, ["a", "b"], len(SHAPES))
        weeks = cf.expected_weeks(chosen, fit, K, free, ["a", "b"]).where("idx >= 6").select("panel", "idx", (F.col("mu") * F.col("y_max")).alias("f")).toPandas()
        wide = weeks.pivot(index="idx", columns="panel", values="f")
        moved[kind] = float((wide["bad"] - wide["clean"]).abs().mean())
    assert moved["student_t"] < 3 and moved["normal"] > 10 * moved["student_t"]


def panel_terms(spark, rows, free, factor=1.0, **beliefs):
    m = weekly(spark, rows)
    panel = (me.kpi_stats(m, K).join(me.trend(m, K), K).withColumns({
        "media_share": F.lit(beliefs.get("media_share")).cast("string"), "seasonality": F.lit("unknown"), "seasonal_amplitude": F.lit(0.05),
        "residual_sd": F.lit(0.02), "likelihood": F.lit(beliefs.get("likelihood", "normal"))}))
    intent = m.where("role = 'spend'").select("panel", "series").distinct().withColumns({
        "strength": F.lit("unknown"), "saturation": F.lit("unknown"), "carryover": F.lit(beliefs.get("carryover", "unknown")), "unit": F.lit("currency"),
        "channel_role": F.lit(beliefs.get("role", "mixed"))})
    base = me.baseline_priors(panel)
    chan = me.channel_priors(intent, me.channel_stats(m, K), panel.select("panel", "media_share", "likelihood", "kpi_median_scaled"), K)
    if factor != 1.0:
        base, chan = me.widen(base, factor), me.widen(chan, factor)
    return cf.prior_terms(base, chan, K, free, ["a", "b"], SHAPES)


def test_priors_bind_less_as_they_widen(spark):
    rows = {"p": planted(9)}
    m = weekly(spark, rows)
    design, free = cf.weekly_design(m, K, "rev", ["a", "b"], [], SHAPES)
    design = design.persist()
    flat = cf.fit_channels(design, K, free, ["a", "b"], SHAPES, burn_in=6).first()
    far = []
    for factor in (0.05, 1.0, 20.0):
        terms = panel_terms(spark, rows, free, factor)
        got = cf.fit_channels(design, K, free, ["a", "b"], SHAPES, terms, burn_in=6).first()
        far.append(np.abs(np.array(got["coef"]) - np.array(flat["coef"]))[len(free):].max())
        # the gradient is in units of 1 / sigma
        assert got["sigma"] * np.abs([g for g, b in zip(got["gradient"], got["coef"]) if b != 0]).max() < 1e-4
    assert far[0] > far[1] > far[2]


def test_priors_choose_the_kind_of_shape(spark):
    rows = {"p": planted(9)}
    design, free = cf.weekly_design(weekly(spark, rows), K, "rev", ["a", "b"], [], SHAPES)
    brand = cf.fit_channels(design, K, free, ["a", "b"], SHAPES, panel_terms(spark, rows, free, role="brand_building"), burn_in=6).first()
    assert all(SHAPES[k].theta == 2.0 and SHAPES[k].lam is None for k in brand["choice"])
    terms = panel_terms(spark, rows, free).first()
    assert terms["mean"][0] == pytest.approx(0.7 * np.median(rows["p"][2]) / rows["p"][2].max())
    penalty = np.array([math.nan if v is None else v for v in terms["penalty"]]).reshape(2, -1)
    allowed = [s.theta is None and s.lam is None for s in SHAPES]
    assert (np.isfinite(penalty) == np.array(allowed)).all()
    k = next(i for i, s in enumerate(SHAPES) if allowed[i] and (s.half_life, s.half_sat) == (2.5, 0.3))
    stats = me.channel_stats(weekly(spark, rows), K).where("series = 'a'").first()
    alpha, center, conc = 0.5 ** (1 / 2.5), 0.5 ** (1 / 2.5), 6.0
    want = -((center * conc - 1) * math.log(alpha) + ((1 - center) * conc - 1) * math.log(1 - alpha))
    want += (math.log(0.3) - math.log(stats["median_scaled"] * 1.3)) ** 2 / (2 * 0.9 ** 2) + math.log(0.3) - 2 * math.log(1.0) + 3.0
    assert penalty[0, k] == pytest.approx(want)


def test_draws_surround_the_fit_and_repeat(spark):
    rows = {"p1": planted(1), "p2": planted(2)}
    for kind in ("normal", "student_t", "poisson"):
        design, free, fit = fitted(spark, {"p1": planted(1, kind), "p2": planted(2, kind)} if kind == "poisson" else rows, likelihood=kind)
        chosen = cf.with_choice(design, fit, K, ["a", "b"], len(SHAPES)).persist()
        draws = lambda df: {(r["panel"], r["draw"]): tuple(r["coef"]) for r in cf.fit_draws(
            df, fit, K, free, ["a", "b"], 30, burn_in=6, likelihood=kind).collect()}
        one = draws(chosen.repartition(1))
        many = draws(chosen.repartition(7))
        assert one.keys() == many.keys() and len(one) == 60
        for k in one:
            assert np.allclose(one[k], many[k], rtol=1e-6, atol=1e-8)
        for r in fit.collect():
            c = np.array([v for (panel, _), v in one.items() if panel == r["panel"]])
            assert (c[:, len(free):] >= 0).all()
            assert np.all(np.abs(np.median(c, axis=0) - r["coef"]) <= 4 * c.std(axis=0) + 1e-6)


def test_panels_without_data_give_no_row(spark):
    rows = {"p": planted(1)}
    design, free = cf.weekly_design(weekly(spark, rows), K, "rev", ["a", "b"], [], SHAPES)
    empty = design.limit(0)
    assert cf.fit_channels(empty, K, free, ["a", "b"], SHAPES).count() == 0
    assert cf.fit_channels(design.withColumn("y", F.lit(None).cast("double")), K, free, ["a", "b"], SHAPES).count() == 0
    null_key = design.withColumn("panel", F.lit(None).cast("string"))
    assert cf.fit_channels(null_key, K, free, ["a", "b"], SHAPES, burn_in=6).count() == 1


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2 ** 32), st.integers(1, 9), st.integers(0, 4))
def test_nonnegative_solve_meets_its_conditions(seed, p, n_free):
    rng = np.random.default_rng(seed)
    n_free = min(n_free, p)
    m = rng.normal(size=(p + 3, p))
    m[:, -1] = m[:, 0] + 1e-3 * rng.normal(size=p + 3)
    a, r = m.T @ m + 1e-6 * np.eye(p), rng.normal(size=p)
    b = cf.nonnegative(a, r, n_free)
    g = a @ b - r
    assert (b[n_free:] >= 0).all() and np.abs(g[:n_free]).max(initial=0) < 1e-6
    assert (g[n_free:] > -1e-6).all() and np.abs(g[n_free:][b[n_free:] > 0]).max(initial=0) < 1e-6


def test_prior_outcomes_cover_what_their_priors_say(spark):
    rows = {"p": planted(9), "q": planted(4)}
    design, free = cf.weekly_design(weekly(spark, rows), K, "rev", ["a", "b"], [], SHAPES)
    for kind in ("normal", "student_t", "negative_binomial"):
        out = cf.prior_outcomes(design, panel_terms(spark, rows, free, likelihood=kind), K, free, ["a", "b"], draws=40, burn_in=6)
        per = out.groupBy("panel").agg(F.count("value").alias("n"), F.percentile("value", F.lit(0.5)).alias("mid")).collect()
        assert {r["n"] for r in per} == {40 * (N - 6)}
        for r in per:
            assert 0.3 < r["mid"] / np.median(rows[r["panel"]][2]) < 2.0, kind
