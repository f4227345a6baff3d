"""Recovery: data made from known parameters must give the known contributions back."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import evaluate as ev, fit as ft, measure as me
from testkit import monday

K = ["panel"]


def adstock(x, half_life, l_max=12):
    w = (0.5 ** (1 / half_life)) ** np.arange(l_max)
    w /= w.sum()
    return np.array([sum(w[l] * x[t - l] for l in range(l_max) if t >= l) for t in range(len(x))])


def truth(seed, n=156, half_life=2.5, half_sat=0.3, slope=1.0):
    rng = np.random.default_rng(seed)
    a, b = rng.gamma(2, 50, n), rng.gamma(2, 80, n) * (rng.uniform(size=n) < 0.6)
    h = lambda x: (x + 1e-6) / (half_sat + x + 1e-6)
    ea, eb = h(adstock(a / a.max(), half_life)), h(adstock(b / b.max(), half_life))
    t = np.arange(n)
    y = 2000 + 300 * t / n + 150 * np.sin(2 * np.pi * t / 52) + 1500 * ea + 900 * eb + rng.normal(0, 20, n)
    return a, b, y, 1500 * ea.sum(), 900 * eb.sum()


def table(spark, seeds=(1, 2)):
    rows, want = [], {}
    for s in seeds:
        a, b, y, ca, cb = truth(s)
        want[f"p{s}"] = (ca, cb)
        for i in range(len(y)):
            w = monday(i, dt.date(2020, 1, 6))
            rows += [(f"p{s}", w, "a", "spend", float(a[i])), (f"p{s}", w, "b", "spend", float(b[i])), (f"p{s}", w, "rev", "kpi", float(y[i]))]
    return spark.createDataFrame(rows, "panel string, week_start date, series string, role string, value double"), want


def test_recovers_shape_and_contributions(spark):
    m, want = table(spark)
    grid = ft.candidate_grid((0.5, 2.5, 5.0), (0.15, 0.3, 0.6))
    d, cols, free = ft.design_table(m, K, "rev", ["a", "b"], [], grid)
    d = d.persist()
    best = ft.grid_fit(d, K, cols, free, burn_in=6).persist()
    for r in best.collect():
        c = grid[r["cand"]]
        assert c.half_life == 2.5, c
    again = ft.refit(d, best, K, cols, free, burn_in=6)
    sums = d.groupBy("panel", "cand").agg(F.sum("x_a").alias("a"), F.sum("x_b").alias("b"), F.max("actual").alias("y"))
    for r in again.join(sums, ["panel", "cand"]).collect():
        ca, cb = want[r["panel"]]
        assert abs(r["coef"][cols.index("x_a")] * r["a"] * r["y"] / ca - 1) < 0.25
        assert abs(r["coef"][cols.index("x_b")] * r["b"] * r["y"] / cb - 1) < 0.25
    draws = ft.bootstrap_draws(d, best, K, cols, free, 25, burn_in=6)
    n = {r["panel"]: r["count"] for r in draws.groupBy("panel").count().collect()}
    assert n == {"p1": 25, "p2": 25}
    p = ft.predict(d, again, K, cols).where("panel='p1'")
    r2 = 1 - p.agg((F.sum((F.col("y") - F.col("mu")) ** 2) / (F.var_pop("y") * F.count("y"))).alias("e")).first()["e"]
    assert r2 > 0.9
    # an experiment with a tiny sd pulls the implied return to its value
    spend = m.where("role='spend'").groupBy("panel", "series").agg(F.sum("value").alias("total_spend")).join(
        m.where("role='kpi'").groupBy("panel").agg(F.max("value").alias("y_max")), "panel")
    tests = spend.where("series='a'").select("panel", "series", F.lit(0.5).alias("roas"), F.lit(1e-4).alias("sd"))
    pulls = ft.calibration_pulls(d, best, spend, tests, K, cols)
    cal = ft.refit(d, best, K, cols, free, pulls=pulls).join(sums, ["panel", "cand"]).join(spend.where("series='a'"), "panel")
    for r in cal.collect():
        assert abs(r["coef"][cols.index("x_a")] * r["a"] * r["y_max"] / r["total_spend"] - 0.5) < 0.02


def test_ols_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=50), rng.normal(size=50)
    y = 1 + 2 * x - 3 * z + rng.normal(0, 0.1, 50)
    df = spark.createDataFrame([("p", 1.0, float(a), float(b), float(c)) for a, b, c in zip(x, z, y)], "panel string, one double, x double, z double, y double")
    got = {r["term"]: r["coef"] for r in me.ols(df, K, ["one", "x", "z"], "y").collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(50), x, z]), y, rcond=None)[0]
    assert np.allclose([got["one"], got["x"], got["z"]], want)


def test_nonneg_solve():
    x = np.array([[1.0, 0.2], [0.3, 1.0], [1.0, 1.0]])
    b = ft.nonneg_solve(x.T @ x, x.T @ np.array([1.0, -2.0, 0.0]), 0, 0.0)
    assert b[1] == 0 and b[0] >= 0


def test_prior_share_does_not_depend_on_channel_count(spark):
    for n in (1, 4, 12):
        it = spark.createDataFrame([("p", f"c{i}", "currency", "unknown", "unknown", "unknown", "mixed") for i in range(n)],
                                   "panel string, series string, unit string, carryover string, strength string, saturation string, channel_role string")
        st = spark.createDataFrame([("p", f"c{i}", 0.4, 104, 90) for i in range(n)], "panel string, series string, median_scaled double, n_weeks int, n_active_weeks int")
        pn = spark.createDataFrame([("p", "moderate", "normal", 0.6)], "panel string, media_share string, likelihood string, kpi_median_scaled double")
        pr = me.channel_priors(it, st, pn, K)
        share = pr.agg(F.sum(F.col("beta_sigma") * me.HALF_NORMAL_MEAN / 2.3)).first()[0] / 0.6
        assert abs(share - 0.3) < 1e-9


def test_placebo_is_repeatable(spark, weekly):
    m = weekly(shift=0.0, kpi=("kpi", range(10)), tv=("spend", [4] * 10))
    one, two = ev.add_placebo(m, K), ev.add_placebo(m, K)
    pick = lambda d: sorted(r["value"] for r in d.where("series='placebo'").collect())
    assert pick(one) == pick(two) and 0 <= min(pick(one)) and max(pick(one)) <= 8
