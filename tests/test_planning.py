import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import planning as pl, reporting as rp
from testkit import monday

K = ["panel"]


def make_params(spark, slopes=(1.0, 1.0, 1.0), draws=5):
    rows = []
    for p, scale in (("p1", 1.0), ("p2", 2.0)):
        for i, s in enumerate(slopes):
            for d in range(draws):
                rows.append((p, f"c{i}", d, (0.4 - 0.08 * i) * scale, 0.3 + 0.1 * i, s, 1000.0, 50000.0))
    return spark.createDataFrame(rows, "panel string, series string, draw int, beta double, half_sat double, slope double, x_max double, y_max double")


def value(x, i, slope, scale=1.0):
    u, k = x / 1000 + 1e-6, 0.3 + 0.1 * i
    h = lambda v: v ** slope / (k ** slope + v ** slope)
    return (0.4 - 0.08 * i) * scale * (h(u) - h(1e-6)) * 50000


def best_by_brute_force(budget, steps, slopes):
    delta = budget / steps
    top = [min(steps, int(1200 / delta + 1e-9)) for _ in slopes]
    return max(sum(value(k * delta, i, s) for i, (k, s) in enumerate(zip(ks, slopes)))
               for ks in itertools.product(*[range(t + 1) for t in top]) if sum(ks) <= steps)


@pytest.mark.parametrize("slopes,exact_only", [((1.0, 1.0, 1.0), False), ((2.5, 1.0, 2.0), True)])
def test_allocators_match_brute_force(spark, slopes, exact_only):
    steps, budget = 20, 1500.0
    p = make_params(spark, slopes)
    b = spark.createDataFrame([("p1", "s", budget), ("p2", "s", budget)], "panel string, scenario string, budget double")
    rg = pl.allocation_ranges(pl.median_params(p, K), b, K, None, steps)
    want = best_by_brute_force(budget, steps, slopes)
    outs = [pl.allocate_exact(rg, K)] + ([] if exact_only else [pl.allocate(rg, K)])
    for out in outs:
        got = {r["series"]: r["spend"] for r in out.where("panel='p1'").collect()}
        total = sum(value(got[f"c{i}"], i, s) for i, s in enumerate(slopes))
        assert np.isclose(total, want, rtol=1e-9)
        assert sum(got.values()) <= budget + 1e-6 and max(got.values()) <= 1200 + 1e-6


def test_budget_is_clipped_and_floors_hold(spark):
    p = make_params(spark)
    b = spark.createDataFrame([("p1", "big", 9000.0), ("p1", "small", 500.0)], "panel string, scenario string, budget double")
    lim = spark.createDataFrame([("p1", "c2", 200.0, None)], "panel string, series string, min_spend double, max_spend double")
    out = pl.allocate(pl.allocation_ranges(pl.median_params(p, K).where("panel='p1'"), b, K, lim, 50), K).collect()
    big = {r["series"]: r for r in out if r["scenario"] == "big"}
    assert np.isclose(big["c0"]["feasible"], 3600) and all(r["at_cap"] for r in big.values())
    assert next(r["spend"] for r in out if r["scenario"] == "small" and r["series"] == "c2") >= 200


@pytest.mark.parametrize("steps", [7, 60, 100])
def test_the_whole_budget_is_spent(spark, steps):
    p = make_params(spark)
    budgets = [("p1", str(x), x) for x in (10.0, 333.3, 3500.0, 3599.0, 9000.0)]
    b = spark.createDataFrame(budgets, "panel string, scenario string, budget double")
    rg = pl.allocation_ranges(pl.median_params(p, K).where("panel='p1'"), b, K, None, steps)
    for out in (pl.allocate(rg, K), *([pl.allocate_exact(rg, K)] if steps < 60 else [])):
        r = out.groupBy("scenario").agg(F.sum("spend").alias("s"), F.max("feasible").alias("f"), F.max("spend").alias("m")).collect()
        assert len(r) == 5 and all(np.isclose(x["s"], x["f"]) and x["m"] <= 1200 + 1e-6 for x in r)


def smooth_params(spark):
    """Six panels of channels that only flatten: Hill of slope 1 and below, logistic, one without effect."""
    rng = np.random.default_rng(4)
    rows = []
    for p in range(6):
        for c in range(4):
            kind = "logistic" if (p + c) % 3 == 2 else "hill"
            slope = 1.0 if (p + c) % 3 == 0 else 0.7
            beta = 0.0 if (p, c) == (5, 0) else float(rng.uniform(0.05, 0.6))
            rows.append((f"p{p}", f"c{c}", beta, float(rng.uniform(0.1, 1.0)), slope, float(rng.uniform(1, 6)), kind, float(rng.uniform(200, 2000)), 50000.0))
    return spark.createDataFrame(rows, "panel string, series string, beta double, half_sat double, slope double, lam double, saturation string, x_max double, y_max double")


def test_smooth_allocation_beats_every_grid(spark):
    p = smooth_params(spark).persist()
    budgets = [(f"p{i}", s, b) for i in range(6) for s, b in (("tiny", 3.0), ("some", 700.0), ("much", 3000.0), ("all", 1e6))]
    b = spark.createDataFrame(budgets, "panel string, scenario string, budget double")
    limits = spark.createDataFrame([(f"p{i}", "c1", 50.0, 300.0) for i in range(3)], "panel string, series string, min_spend double, max_spend double")
    for lim in (None, limits):
        fine, coarse = (pl.allocation_ranges(p, b, K, lim, n) for n in (400, 40))

        def worth(split):
            v = F.sum(pl.own_effect(F.col("spend"), True) * F.col("y_max"))
            j = split.join(p, ["panel", "series"]).groupBy("panel", "scenario").agg(v.alias("v"), F.sum("spend").alias("s"), F.max("feasible").alias("f"))
            return {(r["panel"], r["scenario"]): r for r in j.collect()}

        smooth, greedy, exact = worth(pl.allocate_smooth(fine, K)), worth(pl.allocate(fine, K)), worth(pl.allocate_exact(coarse, K))
        assert smooth.keys() == greedy.keys() == exact.keys() and len(smooth) == 24
        for k, r in smooth.items():
            assert np.isclose(r["s"], r["f"], rtol=1e-6), k
            assert r["v"] >= max(greedy[k]["v"], exact[k]["v"]) * (1 - 1e-9), k
        bounds = pl.allocate_smooth(fine, K).join(fine.select("panel", "scenario", "series", "low", "high"), ["panel", "scenario", "series"])
        assert bounds.where("spend < low - 1e-9 OR spend > high * (1 + 1e-9)").count() == 0


def test_steep_curves_are_left_to_the_exact_allocator(spark):
    p = make_params(spark, (2.5, 1.0, 1.0))
    b = spark.createDataFrame([("p1", "s", 500.0)], "panel string, scenario string, budget double")
    assert pl.allocate_smooth(pl.allocation_ranges(pl.median_params(p, K), b, K), K).count() == 0


def test_refusals(spark):
    p = make_params(spark).where("draw = 0")
    b = spark.createDataFrame([("p1", "none", 0.0), ("p1", "below", -5.0), ("p1", "unknown", None), ("p1", "small", 100.0), ("p1", "fine", 900.0)],
                              "panel string, scenario string, budget double")
    lim = spark.createDataFrame([("p1", "c1", 1300.0, None), ("p1", "c2", 60.0, 50.0)], "panel string, series string, min_spend double, max_spend double")
    got = {(r["scenario"], r["series"], r["code"]) for r in pl.allocation_refusals(p, b, K, lim).collect()}
    names = ("none", "below", "unknown", "small", "fine")
    want = {(s, c, "minimum_above_cap") for s in names for c in ("c1", "c2")}
    want |= {(s, None, "budget_not_positive") for s in names[:3]} | {(s, None, "minimums_above_budget") for s in ("small", "fine")}
    assert got == want
    assert pl.allocation_refusals(p, b.where("scenario = 'fine'"), K).count() == 0


def test_curve_is_monotone_and_marks_extrapolation(spark):
    c = pl.response_curve(make_params(spark), K).where("panel='p1' and series='c0'").orderBy("step").collect()
    assert len(c) == 25 and c[0]["p50"] == 0 and all(a["p50"] < b["p50"] for a, b in zip(c, c[1:]))
    assert [r["extrapolated"] for r in c].count(True) == sum(r["weekly_spend"] > 1000 for r in c)


def test_marginal_matches_formula(spark):
    p = make_params(spark).withColumn("spend", F.lit(400.0))
    m = pl.marginal_return(p, K, "spend").where("panel='p1' and series='c0'").first()["p50"]
    assert np.isclose(m, (value(400.1, 0, 1.0) - value(399.9, 0, 1.0)) / 0.2)


def test_read_curve(spark):
    curve = spark.createDataFrame([("p1", 0.0, 0.0), ("p1", 10.0, 100.0), ("p1", 20.0, 120.0)], "panel string, weekly_spend double, p50 double")
    at = spark.createDataFrame([("p1", x) for x in (-5.0, 0.0, 5.0, 10.0, 15.0, 20.0, 30.0)], "panel string, s double")
    r = pl.read_curve(at, curve, K, "s").orderBy("s").collect()
    assert [x["p50"] for x in r] == [0, 0, 50, 100, 110, 120, 120]
    assert [x["outside"] for x in r] == [True, False, False, False, False, False, True]


def test_frontier_rises(spark):
    p = make_params(spark)
    cur = p.where("draw=0").select("panel", "series", F.lit(300.0).alias("spend"))
    f = pl.frontier(p, cur, K, 40).where("panel='p2'").orderBy("total_budget").collect()
    assert len(f) == 6 and all(a["p50"] < b["p50"] for a, b in zip(f, f[1:]))


def test_year_ago(spark):
    rows = [("p", monday(i), float(i)) for i in range(60)]
    rows[2] = ("p", monday(2), None)
    df = spark.createDataFrame(rows, "panel string, week_start date, value double")
    r = {x["week_start"]: x["year_ago_value"] for x in rp.year_ago(df, K).collect()}
    assert r[monday(52)] == 0.0 and r[monday(53)] == 1.0 and r[monday(54)] == 1.0 and r[monday(50)] is None


def test_waterfall_ends_at_total(spark):
    c = spark.createDataFrame([("p", "a", 5.0), ("p", "b", -2.0), ("p", "c", 7.0)], "panel string, series string, p50 double")
    b = spark.createDataFrame([("p", 10.0)], "panel string, p50 double")
    r = rp.waterfall(c, b, K).orderBy("position").collect()
    assert [(x["bar"], x["start"], x["height"]) for x in r] == [("baseline", 0, 10), ("c", 10, 7), ("a", 17, 5), ("b", 20, 2), ("total", 0, 20)]


def test_money_only_counts_money(spark):
    ch = spark.createDataFrame([("p", "a", "currency", 100.0, 1.0, 50.0, 90.0), ("p", "b", "grp", 900.0, 1.0, 10.0, 20.0)],
                               "panel string, series string, unit string, total_spend double, contribution_p3 double, contribution_p50 double, contribution_p97 double")
    t = spark.createDataFrame([("p", 200.0, 120.0)], "panel string, kpi_total double, baseline_p50 double")
    m = rp.money_kpis(ch, t, K).first()
    assert (m["total_spend"], m["marketing_p50"], m["blended_return"], m["roi_pct"], m["baseline_share_pct"]) == (100, 60, 0.6, None, 60)
