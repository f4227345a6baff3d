import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import draws as dr, evaluate as ev, identify as idn, verdict as vd
from testkit import monday

R = ["run"]
HEALTHY = dict(run="r", max_r_hat=1.0, n_divergences=0, n_samples=1000, min_ess_bulk=900.0, min_ess_tail=850.0, min_e_bfmi=0.9,
               decomposition_ok=True, r2=0.85, coverage_94=0.94, coverage_80=0.81, coverage_50=0.52, mape=0.08, autocorrelation=0.05,
               holdout_mape=0.1, placebo_share=0.01)
SCHEMA = ("run string, max_r_hat double, n_divergences bigint, n_samples bigint, min_ess_bulk double, min_ess_tail double, min_e_bfmi double, "
          "decomposition_ok boolean, r2 double, coverage_94 double, coverage_80 double, coverage_50 double, mape double, autocorrelation double, "
          "holdout_mape double, placebo_share double")
CASES = [
    ({}, "usable_for_decisions", None), ({"max_r_hat": 1.2}, "not_usable", "converged"), ({"max_r_hat": 1.07}, "statistically_valid", "convergence_tight"),
    ({"n_divergences": 30}, "not_usable", "few_divergences"), ({"n_divergences": 5}, "statistically_valid", "some_divergences"),
    ({"min_ess_bulk": 100.0}, "statistically_valid", "enough_effective_samples"), ({"min_ess_tail": 100.0}, "statistically_valid", "enough_tail_samples"),
    ({"min_e_bfmi": 0.1}, "statistically_valid", "energy_ok"), ({"decomposition_ok": False}, "not_usable", "decomposition_adds_up"),
    ({"r2": 0.2}, "not_usable", "explains_the_data"), ({"r2": 0.4}, "technically_completed", "explains_the_data_weakly"),
    ({"coverage_50": 0.8}, "technically_completed", "uncertainty_is_calibrated"), ({"mape": 0.4}, "technically_completed", "prediction_error_ok"),
    ({"autocorrelation": -0.6}, "technically_completed", "no_leftover_structure"), ({"holdout_mape": 0.5}, "statistically_valid", "generalises"),
    ({"holdout_mape": None}, "statistically_valid", None), ({"placebo_share": 0.06}, "not_usable", "placebo_clean"),
    ({"placebo_share": 0.04}, "not_usable", "placebo_clean"),
]


def test_verdict_ladder(spark):
    rows, ch = [], []
    for i, (change, _, _) in enumerate(CASES):
        rows.append(tuple({**HEALTHY, **change, "run": str(i)}.values()))
        ch += [(str(i), "a", "identified", 0.03), (str(i), "b", "identified", 0.2), (str(i), "c", "identified", 0.03)]
    d = spark.createDataFrame(rows, SCHEMA)
    c = spark.createDataFrame(ch, "run string, series string, verdict string, share double")
    checks = vd.validity_checks(d, R, c, c)
    failed = {}
    for r in checks.where("not passed").collect():
        failed.setdefault(r["run"], set()).add(r["code"])
    levels = {r["run"]: r["level"] for r in vd.verdict_level(checks, R, c).collect()}
    for i, (_, level, code) in enumerate(CASES):
        assert levels[str(i)] == level, CASES[i]
        assert failed.get(str(i), set()) == ({code} if code else set()), CASES[i]


def test_unusable_channels(spark):
    d = spark.createDataFrame([tuple({**HEALTHY, "run": r}.values()) for r in "xyz"], SCHEMA)
    c = spark.createDataFrame([("x", "a", "not_identified"), ("x", "b", "identified"), ("y", "a", "not_identified")], "run string, series string, verdict string")
    levels = {r["run"]: r["level"] for r in vd.verdict_level(vd.validity_checks(d, R, c), R, c).collect()}
    assert levels == {"x": "usable_for_decisions", "y": "not_usable", "z": "statistically_valid"}
    out = {r["output"] for r in vd.allowed_outputs(vd.verdict_level(vd.validity_checks(d, R, c), R, c), R).where("run='y'").collect()}
    assert out == {"diagnostics"}


def pair(spark, n=400):
    rng = np.random.default_rng(2)
    s = rng.normal(100, 20, n)
    rows = []
    for i in range(n):
        rows += [("r", "a", i, s[i] + rng.normal()), ("r", "b", i, 200 - s[i] + rng.normal()), ("r", "c", i, 50 + rng.normal())]
    return spark.createDataFrame([(r, c, i, float(v)) for r, c, i, v in rows], "run string, series string, draw int, total double")


def test_traded_off_pair_is_one_group(spark):
    t = pair(spark)
    corr = idn.contribution_correlations(t, R, ["a", "b", "c"])
    assert next(r["r"] for r in corr.collect() if (r["a"], r["b"]) == ("a", "b")) < -0.99
    groups = {r["series"]: r["group_label"] for r in idn.inseparable_groups(corr, R).collect()}
    assert groups == {"a": "a", "b": "a"}
    v = {r["series"]: r for r in idn.identifiability(dr.interval(t, ["run", "series"], "total"), corr, R).collect()}
    assert v["a"]["verdict"] == "not_identified" and v["a"]["reasons"] == "correlated" and v["c"]["verdict"] == "identified"


def test_long_chain_is_one_component(spark):
    n = 40
    c = spark.createDataFrame([("r", f"n{i:02d}", f"n{i + 1:02d}", 0.9) for i in range(n)] + [("r", "x", "y", 0.9), ("r", "y", "z", 0.1)], "run string, a string, b string, r double")
    g = {r["series"]: r["group_label"] for r in idn.inseparable_groups(c, R).collect()}
    assert {v for k, v in g.items() if k.startswith("n")} == {"n00"} and g["y"] == "x" and "z" not in g


def test_overlap_bounds(spark):
    a = spark.createDataFrame([("r", float(i)) for i in range(100)], "run string, value double")
    assert abs(idn.overlap(a, a, R).first()["overlap"] - 1) < 1e-12
    far = a.withColumn("value", F.col("value") + 1000)
    assert idn.overlap(a, far, R).first()["overlap"] == 0


def test_attribution_adds_up(spark):
    rows = [("r", monday(w), d, 0.1 * w + 0.01 * d + 0.5) for w in range(4) for d in range(5)]
    e = spark.createDataFrame(rows, "run string, week_start date, draw int, mu double").withColumn("y_max", F.lit(10.0))
    c = e.select("run", "week_start", "draw", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("series")).withColumn("contrib", F.lit(0.05)).withColumn("y_max", F.lit(10.0))
    total = lambda df: {(r["week_start"], r["draw"]): r["s"] for r in df.groupBy("week_start", "draw").agg(F.sum("value").alias("s")).collect()}
    add, cnt = total(dr.attribute_additive(e, c, R)), total(dr.attribute_count(e, c, R))
    for r in e.collect():
        assert math.isclose(add[(r["week_start"], r["draw"])], r["mu"] * 10) and math.isclose(cnt[(r["week_start"], r["draw"])], math.exp(r["mu"]))


def test_goodness_and_autocorrelation(spark):
    y, f = [1.0, 2.0, 4.0, 0.0], [1.5, 2.0, 3.0, 0.5]
    w = spark.createDataFrame([("r", monday(i), a, b) for i, (a, b) in enumerate(zip(y, f))], "run string, week_start date, actual double, fitted double")
    g = dr.goodness(w, R).first()
    e = np.array(y) - np.array(f)
    assert math.isclose(g["r2"], 1 - (e @ e) / np.sum((np.array(y) - np.mean(y)) ** 2)) and math.isclose(g["mape"], (0.5 + 0 + 0.25) / 3)
    c = e - e.mean()
    r = dr.lag1_autocorrelation(w.withColumn("e", F.col("actual") - F.col("fitted")), R, "e").first()["lag1_autocorrelation"]
    assert math.isclose(r, (c[:-1] @ c[1:]) / (c @ c))


def test_rhat_and_ess(spark):
    rng = np.random.default_rng(0)
    good = [("good", ch, i, float(v)) for ch in range(4) for i, v in enumerate(rng.normal(size=200))]
    bad = [("bad", ch, i, float(v + 3 * ch)) for ch in range(4) for i, v in enumerate(rng.normal(size=200))]
    walk = [("walk", ch, i, float(v)) for ch in range(4) for i, v in enumerate(np.cumsum(rng.normal(size=200)))]
    s = spark.createDataFrame(good + bad + walk, "run string, chain int, draw int, value double")
    r = {x["run"]: x["r_hat"] for x in dr.split_rhat(s, R).collect()}
    assert r["good"] < 1.05 < 1.5 < r["bad"]
    n = {x["run"]: x["ess"] for x in dr.effective_samples(s, R).collect()}
    assert n["good"] > 400 and n["walk"] < 100


def test_ess_sees_long_correlation(spark):
    """AR(1) with 0.99: the true number is draws * 0.01 / 1.99, about 40."""
    rng, rows = np.random.default_rng(4), []
    for ch in range(4):
        v = rng.normal() * 7
        for i in range(2000):
            v = 0.99 * v + rng.normal()
            rows.append(("ar", ch, i, float(v)))
    rows += [("flat", ch, i, 1.0) for ch in range(4) for i in range(10)]
    n = {x["run"]: x for x in dr.effective_samples(spark.createDataFrame(rows, "run string, chain int, draw int, value double"), R).collect()}
    assert 15 < n["ar"]["ess"] < 100 and 15 < n["ar"]["ess_bulk"] < 100 and n["ar"]["ess_tail"] < 400
    assert n["flat"]["ess"] is None and n["flat"]["ess_tail"] is None


def test_predictive_noise_has_its_distribution(spark):
    e = spark.range(40_000).selectExpr("'a' run", "date'2024-01-01' week_start", "cast(id as int) draw", "20.0 mu", "1.0 y_max", "1.0 s", "5.0 disp")
    t = [r[0] - 20 for r in dr.predictive_t(e, R, "s", "y_max", 4.0).select("predicted").collect()]
    assert abs(np.mean(t)) < 0.05 and abs(np.percentile(t, 97.5) - 2.776) < 0.15
    for disp, var in ((None, 20.0), ("disp", 20 + 400 / 5)):
        df = dr.predictive_count(e, R, "mu", disp)
        got = [r[0] for r in df.select("predicted").collect()]
        assert abs(np.mean(got) - 20) < 0.3 and abs(np.var(got) / var - 1) < 0.08
        assert got == [r[0] for r in df.select("predicted").collect()]


def test_splits_and_holdout(spark):
    p = spark.createDataFrame([("a", 100), ("b", 20)], "run string, n int")
    f = ev.expanding_splits(p, "n", 52, 13).collect()
    assert [(r["fold"], r["train_end"], r["test_end"]) for r in f] == [(0, 52, 65), (1, 65, 78), (2, 78, 91)]
    h = ev.holdout_folds(p, "n", 4).collect()
    assert [(r["run"], r["train_end"], r["test_end"]) for r in h] == [("a", 90, 100)]


def test_constant_columns_do_not_fail_in_ansi_mode(spark, weekly):
    from tidemark.frames import to_wide
    from tidemark.operators import measure as me, quality as ql
    t = spark.createDataFrame([("r", c, i, v) for i in range(5) for c, v in (("a", 1.0), ("b", float(i)))], "run string, series string, draw int, total double")
    assert idn.contribution_correlations(t, R, ["a", "b"]).first()["r"] == 0.0
    m = weekly(shift=0.0, a=("spend", [0] * 6), b=("spend", range(6)), kpi=("kpi", [0] * 6))
    assert ql.column_pairs(to_wide(m, ["panel"], ["a", "b"]), ["panel"], ["a", "b"], 0.0).count() == 0
    assert me.kpi_stats(m, ["panel"]).first()["refused"] == "no_positive_values"
    assert me.trend(m, ["panel"]).first()["trend_slope"] is None
