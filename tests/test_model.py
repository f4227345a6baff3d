"""The whole run over two panels: one of money, one of counts, judged with all its evidence."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from testkit import monday
from tidemark.operators import channel_fit as cf
from tidemark.plans.model import Beliefs, plan, run_model

K = ["panel"]
SHAPES = cf.shape_grid((0.5, 2.5), (0.15, 0.4))


def carried(x, half_life, l_max=12):
    w = (0.5 ** (1 / half_life)) ** np.arange(l_max)
    return np.array([sum(w[k] * x[t - k] for k in range(l_max) if t >= k) for t in range(len(x))]) / w.sum()


def panels(n=130):
    """(panel, a, b, outcome): money with noise, and counts of about twenty a week."""
    rng = np.random.default_rng(11)
    for panel in ("counts", "money"):
        a, b = (rng.gamma(1.5, 50, n) * (rng.uniform(size=n) < p) for p in (0.6, 0.4))
        effect = lambda x, h: (u := carried(x / x.max(), h)) / (0.15 + u)
        ea, eb = effect(a, 0.5), effect(b, 2.5)
        if panel == "counts":
            y = rng.poisson(np.exp(2.6 + 0.7 * ea + 0.5 * eb)).astype(float)
        else:
            y = np.rint(20_000 + 9_000 * ea + 7_000 * eb + rng.normal(0, 300, n))
        yield panel, a, b, y


@pytest.fixture(scope="module")
def run(spark):
    rows = [(p, monday(i, dt.date(2021, 1, 4)), s, r, float(v[i])) for p, a, b, y in panels()
            for s, r, v in (("a", "spend", a), ("b", "spend", b), ("orders", "kpi", y)) for i in range(len(y))]
    m = spark.createDataFrame(rows, "panel string, week_start date, series string, role string, value double")
    return run_model(m, K, "orders", ["a", "b"], [], SHAPES, 40, 4, Beliefs("orders"), cv_train=91, cv_horizon=13)


def test_the_outcome_chooses_its_likelihood(run):
    assert {r["panel"]: r["likelihood"] for r in run.terms.collect()} == {"counts": "negative_binomial", "money": "normal"}
    picked = {r["panel"]: [SHAPES[k].half_life for k in r["choice"]] for r in run.best.collect()}
    assert picked["money"] == [0.5, 2.5]


def test_attribution_adds_up_and_evidence_is_measured(run):
    for d in run.diagnostics.collect():
        assert d["decomposition_ok"] and d["cv_folds"] == 3
        assert d["r2"] > {"money": 0.9, "counts": 0.3}[d["panel"]]      # counts of about twenty are mostly noise
        for name in ("holdout_mape", "cv_mape", "placebo_share", "max_prior_shift", "coverage_94"):
            assert d[name] is not None, name
        assert d["prior_gate_ok"] is not None and d["max_r_hat"] is None and d["sampled"] is False
    shifts = {(r["panel"], r["series"]): r["shift"] for r in run.sensitivity.collect()}
    assert len(shifts) == 4 and all(0 <= v <= 1 for v in shifts.values())
    assert run.identifiability.where("overlap IS NULL OR shift IS NULL").count() == 0


def test_contributions_find_the_planted_shares(run):
    got = {(r["panel"], r["series"]): r["share_p50"] for r in run.channels.collect()}
    for panel, a, b, y in panels():
        for s, x, h, top in (("a", a, 0.5, 9_000), ("b", b, 2.5, 7_000)):
            if panel == "money":
                u = carried(x / x.max(), h)[4:]
                assert got[panel, s] == pytest.approx(top * (u / (0.15 + u)).sum() / y[4:].sum(), rel=0.3)
            else:
                assert 0.05 < got[panel, s] < 0.6


def test_missing_evidence_never_reaches_the_top(run):
    # forty draws are fewer than the effective samples asked for
    assert {r["level"] for r in run.levels.collect()} <= {"statistically_valid", "technically_completed", "not_usable"}
    curves, split, front = plan(run, K, run.channels.select("panel", "series", F.lit("currency").alias("unit")), "channel_contributions")
    allowed = run.levels.where("level = 'statistically_valid'").count()
    assert curves.select("panel").distinct().count() == allowed
    for r in split.groupBy("panel").agg(F.sum("spend").alias("s"), F.max("feasible").alias("f")).collect():
        assert r["s"] == pytest.approx(r["f"], rel=1e-6)
    assert front.count() in (0, 6, 12)
