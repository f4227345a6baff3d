"""Normal scores, counts drawn from hashes of their row, and R-hat of ranks."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from testkit import monday
from tidemark.functions import normal as nm
from tidemark.operators import draws as dr

K = ["panel"]


def test_normal_score_and_log_gamma(spark):
    p = [1e-9, 1e-4, 0.02, 0.02425, 0.1, 0.5, 0.77, 0.97575, 0.98, 1 - 1e-6]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in p], "p double").select(nm.normal_score(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(v) for v in p], rel=2e-8, abs=1e-8)
    x = [0.01, 0.5, 1.0, 1.5, 2.0, 10.0, 123.4, 1e6]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(nm.log_gamma(F.col("x"))).collect()]
    assert got == pytest.approx([math.lgamma(v) for v in x], rel=1e-11, abs=1e-11)


def numbers(spark, n, *columns):
    return spark.range(n).select(F.col("id").cast("int").alias("draw"), *columns)


@pytest.mark.parametrize("rate", [0.0, 0.3, 4.0, 9.99, 10.0, 37.5, 900.0])
def test_poisson_draws_have_their_distribution(spark, rate):
    n = 20_000
    x = np.array([r[0] for r in numbers(spark, n, F.lit(rate).alias("m")).select(nm.poisson_draw(F.col("m"), ["draw"])).collect()])
    assert (x == np.rint(x)).all() and (x >= 0).all()
    assert abs(x.mean() - rate) <= 5 * math.sqrt(rate / n) and abs(x.var() - rate) <= 0.06 * rate + 1e-12
    top = int(rate + 8 * math.sqrt(rate) + 3)
    k = np.arange(top)
    cdf = np.cumsum(np.exp(-rate + k * math.log(rate or 1.0) - [math.lgamma(v + 1) for v in k])) if rate else np.ones(top)
    seen = np.cumsum(np.bincount(x.astype(int), minlength=top)[:top]) / n
    assert np.abs(seen - cdf).max() < 1.95 / math.sqrt(n)


@pytest.mark.parametrize("shape", [0.2, 1.0, 5.0, 250.0])
def test_gamma_draws_have_their_moments(spark, shape):
    n = 20_000
    x = np.array([r[0] for r in numbers(spark, n, F.lit(shape).alias("a")).select(nm.gamma_draw(F.col("a"), ["draw"])).collect()])
    assert (x > 0).all() and abs(x.mean() - shape) < 5 * math.sqrt(shape / n)
    assert x.var() == pytest.approx(shape, rel=0.12)
    assert np.log(x).mean() == pytest.approx((math.lgamma(shape + 1e-5) - math.lgamma(shape - 1e-5)) / 2e-5, abs=0.1 / min(shape, 1.0))


def test_count_draws_do_not_depend_on_the_layout(spark):
    rows = [("p", monday(i), d, m, a) for i in range(20) for d in range(30) for m, a in ((5.0 + 40 * (i % 2), 3.0 if i % 3 else None),)]
    rows += [("q", monday(0), 0, None, 1.0), ("q", monday(1), 0, -1.0, 1.0), ("q", monday(2), 0, 3.0, 0.0), ("q", monday(3), 0, 3.0, float("inf"))]
    e = spark.createDataFrame(rows, "panel string, week_start date, draw int, mean double, disp double")
    one, many = ({(r["panel"], r["week_start"], r["draw"]): r["predicted"] for r in dr.predictive_count(e.repartition(n), K, "mean", "disp").collect()}
                 for n in (1, 50))
    assert one == many and len(one) == 604
    odd = [one["q", monday(i), 0] for i in range(4)]
    assert odd[:2] == [None, None] and odd[2] is not None and odd[3] is not None
    plain = {(r["panel"], r["week_start"], r["draw"]): r["predicted"] for r in dr.predictive_count(e, K, "mean").collect()}
    assert plain["q", monday(2), 0] == odd[2]


def by_hand(x, folded):
    """Split R-hat of rank scores; ``x`` is chains by draws."""
    x = np.abs(x - np.median(x)) if folded else x
    z = np.vectorize(NormalDist().inv_cdf)((pd.Series(x.ravel()).rank().to_numpy() - 0.375) / (x.size + 0.25)).reshape(x.shape)
    half = x.shape[1] // 2
    h = np.concatenate([z[:, :half], z[:, half:]])
    w = h.var(axis=1, ddof=1).mean()
    return math.sqrt(((half - 1) / half * w + h.mean(axis=1).var(ddof=1)) / w)


def test_rank_rhat_flags_unequal_spread(spark):
    rng = np.random.default_rng(2)
    spread = np.array([1.0, 1.0, 1.0, 6.0])[:, None]
    sets = {"good": rng.normal(size=(4, 200)), "spread": rng.normal(size=(4, 200)) * spread, "apart": rng.normal(size=(4, 200)) + np.arange(4)[:, None],
            "ties": rng.integers(0, 3, (4, 200)).astype(float), "heavy": rng.standard_cauchy((4, 200))}
    rows = [(n, c, d, float(x[c, d])) for n, x in sets.items() for c in range(4) for d in range(200)]
    rows += [("flat", c, d, 1.0) for c in range(4) for d in range(10)] + [("good", 0, 500, None)]
    got = {r["panel"]: r for r in dr.rank_rhat(spark.createDataFrame(rows, "panel string, chain int, draw int, value double"), K).collect()}
    for n, x in sets.items():
        assert got[n]["r_hat_bulk"] == pytest.approx(by_hand(x, False), rel=1e-6), n
        assert got[n]["r_hat_tail"] == pytest.approx(by_hand(x, True), rel=1e-6), n
        assert got[n]["r_hat"] == max(got[n]["r_hat_bulk"], got[n]["r_hat_tail"])
    assert got["spread"]["r_hat_bulk"] < 1.02 and got["spread"]["r_hat"] > 1.1
    assert got["good"]["r_hat"] < 1.02 and got["apart"]["r_hat_bulk"] > 1.1 and got["flat"]["r_hat"] is None
