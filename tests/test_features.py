import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import response as rf
from tidemark.operators import features as ft, response as rs
from tidemark.types import Feature

K = ["panel"]


@pytest.fixture
def small(weekly):
    return weekly(google=("spend", range(1, 11)), meta=("spend", range(2, 12)), price=("control", np.linspace(5, 6, 10)))


def values(df, col, series="google", panel="p1"):
    return [r[col] for r in df.where(f"panel='{panel}' and series='{series}'").orderBy("week_start").collect()]


def test_windowed_features(small):
    df = small.withColumns({"l": ft.lag(K, 1), "m": ft.rolling_mean(K, 3), "s": ft.rolling_sum(K, 3), "d": ft.diff(K, 1), "z": ft.zscore(K)})
    assert values(df, "l")[:3] == [0, 1, 2] and values(df, "l", panel="p2")[1] == 101
    assert values(df, "m")[2] == 2 and values(df, "s")[2] == 6 and values(df, "d")[:2] == [0, 1]
    z = values(df, "z")
    assert abs(np.mean(z)) < 1e-12 and abs(np.std(z) - 1) < 1e-12


def test_scalar_features(spark):
    df = spark.createDataFrame([(-3.0, 0.0), (4.0, 2.0), (None, 1.0)], "a double, b double")
    r = df.select(ft.log1p("a"), ft.ratio(F.col("a"), F.col("b")), ft.product(F.col("a"), F.col("b")), ft.total(F.col("a"), F.col("b"))).collect()
    assert np.allclose(r[0], [-np.log(4), 0, 0, -3]) and np.allclose(r[1], [np.log(5), 2, 8, 6]) and np.allclose(r[2], [0, 0, 1, 1])


def test_constant_series_scores_zero(weekly):
    m = weekly(shift=0.0, c=("control", [4] * 5))
    assert values(m.withColumn("z", ft.zscore(K)), "z", "c") == [0.0] * 5


def test_declared_features(small):
    from tidemark.frames import to_wide
    wide = to_wide(small, K, ["google", "meta"])
    out, notes = ft.apply_features(wide, [Feature("g1", "lag", ("google",), {"weeks": 1}), Feature("both", "sum", ("g1", "meta")),
                                          Feature("bad", "ratio", ("google",)), Feature("meta", "log1p", ("google",))], K)
    assert [r["code"] for r in notes.collect()] == ["feature_added", "feature_added", "feature_error", "feature_error"]
    r = out.where("panel='p1'").orderBy("week_start").collect()
    assert [x["both"] for x in r[:3]] == [2.0, 4.0, 6.0]


def test_adstock_identities(weekly):
    x = [10.0] + [0.0] * 15
    m = weekly(shift=0.0, tv=("spend", x))
    geo = values(rs.geometric_adstock(m, K, F.lit(0.6)), "adstock", "tv")
    w = 0.6 ** np.arange(12)
    w /= w.sum()
    assert np.allclose(geo[:12], 10 * w) and abs(sum(geo) - 10) < 1e-9        # mass is kept
    peak = values(rs.delayed_adstock(m, K, F.lit(0.6), F.lit(2.0)), "adstock", "tv")
    assert np.argmax(peak) == 2
    steady = values(rs.geometric_adstock(weekly(shift=0.0, tv=("spend", [7.0] * 30)), K, F.lit(0.8)), "adstock", "tv")
    assert abs(steady[-1] - 7.0) < 1e-9


def test_direct_fraction(weekly):
    m = weekly(shift=0.0, tv=("spend", [10, 0]), off=("spend", [0, 0]))
    df = rs.direct_fraction(m, K, [F.lit(2 / 3), F.lit(1 / 3)])
    assert values(df, "direct_fraction", "tv") == [1.0, 0.0] and values(df, "direct_fraction", "off") == [0.0, 0.0]


def test_saturation_identities(spark):
    df = spark.range(1)
    r = df.select(rf.hill(F.lit(0.3), F.lit(0.3), F.lit(1.7)), rf.logistic(F.log(F.lit(3.0)) / 2, F.lit(2.0)), rf.hill(F.lit(-1.0), F.lit(0.3), F.lit(1.0)),
                  rf.hill_effect(F.lit(0.0), F.lit(0.3), F.lit(1.5)), rf.half_life_from_alpha(rf.alpha_from_half_life(F.lit(2.5)))).first()
    assert np.allclose(list(r), [0.5, 0.5, 0.0, 0.0, 2.5])


def test_calendar_and_changepoints(weekly):
    m = weekly(kpi=("kpi", range(53)))
    c = ft.calendar(m, K).where("panel='p1' and value=1").collect()
    assert len({r["series"] for r in c}) == 10
    assert np.allclose(ft.changepoint_locations(4), [0.2, 0.4, 0.6, 0.8])
