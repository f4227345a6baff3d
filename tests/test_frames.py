"""The range-cut helpers must equal the plain window, hot keys and ties included."""

import numpy as np
from pyspark.sql import Window, functions as F

from tidemark import frames as fr


def skewed(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", int(i), float(rng.integers(0, 50)) if i % 3 else 7.0) for i in range(3000)]
    rows += [(f"k{i % 40}", int(5000 + i), float(rng.normal())) for i in range(800)]
    return spark.createDataFrame(rows, "k string, at long, v double")


def test_exact_quantiles_equal_numpy(spark):
    df = skewed(spark)
    pdf = df.toPandas()
    got = {(r["k"], r["p"]): r["q"] for r in fr.exact_quantiles(df, ["k"], "v", [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
    for (k, p), q in got.items():
        assert np.isclose(q, np.percentile(pdf[pdf.k == k].v, p * 100)), (k, p)
    assert len(got) == 41 * 5


def test_previous_and_running_total_equal_windows(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("at")
    want = df.withColumn("p", F.lag("v").over(w)).withColumn("t", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = fr.running_total(fr.previous_in_order(df, ["k"], "at", "v", "p"), ["k"], "at", F.col("v"), "t")
    a = {r["at"]: (r["p"], round(r["t"], 6)) for r in want.collect()}
    b = {r["at"]: (r["p"], round(r["t"], 6)) for r in got.collect()}
    assert a == b


def test_ties_and_null_keys_are_cut_into_ranges(spark):
    """One value of the order for all rows, and rows without a key: still several ranges, and no row is lost."""
    df = spark.range(4000).select(F.when(F.col("id") % 4 > 0, F.lit("hot")).alias("k"), F.lit(1).alias("at"), "id")
    many = df.sparkSession.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert fr._ordered_rows(df, ["k"], "at").where("k = 'hot'").select("_range").distinct().count() > 1
        got = fr.running_total(df, ["k"], "at", F.lit(1), "n").collect()
        assert sorted(r["n"] for r in got if r["k"]) == list(range(1, 3001))
        assert sorted(r["n"] for r in got if not r["k"]) == list(range(1, 1001))
        before = fr.previous_in_order(df, ["k"], "at", "id", "p").collect()
        assert sum(r["p"] is None for r in before) == 2 and len({r["p"] for r in before}) == 3999
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", many)


def test_wide_and_long(weekly):
    m = weekly(kpi=("kpi", [1, 2, None]), tv=("spend", [3, 4, 5]))
    wide = fr.to_wide(m, ["panel"], ["kpi", "tv"])
    back = fr.to_long(wide, ["panel"], {"kpi": "kpi", "tv": "spend"})
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, m.collect()), key=str)


def test_finite(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.5,), (None,)], "v double")
    assert [r[0] for r in df.select(fr.finite(F.col("v"))).collect()] == [None, None, 1.5, None]
