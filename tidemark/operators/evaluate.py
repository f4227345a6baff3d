"""Evaluation on unseen weeks: expanding splits, cross-validation, holdout, placebo, prior gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from tidemark import fixed_values as fx
from tidemark.frames import WEEK
from tidemark.operators.draws import goodness


def expanding_splits(panels: DataFrame, n: str, min_train: int, horizon: int, step: int | None = None) -> DataFrame:
    """Fold origins: train on the first ``train_end`` weeks, test on the next ``horizon``."""
    step = step or horizon
    origins = F.sequence(F.lit(min_train), (F.col(n) - horizon).cast("int"), F.lit(step))
    enough = F.col(n) >= min_train + horizon
    return (panels.where(enough).select(*panels.columns, F.posexplode(origins).alias("fold", "train_end"))
            .withColumn("test_end", F.col("train_end") + horizon))


def fold_weeks(weeks: DataFrame, folds: DataFrame, keys: list[str]) -> DataFrame:
    """Weeks of each fold with ``is_test``; ``weeks`` has a 0-based ``idx``."""
    j = weeks.join(folds.select(*keys, "fold", "train_end", "test_end"), keys)
    return j.where(F.col("idx") < F.col("test_end")).withColumn("is_test", F.col("idx") >= F.col("train_end"))


def cross_validate(weeks: DataFrame, folds: DataFrame, keys: list[str], fit_predict: Callable, schema: str) -> DataFrame:
    """Score a caller's model per fold: (keys, fold, r2, mape).

    ``fit_predict(pdf)`` sees one panel's fold (bounded by its weeks, with ``is_test``) and
    returns the test rows with ``actual`` and ``fitted``; ``schema`` declares them.
    """
    predicted = fold_weeks(weeks, folds, keys).groupBy(*keys, "fold").applyInPandas(fit_predict, schema)
    return goodness(predicted, [*keys, "fold"])


def cv_means(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_folds"), F.avg("r2").alias("mean_r2"), F.avg("mape").alias("mean_mape"))


def holdout_size(n):
    """A tenth of the weeks, between 4 and 13."""
    return F.least(F.greatest(F.floor(n / 10), F.lit(4)), F.lit(13)).cast("int")


def holdout_folds(panels: DataFrame, n: str, burn_in: int = 0) -> DataFrame:
    """One fold on the last weeks; panels too short to judge get none."""
    h = holdout_size(F.col(n))
    train = F.col(n) - h
    return (panels.where(train >= F.greatest(2 * h, F.lit(26 + burn_in)))
            .select(*panels.columns, F.lit(0).alias("fold"), train.cast("int").alias("train_end"), F.col(n).cast("int").alias("test_end")))


def add_placebo(master: DataFrame, keys: list[str], name: str = "placebo", seed: int = 1) -> DataFrame:
    """Add a random channel, uniform on 0 to twice the median channel mean; a hash of the week."""
    level = (master.where(F.col("role") == "spend").groupBy(*keys, "series").agg(F.avg("value").alias("_m"))
             .groupBy(*keys).agg(F.percentile("_m", F.lit(0.5)).alias("_level")))
    u = (F.pmod(F.xxhash64(F.lit(seed), *keys, WEEK), F.lit(1_000_003)) + 0.5) / 1_000_003
    weeks = master.select(*keys, WEEK).distinct().join(level, keys)
    fake = weeks.select(*keys, WEEK, F.lit(name).alias("series"), F.lit("spend").alias("role"), (u * 2 * F.col("_level")).alias("value"))
    return master.select(*keys, WEEK, "series", "role", "value").unionByName(fake)


def judge_placebo(shares: DataFrame, keys: list[str], name: str = "placebo") -> DataFrame:
    """Whether the random channel stayed below 5% of the outcome and below the middle channel."""
    mine = F.max(F.when(F.col("series") == name, F.abs("share")))
    typical = F.percentile(F.when(F.col("series") != name, F.abs("share")), F.lit(0.5))
    s = shares.groupBy(*keys).agg(mine.alias("placebo_share"), typical.alias("typical_share"))
    return s.withColumn("clean", (F.col("placebo_share") <= fx.PLACEBO_LIMIT)
                        & F.coalesce(F.col("placebo_share") < F.col("typical_share"), F.lit(True)))


def prior_gate(prior_kpi: DataFrame, observed: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Do prior draws of the outcome cover what was seen without being absurdly wide?

    ``prior_kpi``: draws in KPI units; ``observed``: (keys, lo, hi).
    """
    q = prior_kpi.groupBy(*keys).agg(F.percentile(value, F.lit(0.005)).alias("prior_lo"), F.percentile(value, F.lit(0.995)).alias("prior_hi"))
    j = q.join(observed, keys)
    covers = (F.col("prior_lo") <= F.col("lo")) & (F.col("prior_hi") >= F.col("hi"))
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9))
    sane = (F.col("prior_hi") - F.col("prior_lo")) / span <= fx.PRIOR_GATE_WIDTH
    return j.withColumn("covers", covers).withColumn("width_ok", sane).withColumn("passed", covers & sane)


def least_squares_fold(keys: list[str], columns: list[str], n_free: int, ridge: float = 1e-6) -> Callable:
    """Default model of a fold: non-negative ridge on the design columns of its training weeks."""
    from tidemark.operators.fit import nonneg_solve

    def run(pdf):
        train = pdf[~pdf["is_test"] & pdf["y"].notna()]
        test = pdf[pdf["is_test"] & pdf["y"].notna()]
        x = train[columns].to_numpy(float)
        b = nonneg_solve(x.T @ x, x.T @ train["y"].to_numpy(float), n_free, ridge)
        out = test[[*keys, "fold", WEEK]].copy()
        out["actual"], out["fitted"] = test["y"], test[columns].to_numpy(float) @ b
        return out

    return run


def fold_schema(df: DataFrame, keys: list[str]) -> str:
    ids = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)
    return f"{ids}, fold int, {WEEK} date, actual double, fitted double"
