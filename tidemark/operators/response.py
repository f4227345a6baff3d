"""Carry-over over weekly series: convolutions, lag arrays, same-week share of the stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import fixed_values as fx
from tidemark.frames import WEEK, series_window
from tidemark.functions.response import alpha_from_half_life, raw_weight, weights


def lags(keys: list[str], l_max: int = fx.L_MAX, value: str = "value") -> list[Column]:
    """The value 0..l_max-1 weeks back, zero before the start; all share one sort."""
    w = series_window(keys)
    return [F.coalesce(F.lag(value, i).over(w) if i else F.col(value), F.lit(0.0)) for i in range(l_max)]


def convolve(x: list[Column], w: list[Column]) -> Column:
    out = x[0] * w[0]
    for a, b in zip(x[1:], w[1:]):
        out = out + a * b
    return out


def geometric_adstock(weekly: DataFrame, keys: list[str], alpha: Column, l_max: int = fx.L_MAX,
                      out: str = "adstock") -> DataFrame:
    return weekly.withColumn(out, convolve(lags(keys, l_max), weights(alpha, l_max)))


def delayed_adstock(weekly: DataFrame, keys: list[str], alpha: Column, theta: Column,
                    l_max: int = fx.L_MAX, out: str = "adstock") -> DataFrame:
    return weekly.withColumn(out, convolve(lags(keys, l_max), weights(alpha, l_max, theta)))


def lag_matrix(weekly: DataFrame, keys: list[str], l_max: int = fx.L_MAX) -> DataFrame:
    return weekly.withColumn("lags", F.array(*lags(keys, l_max)))


def direct_fraction(weekly: DataFrame, keys: list[str], w: list[Column], out: str = "direct_fraction") -> DataFrame:
    """Share of the carry-over stock that is this week's own pressure; no stock, no share."""
    x = lags(keys, len(w))
    stock = convolve(x, w)
    return weekly.withColumn(out, F.when(stock > 0, w[0] * x[0] / stock).otherwise(0.0))


def weight_table(channels: DataFrame, alpha: str, theta: str | None = None,
                 l_max: int = fx.L_MAX) -> DataFrame:
    """One row per lag with its normalised weight, for channels with their own parameters."""
    raw = [raw_weight(F.col(alpha), i, F.col(theta) if theta else None) for i in range(l_max)]
    total = sum(raw[1:], raw[0])
    rows = [F.struct(F.lit(i).alias("lag"), (w / total).alias("weight")) for i, w in enumerate(raw)]
    return channels.select(*channels.columns, F.inline(F.array(*rows)))


def decay_curve(channels: DataFrame, half_life: str, weeks: int = fx.DECAY_WEEKS) -> DataFrame:
    alpha = alpha_from_half_life(F.greatest(F.col(half_life), F.lit(fx.DECAY_MIN_HALF_LIFE)))
    lag = F.explode(F.sequence(F.lit(0), F.lit(weeks - 1)))
    raw = channels.withColumn("_alpha", alpha).withColumn("lag", lag)
    total = (1 - F.pow("_alpha", F.lit(float(weeks)))) / (1 - F.col("_alpha"))
    return raw.withColumn("share", F.pow("_alpha", F.col("lag").cast("double")) / total).drop("_alpha")


def with_week_number(weekly: DataFrame, keys: list[str]) -> DataFrame:
    """0-based position of the week in its series."""
    return weekly.withColumn("t", F.row_number().over(series_window(keys)) - 1)
