"""Column helpers for response shapes: carry-over weights and saturation curves."""

from pyspark.sql import Column, functions as F

from tidemark import fixed_values as fx


def alpha_from_half_life(h: Column) -> Column:
    return F.pow(F.lit(0.5), 1 / F.nullif(h, F.lit(0.0)))


def half_life_from_alpha(a: Column) -> Column:
    return F.log(F.lit(0.5)) / F.nullif(F.log(a), F.lit(0.0))


def raw_weight(alpha: Column, lag: int | Column, theta: Column | None = None) -> Column:
    """Unnormalised weight of a lag: geometric, or peaked at ``theta`` weeks."""
    lag = F.lit(lag) if isinstance(lag, int) else lag
    return F.pow(alpha, lag if theta is None else F.pow(lag - theta, F.lit(2.0)))


def weights(alpha: Column, l_max: int = fx.L_MAX, theta: Column | None = None) -> list[Column]:
    raw = [raw_weight(alpha, i, theta) for i in range(l_max)]
    total = sum(raw[1:], raw[0])
    return [w / total for w in raw]


def weight_array(alpha: Column, l_max: int = fx.L_MAX, theta: Column | None = None) -> Column:
    raw = F.transform(F.sequence(F.lit(0), F.lit(l_max - 1)),
                      lambda i: raw_weight(alpha, i.cast("double"), theta))
    total = F.aggregate(raw, F.lit(0.0), lambda a, w: a + w)
    return F.transform(raw, lambda w: w / total)


def hill(x: Column, k: Column, s: Column) -> Column:
    p = F.pow(F.greatest(x, F.lit(0.0)), s)
    return p / (F.pow(k, s) + p)


def logistic(x: Column, lam: Column) -> Column:
    e = F.exp(-lam * x)
    return (1 - e) / (1 + e)


def half_point(kind: Column, k: Column, lam: Column) -> Column:
    return F.when(kind == "hill", k).when(kind == "logistic", F.log(F.lit(3.0)) / lam)


def hill_effect(u: Column, k: Column, s: Column) -> Column:
    """Model-side shape: inputs are shifted by a tiny epsilon and start exactly at 0."""
    eps = F.lit(fx.SHAPE_EPS)
    return hill(u + eps, k, s) - hill(eps, k, s)


def logistic_effect(u: Column, lam: Column) -> Column:
    return logistic(u, lam) - logistic(F.lit(0.0), lam)
