"""Derived weekly features. Each returns a new control series or a Column over the weekly form.

Every result ends as a finite number: undefined becomes 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import fixed_values as fx
from tidemark.frames import WEEK, finite, series_window, whole_series
from tidemark.functions.dates import iso_week, week_start
from tidemark.types import Feature, issue_frame


def clean(c: Column) -> Column:
    return F.coalesce(finite(c.cast("double")), F.lit(0.0))


def lag(keys: list[str], n: int, v: str = "value") -> Column:
    return F.coalesce(F.lag(v, n).over(series_window(keys)), F.lit(0.0))


def rolling_mean(keys: list[str], n: int, v: str = "value") -> Column:
    return clean(F.avg(v).over(series_window(keys).rowsBetween(-(n - 1), 0)))


def rolling_sum(keys: list[str], n: int, v: str = "value") -> Column:
    return clean(F.sum(v).over(series_window(keys).rowsBetween(-(n - 1), 0)))


def diff(keys: list[str], n: int, v: str = "value") -> Column:
    return clean(F.col(v) - F.lag(v, n).over(series_window(keys)))


def log1p(v: str = "value") -> Column:
    """Sign-preserving, so series with negative values keep their order."""
    return clean(F.signum(v) * F.log1p(F.abs(v)))


def zscore(keys: list[str], v: str = "value") -> Column:
    w = whole_series(keys)
    sd = F.stddev_pop(v).over(w)
    return clean(F.when(sd > 0, (F.col(v) - F.avg(v).over(w)) / sd))


def winsorize(keys: list[str], lo: float = 0.01, hi: float = 0.99, v: str = "value") -> Column:
    w = whole_series(keys)
    a, b = F.percentile(v, F.lit(lo)).over(w), F.percentile(v, F.lit(hi)).over(w)
    return clean(F.when(F.col(v).isNotNull(), F.least(F.greatest(F.col(v), a), b)))


def ratio(a: Column, b: Column) -> Column:
    return clean(F.when(b != 0, a / b))


def product(*parts: Column) -> Column:
    out = F.lit(1.0)
    for p in parts:
        out = out * F.coalesce(p, F.lit(1.0))
    return clean(out)


def total(*parts: Column) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + F.coalesce(p, F.lit(0.0))
    return clean(out)


def recurring_week(weeks: list[int], week: str = WEEK) -> Column:
    return iso_week(F.col(week)).isin(*weeks).cast("double")


def date_span(weekly: DataFrame, dates: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """1 on weeks that hold any listed date of the panel."""
    weeks = dates.select(*keys, week_start(F.col(date)).alias(WEEK)).distinct().withColumn("_hit", F.lit(1.0))
    return (weekly.select(*keys, WEEK).distinct().join(weeks, [*keys, WEEK], "left")
            .select(*keys, WEEK, F.coalesce("_hit", F.lit(0.0)).alias("value")))


def row_index(keys: list[str]) -> Column:
    return (F.row_number().over(Window.partitionBy(*keys).orderBy(WEEK)) - 1).cast("double")


def fourier(t: Column, period: float = 52.0, modes: int = 2) -> dict[str, Column]:
    out = {}
    for k in range(1, modes + 1):
        angle = 2 * math.pi * k * t / period
        out[f"sin_{k}"], out[f"cos_{k}"] = F.sin(angle), F.cos(angle)
    return out


def changepoint_locations(n: int) -> list[float]:
    """n evenly spaced points in (0, 0.8]."""
    return [0.8 * (i + 1) / n for i in range(n)]


def changepoints(t_scaled: Column, n: int) -> dict[str, Column]:
    return {f"cp_{i + 1}": F.greatest(t_scaled - c, F.lit(0.0))
            for i, c in enumerate(changepoint_locations(n))}


def calendar(weekly: DataFrame, keys: list[str]) -> DataFrame:
    """One 0/1 series per fixed calendar week; varying feasts are left to event dates."""
    weeks = weekly.select(*keys, WEEK).distinct()
    named = [F.struct(F.lit(name).alias("series"), (iso_week(F.col(WEEK)) == w).cast("double").alias("value"))
             for name, w in fx.CALENDAR_WEEKS if w is not None]
    return weeks.select(*keys, WEEK, F.inline(F.array(*named)))


# --- declared features over a wide table -------------------------------------------------

ARITY = {"lag": 1, "rolling_mean": 1, "rolling_sum": 1, "diff": 1, "log1p": 1, "zscore": 1,
         "winsorize": 1, "ratio": 2, "product": None, "sum": None, "recurring_week_dummy": 0}
REQUIRED = {"lag": ("weeks",), "rolling_mean": ("window",), "rolling_sum": ("window",),
            "recurring_week_dummy": ("iso_weeks",)}


def feature_column(spec: Feature, keys: list[str]) -> Column:
    w = Window.partitionBy(*keys).orderBy(WEEK)
    whole = Window.partitionBy(*keys)
    p = {k: v for k, v in spec.params.items() if v is not None}
    cols = [F.col(c) for c in spec.inputs]
    if spec.op not in ARITY:
        raise ValueError(f"unknown feature {spec.op!r}")
    need = ARITY[spec.op]
    if (need is None and len(cols) < 2) or (need is not None and len(cols) != need):
        raise ValueError(f"{spec.op} takes {need or 'two or more'} input(s)")
    for key in REQUIRED.get(spec.op, ()):
        if not p.get(key):
            raise ValueError(f"{spec.op} needs {key!r}")
    for key in ("weeks", "window"):
        if int(p.get(key, 1)) < 1:
            raise ValueError(f"{key} must be at least 1")
    x = cols[0] if cols else None
    if spec.op == "lag":
        return clean(F.lag(x, int(p["weeks"])).over(w))
    if spec.op == "rolling_mean":
        return clean(F.avg(x).over(w.rowsBetween(1 - int(p["window"]), 0)))
    if spec.op == "rolling_sum":
        return clean(F.sum(x).over(w.rowsBetween(1 - int(p["window"]), 0)))
    if spec.op == "diff":
        return clean(x - F.lag(x, int(p.get("weeks", 1))).over(w))
    if spec.op == "log1p":
        return log1p(spec.inputs[0])
    if spec.op == "zscore":
        sd = F.stddev_pop(x).over(whole)
        return clean(F.when(sd > 0, (x - F.avg(x).over(whole)) / sd))
    if spec.op == "winsorize":
        a = F.percentile(x, F.lit(float(p.get("lower_q", 0.01)))).over(whole)
        b = F.percentile(x, F.lit(float(p.get("upper_q", 0.99)))).over(whole)
        return clean(F.when(x.isNotNull(), F.least(F.greatest(x, a), b)))
    if spec.op == "ratio":
        return ratio(*cols)
    if spec.op == "product":
        return product(*cols)
    if spec.op == "sum":
        return total(*cols)
    return recurring_week([int(x) for x in p["iso_weeks"]])


def apply_features(wide: DataFrame, specs: list[Feature], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """In order, later ones may use earlier ones; a bad one is reported and skipped."""
    notes = []
    for spec in specs:
        absent = [c for c in spec.inputs if c not in wide.columns]
        try:
            if spec.name in wide.columns:
                raise ValueError("name is taken")
            if absent:
                raise ValueError(f"missing input {absent}")
            wide = wide.withColumn(spec.name, feature_column(spec, keys))
            notes.append(("feature_added", "info", None, spec.name, None, {"op": spec.op}))
        except (KeyError, ValueError) as exc:
            notes.append(("feature_error", "error", None, spec.name, None, {"reason": str(exc)}))
    return wide, issue_frame(wide.sparkSession, notes)
