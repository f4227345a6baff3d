"""The whole build of a weekly master table as one lazy plan, with its checks beside it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidemark.frames import WEEK, stored, union_all
from tidemark.operators import quality as ql, weekly as wk


@dataclass(frozen=True)
class Master:
    """Every part is lazy; all of them read ``weekly``."""

    weekly: DataFrame
    window: DataFrame
    gappy: DataFrame
    data: DataFrame


def from_weekly(weekly: DataFrame, keys: list[str], essential: list[str]) -> Master:
    """Shared window, gap-free grid and zero spend of a weekly table that is cheap to read again."""
    window = wk.overlap_window(wk.source_spans(weekly, keys), keys, essential)
    gappy = wk.reindex_grid(weekly, window, keys)
    return Master(weekly, window, gappy, wk.impute_spend(gappy))


def weekly_master(raw: DataFrame, keys: list[str], essential: list[str], ts: str = "ts",
                  null_weeks: str = "zero") -> Master:
    """From raw rows. The scan and the one large shuffle end in the weekly table; it is stored
    so that the spans, the series list and the grid do not scan the sources again.
    """
    weekly = stored(wk.aggregate_weeks(raw, keys, ts, null_weeks), "weekly")
    return from_weekly(weekly, keys, essential)


def build_master(raw: DataFrame, keys: list[str], essential: list[str], fills: dict[str, str] | None = None,
                 events: DataFrame | None = None, null_weeks: str = "zero", predictors: list[str] | None = None) -> tuple[Master, DataFrame]:
    """Master table and its issues: fills, event dummies, then every quality rule.

    ``fills`` maps a control series to one of the six fills. ``predictors`` names the channels and controls whose
    collinearity is judged (pairs of channels that move together, variance inflation of all); without it both are left out.
    """
    fills = fills or {}
    m = weekly_master(raw, keys, essential, null_weeks=null_weeks)
    data = m.data
    for series, strategy in fills.items():
        data = wk.fill_missing(data, keys, strategy, [series])
    parts = []
    if events is not None:
        dummies = wk.event_dummies(data, events, keys)
        parts.append(_issue(wk.event_issues(dummies, data.select(*keys, "series").distinct(), keys), keys))
        data = data.unionByName(dummies.join(
            m.weekly.select(*keys, "series").distinct(), [*keys, "series"], "left_anti").select(data.columns))
    parts += [
        _issue(wk.gap_report(m.gappy, keys, list(fills)), keys, "warning"),
        _issue(wk.imputation_report(m.gappy, keys), keys, "info"),
        _issue(ql.year_end_anomalies(data, keys), keys),
        _issue(ql.outlier_weeks(data, keys, kpi=True), keys),
        _issue(ql.outlier_weeks(data, keys, kpi=False), keys),
        _issue(ql.degenerate_columns(data, keys), keys),
        _issue(ql.over_parameterised(data, keys), keys),
        _issue(wk.window_issues(m.weekly, m.window, keys, essential).withColumnRenamed("source", "series"), keys),
    ]
    if predictors and len(predictors) > 1:
        spend = data.where((F.col("role") == "spend") & F.col("series").isin(*predictors))
        parts.append(_issue(ql.near_identical(spend, keys, predictors).withColumnRenamed("a", "series"), keys))
    if predictors and len(predictors) > 2:
        parts.append(_issue(ql.multicollinearity(data, keys, predictors), keys))
    return Master(m.weekly, m.window, m.gappy, data), union_all(parts)


def _issue(df: DataFrame, keys: list[str], severity: str | None = None) -> DataFrame:
    series = F.col("series") if "series" in df.columns else F.lit(None).cast("string")
    level = F.col("severity") if "severity" in df.columns else F.lit(severity or "warning")
    return df.select(*keys, F.col("code"), level.alias("severity"), series.alias("series")).distinct()


def quality_verdict(issues: DataFrame, panels: DataFrame, keys: list[str]) -> DataFrame:
    """Verdict of every panel; one without issues is usable."""
    return (panels.select(*keys).distinct().join(wk.verdict(issues, keys), keys, "left")
            .withColumn("verdict", F.coalesce("verdict", F.lit("usable"))))
