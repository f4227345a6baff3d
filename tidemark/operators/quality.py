"""Quality rules on the weekly table. Each returns issue rows, at least (keys, code, severity)."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import fixed_values as fx
from tidemark.frames import WEEK, correlation, literal_frame, series_window, to_wide, union_all, whole_series
from tidemark.functions.dates import iso_week, week_start
from tidemark.operators.weekly import median_day_gap


def duplicate_dates(raw: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """Dates that carry more than one distinct row; rows of ``weekly.different_rows`` are distinct already, those of
    ``weekly.rows_per_day`` counted."""
    distinct = raw if "_copies" in raw.columns else raw.select(*columns).distinct()
    rows = F.sum("_rows") if "_rows" in raw.columns else F.count(F.lit(1))
    per_day = (distinct.groupBy(*keys, F.to_date(ts).alias("day")).agg(rows.alias("rows"))
               .where(F.col("rows") > 1))
    return (per_day.groupBy(*keys).agg(F.sum("rows").alias("n_rows"), F.count(F.lit(1)).alias("n_dates"))
            .withColumn("code", F.lit("duplicate_dates_aggregated")).withColumn("severity", F.lit("warning")))


def partial_edge_weeks(raw: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """First or last week with far fewer rows than the typical inner week."""
    rows = F.sum("_copies") if "_copies" in raw.columns else F.count(F.lit(1))
    per_week = raw.groupBy(*keys, week_start(F.col(ts)).alias(WEEK)).agg(rows.alias("rows"))
    w = Window.partitionBy(*keys)
    marked = (per_week.withColumn("first", F.col(WEEK) == F.min(WEEK).over(w))
              .withColumn("last", F.col(WEEK) == F.max(WEEK).over(w)))
    inner = F.when(~F.col("first") & ~F.col("last"), F.col("rows"))
    typical = (marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_weeks"),
                                         F.percentile(inner, F.lit(0.5)).alias("median_rows")))
    edge = marked.where(F.col("first") | F.col("last")).join(typical, keys)
    short = ((F.col("n_weeks") >= fx.EDGE_MIN_WEEKS) & (F.col("median_rows") >= fx.EDGE_MIN_MEDIAN)
             & (F.col("rows") < fx.EDGE_SHARE * F.col("median_rows")))
    return edge.where(short).select(*keys, WEEK, "rows", "median_rows",
                                    F.lit("partial_edge_week").alias("code"), F.lit("warning").alias("severity"))


def coarse_cadence(raw: DataFrame, keys: list[str], ts: str) -> DataFrame:
    g = median_day_gap(raw, keys, ts).where(F.col("median_gap") > fx.COARSE_GAP_DAYS)
    return g.select(*keys, "median_gap", (F.col("median_gap") >= fx.MONTHLY_GAP_DAYS).alias("monthly"),
                    F.lit("coarse_cadence").alias("code"), F.lit("warning").alias("severity"))


def column_pairs(wide: DataFrame, keys: list[str], columns: list[str], minimum: float,
                 sample_guard: bool = False) -> DataFrame:
    """Pearson r of every column pair in one aggregate; p columns cost p(p-1)/2 sums, no join."""
    pairs = list(combinations(columns, 2))

    usable = {c: ((F.stddev_samp(c) != 0) & (F.count(c) > 2)) if sample_guard else F.lit(True) for c in columns}
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                      F.when(usable[a] & usable[b], correlation(a, b)).alias("r"))
             for a, b in pairs]
    return (wide.groupBy(*keys).agg(F.array(*cells).alias("_p")).select(*keys, F.inline("_p"))
            .where(F.abs("r") >= minimum))


def near_identical(master: DataFrame, keys: list[str], spend: list[str],
                   minimum: float = fx.NEAR_IDENTICAL_R) -> DataFrame:
    pairs = column_pairs(to_wide(master, keys, spend), keys, spend, minimum, sample_guard=True)
    return (pairs.withColumn("code", F.lit("near_identical_channels"))
            .withColumn("severity", F.lit("warning")))


def _median(c: Column, w) -> Column:
    return F.percentile(c, F.lit(0.5)).over(w)


def global_robust_z(master: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``robust_z`` against the series median; a collapsed MAD falls back to the std."""
    w = whole_series(keys)
    centred = master.withColumn("_dev", F.col("value") - _median(F.col("value"), w))
    mad = _median(F.abs("_dev"), w) * fx.MAD_SCALE
    return (centred.withColumn("_mad", mad)
            .withColumn("_scale", F.when(F.col("_mad") > 0, F.col("_mad"))
                        .otherwise(F.stddev_pop("value").over(w)))
            .withColumn("n_values", F.count("value").over(w))
            .withColumn("robust_z", F.when(F.col("_scale") > 0, F.col("_dev") / F.col("_scale")))
            .drop("_dev", "_mad", "_scale"))


def global_outliers(master: DataFrame, keys: list[str], z: float = fx.ROBUST_Z) -> DataFrame:
    return global_robust_z(master, keys).where(F.abs("robust_z") > z)


def year_end_anomalies(master: DataFrame, keys: list[str], limit: float = fx.ROBUST_Z) -> DataFrame:
    z = global_robust_z(master.where(F.col("role") == "kpi"), keys)
    hit = (F.abs("robust_z") > limit) & (F.col("n_values") >= fx.OUTLIER_MIN_VALUES)
    turn = iso_week(F.col(WEEK)).isin(*fx.YEAR_TURN_WEEKS)
    return z.where(hit & turn).select(*keys, "series", WEEK, "value", "robust_z",
                                      F.lit("year_end_anomaly").alias("code"), F.lit("warning").alias("severity"))


def local_outliers(master: DataFrame, keys: list[str], window: int = fx.LOCAL_WINDOW,
                   z: float = fx.ROBUST_Z) -> DataFrame:
    """Adds ``is_outlier`` from a centred rolling median and the rolling median deviation."""
    half = window // 2
    enough = max(3, half)
    w = series_window(keys).rowsBetween(-half, half)

    def rolling(c: str) -> Column:
        return F.when(F.count(c).over(w) >= enough, _median(F.col(c), w))

    d = (master.withColumn("_mid", rolling("value"))
         .withColumn("_dev", F.abs(F.col("value") - F.col("_mid")))
         .withColumn("_scale", rolling("_dev") * fx.MAD_SCALE))
    hit = (F.col("_scale") > 0) & (F.col("_dev") / F.col("_scale") > z)
    return (d.withColumn("is_outlier", F.coalesce(hit, F.lit(False)))
            .withColumn("n_values", F.count("value").over(whole_series(keys)))
            .drop("_mid", "_dev", "_scale"))


def outlier_weeks(master: DataFrame, keys: list[str], kpi: bool) -> DataFrame:
    """One issue per series: the weeks and values that stand out locally."""
    role = F.col("role") == "kpi" if kpi else F.col("role").isin("spend", "control")
    flagged = local_outliers(master.where(role), keys).where(
        F.col("is_outlier") & (F.col("n_values") >= fx.OUTLIER_MIN_VALUES))
    points = F.array_sort(F.collect_list(F.struct(WEEK, "value")))
    code, severity = ("kpi_outlier_weeks", "warning") if kpi else ("predictor_outlier_weeks", "info")
    return (flagged.groupBy(*keys, "series", "role")
            .agg(F.count(F.lit(1)).alias("n"), F.min(WEEK).alias("first_week"), points.alias("points"))
            .withColumn("code", F.lit(code)).withColumn("severity", F.lit(severity)))


def vif(master: DataFrame, keys: list[str], predictors: list[str]) -> DataFrame:
    """Variance inflation per predictor.

    Spark reduces complete weeks to p(p+1)/2 product sums per panel; a task only inverts the
    p-by-p correlation matrix of one panel.
    """
    if len(predictors) < 3:
        raise ValueError("variance inflation needs three predictors")
    wide = to_wide(master, keys, predictors).dropna(subset=predictors)
    # scale first: raw products of large values lose the digits the matrix needs
    w = Window.partitionBy(*keys)
    scaled = wide
    for i, c in enumerate(predictors):
        sd = F.stddev_pop(c).over(w)
        scaled = scaled.withColumn(f"_z{i}", F.when(sd > 0, (F.col(c) - F.avg(c).over(w)) / sd))
    sums = [F.avg(F.col(f"_z{i}") * F.col(f"_z{j}")) for i in range(len(predictors))
            for j in range(i, len(predictors))]
    grams = scaled.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("r"))
    p = len(predictors)
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in master.schema if f.name in keys)
    upper = np.triu_indices(p)

    def inflate(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.itertuples(index=False):
                m = np.full((p, p), np.nan)
                m[upper] = [np.nan if x is None else x for x in rec.r]
                m = np.where(np.isnan(m), m.T, m)
                use = ~np.isnan(np.diag(m))
                if use.sum() < 3 or rec.n <= use.sum() + 1:
                    continue
                idx = np.flatnonzero(use)
                sub = m[np.ix_(idx, idx)]
                for a, i in enumerate(idx):
                    rest = np.delete(np.arange(len(idx)), a)
                    coef = np.linalg.lstsq(sub[np.ix_(rest, rest)], sub[rest, a], rcond=None)[0]
                    left = 1.0 - float(coef @ sub[rest, a])
                    value = 1.0 / left if left > 1e-12 else 1e12
                    rows.append(tuple(getattr(rec, k) for k in keys) + (predictors[i], value))
            yield pd.DataFrame(rows, columns=[*keys, "series", "vif"])

    return grams.mapInPandas(inflate, f"{key_schema}, series string, vif double")


def multicollinearity(master: DataFrame, keys: list[str], predictors: list[str]) -> DataFrame:
    return (vif(master, keys, predictors).where(F.col("vif") >= fx.VIF_LIMIT)
            .withColumn("code", F.lit("multicollinearity")).withColumn("severity", F.lit("warning")))


def degenerate_columns(master: DataFrame, keys: list[str]) -> DataFrame:
    """Negative or empty channels, 0/1 flags as spend, constant outcomes and controls."""
    v = F.col("value")
    s = master.groupBy(*keys, "series", "role").agg(
        F.count(v).alias("n"), F.count_if(v < 0).alias("n_negative"), F.min(v).alias("lo"),
        F.max(v).alias("hi"), F.count_if(v.isNotNull() & ~v.isin(0.0, 1.0)).alias("n_other"))
    spend, base = F.col("role") == "spend", F.col("role").isin("kpi", "control")
    codes = F.array_compact(F.array(
        F.when(spend & (F.col("n_negative") > 0), "negative_spend"),
        F.when(spend & F.coalesce((F.col("lo") == 0) & (F.col("hi") == 0), F.lit(True)), "all_zero_channel"),
        F.when(spend & (F.col("n") > 0) & (F.col("n_other") == 0) & (F.col("lo") < F.col("hi")),
               "binary_column_as_spend"),
        F.when(base & (F.col("n") >= 2) & (F.col("lo") == F.col("hi")), "zero_variance_column")))
    out = s.select(*keys, "series", F.explode(codes).alias("code"))
    error = F.col("code") == "binary_column_as_spend"
    return out.withColumn("severity", F.when(error, "error").otherwise("warning"))


def over_parameterised(master: DataFrame, keys: list[str]) -> DataFrame:
    n = master.groupBy(*keys).agg(
        F.count_distinct(WEEK).alias("n_weeks"),
        F.count_distinct(F.when(F.col("role") == "spend", F.col("series"))).alias("n_channels"),
        F.count_distinct(F.when(F.col("role") == "kpi", F.col("series"))).alias("n_kpi"))
    per = F.when((F.col("n_channels") > 0) & (F.col("n_kpi") > 0), F.col("n_weeks") / F.col("n_channels"))
    n = n.withColumn("weeks_per_channel", per)
    severity = (F.when(F.col("weeks_per_channel") < fx.WEEKS_PER_CHANNEL_ERROR, "error")
                .when(F.col("weeks_per_channel") < fx.WEEKS_PER_CHANNEL_WARN, "warning"))
    return (n.withColumn("severity", severity).where(F.col("severity").isNotNull()).drop("n_kpi")
            .withColumn("code", F.lit("too_many_parameters")))


def explain_issues(issues: DataFrame) -> DataFrame:
    """Attach the explanation and the action of each code; unknown codes keep NULL."""
    rows = [(code, text, action) for code, (_, text, action) in fx.ISSUE_INFO.items()]
    info = literal_frame(issues.sparkSession, rows, "code string, explanation string, action string")
    return issues.join(info, "code", "left")


def collect_issues(parts: list[DataFrame]) -> DataFrame:
    """All checks as one table, in the order given."""
    tagged = [p.withColumn("check_no", F.lit(i)) for i, p in enumerate(parts)]
    return union_all(tagged)
