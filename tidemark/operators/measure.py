"""Measuring a weekly table: channel and outcome statistics, least squares, prior derivation."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import fixed_values as fx
from tidemark.frames import WEEK, lookup, over, to_wide
from tidemark.functions.response import alpha_from_half_life, raw_weight
from tidemark.operators.features import fourier


def channel_stats(master: DataFrame, keys: list[str]) -> DataFrame:
    """Scale and variation of each channel, and why it cannot be estimated if it cannot."""
    v = F.col("value")
    s = master.where(F.col("role") == "spend").groupBy(*keys, "series").agg(
        F.max(v).alias("max_weekly"), F.percentile(v, F.lit(0.5)).alias("median_weekly"),
        F.coalesce(F.percentile(F.when(v > 0, v), F.lit(0.5)), F.lit(0.0)).alias("active_median_weekly"),
        F.avg(v).alias("mean_weekly"), F.stddev_pop(v).alias("std_weekly"), F.sum(v).alias("total"),
        F.count_if(v > 0).alias("n_active_weeks"), F.count(F.lit(1)).alias("n_weeks"),
        F.min(v).alias("min_weekly"), F.count_if(v.isNull()).alias("n_missing"))
    typical = F.when(F.col("n_active_weeks") > 0, F.col("active_median_weekly")).otherwise(F.col("median_weekly"))
    s = (s.withColumn("median_scaled", F.when(F.col("max_weekly") > 0, typical / F.col("max_weekly")).otherwise(0.0))
         .withColumn("cv", F.when(F.col("mean_weekly") > 0, F.col("std_weekly") / F.col("mean_weekly")).otherwise(0.0)))
    reason = (F.when(F.col("max_weekly") <= 0, "no_activity")
              .when(F.col("n_active_weeks") < fx.MIN_ACTIVE_WEEKS, "few_active_weeks")
              .when(F.col("cv") < fx.MIN_CHANNEL_CV, "no_variation"))
    return s.withColumn("degenerate_reason", reason)


def channel_guard(stats: DataFrame) -> DataFrame:
    """Channels a fit must refuse, with the first reason that applies."""
    reason = (F.when(F.col("n_missing") > 0, "missing_values").when(F.col("min_weekly") < 0, "negative")
              .otherwise(F.col("degenerate_reason")))
    return stats.withColumn("refused", reason).where(F.col("refused").isNotNull())


def is_constant(c: str) -> Column:
    return F.stddev_pop(c) <= 1e-9 * F.greatest(F.abs(F.avg(c)), F.lit(1.0))


def kpi_stats(master: DataFrame, keys: list[str]) -> DataFrame:
    """Scale of the outcome; ``refused`` names why it cannot be modelled."""
    v = F.col("value")
    s = master.where(F.col("role") == "kpi").groupBy(*keys, "series").agg(
        F.count(F.lit(1)).alias("n_weeks"), F.count_if(v.isNull()).alias("n_missing"),
        F.max(v).alias("kpi_max"), F.percentile(v, F.lit(0.5)).alias("kpi_median"),
        F.stddev_pop(v).alias("kpi_std"), F.min((v == F.round(v)).cast("int")).alias("_whole"),
        F.count_if(v == 0).alias("n_zero_weeks"))
    refused = (F.when(F.col("n_missing") > 0, "missing_values").when(F.col("kpi_max") <= 0, "no_positive_values")
               .when(F.col("n_weeks") < 2, "too_short"))
    return (s.withColumn("kpi_median_scaled", over(F.col("kpi_median"), F.col("kpi_max")))
            .withColumn("kpi_std_scaled", over(F.col("kpi_std"), F.col("kpi_max")))
            .withColumn("kpi_is_integer", F.col("_whole") == 1)
            .withColumn("refused", refused).drop("_whole"))


def scaled_time(keys: list[str]) -> Column:
    w = Window.partitionBy(*keys)
    t = F.row_number().over(w.orderBy(WEEK)) - 1
    return over(t, F.count(F.lit(1)).over(w) - 1)


def trend(master: DataFrame, keys: list[str]) -> DataFrame:
    """Slope and level of the outcome over its own maximum, on time scaled to 0..1."""
    k = master.where(F.col("role") == "kpi")
    y = over(F.col("value"), F.max("value").over(Window.partitionBy(*keys)))
    t = k.select(*keys, y.alias("y"), scaled_time(keys).alias("t"))
    return t.groupBy(*keys).agg(F.regr_slope("y", "t").alias("trend_slope"),
                                F.regr_intercept("y", "t").alias("trend_intercept"))


# --- least squares per panel: Spark sums products, a task solves one small system ----------

def gram(df: DataFrame, group: list[str], design: list[str], y: str, weight: Column | None = None) -> DataFrame:
    """Upper triangle of X'X, X'y, y'y and n per group over complete rows, in one aggregate."""
    df = df.dropna(subset=[y, *design])
    w = weight if weight is not None else F.lit(1.0)
    xx = [F.sum(w * F.col(a) * F.col(b)) for a, b in combinations_with_replacement(design, 2)]
    xy = [F.sum(w * F.col(a) * F.col(y)) for a in design]
    return df.groupBy(*group).agg(F.array(*xx).alias("xx"), F.array(*xy).alias("xy"),
                                  F.sum(w * F.col(y) * F.col(y)).alias("yy"), F.sum(w).alias("n"))


def unpack_gram(xx, p: int) -> np.ndarray:
    m = np.zeros((p, p))
    m[np.triu_indices(p)] = [0.0 if x is None else x for x in xx]
    return m + np.triu(m, 1).T


def solve_gram(grams: DataFrame, group: list[str], design: list[str]) -> DataFrame:
    """Rank-safe least squares: one row per (group, term) with its coefficient."""
    p = len(design)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grams.schema if f.name in group)

    def solve(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.itertuples(index=False):
                coef = np.linalg.lstsq(unpack_gram(rec.xx, p), np.asarray(rec.xy, float), rcond=1e-12)[0]
                head = tuple(getattr(rec, g) for g in group)
                rows += [head + (name, float(c)) for name, c in zip(design, coef)]
            yield pd.DataFrame(rows, columns=[*group, "term", "coef"])

    return grams.mapInPandas(solve, f"{schema}, term string, coef double")


def ols(df: DataFrame, group: list[str], design: list[str], y: str) -> DataFrame:
    return solve_gram(gram(df, group, design, y), group, design)


def with_fit(df: DataFrame, coefs: DataFrame, group: list[str], design: list[str], out: str = "fitted") -> DataFrame:
    """Add the fitted value from a coefficient table."""
    wide = coefs.groupBy(*group).agg(*[F.max(F.when(F.col("term") == c, F.col("coef"))).alias(f"_b{i}")
                                       for i, c in enumerate(design)])
    fit = F.lit(0.0)
    for i, c in enumerate(design):
        fit = fit + F.col(f"_b{i}") * F.col(c)
    return df.join(wide, group).withColumn(out, fit).drop(*[f"_b{i}" for i in range(len(design))])


def season_design(master: DataFrame, keys: list[str], modes: int = 2) -> tuple[DataFrame, list[str]]:
    """Outcome over its maximum with constant, scaled time and Fourier columns."""
    w = Window.partitionBy(*keys)
    t = F.row_number().over(w.orderBy(WEEK)) - 1
    base = (master.where(F.col("role") == "kpi")
            .withColumn("y", over(F.col("value"), F.max("value").over(w)))
            .withColumn("idx", t.cast("double")).withColumn("one", F.lit(1.0))
            .withColumn("t", over(F.col("idx"), F.count(F.lit(1)).over(w) - 1)))
    waves = fourier(F.col("idx"), 52.0, modes)
    return base.withColumns(waves).select(*keys, WEEK, "y", "one", "t", *waves), list(waves)


def season_amplitude(master: DataFrame, keys: list[str], modes: int = 2) -> DataFrame:
    """Root mean square of the Fourier coefficients on the detrended outcome."""
    df, waves = season_design(master, keys, modes)
    line = trend(master, keys)
    rest = df.join(line, keys).withColumn(
        "rest", F.col("y") - F.col("trend_intercept") - F.col("trend_slope") * F.col("t"))
    coefs = ols(rest, keys, ["one", *waves], "rest")
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_weeks"))
    rms = F.sqrt(F.avg(F.when(F.col("term") != "one", F.col("coef") * F.col("coef"))))
    enough = F.col("n_weeks") >= 2 * (2 * modes) + 2
    return (coefs.groupBy(*keys).agg(rms.alias("rms")).join(n, keys)
            .select(*keys, F.when(enough, F.col("rms")).otherwise(0.0).alias("seasonal_amplitude")))


def residual_stats(master: DataFrame, keys: list[str], channels: list[str], controls: list[str] = (),
                   modes: int = 2) -> DataFrame:
    """Residual spread and excess kurtosis after trend, season, controls and channels."""
    df, waves = season_design(master, keys, modes)
    w = Window.partitionBy(*keys)
    wide = to_wide(master, keys, [*channels, *controls])
    x = wide.select(
        *keys, WEEK,
        *[F.coalesce(F.col(c) / F.nullif(F.max(c).over(w), F.lit(0.0)), F.lit(0.0)).alias(f"x_{c}") for c in channels],
        *[F.coalesce((F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_pop(c).over(w), F.lit(0.0)), F.lit(0.0))
          .alias(f"z_{c}") for c in controls])
    design = ["one", "t", *waves, *[f"x_{c}" for c in channels], *[f"z_{c}" for c in controls]]
    full = df.join(x, [*keys, WEEK])
    resid = with_fit(full, ols(full, keys, design, "y"), keys, design).withColumn("e", F.col("y") - F.col("fitted"))
    m = resid.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") * F.col("e")).alias("ss"),
                                 F.avg("e").alias("mean_e"), F.stddev_pop("y").alias("sd_y"))
    dof = F.greatest(F.col("n") - len(design), F.lit(1))
    sd = F.when(F.col("n") > len(design) + 2, F.sqrt(F.col("ss") / dof)).otherwise(F.col("sd_y"))
    m = m.withColumn("residual_sd", sd)
    z = (F.col("e") - F.col("mean_e")) / F.nullif(F.col("residual_sd"), F.lit(0.0))
    k = (resid.join(m.select(*keys, "mean_e", "residual_sd", "n"), keys)
         .groupBy(*keys, "residual_sd", "n").agg((F.avg(F.pow(z, F.lit(4.0))) - 3.0).alias("k")))
    return k.select(*keys, "residual_sd", F.when(F.col("n") >= 8, F.coalesce("k", F.lit(0.0))).otherwise(0.0)
                    .alias("excess_kurtosis"))


# --- priors -------------------------------------------------------------------------------

HALF_NORMAL_MEAN = math.sqrt(2.0 / math.pi)


def likelihood(kpi_type: Column, is_integer: Column, median: Column, kurtosis: Column) -> Column:
    counts = kpi_type.isin("orders", "leads")
    return (F.when(counts & is_integer & (median <= fx.COUNT_MEDIAN), "negative_binomial")
            .when(counts, "normal").when(kurtosis > fx.STUDENT_T_KURTOSIS, "student_t").otherwise("normal"))


def burn_in(channels: DataFrame, keys: list[str], half_life: str, n_weeks: str, l_max: int = fx.L_MAX,
            delayed: str | None = None, theta: str | None = None) -> DataFrame:
    """Leading weeks to leave out: the slowest channel decides, at most a fifth of the weeks."""
    alpha = F.least(F.greatest(alpha_from_half_life(F.col(half_life)), F.lit(1e-6)), F.lit(1 - 1e-9))
    geo = [raw_weight(alpha, i) for i in range(l_max)]
    raw = geo if delayed is None else [F.when(F.col(delayed), raw_weight(alpha, i, F.col(theta))).otherwise(g)
                                       for i, g in enumerate(geo)]
    total = sum(raw[1:], raw[0])
    reached, cum = [], raw[0]
    for i in range(l_max):
        cum = raw[0] if i == 0 else cum + raw[i]
        reached.append(F.when(cum / total >= fx.BURN_IN_COVERAGE, F.lit(i)))
    needed = F.coalesce(*reached, F.lit(0))
    return (channels.withColumn("required", needed).groupBy(*keys)
            .agg(F.least(F.max("required"), F.max(F.floor(F.col(n_weeks) * fx.BURN_IN_MAX_SHARE)))
                 .cast("int").alias("burn_in_weeks")))


def prior_issues(intent: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    on = [*keys, "series"]
    unknown = (intent.join(stats, on, "left_anti").select(*keys, "series", F.lit("unknown_channel").alias("code")))
    stuck = (intent.select(*on).join(stats.where(F.col("degenerate_reason").isNotNull()), on)
             .select(*keys, "series", F.lit("channel_not_estimable").alias("code")))
    per = (intent.join(stats, on).groupBy(*keys)
           .agg((F.max("n_weeks") / F.count(F.lit(1))).alias("per")).where(F.col("per") < fx.WEEKS_PER_CHANNEL_WARN)
           .select(*keys, F.lit(None).cast("string").alias("series"),
                   F.when(F.col("per") < fx.WEEKS_PER_CHANNEL_ERROR, "too_many_channels")
                   .otherwise("few_weeks_per_channel").alias("code")))
    out = unknown.unionByName(stuck).unionByName(per)
    return out.withColumn("severity", F.when(F.col("code") == "few_weeks_per_channel", "warning").otherwise("error"))


def channel_priors(intent: DataFrame, stats: DataFrame, panel: DataFrame, keys: list[str]) -> DataFrame:
    """Prior table per channel from stated beliefs and measured scale.

    ``panel``: (keys, media_share, likelihood, kpi_median_scaled). Channel weights are
    normalised per panel, so adding a channel never inflates the media total.
    """
    j = intent.join(stats, [*keys, "series"]).join(panel, keys)
    weight = lookup(F.col("strength"), fx.STRENGTH_WEIGHT)
    center = lookup(F.col("saturation"), fx.SATURATION_CENTER)
    half_life = lookup(F.col("carryover"), fx.HALF_LIFE_WEEKS)
    share = weight / F.sum(weight).over(Window.partitionBy(*keys)) * lookup(
        F.coalesce("media_share", F.lit(fx.DEFAULT_MEDIA_SHARE)), fx.MEDIA_SHARE_CENTER)
    j = j.withColumn("slice_share", share).withColumn("_center", center)
    target = F.when(F.col("likelihood") == "negative_binomial",
                    -F.log(F.greatest(1.0 - F.col("slice_share"), F.lit(1e-6)))
                    ).otherwise(F.col("slice_share") * F.col("kpi_median_scaled"))
    expected = 1.0 / (1.0 + F.col("_center"))
    half_sat = F.greatest(F.col("median_scaled") * F.col("_center"), F.lit(1e-4))
    brand = F.col("channel_role") == "brand_building"
    hill = (F.col("n_weeks") >= fx.HILL_MIN_WEEKS) & (F.col("n_active_weeks") >= fx.HILL_MIN_ACTIVE)
    l_max = F.least(F.lit(fx.L_MAX), F.greatest(F.lit(4), F.floor(F.col("n_weeks") / 4))).cast("int")
    return j.select(
        *keys, "series", "unit", "n_weeks",
        F.greatest(target / (HALF_NORMAL_MEAN * expected), F.lit(1e-6)).alias("beta_sigma"),
        half_life.alias("half_life"),
        lookup(F.col("carryover"), fx.ADSTOCK_CONCENTRATION).alias("adstock_concentration"),
        F.when(brand, 2.0).otherwise(1.0).alias("delayed_peak_weeks"), F.lit(1.5).alias("delayed_peak_sigma"),
        F.lit(3.0).alias("hill_slope_a"), F.lit(3.0).alias("hill_slope_b"),
        half_sat.alias("halfsat_log_center"),
        lookup(F.col("saturation"), fx.SATURATION_SIGMA).alias("halfsat_log_sigma"),
        F.greatest(F.log(F.lit(3.0)) / half_sat, F.lit(1e-3)).alias("logistic_lam_sigma"),
        F.when(brand, "delayed").otherwise("geometric").alias("adstock"),
        F.when(hill, "hill").otherwise("logistic").alias("saturation"), l_max.alias("l_max"))


def baseline_priors(panel: DataFrame) -> DataFrame:
    """Baseline prior scales per panel from its measured statistics.

    Needs n_weeks, media_share, seasonality, kpi_median_scaled, kpi_std_scaled, trend_slope,
    seasonal_amplitude, residual_sd.
    """
    share = lookup(F.coalesce("media_share", F.lit(fx.DEFAULT_MEDIA_SHARE)), fx.MEDIA_SHARE_CENTER)
    on = (F.col("seasonality") != "none") & (F.col("n_weeks") >= fx.SEASON_MIN_WEEKS)
    season = F.greatest(F.lit(0.01), lookup(F.col("seasonality"), fx.SEASON_MULTIPLIER) * F.col("seasonal_amplitude"))
    trend_sigma = F.greatest(F.lit(0.05), 3.0 * F.abs("trend_slope"))
    modes = F.when(~on, 0).when(F.col("n_weeks") < fx.SEASON_TWO_MODES_WEEKS, 1).otherwise(2)
    return panel.withColumns({
        "intercept_mu": (1.0 - share) * F.col("kpi_median_scaled"),
        "intercept_sigma": F.greatest(F.lit(0.05), 0.5 * share * F.col("kpi_median_scaled")),
        "trend_sigma": trend_sigma,
        "season_sigma": F.when(on, season).otherwise(0.1),
        "control_sigma": F.greatest(F.lit(0.05), 1.5 * F.col("kpi_std_scaled")),
        "noise_sigma": F.greatest(F.lit(0.005), 2.0 * F.col("residual_sd")),
        "changepoint_scale": F.greatest(F.lit(0.01), 0.3 * trend_sigma),
        "fourier_modes": modes,
        "n_changepoints": F.least(F.lit(6), F.greatest(F.lit(1), F.floor(F.col("n_weeks") / 20))).cast("int"),
    })


WIDENED = ("beta_sigma", "halfsat_log_sigma", "logistic_lam_sigma", "intercept_sigma", "trend_sigma",
           "season_sigma", "control_sigma", "noise_sigma", "changepoint_scale")


def widen(priors: DataFrame, factor: float = 2.0) -> DataFrame:
    if factor <= 0:
        raise ValueError("factor must be positive")
    out = priors.withColumns({c: F.col(c) * factor for c in WIDENED if c in priors.columns})
    if "adstock_concentration" in priors.columns:
        out = out.withColumn("adstock_concentration",
                             F.greatest(F.col("adstock_concentration") / factor, F.lit(2.0)))
    return out


def bound_violations(priors: DataFrame, ids: list[str]) -> DataFrame:
    """Prior values outside their plausible range, NULLs included."""
    cols = [c for c in fx.PRIOR_BOUNDS if c in priors.columns]
    long = priors.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(ids, cols, "parameter", "value")
    lo = lookup(F.col("parameter"), {k: v[0] for k, v in fx.PRIOR_BOUNDS.items()})
    hi = lookup(F.col("parameter"), {k: v[1] for k, v in fx.PRIOR_BOUNDS.items()})
    return long.where(~F.coalesce(F.col("value").between(lo, hi), F.lit(False)))


def clamp_sample(df: DataFrame) -> DataFrame:
    """Sampling parameters into their bounds; whole numbers except the acceptance rate."""
    out = {}
    for c, (lo, hi) in fx.SAMPLE_BOUNDS.items():
        if c in df.columns:
            v = F.least(F.greatest(F.col(c).cast("double"), F.lit(float(lo))), F.lit(float(hi)))
            out[c] = v if c == "target_accept" else v.cast("int")
    return df.withColumns(out)


def spec_hash(df: DataFrame, out: str = "spec_hash") -> DataFrame:
    """sha-256 of the row as JSON with its fields in name order."""
    return df.withColumn(out, F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256))
