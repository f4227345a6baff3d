"""Analytics on draw tables: intervals, attribution, fit diagnostics, convergence.

A draw table holds one number per draw, from our bootstrap or an external sampler. Groups are
bounded by the number of draws (times weeks where said), so exact percentiles are safe; pass
``approx=True`` for very many draws.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import fixed_values as fx
from tidemark.frames import WEEK, exact_quantiles, over, running_total, stored
from tidemark.functions.normal import gamma_draw, hash_uniform, normal_score, poisson_draw

BAND = (0.03, 0.5, 0.97)


def interval_columns(value: Column, prefix: str = "", approx: bool = False) -> list[Column]:
    if approx:
        return [F.percentile_approx(value, p, 10000).alias(f"{prefix}p{round(p * 100)}") for p in BAND]
    return [F.percentile(value, F.lit(p)).alias(f"{prefix}p{round(p * 100)}") for p in BAND]


def interval(df: DataFrame, keys: list[str], value: str = "value", approx: bool = False) -> DataFrame:
    return df.groupBy(*keys).agg(*interval_columns(F.col(value), approx=approx))


def attribute_additive(expected: DataFrame, contributions: DataFrame, keys: list[str], y_max: str = "y_max") -> DataFrame:
    """(keys, week, draw, component, value) in KPI units; the baseline is what is left."""
    at = [*keys, WEEK, "draw"]
    ch = contributions.select(*at, F.col("series").alias("component"), (F.col("contrib") * F.col(y_max)).alias("value"))
    media = ch.groupBy(*at).agg(F.sum("value").alias("_media"))
    base = (expected.join(media, at)
            .select(*at, F.lit("baseline").alias("component"), (F.col("mu") * F.col(y_max) - F.col("_media")).alias("value")))
    return ch.unionByName(base)


def attribute_count(expected: DataFrame, contributions: DataFrame, keys: list[str]) -> DataFrame:
    """Log link: a channel's lift alone, rescaled so that channels add up to the media total."""
    at = [*keys, WEEK, "draw"]
    w = Window.partitionBy(*at)
    j = contributions.select(*at, "series", "contrib").join(expected.select(*at, "mu"), at)
    lift = F.exp("mu") - F.exp(F.col("mu") - F.col("contrib"))
    j = j.withColumn("_lift", lift).withColumn("_media", F.exp("mu") - F.exp(F.col("mu") - F.sum("contrib").over(w)))
    total = F.sum("_lift").over(w)
    share = F.when(total > 0, F.col("_lift") * F.col("_media") / total).otherwise(0.0)
    ch = j.select(*at, F.col("series").alias("component"), share.alias("value"))
    left = j.groupBy(*at).agg((F.max(F.exp("mu")) - F.max("_media")).alias("value"))
    return ch.unionByName(left.select(*at, F.lit("baseline").alias("component"), "value"))


def baseline_parts(parts: DataFrame, keys: list[str], names: list[str], scale: str = "y_max") -> DataFrame:
    """Median per week of each baseline part. ``parts`` has one column per name and draw rows."""
    long = parts.select(*keys, WEEK, "draw", *[(F.col(n) * F.col(scale)).alias(n) for n in names])
    long = long.unpivot([*keys, WEEK, "draw"], names, "part", "value")
    return long.groupBy(*keys, WEEK, "part").agg(F.percentile("value", F.lit(0.5)).alias("p50"))


def baseline_parts_count(parts: DataFrame, keys: list[str], names: list[str], baseline: str) -> DataFrame:
    """Log link: what the baseline loses without each part, rescaled to add up to the baseline."""
    log_total = F.lit(0.0)
    for n in names:
        log_total = log_total + F.col(n)
    raw = {n: F.col(baseline) - F.exp(log_total - F.col(n)) for n in names}
    total = F.lit(0.0)
    for c in raw.values():
        total = total + c
    scaled = [F.when(F.abs(total) > 1e-12, c / total * F.col(baseline)).otherwise(0.0).alias(n) for n, c in raw.items()]
    long = parts.select(*keys, WEEK, "draw", *scaled).unpivot([*keys, WEEK, "draw"], names, "part", "value")
    return long.groupBy(*keys, WEEK, "part").agg(F.percentile("value", F.lit(0.5)).alias("p50"))


def channel_results(contributions: DataFrame, kpi_totals: DataFrame, keys: list[str]) -> DataFrame:
    """Totals over observed weeks per channel, as intervals over draws.

    ``contributions``: (keys, week, series, draw, value, spend, direct_fraction) in KPI units;
    ``kpi_totals``: (keys, kpi_total). No spend, no return.
    """
    per_draw = contributions.groupBy(*keys, "series", "draw").agg(
        F.sum("value").alias("total"), F.sum(F.col("value") * F.col("direct_fraction")).alias("direct"),
        F.sum("spend").alias("spend"))
    d = per_draw.join(kpi_totals, keys)
    share = F.when(F.abs("total") > 1e-12, F.col("direct") / F.col("total")).otherwise(1.0)
    out = d.groupBy(*keys, "series").agg(
        *interval_columns(F.col("total"), "contribution_"),
        *interval_columns(over(F.col("total"), F.col("kpi_total")), "share_"),
        *interval_columns(F.when(F.col("spend") > 0, F.col("total") / F.col("spend")), "return_"),
        *interval_columns(F.col("direct"), "direct_"),
        *interval_columns(F.col("total") - F.col("direct"), "carryover_"),
        *interval_columns(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), "direct_share_"),
        F.max("spend").alias("total_spend"))
    return out


def weekly_bands(expected: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return expected.groupBy(*keys, WEEK).agg(*interval_columns(F.col(value)))


def predictive_normal(expected: DataFrame, keys: list[str], sigma: str, y_max: str, seed: int = 1) -> DataFrame:
    """Expected plus Gaussian noise. The noise is a hash of the row, so a rerun repeats it."""
    ids = [*keys, WEEK, "draw"]
    z = F.sqrt(-2 * F.log(hash_uniform(1, ids, seed))) * F.cos(2 * F.pi() * hash_uniform(2, ids, seed))
    return expected.withColumn("predicted", F.col("mu") * F.col(y_max) + z * F.col(sigma) * F.col(y_max))


def predictive_t(expected: DataFrame, keys: list[str], sigma: str, y_max: str, nu: float, seed: int = 1) -> DataFrame:
    """Expected plus Student-t noise of ``nu`` degrees of freedom, in its polar form, from hashes of the row."""
    ids = [*keys, WEEK, "draw"]
    t = F.sqrt(nu * (F.pow(hash_uniform(1, ids, seed), F.lit(-2.0 / nu)) - 1)) * F.cos(2 * F.pi() * hash_uniform(2, ids, seed))
    return expected.withColumn("predicted", F.col("mu") * F.col(y_max) + t * F.col(sigma) * F.col(y_max))


def predictive_count(expected: DataFrame, keys: list[str], mean: str, dispersion: str | None = None, seed: int = 1) -> DataFrame:
    """Counts around ``mean``: negative binomial, or Poisson without a ``dispersion`` (or where it is NULL, 0 or infinite).

    Both are columns of hashes of the row, so the draws do not depend on partitions or batches.
    """
    ids = [*keys, WEEK, "draw"]
    rate = F.col(mean).cast("double")
    if dispersion is not None:
        a = F.col(dispersion).cast("double")
        spread = (a > 0) & (a < float("inf"))
        shape = F.when(spread, a).otherwise(1.0)
        rate = F.when(F.coalesce(spread, F.lit(False)), rate / shape * gamma_draw(shape, ids, seed)).otherwise(rate)
    e = expected.withColumn("_rate", rate)
    return e.withColumn("predicted", poisson_draw(F.col("_rate"), ids, seed)).drop("_rate")


COVERAGE = {94: (0.03, 0.97), 80: (0.10, 0.90), 50: (0.25, 0.75)}


def coverage(draws: DataFrame, keys: list[str], value: str = "predicted", actual: str = "actual") -> DataFrame:
    """Share of weeks whose actual lies in the 94, 80 and 50% bands of its draws."""
    probs = sorted({p for band in COVERAGE.values() for p in band})
    per_week = draws.groupBy(*keys, WEEK).agg(
        F.max(actual).alias("_a"), *[F.percentile(value, F.lit(p)).alias(f"_q{round(p * 100)}") for p in probs])
    inside = [F.avg(F.col("_a").between(F.col(f"_q{round(lo * 100)}"), F.col(f"_q{round(hi * 100)}")).cast("double"))
              .alias(f"coverage_{level}") for level, (lo, hi) in COVERAGE.items()]
    return per_week.groupBy(*keys).agg(*inside)


def coverage_check(cover: DataFrame, keys: list[str], tolerance: float = fx.COVERAGE_TOLERANCE) -> DataFrame:
    names = [f"coverage_{level}" for level in COVERAGE]
    long = cover.unpivot(keys, names, "band", "actual").withColumn(
        "nominal", F.substring_index("band", "_", -1).cast("double") / 100)
    return long.withColumn("ok", F.abs(F.col("actual") - F.col("nominal")) <= tolerance)


def decomposition_check(totals: DataFrame, keys: list[str], total: str, parts: str,
                        tolerance: float = fx.DECOMPOSITION_TOLERANCE) -> DataFrame:
    """Largest gap between the total and the sum of its parts, against the mean total."""
    err = F.max(F.abs(F.col(total) - F.col(parts))) / F.greatest(F.avg(F.abs(total)), F.lit(1e-12))
    return totals.groupBy(*keys).agg(err.alias("max_relative_error")).withColumn(
        "ok", F.col("max_relative_error") <= tolerance)


def goodness(weeks: DataFrame, keys: list[str], actual: str = "actual", fitted: str = "fitted") -> DataFrame:
    """R2 (a flat actual counts as total 1) and the mean absolute percentage error over non-zero actuals."""
    w = Window.partitionBy(*keys)
    d = (weeks.withColumn("_c", F.col(actual) - F.avg(actual).over(w)).withColumn("_e", F.col(actual) - F.col(fitted)))
    tot = F.sum(F.col("_c") * F.col("_c"))
    ape = F.when(F.col(actual) != 0, F.abs(F.col("_e") / F.col(actual)))
    return d.groupBy(*keys).agg(
        (1 - F.sum(F.col("_e") * F.col("_e")) / F.when(tot == 0, 1.0).otherwise(tot)).alias("r2"),
        F.avg(ape).alias("mape"))


def lag1_autocorrelation(weeks: DataFrame, keys: list[str], residual: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    c = weeks.withColumn("_c", F.col(residual) - F.avg(residual).over(w))
    c = c.withColumn("_n", F.lead("_c").over(w.orderBy(WEEK)))
    ss = F.sum(F.col("_c") * F.col("_c"))
    r = F.when(ss > 0, F.sum(F.col("_c") * F.col("_n")) / ss).otherwise(0.0)
    return c.groupBy(*keys).agg(F.when(F.count(residual) >= 3, r).alias("lag1_autocorrelation"))


def split_rhat(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Split R-hat. ``samples``: (keys, chain, draw, value), draws numbered from 0 per chain."""
    w = Window.partitionBy(*keys, "chain")
    half = F.when(F.col("draw") * 2 < F.max("draw").over(w) + 1, 0).otherwise(1)
    halves = samples.withColumn("_half", half).groupBy(*keys, "chain", "_half").agg(
        F.avg(value).alias("_m"), F.var_samp(value).alias("_v"), F.count(F.lit(1)).alias("_n"))
    m = halves.groupBy(*keys).agg(F.avg("_v").alias("within"), F.var_samp("_m").alias("between"), F.avg("_n").alias("n"))
    plus = (F.col("n") - 1) / F.col("n") * F.col("within") + F.col("between")
    return m.select(*keys, F.when(F.col("within") > 0, F.sqrt(plus / F.col("within"))).alias("r_hat"))


def _normal_scores(samples: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Normal scores of the values' ranks over all chains; equal values share their mean rank.

    Values are counted first and the counts are summed in ranges, so a quantity may have any number of draws.
    """
    counts = samples.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_total(counts, keys, value, F.col("_c"), "_to")
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_s"))
    rank = F.col("_to") - F.col("_c") + (F.col("_c") + 1) / 2
    scores = ranked.join(sizes, keys).select(*keys, value, normal_score((rank - 0.375) / (F.col("_s") + 0.25)).alias(out))
    return samples.join(scores, [*keys, value])


def rank_rhat(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, r_hat_bulk, r_hat_tail, r_hat): split R-hat of normal scores, of the same for distances from the median, and
    the larger of the two. Chains that agree in place but not in spread show in the second one alone.

    Missing values are left out; a quantity that never varies has no R-hat.
    """
    rows = samples.select(*keys, "chain", "draw", F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    rows = stored(rows, "samples")
    middle = exact_quantiles(rows, keys, "_v", [0.5]).select(*keys, F.col("q").alias("_mid"))
    folded = rows.join(middle, keys).select(*keys, "chain", "draw", F.abs(F.col("_v") - F.col("_mid")).alias("_v"))
    bulk, tail = (split_rhat(_normal_scores(r, keys, "_v", "_z"), keys, "_z").withColumnRenamed("r_hat", name)
                  for r, name in ((rows, "r_hat_bulk"), (folded, "r_hat_tail")))
    return bulk.join(tail, keys).withColumn("r_hat", F.greatest("r_hat_bulk", "r_hat_tail"))


def _ess(x: np.ndarray) -> float:
    """Effective samples of chains by draws: autocovariances of every lag, summed in pairs while these are positive and fall."""
    m, n = x.shape
    if n < 4 or not np.isfinite(x).all() or np.ptp(x) == 0:
        return float("nan")
    c = x - x.mean(axis=1, keepdims=True)
    f = np.fft.rfft(c, 2 * n, axis=1)
    acov = (np.fft.irfft(f * np.conj(f), 2 * n, axis=1)[:, :n] / n).mean(axis=0)
    within = acov[0] * n / (n - 1)
    plus = acov[0] + (x.mean(axis=1).var(ddof=1) if m > 1 else 0.0)
    rho = 1 - (within - acov * n / (n - 1)) / plus
    rho[0] = 1.0
    pairs = rho[:n // 2 * 2].reshape(-1, 2).sum(axis=1)
    stop = int(np.argmax(pairs <= 0)) if (pairs <= 0).any() else len(pairs)
    tau = 2 * np.minimum.accumulate(pairs[:max(stop, 1)]).sum() - 1
    return float(min(m * n / max(tau, 1e-9), m * n * np.log10(m * n)))


def effective_samples(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, ess, ess_bulk, ess_tail) of chains of equal length; longer ones are cut at their ends to the shortest.

    ``ess`` is of the values; ``ess_bulk`` of their normal ranks in half chains, ``ess_tail`` the smaller of those of the 5 and
    95% marks. A task gets one quantity's draws. Fewer than four draws a chain, or values that never vary, give NULL.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chains = [g.sort_values("draw")[value].to_numpy(float) for _, g in pdf.groupby("chain")]
        n = min(map(len, chains))
        x = np.stack([c[:n] for c in chains])
        half = n // 2
        halves = np.concatenate([x[:, :half], x[:, n - half:]])
        ranks = pd.Series(halves.ravel()).rank().to_numpy().reshape(halves.shape)
        normal = np.vectorize(NormalDist().inv_cdf, otypes=[float])((ranks - 0.375) / (halves.size + 0.25))
        tails = [_ess((halves <= np.quantile(x, p)).astype(float)) for p in (0.05, 0.95)]
        row = {k: pdf[k].iloc[0] for k in keys} | {"ess": _ess(x), "ess_bulk": _ess(normal), "ess_tail": min(tails)}
        return pd.DataFrame([row])

    ids = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema if f.name in keys)
    rows = samples.select(*keys, "chain", "draw", value).where(F.col(value).isNotNull())
    out = rows.groupBy(*keys).applyInPandas(run, f"{ids}, ess double, ess_bulk double, ess_tail double")
    return out.select(*keys, *[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in ("ess", "ess_bulk", "ess_tail")])


def sampler_health(stats: DataFrame, keys: list[str], max_depth: int = 10) -> DataFrame:
    """Divergences, lowest E-BFMI over chains and draws at the depth limit.

    ``stats``: (keys, chain, draw, energy, diverging, tree_depth) as a sampler reports them.
    """
    w = Window.partitionBy(*keys, "chain").orderBy("draw")
    e = stats.withColumn("_d", F.col("energy") - F.lag("energy").over(w))
    chain = e.groupBy(*keys, "chain").agg(
        (F.sum(F.col("_d") * F.col("_d")) / F.count(F.lit(1)) / F.nullif(F.var_pop("energy"), F.lit(0.0))).alias("bfmi"),
        F.count_if("diverging").alias("n_div"), F.count_if(F.col("tree_depth") >= max_depth).alias("n_deep"))
    return chain.groupBy(*keys).agg(F.sum("n_div").alias("n_divergences"), F.min("bfmi").alias("min_e_bfmi"),
                                    F.sum("n_deep").alias("n_max_treedepth"))
