"""Can the channels be told apart: overlap, width, correlation, groups, per-channel verdict."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import fixed_values as fx
from tidemark.frames import correlation, over, stored

RANKS = ("identified", "weak", "not_identified")


def overlap(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value", bins: int = fx.OVERLAP_BINS) -> DataFrame:
    """Shared mass of two samples on one grid of equal bins."""
    both = a.select(*keys, value, F.lit(0).alias("_s")).unionByName(b.select(*keys, value, F.lit(1).alias("_s")))
    span = both.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"),
                                   F.count_if(F.col("_s") == 0).alias("na"), F.count_if(F.col("_s") == 1).alias("nb"))
    at = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    cells = (both.join(span, keys).withColumn("_bin", F.when(F.col("hi") > F.col("lo"), at).otherwise(0))
             .groupBy(*keys, "_bin", "na", "nb")
             .agg(F.count_if(F.col("_s") == 0).alias("ca"), F.count_if(F.col("_s") == 1).alias("cb")))
    return cells.groupBy(*keys).agg(
        F.sum(F.least(over(F.col("ca"), F.col("na")), over(F.col("cb"), F.col("nb")))).alias("overlap"))


def relative_width(p3: Column, p50: Column, p97: Column) -> Column:
    """Band over twice the median; a median of nearly zero counts as infinitely wide (NULL)."""
    return F.when(F.abs(p50) >= 1e-12, (p97 - p3) / (2 * F.abs(p50)))


def contribution_correlations(totals: DataFrame, keys: list[str], channels: list[str], value: str = "total") -> DataFrame:
    """Pearson r between channels over draws: (keys, a, b, r). One aggregate over a pivot."""
    wide = totals.groupBy(*keys, "draw").agg(
        *[F.max(F.when(F.col("series") == c, F.col(value))).alias(c) for c in channels])
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                      F.when((F.stddev_pop(a) < 1e-12) | (F.stddev_pop(b) < 1e-12), 0.0).otherwise(correlation(a, b)).alias("r"))
             for a, b in combinations(channels, 2)]
    return wide.groupBy(*keys).agg(F.array(*pairs).alias("_p")).select(*keys, F.inline("_p")).where(F.col("r").isNotNull())


def inseparable_groups(correlations: DataFrame, keys: list[str],
                       limit: float = fx.CONTRIBUTION_CORR_LIMITS[1]) -> DataFrame:
    """Connected components over |r| >= limit: (keys, series, group_label).

    Each round a channel takes the smallest label among itself, its neighbours and the label
    its label has (pointer jumping), so long chains close in few rounds. Each round is stored,
    so lineage stays short; the loop stops when nothing changes.
    """
    edges = correlations.where(F.abs("r") >= limit)
    links = edges.select(*keys, F.col("a").alias("series"), F.col("b").alias("other")).unionByName(
        edges.select(*keys, F.col("b").alias("series"), F.col("a").alias("other"))).distinct()
    labels = stored(links.select(*keys, "series").distinct().withColumn("label", F.col("series")))
    while True:
        near = (links.join(labels.select(*keys, F.col("series").alias("other"), F.col("label").alias("near")), [*keys, "other"])
                .groupBy(*keys, "series").agg(F.min("near").alias("near")))
        hop = labels.select(*keys, F.col("series").alias("label"), F.col("label").alias("hop"))
        step = (labels.join(near, [*keys, "series"], "left").join(hop, [*keys, "label"], "left")
                .select(*keys, "series", "label", F.least("label", "near", "hop").alias("next")))
        moved = stored(step)
        done = moved.where(F.col("label") != F.col("next")).isEmpty()
        labels = moved.select(*keys, "series", F.col("next").alias("label"))
        if done:
            return labels.select(*keys, "series", F.col("label").alias("group_label"))


def _level(c: Column, limits: tuple[float, float]) -> Column:
    return F.when(c >= limits[1], 2).when(c >= limits[0], 1).otherwise(0)


def worst_partner(correlations: DataFrame, keys: list[str]) -> DataFrame:
    both = correlations.select(*keys, F.col("a").alias("series"), F.col("b").alias("partner"), "r").unionByName(
        correlations.select(*keys, F.col("b").alias("series"), F.col("a").alias("partner"), "r"))
    top = F.max_by(F.struct("partner", "r"), F.struct(F.abs("r"), F.col("partner")))
    return both.groupBy(*keys, "series").agg(top.alias("_t")).select(*keys, "series", "_t.*")


def identifiability(intervals: DataFrame, correlations: DataFrame, keys: list[str], overlaps: DataFrame | None = None,
                    sensitivity: DataFrame | None = None) -> DataFrame:
    """Verdict per channel: the worst of four tests, with the tests that spoke.

    ``intervals``: (keys, series, p3, p50, p97) of total contributions; ``overlaps``:
    (keys, series, overlap); ``sensitivity``: (keys, series, shift). Missing evidence is skipped.
    """
    on = [*keys, "series"]
    j = intervals.join(worst_partner(correlations, keys), on, "left")
    j = j.join(overlaps, on, "left") if overlaps is not None else j.withColumn("overlap", F.lit(None).cast("double"))
    j = j.join(sensitivity, on, "left") if sensitivity is not None else j.withColumn("shift", F.lit(None).cast("double"))
    width = relative_width(F.col("p3"), F.col("p50"), F.col("p97"))
    j = (j.withColumn("relative_width", width)
         .withColumn("_c", _level(F.coalesce(F.abs("r"), F.lit(0.0)), fx.CONTRIBUTION_CORR_LIMITS))
         .withColumn("_w", F.when(F.col("relative_width").isNull(), 2).otherwise(_level(F.col("relative_width"), fx.WIDTH_LIMITS)))
         .withColumn("_o", _level(F.coalesce("overlap", F.lit(0.0)), fx.OVERLAP_LIMITS))
         .withColumn("_s", _level(F.coalesce("shift", F.lit(0.0)), fx.SENSITIVITY_LIMITS)))
    worst = F.greatest("_c", "_w", "_o", "_s")
    reasons = F.concat_ws(",", *[F.when(F.col(c) > 0, name) for c, name in (
        ("_c", "correlated"), ("_w", "wide_interval"), ("_o", "prior_unmoved"), ("_s", "prior_sensitive"))])
    return j.select(*on, F.element_at(F.array(*[F.lit(r) for r in RANKS]), worst + 1).alias("verdict"),
                    F.coalesce("r", F.lit(0.0)).alias("max_correlation"), F.col("partner").alias("most_correlated_with"),
                    "relative_width", "overlap", "shift", reasons.alias("reasons"))


def prior_samples(priors: DataFrame, keys: list[str], n: int, seed: int = 1, sigma: str = "beta_sigma") -> DataFrame:
    """Half-normal draws of each channel's effect. Noise is a hash of the row, so it repeats."""
    d = priors.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def uniform(k):
        return (F.pmod(F.xxhash64(F.lit(seed * 10 + k), *keys, "series", "draw"), F.lit(2_147_483_647)) + 0.5) / 2_147_483_647

    z = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * F.pi() * uniform(2))
    return d.select(*keys, "series", "draw", (F.abs(z) * F.col(sigma)).alias("value"))


def prior_shift(base: DataFrame, widened: DataFrame, keys: list[str], share: str = "share") -> DataFrame:
    """Relative move of a share between two fits, against the larger of the two."""
    on = [*keys, "series"]
    j = base.select(*on, F.col(share).alias("_a")).join(widened.select(*on, F.col(share).alias("_b")), on)
    top = F.greatest(F.abs("_a"), F.abs("_b"))
    return j.select(*on, F.when(top > 1e-12, F.abs(F.col("_a") - F.col("_b")) / top).otherwise(0.0).alias("shift"))
