"""Profiles of raw sources: statistics, gaps, outliers, correlations, histograms, findings.

Sources are raw and may be of any size, so quantiles, row order and runs use the range-cut
helpers instead of a window over a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark import fixed_values as fx
from tidemark.frames import exact_quantiles, running_totals, to_wide
from tidemark.operators.quality import column_pairs


def column_stats(cells: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """n, missing, range, mean, population std and exact quartiles per column."""
    base = cells.groupBy(*keys).agg(
        F.count(value).alias("n"), F.count_if(F.col(value).isNull()).alias("n_missing"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"))
    q = exact_quantiles(cells, keys, value, [0.25, 0.5, 0.75])
    wide = q.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(name)
                                  for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return base.join(wide, keys, "left")


def missing_runs(cells: DataFrame, keys: list[str], order: str, value: str = "value",
                 label: str | None = None) -> DataFrame:
    """Runs of empty cells in row order: start row (0-based), length, first and last label.

    The number of filled cells before a row names its run; a run of any length is reduced by
    a partial aggregate.
    """
    label = label or order
    filled = F.col(value).isNotNull().cast("bigint")
    placed = running_totals(cells, keys, order, {"_row": F.lit(1).cast("bigint"), "_seen": filled})
    return (placed.where(F.col(value).isNull()).groupBy(*keys, "_seen")
            .agg((F.min("_row") - 1).alias("start"), F.count(F.lit(1)).alias("length"),
                 F.min_by(label, order).alias("start_label"), F.max_by(label, order).alias("end_label"))
            .drop("_seen"))


def kept_runs(runs: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """The ``keep`` longest runs per column, for a display."""
    w = Window.partitionBy(*keys).orderBy(F.desc("length"), "start")
    return runs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


def longest_gap(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(F.max("length").alias("longest_missing_run"))


def outliers(cells: DataFrame, keys: list[str], order: str, value: str = "value", top: int | None = None) -> DataFrame:
    """|z| >= 3.5 on the population std, numbered from the largest; all of them, or the ``top`` largest per column."""
    stats = cells.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = (F.col(value) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    far = (cells.join(F.broadcast(stats), keys).withColumn("z", z).where(F.abs("z") >= fx.OUTLIER_Z).drop("_m", "_s"))
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs("z")), order)
    ranked = far.withColumn("outlier_no", F.row_number().over(w))
    return ranked if top is None else ranked.where(F.col("outlier_no") <= top)


def correlations(wide: DataFrame, keys: list[str], columns: list[str],
                 minimum: float = fx.CORRELATION_MIN, top: int | None = None) -> DataFrame:
    """Column pairs of at least ``minimum``, numbered from the strongest; all of them, or the ``top`` strongest."""
    pairs = column_pairs(wide, keys, columns, minimum)
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs("r")), "a", "b")
    ranked = pairs.withColumn("pair_no", F.row_number().over(w))
    return ranked if top is None else ranked.where(F.col("pair_no") <= top)


def histogram(cells: DataFrame, keys: list[str], bins: int = fx.HISTOGRAM_BINS,
              value: str = "value") -> DataFrame:
    """Equal bins between min and max, the last one closed; empty bins are listed.

    The spans, a row per column, go to the cells: a shuffle by ``keys`` would put all cells of a column in one task.
    """
    span = cells.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    span = (span.where(F.col("lo").isNotNull())
            .withColumn("n_bins", F.when(F.col("lo") == F.col("hi"), 1).otherwise(bins))
            .withColumn("width", (F.col("hi") - F.col("lo")) / F.col("n_bins")))
    at = F.when(F.col("width") == 0, 0).otherwise(
        F.least(F.floor((F.col(value) - F.col("lo")) / F.col("width")), F.col("n_bins") - 1))
    counts = (cells.where(F.col(value).isNotNull()).join(F.broadcast(span), keys)
              .groupBy(*keys, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    frame = span.select(*keys, "lo", "width", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin"))
    return (frame.join(counts, [*keys, "bin"], "left")
            .select(*keys, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
                    F.coalesce("n", F.lit(0).cast("bigint")).alias("n")))


def date_range(rows: DataFrame, keys: list[str], date: str, order: str) -> DataFrame:
    """Label of the first and the last row."""
    return rows.groupBy(*keys).agg(F.min_by(date, order).alias("first_label"),
                                   F.max_by(date, order).alias("last_label"))


def build_profile(cells: DataFrame, keys: list[str], order: str, label: str, columns: list[str] | None = None,
                  most_outliers: int = fx.OUTLIER_TOP, most_runs: int = fx.MISSING_RUNS_KEPT, most_points: int = fx.SERIES_ROWS,
                  most_pairs: int = fx.CORRELATION_TOP) -> DataFrame:
    """One nested row per column, the last of ``keys``: statistics, date range, histogram, outliers, gaps, look-alike
    columns, and the series if it is short.

    A nested row is for display, so its arrays are cut to the sizes given; the operators it is made of give all rows.
    ``columns`` names the columns whose pairs are compared.
    """
    stats = column_stats(cells, keys)
    far = outliers(cells, keys, order, top=most_outliers).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("outlier_no", F.col(label).alias("label"), "value", "z")))
        .alias("outliers"))
    runs = kept_runs(missing_runs(cells, keys, order, label=label), keys, most_runs)
    bars = histogram(cells, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "bin_start", "n"))).alias("histogram"))
    gaps = runs.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("start", "length", "start_label", "end_label"))).alias("missing_runs"),
        F.max("length").alias("longest_missing_run"))
    short = stats.where(F.col("n") + F.col("n_missing") <= most_points).select(*keys)
    points = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "value")))
    series = cells.join(short, keys, "left_semi").groupBy(*keys).agg(points.alias("series_points"))
    parts = [far, gaps, series, bars, date_range(cells, keys, label, order)]
    if columns and len(columns) > 1:
        panel, name = keys[:-1], keys[-1]
        at = to_wide(cells.withColumnRenamed(name, "series") if name != "series" else cells, panel, columns, order)
        pairs = correlations(at, panel, columns, top=most_pairs)
        both = pairs.select(*panel, F.col("a").alias(name), F.col("b").alias("other"), "r").unionByName(
            pairs.select(*panel, F.col("b").alias(name), F.col("a").alias("other"), "r"))
        parts.append(both.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("other", "r"))).alias("look_alikes")))
    for part in parts:
        stats = stats.join(part, keys, "left")
    return (stats
            .withColumn("longest_missing_run", F.coalesce("longest_missing_run", F.lit(0).cast("bigint"))))


def source_check(sources: DataFrame) -> DataFrame:
    """Readiness of a source: needs ``date_column``, ``first_day``, ``last_day``, ``n_numeric``."""
    days = F.date_diff("last_day", "first_day")
    weeks = F.when(days > 0, F.round(days / 7).cast("bigint"))
    blocked = (F.col("date_column").isNull() | (F.col("n_numeric") < 2)
               | F.coalesce(F.col("weeks") < fx.SOURCE_MIN_WEEKS, F.lit(False)))
    warned = F.col("weeks").isNull() | (F.col("weeks") < fx.SOURCE_COMFORTABLE_WEEKS)
    return sources.withColumn("weeks", weeks).withColumn(
        "verdict", F.when(blocked, "not_usable").when(warned, "usable_with_warnings").otherwise("usable"))


def findings(gaps: DataFrame, far: DataFrame, pairs: DataFrame, roles: DataFrame, keys: list[str], most_outliers: int | None = None) -> DataFrame:
    """The choices a profile asks for: control gaps, outcome outliers (the ``most_outliers`` largest, or all), look-alike columns."""
    on = [*keys, "series"]
    r = roles.select(*on, "role")
    gap = (gaps.where(F.col("longest_missing_run") >= fx.FINDING_GAP_WEEKS)
           .join(r.where(F.col("role") == "control"), on, "left_semi")
           .select(*keys, F.lit("gap").alias("kind"), F.col("series").alias("subject"),
                   F.lit(None).cast("string").alias("other"), F.col("longest_missing_run").cast("double").alias("evidence"),
                   F.lit("ffill").alias("default_choice")))
    spike = ((far if most_outliers is None else far.where(F.col("outlier_no") <= most_outliers))
             .join(r.where(F.col("role") == "kpi"), on, "left_semi")
             .select(*keys, F.lit("outlier").alias("kind"), F.col("series").alias("subject"),
                     F.lit(None).cast("string").alias("other"), F.col("z").alias("evidence"),
                     F.lit("keep").alias("default_choice")))
    modelled = r.where(F.col("role").isin(*fx.ROLES))
    twin = (pairs.where(F.abs("r") >= fx.FINDING_CORRELATION)
            .join(modelled.select(*keys, F.col("series").alias("a")), [*keys, "a"], "left_semi")
            .join(modelled.select(*keys, F.col("series").alias("b")), [*keys, "b"], "left_semi")
            .select(*keys, F.lit("duplicate").alias("kind"), F.col("a").alias("subject"),
                    F.col("b").alias("other"), F.col("r").alias("evidence"),
                    F.lit("keep").alias("default_choice")))
    return gap.unionByName(spike).unionByName(twin)


def steps_together(wide: DataFrame, keys: list[str], order: str, a: str, b: str) -> DataFrame:
    """Of the steps where either column moves, the share that moves the same way."""
    w = Window.partitionBy(*keys).orderBy(order)
    pair = (wide.where(F.col(a).isNotNull() & F.col(b).isNotNull())
            .withColumn("_da", F.col(a) - F.lag(a).over(w)).withColumn("_db", F.col(b) - F.lag(b).over(w)))
    moved = F.coalesce((F.col("_da") != 0) | (F.col("_db") != 0), F.lit(False))
    same = (F.col("_da") >= 0) == (F.col("_db") >= 0)
    return pair.groupBy(*keys).agg(
        (F.count_if(moved & same) / F.nullif(F.count_if(moved), F.lit(0))).alias("share_together"))


def outlier_rank(series: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """1 is the highest value of the (weekly) series; ties share a rank."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value))
    return series.where(F.col(value).isNotNull()).withColumn("value_rank", F.rank().over(w))


def neighbour_values(series: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return series.withColumn("value_before", before).withColumn("value_after", after)


def context_rows(rows: DataFrame, marks: DataFrame, keys: list[str], position: str, around: int) -> DataFrame:
    """Rows within ``around`` positions of a marked range ``(keys, mark, lo, hi)``.

    The marks are spread over the positions they show, which makes it an equi-join.
    """
    shown = marks.withColumn(position, F.explode(F.sequence(F.col("lo") - around, F.col("hi") + around)))
    marked = F.col(position).between(F.col("lo"), F.col("hi"))
    return rows.join(shown, [*keys, position]).withColumn("marked", marked).drop("lo", "hi")


def recipe_events(choices: DataFrame, keys: list[str], date: str, note: str) -> DataFrame:
    """Dates with a note become one event per ISO week, named after its first note."""
    from tidemark.functions.dates import iso_week, iso_year
    from tidemark.functions.text import slug, unique_names

    trimmed = F.nullif(F.trim(note), F.lit(""))
    weeks = (choices.where(F.col(date).isNotNull())
             .groupBy(*keys, iso_year(F.col(date)).alias("iso_year"), iso_week(F.col(date)).alias("iso_week"))
             .agg(F.min_by(trimmed, F.when(trimmed.isNotNull(), F.struct(date, trimmed))).alias("first_note"),
                  F.count_distinct(trimmed).alias("n_notes")))
    base = F.coalesce(F.nullif(slug(F.col("first_note")), F.lit("")), F.lit("bijzondere_week"))
    named = weeks.withColumn("base_name", F.concat_ws(
        "_", base, F.col("iso_year").cast("string"), F.lpad(F.col("iso_week").cast("string"), 2, "0")))
    order = F.col("iso_year") * 100 + F.col("iso_week")
    return unique_names(named.withColumn("_at", order), keys, "base_name", "_at", "name").drop("_at")
