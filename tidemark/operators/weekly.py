"""From raw dated rows to a gap-free weekly table: aggregation, window, grid, fills.

The raw long form is ``(keys, source, ts, series, role, value)``; the weekly long form is
``(keys, week_start, series, role, value)``. Raw rows are only ever aggregated; windows run on
weekly rows, whose number per series is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import fixed_values as fx
from tidemark.frames import WEEK, series_window, whole_series
from tidemark.functions.dates import monday_of, week_start


ROWS_OF_TASK = 1 << 18


def drop_bad_dates(df: DataFrame, ts: str) -> DataFrame:
    return df.where(F.col(ts).isNotNull())


def different_rows(df: DataFrame, keys: list[str], ts: str, whole: list[str], kept: list[str]) -> DataFrame:
    """Every different raw row once: (keys, ts, kept, _copies, _first).

    Rows are told apart by two hashes of the columns ``whole`` within their panel and moment, so that only the columns
    ``kept`` travel; copies are folded inside tasks before anything moves. ``_first`` is the place of the first copy.
    One read of a source ends here: dates, copies, edges, cadence, roles and weekly sums all follow from these rows.
    """
    # hashes pass over nulls, so where these stand is hashed too
    cells = [F.col(c) for c in whole] + [F.concat_ws("", *[F.col(c).isNull().cast("string") for c in whole])]
    rows = df.select(*keys, ts, *[c for c in kept if c not in (*keys, ts)], F.xxhash64(*cells).alias("_h1"), F.hash(*cells).alias("_h2"),
                     F.monotonically_increasing_id().alias("_first"))
    cells = [F.any_value(c).alias(c) for c in kept if c not in (*keys, ts)]
    return (rows.groupBy(*keys, ts, "_h1", "_h2").agg(*cells, F.count(F.lit(1)).alias("_copies"), F.min("_first").alias("_first")).drop("_h1", "_h2"))


def rows_per_day(rows: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """:func:`different_rows` folded to days: (keys, ts, _copies, _rows), ``ts`` a date. Rules that count rows or look at
    dates alone give the same on these, whose number is bounded by the calendar."""
    return rows.groupBy(*keys, F.to_date(ts).alias(ts)).agg(F.sum("_copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))


def keeps_copies(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """(keys, keeps): whether a panel's rows are daily, so that identical ones are bookings of their own."""
    gaps = median_day_gap(df, keys, ts)
    return gaps.select(*keys, F.coalesce(F.col("median_gap") < fx.DAILY_GAP_DAYS, F.lit(False)).alias("keeps"))


def copy_issues(rows: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """As :func:`identical_row_issues`, from :func:`different_rows` or :func:`rows_per_day`."""
    once = F.col("_rows") if "_rows" in rows.columns else F.lit(1)
    extra = rows.groupBy(*keys).agg(F.sum(F.col("_copies") - once).alias("n")).where(F.col("n") > 0)
    code = F.when(F.coalesce("keeps", F.lit(False)), "duplicate_rows").otherwise("duplicate_rows_dropped")
    return extra.join(keeps_copies(rows, keys, ts), keys, "left").select(*keys, code.alias("code"), "n")


def bad_date_issues(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    copies = F.col("_copies") if "_copies" in df.columns else F.lit(1)
    n = df.groupBy(*keys).agg(F.sum(F.when(F.col(ts).isNull(), copies).otherwise(0)).alias("n"))
    return n.where(F.col("n") > 0).withColumn("code", F.lit("unparseable_dates"))


def median_day_gap(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Median days between consecutive distinct days; NULL below three days."""
    days = df.where(F.col(ts).isNotNull()).select(*keys, F.to_date(ts).alias("day")).distinct()
    w = Window.partitionBy(*keys).orderBy("day")
    gaps = days.withColumn("gap", F.date_diff("day", F.lag("day").over(w)))
    return gaps.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) >= 3, F.percentile(F.col("gap"), F.lit(0.5))).alias("median_gap"))


def drop_identical_rows(df: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """Collapse identical rows where rows are ~weekly or coarser; keep them where daily.

    Panels that keep their rows pass straight through; only the others are deduplicated. Rows are dealt by panel over as
    many tasks as their number asks for, once: gaps, join and copies are then settled where the rows are, and what a
    task sorts or hashes does not grow with the table.
    """
    dealt = df.repartition(1 + df.count() // ROWS_OF_TASK, *keys)
    rows = dealt.select(*columns).join(median_day_gap(dealt, keys, ts), keys, "left")
    keep = F.coalesce(F.col("median_gap") < fx.DAILY_GAP_DAYS, F.lit(False))
    kept = rows.where(keep).select(*columns)
    return kept.unionByName(rows.where(~keep).select(*columns).distinct())


def identical_row_issues(df: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    gaps = median_day_gap(df, keys, ts)
    extra = (df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
             .groupBy(*keys).agg(F.sum(F.col("_copies") - 1).alias("n")).where(F.col("n") > 0))
    once = F.coalesce(F.col("median_gap") >= fx.DAILY_GAP_DAYS, F.lit(True))
    code = F.when(once, "duplicate_rows_dropped").otherwise("duplicate_rows")
    return extra.join(gaps, keys, "left").select(*keys, code.alias("code"), "n")


def aggregate_weeks(raw: DataFrame, keys: list[str], ts: str = "ts", null_weeks: str = "zero") -> DataFrame:
    """Outcomes and spend are summed per week, controls averaged.

    A summed week whose values are all unreadable is 0, or NULL with ``null_weeks="keep"``.
    """
    total = F.sum("value")
    if null_weeks == "zero":
        total = F.coalesce(total, F.lit(0.0))
    value = F.when(F.col("role").isin(*fx.SUMMED_ROLES), total).otherwise(F.avg("value"))
    return (raw.groupBy(*keys, "source", week_start(F.col(ts)).alias(WEEK), "series", "role")
            .agg(value.alias("value")))


def join_sources_long(weekly: list[DataFrame]) -> DataFrame:
    """Outer join of sources in long form is their union."""
    out = weekly[0]
    for other in weekly[1:]:
        out = out.unionByName(other)
    return out


def join_sources_wide(wide: list[DataFrame], keys: list[str]) -> DataFrame:
    out = wide[0]
    for other in wide[1:]:
        out = out.join(other, [*keys, WEEK], "full")
    return out


def source_spans(weekly: DataFrame, keys: list[str]) -> DataFrame:
    return weekly.groupBy(*keys, "source").agg(F.min(WEEK).alias("lo"), F.max(WEEK).alias("hi"))


def overlap_window(spans: DataFrame, keys: list[str], essential: list[str]) -> DataFrame:
    """Shared period of the essential sources; ``problem`` says why there is none."""
    is_essential = F.col("source").isin(*essential)
    w = spans.groupBy(*keys).agg(
        F.max(F.when(is_essential, F.col("lo"))).alias("window_start"),
        F.min(F.when(is_essential, F.col("hi"))).alias("window_end"))
    problem = (F.when(F.col("window_start").isNull(), "no_essential_data")
               .when(F.col("window_start") > F.col("window_end"), "no_overlap"))
    return w.withColumn("problem", problem)


def window_trim_report(weekly: DataFrame, window: DataFrame, keys: list[str]) -> DataFrame:
    """Weeks each source loses before and after the window, and whether it pins an edge."""
    weeks = weekly.select(*keys, "source", WEEK).distinct()
    j = weeks.join(window.where(F.col("problem").isNull()), keys)
    start, end = F.first("window_start"), F.first("window_end")
    return j.groupBy(*keys, "source").agg(
        F.count_if(F.col(WEEK) < F.col("window_start")).alias("weeks_before"),
        F.count_if(F.col(WEEK) > F.col("window_end")).alias("weeks_after"),
        (F.min(WEEK) == start).alias("pins_start"), (F.max(WEEK) == end).alias("pins_end"))


def window_issues(weekly: DataFrame, window: DataFrame, keys: list[str], essential: list[str]) -> DataFrame:
    """(keys, source, column, n, code, severity): which essential source sets which edge of the window, and the weeks of
    each source that lie outside."""
    r = window_trim_report(weekly, window, keys)
    outside = F.col("weeks_before") + F.col("weeks_after")
    lost = r.where(outside > 0).select(*keys, "source", F.lit(None).cast("string").alias("column"), outside.alias("n"), F.lit("source_window_trimmed").alias("code"))
    edges = F.array_compact(F.array(F.when(F.col("pins_start"), "start"), F.when(F.col("pins_end"), "end")))
    pins = r.where(F.col("source").isin(*essential)).select(*keys, "source", F.explode(edges).alias("column"), F.lit(None).cast("long").alias("n"),
                                                            F.lit("window_boundary").alias("code"))
    return lost.unionByName(pins).withColumn("severity", F.lit("info"))


def reindex_grid(weekly: DataFrame, window: DataFrame, keys: list[str]) -> DataFrame:
    """Every series on every week of its panel's window; absent weeks are NULL."""
    weeks = F.explode(F.sequence("window_start", "window_end", F.expr("interval 7 days")))
    grid = (weekly.select(*keys, "series", "role").distinct()
            .join(window.where(F.col("problem").isNull()).select(*keys, "window_start", "window_end"), keys)
            .select(*keys, "series", "role", weeks.alias(WEEK)))
    cells = weekly.select(*keys, "series", WEEK, "value")
    return (grid.join(cells, [*keys, "series", WEEK], "left")
            .select(*keys, WEEK, "series", "role", "value"))


def impute_spend(master: DataFrame) -> DataFrame:
    zero = (F.col("role") == "spend") & F.col("value").isNull()
    return master.withColumn("value", F.when(zero, F.lit(0.0)).otherwise(F.col("value")))


def imputation_report(master: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of spend weeks set to zero, from the table before imputation."""
    return (master.where((F.col("role") == "spend") & F.col("value").isNull())
            .groupBy(*keys, "series").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("code", F.lit("spend_imputed_zero")))


def gap_report(master: DataFrame, keys: list[str], filled: list[str] = ()) -> DataFrame:
    """Empty outcome weeks, and empty control weeks of controls without a fill."""
    gap = F.col("value").isNull() & (
        (F.col("role") == "kpi") | ((F.col("role") == "control") & ~F.col("series").isin(*filled)))
    weeks = F.array_sort(F.collect_list(WEEK))
    return (master.where(gap).groupBy(*keys, "series", "role")
            .agg(F.count(F.lit(1)).alias("n"), F.min(WEEK).alias("first_week"),
                 F.max(WEEK).alias("last_week"), weeks.alias("weeks"))
            .withColumn("code", F.concat("role", F.lit("_gaps"))))


def filled(strategy: str, keys: list[str]) -> Column:
    """Value column after one of the six fills; an all-empty series stays empty."""
    v, w = F.col("value"), series_window(keys)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    last, nxt = F.last(v, ignorenulls=True).over(back), F.first(v, ignorenulls=True).over(ahead)
    if strategy == "zero":
        return F.coalesce(v, F.lit(0.0))
    if strategy == "ffill":
        return F.coalesce(v, last, nxt)
    if strategy == "bfill":
        return F.coalesce(v, nxt, last)
    if strategy == "mean":
        return F.coalesce(v, F.avg(v).over(whole_series(keys)))
    if strategy == "median":
        return F.coalesce(v, F.percentile(v, F.lit(0.5)).over(whole_series(keys)))
    if strategy == "interpolate":
        # weeks are gap-free, so the day number is the row position times seven
        day = F.unix_date(WEEK)
        known = F.when(v.isNotNull(), day)
        d0, d1 = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(ahead)
        line = last + (nxt - last) * (day - d0) / F.nullif(d1 - d0, F.lit(0))
        return F.coalesce(v, line, last, nxt)
    raise ValueError(f"unknown fill {strategy!r}")


def fill_missing(master: DataFrame, keys: list[str], strategy: str, series: list[str] | None = None) -> DataFrame:
    target = F.lit(True) if series is None else F.col("series").isin(*series)
    return master.withColumn("value", F.when(target, filled(strategy, keys)).otherwise(F.col("value")))


def event_dummies(master: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """0/1 control series. ``events``: (keys, name, iso_year, iso_week)."""
    weeks = master.select(*keys, WEEK).distinct()
    marked = events.select(*keys, "name", monday_of(F.col("iso_year"), F.col("iso_week")).alias(WEEK),
                           F.lit(1.0).alias("hit")).distinct()
    names = events.select(*keys, "name").distinct()
    return (names.join(weeks, keys).join(marked, [*keys, "name", WEEK], "left")
            .select(*keys, WEEK, F.col("name").alias("series"), F.lit("control").alias("role"),
                    F.coalesce("hit", F.lit(0.0)).alias("value")))


def event_issues(dummies: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """Names that clash with a series, and events without a week in the window."""
    clash = (dummies.select(*keys, "series").distinct().join(taken, [*keys, "series"], "left_semi")
             .withColumn("code", F.lit("event_dummy_name_collision")))
    empty = (dummies.groupBy(*keys, "series").agg(F.max("value").alias("m")).where(F.col("m") == 0)
             .drop("m").withColumn("code", F.lit("event_dummy_outside_window")))
    return clash.unionByName(empty)


def verdict(issues: DataFrame, keys: list[str]) -> DataFrame:
    rank = F.max(F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0))
    return issues.groupBy(*keys).agg(
        F.when(rank == 2, "not_usable").when(rank == 1, "usable_with_warnings")
        .otherwise("usable").alias("verdict"))
