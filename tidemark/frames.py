"""Helpers shared by the operators: panel keys, windows, nulls, long and wide form.

Every operator takes ``keys``: one or more columns that name a panel (a brand in a market,
a project, ...). Single-panel data gets a constant key from :func:`with_panel`, so joins are
always equi-joins and nothing degenerates to a global window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.window import WindowSpec

from tidemark.session import scratch

WEEK = "week_start"


def with_panel(df: DataFrame, name: str = "all", key: str = "panel") -> DataFrame:
    return df.withColumn(key, F.lit(name))


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"column(s) {missing} not in {df.columns}")


def series_window(keys: list[str], order: str = WEEK) -> WindowSpec:
    """One series per panel in calendar order; its length is bounded by the calendar."""
    return Window.partitionBy(*keys, "series").orderBy(order)


def whole_series(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys, "series")


def finite(c: Column) -> Column:
    """NaN and the infinities become NULL; NULL is the only missing value."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def quantile(c: Column, q: float) -> Column:
    """Exact linear-interpolation quantile, for groups bounded by weeks or draws."""
    return F.percentile(c, F.lit(q))


def over(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 (ANSI mode would fail the query)."""
    return a / F.nullif(b, F.lit(0.0))


def correlation(a: str, b: str) -> Column:
    """Pearson r over complete pairs; NULL where either side does not vary.

    ``corr`` itself divides by zero there.
    """
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return over(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def melt(df: DataFrame, ids: list[str], columns: list[str], name: str = "series",
         value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def to_wide(long: DataFrame, keys: list[str], series: list[str], order: str = WEEK) -> DataFrame:
    """One column per named series; the list is explicit so no extra job finds it."""
    cells = [F.max(F.when(F.col("series") == s, F.col("value"))).alias(s) for s in series]
    return long.groupBy(*keys, order).agg(*cells)


def to_long(wide: DataFrame, keys: list[str], roles: dict[str, str], order: str = WEEK) -> DataFrame:
    out = melt(wide, [*keys, order], list(roles))
    role = reduce(lambda acc, kv: acc.when(F.col("series") == kv[0], kv[1]),
                  roles.items(), F.when(F.lit(False), F.lit("")))
    return out.withColumn("role", role).select(*keys, order, "series", "role", "value")


def lookup(c: Column, table: dict, default=None) -> Column:
    """A small fixed table as a CASE expression; needs no join."""
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out if default is None else out.otherwise(F.lit(default))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back.

    Later plans start from files: short lineage, nothing to recompute when an executor is lost,
    and columns and filters still reach the scan.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- order over unbounded rows -----------------------------------------------------------
# A window over all rows of a source would put one source in one task. These helpers range-sort
# the rows over all tasks first, work inside each range, and carry a one-row summary per range
# across the cuts.


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """``df`` cut into ranges of ``order``, with ``_range`` numbering them; written once and read back.

    Spark samples the cuts; there are as many ranges as the session has shuffle partitions for, so their number
    follows the data and a hot key is cut like any other. ``_range`` is stored since it is the number of the task
    that wrote the row: another plan, or a lost task run again, could number otherwise.
    """
    return stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")


def _ordered_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Ranges of (keys, order, row number): rows that share one value of ``order`` are told apart and cut too.

    ``_key`` is the panel as one value that is never null, so panels with a null key are joined like others.
    """
    rows = in_ranges(df.withColumn("_tie", F.monotonically_increasing_id()), *keys, order, "_tie")
    return rows.withColumn("_key", F.struct(F.lit(0).alias("_"), *keys))


def previous_in_order(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """``lag(value)`` over ``order`` per panel, for panels of any size."""
    rows = _ordered_rows(df, keys, order)
    inside = Window.partitionBy("_key", "_range").orderBy(order, "_tie")
    last = (rows.groupBy("_key", "_range").agg(F.max_by(value, F.struct(order, "_tie")).alias("_last"))
            .withColumn("_carry", F.lag("_last").over(Window.partitionBy("_key").orderBy("_range"))).drop("_last"))
    return (rows.withColumns({"_in": F.lag(value).over(inside), "_first": F.row_number().over(inside) == 1})
            .join(last, ["_key", "_range"], "left")
            .withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_in")))
            .drop("_in", "_first", "_carry", "_range", "_key", "_tie"))


def running_totals(df: DataFrame, keys: list[str], order: str, amounts: dict[str, Column]) -> DataFrame:
    """Cumulative sums in ``order`` per panel, one per entry of ``amounts``, for panels of any size."""
    names = list(amounts)
    rows = _ordered_rows(df.withColumns({f"_a_{n}": c for n, c in amounts.items()}), keys, order)
    earlier = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_key", "_range").agg(*[F.sum(f"_a_{n}").alias(f"_t_{n}") for n in names])
    before = before.select("_key", "_range", *[
        F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in names])
    upto = (Window.partitionBy("_key", "_range").orderBy(order, "_tie")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = rows.withColumns({f"_i_{n}": F.sum(f"_a_{n}").over(upto) for n in names})
    return (inside.join(before, ["_key", "_range"])
            .withColumns({n: F.col(f"_i_{n}") + F.col(f"_b_{n}") for n in names})
            .drop("_range", "_key", "_tie", *[f"_{x}_{n}" for n in names for x in "aib"]))


def running_total(df: DataFrame, keys: list[str], order: str, amount: Column, out: str) -> DataFrame:
    return running_totals(df, keys, order, {out: amount})


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact linear quantiles of groups of any size: ``(*group, p, q)``.

    Equal values are counted before anything else, the counts are range-sorted, and only the ranges
    that hold a wanted rank are numbered. No task ever holds a whole group.
    """
    rows = df.where(F.col(value).isNotNull()).select(*group, value)
    counts = in_ranges(rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c")), *group, value)
    in_group = Window.partitionBy(*group)
    spans = (counts.groupBy(*group, "_range").agg(F.sum("_c").alias("_rows"))
             .withColumn("_from", F.coalesce(F.sum("_rows").over(
                 in_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("_n", F.sum("_rows").over(in_group)))
    wanted = (spans.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
              .withColumn("_pos", (F.col("_n") - 1) * F.col("p"))
              .withColumn("_lo", F.floor("_pos")).withColumn("_hi", F.ceil("_pos"))
              .where((F.col("_hi") >= F.col("_from")) &
                     (F.col("_lo") < F.col("_from") + F.col("_rows")))
              .select(*group, "_range", "_from", "p", "_pos", "_lo", "_hi"))
    touched = wanted.select(*group, "_range", "_from").distinct()
    upto = F.sum("_c").over(Window.partitionBy(*group, "_range").orderBy(value)
                            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = (counts.join(touched, [*group, "_range"])
              .withColumn("_to", F.col("_from") + upto).drop("_from"))
    hits = ranked.join(wanted, [*group, "_range"])

    def at(rank: str) -> Column:
        return F.max(F.when((F.col(rank) < F.col("_to")) &
                            (F.col(rank) >= F.col("_to") - F.col("_c")), F.col(value)))

    return (hits.groupBy(*group, "p", "_pos", "_lo").agg(at("_lo").alias("_a"), at("_hi").alias("_b"))
            .select(*group, "p",
                    (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.col("_lo"))).alias("q")))


def literal_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A DataFrame of declared values (specs, vocabularies), never of data."""
    return spark.createDataFrame(rows, schema)
