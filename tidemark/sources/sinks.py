"""Sinks: master tables with a manifest, previews, JSON-safe rows, draw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.frames import WEEK, finite


def content_hash(df: DataFrame, keys: list[str]) -> DataFrame:
    """Order-free fingerprint per panel: the same rows give the same number.

    Row hashes are added up (columns in name order), so neither row nor column order shows and
    copies of a row count.
    """
    row = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(F.sum(row).cast("string").alias("content_hash"), F.count(F.lit(1)).alias("n_rows"))


def manifest(master: DataFrame, keys: list[str]) -> DataFrame:
    """Per panel: fingerprint, window, number of weeks, series per role."""
    facts = master.groupBy(*keys).agg(
        F.min(WEEK).alias("window_start"), F.max(WEEK).alias("window_end"), F.count_distinct(WEEK).alias("n_weeks"),
        *[F.count_distinct(F.when(F.col("role") == r, F.col("series"))).alias(f"n_{r}") for r in ("kpi", "spend", "control")])
    return facts.join(content_hash(master, keys), keys)


def write_sorted(df: DataFrame, path: str, order: list[str], partition_by: list[str] = ()) -> None:
    """Parquet in ranges of ``order``: readers skip files by their statistics, a large key is
    split over files, and many small keys share one. ``partition_by`` adds folders; give it only
    columns with few values.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_master(master: DataFrame, keys: list[str], path: str, partition_by: list[str] = ()) -> DataFrame:
    """Write the table by panel and return the manifest of what was written."""
    write_sorted(master, f"{path}/data", [*keys, "series", WEEK], partition_by)
    written = master.sparkSession.read.schema(master.schema).parquet(f"{path}/data")
    manifest(written, keys).write.mode("overwrite").parquet(f"{path}/manifest")
    return master.sparkSession.read.parquet(f"{path}/manifest")


def preview_columns(master: DataFrame, keys: list[str]) -> DataFrame:
    return master.groupBy(*keys, "series", "role").agg(
        F.count_if(F.col("value").isNull()).alias("n_missing"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"))


def preview_rows(master: DataFrame, keys: list[str], n: int = 6) -> DataFrame:
    """First and last weeks of each series."""
    w = Window.partitionBy(*keys, "series")
    d = (master.withColumn("_a", F.row_number().over(w.orderBy(WEEK)))
         .withColumn("_b", F.row_number().over(w.orderBy(F.desc(WEEK)))))
    return d.where((F.col("_a") <= n) | (F.col("_b") <= n)).drop("_a", "_b")


def json_safe(df: DataFrame) -> DataFrame:
    """Non-finite numbers become NULL in every double and float column."""
    names = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({n: finite(F.col(n)) for n in names})


def to_json_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    safe = json_safe(df)
    return safe.select(*keys, F.to_json(F.struct(*[c for c in safe.columns if c not in keys])).alias("json"))


def write_draws(draws: DataFrame, path: str, run: str = "run", partition_by: list[str] = ()) -> DataFrame:
    """Store a draw table next to its summary, a run's draws close together."""
    write_sorted(draws, path, [run, "draw"], partition_by)
    return draws.sparkSession.read.parquet(path)
