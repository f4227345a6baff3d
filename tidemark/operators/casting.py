"""Number style detection, declared-column projection, name collisions, number checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark import fixed_values as fx
from tidemark.functions.numbers import en_number, nl_number, numbers_in, to_number, without_currency
from tidemark.types import ColumnSpec, issue_frame


def number_styles(cells: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """One row per (keys) with the notation its failing values share.

    ``cells`` holds one text cell per row; ``keys`` names the column it came from. A single
    partial aggregate, whatever the number of rows behind a column.
    """
    text = F.trim(F.col(raw))
    clean = without_currency(F.col(raw))
    full = text.isNotNull() & (text != "")
    failed = full & to_number(text).isNull()

    def count(test):
        return F.count_if(F.coalesce(test, F.lit(False)))

    n = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), count(full).alias("n_full"),
        count(failed).alias("n_failed"),
        count(failed & clean.rlike(fx.NL_NUMBER)).alias("n_nl"),
        count(failed & clean.rlike(fx.EN_NUMBER)).alias("n_en"),
        count(full & to_number(text).isNotNull()).alias("ok_plain"),
        count(full & nl_number(clean).isNotNull()).alias("ok_nl"),
        count(full & en_number(clean).isNotNull()).alias("ok_en"),
        count(full & to_number(clean).isNotNull()).alias("ok_cur"))
    share = fx.STYLE_SHARE
    guess = (F.when((F.col("n_full") == 0) | (F.col("n_failed") == 0), "plain")
             .when((F.col("n_nl") >= share * F.col("n_failed")) & (F.col("n_nl") >= F.col("n_en")), "NL")
             .when(F.col("n_en") >= share * F.col("n_failed"), "EN")
             .when(F.col("ok_cur") >= share * F.col("n_rows"), "currency")
             .otherwise("plain"))
    won = (F.when(F.col("guess") == "NL", F.col("ok_nl")).when(F.col("guess") == "EN", F.col("ok_en"))
           .when(F.col("guess") == "currency", F.col("ok_cur")).otherwise(F.col("ok_plain")))
    accepted = (won >= share * F.col("n_full")) & (won > F.col("ok_plain"))
    return (n.withColumn("guess", guess)
            .select(*keys, F.when(accepted, F.col("guess")).otherwise("plain").alias("style"),
                    "n_rows", "n_full", "n_failed"))


def parse_in_style(cells: DataFrame, styles: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """Apply each column's style to all of its cells: adds ``value``."""
    clean = without_currency(F.col(raw))
    value = (F.when(F.col("style") == "NL", nl_number(clean))
             .when(F.col("style") == "EN", en_number(clean))
             .when(F.col("style") == "currency", to_number(clean))
             .otherwise(to_number(F.col(raw))))
    return cells.join(styles.select(*keys, "style"), keys).withColumn("value", value)


def coerce_cells(cells: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    return parse_in_style(cells, number_styles(cells, keys, raw), keys, raw)


def style_issues(styles: DataFrame, keys: list[str], column: str) -> DataFrame:
    return (styles.where(F.col("style") != "plain")
            .select(*keys, F.lit("currency_parsed").alias("code"), F.lit("info").alias("severity"),
                    F.col(column).alias("column"), F.col("n_failed").alias("n"), "style"))


def project_declared(df: DataFrame, source: str, columns: list[ColumnSpec],
                     ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """Declared columns that exist, under their output names, plus one issue per absent one."""
    present = [c for c in columns if c.name in df.columns]
    absent = [(("missing_column"), "error", source, c.name, None, None)
              for c in columns if c.name not in df.columns]
    kept = df.select(*ids, *[F.col(c.name).alias(c.series) for c in present])
    return kept, issue_frame(df.sparkSession, absent)


def rename_collisions(columns: DataFrame, keys: list[str]) -> DataFrame:
    """``columns``: (keys, source, series). A name in two sources is prefixed in each."""
    n = columns.groupBy(*keys, "series").agg(F.count_distinct("source").alias("_n"))
    name = F.when(F.col("_n") > 1, F.concat_ws("_", "source", "series")).otherwise(F.col("series"))
    return columns.join(n, [*keys, "series"]).withColumn("final_name", name).drop("_n")


def missing_columns(declared: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    return declared.join(present, on, "left_anti")


def number_check(texts: DataFrame, text: str, facts: DataFrame, keys: list[str],
                 window: DataFrame) -> DataFrame:
    """Numbers in a text that no fact of the same keys explains.

    ``facts``: (keys, fact); ``window``: (keys, year) years the text may name. Facts count as
    is, x100 and /100. Both sides are cut into logarithmic steps of 2%. A fact in the number's
    own step explains it; below it only the largest fact can, above it only the smallest. So
    facts shrink to three values per step and the join is one row to one row.
    """
    tol = fx.TEXT_TOLERANCE
    step = F.log(F.lit(1.0 + tol))
    forms = F.array(F.abs("fact"), F.abs(F.col("fact") * 100), F.abs(F.col("fact") / 100))
    f = (facts.select(*keys, F.explode(forms).alias("fact")).where(F.col("fact") > 0)
         .withColumn("_at", F.floor(F.log("fact") / step))
         .withColumn("_off", F.explode(F.array(*[F.lit(i) for i in (-2, -1, 0, 1, 2)])))
         .withColumn("_step", F.col("_at") + F.col("_off")))
    near = f.groupBy(*keys, "_step").agg(
        F.max(F.when(F.col("_off") > 0, F.col("fact"))).alias("_below"),
        F.max(F.when(F.col("_off") == 0, F.col("fact"))).alias("_same"),
        F.min(F.when(F.col("_off") < 0, F.col("fact"))).alias("_above"))
    numbers = (numbers_in(texts, text).where(F.col("number") > fx.TEXT_SMALL_NUMBER)
               .withColumn("_step", F.floor(F.log("number") / step)))
    years = window.select(*keys, F.col("year").cast("double").alias("number")).distinct()

    def close(c: str):
        return F.coalesce(F.abs(F.col(c) - F.col("number")) <= tol * F.greatest(F.lit(1.0), F.col(c)),
                          F.lit(False))

    return (numbers.join(years, [*keys, "number"], "left_anti")
            .join(near, [*keys, "_step"], "left")
            .where(~(close("_below") | close("_same") | close("_above")))
            .drop("_step", "_below", "_same", "_above"))
