"""The ten raw-table transforms and the fold that applies a declared list of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.frames import require_columns
from tidemark.functions.dates import parse_date
from tidemark.functions.numbers import to_number
from tidemark.types import Transform, issue_frame


def rename(df: DataFrame, source: str, to: str) -> DataFrame:
    require_columns(df, source)
    return df.withColumnRenamed(source, to)


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def row_test(df: DataFrame, column: str, compare: str, value=None, values=None) -> Column:
    """The predicate of ``filter_rows``; NULL never leaks out of it."""
    require_columns(df, column)
    c = F.col(column)
    number = c.cast("double") if dict(df.dtypes)[column] != "string" else to_number(c)
    if compare in ("lt", "le", "gt", "ge"):
        test = {"lt": number < value, "le": number <= value,
                "gt": number > value, "ge": number >= value}[compare]
        return F.coalesce(test, F.lit(False))
    if compare == "eq":
        return F.coalesce(c.cast("string") == str(value), F.lit(False))
    if compare == "ne":
        return F.coalesce(c.cast("string") != str(value), F.lit(True))
    if compare == "in":
        return F.coalesce(c.isin(list(values)), F.lit(False))
    if compare == "not_in":
        return F.coalesce(~c.isin(list(values)), F.lit(True))
    if compare == "contains":
        return F.coalesce(c.cast("string").rlike(value), F.lit(False))
    raise ValueError(f"unknown comparison {compare!r}")


def filter_rows(df: DataFrame, column: str, compare: str, value=None, values=None) -> DataFrame:
    return df.where(row_test(df, column, compare, value, values))


def drop_duplicates(df: DataFrame, subset: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Keep the first row per subset. An aggregate, so a hot subset is reduced map-side."""
    if subset is None:
        return df.dropDuplicates()
    if order is None:
        raise ValueError("keeping the first row needs an order column")
    require_columns(df, *subset, order)
    rest = [c for c in df.columns if c not in subset]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("_row")
    kept = df.groupBy(*subset).agg(first).select(*subset, "_row.*")
    return kept.select(*df.columns)


def scale(df: DataFrame, column: str, factor: float, offset: float = 0.0) -> DataFrame:
    require_columns(df, column)
    return df.withColumn(column, _number(df, column) * F.lit(float(factor)) + F.lit(float(offset)))


def combine(df: DataFrame, columns: list[str], into: str, how: str, sep: str = " ") -> DataFrame:
    require_columns(df, *columns)
    if how == "concat":
        return df.withColumn(into, F.concat_ws(sep, *[F.col(c).cast("string") for c in columns]))
    if how == "sum":
        parts = [F.coalesce(_number(df, c), F.lit(0.0)) for c in columns]
        return df.withColumn(into, reduce(lambda a, b: a + b, parts))
    if how == "product":
        parts = [F.coalesce(_number(df, c), F.lit(1.0)) for c in columns]
        return df.withColumn(into, reduce(lambda a, b: a * b, parts))
    raise ValueError(f"unknown combination {how!r}")


def split(df: DataFrame, column: str, into_columns: list[str], sep: str) -> DataFrame:
    """A one-character separator is literal, a longer one is a pattern; short rows give NULL."""
    require_columns(df, column)
    pattern = f"\\Q{sep}\\E" if len(sep) == 1 else sep
    parts = F.split(F.col(column).cast("string"), pattern, len(into_columns) + 1)
    return df.withColumns({name: F.get(parts, F.lit(i)) for i, name in enumerate(into_columns)})


def recode(df: DataFrame, column: str, mapping: dict[str, str], default: str | None = None) -> DataFrame:
    require_columns(df, column)
    text = F.col(column).cast("string")
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    other = text if default is None else F.lit(default)
    return df.withColumn(column, F.coalesce(F.element_at(pairs, text), other))


def recode_by_table(df: DataFrame, column: str, table: DataFrame, default: str | None = None) -> DataFrame:
    """``recode`` for mappings that are data: ``table`` has ``from_value`` and ``to_value``."""
    joined = df.join(table, F.col(column).cast("string") == F.col("from_value"), "left")
    other = F.col(column).cast("string") if default is None else F.lit(default)
    return joined.withColumn(column, F.coalesce("to_value", other)).drop("from_value", "to_value")


def parse_dates(df: DataFrame, column: str, format: str | None = None, dayfirst: bool = False) -> DataFrame:
    require_columns(df, column)
    return df.withColumn(column, parse_date(F.col(column), format, dayfirst))


def pivot(df: DataFrame, index: list[str], columns: str, values: str, aggfunc: str = "sum",
          names: list[str] | None = None) -> DataFrame:
    """Long to wide. Give ``names`` to keep the plan lazy; else Spark looks them up."""
    require_columns(df, *index, columns, values)
    agg = {"sum": F.sum, "mean": F.avg}[aggfunc]
    listed = sorted(names) if names is not None else None
    return df.groupBy(*index).pivot(columns, listed).agg(agg(values))


TRANSFORMS = {
    "rename": lambda df, p: rename(df, p["from"], p["to"]),
    "drop_columns": lambda df, p: drop_columns(df, p["columns"]),
    "filter_rows": lambda df, p: filter_rows(df, **p),
    "drop_duplicates": lambda df, p: drop_duplicates(df, **p),
    "scale": lambda df, p: scale(df, **p),
    "combine": lambda df, p: combine(df, **p),
    "split": lambda df, p: split(df, **p),
    "recode": lambda df, p: recode(df, p["column"], _pairs(p["mapping"]), p.get("default")),
    "parse_date": lambda df, p: parse_dates(df, **p),
    "pivot": lambda df, p: pivot(df, **{**p, "index": _listed(p["index"])}),
}


def _pairs(mapping) -> dict[str, str]:
    """A recode mapping is a dict or a list of {from, to}."""
    return mapping if isinstance(mapping, dict) else {m["from"]: m["to"] for m in mapping}


def _listed(names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def apply_transforms(df: DataFrame, specs: list[Transform], source: str) -> tuple[DataFrame, DataFrame]:
    """Apply the list in order; one that cannot be planned is reported and skipped."""
    notes = []
    for spec in specs:
        try:
            df = TRANSFORMS[spec.op](df, spec.params)
            notes.append(("transform_applied", "info", source, None, None, {"op": spec.op}))
        except (KeyError, TypeError, ValueError) as exc:
            notes.append(("transform_error", "error", source, None, None,
                          {"op": spec.op, "reason": str(exc)}))
    return df, issue_frame(df.sparkSession, notes)


def _number(df: DataFrame, column: str) -> Column:
    c = F.col(column)
    return to_number(c) if dict(df.dtypes)[column] == "string" else c.cast("double")
