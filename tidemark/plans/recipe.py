"""From a declared recipe to a weekly dataset: the whole build for named source frames.

A recipe is a document of sources (transforms, date column, columns with roles), event dummies
and features. The weekly rows are stored once; data, issues and verdict are lazy plans over them.
Only facts about the layout (the date column, when it has to be found) are read on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import fixed_values as fx
from tidemark.frames import WEEK, literal_frame, stored, to_long, to_wide, union_all
from tidemark.functions.dates import parse_date, week_start
from tidemark.functions.numbers import en_number, nl_number, to_number, without_currency
from tidemark.operators import casting as cs, features as ft, quality as ql, roles as rl, weekly as wk
from tidemark.operators.transforms import apply_transforms
from tidemark.plans.master import from_weekly, quality_verdict
from tidemark.types import ColumnSpec, EventDummy, Feature, SourceSpec, Transform, issue_frame, spec_problems


@dataclass(frozen=True)
class Recipe:
    sources: tuple[SourceSpec, ...]
    event_dummies: tuple[EventDummy, ...] = ()
    features: tuple[Feature, ...] = ()


def parse_recipe(doc: dict) -> Recipe:
    """Read a recipe document; what is missing or unknown raises ``KeyError`` or a ``ValueError`` that names every problem."""
    if not doc.get("sources"):
        raise ValueError("a recipe needs at least one source")
    sources = tuple(SourceSpec(
        name=s["name"], date_column=s.get("date_column"), essential=bool(s.get("essential", True)),
        transforms=tuple(Transform(t["op"], t.get("params") or {}) for t in s.get("transforms") or ()),
        columns=tuple(ColumnSpec(c["name"], c["role"], c.get("output_name"), c.get("fill")) for c in s["columns"]))
        for s in doc["sources"])
    if problems := spec_problems(sources):
        raise ValueError("; ".join(f"{code}: {source}{f'.{column}' if column else ''}" for code, source, column in problems))
    events = tuple(EventDummy(e["name"], tuple((int(y), int(w)) for y, w in e["weeks"])) for e in doc.get("event_dummies") or ())
    features = tuple(Feature(f["name"], f["op"], tuple(f.get("inputs") or ()), f.get("params") or {}) for f in doc.get("features") or ())
    return Recipe(sources, events, features)


@dataclass(frozen=True)
class Dataset:
    """``data`` is the weekly long table with features; ``issues`` has one row per finding."""

    data: DataFrame
    window: DataFrame
    issues: DataFrame
    verdict: DataFrame
    roles: dict[str, str] = field(default_factory=dict)


def find_date_column(df: DataFrame, keys: list[str]) -> str:
    """Best-parsing column by score, name hint first; raises when none qualifies."""
    columns = [c for c in df.columns if c not in keys]
    ready = [c for c, t in df.dtypes if c in columns and t in ("date", "timestamp", "timestamp_ntz")]
    hinted = [c for c in ready if any(h in c.lower() for h in fx.DATE_HINTS)]
    if hinted or ready:
        return (hinted or ready)[0]
    at = reduce(lambda acc, ic: F.when(F.col("column") == ic[1], ic[0]).otherwise(acc), enumerate(columns), F.lit(0))
    cells = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "raw")
    scores = rl.date_score(cells.withColumn("position", at).withColumn("source", F.lit("s")), ["source", "column", "position"])
    found = rl.detect_date_column(scores, ["source"], "column", "position").collect()
    if not found:
        raise ValueError("no column reads as a date; name one")
    return found[0]["date_column"]


def as_timestamp(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.col(column).cast("timestamp")
    if kind in ("int", "bigint", "smallint", "tinyint"):
        text = F.col(column).cast("string")
        return F.when(text.rlike("^[0-9]{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    return parse_date(F.col(column))


def numeric_columns(df: DataFrame, columns: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Declared columns as doubles; text columns in the notation their failing values share."""
    types = dict(df.dtypes)
    texts = [c for c in columns if types[c] == "string"]
    plain = {c: F.col(c).cast("double") for c in columns if c not in texts}
    if not texts:
        return df.withColumns(plain), None
    cells = df.select(*keys, *texts).unpivot(keys, texts, "column", "raw")
    styles = cs.number_styles(cells, [*keys, "column"])
    wide = styles.groupBy(*keys).agg(*[F.max(F.when(F.col("column") == c, F.col("style"))).alias(f"_style_{c}") for c in texts])
    parsed = {}
    for c in texts:
        clean, style = without_currency(F.col(c)), F.col(f"_style_{c}")
        parsed[c] = (F.when(style == "NL", nl_number(clean)).when(style == "EN", en_number(clean))
                     .when(style == "currency", to_number(clean)).otherwise(to_number(F.col(c))))
    out = df.join(wide, keys, "left").withColumns({**plain, **parsed}).drop(*[f"_style_{c}" for c in texts])
    return out, cs.style_issues(styles, keys, "column")


def role_findings(rows: DataFrame, roles: dict[str, str], keys: list[str], order: str) -> DataFrame:
    """Findings about declared columns, as issues: those that are a plain statement about the values stop a build, hints
    (a column that looks like an identifier) warn. ``rows`` holds the columns as they were read."""
    names = list(roles)
    extra = [c for c in ("_copies",) if c in rows.columns]
    cells = rows.select(*keys, order, *extra, *[F.col(c).cast("string").alias(c) for c in names]).unpivot([*keys, order, *extra], names, "column", "raw")
    panels = rows.select(*keys).distinct()
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(r).alias("role")) for c, r in roles.items()]))
    at = [*keys, "column"]
    found = rl.role_gate(rl.validate_roles(panels.select(*keys, each), rl.column_facts(cells, at, order), at))
    return found.select(*at, "code", "severity")


def prepare_source(df: DataFrame, spec: SourceSpec, keys: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """One source to weekly long rows: transforms, dates, copies, roles, numbers, one wide aggregate.

    The source is read once, into a stored table of its different rows; every rule and the weekly sums follow from that,
    those about dates and numbers of rows from its days.
    Sums are taken with and without copies, and which counts is decided on weekly rows.
    """
    df, notes = apply_transforms(df, list(spec.transforms), spec.name)
    date = spec.date_column or find_date_column(df, keys)
    if date not in df.columns:
        raise KeyError(f"date column {date!r} not in source {spec.name!r}")
    present = [c for c in spec.columns if c.name in df.columns]
    absent = [("missing_column", "error", spec.name, c.name, None, None) for c in spec.columns if c.name not in df.columns]
    dated = df.withColumn("_ts", as_timestamp(df, date))
    whole = [c for c in dated.columns if c not in ("ingest_id",)]
    rows = stored(wk.different_rows(dated, keys, "_ts", whole, list(dict.fromkeys([date, *[c.name for c in present]]))), "rows")
    good = wk.drop_bad_dates(rows, "_ts")
    days = stored(wk.rows_per_day(rows, keys, "_ts"), "days")
    known = wk.drop_bad_dates(days, "_ts")
    issues = [notes, wk.bad_date_issues(days, keys, "_ts"), wk.copy_issues(known, keys, "_ts"), ql.duplicate_dates(known, keys, "_ts", whole),
              ql.partial_edge_weeks(known, keys, "_ts"), ql.coarse_cadence(known, keys, "_ts"),
              role_findings(rows, {**{c.name: c.role for c in present}, date: "date"}, keys, "_first")]
    numbers, styles = numeric_columns(good, [c.name for c in present], keys)
    if styles is not None:
        issues.append(styles)
    if absent:
        issues.append(issue_frame(df.sparkSession, absent))
    n = F.col("_copies").cast("double")

    def sums(c: ColumnSpec) -> list[Column]:
        v = F.col(c.name)
        seen = F.when(v.isNotNull(), n)
        if c.role == "control":
            return [F.avg(v).alias(f"_one_{c.series}"), (F.sum(v * n) / F.sum(seen)).alias(f"_all_{c.series}")]
        return [F.coalesce(F.sum(v), F.lit(0.0)).alias(f"_one_{c.series}"), F.coalesce(F.sum(v * n), F.lit(0.0)).alias(f"_all_{c.series}")]

    weekly = numbers.groupBy(*keys, week_start(F.col("_ts")).alias(WEEK)).agg(*[x for c in present for x in sums(c)])
    weekly = weekly.join(wk.keeps_copies(known, keys, "_ts"), keys, "left")
    weekly = weekly.select(*keys, WEEK, *[F.when(F.coalesce("keeps", F.lit(False)), F.col(f"_all_{c.series}")).otherwise(F.col(f"_one_{c.series}")).alias(c.series)
                                          for c in present])
    long = to_long(weekly, keys, {c.series: c.role for c in present}).withColumn("source", F.lit(spec.name))
    return long, [i.withColumn("source", F.lit(spec.name)) for i in issues]


def collision_names(specs: tuple[SourceSpec, ...]) -> dict[tuple[str, str], str]:
    """Names used by two sources get the source in front, in each of them."""
    seen: dict[str, int] = {}
    for s in specs:
        for c in s.columns:
            seen[c.series] = seen.get(c.series, 0) + 1
    return {(s.name, c.series): f"{s.name}_{c.series}" if seen[c.series] > 1 else c.series for s in specs for c in s.columns}


def build_dataset(frames: dict[str, DataFrame], recipe: Recipe, keys: list[str]) -> Dataset:
    """Sources by name to the finished dataset with its issues and verdict."""
    spark = next(iter(frames.values())).sparkSession
    names = collision_names(recipe.sources)
    parts, issues, roles, fills = [], [], {}, {}
    for spec in recipe.sources:
        long, found = prepare_source(frames[spec.name], spec, keys)
        for c in spec.columns:
            final = names[(spec.name, c.series)]
            roles[final] = c.role
            if c.fill:
                fills[final] = c.fill
            if final != c.series:
                long = long.withColumn("series", F.when(F.col("series") == c.series, final).otherwise(F.col("series")))
                found.append(literal_frame(spark, [("column_name_collision", "warning", spec.name, c.series)],
                                           "code string, severity string, source string, `column` string"))
        parts.append(long)
        issues += found
    # the one pass over the raw sources ends here; everything after starts from the weekly rows
    weekly = stored(union_all(parts).select(*keys, "source", WEEK, "series", "role", "value"), "weekly")
    m = from_weekly(weekly, keys, [s.name for s in recipe.sources if s.essential])
    issues += [m.window.where(F.col("problem").isNotNull()).select(*keys, F.col("problem").alias("code"), F.lit("error").alias("severity")),
               wk.gap_report(m.gappy, keys, list(fills)).withColumn("severity", F.lit("warning")),
               wk.imputation_report(m.gappy, keys).withColumn("severity", F.lit("info")),
               wk.window_issues(weekly, m.window, keys, [s.name for s in recipe.sources if s.essential])]
    data = m.data
    for series, strategy in fills.items():
        data = wk.fill_missing(data, keys, strategy, [series])
    if recipe.event_dummies:
        each = F.explode(F.array(*[F.struct(F.lit(e.name).alias("name"), F.lit(y).alias("iso_year"), F.lit(w).alias("iso_week"))
                                   for e in recipe.event_dummies for y, w in e.weeks]))
        events = weekly.select(*keys).distinct().select(*keys, each.alias("_e")).select(*keys, "_e.*")
        dummies = wk.event_dummies(data, events, keys)
        taken = weekly.select(*keys, "series").distinct()
        issues.append(wk.event_issues(dummies, taken, keys).withColumn(
            "severity", F.when(F.col("code") == "event_dummy_name_collision", "error").otherwise("warning")))
        data = data.unionByName(dummies.join(taken, [*keys, "series"], "left_anti").select(data.columns))
        roles.update({e.name: "control" for e in recipe.event_dummies if e.name not in roles})
    if recipe.features:
        wide, notes = ft.apply_features(to_wide(data, keys, list(roles)), list(recipe.features), keys)
        added = {f.name: "control" for f in recipe.features if f.name in wide.columns and f.name not in roles}
        if added:
            data = data.unionByName(to_long(wide.select(*keys, WEEK, *added), keys, added).select(data.columns))
        roles.update(added)
        issues.append(notes.withColumn("source", F.lit(None).cast("string")))
    spend = [n for n, r in roles.items() if r == "spend"]
    checks = [ql.year_end_anomalies(data, keys), ql.outlier_weeks(data, keys, kpi=True), ql.outlier_weeks(data, keys, kpi=False),
              ql.degenerate_columns(data, keys), ql.over_parameterised(data, keys)]
    if len(spend) > 1:
        checks.append(ql.near_identical(data, keys, spend))
    predictors = [n for n, r in roles.items() if r in ("spend", "control")]
    if len(predictors) > 2:
        checks.append(ql.multicollinearity(data, keys, predictors))
    flat = union_all([_flat(i, keys) for i in [*issues, *checks]])
    return Dataset(data, m.window, flat, quality_verdict(flat, weekly.select(*keys), keys), roles)


def _flat(issues: DataFrame, keys: list[str]) -> DataFrame:
    """Issues of any check in one layout; those about the recipe itself have no panel."""
    def named(c: str, *others: str) -> Column:
        for o in (c, *others):
            if o in issues.columns:
                return F.col(o).cast("string")
        return F.lit(None).cast("string")

    severity = named("severity") if "severity" in issues.columns else reduce(
        lambda acc, kv: F.when(F.col("code") == kv[0], kv[1][0]).otherwise(acc), fx.ISSUE_INFO.items(), F.lit("warning"))
    return issues.select(*[named(k).alias(k) for k in keys], F.col("code"), severity.alias("severity"),
                         named("source").alias("source"), named("column", "series").alias("column"))
