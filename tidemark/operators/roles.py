"""Column typing, role validation, and the checks on a stated model intent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import fixed_values as fx
from tidemark.frames import previous_in_order, stored, union_all
from tidemark.functions.dates import parse_date
from tidemark.functions.numbers import to_number


def classify(cells: DataFrame, keys: list[str], order: str, raw: str = "raw", rows: int | None = None) -> DataFrame:
    """date / numeric / text from all rows of each column, or from the first ``rows`` of them."""
    picked = (cells if rows is None else first_rows(cells, keys, order, rows)).select(*keys, F.col(raw).alias("_cell"))
    used = F.col("_cell").isNotNull() & (F.col("_cell") != "")
    is_date = F.col("_cell").rlike(fx.ISO_DATE_PREFIX)
    is_number = ~is_date & to_number(F.col("_cell")).isNotNull()
    n = picked.groupBy(*keys).agg(
        F.count_if(used).alias("n"), F.count_if(used & is_date).alias("d"),
        F.count_if(used & is_number).alias("m"))
    kind = (F.when(F.col("n") == 0, "text").when(F.col("d") > fx.CLASSIFY_SHARE * F.col("n"), "date")
            .when(F.col("m") > fx.CLASSIFY_SHARE * F.col("n"), "numeric").otherwise("text"))
    return n.select(*keys, kind.alias("kind"))


def first_rows(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The n rows lowest in ``order`` per key. Spark filters each task's rows before the
    shuffle (window group limit), so a hot key ships at most n rows per task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")


def date_score(cells: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    # parsed in a projection of its own: the aggregate then stays small enough to compile
    cells = cells.withColumn("_year", F.year(parse_date(F.col(raw))))
    ok = F.count_if(F.coalesce(F.col("_year").between(fx.DATE_MIN_YEAR, fx.DATE_MAX_YEAR), F.lit(False)))
    return cells.groupBy(*keys).agg(
        F.coalesce(ok / F.nullif(F.count(raw), F.lit(0)), F.lit(0.0)).alias("score"))


def name_has(c: Column, words: tuple[str, ...]) -> Column:
    return F.lower(c).rlike("|".join(words))


def detect_date_column(scores: DataFrame, keys: list[str], column: str, position: str) -> DataFrame:
    """Best column per source: a name hint first, then the score, then the leftmost."""
    rank = F.struct(name_has(F.col(column), fx.DATE_HINTS), F.col("score"), -F.col(position))
    return (scores.where(F.col("score") >= fx.DATE_PARSE_SHARE)
            .groupBy(*keys).agg(F.max_by(column, rank).alias("date_column")))


def numeric_share(cells: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    ok = F.count_if(F.col(raw).isNotNull() & to_number(F.col(raw)).isNotNull())
    return cells.groupBy(*keys).agg(
        F.coalesce(ok / F.nullif(F.count(raw), F.lit(0)), F.lit(0.0)).alias("numeric_share"))


def looks_like_identifier(cells: DataFrame, keys: list[str], order: str, raw: str = "raw") -> DataFrame:
    """Near-unique whole numbers that only go up in row order."""
    number = F.col(raw) if dict(cells.dtypes)[raw] == "double" else to_number(F.col(raw))
    values = (cells.withColumn("_v", number).where(F.col("_v").isNotNull())
              .select(*keys, order, "_v"))
    stepped = previous_in_order(values, keys, order, "_v", "_p")
    rising = F.coalesce(F.min((F.col("_v") > F.col("_p")).cast("int")), F.lit(1))
    whole = F.min((F.col("_v") == F.round("_v")).cast("int"))
    # an always-rising series has no equal values, so distinctness follows from the steps
    return stepped.groupBy(*keys).agg(
        ((F.count("_v") >= fx.ID_MIN_ROWS) & (whole == 1) & (rising == 1)).alias("is_identifier"))


def column_facts(cells: DataFrame, keys: list[str], order: str, raw: str = "raw") -> DataFrame:
    """Everything the role rules need per column, from partial aggregates.

    Values are put in row order only for columns that may rise all the way: whole, as wide as they are long, the first
    the least and the last the largest; ``order`` tells rows apart. Rows of ``weekly.different_rows`` count once; a value whose row was repeated does
    not rise.
    """
    number = dict(cells.dtypes)[raw] == "double"
    v = F.col(raw) if number else to_number(F.col(raw))
    year = F.lit(None).cast("int") if number else F.year(parse_date(F.col(raw)))
    copies = F.col("_copies") if "_copies" in cells.columns else F.lit(1)
    parsed = cells.select(*keys, order, raw, v.alias("_v"), year.alias("_year"), copies.alias("_n"))
    whole = F.min((F.col("_v") == F.round("_v")).cast("int")) == 1
    place = F.when(F.col("_v").isNotNull(), F.col(order))   # a fixed-size value: a struct would make Spark sort all cells
    base = parsed.groupBy(*keys).agg(
        F.count(raw).alias("n"), F.count("_v").alias("n_num"),
        F.min("_v").alias("lo"), F.max("_v").alias("hi"),
        F.count_if(F.col("_v") < 0).alias("n_negative"),
        F.count_if(F.col("_v").isNotNull() & ~F.col("_v").isin(0.0, 1.0)).alias("n_not_binary"),
        F.count_if(F.coalesce(F.col("_year").between(fx.DATE_MIN_YEAR, fx.DATE_MAX_YEAR), F.lit(False))).alias("n_date"),
        (whole & (F.count("_v") >= fx.ID_MIN_ROWS) & (F.max("_v") - F.min("_v") >= F.count("_v") - 1) & (F.min_by("_v", place) == F.min("_v"))
         & (F.max_by("_v", place) == F.max("_v")) & (F.max(F.when(F.col("_v").isNotNull(), F.col("_n"))) == 1)).alias("_may_rise"))
    base = stored(base, "facts")
    distinct = (parsed.where(F.col("_v").isNotNull()).select(*keys, "_v").distinct()
                .groupBy(*keys).agg(F.count(F.lit(1)).alias("n_distinct")))
    rising = cells.join(base.where("_may_rise").select(*keys), keys, "left_semi")
    return (base.drop("_may_rise").join(distinct, keys, "left")
            .join(looks_like_identifier(rising, keys, order, raw), keys, "left")
            .withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))
            .withColumn("is_identifier", F.coalesce("is_identifier", F.lit(False))))


def validate_roles(roles: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Findings per column. ``roles``: (keys, role) with the column name last in ``keys``."""
    column = F.col(keys[-1])
    j = roles.join(facts, keys, "left")
    share = F.coalesce(F.col("n_num") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
    dates = F.coalesce(F.col("n_date") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
    role = F.col("role")
    spend = (F.when(F.col("n_negative") > 0, "negative_spend")
             .when(F.col("hi").isNull() | (F.col("hi") <= 0), "all_zero_channel")
             .when(F.col("n_not_binary") == 0, "binary_column_as_spend")
             .when(name_has(column, fx.VOLUME_WORDS), "spend_column_may_be_volume"))
    kpi = (F.when(F.col("n_distinct") < fx.KPI_MIN_DISTINCT, "kpi_barely_varies")
           .when(F.col("hi") <= 0, "kpi_not_positive"))
    code = (F.when(F.col("n").isNull(), "column_missing")
            .when(role == "date", F.when(dates < fx.DATE_PARSE_SHARE, "date_does_not_parse"))
            .when(share < fx.NUMERIC_SHARE, "not_numeric")
            .when(F.col("is_identifier"), "looks_like_identifier")
            .when(role == "spend", spend).when(role == "kpi", kpi)
            .when((role == "control") & (F.col("n_distinct") <= 1), "constant_control"))
    judged = j.where(role != "ignore")
    first = judged.select(*keys, "role", code.alias("code")).where(F.col("code").isNotNull())
    # an outcome may be flagged for negative values on top of its first finding
    usable = (role == "kpi") & (share >= fx.NUMERIC_SHARE) & ~F.coalesce("is_identifier", F.lit(False))
    negative = (judged.where(usable & (F.col("n_negative") > 0))
                .select(*keys, "role", F.lit("kpi_has_negatives").alias("code")))
    mild = F.col("code").isin("spend_column_may_be_volume", "kpi_has_negatives")
    return first.unionByName(negative).withColumn("severity", F.when(mild, "warning").otherwise("blocking"))


def structural_findings(roles: DataFrame, keys: list[str]) -> DataFrame:
    """No or many dates, no or many outcomes, no channel, per source."""
    n = roles.groupBy(*keys).agg(*[F.count_if(F.col("role") == r).alias(f"n_{r}")
                                   for r in ("date", "kpi", "spend")])
    codes = F.array_compact(F.array(
        F.when(F.col("n_date") == 0, "no_date_column").when(F.col("n_date") > 1, "multiple_date_columns"),
        F.when(F.col("n_kpi") == 0, "no_kpi_column").when(F.col("n_kpi") > 1, "multiple_kpi_columns"),
        F.when(F.col("n_spend") == 0, "no_channels")))
    return n.select(*keys, F.explode(codes).alias("code")).withColumn("severity", F.lit("blocking"))


def role_gate(findings: DataFrame) -> DataFrame:
    """Only some blocking findings stop a build; the rest stay warnings."""
    stops = (F.col("severity") == "blocking") & F.col("code").isin(*fx.BLOCKING_ROLE_CODES)
    return findings.withColumn("severity", F.when(stops, "error").otherwise("warning"))


def build_intent(roles: DataFrame, units: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """One intent row per channel; what was not answered is an explicit unknown."""
    on = [*keys, "series"]
    given = [F.coalesce(c, F.lit("unknown")).alias(c) for c in ("carryover", "strength", "saturation")]
    return (roles.where(F.col("role") == "spend").select(*on)
            .join(units, on, "left").join(answers, on, "left")
            .select(*on, F.coalesce("unit", F.lit(fx.MONEY_UNIT)).alias("unit"), *given,
                    F.lit("mixed").alias("channel_role")))


INTENT_DOMAINS = {
    "unit": fx.CHANNEL_UNITS, "channel_role": fx.CHANNEL_ROLES,
    "carryover": tuple(fx.HALF_LIFE_WEEKS), "strength": tuple(fx.STRENGTH_WEIGHT),
    "saturation": tuple(fx.SATURATION_CENTER),
}


def validate_intent(channels: DataFrame, controls: DataFrame, kpis: DataFrame, roles: DataFrame,
                    keys: list[str]) -> DataFrame:
    """Problems of an intent against the confirmed roles: (keys, series, problem)."""
    on = [*keys, "series"]
    known = roles.select(*on, F.col("role").alias("declared"))
    ch = channels.join(known, on, "left")
    out = [
        ch.where(F.col("declared").isNull()).select(*on, F.lit("unknown_column").alias("problem")),
        ch.where(F.col("declared") != "spend").select(*on, F.lit("wrong_role").alias("problem")),
        channels.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        .select(*on, F.lit("duplicate_channel").alias("problem")),
        channels.where(F.col("unit").isNull()).select(*on, F.lit("unit_missing").alias("problem")),
    ]
    out += [channels.where(F.col(c).isNotNull() & ~F.col(c).isin(*domain))
            .select(*on, F.lit(f"invalid_{c}").alias("problem")) for c, domain in INTENT_DOMAINS.items()]
    ct = controls.select(*on).join(known, on, "left")
    names = channels.select(*on).distinct()
    out += [
        ct.where(F.col("declared").isNull()).select(*on, F.lit("unknown_control").alias("problem")),
        ct.where(F.col("declared").isNotNull()).join(names, on, "left_semi")
        .select(*on, F.lit("control_also_channel").alias("problem")),
        kpis.select(*on).join(known, on, "left").where(F.coalesce(F.col("declared") != "kpi", F.lit(True)))
        .select(*on, F.when(F.col("declared").isNull(), "unknown_kpi").otherwise("kpi_wrong_role").alias("problem")),
        kpis.select(*on).join(names, on, "left_semi").select(*on, F.lit("kpi_also_channel").alias("problem")),
    ]
    return union_all(out)
