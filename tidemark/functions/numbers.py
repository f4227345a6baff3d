"""Column helpers for numbers: strict parsing, number styles, numbers in text."""

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import fixed_values as fx


def to_number(c: Column) -> Column:
    """Plain decimal or exponent text to double, anything else NULL.

    The pattern guard keeps out what a cast would accept by accident (``1d``, ``NaN``).
    """
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(fx.PLAIN_NUMBER), text.try_cast("double"))


def without_currency(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), fx.CURRENCY_CHARS, "")


def nl_number(c: Column) -> Column:
    return to_number(F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))


def en_number(c: Column) -> Column:
    return to_number(F.replace(c, F.lit(","), F.lit("")))


def text_number_value(raw: Column) -> Column:
    """Value of one number as written in running text, NL thousands included."""
    dotted = F.replace(raw, F.lit(","), F.lit("."))
    thousands = F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(raw.rlike(fx.TEXT_THOUSANDS), thousands).otherwise(dotted).try_cast("double")


def numbers_in(df: DataFrame, text: str) -> DataFrame:
    """One row per number in ``text``: adds ``raw`` and ``number``."""
    found = F.regexp_extract_all(F.col(text), F.lit(fx.TEXT_NUMBER), F.lit(0))
    return (df.select(*[c for c in df.columns if c != text], F.explode(found).alias("raw"))
            .withColumn("number", text_number_value(F.col("raw"))))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)
