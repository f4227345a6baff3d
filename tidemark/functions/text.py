"""Column helpers for text: slugs, unique names, clipped messages."""

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import fixed_values as fx
from tidemark.frames import running_total

ACCENTED = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyy"


def slug(c: Column) -> Column:
    """Typed text to a dull column name: at most four words and 40 characters."""
    plain = F.translate(F.lower(c), ACCENTED, UNACCENTED)
    words = F.filter(F.split(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "_"), lambda w: w != "")
    return F.substring(F.array_join(F.slice(words, 1, 4), "_"), 1, 40)


def truncated(c: Column, limit: int) -> Column:
    note = F.format_string(fx.LOG_SUFFIX, F.length(c))
    return (F.when(c.isNull() | (c == ""), None)
            .when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), note))
            .otherwise(c))


def unique_names(df: DataFrame, keys: list[str], name: str, order: str, out: str,
                 taken: DataFrame | None = None) -> DataFrame:
    """Suffix ``_2``, ``_3``, ... on repeated names; ``taken`` (keys, name) counts as seen.

    Numbers that any name of the table or of ``taken`` already carries are passed over, so no name comes out twice.
    """
    ranked = running_total(df, [*keys, name], order, F.lit(1), "_rank")
    there = df.select(*keys, name)
    if taken is not None:
        used = taken.select(*keys, F.col(name)).distinct()
        there = there.unionByName(used)
        ranked = (ranked.join(used.withColumn("_used", F.lit(1)), [*keys, name], "left")
                  .withColumn("_rank", F.col("_rank") + F.coalesce("_used", F.lit(0))).drop("_used"))
    numbered = r"^(.*)_([1-9][0-9]{0,8})$"
    numbers = (there.select(*keys, F.regexp_extract(name, numbered, 1).alias(name), F.expr(f"try_cast(regexp_extract(`{name}`, r'{numbered}', 2) as int)").alias("_k"))
               .where(F.col("_k") >= 2).groupBy(*keys, name).agg(F.sort_array(F.collect_set("_k")).alias("_numbers")))
    ranked = ranked.join(numbers, [*keys, name], "left")
    # a used number pushes on every later one: it counts where fewer free numbers than wanted lie below it
    passed = F.size(F.filter(F.transform(F.coalesce("_numbers", F.array().cast("array<int>")), lambda x, i: x - 2 - i), lambda free: free < F.col("_rank") - 1))
    suffixed = F.concat(F.col(name), F.lit("_"), (F.col("_rank") + passed).cast("string"))
    return (ranked.withColumn(out, F.when(F.col("_rank") == 1, F.col(name)).otherwise(suffixed))
            .drop("_rank", "_numbers"))
