"""Readers: delimited text with a detected separator, file intake, stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark import fixed_values as fx

SEPARATORS = {"comma": ",", "semicolon": ";", "tab": "\t", "pipe": "|"}


def separator_counts(lines: DataFrame, keys: list[str], line: str = "value") -> DataFrame:
    """Candidate separators counted in header lines: the most frequent one, comma on a tie."""
    n = lines.select(*keys, *[(F.length(line) - F.length(F.replace(F.col(line), F.lit(s), F.lit("")))).alias(name)
                              for name, s in SEPARATORS.items()])
    rank = F.greatest(*[F.col(c) for c in SEPARATORS])
    pick = F.when(rank == 0, ",")
    for name, s in SEPARATORS.items():
        pick = pick.when(F.col(name) == rank, F.lit(s))
    return n.select(*keys, pick.alias("separator"))


def detect_separator(spark: SparkSession, path: str) -> str:
    """Separator of one file from its first line: a fact of a few characters."""
    first = spark.read.text(path).limit(1)
    rows = separator_counts(first, []).collect()
    return rows[0]["separator"] if rows else ","


def read_delimited(spark: SparkSession, path: str, separator: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text, never inferred. A row with more or fewer fields than the header is kept whole in ``_corrupt``.

    A result of one column is tried again with ``;`` and that is kept when it gives more.
    """
    sep = separator or detect_separator(spark, path)

    def read(s: str) -> DataFrame:
        names = spark.read.csv(path, header=True, sep=s, encoding=encoding, inferSchema=False).columns
        fields = [StructField(n, StringType()) for n in [*names, "_corrupt"]]
        return spark.read.schema(StructType(fields)).csv(path, header=True, sep=s, encoding=encoding, mode="PERMISSIVE",
                                                         columnNameOfCorruptRecord="_corrupt")

    df = read(sep)
    if len(df.columns) == 2 and sep != ";":
        again = read(";")
        if len(again.columns) > 2:
            return again
    return df


def with_ingest_id(df: DataFrame) -> DataFrame:
    """Row order of files: a number that grows with file, block and row."""
    return df.withColumn("ingest_id", F.monotonically_increasing_id())


def intake(spark: SparkSession, path: str, project: str = "default", max_bytes: int | None = None) -> DataFrame:
    """Catalogue a folder of uploads: size, content hash, and the reason a file is refused.

    Content is hashed inside the scan tasks, and only of files of acceptable size. Spark's scan
    leaves files without a byte out, so they never enter the catalogue.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = (F.col("length") > 0) & (F.lit(True) if max_bytes is None else F.col("length") <= max_bytes)
    f = files.select(F.lit(project).alias("project"), "path", F.col("modificationTime").alias("created_at"), "length",
                     F.lower(F.substring_index("path", ".", -1)).alias("extension"),
                     F.when(small, F.sha2("content", 256)).alias("sha256"))
    return judge_uploads(f, max_bytes)


def judge_uploads(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Refuse wrong types, empty files, those above ``max_bytes`` if it is given, and every copy but the first of a project's content.

    ``files``: (project, path, created_at, length, extension, sha256). The first copy is an
    aggregate, so a much-copied file is reduced before the shuffle.
    """
    size_ok = (F.col("length") > 0) & (F.lit(True) if max_bytes is None else F.col("length") <= max_bytes)
    type_ok = F.col("extension").isin(*fx.UPLOAD_EXTENSIONS)
    first = (files.where(size_ok & type_ok).groupBy("project", "sha256")
             .agg(F.min_by("path", F.struct("created_at", "path")).alias("_first")))
    j = files.join(first, ["project", "sha256"], "left")
    reason = (F.when(~type_ok, "wrong_type").when(F.col("length") <= 0, "empty").when(~size_ok, "too_large")
              .when(F.col("path") != F.col("_first"), "duplicate_upload"))
    return j.withColumn("refused", reason).drop("_first")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
