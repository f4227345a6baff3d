"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the folder in ``spark.checkpoint.dir`` and read back: later steps start from files that outlive
    any executor, and read only the columns they need."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_groups(texts: Iterable[str | None], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Consecutive texts in lists of about ``chars`` characters, so that a batch of long texts stays small in memory."""
    group, size = [], 0
    for t in texts:
        group.append(t or "")
        size += len(group[-1])
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def span_text(spans, separator: str = ","):
    """``kind:start:end`` of an array of structs, joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), separator)
