"""Token counts kept up by signed deltas: batches of changes add to totals by source, language and tokenizer version."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import in_groups, stored, table
from tidemark.llm.registry import query
from tidemark.llm.tokens import encoder
from tidemark.session import scratch

GROUP = ["source", "lang", "tokenizer"]
VERSIONS = {"word_bpe_49k": "word_bpe_49k.json", "space_words": None}
DELTA = "batch string, attempt string, source string, lang string, tokenizer string, docs long, tokens long"


def count_tokens(docs: DataFrame, versions: dict[str, str | None] = VERSIONS, id_column: str = "doc_id", text_column: str = "text",
                 group_columns: tuple[str, str] = ("source", "lang")) -> DataFrame:
    """(id, source, lang, tokenizer, tokens): a row per document and tokenizer version; whole texts, null as empty.

    A version is a public tokenizer's file, or None for words between ASCII white space.
    """
    def run(batches):
        for b in batches:
            found = {v: [] for v in versions}
            for group in in_groups(b["text"]):
                for v, file in versions.items():
                    found[v] += [len(t.encode().split()) for t in group] if file is None else [len(x) for x in encoder(file).encode(group)]
            for v, tokens in found.items():
                yield pd.DataFrame({"id": b["id"], "source": b["source"], "lang": b["lang"], "tokenizer": v, "tokens": np.array(tokens, np.int64)})

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), *[F.col(c).cast("string").alias(n) for c, n in zip(group_columns, GROUP)],
                       F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, source string, lang string, tokenizer string, tokens long")


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Counts as changes: 1 inserts, -1 deletes."""
    return counts.groupBy(*GROUP).agg(F.sum(F.lit(sign)).alias("docs"), F.sum(F.col("tokens") * sign).alias("tokens"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes that turn one set of counts into another: the old rows leave, the new ones come."""
    return (signed(before, -1).unionByName(signed(after, 1)).groupBy(*GROUP)
            .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0"))


class Ledger:
    """Signed deltas in a shared folder. A batch counts once, however often and by however many writers it is committed.

    ``commit`` appends the batch's deltas under a new attempt name and then one row to the list of commits. Totals add
    the deltas of one listed attempt per batch, the smallest name, so an attempt that died before its commit row, or
    a second commit of a batch, adds nothing. Nulls in the group columns form groups of their own.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.deltas, self.commits = spark, f"{folder}/deltas", f"{folder}/commits"

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def committed(self) -> DataFrame:
        return self._read(self.commits, "batch string, attempt string").groupBy("batch").agg(F.min("attempt").alias("attempt"))

    def commit(self, batch: str, changes: DataFrame) -> None:
        """``changes``: rows of the group columns, docs and tokens, of any number per group."""
        if not self.committed().where(F.col("batch") == batch).isEmpty():
            return
        attempt = uuid.uuid4().hex
        (changes.groupBy(*GROUP).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
         .select(F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"), *GROUP, "docs", "tokens")
         .write.mode("append").parquet(self.deltas))
        self.spark.createDataFrame([(batch, attempt)], "batch string, attempt string").write.mode("append").parquet(self.commits)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all committed batches; groups that are down to nothing are left out."""
        rows = self._read(self.deltas, DELTA).join(self.committed(), ["batch", "attempt"], "left_semi")
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


def without_repeated_lines(text: str):
    return F.array_join(F.array_distinct(F.split(text, "\n")), "\n")


@query("op3_token_counts")
def op3_token_counts(spark, sf_dir):
    """Load every document; revise those of low quality, whose repeated lines go; delete toxic ones; replay the load."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ledger = Ledger(spark, scratch(spark, "ledger"))
    counts = stored(count_tokens(docs), "counts")
    ledger.commit("load", signed(counts, 1))
    # texts without a repeated line stay as they are, so only the others are counted again, and no text goes through a join
    repeats = docs.withColumn("_trimmed", without_repeated_lines("text")).where("_trimmed <> text")
    before, after = (stored(count_tokens(d), "revised") for d in (repeats, repeats.withColumn("text", F.col("_trimmed"))))
    low = labels.where("quality = 0 and toxic = 0").select(F.col("doc_id").alias("id")).distinct()
    ledger.commit("revise", revised(before.join(low, "id", "left_semi"), after.join(low, "id", "left_semi")))
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    ledger.commit("delete", signed(counts.join(toxic, F.col("id") == F.col("doc_id"), "left_semi"), -1))
    ledger.commit("load", signed(counts, 1))
    return ledger.totals()
