"""Benchmark decontamination: n-gram seeds find passages, local alignment scores them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.registry import query
from tidemark.llm.words import grams, hashed, plain_words

SEED_WORDS = 3
THRESHOLD = 0.6         # of the score of the whole item, unedited
BITS = 22               # the sieve has 2**22 bits, whatever the number of seeds
MATCH, MISMATCH, GAP = 2, -1, -1


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: best score of any part of ``item`` in any part of ``passage``, and where it lies there."""
    n = len(passage)
    steps = np.arange(n + 1, dtype=np.int64)
    row, best, end = np.zeros(n + 1, np.int64), 0, 0
    begin = steps.copy()                     # where the best path to each cell starts
    for word in item:
        diagonal = row[:-1] + np.where(passage == word, MATCH, MISMATCH)
        up = row[1:] + GAP
        new = np.concatenate([[0], np.maximum(np.maximum(diagonal, up), 0)])
        start = np.concatenate([[0], np.where(new[1:] == 0, steps[1:], np.where(diagonal >= up, begin[:-1], begin[1:]))])
        run = np.maximum.accumulate(new - GAP * steps)
        source = np.maximum.accumulate(np.where(new - GAP * steps == run, steps, 0))
        row, begin = run + GAP * steps, start[source]
        top = int(row.argmax())
        if row[top] > best:
            best, end, first = int(row[top]), top, int(begin[top])
    return (best, first, end) if best else (0, 0, 0)


def item_seeds(items: DataFrame, id_column: str, text_column: str, n: int) -> DataFrame:
    """(item, words, seeds): hashes of an item's words and of its runs of ``n`` words."""
    def run(batches):
        for b in batches:
            h = [hashed(plain_words(t)) for t in b["text"]]
            yield pd.DataFrame({"item": b["item"], "words": [x.view(np.int64) for x in h],
                                "seeds": [grams(x, n).view(np.int64) for x in h]})

    kind = items.schema[id_column].dataType.simpleString()
    return (items.select(F.col(id_column).alias("item"), F.col(text_column).alias("text")).where("item is not null")
            .mapInPandas(run, f"item {kind}, words array<long>, seeds array<long>"))


def _sieve(seeds: DataFrame) -> np.ndarray:
    """A bit for each seed hash; 2**BITS bits at most reach the driver, however many seeds there are."""
    words = (seeds.select(F.shiftrightunsigned("seed", 64 - BITS).alias("slot"))
             .groupBy(F.expr("cast(shiftright(slot, 6) as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("v")))
    out = np.zeros(1 << (BITS - 6), np.int64)
    for r in words.collect():
        out[r["w"]] = r["v"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _passing(text: str | None, n: int, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, places and hashes of the n-grams that pass the sieve."""
    h = hashed(plain_words(text))
    g = grams(h, n)
    at = np.flatnonzero(sieve[g >> np.uint64(64 - BITS)])
    return h, at, g[at]


def contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 item_column: str = "item_id", item_text_column: str = "text", n: int = SEED_WORDS,
                 threshold: float = THRESHOLD) -> DataFrame:
    """(id, text_hash, item, score, first_word, end_word): documents that hold a test item, whole, edited or in part.

    Seeds are the items' runs of ``n`` words, all of them, common or not: which of them an edited copy still holds
    is up to the edits, so any choice by count could leave just the broken ones. Any ``n`` words of an item in a row
    that a document holds lead to an alignment. Passages around the seeds are widened by the longest item and
    aligned with each item whose seeds they hold, unless too few of the item's words occur in them to reach the
    threshold in any order. The score is the best local alignment over that of the item with itself; a document and
    item are reported once, with the best, where it reaches ``threshold``.

    A null text has no words. Items with a null id or fewer than ``n`` words have no seed and are never reported.
    Rows that repeat an id are told apart by ``text_hash``. Without items or documents there are no rows. Extra
    columns are not read.
    """
    tests = stored(item_seeds(items, item_column, item_text_column, n), "items")
    seeds = stored(tests.select("item", F.explode("seeds").alias("seed")).distinct(), "seeds")
    reach = tests.agg(F.coalesce(F.max(F.size("words")), F.lit(0))).first()[0]
    sieve = _sieve(seeds)

    def cut(batches):
        for b in batches:
            rows = []
            for name, key, text in zip(b["id"], b["text_hash"], b["text"]):
                h, at, g = _passing(text, n, sieve)
                if len(at):
                    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 2 * reach) + 1):
                        lo, hi = max(0, int(at[part[0]]) - reach), int(at[part[-1]]) + n + reach
                        rows.append((name, key, lo, h[lo:hi].view(np.int64), np.unique(g[part]).view(np.int64)))
            out = pd.DataFrame(rows, columns=["id", "text_hash", "lo", "passage", "seeds"])
            yield out.astype({"id": b["id"].dtype})

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("text_hash"),
                       F.col(text_column).alias("text"))
    passages = stored(rows.mapInPandas(cut, f"id {kind}, text_hash long, lo int, passage array<long>, seeds array<long>")
                      .withColumn("passage_id", F.monotonically_increasing_id()), "passages")
    pairs = (passages.select("passage_id", F.explode("seeds").alias("seed")).join(seeds, "seed")
             .select("passage_id", "item").distinct())
    work = pairs.join(tests.select("item", "words"), "item").join(passages.drop("seeds"), "passage_id")

    def score(batches):
        for b in batches:
            # no more words can match than occur in the passage at all: what that rules out is not aligned
            most = [MATCH * np.isin(w, p).sum() / (MATCH * len(w)) for w, p in zip(b["words"], b["passage"])]
            b = b[np.array(most) >= threshold].copy()
            out = [align(np.asarray(w), np.asarray(p)) for w, p in zip(b["words"], b["passage"])]
            b["score"] = [s / (MATCH * len(w)) for (s, _, _), w in zip(out, b["words"])]
            b["first_word"] = [lo + f for (_, f, _), lo in zip(out, b["lo"])]
            b["end_word"] = [lo + e for (_, _, e), lo in zip(out, b["lo"])]
            yield b[["id", "text_hash", "item", "score", "first_word", "end_word"]]

    of_item = items.schema[item_column].dataType.simpleString()
    scored = work.mapInPandas(score, f"id {kind}, text_hash long, item {of_item}, score double, first_word long, end_word long")
    best = (scored.where(F.col("score") >= threshold).groupBy("id", "text_hash", "item")
            .agg(F.max(F.struct("score", -F.col("first_word"), -F.col("end_word"))).alias("b")))
    return best.select("id", "text_hash", "item", "b.score", (-F.col("b.col2")).alias("first_word"), (-F.col("b.col3")).alias("end_word"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that hold no test item; rows with a null id or text stay unless they hold one."""
    hit = (contaminated(docs, items, id_column, text_column, **how).select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"))
           .distinct())
    same = F.xxhash64(F.coalesce(docs[text_column], F.lit(""))) == F.col("_hash")
    return docs.join(hit, docs[id_column].eqNullSafe(F.col("_id")) & same, "left_anti")


@query("op9_decontaminate")
def op9_decontaminate(spark, sf_dir):
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.round("score", 9).alias("score"), "first_word", "end_word")
