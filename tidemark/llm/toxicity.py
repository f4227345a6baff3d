"""Toxicity severity by cumulative-link ordinal regression over sparse word features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.registry import query
from tidemark.llm.words import hashed, plain_words

BUCKETS = 1 << 20
STEMS = (4, 5, 6)         # bytes of a word's beginning
SAMPLE = 20_000          # labelled rows that the model is fitted on, at most
FEATURES = 4096          # word buckets with a weight, at most: those that tell toxic rows apart best
SUPPORT = 5              # labelled rows that hold a bucket, at least
GRADES = 4               # severity 0 to 3
SIGNIFICANT = 5.0        # standard errors by which a bucket tells toxic rows apart, at least
STEPS, L1 = 300, 0.0015
REJECT = 0.5             # probability of any severity above 0


def buckets(text: str | None) -> np.ndarray:
    """The distinct buckets of a text's words and of the words' beginnings, which stay when endings change."""
    words = set(plain_words(text))
    stems = {w[:n] + b"*" for n in STEMS for w in words if len(w) > n}
    return np.unique(hashed([*words, *stems]) % np.uint64(BUCKETS)).astype(np.int32)


@dataclass
class Ordinal:
    """P(grade >= k) = sigmoid(w.x - cut[k]): one set of weights for all cuts, which ascend."""
    places: np.ndarray       # bucket of each weight
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(sums[:, None] - self.cuts[None, :], -60, 60)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_features: int, n_grades: int = GRADES, steps: int = STEPS,
                l1: float = L1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts that maximise the cumulative-link likelihood with an L1 penalty, by proximal gradient steps.

    Each row is the indices of its features. The cuts are written as a first one and positive distances, so they
    stay in order. Rows are weighted so that severity 0 and the rest count the same.
    """
    n = len(rows)
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    what = np.concatenate(rows) if n else np.zeros(0, np.int64)
    zero = grades == 0
    mass = np.where(zero, 0.5 / max(1, zero.sum()), 0.5 / max(1, (~zero).sum()))
    w, first, gaps = np.zeros(n_features), 0.0, np.zeros(n_grades - 2)
    square = {k: 1e-8 for k in ("w", "first", "gaps")}
    square["w"], square["gaps"] = np.full(n_features, 1e-8), np.full(n_grades - 2, 1e-8)
    for _ in range(steps):
        cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        s = np.bincount(at, w[what], n)
        high = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(s[:, None] - cuts, -30, 30))), np.zeros((n, 1))], axis=1)
        up, down = high[np.arange(n), grades], high[np.arange(n), grades + 1]
        p = np.maximum(up - down, 1e-12)
        d_up, d_down = up * (1 - up), down * (1 - down)
        g_sum = -mass * (d_up - d_down) / p
        g_cut = np.zeros(n_grades - 1)
        np.add.at(g_cut, grades[~zero] - 1, (mass * d_up / p)[~zero])
        last = grades == n_grades - 1
        np.add.at(g_cut, grades[~last], -(mass * d_down / p)[~last])
        g = {"w": np.bincount(what, g_sum[at], n_features), "first": g_cut.sum(),
             "gaps": np.cumsum(g_cut[::-1])[::-1][1:] * np.exp(gaps)}
        for k in g:
            square[k] = square[k] + g[k] ** 2
        rate = 0.5 / np.sqrt(square["w"])
        w = w - rate * g["w"]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        first -= 0.5 / np.sqrt(square["first"]) * g["first"]
        gaps = np.clip(gaps - 0.5 / np.sqrt(square["gaps"]) * g["gaps"], -4, 4)
    return w, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", grade_column: str = "grade",
          n_grades: int = GRADES, sample: int = SAMPLE) -> Ordinal:
    """Fit on at most ``sample`` labelled rows, chosen by a hash of their id.

    ``labels`` has the id and a grade from 0 to ``n_grades`` - 1. Where it only has 0 and 1, graver ones are told
    from lighter ones by how many toxic markers they hold: words that occur in toxic rows almost alone. Rows with a
    null id, text or grade, or a grade out of range, are left out. Without both a row of grade 0 and one above, all
    weights are 0 and nothing is toxic.
    """
    graded = (labels.select(F.col(id_column).alias("id"), F.col(grade_column).cast("int").alias("grade"))
              .where((F.col("grade") >= 0) & (F.col("grade") < n_grades)).groupBy("id").agg(F.max("grade").alias("grade")))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text is not null")
    chosen = (texts.join(graded, "id").withColumn("h", F.xxhash64("id"))
              .join(F.broadcast(graded.orderBy(F.xxhash64("id"), "id").limit(sample).select("id")), "id", "left_semi"))

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"].astype(str), "grade": b["grade"], "features": [buckets(t) for t in b["text"]]})

    rows = stored(chosen.select("id", "grade", "text").mapInPandas(run, "id string, grade int, features array<int>"), "toxic-sample")
    sizes = rows.agg(F.count(F.when(F.col("grade") > 0, 1)), F.count(F.when(F.col("grade") == 0, 1)), F.max("grade")).first()
    none = Ordinal(np.zeros(0, np.int64), np.zeros(0), np.full(n_grades - 1, 60.0))
    if not sizes[0] or not sizes[1]:
        return none
    toxic, clean = sizes[0], sizes[1]
    counts = (rows.select(F.explode("features").alias("bucket"), (F.col("grade") > 0).cast("int").alias("t"))
              .groupBy("bucket").agg(F.sum("t").alias("a"), F.sum(1 - F.col("t")).alias("b")).where(F.col("a") + F.col("b") >= SUPPORT))
    share = (F.col("a") + F.col("b")) / (toxic + clean)
    z = (F.col("a") / toxic - F.col("b") / clean) / F.sqrt(share * (1 - share) * (1 / toxic + 1 / clean) + 1e-12)
    top = counts.withColumn("z", z).where(F.abs("z") >= SIGNIFICANT).orderBy(F.desc(F.abs("z")), "bucket").limit(FEATURES).orderBy("bucket").collect()
    if not top:
        return none
    places = np.array([r["bucket"] for r in top], np.int64)
    known = [int(p) for p in places]
    small = rows.orderBy("id").select("grade", F.array_intersect("features", F.array(*[F.lit(p).cast("int") for p in known])).alias("f")).toPandas()
    found = [np.searchsorted(places, np.asarray(f, np.int64)) for f in small["f"]]
    grades = small["grade"].to_numpy(np.int64)
    if sizes[2] == 1 and n_grades > 2:
        marker = np.array([r["a"] >= SUPPORT and r["a"] / toxic >= 20 * (r["b"] + 1) / (clean + 1) for r in top])
        held = np.array([int(marker[f].sum()) for f in found])
        grades = np.where(grades > 0, np.clip(held, 1, n_grades - 1), 0)
    return Ordinal(places, *fit_ordinal(found, grades, len(places), n_grades))


def severity(model: Ordinal, text: Column) -> Column:
    """Column of arrays (expected severity, probability of each grade or above from 1); the whole text counts."""
    wide = np.zeros(BUCKETS, np.float32)
    wide[model.places] = model.weights
    cuts = model.cuts

    @F.pandas_udf("array<double>")
    def score(texts: pd.Series) -> pd.Series:
        sums = np.array([float(wide[buckets(t)].sum(dtype=np.float64)) for t in texts])
        above = Ordinal(np.zeros(0), np.zeros(0), cuts).above(sums)
        return pd.Series(list(np.concatenate([above.sum(axis=1, keepdims=True), above], axis=1)))

    return score(text)


def with_severity(docs: DataFrame, model: Ordinal, text_column: str = "text") -> DataFrame:
    """``docs`` with ``expected_severity``, ``p_toxic`` and ``grade``, the likeliest severity; these names are replaced.

    A null or empty text has no features: its severity is what the cuts alone say, below the rejection line.
    """
    scored = docs.withColumn("expected_severity", severity(model, F.col(text_column)))
    n = len(model.cuts)
    at = lambda k: F.lit(1.0) if k == 0 else F.lit(0.0) if k > n else F.col("expected_severity")[k]
    each = F.array(*[at(k) - at(k + 1) for k in range(n + 1)])
    return (scored.withColumn("p_toxic", at(1)).withColumn("grade", (F.array_position(each, F.array_max(each)) - 1).cast("int"))
            .withColumn("expected_severity", F.col("expected_severity")[0]))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_column: str = "text", id_column: str = "doc_id", reject: float = REJECT, **how) -> DataFrame:
    """The rows of ``docs`` whose probability of being toxic is below ``reject``."""
    model = train(docs, labels, id_column, text_column, **how)
    return docs.where(severity(model, F.col(text_column))[1] < reject)


def toxic_labels(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade"))


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = with_severity(docs.select("doc_id", "text"), train(docs, toxic_labels(spark, sf_dir)))
    return out.select("doc_id", F.round("expected_severity", 6).alias("expected_severity"), F.round("p_toxic", 6).alias("p_toxic"), "grade",
                      (F.col("p_toxic") >= REJECT).alias("toxic"))
