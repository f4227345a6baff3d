"""Language-model scores of whole documents: a gated recurrent network over word classes, words within classes."""

from __future__ import annotations

import functools
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_groups, stored, table
from tidemark.llm.gru import Gru, learn, score
from tidemark.llm.registry import query

DENSE = 1 << 17         # words that tasks hold in memory, at most; counts of all others come by a join
GROUPS = 8              # languages with classes of their own, the rest share one
TIERS = (0.3, 0.6)      # shares of all tokens at which the dense words are cut into tiers, commonest first
ROUNDS = 3              # parts of the training documents, and averagings of the network
FLUSH = 300_000         # distinct words a task holds before it hands counts on
CHUNK = 1 << 21         # classes that run together


def _words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, lang, n) over all rows of (text, lang); pre-added in tasks. The end token is the empty word."""
    def run(batches):
        held: dict[str, Counter] = {}

        def flush():
            for lang, c in held.items():
                if c:
                    yield pd.DataFrame({"word": [w.decode() for w in c], "lang": lang, "n": np.fromiter(c.values(), np.int64, len(c))})
            held.clear()

        for b in batches:
            at = 0
            for group in in_groups(b["text"]):
                for text, lang in zip(group, b["lang"].iloc[at:at + len(group)]):
                    c = held.setdefault(lang, Counter())
                    c.update(_words(text))
                    c[b""] += 1
                at += len(group)
                if sum(map(len, held.values())) > FLUSH:
                    yield from flush()
        yield from flush()

    return docs.select("text", "lang").mapInPandas(run, "word string, lang string, n long")


class Lexicon:
    """What a task needs of the vocabulary: dense words with class and count, and the class of any other word."""

    def __init__(self, words: bytes, classes: np.ndarray, counts: np.ndarray, suffixes: dict[bytes, int], other: int, end: int, log_sums: np.ndarray):
        self.of = dict(zip(words.split(b"\n"), range(len(counts)))) if len(counts) else {}
        self.classes, self.log_counts = classes, np.log10(counts + 1.0)
        self.suffixes, self.other, self.end, self.log_sums = suffixes, other, end, log_sums

    def encode(self, text: str):
        """(classes with the end, sum of log10(c + 1) of dense words, sum of log10 of class sums, other words)."""
        words = _words(text)
        at = np.fromiter((self.of.get(w, -1) for w in words), np.int64, len(words))
        rare = np.flatnonzero(at < 0)
        classes = np.empty(len(words) + 1, np.uint8)
        classes[:-1] = self.classes[at] if len(self.classes) else 0
        others = [words[i] for i in rare]
        classes[rare] = [self.suffixes.get(w[-2:], self.other) for w in others]
        classes[-1] = self.end
        dense = float(self.log_counts[at[at >= 0]].sum())
        return classes, dense, float(self.log_sums[classes[:-1]].sum()), [w.decode() for w in others]


@functools.lru_cache(maxsize=1)
def _lexicon(*parts) -> Lexicon:
    words, classes, counts, suffixes, other, end, log_sums = parts
    return Lexicon(words, np.frombuffer(classes, np.uint8), np.frombuffer(counts, np.int64), dict(suffixes), other, end, np.frombuffer(log_sums, np.float64))


def lm_scores(docs: DataFrame, held_out, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
              rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of whole documents.

    Words are counted over all rows where ``held_out`` is false. The base is the count of a word plus one over the
    tokens plus the distinct tokens plus one. The model writes p(word | before) = p(class | before) * p(word | class).
    Classes are made of a word's commonest language and its frequency tier; words too rare for a task's memory take
    the language of their last two bytes. p(class | before) is a gated recurrent network whose state runs through
    the whole document; p(word | class) is the word's share of its class, one unknown word counted in. The network is
    trained on every training document: in each round tasks train on their documents of that part from the same
    start, and their parameters, weighted by tokens, are averaged.

    A null text is empty and has the end token alone; a null language counts as one of its own; a row with a null id
    is scored too. Rows that repeat are each counted and scored. Without training rows every word is unknown. An
    empty table gives no rows. Extra columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"),
                       F.coalesce(F.col(lang_column).cast("string"), F.lit("")).alias("lang"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counted = word_counts(rows.where("not held_out")).repartition("word").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    vocabulary = stored(counted.groupBy("word").agg(F.sum("n").alias("c"), F.max_by("lang", F.struct("n", "lang")).alias("lang")), "vocabulary")
    facts = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("c"))), F.lit(0))).first()
    n_all, n_distinct, n_ends = facts
    words = vocabulary.where("word <> ''")
    # the count at which words become dense, and those at which tiers change, from how many words have each count
    spread = words.groupBy("c").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("c")).limit(DENSE).collect()
    least, taken, mass, tiers = math.inf, 0, 0, []
    for r in spread:
        taken += r["words"]
        if taken > DENSE:
            break
        while len(tiers) < len(TIERS) and mass >= TIERS[len(tiers)] * n_all:
            tiers.append(r["c"])
        least, mass = r["c"], mass + r["c"] * r["words"]
    tiers += [-1] * (len(TIERS) - len(tiers))
    langs = [r["lang"] for r in words.groupBy("lang").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "lang").limit(GROUPS - 1).collect()]
    n_groups, n_tiers = len(langs) + 1, len(TIERS) + 2
    end = n_groups * n_tiers
    group = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1 if langs else F.lit(-1), F.lit(-1))
    group = F.when(group < 0, len(langs)).otherwise(group).cast("int")
    dense = words.where(F.col("c") >= F.lit(least if taken and least < math.inf else 1 << 62))
    tier = sum(((F.col("c") <= t).cast("int") for t in tiers), F.lit(0))
    table_ = dense.select("word", "c", (group * n_tiers + tier).alias("class")).toPandas().sort_values("word", ignore_index=True)
    rare = words.where(F.col("c") < F.lit(least if taken and least < math.inf else 1 << 62)).select("word", "c", group.alias("g"))
    # by bytes, as tasks cut words
    suffix = F.expr("substring(cast(word as binary), greatest(1, octet_length(word) - 1), 2)")
    by_suffix = (rare.groupBy(suffix.alias("suffix"), "g").agg(F.sum("c").alias("c"), F.sum(F.col("c") + 1).alias("s")).collect())  # 65,792 suffixes at most, times groups
    best: dict[bytes, tuple] = {}
    total: Counter = Counter()
    for r in by_suffix:
        key = bytes(r["suffix"])
        best[key] = max(best.get(key, (-1, 0)), (r["c"], -r["g"]))
        total[key] += r["s"]
    suffixes = {k: -g * n_tiers + n_tiers - 1 for k, (_, g) in best.items()}
    other = (n_groups - 1) * n_tiers + n_tiers - 1
    sums = np.zeros(end + 1)
    np.add.at(sums, table_["class"].to_numpy(np.int64), table_["c"].to_numpy(float) + 1)
    for k, s in total.items():
        sums[suffixes[k]] += s
    sums[n_tiers - 1:end:n_tiers] += 1                       # an unknown word in each class of rare ones
    sums[end] = n_ends + 1
    log_sums = np.log10(np.maximum(sums, 1))
    used = sums > 0
    prior = np.where(used, np.maximum(sums, 1e-3), 1e-3) / np.where(used, np.maximum(sums, 1e-3), 1e-3).sum()
    parts = ("\n".join(table_["word"]).encode(), table_["class"].to_numpy(np.uint8).tobytes(), table_["c"].to_numpy(np.int64).tobytes(),
             tuple(sorted(suffixes.items())), other, end, log_sums.tobytes())

    def encode(batches):
        lexicon = _lexicon(*parts)
        for b in batches:
            at = 0
            for group_ in in_groups(b["text"]):
                found = [lexicon.encode(t) for t in group_]
                part = b.iloc[at:at + len(group_)]
                at += len(group_)
                yield pd.DataFrame({"id": part["id"], "held_out": part["held_out"], "classes": [c.tobytes() for c, *_ in found],
                                    "dense": [f[1] for f in found], "log_sums": [f[2] for f in found], "others": [f[3] for f in found]})

    kind = docs.schema[id_column].dataType.simpleString()
    encoded = stored(rows.select("id", "held_out", "text").mapInPandas(
        encode, f"id {kind}, held_out boolean, classes binary, dense double, log_sums double, others array<string>")
        .withColumn("row", F.monotonically_increasing_id()), "encoded")
    gru = Gru.fresh(prior)
    for k in range(rounds):
        part = encoded.where((~F.col("held_out")) & (F.pmod(F.xxhash64("row"), F.lit(rounds)) == k)).select("classes")
        averaged = _round(part, gru.flat, len(prior), end)
        if averaged is not None:
            gru = Gru(len(prior), flat=averaged)
    flat, n_classes = gru.flat, len(prior)

    def rate(batches):
        model = Gru(n_classes, flat=flat)
        for b in batches:
            docs_ = [np.frombuffer(c, np.uint8) for c in b["classes"]]
            out = np.concatenate([score(model, part_, end) for part_ in _parts(docs_)] or [np.zeros(0)])
            b["chain"] = out / math.log(10)
            b["n_tokens"] = [len(d) for d in docs_]
            yield b.drop(columns="classes")

    rated = (encoded.select("id", "held_out", "row", "dense", "log_sums", F.size("others").alias("n_others"), "classes")
             .mapInPandas(rate, f"id {kind}, held_out boolean, row long, dense double, log_sums double, n_others int, chain double, n_tokens long"))
    counts = rare.select("word", "c")
    met = (encoded.select("row", F.explode("others").alias("word")).join(counts, "word", "left").groupBy("row")
           .agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rest"), F.count("c").alias("met")))
    ends = math.log10(n_ends + 1)
    base = math.log10(n_all + n_distinct + 1)
    both = rated.join(met, "row", "left").withColumn("logs", F.col("dense") + F.coalesce("rest", F.lit(0.0)))
    return both.select(
        "id", "held_out", "n_tokens",
        (F.col("n_tokens") - 1 - F.col("n_others") + F.coalesce("met", F.lit(0)) + F.lit(1 if n_ends else 0)).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), (F.col("logs") + ends - F.col("n_tokens") * base).alias("base_score"),
        (F.col("chain") + F.col("logs") - F.col("log_sums")).alias("score"))


def _parts(docs: list[np.ndarray]):
    """Documents in lists of about ``CHUNK`` classes."""
    held, size = [], 0
    for d in docs:
        held.append(d)
        size += len(d)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _round(part: DataFrame, start: np.ndarray, classes: int, end: int) -> np.ndarray | None:
    """Train in each task from ``start``; the average of the tasks' parameters by tokens, None without documents."""
    def run(batches):
        model, memory, tokens = Gru(classes, flat=start), {}, 0
        for b in batches:
            for docs in _parts([np.frombuffer(c, np.uint8) for c in b["classes"]]):
                learn(model, docs, end, memory)
                tokens += sum(map(len, docs))
        if tokens:
            yield pd.DataFrame({"i": np.arange(len(model.flat), dtype=np.int32), "v": model.flat.astype(float) * tokens, "n": tokens})

    summed = part.mapInPandas(run, "i int, v double, n long").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).toPandas()
    return None if summed.empty else summed.sort_values("i")["v"].to_numpy(np.float32)


@query("op8_lm_scores")
def op8_lm_scores(spark, sf_dir):
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    out = lm_scores(table(spark, sf_dir, "documents"), held_out)
    return out.withColumnRenamed("id", "doc_id")
