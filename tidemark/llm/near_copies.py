"""Near copies by the exact Jaccard similarity of five-word shingles; SimHash fingerprints and min-hash bands only say which
are compared."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.decontaminate import BITS, _sieve
from tidemark.llm.graph import components
from tidemark.llm.simhash import fingerprint, near_links
from tidemark.llm.words import grams, hashed

WIDTH = 5
SIMILAR = 0.8
BANDS, ROWS = 40, 5      # two texts of similarity 0.8 share no band with probability (1 - 0.8**5)**40 = 1.3e-7
TILE = 128               # texts of a tile, about
WEIGHT = 1 << 18         # shingles of a tile, about
_RNG = np.random.default_rng(5)
_FLIP, _TIMES = (_RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False) for _ in range(2))
_TIMES |= np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a text of fewer words has one, of all of them."""
    h = hashed((text or "").encode().lower().split())
    return np.unique(grams(h, min(width, len(h)))) if len(h) else h


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band; texts with equal keys are compared."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(found), 256):
        least = np.minimum(least, ((found[i:i + 256, None] ^ _FLIP) * _TIMES).min(axis=0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ least[k::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def groups_within(sets: list[np.ndarray], similar: float = SIMILAR) -> np.ndarray:
    """For each set the place of the first in its group; groups are linked by a Jaccard similarity of ``similar``."""
    label, left = np.arange(len(sets)), np.arange(len(sets))
    size = np.array([len(s) for s in sets])
    while len(left):
        first, left = left[0], left[1:]
        ahead = [first]
        while ahead and len(left):
            one = ahead.pop()
            fits = np.minimum(size[left], size[one]) >= similar * np.maximum(size[left], size[one])
            near = left[fits]
            if len(near):
                ends = np.cumsum(size[near])
                held = np.concatenate([[0], np.cumsum(np.isin(np.concatenate([sets[k] for k in near]), sets[one]))])
                both = held[ends] - held[ends - size[near]]
                near = near[both >= similar * (size[near] + size[one] - both)]
                label[near] = first
                ahead.extend(near.tolist())
                left = np.setdiff1d(left, near)
    return label


def _links(batches):
    """Compare the texts of tile pairs; only a spanning forest leaves the task."""
    for b in batches:
        left, right = [], []
        for nodes, sets in zip(b["nodes"], b["sets"]):
            nodes = np.asarray(nodes, np.int64)
            label = groups_within([np.asarray(s, np.int64) for s in sets])
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            left.append(nodes[moved])
            right.append(nodes[label[moved]])
        yield pd.DataFrame({"a": np.concatenate([*left, np.zeros(0, np.int64)]), "b": np.concatenate([*right, np.zeros(0, np.int64)])})


def _by_fingerprint(prints: DataFrame) -> DataFrame:
    """(a, b): nodes whose fingerprints are equal or near, each fingerprint standing for its least node."""
    nodes = prints.select("fp", "node").distinct()
    leads = stored(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "fingerprint-leads")
    same = nodes.join(leads, "fp").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    near = near_links(leads.select("fp"))
    ends = [leads.select(F.col("fp").alias(end), F.col("lead").alias(f"lead_{end}")) for end in ("a", "b")]
    return same.unionByName(near.join(ends[0], "a").join(ends[1], "b").select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b")))


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text_hash, lead, lead_hash): every row with an id, and the row of least (id, text_hash) it is linked to.

    Texts are linked when five-word shingles have a Jaccard similarity of 0.8 or more; texts with the same shingles
    are one node, as are all without words. Texts whose SimHash fingerprints differ in 3 bits or fewer, as by
    :mod:`tidemark.llm.simhash`, or that share a band key, fall in one block, and within blocks all are
    compared exactly, tile against tile, where they are not linked already. Rows with a null id are left out.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = (docs.select(F.col(id_column).alias("id"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("text_hash"),
                        F.col(text_column).alias("text")).where("id is not null"))

    def sign(batches):
        for b in batches:
            sets = [shingles(t) for t in b["text"]]
            node = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets))
            fp = np.fromiter((fingerprint((t or "").encode()) for t in b["text"]), np.uint64, len(sets))
            yield pd.DataFrame({"id": b["id"], "text_hash": b["text_hash"], "node": node.view(np.int64), "fp": fp.view(np.int64),
                                "keys": [band_keys(s).view(np.int64) if len(s) else [] for s in sets]})

    prints = stored(rows.mapInPandas(sign, f"id {kind}, text_hash long, node long, fp long, keys array<long>"), "shingle-prints")
    classes = stored(prints.groupBy("node").agg(F.min(F.struct("id", "text_hash", "keys")).alias("first"))
                     .select("node", "first.*"), "shingle-classes")
    spread = classes.select("node", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    banded = spread.join(shared, "key").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    blocks = components(banded.unionByName(_by_fingerprint(prints)))
    named = stored(classes.join(blocks, "node").select("node", "root", F.xxhash64("id", "text_hash").alias("seed")), "blocks")
    sieve = _sieve(named)

    def pick(batches):
        for b in batches:
            b = b[sieve[b["seed"].to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - BITS)]]
            yield pd.DataFrame({"seed": b["seed"], "found": [shingles(t).view(np.int64) for t in b["text"]]})

    texts = rows.select(F.xxhash64("id", "text_hash").alias("seed"), "text").mapInPandas(pick, "seed long, found array<long>")
    sets = stored(texts.join(named, "seed").drop("seed").dropDuplicates(["node"]), "shingle-sets")
    pieces = sets.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum(F.size("found")) / WEIGHT)).cast("int").alias("pieces"))
    tiles = stored(sets.join(pieces, "root").withColumn("piece", F.pmod(F.xxhash64("node"), "pieces").cast("int"))
                   .groupBy("root", "pieces", "piece").agg(F.collect_list(F.struct("node", "found")).alias("t")), "shingle-tiles")
    pairs = (tiles.select("root", "pieces", F.col("piece").alias("p"), F.col("t").alias("x"))
             .join(tiles.select("root", F.col("piece").alias("q"), F.col("t").alias("y")), "root").where("p <= q")
             .select("root", "p", "q", F.when(F.col("p") == F.col("q"), F.col("x")).otherwise(F.concat("x", "y")).alias("t"))
             .repartition("root", "p", "q").select(F.col("t.node").alias("nodes"), F.col("t.found").alias("sets")))
    roots = components(pairs.mapInPandas(_links, "a long, b long"))
    linked = classes.select("node", F.struct("id", "text_hash").alias("first")).join(roots, "node")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    of_node = stored(linked.join(least, "root").select("node", "least"), "shingle-linked")
    leads = classes.join(of_node, "node", "left").select("node", F.coalesce("least", F.struct("id", "text_hash")).alias("lead"))
    return (prints.select("id", "text_hash", "node").join(leads, "node")
            .select("id", "text_hash", F.col("lead.id").alias("lead"), F.col("lead.text_hash").alias("lead_hash")))


def keep_one_copy(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that lead their group of near copies.

    Rows with a null id are kept, as nothing else could name them. Rows that repeat an id and a text are cut to one;
    different texts under one id are rows of their own.
    """
    leads = stored(near_copies(docs, id_column, text_column).where("id = lead and text_hash = lead_hash").groupBy("id", "text_hash")
                   .agg(F.count(F.lit(1)).alias("n")), "copy-leads")
    same = F.xxhash64(F.coalesce(docs[text_column], F.lit(""))) == F.col("_hash")
    once, repeated = (docs.join(leads.where(c).select(F.col("id").alias("_lead"), F.col("text_hash").alias("_hash")),
                                (docs[id_column] == F.col("_lead")) & same, "left_semi") for c in ("n = 1", "n > 1"))
    return (once.unionByName(repeated.dropDuplicates([id_column, text_column]))
            .unionByName(docs.where(F.col(id_column).isNull())))
