"""SimHash near-duplicates: 64-bit fingerprints compared exactly, tile against tile."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.graph import components
from tidemark.llm.registry import query

BITS = 64
PARTS = 4                    # population counts are taken of 16-bit parts
PART_BITS = BITS // PARTS
TILE = 512                   # fingerprints of a tile, about


def fingerprint(raw: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of a UTF-8 text's word shingles; A-Z are lower-cased, words end at ASCII white space."""
    words = raw.lower().split()  # of bytes: only A-Z change, only the six ASCII spaces split
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        digest, at = xxhash.xxh64_intdigest, zip((ends - lengths).tolist(), ends[width - 1:].tolist())
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in at), np.uint64, len(words) - width + 1)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        octets = hashes[i:i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3,
                 seed: int = 42) -> DataFrame:
    """(id, fp long) of every row. A null or blank text has fingerprint zero. Other columns are not read."""
    def run(batches):
        for ids, texts in ((b.iloc[:, 0], b.iloc[:, 1]) for b in batches):
            fp = np.fromiter((fingerprint((t or "").encode(), width, seed) for t in texts), np.uint64, len(texts))
            yield pd.DataFrame({"id": ids, "fp": fp.view(np.int64)})

    kind = docs.schema[id_column].dataType.simpleString()
    return (docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
            .mapInPandas(run, f"id {kind}, fp long"))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node that each of ``n`` nodes reaches by the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        was = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(label, was):
            return label


def _links(radius: int):
    """Compare tile pairs; of the links found in a pair only a spanning forest leaves the task."""
    def run(batches):
        for b in batches:
            left, right = [], []
            for x, y, same in zip(b["x"], b["y"], b["same"]):
                x, y = np.asarray(x, np.int64), np.asarray(y, np.int64)
                near = np.bitwise_count((x[:, None] ^ y[None, :]).view(np.uint64)) <= radius
                if same:
                    near = np.triu(near, 1)
                if near.any():
                    i, j = np.nonzero(near)
                    nodes = x if same else np.concatenate([x, y])
                    label = _forest(len(nodes), i, j if same else j + len(x))
                    moved = np.flatnonzero(label != np.arange(len(nodes)))
                    left.append(nodes[moved])
                    right.append(nodes[label[moved]])
            if left:
                yield pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})
    return run


def near_links(classes: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(a, b) fingerprint pairs at most ``radius`` bits apart that connect all that are so near.

    ``classes`` holds distinct fingerprints ``fp``. Their cell is the population count of each 16-bit part; two
    fingerprints within the radius have counts that differ by no more than it in sum, so only such cells are paired.
    A cell of any size is cut into tiles; a tile pair is compared whole, by exclusive-or and bit count.
    """
    places = [(2 * PART_BITS + 1) ** k for k in range(PARTS)]  # room for a step beyond either end
    counts = [F.bit_count(F.shiftrightunsigned("fp", PART_BITS * k).bitwiseAND(F.lit((1 << PART_BITS) - 1)))
              for k in range(PARTS)]
    cell = sum((c.cast("long") * p for c, p in zip(counts, places)), F.lit(0))
    cells = classes.select("fp", cell.alias("cell"))
    pieces = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("pieces"))
    tiles = stored(cells.join(pieces, "cell").withColumn("piece", F.pmod(F.xxhash64("fp"), "pieces").cast("int"))
                   .groupBy("cell", "piece").agg(F.collect_list("fp").alias("tile")), "tiles")
    steps = [s for s in itertools.product(range(-radius, radius + 1), repeat=PARTS)
             if sum(map(abs, s)) <= radius and s >= (0,) * PARTS]  # each pair of cells from one side only
    moves = F.array(*[F.lit(sum(a * b for a, b in zip(s, places))).cast("long") for s in steps])
    left = tiles.select(F.col("cell").alias("own"), F.col("piece").alias("p"), F.col("tile").alias("x"),
                        F.explode(moves).alias("move")).withColumn("cell", F.col("own") + F.col("move"))
    pairs = (left.join(tiles.select("cell", F.col("piece").alias("q"), F.col("tile").alias("y")), "cell")
             .where("move <> 0 or p <= q").select("x", "y", F.expr("move = 0 and p = q").alias("same")))
    return pairs.mapInPandas(_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, seed: int = 42,
                    radius: int = 3) -> DataFrame:
    """(id, fp, component): every row with its fingerprint and the smallest id it is linked to, its own included.

    Exact copies share a fingerprint and are one node, however many they are. A row with a null id keeps its
    fingerprint; its component is the smallest id among the others, or null where it has none. Rows that repeat an
    id are all returned. An empty table gives no rows. Extra columns are not read.
    """
    prints = stored(fingerprints(docs, id_column, text_column, width, seed), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    roots = components(near_links(classes, radius)).withColumnRenamed("node", "fp")
    linked = classes.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = stored(linked.join(least, "root").select("fp", "least"), "linked")
    of_class = classes.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component"))
    return prints.join(of_class, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that lead their group: one document of each group of near-duplicates stays.

    Rows with a null id are kept, as nothing else could name them. Rows that repeat an id are cut to one.
    """
    leads = stored(near_duplicates(docs, id_column, text_column, **how).where("id = component").groupBy("id").count(), "leads")
    once, repeated = (docs.join(leads.where(c).select(F.col("id").alias("_lead")), docs[id_column] == F.col("_lead"), "left_semi")
                      for c in ("count = 1", "count > 1"))
    return (once.unionByName(repeated.dropDuplicates([id_column]))
            .unionByName(docs.where(F.col(id_column).isNull())))


@query("op2_simhash")
def op2_simhash(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.col("component").alias("component_id"))
