"""Best-fit packing of documents' token pieces into sequences of fixed length."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import in_groups, stored, table
from tidemark.llm.registry import query
from tidemark.llm.tokens import VOCABULARY, encoder

CAPACITY = 2048


def token_pieces(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str = VOCABULARY,
                 end_id: int | None = 0, capacity: int = CAPACITY, whole: bool = False) -> DataFrame:
    """(id, piece, start, length, ids): whole texts as ids, cut into pieces only where longer than ``capacity``.

    ``ids`` holds unsigned 32-bit little-endian integers. A null or empty text is its end id alone. Rows with a null
    or repeated id are each cut by themselves. Extra columns are not read.
    """
    def run(batches):
        enc = encoder(tokenizer, whole)
        tail = np.array([] if end_id is None else [end_id], enc.kind)
        for b in batches:
            at = 0
            for group in in_groups(b["text"]):
                rows = []
                for name, ids in zip(b["id"].iloc[at:at + len(group)], enc.encode(group)):
                    ids = np.concatenate([ids, tail]).astype("<u4")
                    rows += [(name, k, s, len(ids[s:s + capacity]), ids[s:s + capacity].tobytes())
                             for k, s in enumerate(range(0, len(ids), capacity))]
                at += len(group)
                out = pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids"])
                yield out.astype({"id": b["id"].dtype})

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, piece int, start long, length long, ids binary")


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Place ``counts[size]`` items of each size; returns runs (size, first rank, end rank, first sequence, offset).

    Supersteps go from the largest size down. In each, all items of a size sweep the gaps upwards from their
    smallest fit: the item of rank r within its size takes the r-th of those gaps, so no two want the same one. The
    gaps taken shrink by the size, and the sweep is repeated until no gap is left, when sequences are opened for
    the rest. State is a list of stretches of sequences per gap size, never a row per item.
    """
    open_gaps: dict[int, list[tuple[int, int]]] = {}   # gap -> stretches (first sequence, count)
    order: list[int] = []                              # gaps that have stretches, ascending
    runs, opened = [], 0

    def put(gap, first, count):
        if gap and count:
            if gap not in open_gaps:
                open_gaps[gap] = []
                bisect.insort(order, gap)
            open_gaps[gap].append((first, count))

    for size in sorted(counts, reverse=True):
        rank, end = 0, counts[size]
        while rank < end:
            k = bisect.bisect_left(order, size)
            if k < len(order):
                gap = order[k]
                first, count = open_gaps[gap].pop()
                if not open_gaps[gap]:
                    del open_gaps[gap], order[k]
                take = min(count, end - rank)
                runs.append((size, rank, rank + take, first, capacity - gap))
                put(gap, first + take, count - take)
                put(gap - size, first, take)
                rank += take
            else:
                each = capacity // size
                full, rest = divmod(end - rank, each)
                for slot in range(each if full else 0):
                    runs.append((size, rank, rank + full, opened, slot * size))
                    rank += full
                put(capacity - each * size, opened, full)
                for slot in range(rest):
                    runs.append((size, rank, rank + 1, opened + full, slot * size))
                    rank += 1
                put(capacity - rest * size, opened + full, 1 if rest else 0)
                opened += full + (1 if rest else 0)
    return runs


def place(items: DataFrame, size_column: str = "length", order_columns: tuple[str, ...] = (), capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset``: items packed by best fit into sequences of at most ``capacity``.

    Items are range-sorted by size, so that one size, however common, lies in several tasks; each task numbers its
    items within a size, and counts per task and size turn these into ranks over all. The sweeps need only how many
    items there are of each of the ``capacity`` sizes, which is the one thing the driver sees; a join on size hands
    each item the run that holds its rank. Items whose size is null, below 1 or above ``capacity`` get null in both.
    """
    names = items.columns

    def number(batches):
        seen: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for b in batches:
            sizes = b["_size"]
            b["_rank"] = sizes.groupby(sizes).cumcount() + sizes.map(lambda s: seen.get(s, 0))
            for s, n in sizes.value_counts().items():
                seen[s] = seen.get(s, 0) + n
            b["_part"] = part
            yield b

    fits = F.col(size_column).between(1, capacity)
    sized = items.where(fits).withColumn("_size", F.col(size_column).cast("int"))
    ordered = sized.repartitionByRange(F.desc("_size"), *order_columns).sortWithinPartitions(F.desc("_size"), *order_columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.schema) + ", _rank long, _part int"
    ranked = stored(ordered.mapInPandas(number, schema), "ranked")
    tallies = ranked.groupBy("_part", "_size").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = tallies.select("_part", "_size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    counts = {r[0]: r[1] for r in tallies.groupBy("_size").agg(F.sum("n")).collect()}  # a row per size: capacity at most
    spark = items.sparkSession
    runs = spark.createDataFrame(best_fit_runs(counts, capacity), "_size int, lo long, hi long, first long, offset long")
    by_size = runs.groupBy("_size").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "first", "offset"))).alias("_runs"))
    rank = F.col("_rank") + F.col("_base")
    run = F.filter("_runs", lambda r: (r["lo"] <= rank) & (rank < r["hi"]))[0]
    # both are small by construction: a row per size, or per task and the few sizes that a range-sorted task holds
    placed = (ranked.join(F.broadcast(bases), ["_part", "_size"]).join(F.broadcast(by_size), "_size").withColumn("_run", run)
              .select(*names, (F.col("_run.first") + rank - F.col("_run.lo")).alias("sequence_id"), F.col("_run.offset").alias("offset")))
    empty = F.lit(None).cast("long")
    return placed.unionByName(items.where(~F.coalesce(fits, F.lit(False)))
                              .select(*names, empty.alias("sequence_id"), empty.alias("offset")))


def packed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, **how) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece; the ids stay in ``token_pieces``."""
    pieces = token_pieces(docs, id_column, text_column, capacity=capacity, **how)
    slim = stored(pieces.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return place(slim, "length", ("doc_id", "piece"), capacity)


@query("op4_best_fit")
def op4_best_fit(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))
