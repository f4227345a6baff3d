"""Exact top-k search by inner product: score histograms locate each query's k-th score, then rows are filtered."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.registry import query

TILE = 4096            # candidates of a tile
BLOCK = 256            # queries of a block
BINS = 4096            # bins of a histogram pass
SLOTS = 64             # least number of slots, where there are as many tiles
HELD = 16              # tiles of a slot, about, once there are more than SLOTS * HELD


def _usable(embedding: str):
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & (F.size(embedding) > 0), F.lit(False))


def _packed(vectors: DataFrame, rows: int) -> DataFrame:
    """(dim, ids, matrix, norm): up to ``rows`` vectors of one length side by side, as bytes, cut within tasks."""
    def run(batches):
        for b in batches:
            x = [np.asarray(v, np.int64) for v in b["x"]]
            dims = np.array([len(v) for v in x])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                for i in range(0, len(at), rows):
                    part = at[i:i + rows]
                    m = np.stack([x[j] for j in part])
                    norm = float(np.sqrt((m.astype(float) ** 2).sum(axis=1)).max())
                    yield pd.DataFrame({"dim": [int(d)], "ids": [b["id"].to_numpy(np.int64)[part].tobytes()], "matrix": [m.tobytes()], "norm": [norm]})

    return vectors.mapInPandas(run, "dim int, ids binary, matrix binary, norm double")


def _scores(q: bytes, c: bytes, dim: int) -> np.ndarray:
    """Integer inner products, queries by candidates; exact in doubles where they stay below 2**53."""
    a, b = (np.frombuffer(m, np.int64).reshape(-1, dim) for m in (q, c))
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * dim
    if bound < 2.0 ** 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def top_k(vectors: DataFrame, is_query, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, id, score): each query's ``k`` highest integer inner products over all rows but its own.

    Components become floor(scale * x). Queries are the rows where ``is_query`` holds. Query blocks meet all
    candidate tiles in a shuffled join on a slot number. Pass after pass, each block and tile scores everything and counts
    scores in the bins of each query's open interval; the counts are summed over all tiles, and the bin that holds
    the k-th score becomes the next interval, until it is one score wide. In a pass, a tile leaves out only bins
    below its own k-th score. A last pass keeps scores above the k-th value, and of those equal to it the
    smallest ids, which a window then ranks.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a null id.
    Vectors of another length than the query's are no candidates for it. Rows that repeat an id are each candidates,
    but for a query of the same id. Fewer than ``k`` candidates are all returned; no queries give no rows.
    """
    ints = F.transform(vector_column, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.where(_usable(vector_column) & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), ints.alias("x"), F.coalesce(is_query, F.lit(False)).alias("q"))
    tiles = stored(_packed(rows.select("id", "x"), TILE).withColumn("tile", F.monotonically_increasing_id()), "tiles")
    blocks = stored(_packed(rows.where("q").select("id", "x"), BLOCK).withColumn("block", F.monotonically_increasing_id()), "blocks")
    facts = tiles.agg(F.count(F.lit(1)), F.max("norm")).first()
    most = blocks.agg(F.max("norm")).first()[0]
    id_type = vectors.schema[id_column].dataType.simpleString()
    result = f"query_id long, rank int, {id_column} {id_type}, score long"
    if most is None:
        return vectors.sparkSession.createDataFrame([], result)
    slots = min(facts[0], max(SLOTS, facts[0] // HELD))
    dealt = tiles.select((F.pmod(F.xxhash64("tile"), F.lit(slots))).cast("int").alias("slot"), "dim", F.col("ids").alias("cids"), F.col("matrix").alias("c"))

    def grid(packed_state):
        """Blocks with their open intervals, beside every tile. Copies of all blocks, as many as slots, are too much for a
        broadcast through the driver, and Spark takes them for one copy: both sides are shuffled."""
        asked = blocks.join(packed_state, "block").select("dim", F.col("ids").alias("qids"), F.col("matrix").alias("q"), "open",
                                                          F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
        return asked.hint("merge").join(dealt, ["slot", "dim"])

    reach = min(2 ** 62, int(most * facts[1]) + 1)          # no score lies beyond, by Cauchy and Schwarz
    # per query: the k-th score is in [lo, lo + width); ``above`` scores lie beyond
    state = blocks.select("block", "ids").mapInPandas(_open(-reach), "block long, query_id long, lo long, above long")
    width = 2 * reach + 1
    while width > 1:
        step = -(-width // BINS)
        state = stored(state, "state")
        packed_state = state.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("query_id", "lo"))).alias("open"))  # BLOCK rows each
        counts = (grid(packed_state).mapInPandas(_histogram(k, step, width), "query_id long, bin int, n long")
                  .groupBy("query_id", "bin").agg(F.sum("n").alias("n")))
        beyond = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        # queries with fewer than k candidates stay open from below: all their candidates are kept in the end
        reached = (state.join(counts, "query_id", "left").withColumn("seen", F.col("above") + F.sum("n").over(beyond))
                   .groupBy("block", "query_id").agg(
                       F.max(F.when(F.col("seen") >= k, F.col("bin"))).alias("hit"), F.min("lo").alias("lo"), F.min("above").alias("was"),
                       F.collect_list(F.struct("bin", "n")).alias("bins")))
        more = F.aggregate(F.filter("bins", lambda b: b["bin"] > F.col("hit")), F.lit(0).cast("long"), lambda acc, b: acc + b["n"])
        state = reached.select("block", "query_id",
                               F.when(F.col("hit").isNull(), F.lit(-reach)).otherwise(F.col("lo") + F.col("hit") * F.lit(step)).alias("lo"),
                               F.when(F.col("hit").isNull(), 0).otherwise(F.col("was") + more).cast("long").alias("above"))
        width = step
    packed_state = state.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("query_id", "lo"))).alias("open"))
    best = grid(packed_state).mapInPandas(_keep(k), "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").cast(id_type).alias(id_column), "score"))


def _open(lo: int):
    def run(batches):
        for b in batches:
            for block, ids in zip(b["block"], b["ids"]):
                q = np.unique(np.frombuffer(ids, np.int64))
                yield pd.DataFrame({"block": block, "query_id": q, "lo": lo, "above": 0})
    return run


def _rows(b: pd.DataFrame):
    """Per block and tile: query ids, candidate ids, scores, and each query's interval start; own pairs are masked."""
    for dim, qids, q, cids, c, opened in zip(b["dim"], b["qids"], b["q"], b["cids"], b["c"], b["open"]):
        qids, cids = np.frombuffer(qids, np.int64), np.frombuffer(cids, np.int64)
        lows = {r["query_id"]: r["lo"] for r in opened}
        s = _scores(q, c, dim)
        _, first = np.unique(qids, return_index=True)   # a repeated query id is one query, its first row's vector
        first = first[[x in lows for x in qids[first].tolist()]]
        qids, s = qids[first], s[first]
        yield qids, cids, s, qids[:, None] != cids[None, :], np.array([lows[x] for x in qids.tolist()], np.int64)


def _histogram(k: int, step: int, width: int):
    def run(batches):
        for b in batches:
            for qids, cids, s, other, lo in _rows(b):
                kth = np.full(len(qids), np.iinfo(np.int64).min)
                if s.shape[1] > k + 1:
                    kth = np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1]  # own score may be among the k
                floor = np.maximum(lo, lo + np.maximum(kth - lo, 0) // step * step)
                i, j = np.nonzero(other & (s >= floor[:, None]) & (s - lo[:, None] < width))
                cell, n = np.unique(np.stack([i, (s[i, j] - lo[i]) // step]), axis=1, return_counts=True)
                yield pd.DataFrame({"query_id": qids[cell[0]], "bin": cell[1].astype(np.int32), "n": n})
    return run


def _keep(k: int):
    def run(batches):
        for b in batches:
            for qids, cids, s, other, lo in _rows(b):
                i, j = np.nonzero(other & (s >= lo[:, None]))
                out = pd.DataFrame({"query_id": qids[i], "id": cids[j], "score": s[i, j]})
                yield out.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(k)
    return run


@query("op6_top_k", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
   WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
   WHERE q.vec_id % 50 = 0)
 SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
 QUALIFY row_number() OVER w <= 5""")
def op6_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
