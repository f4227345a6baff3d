"""Centroid clustering of whole-number vectors; the nearest centroid is found coarse to fine in Walsh-Hadamard coefficients."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.registry import query

SCALE = 1024.0
NARROW = 1 << 27                       # coefficients up to here give squared distances within 64 bits
STEPS = (0, 1, 2, 4, 8, 16, 32, 64)    # coefficients seen when centroids are dropped
CHUNK = 1 << 14                        # vectors compared at once, 8 MB of coefficients
HALF = 1 << 40                         # sums travel as high and low part
LARGEST = (1 << 63) - 1
FINITE = 1e45                          # scaled components from here on count as infinite; no 32-bit float gets there
CODED = "vec_id long, coefs array<long>, wide string"


def coarse_to_fine(n: int) -> np.ndarray:
    """Places of a fast transform's ``n`` coefficients by their number of sign changes."""
    bits = n.bit_length() - 1
    gray = np.arange(n) ^ (np.arange(n) >> 1)
    return np.array([int(f"{g:0{bits}b}"[::-1], 2) for g in gray.tolist()]) if bits else np.zeros(1, int)


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """The transform of every row (a power of two long) in whole numbers, coarse coefficients first.

    Squared distances grow by the row length exactly, so they can be summed coefficient by coefficient.
    """
    rows, n = x.shape
    y, h = x.copy(), 1
    while h < n:
        y = y.reshape(rows, n // (2 * h), 2, h)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(rows, n)
        h *= 2
    return y[:, coarse_to_fine(n)]


def inverse(y: np.ndarray) -> np.ndarray:
    """The rows whose transform is ``y``."""
    back = np.empty_like(y)
    back[:, coarse_to_fine(y.shape[1])] = y
    natural = walsh_hadamard(back)
    out = np.empty_like(natural)
    out[:, coarse_to_fine(y.shape[1])] = natural
    return out // y.shape[1]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of coefficients: the nearest centroid (ties: the smaller number) and its squared distance, scaled by the length.

    Each step adds the squared differences of its coefficients for the centroids still in. After the first, the
    centroid that leads is finished; what a sum already exceeds can only be further away and is dropped. Centroids that
    are still in have all coefficients summed in the end.
    """
    rows, k = len(x), len(centroids)
    partial = np.zeros((rows, k), x.dtype)
    alive = np.ones((rows, k), bool)
    bound = None
    for a, b in zip(STEPS, STEPS[1:]):
        for c in range(k):
            at = np.flatnonzero(alive[:, c])
            d = x[at, a:b] - centroids[c, a:b]
            partial[at, c] += (d * d).sum(axis=1)
        if bound is None:
            leader = partial.argmin(axis=1)
            d = x[:, b:] - centroids[leader, b:]
            bound = partial[np.arange(rows), leader] + (d * d).sum(axis=1)
        alive &= partial <= bound[:, None]
    best = np.full(rows, -1)
    distance = bound.copy()
    for c in range(k):
        better = alive[:, c] & ((partial[:, c] < distance) | (best < 0) & (partial[:, c] == distance))
        best[better], distance[better] = c, partial[better, c]
    return best, distance


def _code(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.floor(batch.column("x").flatten().to_numpy() * scale).reshape(batch.num_rows, -1)
        small = np.abs(x).max(axis=1) * x.shape[1] < NARROW
        coefs: list = [None] * len(x)
        wide: list = [None] * len(x)
        at = np.flatnonzero(small)
        for i, row in zip(at.tolist(), walsh_hadamard(x[at].astype(np.int64))):
            coefs[i] = row
        for i in np.flatnonzero(~small).tolist():
            row = walsh_hadamard(np.array([[int(v) for v in x[i].tolist()]], object))[0]
            wide[i] = ",".join(map(str, row))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(coefs, pa.list_(pa.int64())), pa.array(wide, pa.string())],
                                         ["vec_id", "coefs", "wide"])


def _chunks(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, coefficients): narrow rows in 64 bits, wide ones as Python integers."""
    coefs, wide = batch.column("coefs"), batch.column("wide")
    at = np.flatnonzero(coefs.is_valid().to_numpy(zero_copy_only=False))
    x = coefs.flatten().to_numpy().reshape(len(at), dim)
    for i in range(0, len(at), CHUNK):
        yield at[i:i + CHUNK], x[i:i + CHUNK]
    far = np.flatnonzero(wide.is_valid().to_numpy(zero_copy_only=False))
    for i in range(0, len(far), CHUNK):
        part = far[i:i + CHUNK]
        yield part, np.array([[int(v) for v in wide[j].as_py().split(",")] for j in part.tolist()], object)


def _compared(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if x.dtype != object and max(map(abs, centroids.ravel().tolist())) < NARROW:
        return nearest(x, centroids.astype(np.int64))
    return nearest(x.astype(object), centroids)


def _sums(centroids: np.ndarray):
    """Per task: each centroid's sum of coefficients and its number of rows."""
    k, dim = centroids.shape

    def run(batches):
        total, count = np.zeros((k, dim), object), [0] * k
        for batch in batches:
            for _, x in _chunks(batch, dim):
                best, _ = _compared(x, centroids)
                for c in range(k):
                    mine = x[best == c]
                    if len(mine):
                        total[c] += mine.sum(axis=0)
                        count[c] += len(mine)
        held = [(c, d) for c in range(k) if count[c] for d in range(dim)]
        parts = [divmod(int(total[c, d]), HALF) for c, d in held]
        with localcontext() as context:
            context.prec = 60
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in held], pa.int32()), pa.array([d for _, d in held], pa.int32()),
                 pa.array([Decimal(h) for h, _ in parts], pa.decimal128(38, 0)), pa.array([Decimal(low) for _, low in parts], pa.decimal128(38, 0)),
                 pa.array([count[c] for c, _ in held], pa.int64())], ["cluster", "place", "high", "low", "n"])

    return run


def _assigned(centroids: np.ndarray):
    dim = centroids.shape[1]

    def run(batches):
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), [0] * batch.num_rows
            for at, x in _chunks(batch, dim):
                best, far = _compared(x, centroids)
                cluster[at] = best
                for i, d in zip(at.tolist(), far.tolist()):
                    distance[i] = min(d // dim, LARGEST)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster), pa.array(distance, pa.int64())],
                                             ["vec_id", "cluster", "distance"])

    return run


def kept_vectors(vectors: DataFrame, id_column: str, vector_column: str, dim: int, scale: float) -> DataFrame:
    """(vec_id, x) of the rows whose vector has exactly ``dim`` components, none of them null or non-finite."""
    v = F.col(vector_column)
    sound = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < FINITE))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_column).cast("long").alias("vec_id"), v.cast("array<double>").alias("x"))


def starting_order(id_column: str = "vec_id", seed: int = 3) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")), 256)


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, id_column: str = "vec_id", vector_column: str = "embedding",
                    dim: int = 64, scale: float = SCALE, seed: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) per kept vector, the final centroids as lists of whole numbers).

    Components become floor(scale * x) and every vector's Walsh-Hadamard coefficients are written once. The first
    centroids are the ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``. A round finds each vector's nearest
    centroid in its coefficients (:func:`nearest`) and sums coefficients by cluster inside each task; Spark adds these
    up, the driver sees k times ``dim`` sums. The transform is linear and its inverse exact, so the sums of coefficients
    give the sums of components, and a centroid becomes their floored mean. Empty clusters keep their centroid.

    Vectors of another length, null ones and those with null or non-finite components take no part. Rows with a null id
    are assigned but are no first centroid; rows that repeat an id are each assigned, and those tied in the hash come in
    order of their components. Fewer than ``k`` vectors give fewer centroids, none give no rows. Coefficients that 64-bit
    squares cannot hold are carried as Python integers; distances beyond a long are given as its largest value. Other
    columns are not read. ``dim`` is a power of two up to 64.
    """
    if dim not in STEPS[1:]:
        raise ValueError("dim must be a power of two up to 64")
    rows = kept_vectors(vectors, id_column, vector_column, dim, scale)
    coded = stored(rows.mapInArrow(lambda b: _code(b, scale), CODED), "coefficients")
    first = (rows.where("vec_id IS NOT NULL").orderBy(starting_order("vec_id", seed), "x").limit(k).select("x").collect())
    if not first:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), []
    start = np.array([[int(v) for v in np.floor(np.array(r["x"]) * scale).tolist()] for r in first], object)
    centroids = start
    for _ in range(rounds):
        sums = (coded.mapInArrow(_sums(walsh_hadamard(centroids)), "cluster int, place int, high decimal(38,0), low decimal(38,0), n long")
                .groupBy("cluster", "place").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).collect())
        total, count = np.zeros(centroids.shape, object), {}
        for s in sums:                      # k * dim rows
            total[s["cluster"], s["place"]] = int(s["high"]) * HALF + int(s["low"])
            count[s["cluster"]] = s["n"]
        moved = inverse(total)
        after = np.array([moved[c] // count[c] if c in count else centroids[c] for c in range(len(centroids))], object)
        if (after == centroids).all():      # no later round would move anything
            break
        centroids = after
    return coded.mapInArrow(_assigned(walsh_hadamard(centroids)), "vec_id long, cluster int, distance long"), [list(c) for c in centroids]


@query("op11_clusters")
def op11_clusters(spark, sf_dir):
    found, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    found = stored(found, "assigned")
    whole = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()   # k rows
    by = {r["cluster"]: int(r["s"]) for r in whole}
    facts = [(c, min(s, LARGEST), min(sum(by.values()), LARGEST), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
             for c, s in by.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
