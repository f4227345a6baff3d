import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import clustering as cl

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, x double, coefs string"


def brute(rows, k=8, rounds=10, dim=64):
    """The same clustering in plain Python: every distance of every vector, in components."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds if centroids else 0):
        found = assign()
        for c in range(len(centroids)):
            mine = [v for (_, v), (b, _) in zip(kept, found) if b == c]
            if mine:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine)]
    if not centroids:
        return []
    found = assign()
    total = sum(d for _, d in found)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, sum(e for b, e in found if b == c), total, digests[c]) for (i, _), (c, d) in zip(kept, found)]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2 ** 32), st.integers(1, 12), st.sampled_from([1, 3, 60]))
def test_nearest_is_the_full_comparison(seed, k, spread):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-spread, spread + 1, (70, 64)), rng.integers(-spread, spread + 1, (k, 64))
    c[-1] = c[0]                                                   # a tie between equal centroids
    full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    for kind in (np.int64, object):
        best, d = cl.nearest(cl.walsh_hadamard(x.astype(kind)), cl.walsh_hadamard(c.astype(kind)))
        assert best.tolist() == full.argmin(axis=1).tolist() and (d // 64).tolist() == full.min(axis=1).tolist()


def test_transform_is_ordered_and_exact():
    eye = cl.walsh_hadamard(np.eye(64, dtype=np.int64)).T
    assert [int((np.diff(r) != 0).sum()) for r in eye] == list(range(64))
    x = np.random.default_rng(1).integers(-10 ** 6, 10 ** 6, (9, 64))
    assert (cl.inverse(cl.walsh_hadamard(x)) == x).all()


def edge_rows(spark):
    base = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    flat = [0.5] * 64
    return base + [(None, flat), (7001, None), (7002, []), (7003, flat[:63]), (7004, flat + [1.0]), (7005, flat[:63] + [None]),
                   (7006, flat[:63] + [float("nan")]), (7007, flat[:63] + [float("-inf")]), (7008, flat), (7008, flat), (7008, [0.25] * 64),
                   (7009, [-0.0] * 64)]


def test_clusters_equal_plain_lloyd(spark, tmp_path):
    rows = edge_rows(spark)
    spark.createDataFrame([(*r, 1, "c", 0.0, "z") for r in rows], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = cl.op11_clusters(spark, str(tmp_path)).collect()
    single = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(brute(single), key=key)


def test_few_none_and_far_vectors(spark):
    make = lambda rows: spark.createDataFrame([(*r, 1, "c", 0.0, "z") for r in rows], SCHEMA)
    assert cl.cluster_vectors(make([]))[0].count() == 0
    assert cl.cluster_vectors(make([(1, None), (None, [1.0] * 64)]))[0].count() == 0
    two, centroids = cl.cluster_vectors(make([(1, [1.0] * 64), (2, [2.0] * 64), (2, [2.0] * 64)]), rounds=3)
    assert len(centroids) == 3 and {r["distance"] for r in two.collect()} == {0}
    near, far = [3.0 + i / 64 for i in range(64)], [3.0e38] * 64
    rows = [(1, near), (2, far), (3, [-v for v in far]), (4, near[::-1])]
    got, centroids = cl.cluster_vectors(make(rows), k=2)
    want = brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows], k=2)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()) == sorted((r[0], r[1], min(r[2], cl.LARGEST)) for r in want)
    assert {hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids} >= {r[5] for r in want}


def test_other_lengths(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)], "id long, v array<double>")
    found, centroids = cl.cluster_vectors(df, k=3, id_column="id", vector_column="v", dim=2)
    assert found.count() == 9 and len(centroids) == 3
    with pytest.raises(ValueError):
        cl.cluster_vectors(df, dim=3)
