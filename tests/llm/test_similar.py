import numpy as np
import pytest
import re
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, graph, simhash, topk


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(prints))]


def test_fingerprints_and_components(spark, docs, empty, folder):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is None, r[0] or 0))
    prints = [brute_print(r["text"]) for r in rows]
    want = sorted(zip([str(r[0]) for r in rows], [format(p, "016x") for p in prints], map(str, brute_components(prints, [r[0] for r in rows]))))
    assert sorted((str(a), b, str(c)) for a, b, c in simhash.op2_simhash(spark, folder).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_links_of_planted_prints(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = list(map(int, base)) + [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base[:30] for i, j in rng.integers(0, 64, (8, 2))] + [0, 7, (1 << 64) - 1, (1 << 64) - 8]
    prints = sorted(set(prints))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    for tile in (4, 512):
        links = graph.components(simhash.near_links(df, tile=tile))
        got = {r["node"] & ((1 << 64) - 1): r["root"] for r in links.collect()}
        comp = brute_components(prints, prints)
        groups = {}
        for p, c in zip(prints, comp):
            groups.setdefault(c, set()).add(p)
        want = {frozenset(g) for g in groups.values() if len(g) > 1}
        mine = {}
        for p, r in got.items():
            mine.setdefault(r, set()).add(p)
        assert {frozenset(g) for g in mine.values()} == want


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, None)] + [(300, 301), (301, 300)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}, 300: 300, 301: 300}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_of_each_group(spark, docs):
    kept = simhash.keep_one(docs)
    rows = docs.select("doc_id", "text").collect()
    comp = brute_components([brute_print(r["text"]) for r in rows], [r["doc_id"] for r in rows])
    want = sorted({c for c in comp if c is not None})
    assert sorted(r[0] for r in kept.where("doc_id is not null").select("doc_id").collect()) == want
    assert kept.where("doc_id is null").count() == 1 and kept.columns == docs.columns


def test_top_k_matches_brute_force(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(256 * np.array([r["embedding"] for r in rows], float)).astype(np.int64)
    ids = [r["vec_id"] for r in rows]
    want = []
    for i, name in enumerate(ids):
        if name % 50 == 0:
            best = sorted((-int(s), v) for s, v in zip(x @ x[i], ids) if v != name)[:5]
            want += [(name, k + 1, v, -s) for k, (s, v) in enumerate(best)]
    assert sorted(map(tuple, topk.op6_top_k(spark, folder).collect())) == sorted(want)


def test_top_k_broadcasts_no_copies_of_the_queries(spark, folder):
    """Blocks beside every slot are many times their size; through a broadcast the driver would hold them all."""
    plan = topk.op6_top_k(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "leftHint=(strategy=merge)" in plan


def test_top_k_of_ties_bad_vectors_and_few_rows(spark):
    rows = [(i, [float(i % 3), 1.0], "q") for i in range(300)] + [(400, None, "q"), (401, [None, 1.0], "q"), (450, [float("nan"), 1.0], "q"),
                                                             (500, [1.0], "q"), (None, [9.0, 9.0], "q"), (405, [], "q"), (550, [1.0, 2.0, 3.0], "q"), (551, [1.0, 2.0, 3.0], "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string").repartition(6)
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id").collect()))
    assert {g[0] for g in got} == {0, 50, 100, 150, 200, 250, 550}
    assert [g[2] for g in got if g[0] == 50] == [2, 5, 8, 11, 14] and [g[2] for g in got if g[0] == 0] == [1, 2, 3, 4, 5]
    assert [g for g in got if g[0] == 550] == [(550, 1, 551)]
    assert topk.top_k(df.where("vec_id > 990"), F.lit(True)).count() == 0


def brute_align(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_alignment_matches_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(150):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 30))
        score, first, end = decontaminate.align(a, b)
        assert score == brute_align(a, b) == brute_align(a, b[first:end])


@pytest.fixture(scope="module")
def leaks(spark):
    import random
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(20)] + [(90, None), (91, ""), (92, "too short"), (None, "an item with no id at all")]
    fill = lambda n: " ".join(word() for _ in range(n))
    docs, want = [], set()
    for i in range(20):
        w = items[i][1].split()
        edited = [word() if k % 7 == 3 else x for k, x in enumerate(w)]
        docs += [(10 * i, f"{fill(40)} {', '.join(w).title()}. {fill(40)}"), (10 * i + 1, f"{fill(9)} {' '.join(edited)} {fill(400)}"),
                 (10 * i + 2, fill(200)), (10 * i + 3, f"{fill(20)} {' '.join(w[:6])} {fill(20)}")]
        want |= {(10 * i, i), (10 * i + 1, i)}
    docs += [(900, None), (901, ""), (None, fill(30)), (0, docs[0][1])]
    return (spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), want)


def test_decontamination_finds_whole_and_edited_items(spark, leaks, empty):
    docs, items, want = leaks
    got = decontaminate.contaminated(docs, items)
    assert {(r["id"], r["item"]) for r in got.collect()} == want
    kept = decontaminate.drop_contaminated(docs, items)
    assert sorted(str(r[0]) for r in kept.select("doc_id").collect()) == sorted(str(r[0]) for r in docs.collect() if r[0] not in {a for a, _ in want})
    assert decontaminate.contaminated(docs, items.where("item_id > 90")).count() == 0
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == docs.count()


def test_decontamination_whatever_the_edits_break(spark):
    rng = np.random.default_rng(4)
    count = iter(range(10**6))
    words = lambda k: [f"w{next(count)}x" for _ in range(k)]
    items = [words(30) for _ in range(12)]
    copies = [(i, {k for k in range(30) if k % 7 == i % 7}) for i in range(7)] + [(7 + i % 5, set(rng.choice(30, 4, replace=False).tolist())) for i in range(40)]
    docs = [words(20) + w + words(20) for w in items for _ in range(3)]  # whole copies make intact and broken seeds alike
    for i, gone in copies:
        edited = [words(1)[0] if k in gone else x for k, x in enumerate(items[i])]
        assert brute_align(items[i], edited) >= 36
        docs.append(words(20) + edited + words(20))
    want = {(k, k // 3) for k in range(36)} | {(36 + k, i) for k, (i, _) in enumerate(copies)}
    frame = lambda rows, name: spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], f"{name} long, text string")
    got = decontaminate.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).select("id", "item", "score").collect()
    assert {(r[0], r[1]) for r in got} == want
    assert all(abs(r[2] - brute_align(items[r[1]], docs[r[0]]) / 60) < 1e-12 for r in got)


def test_decontamination_of_the_table(spark, docs, folder):
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.op9_decontaminate(spark, folder).collect()}
    plain = lambda t: f" {' '.join((t or '').lower().split())} "
    items = [(r["item_id"], plain(r["text"])) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert {(r["doc_id"], i) for r in docs.collect() for i, t in items if t in plain(r["text"])} <= found
