import random

import corpus_pipeline
from tidemark.llm import catalog, near_copies
from tidemark.llm.common import table


def test_stages_keep_columns_and_take_effect(spark, docs, folder):
    now, sizes = table(spark, folder, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        nxt = stage(spark, now, folder)
        nxt.write.parquet(f"{folder}/out-{name}")
        before, now = now, spark.read.parquet(f"{folder}/out-{name}")
        sizes.append(now.count())
        if name != "packing":
            assert now.columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    assert docs.count() >= sizes[0] > sizes[1] > sizes[2] == sizes[3] <= sizes[4]
    last = spark.read.parquet(f"{folder}/out-secrets")
    assert last.where("text rlike 'AKIA[A-Z0-9]{16}'").count() == 0
    assert last.where("n_chars <> char_length(text)").count() == 0
    assert {r[0] for r in now.select("doc_id").collect()} == {r[0] for r in before.select("doc_id").collect()}


def test_stages_of_an_empty_table(spark, empty, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_run_is_the_stages_one_after_the_other(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in catalog.queries()} == {f"op{i}" for i in range(1, 14)}


def test_near_copies_of_similarity_four_fifths_go(spark, folder):
    rng = random.Random(3)
    docs, sets = [], []
    for g in range(30):
        base = [f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(15, 400))]
        for c in range(6):
            words = list(base)
            for k in rng.sample(range(len(words)), rng.randrange(1 + len(words) // 30)) if c else []:
                words[k] = f"n{rng.randrange(10**9)}"
            docs.append((len(docs), " ".join(words)))
            sets.append({tuple(words[i:i + 5]) for i in range(len(words) - 4)})
    root = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                hi, lo = max(root[a], root[b]), min(root[a], root[b])
                root = [lo if r == hi else r for r in root]
    assert 30 < len(set(root)) < 120
    docs += [(900, "one id and a text"), (900, "one id and another text"), (900, "one id and a text")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    kept = sorted(map(tuple, corpus_pipeline.near_dedup(spark, df, folder).collect()))
    assert kept == sorted([docs[k] for k in set(root)] + docs[180:182])


def test_near_dedup_compares_near_fingerprints(spark, folder):
    prints = spark.createDataFrame([(7, 0), (3, 0b111), (9, 0b111), (5, 0b1111111 << 40), (2, -1)], "node long, fp long")
    assert {frozenset(r) for r in near_copies._by_fingerprint(prints).collect()} == {frozenset((7, 3)), frozenset((9, 3))}
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "A b c d e f g"), (3, None), (4, ""), (5, "a text of its own")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, folder).collect()) == [1, 3, 5]
