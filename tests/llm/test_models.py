import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import gru, lm_score, toxicity


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = gru.Gru.fresh(np.array([.2, .3, .5]), hidden=5)
    net.flat = net.flat.astype(float)
    net.p = net.views(net.flat)
    seen, fresh, target = rng.integers(0, 3, (6, 4)).astype(np.uint8), rng.random((6, 4)) < .3, rng.integers(0, 3, (6, 4)).astype(np.uint8)

    def loss():
        _, kept, after, logs = net.window(np.zeros((5, 4)), seen, fresh)
        return -np.take_along_axis(logs, target.astype(int)[:, None], 1).mean(), kept, after, logs

    _, kept, after, logs = loss()
    g = net.gradient(kept, after, logs, seen, fresh, target, np.ones((6, 4)))
    for i in range(0, len(g), 7):
        was = net.flat[i]
        net.flat[i] = was + 1e-5
        up = loss()[0]
        net.flat[i] = was - 1e-5
        down = loss()[0]
        net.flat[i] = was
        assert abs((up - down) / 2e-5 - g[i]) < 1e-6


def test_network_scores_whole_documents_whatever_the_lanes(monkeypatch):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 5, n).astype(np.uint8) for n in (1, 2, 40, 333, 7, 16, 17)]
    net = gru.Gru.fresh(np.full(5, .2))
    alone = [gru.score(net, [d], 4)[0] for d in docs]
    assert np.allclose(gru.score(net, docs, 4), alone, rtol=1e-4)
    monkeypatch.setattr(gru, "LANES", 2)
    assert np.allclose(gru.score(net, docs, 4), alone, rtol=1e-4)


def test_network_learns_what_follows_what():
    docs = [np.array([k, *([(k + 1) % 4] * n), 4], np.uint8) for k in range(4) for n in range(3, 60)]
    net, memory = gru.Gru.fresh(np.full(5, .2)), {}
    before = gru.score(net, docs, 4).sum()
    for _ in range(20):
        gru.learn(net, docs, 4, memory)
    assert gru.score(net, docs, 4).sum() > 0.4 * before


def test_scores_of_documents(spark, docs, empty, folder):
    got = lm_score.op8_lm_scores(spark, folder).collect()
    words = {}
    for r in docs.select("doc_id", "text").collect():
        words.setdefault(r["doc_id"], []).append((r["text"] or "").encode().lower().split() + [b""])
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i in words}
    c = Counter(w for i, ts in words.items() if not held[i] for t in ts for w in t)
    n, base = sum(c.values()), math.log10(sum(c.values()) + len(c) + 1)
    assert len(got) == docs.count()
    for r in got:
        t = words[r["doc_id"]][0]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10(c[w] + 1) for w in t) - len(t) * base, rel=1e-9, abs=1e-6)
        assert r["score"] < 0
    assert lm_score.lm_scores(empty, F.lit(False)).count() == 0
    alone = lm_score.lm_scores(docs.where("doc_id < 20"), F.lit(True)).collect()     # nothing to learn from
    assert len(alone) == 20 and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in alone)


def test_held_out_documents_score_above_the_base(spark):
    got = lm_score.op8_lm_scores(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > got[1] + 0.05 * got[2]


def test_sparse_words_take_the_join(spark, docs, folder, monkeypatch):
    monkeypatch.setattr(lm_score, "DENSE", 50)
    few = lm_score.op8_lm_scores(spark, folder).select("doc_id", "n_known", F.round("base_score", 6)).collect()
    monkeypatch.undo()
    assert Counter(few) == Counter(lm_score.op8_lm_scores(spark, folder).select("doc_id", "n_known", F.round("base_score", 6)).collect())


def test_ordinal_fit_recovers_order_and_shares_weights():
    rng = np.random.default_rng(3)
    true = np.array([2.0, -2.0, 1.0, 0.0, 0.0])
    rows = [np.flatnonzero(rng.random(5) < 0.5) for _ in range(4000)]
    s = np.array([true[r].sum() for r in rows]) + rng.logistic(size=4000)
    grades = np.digitize(s, [0.0, 1.5, 3.0])
    w, cuts = toxicity.fit_ordinal(rows, grades, 5, 4, steps=600, l1=0.0)
    assert (np.diff(cuts) > 0).all() and w[0] > 1 and w[1] < -1 and abs(w[3]) < 0.4


def test_toxic_documents_are_told_apart(spark):
    import random
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(2))
    rows = []
    for i in range(800):
        bad = ["grobian", "lumpling", "scheusal"][:rng.randrange(1, 4)] if i % 5 == 0 else []
        w = [word() for _ in range(60)] + bad
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(bool(bad)), "x"))
    docs = spark.createDataFrame([*rows, (None, "grobian", 1, "x"), (901, None, None, "x"), (902, "", 0, "x"), (0, rows[0][1], 1, "x")], "doc_id long, text string, toxic int, grade string")
    labels = docs.where("doc_id < 400").select("doc_id", F.col("toxic").alias("grade"))
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.with_severity(docs, model).collect()}
    assert all((got[i]["p_toxic"] >= 0.5) == bool(t) for i, _, t, _ in rows[400:])
    assert got[901]["p_toxic"] < 0.5 and got[902]["p_toxic"] < 0.5 and got[None]["p_toxic"] >= 0.5
    assert 0 <= min(r["expected_severity"] for r in got.values()) and max(r["expected_severity"] for r in got.values()) <= 3
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r[0] for r in kept.select("doc_id").collect()} == {i for i, _, t, _ in rows if not t} | {901, 902}


def test_nothing_to_learn_means_nothing_is_toxic(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert toxicity.drop_toxic(docs, none).count() == docs.count()
    only = spark.createDataFrame([(1, 1), (None, 0), (2, 9)], "doc_id long, grade int")
    assert toxicity.drop_toxic(docs, only).count() == docs.count()
    assert toxicity.drop_toxic(empty, only).count() == 0


def test_grades_are_used_where_given(spark):
    texts = [(i, f"filler{i % 9} common " + " ".join(["mild", "bad", "worse"][:i % 4])) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 4 as int) as grade")
    got = toxicity.with_severity(docs, toxicity.train(docs, labels)).select("doc_id", "expected_severity").collect()
    means = [np.mean([r[1] for r in got if r[0] % 4 == g]) for g in range(4)]
    assert means == sorted(means) and means[3] > means[0] + 1
