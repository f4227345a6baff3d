import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing, token_counts, token_files
from tidemark.llm.tokens import Encoder

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_encoder_gives_the_library_ids(texts):
    enc = Encoder("word_bpe_49k.json", memory=20)
    assert [a.tolist() for a in enc.encode(texts)] == [ids(t) for t in texts]


WORDS = st.text(st.sampled_from("aZé Ünœ Ǆİıſ.,;:!?)\"]([<|'09-\u0301\u00d7\u00df\u0149\x01"), max_size=12)


SMALL = Encoder("word_bpe_49k.json", memory=30)      # forgets all the time


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, max_size=8))
def test_words_without_the_splitter_give_the_library_ids(texts):
    assert SMALL.model is not None
    assert [a.tolist() for a in SMALL.encode(texts)] == [ids(t) for t in texts]


def test_all_letters_of_simple_words():
    every = [f'("{chr(c)}a{chr(c)}".' for c in range(0x21, 0x250)] + [chr(c) * 3 for c in range(0x21, 0x250)]
    assert [a.tolist() for a in Encoder("word_bpe_49k.json").encode(every)] == [ids(t) for t in every]


def test_encoder_cuts_very_long_texts_at_white_space():
    text = ("Über–straße <|endoftext|> x\x01y " * 60_000)[:1_500_000]
    assert Encoder("word_bpe_49k.json").encode([text])[0].tolist() == ids(text)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1 << 30), max_size=900), st.integers(1, 40))
def test_elias_fano_selects(steps, every):
    items = np.cumsum(np.array([s if i % every == 0 else s % 7 for i, s in enumerate(steps)], np.int64))
    coded, at = token_files.EliasFano.read(token_files.EliasFano.of(items).to_bytes(), 0)
    assert coded.all().tolist() == items.tolist()
    assert [coded.select(i) for i in range(len(items))] == items.tolist()
    if len(items) > 100:
        assert len(coded.lower) + len(coded.upper) <= len(items) * (2 + max(1, int(items[-1]) // len(items)).bit_length()) / 8 + 16


def test_token_files_round_trip(spark, docs, empty, folder, tmp_path):
    got = token_files.op7_token_files(spark, folder).collect()
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    want, start = Counter(), 0
    for r in rows:
        e = ids(r["text"]) + [2]
        want[r["doc_id"], start, len(e), zlib.crc32(np.array(e, "<u4").tobytes())] += 1
        start += len(e)
    assert Counter(tuple(r) for r in got) == want
    listing = token_files.write_token_files(docs, f"{tmp_path}/files", file_ids=5000)
    assert listing.count() > 5
    one = token_files.TokenFile(listing.first()["file"])
    assert one.document(0)[-1] == 2 and one.n == listing.first()["docs"]
    assert token_files.read_token_files(token_files.write_token_files(empty, f"{tmp_path}/none")).count() == 0


def test_packing_is_whole_gapless_and_tight(spark, docs, empty, folder):
    got = packing.op4_best_fit(spark, folder).toPandas()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        e = ids(r["text"]) + [0]
        for k, s in enumerate(range(0, len(e), 2048)):
            want[r["doc_id"], k, s, len(e[s:s + 2048]), zlib.crc32(np.array(e[s:s + 2048], "<u4").tobytes())] += 1
    cells = got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object)
    assert Counter(tuple(None if x != x else int(x) for x in r) for r in cells.itertuples(index=False)) == want
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
    assert got.sequence_id.nunique() <= got.length.sum() / 2048 * 1.05 + 2
    assert packing.packed(empty).count() == 0


def test_place_ranks_one_hot_size_and_refuses_others(spark):
    items = spark.range(3000).select("id", F.lit(700).cast("long").alias("length")).unionByName(
        spark.createDataFrame([(-1, None), (-2, 0), (-3, 5000), (-4, 2048)], "id long, length long"))
    got = packing.place(items, order_columns=("id",)).toPandas()
    assert got[got.id.isin([-1, -2, -3])].sequence_id.isna().all()
    good = got[got.sequence_id.notna()]
    assert good.sequence_id.nunique() == 1501 and not good.duplicated(["sequence_id", "offset"]).any()


def test_best_fit_runs_fill_the_smallest_gap():
    runs = packing.best_fit_runs({6: 1, 7: 1, 4: 1, 3: 1}, 10)
    place = {r[0]: r[3:] for r in runs}
    assert place[3] == (place[7][0], 7) and place[4] == (place[6][0], 6)


def test_ledger_adds_each_batch_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", "v", 1, 5), ("a", None, "v", 2, 7)], "source string, lang string, tokenizer string, docs long, tokens long")
    book = token_counts.Ledger(spark, str(tmp_path))
    assert book.totals().count() == 0
    for _ in range(3):
        book.commit("one", rows)
    book.commit("two", rows.selectExpr("source", "lang", "tokenizer", "-docs as docs", "-tokens as tokens").where("lang is null"))
    rows.selectExpr("'dead' as batch", "'x' as attempt", "*").write.mode("append").parquet(book.deltas)  # never committed
    assert [tuple(r) for r in book.totals().collect()] == [("a", "en", "v", 1, 5)]


def test_token_counts_match_a_recount(spark, docs, empty, folder):
    got = {tuple(r)[:3]: tuple(r)[3:] for r in token_counts.op3_token_counts(spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    low = {r["doc_id"] for r in labels if r["quality"] == 0 and r["toxic"] == 0}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1}
    want = {}
    for r in docs.collect():
        if r["doc_id"] in toxic:
            continue
        text = r["text"] or ""
        if r["doc_id"] in low:
            text = "\n".join(dict.fromkeys(text.split("\n")))
        for v, n in (("word_bpe_49k", len(ids(text))), ("space_words", len(text.encode().split()))):
            a, b = want.get((r["source"], r["lang"], v), (0, 0))
            want[r["source"], r["lang"], v] = (a + 1, b + n)
    assert got == want
    assert token_counts.count_tokens(empty).count() == 0


@pytest.mark.parametrize("texts", [[None, ""], ["one"]])
def test_encoder_of_blanks(texts):
    assert [a.tolist() for a in Encoder("word_bpe_49k.json").encode(texts)] == [ids(t) for t in texts]
