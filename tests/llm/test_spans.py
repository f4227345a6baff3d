import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii, secrets
from tidemark.llm import spans as sp

TEXTS = ["", None, "😀é password=abc def secret: 'abcdef' secret=token:abcdef AKIA" + "A" * 15 + " AKIA" + "B" * 16 + " " + "ab12" * 6 + "\n",
         "password=token=abcdefgh PASSWORD : \"x.y-z==\" Api-key=123456 api_key='k'", "foo@bar@baz.com a@b. x@y.z.. q@-.a.b@c.d 1.2.3.4.5 0001.255.256.3 300.1.1.1 000255.1.1.1",
         "4111 1111 1111 1111 4111-1111-1111-1111  4111111111111111 4 1 1  12 3-4 0000000000000", "+1 (988) 555-2485 +12345 +1 234 567 89 0. +49.(0)30-1234567 +1\t2",
         "9" * 30_000, "a.a." * 20_000 + "@" + "b.c." * 20_000, "1 " * 20_000, "😀 4111111111111111 😀 a@b.co", "1.1.1.1" * 300]
TEXTS += ["".join(random.Random(i).choices("a.@-_1+ ", k=60)) for i in range(150)] + ["a@b.com_c@d.com a@b.c-.d@e.f.%g@h.i"]
ACCESS, HEX = "AKIA" + "Z" * 17, "0123456789abcdef" * 2


def base_secrets(t):
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [("assign", m) for m in re.finditer(assign, t) if len(m[1]) >= 6]
    found += [("access", m) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [("hex", m) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [x[2] for x in sorted((m.start(), secrets.BASE.index(k), f"{k}:{m.start()}:{m.end()}") for k, m in found)]


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def base_pii(t):
    forms = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in zip(pii.BASE, forms):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(x) > 255 for x in m[0].split(".")) or k == "card" and not (13 <= len(d) <= 19 and luhn(d)) or k == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{k}:{m.start()}:{m.end()}")
    return out


@pytest.mark.parametrize("query, brute, kinds", [(secrets.op1_secrets, base_secrets, secrets.BASE), (pii.op5_pii, base_pii, pii.BASE)])
def test_base_spans_match_brute_force(spark, docs, empty, tmp_path, query, brute, kinds):
    texts = [*TEXTS, *[r["text"] for r in docs.select("text").collect()]]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "token = abcdef12 4111111111111111", "clash")]
    spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute((texts[r["doc_id"]] if r["doc_id"] is not None else rows[-1][1]) or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), r
        assert [r[f"n_{k}"] for k in kinds] == [sum(w.startswith(k + ":") for w in want) for k in kinds]
        assert set(want) <= set(r["spans"].split(",")) or not want
    empty.select("doc_id", "text").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert query(spark, f"{tmp_path}/none").count() == 0


def brute_links(parts, scope):
    out = set()
    for row, kind, start, end, strong in parts:
        if not strong:
            near = [(secrets.ROLES[k], s) for r, k, a, b, s in parts if r == row and a <= end + scope and b >= start - scope and secrets.ROLES[k] != secrets.ROLES[kind]]
            if any(s for _, s in near) or len({r for r, _ in near}) == 2:
                out.add((row, kind, start, end))
    return out


def test_links_match_brute_force(spark):
    rng, parts = random.Random(3), []
    for row in range(40):
        at = 0
        for _ in range(rng.randrange(1, 25)):
            at += rng.choice([1, 50, 199, 200, 201, 400, 700])
            kind = rng.choice(secrets.KINDS)
            end = at + rng.choice([1, 30, 900])
            parts.append((row, kind, at, end, kind in secrets.BASE))
            at = end
    df = spark.createDataFrame(parts, "row long, kind string, start int, end int, strong boolean").repartition(3)
    assert {tuple(r) for r in secrets.linked(df).collect()} == brute_links(parts, secrets.SCOPE)


def test_weak_parts_are_reported_only_together(spark):
    weak = "key Ab3x9x9x9x9x9x9x9x9"
    texts = [f"{weak} alone", f"user=bob {weak} https://db.example.com/x", f"{ACCESS} {weak}", f"{ACCESS}{' ' * 300}{weak}", "user=bob only", f"user=bob {HEX}"]
    found = {r["i"]: {s["kind"] for s in r["spans"]} for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()}
    assert found == {0: set(), 1: {"user", "opaque", "endpoint"}, 2: {"access", "opaque"}, 3: {"access"}, 4: set(), 5: {"user", "hex"}}


def test_redact_masks_only_secrets(spark, docs):
    rows = [(1, f"a {HEX} b"), (2, "clean text"), (3, None), (4, f"token={HEX} 😀 {ACCESS}")]
    got = {r[0]: r[1] for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "a [secret] b", 2: "clean text", 3: None, 4: "[secret] 😀 [secret]"}
    assert secrets.redact(docs).count() == docs.count() and secrets.redact(docs).columns == docs.columns


def test_labelers_teach_the_classifier(spark):
    good = [(i, f"her ssn is {100 + i % 500}-{10 + i % 80}-{1000 + i}, call +1 (212) 555-{1000 + i}") for i in range(300)]
    bad = [(1000 + i, f"see part {900 + i % 99}-00-0000 of section {i}") for i in range(300)]
    found = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.find_pii(spark.createDataFrame(good + bad, "doc_id long, text string")).collect()}
    assert sum("national" in found[i] for i, _ in good) >= 290 and sum("national" in found[i] for i, _ in bad) <= 10


def test_reliabilities_follow_the_majority():
    post = pii.reliabilities([("email", (1, 1, 1, 0, 1), 90), ("email", (-1, 0, 0, -1, 0), 40), ("email", (1, 0, 0, 0, 0), 10)])
    assert post["email", (1, 1, 1, 0, 1)] > 0.9 > 0.1 > post["email", (-1, 0, 0, -1, 0)]


def test_long_runs_are_tried_once(spark):
    """From every character of a run anew these would take hours."""
    texts = ["x" * 1_000_000 + "@ a@b.co", "7" * 1_000_000 + ".1.2 1.2.3.4"]
    found = {r["i"]: [(s["kind"], s["start"]) for s in r["spans"] if s["kind"] in ("email", "ip")]
             for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()}
    assert found == {0: [("email", 1_000_002)], 1: [("ip", 1_000_005)]}


def test_no_python_on_the_main_path(spark, docs):
    for df in (secrets.find_secrets(docs), pii.find_pii(docs), secrets.redact(docs)):
        assert "Python" not in (plan := df._jdf.queryExecution().toString()) and "Pandas" not in plan


def test_masked_merges_overlaps(spark):
    df = spark.sql("select 'abcdefgh' as t, array(named_struct('start', 1, 'end', 4), named_struct('start', 3, 'end', 5)) as s")
    assert df.select(sp.masked(F.col("t"), F.col("s"), "*")).first()[0] == "a*fgh"
