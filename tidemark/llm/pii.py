"""Personal data in texts: certain forms, and weak ones that labelers vote on and a trained classifier decides."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import spans as sp
from tidemark.llm.common import stored, table
from tidemark.llm.registry import query

# fixed values: the certain forms. Written without repeated groups, which the engine's matcher follows by recursion:
# a lookahead for the dot and a lazy run that ends where the repeated group would have. A match starts where its run of
# characters does (or right after the match before), so that a long run is tried once and not from each of its characters.
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9-][A-Za-z0-9.-]*?"
         r"(?=\.(?:[^A-Za-z0-9-]|\z)|[^A-Za-z0-9.-]|\z)")
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9\x20-]*?(?=[\x20-]{2}|[\x20-]?(?:[^0-9\x20-]|\z))"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# forms of weak candidates
NATIONAL = r"(?<![0-9-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9-])"
LOCAL = r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
ACCOUNT = r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Z0-9])"
GIVEN = ("James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Thomas "
         "Sarah Anna Maria Peter Hans Pierre Marie Juan Carlos Sofia Laura Paul Julia").split()
PERSON = rf"\b(?:{'|'.join(GIVEN)})\x20[A-Z][a-z]{{2,20}}\b"

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "national", "local", "account", "person"]
AROUND = 40       # characters of context on either side
ROUNDS = 50       # of expectation-maximisation
WORDS = {"email": "mail|contact|write|reply|@", "ip": "ip|host|address|server|login", "card": "card|visa|pay|credit|cvv|amex",
         "phone": "phone|tel|call|mobile|fax", "national": "ssn|social|national|tax|id", "local": "phone|tel|call|mobile|fax",
         "account": "iban|account|bank|transfer", "person": "name|mr|mrs|ms|dr|dear|contact|signed"}
AGAINST = r"(?i)\b(?:version|ver|build|release|isbn|page|figure|table|section|order|serial|model|part)\b[^A-Za-z0-9]*$"
LABELERS = ["form", "gazetteer", "context", "against", "company"]


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def value(i):
        d = digits.substr(n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    places = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    return (n > 0) & (F.aggregate(places, F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0)


def certain(text: Column) -> Column:
    def count(v):
        return F.char_length(_digits(v))

    small = lambda p: F.char_length(F.regexp_replace(p, "^0+", "")) <= 3
    ip = F.filter(sp.find(text, IP, "ip"), lambda s: F.forall(F.split(s["value"], r"\."), lambda p: F.when(
        small(p), F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int"), F.lit(999)) <= 255).otherwise(False)))
    card = F.filter(sp.find(text, CARD, "card", text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
                    lambda s: F.when(count(s["value"]).between(13, 19), luhn(_digits(s["value"]))).otherwise(False))
    phone = F.filter(sp.find(text, PHONE, "phone", text.contains("+")), lambda s: count(s["value"]).between(9, 15))
    return F.concat(sp.find(text, EMAIL, "email", text.contains("@")), ip, card, phone)


def _weak(text: Column, base: Column) -> Column:
    digit = text.rlike("[0-9]{4}")
    national, local, account, person = (sp.find(text, p, k, w) for p, k, w in (
        (NATIONAL, "national", digit), (LOCAL, "local", digit), (ACCOUNT, "account", digit), (PERSON, "person", None)))
    return F.filter(F.concat(national, local, account, person), lambda s: ~sp.overlaps(s, base))


def _by_kind(kind: Column, table: dict[str, Column], default: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(kind == kv[0], kv[1]), table.items(), F.when(F.lit(False), default)).otherwise(default)


def votes(c: DataFrame) -> DataFrame:
    """A column per labeler: 1 for personal data, -1 against, 0 abstains. ``c`` has kind, value, before, after, near."""
    v, k = F.col("value"), F.col("kind")
    digits = _digits(v)
    yes = lambda good: F.when(good, 1).otherwise(-1)
    form = _by_kind(k, {
        "email": yes(v.rlike(r"[A-Za-z0-9]@") & v.rlike(r"\.[A-Za-z]{2,}$")), "ip": yes(~v.rlike(r"(^|\.)0[0-9]")),
        "card": yes(F.char_length(digits).between(15, 16)), "phone": yes(F.char_length(digits).between(10, 13)),
        "national": yes(~v.rlike(r"^(000|666|9)|00.{0,1}[0-9]{4}$|0000$")), "local": yes(v.rlike(r"^\(?[2-9]")),
        "account": yes(F.char_length(F.replace(v, F.lit(" "), F.lit(""))).between(15, 34)), "person": F.lit(0)}, F.lit(0))
    gazetteer = _by_kind(k, {
        "email": F.when(v.rlike(r"(?i)\.(com|org|net|edu|gov|io|de|fr|es|uk|eu)$"), 1).otherwise(0),
        "ip": F.when(v.rlike(r"^(0|127|255)\."), -1).otherwise(0), "card": yes(digits.rlike("^(3[47]|4|5[1-5]|2[2-7]|6)")),
        "phone": F.when(digits.rlike("^(1|33|34|44|49|39|31|32|41|43|7|81|86|91)"), 1).otherwise(0),
        "person": F.lit(1)}, F.lit(0))
    words = _by_kind(k, {x: F.lit(rf"(?i)\b(?:{w})\b") for x, w in WORDS.items()}, F.lit("(?!)"))
    context = F.when(F.regexp_like("before", words) | F.regexp_like("after", words), 1).otherwise(0)
    return c.select("*", form.alias("form"), gazetteer.alias("gazetteer"), context.alias("context"),
                    F.when(F.col("before").rlike(AGAINST), -1).otherwise(0).alias("against"),
                    F.when(F.col("near"), 1).otherwise(0).alias("company"))


def reliabilities(patterns: list[tuple], rounds: int = ROUNDS) -> dict[tuple, float]:
    """Posterior of each vote pattern, by expectation-maximisation over labelers that vote independently given truth.

    ``patterns``: (kind, votes tuple, count). Kinds have a prior of their own; a labeler's rates of voting 1, 0, -1
    given truth are shared by all kinds. Starts from the majority of votes, so the classes keep their meaning.
    """
    post = {(k, v): 1 / (1 + math.exp(-1.5 * sum(v))) for k, v, _ in patterns}
    for _ in range(rounds):
        rate = [{(y, x): 1.0 for y in (0, 1) for x in (-1, 0, 1)} for _ in LABELERS]
        prior: dict = {}
        for k, v, n in patterns:
            p = post[k, v]
            a, b = prior.get(k, (1.0, 1.0))
            prior[k] = (a + n * p, b + n * (1 - p))
            for r, x in zip(rate, v):
                r[1, x] += n * p
                r[0, x] += n * (1 - p)
        total = [{y: sum(r[y, x] for x in (-1, 0, 1)) for y in (0, 1)} for r in rate]
        for k, v, _ in patterns:
            logit = math.log(prior[k][0] / prior[k][1])
            for r, t, x in zip(rate, total, v):
                logit += math.log(r[1, x] / t[1]) - math.log(r[0, x] / t[0])
            post[k, v] = 1 / (1 + math.exp(-max(-40.0, min(40.0, logit))))
    return post


def features(c: DataFrame) -> Column:
    """What the classifier looks at: ``name=value`` strings, a fixed small number of values each."""
    v = F.col("value")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]+", "9"), "[A-Z]+", "A"), "[a-z]+", "a")
    return F.array(
        F.concat(F.lit("length="), F.col("kind"), F.least(F.char_length(v), F.lit(40)).cast("string")),
        F.concat(F.lit("shape="), F.col("kind"), F.pmod(F.xxhash64(shape), F.lit(256)).cast("string")),
        F.concat(F.lit("left="), F.pmod(F.xxhash64(F.regexp_replace(F.right("before", F.lit(1)), "[A-Za-z]", "a")), F.lit(64)).cast("string")),
        F.concat(F.lit("right="), F.pmod(F.xxhash64(F.regexp_replace(F.left("after", F.lit(1)), "[A-Za-z]", "a")), F.lit(64)).cast("string")),
        F.concat(F.lit("word="), F.col("kind"), F.pmod(F.xxhash64(F.lower(F.regexp_extract("before", r"([A-Za-z]+)[^A-Za-z]*$", 1))), F.lit(512)).cast("string")))


def find_pii(docs: DataFrame, text_column: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``spans``: certain personal data, and weak candidates whose classifier probability reaches ``threshold``.

    Labelers vote on all candidates of all texts; the counts of vote patterns, at most 8 kinds times 3 to the power of
    5, are the one thing the driver sees, and expectation-maximisation on them gives each pattern's posterior. With
    these as soft labels a naive-Bayes classifier of span features is counted over all candidates and scores them.

    ``keep`` names the columns carried along; one named ``spans`` is replaced. A null text counts as empty. Repeated
    rows are scanned each for itself. Without any candidate no weak span is reported. An empty table gives no rows.
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c != "spans"]
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("_kept"), F.col(text_column).alias("_text")).withColumn("_base", certain(text))
    rows = rows.withColumn("_weak", _weak(text, F.col("_base")))

    def in_context(s):
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
                        text.substr(F.greatest(s["start"] - AROUND, F.lit(0)) + 1, F.least(s["start"], F.lit(AROUND))).alias("before"),
                        text.substr(s["end"] + 1, F.lit(AROUND)).alias("after"))

    rows = rows.withColumn("_all", F.concat("_base", "_weak")).select(
        "_kept", F.size("_base").alias("_sure"), F.transform("_all", in_context).alias("_all"), F.monotonically_increasing_id().alias("row"))
    scanned = stored(rows, "pii")
    candidates = scanned.select("row", "_sure", (F.size("_all") > 1).alias("near"), F.posexplode("_all").alias("i", "s"))
    # one row per distinct candidate with its context: copies of a text are voted on once and counted
    told = votes(candidates.select("row", "_sure", "i", "near", "s.*"))
    voted = stored(told.select("row", "kind", "start", "end", (F.col("i") < F.col("_sure")).alias("sure"), *LABELERS,
                               features(told).alias("features")), "votes")
    patterns = [(r["kind"], tuple(r[x] for x in LABELERS), r["n"])
                for r in voted.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()]
    posterior = [(k, *v, p) for (k, v), p in reliabilities(sorted(patterns)).items()]
    label = spark.createDataFrame(posterior, f"kind string, {', '.join(f'{x} int' for x in LABELERS)}, p double")
    seen = voted.join(F.broadcast(label), ["kind", *LABELERS])  # a row per vote pattern
    weights = (seen.select(F.explode("features").alias("feature"), "p").groupBy("feature")
               .agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")))
    totals = seen.agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("yes"), F.coalesce(F.sum(1 - F.col("p")), F.lit(0.0)).alias("no")).first()
    odds = F.log((F.col("yes") + 1) / (totals["yes"] + 2)) - F.log((F.col("no") + 1) / (totals["no"] + 2))
    table_of = weights.select("feature", odds.alias("odds"))
    prior = math.log((totals["yes"] + 1) / (totals["no"] + 1))
    weak = seen.where("not sure").select("row", "kind", "start", "end", "p", F.explode("features").alias("feature"))
    scored = (weak.join(table_of, "feature").groupBy("row", "kind", "start", "end")
              .agg(F.sum("odds").alias("odds"), F.first("p").alias("p")))
    chosen = scored.where(1 / (1 + F.exp(-(F.col("odds") + prior))) >= threshold)
    more = chosen.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_more"))
    bare = F.transform(F.slice("_all", F.lit(1), F.col("_sure")), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    based = scanned.select("_kept", "row", bare.alias("_base"), (F.size("_all") > F.col("_sure")).alias("_doubt"))
    joined = based.where("_doubt").join(more, "row", "left").select("_kept", F.concat("_base", F.coalesce(
        "_more", F.array().cast("array<struct<kind:string,start:int,end:int>>"))).alias("_spans"))
    both = based.where("not _doubt").select("_kept", F.col("_base").alias("_spans")).unionByName(joined)
    return both.select(*[F.col("_kept")[c].alias(c) for c in keep], sp.in_order(F.col("_spans"), KINDS, by_kind_first=True).alias("spans"))


@query("op5_pii")
def op5_pii(spark, sf_dir):
    out = find_pii(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    return out.select("doc_id", *[sp.of_kind(F.col("spans"), k).alias(f"n_{k}") for k in BASE],
                      F.sha2(sp.written(base), 256).alias("base_sha256"), sp.written(F.col("spans")).alias("spans"))
