"""Secrets in texts: certain ones by their form, weak ones only where complementary parts of a credential lie near."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import spans as sp
from tidemark.llm.common import stored, table
from tidemark.llm.registry import query

# fixed values: the forms of certain secrets
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LENGTH = 6

# forms of weak parts
USER = r"""(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\x00-\x20"'<>]+"""
OPAQUE = r"[A-Za-z0-9+/_=-]{16,}"

KINDS = ["assign", "access", "hex", "user", "opaque", "endpoint"]
BASE = KINDS[:3]
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "user": "id", "opaque": "secret", "endpoint": "endpoint"}
SCOPE = 200  # characters between the parts of one credential, at most


def certain(text: Column) -> Column:
    assign = F.filter(sp.find(text, ASSIGN, "assign"),
                      lambda s: F.char_length(F.regexp_extract(s["value"], ASSIGN, 1)) >= ASSIGN_LENGTH)
    return F.concat(assign, sp.find(text, ACCESS, "access", text.contains("AKIA")), sp.find(text, HEX, "hex"))


def _weak(text: Column, base: Column, names: Column) -> Column:
    """Weak parts apart from certain ones; opaque strings only where an identifier or endpoint is in the text at all."""
    opaque = F.filter(sp.find(text, OPAQUE, "opaque", (F.size(names) > 0) | F.exists(base, lambda s: s["kind"] == "access")),
                      lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    opaque = F.filter(opaque, lambda s: ~sp.overlaps(s, names))
    return F.filter(F.concat(names, opaque), lambda s: ~sp.overlaps(s, base))


def _role(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[kind]


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts (row, kind, start, end) that a complementary part accompanies.

    ``parts`` has row, kind, start, end and strong. Identifier, secret and endpoint complement each other. A weak part
    counts where a strong part of another role is at most ``scope`` characters off, or parts of both other roles are.
    Intervals meet in an equi-join on (row, stretch of ``scope`` characters): first each stretch keeps, per role, its
    least start and greatest end, so that a text full of parts gives a few rows a stretch and no pairs. That is exact:
    a weak part's reach is longer than a stretch, so it holds an end of every stretch that it touches.
    """
    def over_stretches(df, start, end):
        return df.withColumn("stretch", F.explode(F.sequence(F.floor(start / scope), F.floor(end / scope))))

    parts = parts.withColumn("role", _role(F.col("kind")))
    there = (over_stretches(parts, F.col("start"), F.col("end"))
             .withColumn("from", F.greatest("start", F.col("stretch") * scope))
             .withColumn("to", F.least("end", (F.col("stretch") + 1) * scope))
             .groupBy("row", "stretch", F.col("role").alias("other"))
             .agg(F.min("from").alias("from"), F.max("to").alias("to"),
                  F.min(F.when(F.col("strong"), F.col("from"))).alias("sfrom"), F.max(F.when(F.col("strong"), F.col("to"))).alias("sto")))
    reach = (parts.where("not strong").withColumn("lo", F.greatest(F.lit(0), F.col("start") - scope))
             .withColumn("hi", F.col("end") + scope))
    met = (over_stretches(reach, F.col("lo"), F.col("hi")).join(there, ["row", "stretch"])
           .where("other <> role and from <= hi and to >= lo"))
    near = met.groupBy("row", "kind", "start", "end").agg(
        F.max(F.expr("coalesce(sfrom <= hi and sto >= lo, false)")).alias("by_strong"), F.count_distinct("other").alias("others"))
    return near.where("by_strong or others = 2").select("row", "kind", "start", "end")


def find_secrets(docs: DataFrame, text_column: str = "text", keep: list[str] | None = None, scope: int = SCOPE) -> DataFrame:
    """``docs`` with ``spans``: certain secrets and linked weak parts, an array of (kind, start, end), sorted.

    ``keep`` names the columns carried along, all by default; one of its own named ``spans`` is replaced. A null text
    counts as empty and has no spans. Repeated rows are scanned each for itself. An empty table gives no rows.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "spans"]
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("_kept"), F.col(text_column).alias("_text"))
    rows = rows.withColumn("_base", certain(text))
    rows = rows.withColumn("_names", F.concat(sp.find(text, USER, "user"), sp.find(text, ENDPOINT, "endpoint", text.contains("://"))))
    rows = rows.withColumn("_weak", _weak(text, F.col("_base"), F.col("_names")))
    bare = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    scanned = stored(rows.select("_kept", bare(F.col("_base")).alias("_base"), bare(F.col("_weak")).alias("_weak"),
                                 F.monotonically_increasing_id().alias("row")), "secrets")
    doubtful = scanned.where(F.size("_weak") > 0)
    parts = (doubtful.select("row", F.explode("_base").alias("s"), F.lit(True).alias("strong"))
             .unionByName(doubtful.select("row", F.explode("_weak").alias("s"), F.lit(False).alias("strong")))
             .select("row", "s.kind", "s.start", "s.end", "strong"))
    more = linked(parts, scope).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_more"))
    joined = doubtful.join(more, "row", "left").withColumn("_all", F.concat("_base", F.coalesce("_more", F.array().cast(
        "array<struct<kind:string,start:int,end:int>>"))))
    both = (scanned.where(F.size("_weak") == 0).select("_kept", F.col("_base").alias("_all"))
            .unionByName(joined.select("_kept", "_all")))
    return both.select(*[F.col("_kept")[c].alias(c) for c in keep], sp.in_order(F.col("_all"), KINDS).alias("spans"))


def redact(docs: DataFrame, text_column: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; all rows stay, a text without secrets is unchanged."""
    found = find_secrets(docs, text_column)
    return found.withColumn(text_column, sp.masked(F.col(text_column), F.col("spans"), mark)).select(*docs.columns)


@query("op1_secrets")
def op1_secrets(spark, sf_dir):
    out = find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    return out.select("doc_id", *[sp.of_kind(F.col("spans"), k).alias(f"n_{k}") for k in BASE],
                      F.sha2(sp.written(base), 256).alias("base_sha256"), sp.written(F.col("spans")).alias("spans"))
