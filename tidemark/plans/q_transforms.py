"""Queries: raw-table transforms, casts, names, numbers in text."""

from pyspark.sql import functions as F

from tidemark.frames import literal_frame
from tidemark.functions import dates as dt, numbers as nm, text as tx
from tidemark.operators import casting as cs, transforms as tf
from tidemark.plans.inputs import table
from tidemark.plans.registry import query
from tidemark.types import ColumnSpec, Transform


@query("tf_rename", "SELECT o_orderkey, o_totalprice AS amount FROM orders")
def _(spark, sf):
    return tf.rename(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "amount")


@query("tf_drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, sf):
    return tf.drop_columns(table(spark, sf, "orders"), ["o_orderdate", "o_orderpriority", "not_there"])


@query("tf_filter_rows", """SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
 WHERE o_totalprice >= 100000 AND o_orderstatus <> 'F' AND regexp_matches(o_orderpriority, '^[1-3]-')
   AND o_orderpriority NOT IN ('2-HIGH')""")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    df = tf.filter_rows(df, "o_totalprice", "ge", 100000)
    df = tf.filter_rows(df, "o_orderstatus", "ne", "F")
    df = tf.filter_rows(df, "o_orderpriority", "contains", "^[1-3]-")
    return tf.filter_rows(df, "o_orderpriority", "not_in", values=["2-HIGH"])


@query("tf_drop_duplicates", """SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice FROM orders
 QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1""")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")
    return tf.drop_duplicates(df, ["o_custkey", "o_orderstatus"], "o_orderkey")


@query("tf_scale", "SELECT l_orderkey, l_linenumber, l_quantity*2.5::DOUBLE+1.0::DOUBLE AS l_quantity FROM lineitem")
def _(spark, sf):
    return tf.scale(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 2.5, 1)


@query("tf_combine", """SELECT l_orderkey, l_linenumber, l_quantity+l_linenumber AS total,
 l_quantity*l_linenumber AS area, l_returnflag||'-'||l_linestatus AS label FROM lineitem""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    df = tf.combine(df, ["l_quantity", "l_linenumber"], "total", "sum")
    df = tf.combine(df, ["l_quantity", "l_linenumber"], "area", "product")
    df = tf.combine(df, ["l_returnflag", "l_linestatus"], "label", "concat", "-")
    return df.select("l_orderkey", "l_linenumber", "total", "area", "label")


@query("tf_split", """SELECT p_partkey, string_split(p_name,' ')[1] AS first_word,
 string_split(p_name,' ')[2] AS second_word, string_split(p_name,' ')[3] AS third_word FROM part""")
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_name")
    return tf.split(df, "p_name", ["first_word", "second_word", "third_word"], " ").drop("p_name")


@query("tf_recode", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open'
 ELSE o_orderstatus END AS o_orderstatus, CASE o_orderpriority WHEN '1-URGENT' THEN 'now' ELSE 'later' END AS o_orderpriority
 FROM orders""")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    df = tf.recode(df, "o_orderstatus", {"F": "finished", "O": "open"})
    return tf.recode(df, "o_orderpriority", {"1-URGENT": "now"}, "later")


@query("tf_parse_date", """SELECT o_orderkey, strptime(strftime(o_orderdate,'%d-%m-%Y'),'%d-%m-%Y') AS by_format,
 strptime(strftime(o_orderdate,'%d/%m/%Y'),'%d/%m/%Y') AS day_first FROM orders""")
def _(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "dd-MM-yyyy").alias("by_format"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day_first"))
    return tf.parse_dates(tf.parse_dates(df, "by_format", "%d-%m-%Y"), "day_first", dayfirst=True)


@query("tf_pivot", """SELECT l_suppkey, sum(l_quantity) FILTER (l_returnflag='A') AS "A",
 sum(l_quantity) FILTER (l_returnflag='N') AS "N", sum(l_quantity) FILTER (l_returnflag='R') AS "R"
 FROM lineitem GROUP BY 1""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity")
    return tf.pivot(df, ["l_suppkey"], "l_returnflag", "l_quantity", "sum", ["N", "A", "R"])


@query("tf_apply_all", """SELECT o_orderkey, o_totalprice*100.0::DOUBLE+0.0::DOUBLE AS cents,
 CASE o_orderstatus WHEN 'P' THEN 'pending' ELSE 'other' END AS o_orderstatus FROM orders WHERE o_totalprice < 250000""")
def _(spark, sf):
    specs = [Transform("filter_rows", {"column": "o_totalprice", "compare": "lt", "value": 250000}),
             Transform("rename", {"from": "o_totalprice", "to": "cents"}),
             Transform("scale", {"column": "absent", "factor": 2}),
             Transform("scale", {"column": "cents", "factor": 100}),
             Transform("recode", {"column": "o_orderstatus", "mapping": {"P": "pending"}, "default": "other"})]
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return tf.apply_transforms(df, specs, "orders")[0]


# --- amounts as text: NL for status F, EN for O, a currency sign for P, some unreadable ------

def amount_texts(spark, sf):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    whole, rest = F.floor(cents / 100).cast("bigint"), F.lpad((cents % 100).cast("string"), 2, "0")
    head, tail = F.floor(whole / 1000).cast("string"), F.lpad((whole % 1000).cast("string"), 3, "0")
    nl = F.concat(F.lit("€ "), F.when(whole >= 1000, F.concat(head, F.lit("."), tail)).otherwise(whole.cast("string")), F.lit(","), rest)
    en = F.concat(F.when(whole >= 1000, F.concat(head, F.lit(","), tail)).otherwise(whole.cast("string")), F.lit("."), rest)
    text = (F.when(F.col("o_totalprice") > 480000, "n.v.t.").when(F.col("o_orderstatus") == "F", nl)
            .when(F.col("o_orderstatus") == "O", en)
            .otherwise(F.concat(F.lit("$ "), whole.cast("string"), F.lit("."), rest)))
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("column"), text.alias("raw"))


AMOUNTS = """amounts AS (SELECT o_orderkey, o_orderstatus AS "column", CASE WHEN o_totalprice > 480000 THEN 'n.v.t.'
  WHEN o_orderstatus='F' THEN '€ ' || CASE WHEN w>=1000 THEN (w//1000)::VARCHAR||'.'||lpad((w%1000)::VARCHAR,3,'0') ELSE w::VARCHAR END || ',' || r
  WHEN o_orderstatus='O' THEN CASE WHEN w>=1000 THEN (w//1000)::VARCHAR||','||lpad((w%1000)::VARCHAR,3,'0') ELSE w::VARCHAR END || '.' || r
  ELSE '$ ' || w::VARCHAR || '.' || r END AS raw
 FROM (SELECT *, CAST(round(o_totalprice*100) AS BIGINT)//100 AS w,
   lpad((CAST(round(o_totalprice*100) AS BIGINT)%100)::VARCHAR,2,'0') AS r FROM orders))"""


@query("cast_locale_number", f"""WITH {AMOUNTS}
SELECT o_orderkey, "column", CASE WHEN raw='n.v.t.' THEN NULL
  WHEN "column"='F' THEN TRY_CAST(replace(replace(replace(raw,'€ ',''),'.',''),',','.') AS DOUBLE)
  WHEN "column"='O' THEN TRY_CAST(replace(raw,',','') AS DOUBLE)
  ELSE TRY_CAST(replace(raw,'$ ','') AS DOUBLE) END AS value,
  CASE "column" WHEN 'F' THEN 'NL' WHEN 'O' THEN 'EN' ELSE 'currency' END AS style FROM amounts""")
def _(spark, sf):
    return cs.coerce_cells(amount_texts(spark, sf), ["column"]).select("o_orderkey", "column", "value", "style")


def date_texts(spark, sf):
    d = F.col("o_orderdate")
    text = (F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(d, "yyyy-MM-dd"))
            .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(d, "MM/dd/yyyy"))
            .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format(d, "yyyy/MM/dd"))
            .when(F.col("o_orderpriority") == "5-LOW", F.date_format(d, "d MMM yyyy")).otherwise("onbekend"))
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", text.alias("raw"))


@query("cast_date_try", """SELECT o_orderkey, CASE WHEN o_orderpriority='4-NOT SPECIFIED' THEN NULL
 ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def _(spark, sf):
    return date_texts(spark, sf).select("o_orderkey", F.to_date(dt.parse_date(F.col("raw"))).alias("day"))


@query("week_start", "SELECT event_id, CAST(date_trunc('week', ts) AS DATE) AS week_start FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", dt.week_start(F.col("ts")).alias("week_start"))


@query("iso_year_week", """SELECT o_orderkey, CAST(isoyear(o_orderdate) AS INTEGER) AS iso_year,
 CAST(week(o_orderdate) AS INTEGER) AS iso_week, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday FROM orders""")
def _(spark, sf):
    d = F.col("o_orderdate")
    df = table(spark, sf, "orders").select("o_orderkey", dt.iso_year(d).alias("iso_year"), dt.iso_week(d).alias("iso_week"))
    return df.withColumn("monday", dt.monday_of(F.col("iso_year"), F.col("iso_week")))


SLUG = ("left(array_to_string(list_filter(string_split(regexp_replace(translate(lower({c}),"
        f"'{tx.ACCENTED}','{tx.UNACCENTED}'),'[^a-z0-9]+','_','g'),'_'), lambda x: x <> '')[1:4], '_'), 40)")


@query("slug_text", f"SELECT doc_id, {SLUG.format(c='text')} AS slug FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.slug(F.col("text")).alias("slug"))


@query("unique_name", f"""SELECT p_partkey, CASE WHEN k=1 THEN s ELSE s||'_'||k END AS name FROM (
 SELECT p_partkey, s, row_number() OVER (PARTITION BY p_brand, s ORDER BY p_partkey)
   + CASE WHEN s='red_widget' THEN 1 ELSE 0 END AS k
 FROM (SELECT p_partkey, p_brand, {SLUG.format(c='p_name')} AS s FROM part))""")
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_brand", tx.slug(F.col("p_name")).alias("slug"))
    taken = df.where(F.col("slug") == "red_widget").select("p_brand", "slug").distinct()
    return tx.unique_names(df, ["p_brand"], "slug", "p_partkey", "name", taken).select("p_partkey", "name")


@query("project_declared", """SELECT c_custkey, c_acctbal AS balance, c_mktsegment FROM customer""")
def _(spark, sf):
    declared = [ColumnSpec("c_acctbal", "kpi", "balance"), ColumnSpec("c_mktsegment", "control"),
                ColumnSpec("c_missing", "spend")]
    return cs.project_declared(table(spark, sf, "customer"), "customer", declared, ["c_custkey"])[0]


@query("rename_collisions", """WITH c AS (SELECT DISTINCT p_brand, p_type AS source, p_name AS series FROM part),
 n AS (SELECT p_brand, series, count(DISTINCT source) AS k FROM c GROUP BY 1,2)
 SELECT c.p_brand, c.source, c.series, CASE WHEN k>1 THEN c.source||'_'||c.series ELSE c.series END AS final_name
 FROM c JOIN n ON c.p_brand=n.p_brand AND c.series=n.series""")
def _(spark, sf):
    cols = table(spark, sf, "part").select("p_brand", F.col("p_type").alias("source"), F.col("p_name").alias("series")).distinct()
    return cs.rename_collisions(cols, ["p_brand"])


NUMBERS = """found AS (SELECT doc_id, source, unnest(regexp_extract_all(text,
  '[0-9]{1,3}(?:\\.[0-9]{3})+(?:,[0-9]+)?|[0-9]+(?:[.,][0-9]+)?')) AS raw FROM documents),
numbers AS (SELECT *, CAST(CASE WHEN regexp_full_match(raw, '[0-9]{1,3}(?:\\.[0-9]{3})+(?:,[0-9]+)?')
  THEN replace(replace(raw,'.',''),',','.') ELSE replace(raw,',','.') END AS DOUBLE) AS number FROM found)"""


@query("text_numbers", f"WITH {NUMBERS} SELECT doc_id, raw, number FROM numbers")
def _(spark, sf):
    return nm.numbers_in(table(spark, sf, "documents").select("doc_id", "text"), "text")


@query("text_number_check", f"""WITH {NUMBERS},
facts AS (SELECT DISTINCT source, n_chars*m AS fact FROM documents JOIN labels USING (doc_id),
   (VALUES (1.0::DOUBLE),(100.0::DOUBLE),(0.01::DOUBLE)) v(m) WHERE quality=1 AND toxic=0)
SELECT doc_id, raw, number FROM numbers n WHERE number>12 AND number NOT BETWEEN 1995 AND 2001
 AND NOT EXISTS (SELECT 1 FROM facts f WHERE f.source=n.source AND abs(f.fact-n.number)<=0.02*greatest(1,f.fact))
UNION ALL SELECT doc_id, raw, number FROM numbers n WHERE number BETWEEN 1995 AND 2001 AND number<>round(number)
 AND NOT EXISTS (SELECT 1 FROM facts f WHERE f.source=n.source AND abs(f.fact-n.number)<=0.02*greatest(1,f.fact))""")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    good = table(spark, sf, "labels").where((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")
    facts = docs.select("doc_id", "source", "n_chars").join(good, "doc_id").select("source", F.col("n_chars").cast("double").alias("fact"))
    years = docs.select("source").distinct().withColumn("year", F.explode(F.sequence(F.lit(1995), F.lit(2001))))
    return (cs.number_check(docs.select("doc_id", "source", "text"), "text", facts, ["source"], years)
            .select("doc_id", "raw", "number"))


@query("set_missing_columns", """SELECT DISTINCT c_custkey, c_mktsegment FROM customer
EXCEPT SELECT c_custkey, c_mktsegment FROM customer JOIN orders ON o_custkey=c_custkey WHERE o_totalprice>400000""")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    big = table(spark, sf, "orders").where(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("c_custkey"))
    names = ["c_custkey", "c_mktsegment"]
    return cs.missing_columns(c, c.join(big, "c_custkey", "left_semi"), names).distinct()
