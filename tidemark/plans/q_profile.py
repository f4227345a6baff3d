"""Queries: column typing, role validation, source profiles, and what follows from them."""

from itertools import combinations

from pyspark.sql import functions as F

from tidemark import fixed_values as fx
from tidemark.frames import WEEK, literal_frame, melt
from tidemark.functions.dates import week_start
from tidemark.operators import profile as pf, roles as rl
from tidemark.plans.inputs import CHANNELS, KEYS, MASTER_SQL, RAW_SQL, master, shop, table
from tidemark.plans.q_features import WIDE_SQL, wide
from tidemark.plans.q_transforms import AMOUNTS, SLUG, amount_texts
from tidemark.plans.registry import query

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def text_cells(spark, sf):
    """Columns of ``orders`` as text: (source, column, position, order_id, raw)."""
    o = table(spark, sf, "orders")
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "day", "o_orderpriority", "flag", "send_count"]
    wide_text = o.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus",
        F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority",
        F.when(F.col("o_orderstatus") == "F", "1").otherwise("0").alias("flag"),
        F.when(F.col("o_orderstatus") != "P", (F.col("o_custkey") + 5).cast("string")).alias("send_count"))
    at = F.lit(0)
    for i, c in enumerate(cols):
        at = F.when(F.col("column") == c, i).otherwise(at)
    return (melt(wide_text, ["order_id"], cols, "column", "raw").withColumn("source", F.lit("orders"))
            .withColumn("position", at))


CELLS = """cells AS (SELECT 'orders' AS source, order_id, col AS "column", pos AS position, raw FROM (
 SELECT o_orderkey AS order_id, unnest(['o_orderkey','o_custkey','o_orderstatus','o_totalprice','day','o_orderpriority','flag','send_count']) AS col,
  unnest([0,1,2,3,4,5,6,7]) AS pos,
  unnest([o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, CAST(round(o_totalprice*100) AS BIGINT)::VARCHAR, strftime(o_orderdate,'%Y-%m-%d'), o_orderpriority,
   CASE WHEN o_orderstatus='F' THEN '1' ELSE '0' END, CASE WHEN o_orderstatus<>'P' THEN (o_custkey+5)::VARCHAR END]) AS raw FROM orders))"""
ON = ["source", "column"]
NUM = f"CASE WHEN regexp_matches(trim(raw), '{fx.PLAIN_NUMBER}') THEN TRY_CAST(trim(raw) AS DOUBLE) END"
DAY = "CASE WHEN regexp_full_match(raw,'[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(raw AS DATE) END"


@query("col_classify", f"""WITH {CELLS}, f AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY source, "column" ORDER BY order_id)<=50),
 n AS (SELECT source, "column", count(*) FILTER (raw IS NOT NULL AND raw<>'') AS n, count(*) FILTER (regexp_matches(raw,'^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) AS d,
  count(*) FILTER (NOT regexp_matches(raw,'^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND {NUM} IS NOT NULL) AS m FROM f GROUP BY 1,2)
 SELECT source, "column", CASE WHEN n=0 THEN 'text' WHEN d>0.6*n THEN 'date' WHEN m>0.6*n THEN 'numeric' ELSE 'text' END AS kind FROM n""")
def _(spark, sf):
    return rl.classify(text_cells(spark, sf), ON, "order_id", rows=fx.CLASSIFY_ROWS)


@query("date_score", f"""WITH {CELLS} SELECT source, "column", coalesce(count(*) FILTER (year({DAY}) BETWEEN 1990 AND 2100)/nullif(count(raw),0),0) AS score FROM cells GROUP BY 1,2""")
def _(spark, sf):
    return rl.date_score(text_cells(spark, sf), ON)


@query("date_column_detect", "SELECT 'orders' AS source, 'day' AS date_column")
def _(spark, sf):
    scores = rl.date_score(text_cells(spark, sf), [*ON, "position"])
    return rl.detect_date_column(scores, ["source"], "column", "position")


IDENT = f"""v AS (SELECT source, "column", order_id, {NUM} AS x FROM cells WHERE {NUM} IS NOT NULL),
 st AS (SELECT *, lag(x) OVER (PARTITION BY source, "column" ORDER BY order_id) AS p FROM v),
 ident AS (SELECT source, "column", count(*)>=5 AND count(DISTINCT x)>=0.95*count(*) AND bool_and(x=round(x)) AND coalesce(bool_and(x>p),true) AS is_identifier FROM st GROUP BY 1,2)"""


@query("col_is_identifier", f"WITH {CELLS}, {IDENT} SELECT * FROM ident")
def _(spark, sf):
    return rl.looks_like_identifier(text_cells(spark, sf), ON, "order_id")


@query("col_numeric_share", f"""WITH {CELLS} SELECT source, "column", coalesce(count({NUM})/nullif(count(raw),0),0) AS numeric_share FROM cells GROUP BY 1,2""")
def _(spark, sf):
    return rl.numeric_share(text_cells(spark, sf), ON)


ROLES = [("o_orderkey", "control"), ("o_custkey", "spend"), ("o_orderstatus", "kpi"), ("o_totalprice", "kpi"), ("day", "date"),
         ("o_orderpriority", "date"), ("flag", "spend"), ("send_count", "spend"), ("gone", "spend")]


def declared_roles(spark, sf):
    """Roles given to the columns that the cells have, plus one column that is not there."""
    rows = [("orders", c, r) for c, r in ROLES]
    return literal_frame(spark, rows, "source string, `column` string, role string")


ROLE_SQL = "roles AS (SELECT 'orders' AS source, c AS \"column\", r AS role FROM (VALUES " + ",".join(f"('{c}','{r}')" for c, r in ROLES) + ") t(c,r))"
WORDS = "|".join(fx.VOLUME_WORDS)
FINDINGS = f"""{CELLS}, {IDENT}, {ROLE_SQL},
 facts AS (SELECT source, "column", count(raw) AS n, count({NUM}) AS n_num, min({NUM}) AS lo, max({NUM}) AS hi, count(DISTINCT {NUM}) AS nd,
  count(*) FILTER ({NUM}<0) AS neg, count(*) FILTER ({NUM} NOT IN (0,1)) AS other, count(*) FILTER (year({DAY}) BETWEEN 1990 AND 2100) AS nday FROM cells GROUP BY 1,2),
 j AS (SELECT r.*, n, n_num, lo, hi, nd, neg, other, nday, coalesce(is_identifier,false) AS ident FROM roles r LEFT JOIN facts f ON r."column"=f."column" LEFT JOIN ident i ON r."column"=i."column"),
 findings AS (SELECT source, "column", role, code, CASE WHEN code='spend_column_may_be_volume' OR code='kpi_has_negatives' THEN 'warning' ELSE 'blocking' END AS severity FROM (
  SELECT source, "column", role, CASE WHEN n IS NULL THEN 'column_missing' WHEN role='date' THEN CASE WHEN nday<0.8*n THEN 'date_does_not_parse' END
   WHEN n_num<0.8*n THEN 'not_numeric' WHEN ident THEN 'looks_like_identifier'
   WHEN role='spend' THEN CASE WHEN neg>0 THEN 'negative_spend' WHEN hi<=0 THEN 'all_zero_channel' WHEN other=0 THEN 'binary_column_as_spend' WHEN regexp_matches("column", '{WORDS}') THEN 'spend_column_may_be_volume' END
   WHEN role='kpi' THEN CASE WHEN nd<5 THEN 'kpi_barely_varies' WHEN hi<=0 THEN 'kpi_not_positive' WHEN neg>0 THEN 'kpi_has_negatives' END
   WHEN role='control' THEN CASE WHEN nd<=1 THEN 'constant_control' END END AS code FROM j) WHERE code IS NOT NULL)"""


def _findings(spark, sf):
    return rl.validate_roles(declared_roles(spark, sf), rl.column_facts(text_cells(spark, sf), ON, "order_id"), ON)


@query("role_validate", f"WITH {FINDINGS} SELECT * FROM findings")
def _(spark, sf):
    return _findings(spark, sf)


BLOCKING = ",".join(f"'{c}'" for c in fx.BLOCKING_ROLE_CODES)


@query("role_gate", f"""WITH {FINDINGS} SELECT source, "column", role, code, CASE WHEN severity='blocking' AND code IN ({BLOCKING}) THEN 'error' ELSE 'warning' END AS severity FROM findings""")
def _(spark, sf):
    return rl.role_gate(_findings(spark, sf))


def brand_roles(spark, sf):
    """Roles per brand read off the part types: (p_brand, series, role)."""
    role = (F.when(F.col("p_type") == "SMALL", "date").when(F.col("p_type") == "ECONOMY", "kpi").otherwise("spend"))
    return table(spark, sf, "part").select("p_brand", F.col("p_name").alias("series"), role.alias("role"))


@query("role_structural", """WITH n AS (SELECT p_brand, count(*) FILTER (p_type='SMALL') AS d, count(*) FILTER (p_type='ECONOMY') AS k,
  count(*) FILTER (p_type NOT IN ('SMALL','ECONOMY')) AS s FROM part GROUP BY 1)
 SELECT p_brand, code, 'blocking' AS severity FROM (SELECT p_brand, CASE WHEN d=0 THEN 'no_date_column' WHEN d>1 THEN 'multiple_date_columns' END AS code FROM n
  UNION ALL SELECT p_brand, CASE WHEN k=0 THEN 'no_kpi_column' WHEN k>1 THEN 'multiple_kpi_columns' END FROM n
  UNION ALL SELECT p_brand, CASE WHEN s=0 THEN 'no_channels' END FROM n) WHERE code IS NOT NULL""")
def _(spark, sf):
    return rl.structural_findings(brand_roles(spark, sf), ["p_brand"])


@query("intent_build", f"""WITH {MASTER_SQL}, s AS (SELECT DISTINCT panel, series FROM master WHERE role='spend')
 SELECT panel, series, CASE WHEN series LIKE 'ch_r%' THEN 'grp' ELSE 'currency' END AS unit, CASE WHEN series LIKE '%_f' THEN 'long' ELSE 'unknown' END AS carryover,
  CASE WHEN series LIKE '%_f' THEN 'large' ELSE 'unknown' END AS strength, 'unknown' AS saturation, 'mixed' AS channel_role FROM s""")
def _(spark, sf):
    return intent(spark, sf)


def intent(spark, sf):
    roles = master(spark, sf).data.select("panel", "series", "role").distinct()
    spend = roles.where(F.col("role") == "spend").select("panel", "series")
    units = spend.where(F.col("series").startswith("ch_r")).withColumn("unit", F.lit("grp"))
    answers = (spend.where(F.col("series").endswith("_f")).withColumn("carryover", F.lit("long"))
               .withColumn("strength", F.lit("large")).withColumn("saturation", F.lit(None).cast("string")))
    return rl.build_intent(roles, units, answers, KEYS)


@query("intent_validate", f"""WITH {MASTER_SQL}, r AS (SELECT DISTINCT panel, series, role FROM master),
 ch AS (SELECT panel, series, CASE WHEN series='ch_a_f' THEN NULL WHEN series='ch_a_o' THEN 'barrels' ELSE 'currency' END AS unit FROM r WHERE role<>'kpi'
   UNION ALL SELECT panel, 'ghost', 'currency' FROM r WHERE role='kpi' UNION ALL SELECT panel, series, 'currency' FROM r WHERE series='ch_n_f')
 SELECT ch.panel, ch.series, 'unknown_column' AS problem FROM ch LEFT JOIN r ON ch.panel=r.panel AND ch.series=r.series WHERE role IS NULL
 UNION ALL SELECT ch.panel, ch.series, 'wrong_role' FROM ch JOIN r ON ch.panel=r.panel AND ch.series=r.series WHERE role<>'spend'
 UNION ALL SELECT panel, series, 'duplicate_channel' FROM ch GROUP BY 1,2 HAVING count(*)>1
 UNION ALL SELECT panel, series, 'unit_missing' FROM ch WHERE unit IS NULL
 UNION ALL SELECT panel, series, 'invalid_unit' FROM ch WHERE unit='barrels'
 UNION ALL SELECT panel, series, 'control_also_channel' FROM r WHERE role='control'
 UNION ALL SELECT panel, 'avg_qty', 'kpi_wrong_role' FROM r WHERE role='kpi'
 UNION ALL SELECT panel, 'avg_qty', 'kpi_also_channel' FROM r WHERE role='kpi'""")
def _(spark, sf):
    r = master(spark, sf).data.select("panel", "series", "role").distinct()
    unit = F.when(F.col("series") == "ch_a_f", None).when(F.col("series") == "ch_a_o", "barrels").otherwise("currency")
    kpi = r.where(F.col("role") == "kpi").select("panel")
    ch = (r.where(F.col("role") != "kpi").select("panel", "series", unit.alias("unit"))
          .unionByName(kpi.select("panel", F.lit("ghost").alias("series"), F.lit("currency").alias("unit")))
          .unionByName(r.where(F.col("series") == "ch_n_f").select("panel", "series", F.lit("currency").alias("unit")))
          .withColumns({c: F.lit("unknown") for c in ("carryover", "strength", "saturation")})
          .withColumn("channel_role", F.lit("mixed")))
    controls = r.where(F.col("role") == "control").select("panel", "series")
    return rl.validate_intent(ch, controls, kpi.withColumn("series", F.lit("avg_qty")), r, KEYS)


def line_cells(spark, sf):
    """Four numeric columns of ``lineitem``: (source, column, value)."""
    return melt(table(spark, sf, "lineitem").select(F.lit("lineitem").alias("source"), *NUMERIC),
                ["source"], NUMERIC, "column", "value")


LINES = f"""cells AS (SELECT unnest({NUMERIC}) AS "column", unnest([{','.join(NUMERIC)}]) AS value FROM lineitem)"""


@query("profile_stats", f"""WITH {LINES} SELECT "column", count(value) AS n, count(*)-count(value) AS n_missing, min(value) AS min, max(value) AS max,
 round(avg(value),6) AS mean, round(stddev_pop(value),6) AS std, quantile_cont(value,0.25) AS p25, quantile_cont(value,0.5) AS p50, quantile_cont(value,0.75) AS p75 FROM cells GROUP BY 1""")
def _(spark, sf):
    out = pf.column_stats(line_cells(spark, sf), ["column"])
    return out.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


def gappy_orders(spark, sf):
    """Order amounts per panel where pending orders count as empty: (panel, series, order_id, ts, value)."""
    return shop(spark, sf).select("panel", F.lit("amount").alias("series"), "order_id", "ts",
                                  F.when(F.col("status") != "P", F.col("cents")).alias("value"))


RUNS = RAW_SQL + """, g AS (SELECT panel, 'amount' AS series, order_id, ts, CASE WHEN status<>'P' THEN cents END AS value FROM shop),
 nb AS (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY order_id)-1 AS rn, count(value) OVER (PARTITION BY panel ORDER BY order_id) AS seen FROM g),
 runs AS (SELECT panel, series, min(rn) AS start, count(*) AS length, arg_min(ts, order_id) AS start_label, arg_max(ts, order_id) AS end_label
   FROM nb WHERE value IS NULL GROUP BY panel, series, seen)"""
PS = ["panel", "series"]


@query("profile_missing_runs", f"""WITH {RUNS} SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY panel, series ORDER BY length DESC, start)<=24""")
def _(spark, sf):
    return pf.kept_runs(pf.missing_runs(gappy_orders(spark, sf), PS, "order_id", label="ts"), PS, fx.MISSING_RUNS_KEPT)


@query("profile_longest_gap", f"WITH {RUNS} SELECT panel, series, max(length) AS longest_missing_run FROM runs GROUP BY 1,2")
def _(spark, sf):
    return pf.longest_gap(pf.missing_runs(gappy_orders(spark, sf), PS, "order_id", label="ts"), PS)


@query("profile_outliers", f"""WITH {MASTER_SQL}, s AS (SELECT panel, series, avg(value) AS m, stddev_pop(value) AS sd FROM master GROUP BY 1,2),
 z AS (SELECT panel, series, week_start, value, (value-m)/nullif(sd,0) AS z FROM master JOIN s USING (panel, series))
 SELECT panel, series, week_start, value, round(z,6) AS z, CAST(row_number() OVER (PARTITION BY panel, series ORDER BY abs(z) DESC, week_start) AS INTEGER) AS outlier_no
 FROM z WHERE abs(z)>=3.5 QUALIFY row_number() OVER (PARTITION BY panel, series ORDER BY abs(z) DESC, week_start)<=6""")
def _(spark, sf):
    return pf.outliers(master(spark, sf).data.drop("role"), PS, WEEK, top=fx.OUTLIER_TOP).withColumn("z", F.round("z", 6))


PROFILE_PAIRS = " UNION ALL ".join(
    f"SELECT panel, '{a}' AS a, '{b}' AS b, corr({a},{b}) AS r FROM wide GROUP BY panel" for a, b in combinations(["revenue", *CHANNELS], 2))


@query("profile_correlations", f"""WITH {WIDE_SQL}, p AS ({PROFILE_PAIRS})
 SELECT panel, a, b, round(r,6) AS r, CAST(row_number() OVER (PARTITION BY panel ORDER BY abs(r) DESC, a, b) AS INTEGER) AS pair_no FROM p WHERE abs(r)>=0.02
 QUALIFY row_number() OVER (PARTITION BY panel ORDER BY abs(r) DESC, a, b)<=12""")
def _(spark, sf):
    return pf.correlations(wide(spark, sf), KEYS, ["revenue", *CHANNELS], 0.02, fx.CORRELATION_TOP).withColumn("r", F.round("r", 6))


@query("profile_histogram", f"""WITH {LINES}, s AS (SELECT "column", min(value) AS lo, (max(value)-min(value))/12 AS w FROM cells GROUP BY 1),
 c AS (SELECT c."column", least(CAST(floor((value-lo)/w) AS INTEGER), 11) AS bin, count(*) AS n FROM cells c JOIN s ON c."column"=s."column" GROUP BY 1,2),
 f AS (SELECT "column", lo, w, CAST(unnest(generate_series(0,11)) AS INTEGER) AS bin FROM s)
 SELECT f."column", f.bin, round(lo+f.bin*w,6) AS bin_start, coalesce(n,0) AS n FROM f LEFT JOIN c ON f."column"=c."column" AND f.bin=c.bin""")
def _(spark, sf):
    return pf.histogram(line_cells(spark, sf), ["column"]).withColumn("bin_start", F.round("bin_start", 6))


@query("profile_date_range", f"WITH {RAW_SQL} SELECT panel, arg_min(ts, order_id) AS first_label, arg_max(ts, order_id) AS last_label FROM shop GROUP BY 1")
def _(spark, sf):
    return pf.date_range(shop(spark, sf), KEYS, "ts", "order_id")


@query("profile_build")
def _(spark, sf):
    return pf.build_profile(master(spark, sf).data.withColumn("at", F.unix_date(WEEK)).drop("role"), PS, "at", WEEK, ["revenue", *CHANNELS])


@query("source_check", """WITH s AS (SELECT o_custkey, CASE WHEN count(*)>2 THEN 'o_orderdate' END AS date_column, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day,
   1+CAST(max(o_totalprice)>200000 AS INTEGER) AS n_numeric FROM orders GROUP BY 1),
 w AS (SELECT *, CASE WHEN last_day>first_day THEN CAST(round((last_day-first_day)/7) AS BIGINT) END AS weeks FROM s)
 SELECT *, CASE WHEN date_column IS NULL OR n_numeric<2 OR coalesce(weeks<26,false) THEN 'not_usable' WHEN weeks IS NULL OR weeks<52 THEN 'usable_with_warnings' ELSE 'usable' END AS verdict FROM w""")
def _(spark, sf):
    s = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.when(F.count(F.lit(1)) > 2, "o_orderdate").alias("date_column"), F.to_date(F.min("o_orderdate")).alias("first_day"),
        F.to_date(F.max("o_orderdate")).alias("last_day"), (1 + (F.max("o_totalprice") > 200000).cast("int")).alias("n_numeric"))
    return pf.source_check(s)


@query("finding_list", f"""WITH {WIDE_SQL}, s AS (SELECT panel, series, role, avg(value) AS m, stddev_pop(value) AS sd FROM master GROUP BY 1,2,3),
 z AS (SELECT panel, series, role, week_start, (value-m)/nullif(sd,0) AS z FROM master JOIN s USING (panel, series, role) WHERE role='kpi'),
 far AS (SELECT panel, series, z FROM z WHERE abs(z)>=3.5 QUALIFY row_number() OVER (PARTITION BY panel, series ORDER BY abs(z) DESC, week_start)<=3),
 nb AS (SELECT *, count(value) OVER (PARTITION BY panel, series ORDER BY week_start) AS seen FROM master WHERE role='control'),
 gap AS (SELECT panel, series, max(k) AS k FROM (SELECT panel, series, seen, count(*) AS k FROM nb WHERE value IS NULL GROUP BY 1,2,3) GROUP BY 1,2 HAVING max(k)>=2),
 p AS ({PROFILE_PAIRS})
 SELECT panel, 'gap' AS kind, series AS subject, NULL::VARCHAR AS other, k::DOUBLE AS evidence, 'ffill' AS default_choice FROM gap
 UNION ALL SELECT panel, 'outlier', series, NULL, round(z,6), 'keep' FROM far
 UNION ALL SELECT panel, 'duplicate', a, b, round(r,6), 'keep' FROM p WHERE abs(r)>=0.9""")
def _(spark, sf):
    data = master(spark, sf).data
    cells = data.withColumn("at", F.unix_date(WEEK)).drop("role")
    gaps = pf.longest_gap(pf.missing_runs(cells, PS, "at", label=WEEK), PS)
    far = pf.outliers(cells, PS, "at")
    pairs = pf.correlations(wide(spark, sf), KEYS, ["revenue", *CHANNELS])
    roles = data.select("panel", "series", "role").distinct()
    return pf.findings(gaps, far, pairs, roles, KEYS, fx.FINDING_KPI_OUTLIERS).withColumn("evidence", F.round("evidence", 6))


@query("steps_together", f"""WITH {WIDE_SQL}, s AS (SELECT panel, ch_a_f-lag(ch_a_f) OVER (PARTITION BY panel ORDER BY week_start) AS da,
   revenue-lag(revenue) OVER (PARTITION BY panel ORDER BY week_start) AS db FROM wide WHERE ch_a_f IS NOT NULL AND revenue IS NOT NULL)
 SELECT panel, count(*) FILTER ((da<>0 OR db<>0) AND (da>=0)=(db>=0))/nullif(count(*) FILTER (da<>0 OR db<>0),0) AS share_together FROM s GROUP BY 1""")
def _(spark, sf):
    return pf.steps_together(wide(spark, sf), KEYS, WEEK, "ch_a_f", "revenue")


@query("outlier_rank", f"""WITH {MASTER_SQL} SELECT panel, series, week_start, value, CAST(rank() OVER (PARTITION BY panel, series ORDER BY value DESC) AS INTEGER) AS value_rank
 FROM master WHERE value IS NOT NULL""")
def _(spark, sf):
    return pf.outlier_rank(master(spark, sf).data.drop("role"), PS)


@query("neighbour_values", f"""WITH {MASTER_SQL} SELECT panel, series, week_start, value,
 last_value(value IGNORE NULLS) OVER (PARTITION BY panel, series ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS value_before,
 first_value(value IGNORE NULLS) OVER (PARTITION BY panel, series ORDER BY week_start ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS value_after FROM master WHERE role='control'""")
def _(spark, sf):
    return pf.neighbour_values(master(spark, sf).data.where(F.col("role") == "control").drop("role"), PS, WEEK)


@query("context_rows", f"""WITH {MASTER_SQL}, n AS (SELECT panel, series, week_start, value, CAST(row_number() OVER (PARTITION BY panel, series ORDER BY week_start) AS INTEGER) AS rn FROM master WHERE role='kpi'),
 m AS (SELECT panel, series, rn AS mark FROM n QUALIFY row_number() OVER (PARTITION BY panel, series ORDER BY value DESC, rn)<=3)
 SELECT n.panel, n.series, n.rn, n.week_start, n.value, m.mark, n.rn=m.mark AS marked FROM n JOIN m ON n.panel=m.panel AND n.series=m.series AND n.rn BETWEEN m.mark-2 AND m.mark+2""")
def _(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy(*PS)
    n = (master(spark, sf).data.where(F.col("role") == "kpi").drop("role").withColumn("rn", F.row_number().over(w.orderBy(WEEK))))
    top = (n.withColumn("k", F.row_number().over(w.orderBy(F.desc("value"), "rn"))).where(F.col("k") <= 3)
           .select(*PS, F.col("rn").alias("mark"), F.col("rn").alias("lo"), F.col("rn").alias("hi")))
    return pf.context_rows(n, top, PS, "rn", 2)


@query("recipe_events", f"""WITH {RAW_SQL}, c AS (SELECT panel, CAST(ts AS DATE) AS day, CASE WHEN priority<>'5-LOW' THEN priority END AS note FROM shop WHERE cents>49500000),
 w AS (SELECT panel, CAST(isoyear(day) AS INTEGER) AS iso_year, CAST(week(day) AS INTEGER) AS iso_week, arg_min(note, (day, note)) FILTER (note IS NOT NULL) AS first_note, count(DISTINCT note) AS n_notes FROM c GROUP BY 1,2,3),
 b AS (SELECT *, coalesce(nullif({SLUG.format(c='first_note')},''),'bijzondere_week')||'_'||iso_year||'_'||lpad(iso_week::VARCHAR,2,'0') AS base_name FROM w)
 SELECT panel, iso_year, iso_week, first_note, n_notes, base_name, base_name AS name FROM b""")
def _(spark, sf):
    note = F.when(F.col("priority") != "5-LOW", F.col("priority"))
    picked = shop(spark, sf).where(F.col("cents") > 49500000).select("panel", F.to_date("ts").alias("day"), note.alias("note"))
    return pf.recipe_events(picked, KEYS, "day", "note")
