"""Queries: lifecycle tables, files, sinks and streams."""

from pyspark.sql import Window, functions as F

from tidemark import fixed_values as fx
from tidemark.frames import WEEK
from tidemark.operators import lifecycle as lc, quality as ql
from tidemark.plans.inputs import KEYS, MASTER_SQL, RAW_SQL, WEEKLY_SQL, master, media, params, raw_long, shop, table
from tidemark.plans.registry import query
from tidemark.session import scratch
from tidemark.sources import event_log as el, readers as rd, sinks as sk
from tidemark.streaming import jobs as st, stateful as sful

# customers are projects, orders are runs, dataset versions and files; the SQL says the same
LIFE_SQL = """runs AS (SELECT o_orderkey AS run, o_custkey AS project, o_orderdate AS created_at, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'sampling' ELSE 'failed' END AS state FROM orders),
 results AS (SELECT o_orderkey AS run, o_totalprice>250000 AS is_published FROM orders WHERE o_orderstatus='F'),
 verdicts AS (SELECT o_orderkey AS run, CASE o_orderpriority WHEN '1-URGENT' THEN 'usable_for_decisions' WHEN '2-HIGH' THEN 'statistically_valid' WHEN '3-MEDIUM' THEN 'technically_completed' ELSE 'not_usable' END AS level FROM orders WHERE o_orderstatus='F' AND o_orderpriority<>'5-LOW'),
 datasets AS (SELECT o_orderkey AS dataset, o_custkey AS project, o_orderdate AS created_at, CASE WHEN o_orderstatus='P' THEN 'building' ELSE 'ready' END AS status, CASE o_orderpriority WHEN '1-URGENT' THEN 'not_usable' ELSE 'usable' END AS verdict,
   CASE WHEN o_totalprice>200000 THEN o_orderdate + INTERVAL 1 DAY END AS approved_at FROM orders)"""


def runs(spark, sf):
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "sampling").otherwise("failed")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("project"), F.col("o_orderdate").alias("created_at"), state.alias("state"))


def results(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("run"), (F.col("o_totalprice") > 250000).alias("is_published"))


def run_verdicts(spark, sf):
    p = F.col("o_orderpriority")
    level = (F.when(p == "1-URGENT", "usable_for_decisions").when(p == "2-HIGH", "statistically_valid").when(p == "3-MEDIUM", "technically_completed").otherwise("not_usable"))
    return table(spark, sf, "orders").where((F.col("o_orderstatus") == "F") & (p != "5-LOW")).select(F.col("o_orderkey").alias("run"), level.alias("level"))


def datasets(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("dataset"), F.col("o_custkey").alias("project"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "P", "building").otherwise("ready").alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "not_usable").otherwise("usable").alias("verdict"),
        F.when(F.col("o_totalprice") > 200000, F.col("o_orderdate") + F.expr("interval 1 day")).alias("approved_at"))


@query("lc_latest_view", f"""WITH {LIFE_SQL}, t AS (SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY created_at DESC, run DESC) AS INTEGER) AS run_no FROM runs QUALIFY run_no<=10)
 SELECT t.*, is_published, level FROM t LEFT JOIN results r ON t.run=r.run LEFT JOIN verdicts v ON t.run=v.run""")
def _(spark, sf):
    return lc.latest_runs(runs(spark, sf), results(spark, sf), run_verdicts(spark, sf), fx.RUNS_SHOWN)


@query("lc_project_heads", f"""WITH {LIFE_SQL}, a AS (SELECT project, dataset AS newest_dataset, status AS newest_status FROM datasets QUALIFY row_number() OVER (PARTITION BY project ORDER BY created_at DESC, dataset DESC)=1),
 b AS (SELECT project, dataset AS approved_dataset FROM datasets WHERE approved_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project ORDER BY created_at DESC, dataset DESC)=1),
 i AS (SELECT user_id AS project, event_id AS newest_inspection FROM events WHERE event_type='view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)=1)
 SELECT coalesce(a.project, i.project) AS project, newest_dataset, newest_status, approved_dataset, newest_inspection FROM a LEFT JOIN b ON a.project=b.project FULL JOIN i ON a.project=i.project""")
def _(spark, sf):
    seen = table(spark, sf, "events").where(F.col("event_type") == "view").select(
        F.col("user_id").alias("project"), F.col("event_id").alias("inspection"), F.col("ts").alias("created_at"))
    return lc.project_heads(datasets(spark, sf), seen)


STEP = "['goal','data','columns','prepare','beliefs','launch','results','share']"
LEDGER_SQL = f"ledger AS (SELECT o_custkey AS project, {STEP}[1+CAST(o_orderkey%8 AS INTEGER)] AS step, o_orderdate AS decided_at FROM orders)"


def ledger(spark, sf):
    names = F.array(*[F.lit(s) for s, _ in fx.FLOW_STEPS])
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("project"), F.get(names, (F.col("o_orderkey") % 8).cast("int")).alias("step"), F.col("o_orderdate").alias("decided_at"))


@query("lc_progress", f"""WITH {LIFE_SQL}, {LEDGER_SQL}, s AS (SELECT o_custkey AS project, min(l_shipdate) AS first_source_at FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1),
 d AS (SELECT project, status AS dataset_status FROM datasets QUALIFY row_number() OVER (PARTITION BY project ORDER BY created_at DESC, dataset DESC)=1), a AS (SELECT project, max(approved_at) AS approved_at FROM datasets GROUP BY 1),
 r AS (SELECT project, state AS run_state, count(*) OVER (PARTITION BY project) AS n_runs FROM runs QUALIFY row_number() OVER (PARTITION BY project ORDER BY created_at DESC, run DESC)=1), l AS (SELECT project, count(DISTINCT step) AS n_steps FROM ledger GROUP BY 1)
 SELECT c_custkey AS project, first_source_at, dataset_status, approved_at, run_state, coalesce(n_runs,0) AS n_runs, coalesce(n_steps,0) AS n_steps FROM customer LEFT JOIN s ON c_custkey=s.project LEFT JOIN d ON c_custkey=d.project LEFT JOIN a ON c_custkey=a.project LEFT JOIN r ON c_custkey=r.project LEFT JOIN l ON c_custkey=l.project""")
def _(spark, sf):
    sources = (table(spark, sf, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("created_at"))
               .join(table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("project")), F.col("l_orderkey") == F.col("o_orderkey")))
    projects = table(spark, sf, "customer").select(F.col("c_custkey").alias("project"))
    return lc.progress(projects, sources, datasets(spark, sf), runs(spark, sf), ledger(spark, sf))


def _stale_sql():
    names = [s for s, _ in fx.FLOW_STEPS]
    wide = ", ".join(f"max(decided_at) FILTER (step='{s}') AS a{i}" for i, s in enumerate(names))
    levels = "f0 AS (SELECT *, false AS s0 FROM w)"
    for i in range(1, 8):
        levels += f", f{i} AS (SELECT *, a{i} IS NOT NULL AND (s{i - 1} OR coalesce(a{i - 1}>a{i},false)) AS s{i} FROM f{i - 1})"
    first = "CASE " + " ".join(f"WHEN a{i} IS NULL OR s{i} THEN '{s}'" for i, s in enumerate(names)) + " ELSE 'share' END"
    rows = " UNION ALL ".join(
        f"SELECT project, active_step, {i + 1} AS step_no, '{s}' AS step, CASE WHEN active_step='{s}' THEN 'active' WHEN s{i} THEN 'stale' WHEN a{i} IS NOT NULL THEN 'done' ELSE 'todo' END AS status, "
        f"CASE WHEN s{i} THEN {repr(names[i - 1]) if i else 'NULL'} END AS stale_because_of FROM f" for i, s in enumerate(names))
    return f"WITH {LEDGER_SQL}, w AS (SELECT project, {wide} FROM ledger GROUP BY 1), {levels}, f AS (SELECT *, {first} AS active_step FROM f7) {rows}"


@query("lc_staleness", _stale_sql())
def _(spark, sf):
    return lc.flow_state(lc.latest_decisions(ledger(spark, sf)))


@query("lc_version_no", "SELECT o_custkey AS project, count(*)+1 AS next_version_no FROM orders GROUP BY 1")
def _(spark, sf):
    v = table(spark, sf, "orders").select(F.col("o_custkey").alias("project"), "o_orderkey")
    return lc.next_version(lc.number_versions(v, "o_orderkey"))


@query("lc_approve_one", f"""WITH {LIFE_SQL} SELECT project, dataset, approved_at FROM datasets WHERE status='ready' AND verdict<>'not_usable' AND approved_at IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY project ORDER BY approved_at DESC, dataset DESC)=1""")
def _(spark, sf):
    return lc.approved_versions(datasets(spark, sf))


GATE_SQL = LIFE_SQL + """, rq AS (SELECT o_orderkey AS run, CASE WHEN o_orderpriority='2-HIGH' AND o_totalprice>400000 THEN o_custkey+1 ELSE o_custkey END AS project, o_orderdate AS requested_at FROM orders WHERE o_totalprice>100000),
 ow AS (SELECT o_orderkey AS run, o_custkey AS owner FROM orders WHERE o_orderstatus='F'),
 gate AS (SELECT rq.*, level, CASE WHEN owner IS NULL OR owner<>project THEN 'result_not_of_project' WHEN level IS NULL THEN 'not_judged' WHEN level NOT IN ('statistically_valid','usable_for_decisions') THEN 'below_threshold' END AS refused
   FROM rq LEFT JOIN ow ON rq.run=ow.run LEFT JOIN verdicts v ON rq.run=v.run)"""


def gate(spark, sf):
    o = table(spark, sf, "orders")
    wrong = (F.col("o_orderpriority") == "2-HIGH") & (F.col("o_totalprice") > 400000)
    rq = o.where(F.col("o_totalprice") > 100000).select(F.col("o_orderkey").alias("run"), F.when(wrong, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("project"), F.col("o_orderdate").alias("requested_at"))
    own = o.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("project"))
    return lc.publish_gate(rq, own, run_verdicts(spark, sf))


@query("lc_publish_gate", f"WITH {GATE_SQL} SELECT run, project, requested_at, level, refused FROM gate")
def _(spark, sf):
    return gate(spark, sf)


@query("lc_published", f"WITH {GATE_SQL} SELECT project, run FROM gate WHERE refused IS NULL QUALIFY row_number() OVER (PARTITION BY project ORDER BY requested_at DESC, run DESC)=1")
def _(spark, sf):
    return lc.published(gate(spark, sf))


@query("lc_visible_results", """SELECT o_custkey AS project, o_orderkey AS run, o_totalprice>250000 AS is_published FROM orders WHERE o_orderstatus='F' AND o_totalprice>250000
 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment<>'MACHINERY') AND o_custkey IN (SELECT user_id FROM events)""")
def _(spark, sf):
    r = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("run"), (F.col("o_totalprice") > 250000).alias("is_published"))
    projects = table(spark, sf, "customer").select(F.col("c_custkey").alias("project"), F.when(F.col("c_mktsegment") == "MACHINERY", "draft").otherwise("published").alias("status"))
    return lc.visible_results(r, projects, table(spark, sf, "events").select(F.col("user_id").alias("project")))


@query("lc_owned_sources", """SELECT DISTINCT l_suppkey AS project, l_partkey AS source FROM lineitem WHERE l_discount>0.05
EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_discount<=0.05""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("project"), F.col("l_partkey").alias("source"), "l_discount")
    used = li.where(F.col("l_discount") > 0.05).select("project", "source").distinct()
    return lc.foreign_sources(used, li.where(F.col("l_discount") <= 0.05).select("project", "source"))


@query("lc_idempotent", """WITH k AS (SELECT o_orderkey AS request, sha256(concat_ws('|', o_custkey::VARCHAR, o_orderstatus, o_orderpriority, '7')) AS run_key, o_totalprice FROM orders)
 SELECT run_key, min(request) AS request FROM k WHERE run_key NOT IN (SELECT run_key FROM k WHERE o_totalprice>400000) GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("request"), "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", F.lit(7).alias("seed"))
    k = lc.run_keys(o, ["o_custkey", "o_orderstatus", "o_orderpriority", "seed"])
    return lc.new_runs(k, k.where(F.col("o_totalprice") > 400000), "request")


@query("lc_capacity", f"""WITH {LIFE_SQL} SELECT project, count(*) FILTER (state='sampling' AND created_at>=TIMESTAMP '2000-01-01'-INTERVAL 525600 MINUTE) AS in_flight,
 count(*) FILTER (state='sampling' AND created_at>=TIMESTAMP '2000-01-01'-INTERVAL 525600 MINUTE)<{fx.MAX_FITS} AS has_capacity FROM runs GROUP BY 1""")
def _(spark, sf):
    now = F.lit("2000-01-01").cast("timestamp")
    return lc.capacity(runs(spark, sf), now, 525600, fx.MAX_FITS)


def failures(spark, sf):
    kind = (F.when(F.col("source") == "src0", "RunCancelled").when(F.col("source") == "src1", "SpecError").when(F.col("source") == "src2", "MemoryError")
            .when(F.col("source") == "src3", "TimeoutError").otherwise("ValueError"))
    return table(spark, sf, "documents").select("doc_id", kind.alias("kind"), "text", (F.col("n_chars") % 3).alias("attempt"))


FAIL_SQL = """fl AS (SELECT doc_id, CASE source WHEN 'src0' THEN 'RunCancelled' WHEN 'src1' THEN 'SpecError' WHEN 'src2' THEN 'MemoryError' WHEN 'src3' THEN 'TimeoutError' ELSE 'ValueError' END AS kind, text, n_chars%3 AS attempt FROM documents),
 fc AS (SELECT doc_id, attempt, CASE kind WHEN 'RunCancelled' THEN 'CANCELLED' WHEN 'SpecError' THEN 'CONFIG_INVALID' WHEN 'MemoryError' THEN 'OOM' WHEN 'TimeoutError' THEN 'TIMEOUT'
   ELSE CASE WHEN regexp_matches(lower(text),'storage|download|upload|connection|timed out') THEN 'STORAGE_UNAVAILABLE' ELSE 'INTERNAL' END END AS code FROM fl)"""


@query("lc_error_class", f"WITH {FAIL_SQL} SELECT doc_id, code, code IN ('STORAGE_UNAVAILABLE','TIMEOUT','OOM','INTERNAL') AS retryable FROM fc")
def _(spark, sf):
    code = lc.error_class(F.col("kind"), F.col("text"))
    return failures(spark, sf).select("doc_id", code.alias("code")).withColumn("retryable", lc.is_retryable(F.col("code")))


@query("lc_retry", f"WITH {FAIL_SQL} SELECT doc_id, code, CASE WHEN code IN ('STORAGE_UNAVAILABLE','TIMEOUT','OOM','INTERNAL') AND attempt<2 THEN 'queued' WHEN code='CANCELLED' THEN 'cancelled' ELSE 'failed' END AS state FROM fc")
def _(spark, sf):
    f = failures(spark, sf).withColumn("code", lc.error_class(F.col("kind"), F.col("text")))
    return f.select("doc_id", "code", lc.after_failure(F.col("code"), F.col("attempt"), F.lit(2)).alias("state"))


LOG_SQL = """log AS (SELECT event_id, ts AS "at", user_id::VARCHAR AS session_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'view' THEN 'debug' ELSE 'info' END AS level, event_type AS event, props AS detail FROM events)"""


def log(spark, sf):
    t = F.col("event_type")
    level = F.when(t == "error", "error").when(t == "signup", "warn").when(t == "view", "debug").otherwise("info")
    return table(spark, sf, "events").select("event_id", F.col("ts").alias("at"), F.col("user_id").cast("string").alias("session_id"), level.alias("level"), t.alias("event"), F.col("props").alias("detail"))


@query("lc_log_tail", f"""WITH {LOG_SQL}, t AS (SELECT * FROM log ORDER BY "at" DESC, event_id DESC LIMIT 500) SELECT event_id, "at", session_id, level, event, (SELECT count(*) FROM t WHERE level<>'info') AS n_problems FROM t""")
def _(spark, sf):
    return lc.log_tail(log(spark, sf), fx.LOG_TAIL).drop("detail")


@query("lc_log_sessions", f"""WITH {LOG_SQL} SELECT session_id, max("at") AS last_at, count(*) AS n_events, count(*) FILTER (level<>'info') AS n_problems FROM log GROUP BY 1""")
def _(spark, sf):
    return lc.log_sessions(log(spark, sf))


@query("lc_log_filter", f"WITH {LOG_SQL} SELECT event_id, session_id, level FROM log WHERE level<>'info'")
def _(spark, sf):
    return lc.log_rows(log(spark, sf), only_problems=True).select("event_id", "session_id", "level")


@query("lc_log_session", f"""WITH {LOG_SQL} SELECT event_id, session_id, "at", lag("at") OVER w AS previous_at, date_diff('microsecond', lag("at") OVER w, "at")/1000000 AS gap_seconds FROM log WINDOW w AS (PARTITION BY session_id ORDER BY "at")""")
def _(spark, sf):
    return lc.session_timeline(log(spark, sf).select("event_id", "session_id", "at"))


@query("lc_orphan_versions", f"WITH {LIFE_SQL} SELECT dataset, project FROM datasets WHERE dataset NOT IN (SELECT l_orderkey FROM lineitem)")
def _(spark, sf):
    used = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("dataset"))
    return lc.orphan_versions(datasets(spark, sf).select("dataset", "project"), used)


# --- sources and sinks -----------------------------------------------------------------------

@query("src_parquet", "SELECT r_regionkey, r_name, n_nationkey, n_name FROM region JOIN nation ON n_regionkey=r_regionkey")
def _(spark, sf):
    r, n = rd.read_table(spark, f"{sf}/region.parquet"), rd.read_table(spark, f"{sf}/nation.parquet")
    return r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", "r_name", "n_nationkey", "n_name")


RAGGED_SQL = "c_custkey::VARCHAR||';'||c_name||';'||c_mktsegment||CASE WHEN c_custkey%7=0 THEN ';more' ELSE '' END"


@query("src_csv_read", f"""SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment, CASE WHEN c_custkey%7=0 THEN {RAGGED_SQL} END AS _corrupt FROM customer""")
def _(spark, sf):
    """A file with a field too many in every seventh row."""
    path, more = scratch(spark, "csv"), F.when(F.col("c_custkey") % 7 == 0, ";more").otherwise("")
    line = F.concat(F.concat_ws(";", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment"), more)
    lines = table(spark, sf, "customer").select(line.alias("c_custkey;c_name;c_mktsegment"))
    lines.write.csv(path, header=True, sep="\t", quote="")
    return rd.read_delimited(spark, path, ",")


SEP = "CASE o_orderstatus WHEN 'F' THEN ',' WHEN 'O' THEN ';' ELSE '|' END"


@query("src_delim_detect", f"SELECT o_orderkey, {SEP} AS separator FROM orders")
def _(spark, sf):
    s = F.when(F.col("o_orderstatus") == "F", ",").when(F.col("o_orderstatus") == "O", ";").otherwise("|")
    lines = table(spark, sf, "orders").select("o_orderkey", F.concat_ws("", F.col("o_orderkey").cast("string"), s, "o_orderstatus", s, "o_orderpriority").alias("value"))
    return rd.separator_counts(lines, ["o_orderkey"])


@query("src_intake_catalog", """WITH f AS (SELECT source AS project, doc_id::VARCHAR||'.'||CASE lang WHEN 'en' THEN 'csv' WHEN 'fr' THEN 'xlsx' WHEN 'de' THEN 'pdf' ELSE 'xls' END AS path, doc_id AS created_at, strlen(text)*CASE WHEN n_chars>5000 THEN 5000 ELSE 1 END AS length,
   CASE lang WHEN 'en' THEN 'csv' WHEN 'fr' THEN 'xlsx' WHEN 'de' THEN 'pdf' ELSE 'xls' END AS extension, sha256(text) AS sha256 FROM documents),
 k AS (SELECT project, sha256, arg_min(path, (created_at, path)) AS first FROM f WHERE extension<>'pdf' AND length>0 AND length<=52428800 GROUP BY 1,2)
 SELECT f.project, f.path, CASE WHEN extension='pdf' THEN 'wrong_type' WHEN length<=0 THEN 'empty' WHEN length>52428800 THEN 'too_large' WHEN path<>first THEN 'duplicate_upload' END AS refused FROM f LEFT JOIN k ON f.project=k.project AND f.sha256=k.sha256""")
def _(spark, sf):
    ext = F.when(F.col("lang") == "en", "csv").when(F.col("lang") == "fr", "xlsx").when(F.col("lang") == "de", "pdf").otherwise("xls")
    size = F.octet_length("text").cast("bigint") * F.when(F.col("n_chars") > 5000, 5000).otherwise(1)
    files = table(spark, sf, "documents").select(
        F.col("source").alias("project"), F.concat(F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), F.col("doc_id").alias("created_at"),
        size.alias("length"), ext.alias("extension"), F.sha2("text", 256).alias("sha256"))
    return rd.judge_uploads(files, fx.UPLOAD_MAX_BYTES).select("project", "path", "refused")


@query("src_intake_files")
def _(spark, sf):
    path = scratch(spark, "uploads")
    table(spark, sf, "customer").select("c_name", "c_mktsegment").repartition("c_mktsegment").write.partitionBy("c_mktsegment").csv(path, header=True)
    return rd.intake(spark, path).select("project", "extension", "length", "sha256", "refused")


@query("src_event_log", """WITH e AS (SELECT doc_id, source AS session_id, CASE lang WHEN 'en' THEN 'info' WHEN 'fr' THEN 'warn' WHEN 'de' THEN 'error' ELSE 'debug' END AS level, text, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM documents)
 SELECT doc_id, session_id, level, left(text,120) AS event, CASE WHEN length(text)>2000 THEN left(text,2000)||'… [afgekapt, '||length(text)||' tekens]' ELSE text END AS message FROM e WHERE rn<=50 AND level<>'debug'""")
def _(spark, sf):
    level = F.when(F.col("lang") == "en", "info").when(F.col("lang") == "fr", "warn").when(F.col("lang") == "de", "error").otherwise("debug")
    raw = table(spark, sf, "documents").select("doc_id", F.col("source").alias("session_id"), "lang", level.alias("level"), F.col("text").alias("event"),
                                               F.col("text").alias("message"), F.lit(None).cast("string").alias("detail"))
    return el.accept_batches(raw, ["session_id", "lang"], ["doc_id"], fx.LOG_BATCH, clip=True).select("doc_id", "session_id", "level", "event", "message")


@query("sink_master", f"""WITH {MASTER_SQL} SELECT panel, min(week_start) AS window_start, max(week_start) AS window_end, count(DISTINCT week_start) AS n_weeks, count(DISTINCT series) FILTER (role='kpi') AS n_kpi,
 count(DISTINCT series) FILTER (role='spend') AS n_spend, count(DISTINCT series) FILTER (role='control') AS n_control, count(*) AS n_rows FROM master GROUP BY 1""")
def _(spark, sf):
    return sk.write_master(master(spark, sf).data, KEYS, scratch(spark, "master")).drop("content_hash")


@query("sink_preview", f"WITH {MASTER_SQL} SELECT panel, series, role, count(*)-count(value) AS n_missing, min(value) AS min, max(value) AS max, round(avg(value),4) AS mean FROM master GROUP BY 1,2,3")
def _(spark, sf):
    return sk.preview_columns(master(spark, sf).data, KEYS).withColumn("mean", F.round("mean", 4))


@query("sink_preview_rows", f"""WITH {MASTER_SQL} SELECT panel, week_start, series, role, value FROM master
 QUALIFY row_number() OVER (PARTITION BY panel, series ORDER BY week_start)<=6 OR row_number() OVER (PARTITION BY panel, series ORDER BY week_start DESC)<=6""")
def _(spark, sf):
    return sk.preview_rows(master(spark, sf).data, KEYS)


@query("sink_json_safe", f"WITH {MASTER_SQL} SELECT panel, week_start, series, CASE WHEN value<>0 THEN 1e6::DOUBLE/value END AS inverse FROM master")
def _(spark, sf):
    zero = F.when(F.col("value") == 0, F.lit(float("inf"))).when(F.col("value").isNull(), F.lit(float("nan"))).otherwise(F.lit(1e6) / F.col("value"))
    return sk.json_safe(master(spark, sf).data.select("panel", WEEK, "series", zero.alias("inverse")))


@query("sink_draws", f"WITH {MASTER_SQL} SELECT panel AS run, count(DISTINCT series)*40 AS n FROM master WHERE role='spend' GROUP BY 1")
def _(spark, sf):
    written = sk.write_draws(params(spark, sf).withColumnRenamed("panel", "run"), scratch(spark, "draws"))
    return written.groupBy("run").agg(F.count(F.lit(1)).alias("n"))


# --- streams ---------------------------------------------------------------------------------

def order_stream(spark, sf):
    schema = table(spark, sf, "orders").schema
    return st.read_stream(spark, sf, schema, "orders.parquet")


@query("st_week_agg", """SELECT o_orderstatus AS panel, o_orderpriority AS series, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, sum(round(o_totalprice*100)) AS total, avg(round(o_totalprice*100)) AS mean, count(*) AS n FROM orders GROUP BY 1,2,3""")
def _(spark, sf):
    raw = order_stream(spark, sf).select(F.col("o_orderstatus").alias("panel"), F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("ts"), F.round(F.col("o_totalprice") * 100).alias("value"))
    written = st.run_available(st.weekly_sums(raw, ["panel"], "3650 days"), scratch(spark, "weeks"), "update")
    return st.latest_update(written, ["panel", "week_start", "series"], ["total", "mean", "n"])


@query("st_dedupe", "SELECT event_id, ts, user_id FROM events")
def _(spark, sf):
    path = scratch(spark, "replay")
    events = table(spark, sf, "events").select("event_id", "ts", "user_id")
    events.write.parquet(f"{path}/first")
    events.write.parquet(f"{path}/again")
    stream = st.read_stream(spark, f"{path}/*", events.schema, files_per_trigger=2)
    return st.run_available(st.dedupe(stream, ["event_id"]), scratch(spark, "dedupe"), "append").drop("batch")


@query("st_log_clean", f"WITH {LOG_SQL} SELECT event_id, session_id, level, event, detail AS message FROM log WHERE level<>'debug'")
def _(spark, sf):
    schema = table(spark, sf, "events").schema
    e = st.read_stream(spark, sf, schema, "events.parquet")
    t = F.col("event_type")
    level = F.when(t == "error", "error").when(t == "signup", "warn").when(t == "view", "debug").otherwise("info")
    raw = e.select("event_id", F.col("user_id").cast("string").alias("session_id"), level.alias("level"), t.alias("event"), F.col("props").alias("message"), F.lit(None).cast("string").alias("detail"))
    return st.run_available(st.clean_log(raw), scratch(spark, "log"), "append").select("event_id", "session_id", "level", "event", "message")


@query("st_stale_heartbeat", """WITH r AS (SELECT user_id||'-'||week(ts) AS run, max(ts) AS last_heartbeat, bool_or(event_type='purchase' AND value>20) AS ended FROM events GROUP BY 1)
 SELECT run, last_heartbeat, 'TIMEOUT' AS code FROM r WHERE NOT ended AND last_heartbeat + INTERVAL 10 MINUTE < (SELECT max(ts) - INTERVAL 1 MINUTE FROM events)""")
def _(spark, sf):
    e = st.read_stream(spark, sf, table(spark, sf, "events").schema, "events.parquet")
    state = F.when((F.col("event_type") == "purchase") & (F.col("value") > 20), "completed").otherwise("sampling")
    run = F.concat_ws("-", F.col("user_id").cast("string"), F.weekofyear("ts").cast("string"))
    beats = e.select(run.alias("run"), state.alias("state"), F.col("ts").alias("heartbeat_at"))
    return st.run_available(st.stale_heartbeats(beats), scratch(spark, "beats"), "append").drop("batch")


@query("st_run_state", """WITH c AS (SELECT o_custkey AS run, CASE o_orderstatus WHEN 'F' THEN 7 WHEN 'O' THEN 4 ELSE 0 END AS rank, CAST(o_orderkey%2 AS INTEGER) AS attempt, o_orderdate AS "at" FROM orders)
 SELECT run, attempt, CASE rank WHEN 7 THEN 'completed' WHEN 4 THEN 'sampling' ELSE 'queued' END AS state, "at" FROM c QUALIFY row_number() OVER (PARTITION BY run ORDER BY attempt DESC, rank DESC, CASE WHEN rank=7 THEN -epoch_us("at") ELSE epoch_us("at") END DESC)=1""")
def _(spark, sf):
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "sampling").otherwise("queued")
    changes = order_stream(spark, sf).select(F.col("o_custkey").alias("run"), (F.col("o_orderkey") % 2).cast("int").alias("attempt"), state.alias("state"), F.col("o_orderdate").alias("at"))
    written = st.run_available(changes, scratch(spark, "states"), "append", st.latest_states)
    return st.merge_states(written)


# --- streams fed batch by batch: each step adds files and starts the stream again from its checkpoint ----

def fed(spark, rows, batch, n, name, start):
    """Hand a table to a stream in ``n`` batches, by the number in ``batch``; ``start(folder, schema, out)`` runs what is there."""
    path, out = scratch(spark, name), scratch(spark, f"{name}-out")
    numbered = rows.withColumn("_batch", batch)
    for k in range(n):
        numbered.where(F.col("_batch") == k).drop("_batch").write.parquet(f"{path}/batch-{k}")
        start(f"{path}/*", rows.schema, out)
    return out


SPAN = "(epoch_us(ts)-epoch_us((SELECT min(ts) FROM events)))/(epoch_us((SELECT max(ts) FROM events))-epoch_us((SELECT min(ts) FROM events)))"


@query("st_heartbeat_timers", f"""WITH e AS (SELECT user_id||'-'||week(ts) AS run, ts, event_type='purchase' AND value>20 AS final, least(4, floor(5*{SPAN})) AS b FROM events),
 m AS (SELECT k, (SELECT max(ts) FROM e WHERE b<=k) - INTERVAL 1 MINUTE AS mark FROM range(0,5) r(k)),
 h AS (SELECT run, k, mark, max(ts) AS last_heartbeat, bool_or(final) AS ended FROM e JOIN m ON b<=k GROUP BY 1,2,3)
 SELECT run, arg_min(last_heartbeat, k) AS last_heartbeat, 'TIMEOUT' AS code FROM h WHERE NOT ended AND epoch_us(last_heartbeat)//1000+600000 <= epoch_us(mark)//1000 GROUP BY 1""")
def _(spark, sf):
    """Timeouts of attempts over five batches in order of time."""
    e = table(spark, sf, "events")
    state = F.when((F.col("event_type") == "purchase") & (F.col("value") > 20), "completed").otherwise("sampling")
    run = F.concat_ws("-", F.col("user_id").cast("string"), F.weekofyear("ts").cast("string"))
    beats = e.select(run.alias("run"), state.alias("state"), F.col("ts").alias("heartbeat_at"))
    at = F.unix_micros(F.col("heartbeat_at").cast("timestamp"))
    lo, hi = beats.agg(F.min(at), F.max(at)).first()
    part = F.least(F.lit(4), F.floor(5 * ((at - F.lit(lo)) / F.lit(hi - lo)))).cast("int")

    def start(folder, schema, out):
        sful.run_batches(lambda: sful.heartbeat_timeouts(st.read_stream(spark, folder, schema)), out, "append")

    return spark.read.parquet(f"{fed(spark, beats, part, 5, 'beats', start)}/data").drop("batch")


@query("st_states_held", """WITH c AS (SELECT o_custkey AS run, CASE o_orderstatus WHEN 'F' THEN 7 WHEN 'O' THEN 4 ELSE 0 END AS rank, CAST(o_orderkey%2 AS INTEGER) AS attempt, o_orderdate AS "at" FROM orders)
 SELECT run, attempt, CASE rank WHEN 7 THEN 'completed' WHEN 4 THEN 'sampling' ELSE 'queued' END AS state, "at" FROM c QUALIFY row_number() OVER (PARTITION BY run ORDER BY attempt DESC, rank DESC, CASE WHEN rank=7 THEN -epoch_us("at") ELSE epoch_us("at") END DESC)=1""")
def _(spark, sf):
    """Run states held by the stream after four batches in no order, the first of them known before it starts."""
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "sampling").otherwise("queued")
    changes = table(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("run"), (F.col("o_orderkey") % 2).cast("int").alias("attempt"),
                                                state.alias("state"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderkey").alias("key"))
    part = F.pmod(F.xxhash64("key"), F.lit(5)).cast("int") - 1
    known = changes.where(part < 0)

    def start(folder, schema, out):
        sful.run_batches(lambda: sful.run_states(st.read_stream(spark, folder, schema), known), out, "append")

    return sful.held_states(spark, fed(spark, changes, part, 4, "changes", start)).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("st_week_late", """WITH o AS (SELECT o_orderstatus AS panel, o_orderpriority AS series, o_orderdate AS ts, round(o_totalprice*100) AS value, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start,
   CASE WHEN o_orderkey%3=0 AND o_orderdate<TIMESTAMP '1997-06-01' THEN 0 WHEN o_orderkey%3=1 AND o_orderdate<TIMESTAMP '1999-06-01' THEN 1 ELSE 2 END AS b FROM orders),
 m AS (SELECT r.b, max(ts) - INTERVAL 35 DAY AS mark FROM range(1,3) r(b) JOIN o ON o.b<r.b GROUP BY 1),
 l AS (SELECT o.*, coalesce(week_start + INTERVAL 7 DAY<=mark, false) AS late FROM o LEFT JOIN m ON o.b=m.b)
 SELECT panel, week_start, series, sum(value) AS total, avg(value) AS mean, count(*) AS n, count(*) FILTER (late) AS n_late FROM l GROUP BY 1,2,3""")
def _(spark, sf):
    """Weekly sums over three batches, the rows that came too late added again, and how many these were."""
    day, key = F.col("o_orderdate"), F.col("o_orderkey") % 3
    part = (F.when((key == 0) & (day < F.to_timestamp_ntz(F.lit("1997-06-01"))), 0).when((key == 1) & (day < F.to_timestamp_ntz(F.lit("1999-06-01"))), 1).otherwise(2))
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("panel"), F.col("o_orderpriority").alias("series"), F.col("o_orderdate").alias("ts"),
                                             F.round(F.col("o_totalprice") * 100).alias("value"), part.alias("part"))

    def start(folder, schema, out):
        sful.week_batches(lambda: st.read_stream(spark, folder, schema), out, ["panel"])

    out = fed(spark, rows, F.col("part"), 3, "orders", start)
    late = sful.late_rows(spark, out).groupBy("panel", "week_start", "series").agg(F.count(F.lit(1)).alias("n_late"))
    sums = sful.week_sums(spark, out, ["panel"], with_late=True)
    return sums.join(late, ["panel", "week_start", "series"], "left").withColumn("n_late", F.coalesce("n_late", F.lit(0)))


@query("st_quality")
def _(spark, sf):
    def rules(batch):
        weekly = batch.groupBy("panel", WEEK, "series", "role").agg(F.sum("value").alias("value"))
        return ql.over_parameterised(weekly, KEYS).select("panel", "code", "severity").unionByName(ql.degenerate_columns(weekly, KEYS).select("panel", "code", "severity"))

    raw = order_stream(spark, sf).select(
        F.col("o_orderstatus").alias("panel"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias(WEEK), F.col("o_orderpriority").alias("series"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "kpi").otherwise("spend").alias("role"), F.col("o_totalprice").alias("value"))
    return st.run_available(raw, scratch(spark, "quality"), "append", rules).drop("batch")
