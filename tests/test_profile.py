import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import lifecycle as lc, profile as pf, roles as rl
from tidemark.sources import event_log as el, readers as rd, sinks as sk
from testkit import monday

S = ["series"]


def test_missing_runs(spark):
    v = [100.0, None, None, 120.0, None, 90.0]
    df = spark.createDataFrame([("a", i, monday(i, dt.date(2025, 1, 6)), x) for i, x in enumerate(v)], "series string, at int, day date, value double")
    runs = pf.kept_runs(pf.missing_runs(df, S, "at", label="day"), S, 24)
    assert sorted((r["start"], r["length"], str(r["start_label"])) for r in runs.collect()) == [(1, 2, "2025-01-13"), (4, 1, "2025-02-03")]
    assert pf.longest_gap(runs, S).first()["longest_missing_run"] == 2


def test_histogram_and_stats(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(13)] + [("c", 5.0)] * 3 + [("a", None)], "series string, value double")
    h = {(r["series"], r["bin"]): r["n"] for r in pf.histogram(df, S).collect()}
    assert h[("a", 11)] == 2 and h[("a", 0)] == 1 and h[("c", 0)] == 3 and len(h) == 13
    s = {r["series"]: r for r in pf.column_stats(df, S).collect()}
    assert (s["a"]["n"], s["a"]["n_missing"], s["a"]["p50"], s["a"]["p25"]) == (13, 1, 6.0, 3.0)


def role_case(spark, role, values, name="x"):
    df = spark.createDataFrame([("s", name, i, None if v is None else str(v)) for i, v in enumerate(values)], "source string, column string, at int, raw string")
    roles = spark.createDataFrame([("s", name, role)], "source string, column string, role string")
    keys = ["source", "column"]
    return {r["code"] for r in rl.validate_roles(roles, rl.column_facts(df, keys, "at"), keys).collect()}


def test_role_rules(spark):
    wavy = [3, 9, 2, 8, 4, 7, 1, 6]
    assert role_case(spark, "spend", wavy) == set()
    assert role_case(spark, "spend", [1, -2, 3, 2, 5, 1]) == {"negative_spend"}
    assert role_case(spark, "spend", [0] * 6) == {"all_zero_channel"}
    assert role_case(spark, "spend", [0, 1, 0, 1, 1]) == {"binary_column_as_spend"}
    assert role_case(spark, "spend", wavy, "email_sends") == {"spend_column_may_be_volume"}
    assert role_case(spark, "spend", range(100, 120)) == {"looks_like_identifier"}
    assert role_case(spark, "kpi", [1, 2, 1, 2, 1]) == {"kpi_barely_varies"}
    assert role_case(spark, "kpi", [-1, -5, -3, -9, -4, -2]) == {"kpi_not_positive", "kpi_has_negatives"}
    assert role_case(spark, "kpi", [5, -1, 8, 2, 9, 4]) == {"kpi_has_negatives"}
    assert role_case(spark, "control", [4, 4, 4]) == {"constant_control"}
    assert role_case(spark, "control", ["a", "b", "1"]) == {"not_numeric"}
    assert role_case(spark, "date", ["x", "y"]) == {"date_does_not_parse"}
    assert role_case(spark, "date", ["2024-01-01", "2024-01-08"]) == set()
    assert role_case(spark, "ignore", ["x"]) == set()


def test_source_check(spark):
    rows = [(1, None, "2024-01-01", "2025-01-01", 5), (2, "d", "2024-01-01", "2024-03-01", 5), (3, "d", "2024-01-01", "2024-09-01", 5), (4, "d", "2024-01-01", "2025-06-01", 5), (5, "d", "2024-01-01", "2025-06-01", 1)]
    df = spark.createDataFrame(rows, "id int, date_column string, a string, b string, n_numeric int").select(
        "id", "date_column", F.to_date("a").alias("first_day"), F.to_date("b").alias("last_day"), "n_numeric")
    v = {r["id"]: r["verdict"] for r in pf.source_check(df).collect()}
    assert v == {1: "not_usable", 2: "not_usable", 3: "usable_with_warnings", 4: "usable", 5: "not_usable"}


def test_staleness_is_transitive(spark):
    d = [("p", "goal", "2024-01-01"), ("p", "data", "2024-01-02"), ("p", "columns", "2024-01-09"), ("p", "prepare", "2024-01-04"), ("p", "beliefs", "2024-01-12")]
    df = spark.createDataFrame(d, "project string, step string, d string").select("project", "step", F.to_timestamp("d").alias("decided_at"))
    r = {x["step"]: (x["status"], x["stale_because_of"]) for x in lc.flow_state(df).collect()}
    assert r["columns"] == ("done", None) and r["prepare"] == ("active", "columns") and r["beliefs"] == ("stale", "prepare") and r["launch"] == ("todo", None)


def test_event_log_clips(spark):
    long = "x" * 2500
    df = spark.createDataFrame([("s" * 80, "info", "e" * 200, long, None, 1), ("s", "loud", "e", "m", None, 2)], "session_id string, level string, event string, message string, detail string, id int")
    r = el.clean_events(df, clip=True).collect()
    assert len(r) == 1 and len(r[0]["session_id"]) == 64 and len(r[0]["event"]) == 120 and r[0]["message"] == "x" * 2000 + "… [afgekapt, 2500 tekens]"


def test_delimiter_and_fallback(spark, tmp_path):
    (tmp_path / "a.csv").write_text("week;spend\n2024-01-01;1,5\n")
    df = rd.read_delimited(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["week", "spend", "_corrupt"] and df.first()["spend"] == "1,5"
    assert rd.read_delimited(spark, str(tmp_path / "a.csv"), ",").columns == ["week", "spend", "_corrupt"]


def test_ragged_rows_are_kept_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n3,4,5,6\n7\n")
    got = {r["a"]: (r["b"], r["_corrupt"]) for r in rd.read_delimited(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {"1": ("2", None), "3": ("4", "3,4,5,6"), "7": (None, "7")}


def test_intake(spark, tmp_path):
    for name, text in (("a.csv", "x"), ("b.csv", "x"), ("c.txt", "y"), ("d.csv", "z")):
        (tmp_path / name).write_text(text)
    r = {x["path"].rsplit("/", 1)[1]: x["refused"] for x in rd.intake(spark, str(tmp_path)).collect()}
    assert sorted(x for x in (r["a.csv"], r["b.csv"]) if x) == ["duplicate_upload"] and r["c.txt"] == "wrong_type" and r["d.csv"] is None


def test_upload_rules(spark):
    rows = [("p", "a.csv", 1, 10, "csv", "h"), ("p", "b.csv", 2, 10, "csv", "h"), ("q", "c.csv", 3, 10, "csv", "h"),
            ("p", "d.csv", 4, 0, "csv", None), ("p", "e.csv", 5, 60 * 2 ** 20, "csv", None)]
    df = spark.createDataFrame(rows, "project string, path string, created_at int, length bigint, extension string, sha256 string")
    r = {x["path"]: x["refused"] for x in rd.judge_uploads(df, 50 * 1024 * 1024).collect()}
    assert r == {"a.csv": None, "b.csv": "duplicate_upload", "c.csv": None, "d.csv": "empty", "e.csv": "too_large"}


def test_master_sink_round_trip(weekly, tmp_path):
    m = weekly(kpi=("kpi", range(5)), tv=("spend", range(5)))
    man = {r["panel"]: r for r in sk.write_master(m, ["panel"], str(tmp_path / "m")).collect()}
    want = {r["panel"]: r["content_hash"] for r in sk.content_hash(m.orderBy(F.rand()), ["panel"]).collect()}
    assert {k: v["content_hash"] for k, v in man.items()} == want and man["p1"]["n_weeks"] == 5


def test_histogram_shuffles_no_cells(spark):
    """A shuffle by column would read all cells of a column in one task."""
    cells = spark.range(1000).selectExpr("'c' || id % 2 AS column", "CAST(id AS DOUBLE) AS value")
    out = pf.histogram(cells, ["column"])
    assert out.agg({"n": "sum"}).first()[0] == 1000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
