"""The registered queries: twins cover them, the flagship runs, streams equal batches."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, rows
from testkit import SF

SOME = ["as_geometric", "cast_locale_number", "profile_missing_runs", "profile_stats", "dr_channel_result", "pl_allocate",
        "lc_staleness", "st_week_agg", "st_dedupe", "st_stale_heartbeat", "st_run_state", "id_groups", "text_number_check"]


def test_twins_name_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 200


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", SOME)
def test_query_equals_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(cols, cur.fetchall())


def test_no_plan_crosses_or_loops(spark):
    """Plans must not hold a cartesian product; nested-loop joins only where one side is one row."""
    for name in ("as_geometric", "pl_scenario", "text_number_check", "asof_year_ago", "pl_curve_read", "profile_stats"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
