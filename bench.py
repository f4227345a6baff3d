"""Headline queries, timed one by one with nothing cached or built before. Prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the number of cores.
"""

import json
import os
import sys
import time

from tidemark.plans import catalog, inputs
from tidemark.session import local_session

HEADLINE = (
    "agg_week", "master_build", "as_geometric", "drop_identical_rows", "cast_locale_number", "profile_stats",
    "profile_missing_runs", "q_outlier_local", "q_vif", "text_number_check", "role_validate", "ms_channel_stats",
    "fit_grid", "fit_bootstrap_draws", "dr_attr_additive", "dr_channel_result", "dr_coverage", "id_verdict", "vd_level",
    "pl_response_curve", "pl_allocate", "pl_allocate_exact", "pl_frontier", "pl_scenario", "rp_actions", "asof_year_ago",
    "lc_progress", "lc_staleness", "lc_log_session", "st_week_agg",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    queries = catalog.queries()
    spark.read.parquet(f"{sf}/nation.parquet").count()  # start the engine before the clock
    times = {}
    for name in names:
        spark.catalog.clearCache()
        inputs.forget()
        t = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
