"""Operators over lifecycle tables of many projects: views, gates, staleness, retries, logs.

A project may hold a third of all rows: what is kept per project is either an aggregate or the
first few rows in an order, which Spark limits inside each task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import fixed_values as fx
from tidemark.frames import previous_in_order, running_total


def latest_runs(runs: DataFrame, results: DataFrame, verdicts: DataFrame, keep: int | None = None) -> DataFrame:
    """All runs per project, or the ``keep`` newest, numbered from the newest, with their result and verdict, if any."""
    w = Window.partitionBy("project").orderBy(F.desc("created_at"), F.desc("run"))
    top = runs.withColumn("run_no", F.row_number().over(w))
    top = top if keep is None else top.where(F.col("run_no") <= keep)
    return top.join(results, "run", "left").join(verdicts, "run", "left")


def newest(df: DataFrame, order: list[str], columns: list[str], prefix: str) -> DataFrame:
    """The newest row per project, as an aggregate."""
    best = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy("project").agg(best.alias("_b")).select(
        "project", *[F.col(f"_b.{c}").alias(f"{prefix}{c}") for c in columns])


def project_heads(datasets: DataFrame, inspections: DataFrame) -> DataFrame:
    """Newest dataset, approved dataset and newest inspection of every project."""
    order = ["created_at", "dataset"]
    last = newest(datasets, order, ["dataset", "status"], "newest_")
    approved = newest(datasets.where(F.col("approved_at").isNotNull()), order, ["dataset"], "approved_")
    seen = newest(inspections, ["created_at", "inspection"], ["inspection"], "newest_")
    return last.join(approved, "project", "left").join(seen, "project", "full")


def progress(projects: DataFrame, sources: DataFrame, datasets: DataFrame, runs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Where every project stands: first source, datasets, newest run, steps decided."""
    first = sources.groupBy("project").agg(F.min("created_at").alias("first_source_at"))
    last = newest(datasets, ["created_at", "dataset"], ["status"], "dataset_")
    approved = datasets.where(F.col("approved_at").isNotNull()).groupBy("project").agg(F.max("approved_at").alias("approved_at"))
    run = newest(runs, ["created_at", "run"], ["state"], "run_")
    n = runs.groupBy("project").agg(F.count(F.lit(1)).alias("n_runs"))
    steps = ledger.groupBy("project").agg(F.count_distinct("step").alias("n_steps"))
    out = projects.select("project")
    for part in (first, last, approved, run, n, steps):
        out = out.join(part, "project", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_runs", "n_steps")})


def latest_decisions(ledger: DataFrame) -> DataFrame:
    """Last decision per (project, step); the later of fact and confirmation counts."""
    return ledger.groupBy("project", "step").agg(F.max("decided_at").alias("decided_at"))


def flow_state(decisions: DataFrame) -> DataFrame:
    """Status of the eight steps per project: done, stale (with the cause), active or todo.

    A step is stale when the step it rests on was decided later or is stale itself. The steps
    form one short fixed order, so a project becomes one row and the order is folded in columns.
    """
    names = [s for s, _ in fx.FLOW_STEPS]
    wide = decisions.groupBy("project").agg(
        *[F.max(F.when(F.col("step") == s, F.col("decided_at"))).alias(f"at_{s}") for s in names])
    stale: dict[str, Column] = {}
    for step, dep in fx.FLOW_STEPS:
        mine = F.col(f"at_{step}")
        later = F.lit(False) if dep is None else (stale[dep] | F.coalesce(F.col(f"at_{dep}") > mine, F.lit(False)))
        stale[step] = F.coalesce(mine.isNotNull() & later, F.lit(False))
    wide = wide.withColumns({f"stale_{s}": c for s, c in stale.items()})
    open_steps = F.array_compact(F.array(*[
        F.when(F.col(f"at_{s}").isNull() | F.col(f"stale_{s}"), F.lit(s)) for s in names]))
    active = F.coalesce(F.get(open_steps, F.lit(0)), F.lit(names[-1]))
    wide = wide.withColumn("active_step", active)
    rows = [F.struct(F.lit(i + 1).alias("step_no"), F.lit(s).alias("step"),
                     F.when(F.col("active_step") == s, "active").when(F.col(f"stale_{s}"), "stale")
                     .when(F.col(f"at_{s}").isNotNull(), "done").otherwise("todo").alias("status"),
                     F.when(F.col(f"stale_{s}"), F.lit(dep)).alias("stale_because_of"))
            for i, (s, dep) in enumerate(fx.FLOW_STEPS)]
    return wide.select("project", "active_step", F.inline(F.array(*rows)))


def next_version(versions: DataFrame) -> DataFrame:
    return versions.groupBy("project").agg((F.coalesce(F.max("version_no"), F.lit(0)) + 1).alias("next_version_no"))


def number_versions(versions: DataFrame, order: str) -> DataFrame:
    """1, 2, 3, ... per project in ``order``, for projects of any size."""
    return running_total(versions, ["project"], order, F.lit(1), "version_no")


def approved_versions(datasets: DataFrame) -> DataFrame:
    """The one approved version per project; only ready and usable ones count."""
    ok = datasets.where((F.col("status") == "ready") & (F.col("verdict") != "not_usable") & F.col("approved_at").isNotNull())
    best = F.max_by(F.struct("dataset", "approved_at"), F.struct("approved_at", "dataset"))
    return ok.groupBy("project").agg(best.alias("_b")).select("project", "_b.*")


def publish_gate(requests: DataFrame, results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each publish request with its refusal reason, if any. ``requests``: (project, run, requested_at)."""
    own = results.select("run", F.col("project").alias("_owner"))
    j = requests.join(own, "run", "left").join(verdicts.select("run", "level"), "run", "left")
    reason = (F.when(F.col("_owner").isNull() | (F.col("_owner") != F.col("project")), "result_not_of_project")
              .when(F.col("level").isNull(), "not_judged")
              .when(~F.col("level").isin(*fx.PUBLISHABLE), "below_threshold"))
    return j.withColumn("refused", reason).drop("_owner")


def published(gated: DataFrame) -> DataFrame:
    """The accepted request made last wins its project."""
    best = F.max_by("run", F.struct("requested_at", "run"))
    return gated.where(F.col("refused").isNull()).groupBy("project").agg(best.alias("run"))


def visible_results(results: DataFrame, projects: DataFrame, access: DataFrame) -> DataFrame:
    """Published results of published projects that somebody has access to."""
    open_projects = projects.where(F.col("status") == "published").select("project")
    return (results.where("is_published").join(open_projects, "project", "left_semi")
            .join(access.select("project"), "project", "left_semi"))


def foreign_sources(recipes: DataFrame, files: DataFrame) -> DataFrame:
    """Recipe references to files the project does not own."""
    return recipes.join(files, ["project", "source"], "left_anti")


def run_keys(requests: DataFrame, parts: list[str]) -> DataFrame:
    """Idempotency key: sha-256 of spec, data, sample and seed."""
    return requests.withColumn("run_key", F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]), 256))


def new_runs(keyed: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Requests that need a run: the first per key, unless the key already ran."""
    first = keyed.groupBy("run_key").agg(F.min_by("request", order).alias("request"))
    return first.join(existing.select("run_key"), "run_key", "left_anti")


def capacity(jobs: DataFrame, now: Column, minutes: int, limit: int, states: tuple = fx.LIVE_STATES) -> DataFrame:
    """Live jobs per project newer than the cutoff, and whether one more may start."""
    recent = F.col("state").isin(*states) & (F.col("created_at") >= now - F.make_interval(mins=F.lit(minutes)))
    return jobs.groupBy("project").agg(F.count_if(recent).alias("in_flight")).withColumn(
        "has_capacity", F.col("in_flight") < limit)


def error_class(kind: Column, text: Column) -> Column:
    """Closed failure code from the kind of failure and its text."""
    full = F.lower(F.concat_ws(": ", kind, text))
    words = "|".join(fx.STORAGE_WORDS)
    return (F.when(kind == "RunCancelled", "CANCELLED").when(kind == "SpecError", "CONFIG_INVALID")
            .when(kind == "MemoryError", "OOM").when(kind == "TimeoutError", "TIMEOUT")
            .when(full.rlike(words), "STORAGE_UNAVAILABLE").otherwise("INTERNAL"))


def is_retryable(code: Column) -> Column:
    return code.isin(*fx.RETRYABLE)


def after_failure(code: Column, attempt: Column, max_attempts: Column) -> Column:
    """State after a failure: queued again while attempts are left and the cause may pass."""
    return (F.when(is_retryable(code) & (attempt < max_attempts), "queued")
            .when(code == "CANCELLED", "cancelled").otherwise("failed"))


def log_tail(log: DataFrame, n: int) -> DataFrame:
    """The newest events with the number of problems among them."""
    tail = log.orderBy(F.desc("at"), F.desc("event_id")).limit(n)
    # at most n rows reach this window
    return tail.withColumn("n_problems", F.sum((F.col("level") != "info").cast("bigint")).over(Window.partitionBy(F.lit(1))))


def log_sessions(log: DataFrame) -> DataFrame:
    return log.groupBy("session_id").agg(F.max("at").alias("last_at"), F.count(F.lit(1)).alias("n_events"),
                                         F.count_if(F.col("level") != "info").alias("n_problems"))


def log_rows(log: DataFrame, session: str | None = None, only_problems: bool = False) -> DataFrame:
    test = F.lit(True) if session is None else F.col("session_id") == session
    return log.where(test & ((F.col("level") != "info") if only_problems else F.lit(True)))


def session_timeline(log: DataFrame) -> DataFrame:
    """Events of a session in action order with the seconds since the one before.

    A session may be as long as the log, so the order is cut into ranges.
    """
    out = previous_in_order(log, ["session_id"], "at", "at", "previous_at")
    
    def micros(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp"))

    gap = micros("at") - micros("previous_at")
    return out.withColumn("gap_seconds", gap / 1_000_000)


def orphan_versions(datasets: DataFrame, runs: DataFrame) -> DataFrame:
    return datasets.join(runs.select("dataset"), "dataset", "left_anti")
