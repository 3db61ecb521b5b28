"""Ranking, summary and drill-down tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope import model as M
from emberscope.functions import bands
from emberscope.functions.plan_text import line_tokens, plan_lines, token_kind
from emberscope.functions.texts import (
    bytes_or_dash,
    bytes_text,
    count_text,
    cpu_millis,
    cpu_ratio,
    duration_text,
    fill,
    fixed,
    lit,
    one_line,
    percent,
    printable,
    shorten,
    stage_label,
    whole_div,
)
from emberscope.functions.times import clock_text, elapsed_ms
from emberscope.operators.keys import attach_totals, salted_lookup, top_rows
from emberscope.operators.linking import job_sql
from emberscope.operators.quantiles import exact_quantiles, value_counts
from emberscope.operators.ranking import with_rank
from emberscope.operators.task_rules import distributions, executor_shares, executor_totals, slowest_tasks

# Fixed values
DURATION_PROBS = {"min": 0.0, "median": 0.5, "p90": 0.9, "p99": 0.99, "max": 1.0}
HISTOGRAM_BUCKETS = 10
HISTOGRAM_BAR = 40
NO_DESCRIPTION, NO_PLAN = "(no description)", "(empty plan)"
RUNNING, ACTIVE, CRITICAL_MARK = "running", "active", " CP"
ISSUE = "{} in stage {}"
JOBS_LINE, BUSY_JOBS_LINE = "Jobs: {}", "Jobs: {} ({} running, {} failed)"
IO_LINE = "I/O: in {} out {} shuffle {}"
HEALTH_LINE, HEALTHY_LINE = "Health: {} CRIT {} WARN", "Health: OK"
TOP_LINE, NO_ISSUES_LINE = "Top: {}", "No critical issues detected"
STAGE_LINE, STAGE_TAG = "Stage {}: {}", "[Stage {}]"
SQL_LINE = "#{} — {}"
SAVINGS_LINE = "~{} potential savings"
HEADER_IO = {"in: {} ({})": "input", "out: {} ({})": "output", "shuf_r: {} ({})": "shuffle_read", "shuf_w: {} ({})": "shuffle_write"}
HEADER_SPILL = "spill: {} (RAM: {})"
HEADER_CPU = "cpu: {} / runtime: {}"
HEADER_FAILURES = "{} failed, {} killed out of {} tasks"

WALL_MS = elapsed_ms("submission_time", "completion_time")


# ---------------------------------------------------------------------------
# Cluster resources
# ---------------------------------------------------------------------------
def cluster_resources(
    executors: DataFrame, by: Sequence[str] = (), every: DataFrame | None = None
) -> DataFrame:
    """Memory, cores and number of active executors, the driver left out.

    ``every`` names the keys that must appear; those without executors get zeros.
    """
    worker = (F.col("id") != "driver") & F.col("is_active")
    zero = F.lit(0).cast("bigint")
    found = executors.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(worker, F.col("max_memory"))), zero).alias("total_executor_memory"),
        F.coalesce(F.sum(F.when(worker, F.col("total_cores"))), zero).alias("total_executor_cores"),
        F.count_if(worker).alias("num_executors"),
    )
    if not by or every is None:
        return found
    names = ("total_executor_memory", "total_executor_cores", "num_executors")
    return every.select(*by).distinct().join(found, list(by), "left").na.fill(0, list(names))


# ---------------------------------------------------------------------------
# Ranking
# ---------------------------------------------------------------------------
def suspect_order() -> list[Column]:
    """Critical first, then by savings; category, stage and title settle ties."""
    return [
        (F.col("severity") == M.CRIT).desc(),
        F.col("estimated_savings_ms").desc(),
        F.col("category"),
        F.col("stage_id"),
        F.col("title"),
    ]


def rank_suspects(suspects: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return with_rank(suspects, suspect_order(), by)


def sort_suspects(suspects: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return suspects.orderBy(*by, *suspect_order())


def job_rows(
    jobs: DataFrame, sql_jobs: DataFrame, sql_executions: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Jobs with duration and SQL link, unsorted."""
    return job_sql(jobs, sql_jobs, sql_executions, by).select(
        *by, "job_id", "name", "status", F.expr(WALL_MS).alias("duration_ms"),
        "num_tasks", "num_failed_tasks", "sql_id", "sql_description", "submission_time", "sql_plan",
    )


def job_order() -> list[Column]:
    """Longest first, unfinished jobs last."""
    return [F.col("duration_ms").desc_nulls_last(), F.col("job_id")]


def rank_jobs(
    jobs: DataFrame, sql_jobs: DataFrame, sql_executions: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    return with_rank(job_rows(jobs, sql_jobs, sql_executions, by), job_order(), by)


def critical_stages(
    stages: DataFrame, job_stages: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Stage ids that are the longest of some job; the larger id wins a tie."""
    timed = stages.selectExpr(*by, "stage_id", f"{WALL_MS} AS ms").where("ms IS NOT NULL")
    per_job = (
        job_stages.join(timed, [*by, "stage_id"])
        .groupBy(*by, "job_id")
        .agg(F.max_by("stage_id", F.struct("ms", "stage_id")).alias("stage_id"))
    )
    return per_job.select(*by, "stage_id").distinct()


def _flag(df: DataFrame, critical: DataFrame, by: Sequence[str]) -> DataFrame:
    marked = critical.withColumn("critical", F.lit(True))
    return df.join(marked, [*by, "stage_id"], "left").withColumn(
        "critical", F.coalesce("critical", F.lit(False))
    )


# ---------------------------------------------------------------------------
# Health
# ---------------------------------------------------------------------------
def health_summary(
    jobs: DataFrame, stages: DataFrame, suspects: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Job counts, byte totals, findings by severity and the first three critical ones.

    Each table contributes rows of counters and one grouping adds them up, so a key that
    appears in any of the tables gets its row, and no join is needed.
    """
    critical, warning = F.col("severity") == M.CRIT, F.col("severity") == M.WARN
    issue = F.expr(fill(ISSUE, "category", "stage_id"))
    first = top_rows(suspects.where(critical), by, suspect_order(), 3)

    def counter(condition: Column) -> Column:
        return condition.cast("bigint")

    parts = [
        jobs.select(
            *by,
            F.lit(1).cast("bigint").alias("total_jobs"),
            counter(F.col("status") == M.JOB_RUNNING).alias("running_jobs"),
            counter(F.col("status") == M.JOB_FAILED).alias("failed_jobs"),
        ),
        stages.select(
            *by,
            F.col("input_bytes").alias("total_input_bytes"),
            F.col("output_bytes").alias("total_output_bytes"),
            (F.col("shuffle_read_bytes") + F.col("shuffle_write_bytes")).alias("total_shuffle_bytes"),
        ),
        suspects.select(
            *by, counter(critical).alias("critical_count"), counter(warning).alias("warning_count")
        ),
        first.select(
            *by, *[F.when(F.col("row_no") == i, issue).alias(f"top_issue_{i}") for i in (1, 2, 3)]
        ),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    sums = (
        "total_jobs", "running_jobs", "failed_jobs", "total_input_bytes", "total_output_bytes",
        "total_shuffle_bytes", "critical_count", "warning_count",
    )
    return rows.groupBy(*by).agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums],
        *[F.max(f"top_issue_{i}").alias(f"top_issue_{i}") for i in (1, 2, 3)],
    )


def health_lines(health: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The two summary lines and the overall state."""
    busy = fill(BUSY_JOBS_LINE, "total_jobs", "running_jobs", "failed_jobs")
    jobs = f"if(running_jobs > 0 OR failed_jobs > 0, {busy}, {fill(JOBS_LINE, 'total_jobs')})"
    io = fill(
        IO_LINE, bytes_text("total_input_bytes"),
        bytes_text("total_output_bytes"), bytes_text("total_shuffle_bytes"),
    )
    counts = fill(HEALTH_LINE, "critical_count", "warning_count")
    found = f"if(critical_count > 0 OR warning_count > 0, {counts}, {lit(HEALTHY_LINE)})"
    issues = "concat_ws(', ', top_issue_1, top_issue_2, top_issue_3)"
    return health.selectExpr(
        *by,
        f"concat_ws(' | ', {jobs}, {io}, {found}) AS summary",
        f"if({issues} <> '', {fill(TOP_LINE, issues)}, {lit(NO_ISSUES_LINE)}) AS issues",
        "CASE WHEN critical_count > 0 THEN 'critical' WHEN warning_count > 0 THEN 'warning' ELSE 'ok' END"
        " AS state",
    )


# ---------------------------------------------------------------------------
# Job and finding views
# ---------------------------------------------------------------------------
SQL_REFERENCE = "coalesce(concat('#', sql_id), '-')"


def jobs_report(jobs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``job_rows`` as texts."""
    return jobs.selectExpr(
        *by, "job_id", "status",
        f"{clock_text('submission_time')} AS started",
        f"coalesce({duration_text('duration_ms')}, '{RUNNING}') AS duration",
        "num_tasks", "num_failed_tasks",
        f"{SQL_REFERENCE} AS sql",
        f"{shorten('name', 50)} AS name",
    )


def job_detail(
    jobs: DataFrame,
    stages: DataFrame,
    job_stages: DataFrame,
    critical: DataFrame,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per stage of each job, with the job's SQL and the critical mark."""
    description = one_line(f"coalesce(sql_description, {lit(NO_DESCRIPTION)})")
    heads = (
        jobs.withColumn("lines", F.expr(plan_lines("sql_plan")))
        .withColumns(
            {
                "line_1": F.expr(f"if(sql_plan = '', {lit(NO_PLAN)}, lines[0])"),
                "line_2": F.expr(r"nullif(regexp_replace(get(lines, 1), r'(?U)^\s+', ''), '')"),
                "sql_line": F.expr(f"if(sql_id IS NULL, NULL, {description})"),
            }
        )
        .selectExpr(
            *by, "job_id", "sql_id",
            f"{shorten('sql_line', 70)} AS sql_text",
            f"{shorten('line_1', 80)} AS plan_line_1",
            f"{shorten('line_2', 74)} AS plan_line_2",
        )
    )
    rows = job_stages.join(stages, [*by, "stage_id"]).join(heads, [*by, "job_id"])
    flagged = _flag(rows, critical, by).withColumn("label", F.expr(stage_label("name")))
    return flagged.selectExpr(
        *by, "job_id", "stage_id", "attempt_id", "status",
        f"if(critical, concat({shorten('label', 27)}, '{CRITICAL_MARK}'), {shorten('label', 30)}) AS name",
        f"coalesce({duration_text(WALL_MS)}, '{ACTIVE}') AS duration",
        "num_tasks",
        f"{bytes_or_dash('input_bytes')} AS input",
        f"{bytes_or_dash('output_bytes')} AS output",
        f"{bytes_or_dash('shuffle_read_bytes')} AS shuffle_read",
        f"{bytes_or_dash('shuffle_write_bytes')} AS shuffle_write",
        f"{bytes_or_dash('disk_bytes_spilled')} AS spill",
        "critical", "sql_id", "sql_text", "plan_line_1", "plan_line_2",
    )


def suspect_detail(
    suspects: DataFrame, jobs: DataFrame, critical: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Findings as texts, joined to the job they lead to."""
    heads = jobs.selectExpr(*by, "job_id", "name AS job_name", "status AS job_status")
    label = fill(STAGE_LINE, "stage_id", stage_label("stage_name"))
    sql = fill(SQL_LINE, "sql_id", shorten(f"coalesce(sql_description, {lit(NO_DESCRIPTION)})", 70))
    savings = fill(SAVINGS_LINE, duration_text("estimated_savings_ms"))
    return _flag(suspects.join(heads, [*by, "job_id"], "left"), critical, by).selectExpr(
        *by, "severity", "category", "coalesce(bottleneck, '-') AS pattern",
        "stage_id", "job_id", "job_name", "job_status", f"{SQL_REFERENCE} AS sql",
        f"{shorten('title', 50)} AS title",
        f"coalesce({label}, {fill('Stage {}', 'stage_id')}) AS stage",
        f"{sql} AS sql_text",
        f"{shorten('sql_plan_hint', 80)} AS operators",
        f"{shorten('detail', 80)} AS detail",
        "io_summary",
        f"if(estimated_savings_ms > 0, {savings}, NULL) AS savings",
        "recommendation", "critical",
    )


def sql_recommendations(suspects: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Findings per SQL execution with their advice."""
    return suspects.where("sql_id IS NOT NULL").selectExpr(
        *by, "sql_id", "severity", f"{fill(STAGE_TAG, 'stage_id')} AS stage",
        "category", "stage_id", "title", "detail", "recommendation",
    )


# ---------------------------------------------------------------------------
# Stage views
# ---------------------------------------------------------------------------
def _with_cluster(rows: DataFrame, cluster: DataFrame | None, by: Sequence[str]) -> DataFrame:
    if cluster is None:
        return rows.withColumn("cluster_memory", F.lit(0).cast("bigint"))
    total = cluster.selectExpr(*by, "total_executor_memory AS cluster_memory")
    return attach_totals(rows, total, by).na.fill(0, ["cluster_memory"])


def stage_headers(
    stages: DataFrame, tasks: DataFrame, hints: DataFrame | None = None,
    cluster: DataFrame | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Wall time, I/O, CPU share, peak memory with its source and failures of each stage."""
    peaks = tasks.groupBy(*by, "stage_id").agg(F.max("peak_execution_memory").alias("task_peak"))
    rows = stages.join(peaks, [*by, "stage_id"], "left")
    if hints is None:
        rows = rows.withColumn("sql_plan_hint", F.lit(None).cast("string"))
    else:
        rows = rows.join(hints.select(*by, "stage_id", "sql_plan_hint"), [*by, "stage_id"], "left")
    peak = (
        "CASE WHEN peak_execution_memory > 0 THEN peak_execution_memory"
        " WHEN task_peak > 0 THEN task_peak END"
    )
    rows = _with_cluster(rows, cluster, by).withColumn("peak_memory", F.expr(peak))
    parts = [
        f"if({side}_bytes > 0,"
        f" {fill(part, bytes_text(f'{side}_bytes'), count_text(f'{side}_records'))}, NULL)"
        for part, side in HEADER_IO.items()
    ]
    spill = fill(HEADER_SPILL, bytes_text("disk_bytes_spilled"), bytes_text("memory_bytes_spilled"))
    parts.append(f"if(disk_bytes_spilled > 0, {spill}, NULL)")
    cpu = percent(cpu_ratio("executor_cpu_time", "executor_run_time"))
    cpu_detail = fill(
        HEADER_CPU, duration_text(cpu_millis("executor_cpu_time")),
        duration_text("executor_run_time"),
    )
    lost = fill(HEADER_FAILURES, "num_failed_tasks", "num_killed_tasks", "num_tasks")
    return rows.selectExpr(
        *by, "stage_id", "attempt_id", "status", "num_tasks",
        f"{stage_label('name')} AS name",
        f"coalesce({duration_text(WALL_MS)}, '{ACTIVE}') AS duration",
        "sql_plan_hint",
        f"nullif(concat_ws('  ', {', '.join(parts)}), '') AS io",
        f"if(executor_run_time > 0, {cpu}, NULL) AS cpu",
        f"if(executor_run_time > 0, {cpu_detail}, NULL) AS cpu_detail",
        "peak_memory",
        f"{bytes_text('peak_memory')} AS peak_memory_text",
        "CASE WHEN peak_execution_memory > 0 THEN 'stage' WHEN task_peak > 0 THEN 'task max' END"
        " AS peak_source",
        f"if(peak_memory IS NULL, NULL, {bands.memory_band('peak_memory', 'cluster_memory')}) AS memory_band",
        f"if(num_failed_tasks > 0 OR num_killed_tasks > 0, {lost}, NULL) AS failures",
    )


def duration_profile(tasks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Min, median, p90, p99 and max duration of stages with two durations or more."""
    return exact_quantiles(tasks, [*by, "stage_id"], "duration", DURATION_PROBS).where("n >= 2")


def profile_texts(profile: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return profile.selectExpr(
        *by, "stage_id", *[f"{duration_text(f'cast({n} as bigint)')} AS {n}" for n in DURATION_PROBS]
    )


HISTOGRAM_SALTS = 8  # tasks that share the lookup of one stage's range


def duration_histogram(tasks: DataFrame, by: Sequence[str] = (), totals: DataFrame | None = None) -> DataFrame:
    """Ten equal duration buckets per stage, empty ones included; none without a range.

    Tasks are first counted per duration; the range of a stage then reaches its counts by
    a salted lookup, so one large stage is worked on by many tasks.  With ``executor_totals``
    at hand the ranges come from them and tasks are read once, else twice.
    """
    keys = [*by, "stage_id"]
    counts = value_counts(tasks, keys, "duration")
    if totals is None:
        bounds = counts.groupBy(*keys).agg(F.min("value").alias("least"), F.max("value").alias("most"))
    else:
        bounds = totals.groupBy(*keys).agg(F.min("min_duration").alias("least"), F.max("max_duration").alias("most"))
    ranges = bounds.where("most > least")
    width = (F.col("most") - F.col("least")).cast("double") / F.lit(float(HISTOGRAM_BUCKETS))
    at = F.least(
        F.floor((F.col("value") - F.col("least")).cast("double") / width),
        F.lit(HISTOGRAM_BUCKETS - 1),
    )
    placed = salted_lookup(counts, ranges, keys, F.col("value"), HISTOGRAM_SALTS).withColumn("at", at)
    per_stage = placed.groupBy(*keys).agg(
        F.max("least").alias("least"),
        F.max("most").alias("most"),
        *[
            F.sum(F.when(F.col("at") == i, F.col("times")).otherwise(F.lit(0))).alias(f"n{i}")
            for i in range(HISTOGRAM_BUCKETS)
        ],
    )
    all_counts = F.array(*[f"n{i}" for i in range(HISTOGRAM_BUCKETS)])
    lo = F.col("least").cast("double") + F.col("bucket").cast("double") * width
    return per_stage.select(
        *keys, "least", "most", F.array_max(all_counts).alias("highest"),
        F.posexplode(all_counts).alias("bucket", "n"),
    ).select(
        *keys, F.col("bucket").cast("bigint").alias("bucket"), lo.alias("lo"), (lo + width).alias("hi"), "n",
        (F.col("n").cast("double") / F.col("highest").cast("double") * float(HISTOGRAM_BAR))
        .cast("bigint")
        .alias("bar"),
    )


def executor_breakdown(tasks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tasks, average duration, bytes and share of the stage's bytes per executor."""
    return executor_shares(tasks, by).selectExpr(
        *by, "stage_id", "executor_id", "tasks",
        f"{whole_div('duration_sum', 'tasks')} AS avg_duration", "bytes", "share * 100D AS pct",
    )


def breakdown_texts(breakdown: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return breakdown.selectExpr(
        *by, "stage_id", f"{shorten('executor_id', 12)} AS executor", "tasks",
        f"{duration_text('avg_duration')} AS avg_duration", f"{bytes_text('bytes')} AS bytes",
        f"concat({fixed('pct', 1)}, '%') AS pct",
    )


def peak_memory(tasks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest, average and total peak memory of a stage's tasks, where any is known."""
    per_stage = executor_totals(tasks, by).groupBy(*by, "stage_id").agg(
        F.max("max_memory").alias("max_memory"), F.sum("total_memory").alias("total_memory"), F.sum("tasks").alias("tasks")
    )
    return per_stage.where("max_memory > 0").selectExpr(
        *by, "stage_id", "max_memory", f"{whole_div('total_memory', 'tasks')} AS avg_memory", "total_memory"
    )


def skew_metrics(tasks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Deviation, max/median and slowest task with its executor, for two durations or more."""
    totals = executor_totals(tasks, by)
    dists = distributions(tasks, by, ["duration"], False, totals)
    return dists.select(*by, "stage_id", "cv", "max_median_ratio").join(
        slowest_tasks(tasks, by, totals), [*by, "stage_id"]
    )


def health_bands(
    stages: DataFrame, cluster: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Band of each measure of a stage."""
    busy = cpu_ratio("executor_cpu_time", "executor_run_time")
    return _with_cluster(stages, cluster, by).selectExpr(
        *by, "stage_id", "attempt_id",
        f"{bands.io_band('input_bytes')} AS input_band",
        f"{bands.io_band('output_bytes')} AS output_band",
        f"{bands.shuffle_band('shuffle_read_bytes')} AS shuffle_read_band",
        f"{bands.shuffle_band('shuffle_write_bytes')} AS shuffle_write_band",
        f"{bands.spill_band('disk_bytes_spilled')} AS spill_band",
        f"if({busy} IS NULL, NULL, {bands.cpu_band(busy)}) AS cpu_band",
        f"{bands.memory_band('peak_execution_memory', 'cluster_memory')} AS memory_band",
    )


# ---------------------------------------------------------------------------
# Snapshots and plans
# ---------------------------------------------------------------------------
SNAPSHOT_PARTS = 16  # tasks that share the work on one stage


def merge_task_snapshots(old: DataFrame, new: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The new rows, and the old rows of stages the new snapshot does not hold."""
    keys = [*by, "stage_id"]
    fresh = new.select(*keys).distinct().withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SNAPSHOT_PARTS - 1))))
    # a stage is dealt to several tasks by task id, so that none receives a whole large stage
    dealt = old.withColumn("_part", F.pmod(F.xxhash64("task_id"), F.lit(SNAPSHOT_PARTS)).cast("int"))
    kept = dealt.join(fresh, [*keys, "_part"], "left_anti").drop("_part")
    return new.unionByName(kept, allowMissingColumns=True)


def plan_tokens(sql_executions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How often each operator, column, quoted text and number appears in each plan."""
    lines = sql_executions.selectExpr(
        *by, "id AS sql_id", f"explode({plan_lines('plan_description')}) AS line"
    )
    tokens = lines.selectExpr(*by, "sql_id", f"explode({line_tokens('line')}) AS token")
    return (
        tokens.selectExpr(*by, "sql_id", f"{token_kind('token')} AS kind", f"{printable('token')} AS token")
        .groupBy(*by, "sql_id", "kind", "token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def plan_operator_census(sql_executions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return (
        plan_tokens(sql_executions, by)
        .where(F.col("kind") == "operator")
        .select(*by, "sql_id", F.col("token").alias("operator"), "n")
    )
