"""Stage rules: each is a condition and the finding it reports, over one wide stage row.

Rules are SQL text over the columns of ``linking.stage_context``.  ``stage_findings``
evaluates any number of rules in one pass over the rows and emits the findings that fired,
instead of one scan per rule.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope import model as M
from emberscope.functions.texts import (
    bytes_text,
    cpu_millis,
    cpu_ratio,
    duration_text,
    fill,
    fixed,
    lit,
    percent,
    ratio,
    shorten,
    stage_label,
    whole,
    whole_div,
)
from emberscope.operators.keys import attach_totals

# ---------------------------------------------------------------------------
# Thresholds and the shares of the run time counted as savings.
# ---------------------------------------------------------------------------
SLOW_WARN_SD, SLOW_CRIT_SD = "2.0D", "4.0D"
SPILL_CRIT = M.GB
IO_MIN_RUN_MS, IO_MAX_RATIO = 10_000, "0.3D"
CPU_MIN_RUN_MS, CPU_MIN_RATIO = 30_000, "0.9D"
EXPLODE_MIN_RECORDS, EXPLODE_FACTOR, EXPLODE_CRIT = 1000, 10, "100D"
FAIL_CRIT_RATE, FAIL_CRIT_TASKS = "0.1D", 10
MEM_SPILL_MIN = 50 * M.MB
MANY_TASKS, SMALL_TASK_BYTES = 10_000, M.MB
FEW_TASKS, LARGE_TASK_BYTES = 8, M.GB
TARGET_PARTITION_BYTES = 128 * M.MB
BROADCAST_MAX_BYTES, PLAN_RULE_MIN_RUN_MS = 100 * M.MB, 5_000
JOIN_MARKS = ("SortMerge", "ShuffledHash", "Join")
PYTHON_MARKS = ("ArrowEvalPython", "BatchEvalPython", "PythonUDF", "PythonRunner")
REPEAT_MIN_TOTAL_MS = 30_000
SAVINGS = {
    M.DISK_SPILL: "0.3D",
    M.IO_BOUND: "0.2D",
    M.CPU_BOUND: "0.2D",
    M.RECORD_EXPLODE: "0.5D",
    M.MEM_PRESSURE: "0.1D",
    M.TOO_MANY_PARTS: "0.4D",
    M.TOO_FEW_PARTS: "0.5D",
    M.BCAST_JOIN: "0.6D",
    M.PYTHON_UDF: "0.5D",
}

# Titles and details of the findings.
TITLES = {
    M.SLOW_STAGE: "Stage {} took {}{}",
    M.DISK_SPILL: "Stage {} spilled {} to disk",
    M.IO_BOUND: "Stage {} I/O bound: CPU ratio {}",
    M.CPU_BOUND: "Stage {} CPU saturated: {} utilization for {}",
    M.RECORD_EXPLODE: "Stage {} output {}x more records than input",
    M.TASK_FAIL: "Stage {} has {} failed + {} killed tasks ({})",
    M.MEM_PRESSURE: "Stage {} memory spill {} (no disk spill yet)",
    M.TOO_MANY_PARTS: "Stage {} has {} tasks with only {}/task avg",
    M.TOO_FEW_PARTS: "Stage {} has only {} tasks with {}/task avg",
    M.BCAST_JOIN: "Stage {} shuffles only {} — broadcast join candidate",
    M.PYTHON_UDF: "Stage {} uses Python UDF ({})",
    M.CACHE_OPPTY: "'{}' repeated {} times (total: {})",
}
DETAILS = {
    M.SLOW_STAGE: "Mean: {}, StdDev: {}, {}x slower than average",
    M.DISK_SPILL: "Memory spill: {}, Disk spill: {}",
    M.IO_BOUND: "CPU time {} vs runtime {} ({} utilization)",
    M.CPU_BOUND: "CPU time {} vs runtime {} — CPU fully utilized",
    M.RECORD_EXPLODE: "Input: {} records → Output: {} records ({}x expansion)",
    M.TASK_FAIL: "Total tasks: {}, Failed: {}, Killed: {}, Completed: {}",
    M.MEM_PRESSURE: "Memory spilled: {}, Disk spilled: 0 — approaching disk spill threshold",
    M.TOO_MANY_PARTS: "Total data: {}, {} tasks × {} avg",
    M.TOO_FEW_PARTS: "Total data: {}, {} tasks × {} avg",
    M.BCAST_JOIN: "Shuffle write: {} < 100MB threshold. A broadcast join would eliminate this shuffle.",
    M.PYTHON_UDF: "Python UDF detected in SQL plan. CPU utilization: {}",
    M.CACHE_OPPTY: "{} stages share name '{}'. Total runtime: {}. Caching could eliminate {} re-computations.",
}
PATTERN_TAG = " [{}]"
IO_PARTS = {
    "in: {}": "input_bytes",
    "out: {}": "output_bytes",
    "shuf_r: {}": "shuffle_read_bytes",
    "shuf_w: {}": "shuffle_write_bytes",
}
IO_RATIO, NO_IO = "ratio: {}:1 in:out", "no I/O"

# What to do about a bottleneck.
REMEDY = {
    M.LARGE_SCAN: "Read less: select the columns you need and filter on partition columns such as"
    " date or region before anything else.",
    M.WIDE_SHUFFLE: "Shuffle less: join small tables with broadcast(small_df) and aggregate before"
    " the join.",
    M.DATA_EXPLOSION: "Filter before explode() and make sure that no join lacks its condition.",
    M.RECORD_EXPLOSION: "Look for explode() on long arrays or a join without condition, and filter"
    " its input first.",
}
SLOW_ADVICE = (
    "Look at the code location and at df.explain(True); a large shuffle often means a missing"
    " filter or a broad join."
)
SPILL_ADVICE = "Raise spark.executor.memory or use smaller partitions with df.repartition(200)."
IO_ADVICE = (
    "Waiting for I/O: cache DataFrames that are read again with df.cache(), raise"
    " spark.executor.memory, or repartition for locality."
)
CPU_ADVICE = (
    "CPU is the limit: use built-in functions or @pandas_udf instead of @udf, cache with df.cache(),"
    " and raise parallelism with df.repartition(N)."
)
EXPLODE_ADVICE = (
    "Filter first and explode later, and give every join an explicit condition."
)
FAIL_ADVICE = (
    "Read the executor logs for out-of-memory and fetch failures; consider a larger"
    " spark.executor.memory and check spark.task.maxFailures."
)
MEM_ADVICE = (
    "Raise spark.executor.memory and spark.executor.memoryOverhead, or use smaller partitions with"
    " df.repartition(N)."
)
BROADCAST_ADVICE = (
    "Join with broadcast(small_df): the small side then needs no shuffle."
)
PYTHON_ADVICE = (
    "Use built-in functions such as F.when() and F.expr(), or @pandas_udf; a plain @udf moves the"
    " data row by row."
)
CACHE_ADVICE = (
    "Call df.cache() or df.persist() before the first action and df.unpersist() after the last."
)


@dataclass(frozen=True)
class Finding:
    """One rule: when it fires and what it reports, all as SQL text."""

    category: str
    fires: str
    title: str
    detail: str
    recommendation: str
    savings: str
    critical: str = "false"
    bottleneck: str = "cast(null as string)"


StageRule = Callable[[], Finding]


def _saving(share: str) -> str:
    """Share of the run time in double arithmetic, cut to whole milliseconds."""
    return f"cast(executor_run_time * {share} as bigint)"


COMPLETE = f"status = '{M.STAGE_COMPLETE}'"
RUN_TEXT = duration_text("executor_run_time")
CPU_TEXT = duration_text(cpu_millis("executor_cpu_time"))
CPU_RATIO = cpu_ratio("executor_cpu_time", "executor_run_time")
TOTAL_READ = "(input_bytes + shuffle_read_bytes)"
READ_PER_TASK = whole_div(TOTAL_READ, "num_tasks")


# ---------------------------------------------------------------------------
# Derived columns of the wide stage row
# ---------------------------------------------------------------------------
def bottleneck() -> str:
    """The first matching pattern, or NULL."""
    return (
        f"CASE WHEN input_bytes > {100 * M.MB} AND output_bytes > 5 * input_bytes THEN '{M.DATA_EXPLOSION}'"
        f" WHEN input_bytes > {M.GB} AND input_bytes > 10 * (output_bytes + shuffle_write_bytes)"
        f" THEN '{M.LARGE_SCAN}'"
        f" WHEN shuffle_write_bytes > {500 * M.MB} OR (shuffle_read_bytes > input_bytes AND input_bytes > 0)"
        f" THEN '{M.WIDE_SHUFFLE}' END"
    )


def remedy(pattern: str) -> str:
    branches = " ".join(f"WHEN {lit(name)} THEN {lit(advice)}" for name, advice in REMEDY.items())
    return f"CASE {pattern} {branches} END"


def io_summary() -> str:
    """Byte counters above zero in one line, with the in:out ratio above 2."""
    parts = [
        f"if({name} > 0, {fill(part, bytes_text(name))}, NULL)" for part, name in IO_PARTS.items()
    ]
    in_out = ratio("input_bytes", "output_bytes")
    parts.append(
        f"if(input_bytes > 0 AND output_bytes > 0 AND {in_out} > 2D,"
        f" {fill(IO_RATIO, whole(in_out))}, NULL)"
    )
    return f"coalesce(nullif(concat_ws(', ', {', '.join(parts)}), ''), {lit(NO_IO)})"


# ---------------------------------------------------------------------------
# Rules
# ---------------------------------------------------------------------------
def slow_stage() -> Finding:
    """Needs ``run_mean, run_sd, run_n`` (see ``with_run_statistics``)."""
    return Finding(
        category=M.SLOW_STAGE,
        fires=f"{COMPLETE} AND executor_run_time > 0 AND run_n >= 2"
        f" AND executor_run_time > run_mean + {SLOW_WARN_SD} * run_sd",
        critical=f"executor_run_time > run_mean + {SLOW_CRIT_SD} * run_sd",
        title=fill(
            TITLES[M.SLOW_STAGE], "stage_id", RUN_TEXT,
            f"coalesce({fill(PATTERN_TAG, 'bottleneck')}, '')",
        ),
        detail=fill(
            DETAILS[M.SLOW_STAGE],
            duration_text("cast(run_mean as bigint)"), duration_text("cast(run_sd as bigint)"),
            fixed("executor_run_time / run_mean", 1),
        ),
        recommendation=f"coalesce({remedy('bottleneck')}, {lit(SLOW_ADVICE)})",
        savings="cast(executor_run_time - run_mean as bigint)",
        bottleneck="bottleneck",
    )


def disk_spill() -> Finding:
    return Finding(
        category=M.DISK_SPILL,
        fires="disk_bytes_spilled > 0",
        critical=f"disk_bytes_spilled > {SPILL_CRIT}",
        title=fill(TITLES[M.DISK_SPILL], "stage_id", bytes_text("disk_bytes_spilled")),
        detail=fill(
            DETAILS[M.DISK_SPILL],
            bytes_text("memory_bytes_spilled"), bytes_text("disk_bytes_spilled"),
        ),
        recommendation=f"concat_ws(' ', {lit(SPILL_ADVICE)}, {remedy('bottleneck')})",
        savings=_saving(SAVINGS[M.DISK_SPILL]),
        bottleneck="bottleneck",
    )


def io_bound() -> Finding:
    return Finding(
        category=M.IO_BOUND,
        fires=f"{COMPLETE} AND executor_run_time > {IO_MIN_RUN_MS} AND {CPU_RATIO} < {IO_MAX_RATIO}",
        title=fill(TITLES[M.IO_BOUND], "stage_id", percent(CPU_RATIO)),
        detail=fill(
            DETAILS[M.IO_BOUND], CPU_TEXT, RUN_TEXT, percent(CPU_RATIO)
        ),
        recommendation=lit(IO_ADVICE),
        savings=_saving(SAVINGS[M.IO_BOUND]),
    )


def cpu_bound() -> Finding:
    return Finding(
        category=M.CPU_BOUND,
        fires=f"{COMPLETE} AND executor_run_time > {CPU_MIN_RUN_MS} AND {CPU_RATIO} > {CPU_MIN_RATIO}",
        title=fill(
            TITLES[M.CPU_BOUND], "stage_id", percent(CPU_RATIO), RUN_TEXT
        ),
        detail=fill(DETAILS[M.CPU_BOUND], CPU_TEXT, RUN_TEXT),
        recommendation=lit(CPU_ADVICE),
        savings=_saving(SAVINGS[M.CPU_BOUND]),
    )


def record_explosion() -> Finding:
    growth = ratio("output_records", "input_records")
    return Finding(
        category=M.RECORD_EXPLODE,
        fires=f"input_records > {EXPLODE_MIN_RECORDS} AND output_records > {EXPLODE_FACTOR} * input_records",
        critical=f"{growth} > {EXPLODE_CRIT}",
        title=fill(TITLES[M.RECORD_EXPLODE], "stage_id", whole(growth)),
        detail=fill(
            DETAILS[M.RECORD_EXPLODE],
            "input_records", "output_records", whole(growth),
        ),
        recommendation=lit(EXPLODE_ADVICE),
        savings=_saving(SAVINGS[M.RECORD_EXPLODE]),
        bottleneck=lit(M.RECORD_EXPLOSION),
    )


def task_failures() -> Finding:
    lost = "(num_failed_tasks + num_killed_tasks)"
    rate = f"if(num_tasks > 0, {ratio(lost, 'num_tasks')}, 0D)"
    return Finding(
        category=M.TASK_FAIL,
        fires="num_failed_tasks > 0 OR num_killed_tasks > 0",
        critical=f"{rate} > {FAIL_CRIT_RATE} OR {lost} > {FAIL_CRIT_TASKS}",
        title=fill(
            TITLES[M.TASK_FAIL],
            "stage_id", "num_failed_tasks", "num_killed_tasks", percent(rate),
        ),
        detail=fill(
            DETAILS[M.TASK_FAIL],
            "num_tasks", "num_failed_tasks", "num_killed_tasks", "num_complete_tasks",
        ),
        recommendation=lit(FAIL_ADVICE),
        savings=_saving(rate),
    )


def memory_pressure() -> Finding:
    spilled = bytes_text("memory_bytes_spilled")
    return Finding(
        category=M.MEM_PRESSURE,
        fires=f"memory_bytes_spilled > {MEM_SPILL_MIN} AND disk_bytes_spilled = 0",
        title=fill(TITLES[M.MEM_PRESSURE], "stage_id", spilled),
        detail=fill(
            DETAILS[M.MEM_PRESSURE], spilled
        ),
        recommendation=lit(MEM_ADVICE),
        savings=_saving(SAVINGS[M.MEM_PRESSURE]),
    )


def _partition_detail() -> str:
    return fill(
        DETAILS[M.TOO_MANY_PARTS], bytes_text(TOTAL_READ), "num_tasks", bytes_text(READ_PER_TASK)
    )


def _target(least: int) -> str:
    return f"greatest({TOTAL_READ} div {TARGET_PARTITION_BYTES}, {least})"


def too_many_partitions() -> Finding:
    return Finding(
        category=M.TOO_MANY_PARTS,
        fires=f"{COMPLETE} AND num_tasks > {MANY_TASKS} AND {TOTAL_READ} <> 0"
        f" AND {READ_PER_TASK} < {SMALL_TASK_BYTES}",
        title=fill(
            TITLES[M.TOO_MANY_PARTS], "stage_id", "num_tasks", bytes_text(READ_PER_TASK)
        ),
        detail=_partition_detail(),
        recommendation=fill("Use df.coalesce({}) for partitions of about 128MB.", _target(1)),
        savings=_saving(SAVINGS[M.TOO_MANY_PARTS]),
    )


def too_few_partitions() -> Finding:
    return Finding(
        category=M.TOO_FEW_PARTS,
        fires=f"{COMPLETE} AND num_tasks > 0 AND num_tasks <= {FEW_TASKS}"
        f" AND {READ_PER_TASK} > {LARGE_TASK_BYTES}",
        title=fill(
            TITLES[M.TOO_FEW_PARTS], "stage_id", "num_tasks", bytes_text(READ_PER_TASK)
        ),
        detail=_partition_detail(),
        recommendation=fill("Use df.repartition({}) for partitions of about 128MB.", _target(8)),
        savings=_saving(SAVINGS[M.TOO_FEW_PARTS]),
    )


def _mentions(words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains(plan_search, {lit(word)})" for word in words) + ")"


def broadcast_join() -> Finding:
    moved = bytes_text("shuffle_write_bytes")
    return Finding(
        category=M.BCAST_JOIN,
        fires=f"{COMPLETE} AND shuffle_write_bytes > 0 AND shuffle_write_bytes < {BROADCAST_MAX_BYTES}"
        f" AND executor_run_time > {PLAN_RULE_MIN_RUN_MS} AND {_mentions(JOIN_MARKS)}",
        title=fill(TITLES[M.BCAST_JOIN], "stage_id", moved),
        detail=fill(
            DETAILS[M.BCAST_JOIN], moved
        ),
        recommendation=lit(BROADCAST_ADVICE),
        savings=_saving(SAVINGS[M.BCAST_JOIN]),
    )


def python_udf() -> Finding:
    busy = f"coalesce({CPU_RATIO}, 0D)"
    return Finding(
        category=M.PYTHON_UDF,
        fires=f"{COMPLETE} AND executor_run_time > {PLAN_RULE_MIN_RUN_MS} AND {_mentions(PYTHON_MARKS)}",
        critical=f"{busy} > {CPU_MIN_RATIO} AND executor_run_time > {CPU_MIN_RUN_MS}",
        title=fill(TITLES[M.PYTHON_UDF], "stage_id", RUN_TEXT),
        detail=fill(DETAILS[M.PYTHON_UDF], percent(busy)),
        recommendation=lit(PYTHON_ADVICE),
        savings=_saving(SAVINGS[M.PYTHON_UDF]),
    )


# The rules that look at one stage row at a time, in reporting order.
ROW_RULES: dict[str, StageRule] = {
    "slow_stage": slow_stage,
    "disk_spill": disk_spill,
    "io_bound": io_bound,
    "cpu_bound": cpu_bound,
    "record_explosion": record_explosion,
    "task_failures": task_failures,
    "memory_pressure": memory_pressure,
    "too_many_partitions": too_many_partitions,
    "too_few_partitions": too_few_partitions,
    "broadcast_join": broadcast_join,
    "python_udf": python_udf,
}


# ---------------------------------------------------------------------------
# Evaluation
# ---------------------------------------------------------------------------
def run_statistics(stages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation and count of the run times of completed stages."""
    timed = stages.selectExpr(
        *by, f"if({COMPLETE} AND executor_run_time > 0, executor_run_time, NULL) AS run"
    )
    return timed.groupBy(*by).agg(
        F.avg("run").alias("run_mean"), F.stddev_pop("run").alias("run_sd"), F.count("run").alias("run_n")
    )


def with_run_statistics(context: DataFrame, stages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return attach_totals(context, run_statistics(stages, by), by)


def _as_struct(f: Finding) -> str:
    return (
        f"named_struct('severity', if({f.critical}, '{M.CRIT}', '{M.WARN}'), 'category', {lit(f.category)},"
        f" 'title', {f.title}, 'detail', {f.detail}, 'recommendation', {f.recommendation},"
        f" 'pattern', {f.bottleneck}, 'estimated_savings_ms', {f.savings})"
    )


def stage_findings(
    context: DataFrame, rules: Sequence[StageRule], by: Sequence[str] = ()
) -> DataFrame:
    """Findings of the given rules over the wide stage rows, in one pass."""
    findings = [rule() for rule in rules]
    kept = [*by, "stage_id", "job_id", "name", "sql_id", "sql_description", "io_summary", "sql_plan_hint"]
    if len(findings) == 1:
        rows = context.where(findings[0].fires)
        found = rows.selectExpr(*kept, f"inline(array({_as_struct(findings[0])}))")
    else:
        fired = ", ".join(f"if({f.fires}, {_as_struct(f)}, NULL)" for f in findings)
        found = context.selectExpr(*kept, f"inline(array({fired}))").where("category IS NOT NULL")
    return as_suspects(found.withColumnsRenamed({"pattern": "bottleneck", "name": "stage_name"}), by)


def as_suspects(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.select(*by, *M.SUSPECT_COLUMNS)


def cache_opportunities(context: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Completed stages that repeat under one name; reported on the slowest of them."""
    shown = (
        "struct(stage_id, job_id, name AS stage_name, sql_id, sql_description, io_summary, sql_plan_hint)"
    )
    groups = (
        context.where(f"{COMPLETE} AND executor_run_time > 0")
        .withColumn("label", F.expr(stage_label("name")))
        .groupBy(*by, "label")
        .agg(
            F.count(F.lit(1)).alias("times"),
            F.sum("executor_run_time").alias("total"),
            F.min("executor_run_time").alias("least"),
            F.expr(f"max_by({shown}, struct(executor_run_time, stage_id))").alias("slowest"),
        )
        .where(f"times >= 2 AND total > {REPEAT_MIN_TOTAL_MS}")
    )
    total = duration_text("total")
    title = fill(TITLES[M.CACHE_OPPTY], shorten("label", 40), "times", total)
    detail = fill(
        DETAILS[M.CACHE_OPPTY],
        "times", shorten("label", 30), total, "(times - 1)",
    )
    found = groups.selectExpr(
        *by,
        f"'{M.WARN}' AS severity",
        f"'{M.CACHE_OPPTY}' AS category",
        f"{title} AS title",
        f"{detail} AS detail",
        f"{lit(CACHE_ADVICE)} AS recommendation",
        "cast(null as string) AS bottleneck",
        "total - least AS estimated_savings_ms",
        "slowest.*",
    )
    return as_suspects(found, by)
