"""Distribution statistics of the tasks of a stage, and the findings drawn from them.

Tasks are the one table that is large, and one stage may hold a third of its rows.  The tasks of
stages beyond ``LARGE_GROUP`` are therefore only aggregated to fixed-width values that Spark
combines before the shuffle, those of smaller stages are dealt out by stage, and no join has a
single stage as its only key on the task side.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberscope import model as M
from emberscope.functions.texts import bytes_text, duration_text, fill, fixed, lit, percent, whole
from emberscope.operators.keys import top_rows
from emberscope.operators.quantiles import LARGE_GROUP, parted, quantiles_of_counts, value_counts
from emberscope.operators.stage_rules import as_suspects

# Skew limits on deviation/mean and on max/median, and the hot share.
CV_WARN, CV_CRIT = "1D", "2D"
RATIO_WARN, RATIO_CRIT = "3D", "10D"
RECORD_SKEW_MIN_MAX = 1000
HOT_SHARE = 0.5
TOP_STAGES, MANY_TASKS, STAGE_CAP = 5, 100, 15

# Titles and details of the findings.
SKEW_TITLE = "{}: CV={}, max/median={}x"
SKEW_LABELS = {
    "duration": "Duration skew",
    "size": "Data size skew",
    "records": "Record count skew",
}
SKEW_DETAILS = {
    "duration": "Task #{} took {} (median {}), processed {}",
    "size": "Task #{} processed {} (median {}, max {})",
    "records": "Task #{} processed {} records (median {}, max {})",
}
HOT_TITLE = "Executor {} handles {} of data"
HOT_DETAIL = "Executor {} processed {} ({} of total {}) across {} tasks"

DURATION_ADVICE = "Repartition, or salt the keys that hold most rows."
SIZE_ADVICE = "Tasks get unequal amounts of data: repartition by a more even key or salt it."
RECORD_ADVICE = "Tasks get unequal numbers of records: look for hot keys in joins and groupings."
HOTSPOT_ADVICE = "One executor does most of the work: check data locality and how partitions are placed."

MEASURES = ("duration", "size", "records")
SPREAD_FIELDS = ("n", "mean", "sd", "max", "top", "bytes")
_TASK_ID_ROOM = Decimal(10**19)


def task_size() -> Column:
    return F.col("input_bytes") + F.col("shuffle_read_bytes")


def task_records() -> Column:
    return F.col("input_records") + F.col("shuffle_read_records")


def _values() -> dict[str, Column]:
    return {"duration": F.col("duration"), "size": task_size(), "records": task_records()}


def _measured(measures: Sequence[str]) -> list[Column]:
    return [_values()[m].alias(m) for m in measures]


def _packed(value: Column) -> Column:
    """Value and task id as one decimal: its maximum is the largest value and, among
    equals, the largest task id, and the aggregation buffer stays fixed in width."""
    return F.coalesce(value, F.lit(0)).cast("decimal(18,0)") * F.lit(_TASK_ID_ROOM) + F.col(
        "task_id"
    ).cast("decimal(19,0)")


def _task_id_of(packed: Column) -> Column:
    return F.pmod(packed, F.lit(_TASK_ID_ROOM)).cast("bigint")


def executor_totals(tasks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per stage and executor with all that the rules over tasks need but quantiles.

    Counts, sums and maxima, and per measure the count, mean, variance and the task with the
    largest value.  Everything that adds up to a stage starts from these rows and not from tasks.
    The buffers are fixed in width but ten times as wide as a task: tasks of stages of modest size
    are therefore dealt out by stage as they are, and only those of large stages are combined
    before the shuffle.
    """
    keys = [*by, "stage_id"]
    narrow = tasks.select(*keys, "executor_id", "task_id", "peak_execution_memory", *_measured(MEASURES))
    small, big = parted(narrow, None, keys)
    return _totals(small.repartition(*keys), keys).unionByName(_totals(big, keys))


def _totals(tasks: DataFrame, keys: Sequence[str], more: Sequence[Column] = ()) -> DataFrame:
    measured = [*more]
    for m in MEASURES:
        value = F.col(m)
        packed = F.when(value.isNotNull(), _packed(value))
        measured += [
            F.count(value).alias(f"n_{m}"), F.avg(value).alias(f"mean_{m}"), F.var_pop(value).alias(f"var_{m}"),
            F.max(value).alias(f"max_{m}"), F.max(packed).alias(f"top_{m}"),
            F.max_by("size", packed).alias(f"bytes_{m}"),
        ]
    return tasks.groupBy(*keys, "executor_id").agg(
        F.count(F.lit(1)).alias("tasks"), F.sum("size").alias("bytes"),
        F.sum(F.coalesce("duration", F.lit(0))).alias("duration_sum"), F.min("duration").alias("min_duration"),
        F.max(_packed(F.col("duration"))).alias("slowest"),
        F.max("peak_execution_memory").alias("max_memory"), F.sum("peak_execution_memory").alias("total_memory"),
        *measured,
    )


def merged_totals(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows of ``executor_totals`` over several shares of the tasks, as one row per stage and executor."""
    keys = [*by, "stage_id", "executor_id"]
    one = Window.partitionBy(*keys)  # a row per share
    whole, merged = {}, []
    for m in MEASURES:
        n, mean = F.col(f"n_{m}").cast("double"), F.coalesce(f"mean_{m}", F.lit(0.0))
        whole[f"_mean_{m}"] = F.sum(n * mean).over(one) / F.nullif(F.sum(n).over(one), F.lit(0.0))
        apart = mean - F.col(f"_mean_{m}")
        merged += [
            F.sum(f"n_{m}").alias(f"n_{m}"), F.first(f"_mean_{m}").alias(f"mean_{m}"),
            (F.sum(n * (F.coalesce(f"var_{m}", F.lit(0.0)) + apart * apart)) / F.nullif(F.sum(n), F.lit(0.0))).alias(f"var_{m}"),
            F.max(f"max_{m}").alias(f"max_{m}"), F.max(f"top_{m}").alias(f"top_{m}"), F.max_by(f"bytes_{m}", f"top_{m}").alias(f"bytes_{m}"),
        ]
    return parts.withColumns(whole).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("tasks", "bytes", "duration_sum", "total_memory")],
        F.min("min_duration").alias("min_duration"), F.max("slowest").alias("slowest"), F.max("max_memory").alias("max_memory"), *merged,
    )


def measure_counts(tasks: DataFrame, by: Sequence[str] = (), measures: Sequence[str] = MEASURES) -> DataFrame:
    """Rows per stage, measure and value: all that medians need.

    Tasks of stages of modest size are dealt out by stage as they are, one row for all measures;
    those of large stages are combined before the shuffle.
    """
    keys = [*by, "stage_id"]
    small, big = parted(tasks.select(*keys, *_measured(measures)), None, keys)

    def counted(rows: DataFrame) -> DataFrame:
        return value_counts(_long(rows, keys, measures, "value"), [*keys, "measure"], "value")

    return counted(small.repartition(*keys)).unionByName(counted(big))


def _long(rows: DataFrame, keys: Sequence[str], measures: Sequence[str], value: str) -> DataFrame:
    """A row per measure from one row with a column for each."""
    return rows.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias(value)) for m in measures])))


def _moments(totals: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row per stage and measure: n, mean, deviation and the task with the largest value."""
    return _by_stage(totals, keys, measures).select(*keys, F.inline(F.array(*measures))).where("n > 0")


def _by_stage(totals: DataFrame, keys: Sequence[str], measures: Sequence[str], more: Sequence[Column] = ()) -> DataFrame:
    """One row per stage with a struct of moments per measure; its rows of totals need not be moved if they lie together."""
    stage = Window.partitionBy(*keys)  # over executors, not tasks
    whole, merged = {}, []
    for m in measures:
        weight, mean = F.col(f"n_{m}").cast("double"), F.col(f"mean_{m}")
        whole[f"all_{m}"] = F.sum(weight * mean).over(stage) / F.nullif(F.sum(weight).over(stage), F.lit(0.0))
        apart = mean - F.col(f"all_{m}")
        merged.append(F.struct(
            F.lit(m).alias("measure"), F.sum(f"n_{m}").alias("n"), F.first(f"all_{m}").alias("mean"),
            F.sqrt(F.sum(weight * (F.col(f"var_{m}") + apart * apart)) / F.nullif(F.sum(weight), F.lit(0.0))).alias("sd"),
            F.max(f"max_{m}").alias("max"), _task_id_of(F.max(f"top_{m}")).alias("top"), F.max_by(f"bytes_{m}", f"top_{m}").alias("bytes"),
        ).alias(m))
    return totals.withColumns(whole).groupBy(*keys).agg(*merged, *more)


def stage_spreads(tasks: DataFrame, by: Sequence[str] = (), measures: Sequence[str] = MEASURES, large: int = LARGE_GROUP) -> DataFrame:
    """One row per stage with all that the rules over tasks need: ``stage_tasks, stage_bytes``, tasks and
    bytes of its ``executors``, and per measure the moments (a struct) and the median (``median_`` and its name).

    Tasks of stages of modest size are dealt out by stage once, and all of this is made where they lie:
    neither they nor the totals of their executors are moved again.  Large stages are combined before the shuffle.
    """
    keys = [*by, "stage_id"]
    medians = [f"median_{m}" for m in measures]
    narrow = tasks.select(*keys, "executor_id", "task_id", "peak_execution_memory", *_measured(MEASURES))
    small, big = parted(narrow, None, keys, large)
    stage = Window.partitionBy(*keys)  # of at most `large` tasks
    dealt = small.repartition(*keys).withColumns({f"median_{m}": F.percentile(m, 0.5).over(stage) for m in measures})
    whole = [
        F.sum("tasks").alias("stage_tasks"), F.sum("bytes").alias("stage_bytes"),
        F.collect_list(F.struct("executor_id", "tasks", "bytes")).alias("executors"),
    ]
    known = [F.first(name).alias(name) for name in medians]
    near = _by_stage(_totals(dealt, keys, known), keys, measures, [*whole, *known])
    counted = value_counts(_long(big, keys, measures, "value"), [*keys, "measure"], "value")
    far = quantiles_of_counts(counted, [*keys, "measure"], {"median": 0.5}).groupBy(*keys).agg(
        *[F.max(F.when(F.col("measure") == m, F.col("median"))).alias(f"median_{m}") for m in measures]
    )
    return near.unionByName(_by_stage(_totals(big, keys), keys, measures, whole).join(far, keys, "left").select(*near.columns))


def _spread_rows(spreads: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """``stage_spreads`` as a row per stage and measure; a stage without a key has no distribution."""
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"median_{m}").alias("median"), *[F.col(m)[f].alias(f) for f in SPREAD_FIELDS]) for m in measures])
    return spreads.dropna(subset=list(keys)).select(*keys, F.inline(each)).where("n > 0")


def _shares_of_spreads(spreads: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows of ``executor_shares`` but for ``duration_sum``."""
    rows = spreads.select(*by, "stage_id", "stage_bytes", "stage_tasks", F.inline("executors"))
    return rows.withColumn("share", _share("stage_bytes"))


def _share(total: str) -> Column:
    of = F.col(total)
    return F.when(of > 0, F.col("bytes").cast("double") / F.nullif(of, F.lit(0)).cast("double")).otherwise(F.lit(0.0))


def _medians(tasks: DataFrame, sizes: DataFrame, keys: Sequence[str], measures: Sequence[str], large: int) -> DataFrame:
    """Medians by stage and measure: one buffer for a stage of modest size, counted values beyond it."""
    small, big = parted(tasks.select(*keys, *_measured(measures)), sizes, keys, large)
    buffered = _long(small.repartition(*keys).groupBy(*keys).agg(*[F.percentile(m, 0.5).alias(m) for m in measures]), keys, measures, "median")
    counted = value_counts(_long(big, keys, measures, "value"), [*keys, "measure"], "value")
    return buffered.unionByName(quantiles_of_counts(counted, [*keys, "measure"], {"median": 0.5}).drop("n"))


def _medians_of_counts(counts: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same from counted values."""
    small, big = parted(counts, sizes, keys)
    buffered = small.repartition(*keys).groupBy(*keys, "measure").agg(F.percentile("value", 0.5, F.col("times")).alias("median"))
    return buffered.unionByName(quantiles_of_counts(big, [*keys, "measure"], {"median": 0.5}).drop("n"))


def distributions(
    tasks: DataFrame | None,
    by: Sequence[str] = (),
    measures: Sequence[str] = MEASURES,
    positive_mean: bool = True,
    totals: DataFrame | None = None,
    counts: DataFrame | None = None,
    large: int = LARGE_GROUP,
    spreads: DataFrame | None = None,
) -> DataFrame:
    """Per stage and measure: ``n, mean, cv, median, max_val, max_median_ratio`` and the
    task with the largest value (``task_id``, its ``task_bytes``).

    Stages with fewer than two values or a mean of zero or less have no distribution; with
    ``positive_mean=False`` the latter are kept, with ``cv`` 0.  Tasks are read for what is not
    given: ``stage_spreads`` hold all of it; ``executor_totals`` tell the moments and the sizes, and
    ``measure_counts`` the medians.
    """
    keys = [*by, "stage_id"]
    if totals is None and counts is None:
        rows = _spread_rows(stage_spreads(tasks, by, measures, large) if spreads is None else spreads, keys, measures)
    else:
        totals = executor_totals(tasks, by) if totals is None else totals
        sizes = totals.groupBy(*keys).agg(F.sum("tasks").alias("n"))
        moments = _moments(totals, keys, measures)
        if counts is None:
            medians = _medians(tasks, sizes, keys, measures, large)
        else:
            medians = _medians_of_counts(counts.where(F.col("measure").isin(*measures)), sizes, keys)
        rows = moments.join(medians, [*keys, "measure"])
    positive = F.col("mean") > 0
    ratio = F.when(
        F.col("median") > 0, F.col("max").cast("double") / F.nullif(F.col("median"), F.lit(0.0))
    ).otherwise(F.lit(0.0))
    cv = F.when(positive, F.col("sd") / F.nullif(F.col("mean"), F.lit(0.0))).otherwise(F.lit(0.0))
    return rows.where((F.col("n") >= 2) & (positive if positive_mean else F.lit(True))).select(
        *keys, "measure", "n", "mean", cv.alias("cv"), "median", F.col("max").alias("max_val"),
        ratio.alias("max_median_ratio"), F.col("top").alias("task_id"), F.col("bytes").alias("task_bytes"),
    )


def skew_severity(cv: str, ratio: str) -> str:
    """CRIT, WARN or NULL."""
    return (
        f"CASE WHEN {cv} > {CV_CRIT} OR {ratio} > {RATIO_CRIT} THEN '{M.CRIT}'"
        f" WHEN {cv} > {CV_WARN} OR {ratio} > {RATIO_WARN} THEN '{M.WARN}' END"
    )


def skewed(dists: DataFrame) -> DataFrame:
    """Distributions that count as skew, with their severity and category."""
    category = _by_measure(f"'{M.DATA_SKEW}'", f"'{M.SIZE_SKEW}'", f"'{M.RECORD_SKEW}'")
    return (
        dists.withColumns(
            {
                "severity": F.expr(skew_severity("cv", "max_median_ratio")),
                "category": F.expr(category),
            }
        )
        .where("severity IS NOT NULL")
        .where(f"measure <> 'records' OR max_val > {RECORD_SKEW_MIN_MAX}")
    )


def executor_shares(tasks: DataFrame | None, by: Sequence[str] = (), totals: DataFrame | None = None) -> DataFrame:
    """Per stage and executor: tasks, bytes, share of the stage's bytes, stage totals.

    The window runs over one row per executor of a stage, not over tasks.
    """
    per_executor = (executor_totals(tasks, by) if totals is None else totals).select(
        *by, "stage_id", "executor_id", "tasks", "bytes", "duration_sum"
    )
    stage = Window.partitionBy(*by, "stage_id")
    total = F.sum("bytes").over(stage)
    return per_executor.select(
        "*",
        total.alias("stage_bytes"),
        F.sum("tasks").over(stage).alias("stage_tasks"),
    ).withColumn("share", _share("stage_bytes"))


def slowest_tasks(tasks: DataFrame, by: Sequence[str] = (), totals: DataFrame | None = None) -> DataFrame:
    """The slowest task of each stage and its executor; the larger task id wins a tie."""
    per_executor = executor_totals(tasks, by) if totals is None else totals
    return (
        per_executor.groupBy(*by, "stage_id")
        .agg(F.max("slowest").alias("packed"), F.max_by("executor_id", "slowest").alias("executor_id"))
        .select(
            *by, "stage_id", _task_id_of(F.col("packed")).alias("task_id"), "executor_id"
        )
    )


def hotspots(
    tasks: DataFrame | None, by: Sequence[str] = (), totals: DataFrame | None = None, spreads: DataFrame | None = None
) -> DataFrame:
    """Executors that read more than half of a stage's bytes (stages of two tasks or more)."""
    shares = executor_shares(tasks, by, totals) if spreads is None else _shares_of_spreads(spreads, by)
    return shares.where(
        (F.col("stage_tasks") >= 2) & (F.col("stage_bytes") > 0) & (F.col("share") > HOT_SHARE)
    )


# ---------------------------------------------------------------------------
# Findings
# ---------------------------------------------------------------------------
def _by_measure(duration: str, size: str, records: str) -> str:
    return f"CASE measure WHEN 'duration' THEN {duration} WHEN 'size' THEN {size} ELSE {records} END"


def _skew_texts() -> tuple[str, str, str]:
    label = _by_measure(*[lit(text) for text in SKEW_LABELS.values()])
    title = fill(SKEW_TITLE, label, fixed("cv", 1), fixed("max_median_ratio", 1))
    middle = "cast(median as bigint)"
    detail = _by_measure(
        fill(SKEW_DETAILS["duration"], "task_id", duration_text("max_val"),
             duration_text(middle), bytes_text("task_bytes")),
        fill(SKEW_DETAILS["size"], "task_id", bytes_text("max_val"),
             bytes_text(middle), bytes_text("max_val")),
        fill(SKEW_DETAILS["records"], "task_id", "max_val",
             whole("median"), whole("max_val")),
    )
    return title, detail, _by_measure(lit(DURATION_ADVICE), lit(SIZE_ADVICE), lit(RECORD_ADVICE))


def with_links(found: DataFrame, names: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add job, SQL and stage name; task findings carry no I/O text, pattern or savings."""
    nothing = F.lit(None).cast("string")
    linked = found.join(names, [*by, "stage_id"], "left")
    return as_suspects(
        linked.withColumns(
            {
                "io_summary": nothing,
                "bottleneck": nothing,
                "estimated_savings_ms": F.lit(0).cast("bigint"),
            }
        ),
        by,
    )


def stage_names(stages: DataFrame, links: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per stage id: name (of the last attempt), job, SQL execution, plan hint."""
    last_name = F.max_by("name", "attempt_id").alias("stage_name")
    return (
        stages.groupBy(*by, "stage_id")
        .agg(last_name)
        .join(
            links.select(*by, "stage_id", "job_id", "sql_id", "sql_description", "sql_plan_hint"),
            [*by, "stage_id"],
            "left",
        )
    )


def skew_rows(dists: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Skew findings by stage, without the names and links of the stage."""
    title, detail, advice = _skew_texts()
    return skewed(dists).selectExpr(
        *by, "severity", "category", "stage_id", f"{title} AS title", f"{detail} AS detail",
        f"{advice} AS recommendation",
    )


def skew_findings(dists: DataFrame, names: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return with_links(skew_rows(dists, by), names, by)


def hotspot_rows(
    tasks: DataFrame | None, by: Sequence[str] = (), totals: DataFrame | None = None, spreads: DataFrame | None = None
) -> DataFrame:
    """Hotspot findings by stage, without the names and links of the stage."""
    share = percent("share")
    title = fill(HOT_TITLE, "executor_id", share)
    detail = fill(
        HOT_DETAIL,
        "executor_id", bytes_text("bytes"), share, bytes_text("stage_bytes"), "tasks",
    )
    return hotspots(tasks, by, totals, spreads).selectExpr(
        *by, f"'{M.WARN}' AS severity", f"'{M.EXEC_HOTSPOT}' AS category", "stage_id",
        f"{title} AS title", f"{detail} AS detail", f"{lit(HOTSPOT_ADVICE)} AS recommendation",
    )


def hotspot_findings(
    tasks: DataFrame | None, names: DataFrame, by: Sequence[str] = (), totals: DataFrame | None = None, spreads: DataFrame | None = None
) -> DataFrame:
    return with_links(hotspot_rows(tasks, by, totals, spreads), names, by)


def task_findings(
    tasks: DataFrame, names: DataFrame, by: Sequence[str] = (), measures: Sequence[str] = MEASURES
) -> DataFrame:
    """Skew in duration, size and records, and executor hotspots."""
    return skew_findings(distributions(tasks, by, measures), names, by).unionByName(
        hotspot_findings(tasks, names, by)
    )


def stages_worth_task_analysis(
    stages: DataFrame, by: Sequence[str] = (), cap: int | None = STAGE_CAP
) -> DataFrame:
    """Stages to look at first: top by run time, top by shuffle write, many tasks.

    A stage counts with the attempt that won its place: by run time first, then by shuffle
    write, then the first attempt with many tasks.  The cap belongs to the report; ties are
    cut by run time, then stage id.  ``cap=None`` keeps all.
    """
    ended = stages.where(F.col("status").isin(M.STAGE_COMPLETE, M.STAGE_FAILED)).select(
        *by, "stage_id", "attempt_id", "executor_run_time", "shuffle_write_bytes", "num_tasks"
    )
    tie = [F.col("stage_id"), F.col("attempt_id")]
    by_run = top_rows(ended, by, [F.col("executor_run_time").desc(), *tie], TOP_STAGES)
    by_shuffle = top_rows(ended, by, [F.col("shuffle_write_bytes").desc(), *tie], TOP_STAGES).where(
        "shuffle_write_bytes > 0"
    )
    many = ended.where(F.col("num_tasks") > MANY_TASKS).withColumn("row_no", F.col("attempt_id").cast("int"))
    listed = [df.withColumn("list_no", F.lit(i)) for i, df in enumerate((by_run, by_shuffle, many))]
    picked = (
        listed[0].unionByName(listed[1]).unionByName(listed[2])
        .groupBy(*by, "stage_id")
        .agg(
            F.min_by("attempt_id", F.struct("list_no", "row_no")).alias("attempt_id"),
            F.max("executor_run_time").alias("executor_run_time"),
        )
    )
    if cap is None:
        return picked.select(*by, "stage_id", "attempt_id")
    order = [F.col("executor_run_time").desc(), F.col("stage_id")]
    return top_rows(picked, by, order, cap).select(*by, "stage_id", "attempt_id")
