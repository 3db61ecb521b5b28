"""One registered query per operator, each over the whole derived telemetry."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscope import fixtures as X
from emberscope import model as M
from emberscope.functions import plan_text, texts, times
from emberscope.operators import linking, reports, stage_rules, task_rules
from emberscope.plans import analysis
from emberscope.sources import event_log as log
from emberscope.sources import rest_snapshot, store
from emberscope.sources.tailing import tail_lines
from emberscope.streaming import batches, live
from emberscope.workspace import new_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def register(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _total(value: str) -> Column:
    """The exact sum of an integer column; NULL where no bigint holds it (sums of bigints would fail there)."""
    return F.sum(F.expr(value).cast("decimal(20,0)")).try_cast("bigint")


def _fleet(spark, sf_dir) -> M.Telemetry:
    return X.fleet(X.telemetry(spark, sf_dir))


def _context(spark, sf_dir, by=()) -> DataFrame:
    t = _fleet(spark, sf_dir) if by else X.telemetry(spark, sf_dir)
    return analysis.inputs_of(t, by).context


FINDING = ("stage_id", "job_id", "sql_id", "severity", "category", "bottleneck", "estimated_savings_ms", "title")


# -- stage rules ---------------------------------------------------------------------------
def _rule_query(*rules: str) -> Query:
    def run(spark, sf_dir):
        picked = [stage_rules.ROW_RULES[r] for r in rules]
        return stage_rules.stage_findings(_context(spark, sf_dir), picked).select(*FINDING)

    return run


for _name, _rules in {
    "d1_slow_stage": ("slow_stage",),
    "d2_disk_spill": ("disk_spill",),
    "d3_io_bound": ("io_bound",),
    "d4_cpu_bound": ("cpu_bound",),
    "d5_record_explosion": ("record_explosion",),
    "d6_task_failures": ("task_failures",),
    "d7_memory_pressure": ("memory_pressure",),
    "d8_partition_count": ("too_many_partitions", "too_few_partitions"),
    "d9_broadcast_join": ("broadcast_join",),
    "d10_python_udf": ("python_udf",),
}.items():
    QUERIES[_name] = _rule_query(*_rules)


@register("d1_slow_stage_by_app")
def _(spark, sf_dir):
    context = _context(spark, sf_dir, ["app_id"])
    return stage_rules.stage_findings(context, [stage_rules.slow_stage], ["app_id"]).select("app_id", *FINDING)


@register("d11_bottleneck")
def _(spark, sf_dir):
    stages = X.telemetry(spark, sf_dir).stages
    return stages.selectExpr("stage_id", f"{stage_rules.bottleneck()} AS bottleneck")


@register("d12_remedy")
def _(spark, sf_dir):
    return X.telemetry(spark, sf_dir).stages.selectExpr(
        "stage_id", f"{stage_rules.remedy(stage_rules.bottleneck())} AS remedy"
    ).where("remedy IS NOT NULL")


@register("d13_io_summary")
def _(spark, sf_dir):
    return X.telemetry(spark, sf_dir).stages.selectExpr(
        "stage_id", f"{stage_rules.io_summary()} AS io_summary"
    )


@register("d14_cache_opportunity")
def _(spark, sf_dir):
    return stage_rules.cache_opportunities(_context(spark, sf_dir)).select(*FINDING)


@register("d_details")
def _(spark, sf_dir):
    """Detail texts of all stage rules and of repeated stages."""
    inputs = analysis.inputs_of(X.telemetry(spark, sf_dir))
    found = analysis.row_findings(inputs).unionByName(analysis.repeated_stages(inputs))
    return found.select("stage_id", "category", "detail")


@register("x1_custom_detector")
def _(spark, sf_dir):
    """The registry with a user's own rule: stages that write more than they read."""

    def writes_more() -> stage_rules.Finding:
        return stage_rules.Finding(
            category="Heavy Write",
            fires="shuffle_write_bytes > input_bytes",
            title=texts.fill("Stage {} writes more than it reads", "stage_id"),
            detail="''",
            recommendation="''",
            savings="cast(0 as bigint)",
        )

    own = {"heavy_write": lambda i: stage_rules.stage_findings(i.context, [writes_more], i.by)}
    found = analysis.find_suspects(X.telemetry(spark, sf_dir), detectors=own)
    return found.select("stage_id", "job_id", "severity", "category", "title")


# -- task rules ----------------------------------------------------------------------------
@register("k1_distribution")
def _(spark, sf_dir):
    dists = task_rules.distributions(X.task_table(spark, sf_dir))
    return _round(
        dists.select("stage_id", "measure", "n", "cv", "max_median_ratio", "median", "max_val"),
        "cv", "max_median_ratio",
    )


@register("k1_distribution_by_app")
def _(spark, sf_dir):
    dists = task_rules.distributions(_fleet(spark, sf_dir).tasks, ["app_id"], ["size"])
    return _round(dists.select("app_id", "stage_id", "n", "cv", "median", "max_val"), "cv")


@register("k1_one_stage")
def _(spark, sf_dir):
    """All tasks as one stage whose durations are nanoseconds: the way for large groups."""
    tasks = X.task_table(spark, sf_dir).withColumns(
        {"stage_id": F.expr("stage_id % 1"), "duration": F.expr("1000000000000 + duration * 1003 + task_id % 1000")}
    )
    dists = task_rules.distributions(tasks, (), ["duration"], large=0)
    return _round(dists.select("stage_id", "n", "cv", "median", "max_val"), "cv")


@register("k2_skew_severity")
def _(spark, sf_dir):
    dists = task_rules.distributions(X.task_table(spark, sf_dir))
    severity = F.expr(task_rules.skew_severity("cv", "max_median_ratio"))
    return dists.groupBy("measure", severity.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def _skew_query(measure: str) -> Query:
    def run(spark, sf_dir):
        found = task_rules.skewed(task_rules.distributions(X.task_table(spark, sf_dir), (), [measure]))
        return found.select("stage_id", "severity", "category", "task_id", "task_bytes", "median", "max_val")

    return run


QUERIES["k3_data_skew"] = _skew_query("duration")
QUERIES["k4_size_skew"] = _skew_query("size")
QUERIES["k5_record_skew"] = _skew_query("records")


@register("k6_executor_hotspot")
def _(spark, sf_dir):
    found = task_rules.hotspots(X.task_table(spark, sf_dir))
    return _round(found.select("stage_id", "executor_id", "bytes", "share", "tasks"), "share")


@register("k7_task_analysis_stages")
def _(spark, sf_dir):
    return task_rules.stages_worth_task_analysis(X.with_attempts(X.telemetry(spark, sf_dir).stages))


@register("k7_task_analysis_stages_uncapped")
def _(spark, sf_dir):
    return task_rules.stages_worth_task_analysis(X.with_attempts(X.telemetry(spark, sf_dir).stages), cap=None)


@register("k7_task_analysis_stages_by_app")
def _(spark, sf_dir):
    return task_rules.stages_worth_task_analysis(X.with_attempts(_fleet(spark, sf_dir).stages), ["app_id"])


@register("k7_chosen_tasks")
def _(spark, sf_dir):
    """Tasks of the stages chosen for task analysis, the others not read."""
    t, path = X.telemetry(spark, sf_dir), new_folder(spark, "tasks-by-stage")
    store.write_tasks_by_stage(t.tasks, path)
    chosen = task_rules.stages_worth_task_analysis(X.with_attempts(t.stages)).select("stage_id")
    return store.read_tasks_of(spark, path, chosen).groupBy("stage_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration").alias("duration_sum")
    )


@register("k_titles")
def _(spark, sf_dir):
    """Titles and details of all task findings."""
    inputs = analysis.inputs_of(X.telemetry(spark, sf_dir))
    found = task_rules.task_findings(inputs.telemetry.tasks, inputs.names)
    return found.select("stage_id", "category", "title", "detail", "stage_name", "sql_plan_hint")


# -- linking -------------------------------------------------------------------------------
@register("l1_job_to_sql")
def _(spark, sf_dir):
    return linking.job_to_sql(X.telemetry(spark, sf_dir).sql_jobs)


@register("l2_stage_to_job")
def _(spark, sf_dir):
    return linking.stage_to_job(X.telemetry(spark, sf_dir).job_stages)


@register("l3_job_sql")
def _(spark, sf_dir):
    t = X.telemetry(spark, sf_dir)
    return linking.job_sql(t.jobs, t.sql_jobs, t.sql_executions).select("job_id", "sql_id", "sql_description")


@register("l4_plan_hint")
def _(spark, sf_dir):
    return linking.plan_hints(*_link_tables(X.telemetry(spark, sf_dir)))


@register("l4_plan_hint_lenient")
def _(spark, sf_dir):
    return linking.plan_hints(*_link_tables(X.telemetry(spark, sf_dir)), strict=False)


def _link_tables(t: M.Telemetry):
    return t.stages, t.job_stages, t.sql_jobs, t.sql_executions


@register("l5_stage_context")
def _(spark, sf_dir):
    return linking.stage_context(*_link_tables(X.telemetry(spark, sf_dir))).select(
        "stage_id", "job_id", "sql_id", "sql_description", "io_summary", "sql_plan_hint", "bottleneck"
    )


# -- ranking, summary ----------------------------------------------------------------------
@register("r1_suspects")
def _(spark, sf_dir):
    found = store.written(analysis.find_suspects(X.telemetry(spark, sf_dir)), "findings")
    return reports.rank_suspects(found.select(*FINDING)).select("rank", *FINDING)


@register("r1_suspects_by_app")
def _(spark, sf_dir):
    found = store.written(analysis.find_suspects(_fleet(spark, sf_dir), ["app_id"]), "findings")
    return reports.rank_suspects(found.select("app_id", *FINDING), ["app_id"]).select("app_id", "rank", *FINDING)


@register("r2_ranked_jobs")
def _(spark, sf_dir):
    t = X.telemetry(spark, sf_dir)
    return reports.rank_jobs(t.jobs, t.sql_jobs, t.sql_executions).select(
        "rank", "job_id", "name", "status", "duration_ms", "num_tasks", "num_failed_tasks", "sql_id",
        "sql_description",
    )


@register("r3_critical_stages")
def _(spark, sf_dir):
    t = X.telemetry(spark, sf_dir)
    return reports.critical_stages(t.stages, t.job_stages)


@register("r4_health")
def _(spark, sf_dir):
    return analysis.analyze(X.telemetry(spark, sf_dir)).health


@register("r4_health_by_app")
def _(spark, sf_dir):
    return analysis.analyze(_fleet(spark, sf_dir), ["app_id"]).health


@register("r5_stage_hints")
def _(spark, sf_dir):
    hints = analysis.analyze(X.telemetry(spark, sf_dir), store_findings=False).stage_hints
    return hints.groupBy("sql_plan_hint").agg(F.count(F.lit(1)).alias("stages"))


@register("r6_report_sizes")
def _(spark, sf_dir):
    """Rows of every table of the assembled report."""
    sizes = None
    for name, df in analysis.analyze(X.telemetry(spark, sf_dir)).tables().items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        sizes = part if sizes is None else sizes.unionByName(part)
    return sizes


@register("r6_report_contents")
def _(spark, sf_dir):
    """What the tables of the assembled report hold, by category, status, stage and hint."""
    tables = analysis.analyze(X.telemetry(spark, sf_dir)).tables()
    parts = {
        "suspects": ("concat(severity, ' ', category)", "estimated_savings_ms"), "jobs": ("status", "job_id"),
        "critical_stages": ("'critical'", "stage_id"), "stage_hints": ("sql_plan_hint", "stage_id"),
    }
    sums = [
        tables[name].groupBy(F.expr(key).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.lit(name).alias("table_name"), "part", "n", "total")
        for name, (key, value) in parts.items()
    ]
    return reduce(DataFrame.unionByName, sums)


# -- views ---------------------------------------------------------------------------------
def _jobs(t: M.Telemetry) -> DataFrame:
    return reports.job_rows(t.jobs, t.sql_jobs, t.sql_executions)


@register("v1_jobs_report")
def _(spark, sf_dir):
    return reports.jobs_report(_jobs(X.telemetry(spark, sf_dir)))


@register("v2_job_detail")
def _(spark, sf_dir):
    t = X.telemetry(spark, sf_dir)
    critical = reports.critical_stages(t.stages, t.job_stages)
    return reports.job_detail(_jobs(t), t.stages, t.job_stages, critical).drop("attempt_id")


@register("v3_suspect_detail")
def _(spark, sf_dir):
    t = X.telemetry(spark, sf_dir)
    critical = reports.critical_stages(t.stages, t.job_stages)
    return reports.suspect_detail(analysis.find_suspects(t), _jobs(t), critical)


@register("v4_sql_recommendations")
def _(spark, sf_dir):
    found = store.written(analysis.find_suspects(X.telemetry(spark, sf_dir)), "findings")
    return reports.sql_recommendations(found)


@register("v5_stage_header")
def _(spark, sf_dir):
    t = X.telemetry(spark, sf_dir)
    hints = linking.plan_hints(*_link_tables(t))
    cluster = reports.cluster_resources(t.executors)
    return reports.stage_headers(t.stages, t.tasks, hints, cluster).drop("attempt_id")


@register("v6_duration_profile")
def _(spark, sf_dir):
    return _round(reports.duration_profile(X.task_table(spark, sf_dir)), "median", "p90", "p99")


@register("v7_duration_histogram")
def _(spark, sf_dir):
    return _round(reports.duration_histogram(X.task_table(spark, sf_dir)), "lo", "hi")


@register("v8_executor_breakdown")
def _(spark, sf_dir):
    return _round(reports.executor_breakdown(X.task_table(spark, sf_dir)), "pct")


@register("v9_peak_memory")
def _(spark, sf_dir):
    return reports.peak_memory(X.task_table(spark, sf_dir))


@register("v10_skew_metrics")
def _(spark, sf_dir):
    return _round(reports.skew_metrics(X.task_table(spark, sf_dir)), "cv", "max_median_ratio")


@register("v11_health_bands")
def _(spark, sf_dir):
    t = X.telemetry(spark, sf_dir)
    return reports.health_bands(t.stages, reports.cluster_resources(t.executors)).drop("attempt_id")


@register("v12_summary_lines")
def _(spark, sf_dir):
    return reports.health_lines(analysis.analyze(X.telemetry(spark, sf_dir)).health)


@register("v13_merge_snapshots")
def _(spark, sf_dir):
    """An old snapshot of all tasks with a newer one of every third stage, doubled in time."""
    old = X.task_table(spark, sf_dir)
    new = old.where("stage_id % 3 = 0 and status = 'SUCCESS'").withColumn("duration", F.col("duration") * 2)
    merged = reports.merge_task_snapshots(old, new)
    return merged.groupBy("stage_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration").alias("duration_sum")
    )


@register("v13_bucketed_snapshots")
def _(spark, sf_dir):
    """The same with the old snapshot as a bucketed table, which is not shuffled."""
    tasks, name = X.task_table(spark, sf_dir), f"tasks_{uuid.uuid4().hex}"
    store.write_task_table(tasks, name, new_folder(spark, "task-table"))
    new = tasks.where("stage_id % 3 = 0 and status = 'SUCCESS'").withColumn("duration", F.col("duration") * 2)
    return store.merged_task_table(spark, name, new).groupBy("stage_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration").alias("duration_sum")
    )


@register("v14_plan_operators")
def _(spark, sf_dir):
    return reports.plan_operator_census(X.telemetry(spark, sf_dir).sql_executions)


@register("v14_plan_numbers")
def _(spark, sf_dir):
    return reports.plan_tokens(X.telemetry(spark, sf_dir).sql_executions).where("kind = 'number'").select(
        "sql_id", "token", "n"
    )


@register("v14_plan_tokens")
def _(spark, sf_dir):
    return reports.plan_tokens(X.telemetry(spark, sf_dir).sql_executions).where("kind = 'column'").select(
        "sql_id", "token", "n"
    )


# -- functions -----------------------------------------------------------------------------
@register("f_format")
def _(spark, sf_dir):
    """Every text function over the measures of all stages."""
    columns = {
        "run_text": texts.duration_text("executor_run_time"),
        "short_text": texts.duration_text("executor_run_time % 70000 - 5"),
        "input_text": texts.bytes_text("input_bytes"),
        "small_bytes_text": texts.bytes_text("stage_id * stage_id - 9"),
        "write_text": texts.bytes_or_dash("shuffle_write_bytes"),
        "records_text": texts.count_text("output_records"),
        "small_count_text": texts.count_text("stage_id - 1"),
        "short_name": texts.shorten("name", 12),
        "one_line": texts.one_line("concat(name, '\\n\\tx')"),
        "printable": texts.printable("concat(name, '\\t', char(7), 'x\\r\\n')"),
        "label": texts.stage_label("name"),
        "clock": times.clock_text("submission_time"),
        "cpu_ratio": f"round({texts.cpu_ratio('executor_cpu_time', 'executor_run_time')}, 6)",
    }
    stages = X.telemetry(spark, sf_dir).stages
    return stages.selectExpr("stage_id", *[f"{text} AS {name}" for name, text in columns.items()])


@register("f9_plan_operators")
def _(spark, sf_dir):
    sqls = X.telemetry(spark, sf_dir).sql_executions
    names = plan_text.top_operators("plan_description", 5)
    return sqls.selectExpr("id AS sql_id", f"posexplode({names}) AS (position, operator)").withColumn(
        "position", F.col("position").cast("bigint")
    )


@register("f10_parse_time")
def _(spark, sf_dir):
    """Event times written in the accepted forms and one that is not, parsed again."""
    form = (
        "CASE event_id % 6 WHEN 0 THEN concat(day, 'T', clock, 'Z') WHEN 1 THEN concat(day, 'T', clock, '+02:00')"
        " WHEN 2 THEN concat(day, ' ', clock, '-0330') WHEN 3 THEN concat(day, 'T', clock, 'GMT')"
        " WHEN 4 THEN concat(day, 'T', left(clock, 8)) ELSE day END"
    )
    written = X.source(spark, sf_dir, "events").selectExpr(
        "event_id", "date_format(ts, 'yyyy-MM-dd') AS day", "date_format(ts, 'HH:mm:ss.SSS') AS clock"
    )
    parsed = written.selectExpr("event_id", f"{form} AS text").selectExpr(
        "event_id", f"{times.parse_time('text')} AS ts"
    )
    return parsed.selectExpr(
        "event_id", "unix_millis(ts) AS ms",
        f"{times.elapsed_ms('ts', 'timestamp_millis(1893456000000)')} AS to_2030",
    )


# -- sources, event tables -----------------------------------------------------------------
@register("s1_event_log_scan")
def _(spark, sf_dir):
    return log.event_counts(X.staged_events(spark, sf_dir))


@register("s2_compressed_log")
def _(spark, sf_dir):
    """The same log gzip-compressed, half of it without a suffix, read without staging."""
    lines = log.read_lines(spark, X.bare_gzip_log(spark, sf_dir))
    return log.event_counts(log.parse_lines(lines))


@register("s3_largest_log_file")
def _(spark, sf_dir):
    """Jobs and stages of the larger log of each application, and which one a search finds first."""
    root = X.logs_by_application(spark, sf_dir)
    folder = r"/app=([^/]+)/"
    first = F.regexp_extract(F.lit(log.discover_event_log(spark, root)), folder, 1)
    events = log.read_events(spark, root, pick="largest")
    files = log.largest_per_folder(spark, root).select(F.regexp_extract("path", folder, 1).alias("app"))
    counted = events.groupBy(F.regexp_extract("app_key", folder, 1).alias("app")).agg(
        F.count_if(F.col("kind") == "job_start").alias("jobs"),
        F.count_if(F.col("kind") == "stage_submitted").alias("stages"),
        F.count_distinct("app_key").alias("logs"),
    )
    return files.join(counted, "app").withColumn("is_first", F.col("app") == first)


@register("s4_first_log")
def _(spark, sf_dir):
    """The first of several roots that holds an application; one is damaged, one is missing."""
    roots = [X.damaged_log(spark, sf_dir), "/no/such/folder", X.event_log(spark, sf_dir)]
    unreadable: list[tuple[str, str]] = []
    t = log.load_first(spark, roots, unreadable=unreadable)
    counted = t.jobs.groupBy("app_id", "status").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("unreadable", F.lit(len(unreadable)).cast("bigint"))


@register("s5_rest_snapshot")
def _(spark, sf_dir):
    t = rest_snapshot.read_snapshot(spark, X.rest_snapshot(spark, sf_dir), json_lines=True)
    critical = reports.critical_stages(t.stages, t.job_stages, ["app_id"])
    jobs = reports.job_rows(t.jobs, t.sql_jobs, t.sql_executions, ["app_id"])
    own = t.job_stages.join(critical, ["app_id", "stage_id"]).groupBy("app_id", "job_id").agg(
        F.count(F.lit(1)).alias("critical_stages")
    )
    return jobs.join(own, ["app_id", "job_id"], "left").select(
        "app_id", "job_id", "status", "duration_ms", "sql_id", F.coalesce("critical_stages", F.lit(0)).alias("critical_stages")
    )


@register("s6_rest_tasks")
def _(spark, sf_dir):
    t = rest_snapshot.read_snapshot(spark, X.rest_snapshot(spark, sf_dir), json_lines=True)
    return log.stage_metrics(t.tasks)


@register("s6_rest_array_tasks")
def _(spark, sf_dir):
    """The same from one JSON array a file, cut between elements."""
    t = rest_snapshot.read_snapshot(spark, X.rest_arrays(spark, sf_dir))
    return log.stage_metrics(t.tasks)


@register("s5_rest_arrays")
def _(spark, sf_dir):
    """Jobs, stages and SQL executions of a snapshot of arrays, with their sums."""
    t = rest_snapshot.read_snapshot(spark, X.rest_arrays(spark, sf_dir)).tables()
    ids = {"jobs": "job_id", "stages": "stage_id", "sql_executions": "id", "sql_jobs": "job_id", "job_stages": "stage_id", "tasks": "task_id"}
    sizes = [
        t[name].agg(F.count(F.lit(1)).alias("n"), _total(column).alias("total")).select(F.lit(name).alias("table_name"), "n", "total")
        for name, column in ids.items()
    ]
    return reduce(DataFrame.unionByName, sizes)


@register("s6_broken_answers")
def _(spark, sf_dir):
    """Rows and broken rows of each saved answer, and what is left of them."""
    root = X.broken_rest(spark, sf_dir)
    left = rest_snapshot.read_snapshot(spark, root, json_lines=True)
    kept = left.jobs.agg(F.count(F.lit(1)).alias("kept")).select(F.lit("jobs.json").alias("answer"), "kept").unionByName(
        left.stages.agg(F.count(F.lit(1)).alias("kept")).select(F.lit("stages.json").alias("answer"), "kept")
    )
    return rest_snapshot.broken_rows(spark, root, json_lines=True).join(kept, "answer")


@register("s7_rest_without_sql")
def _(spark, sf_dir):
    """A snapshot without optional answers gives empty tables."""
    t = X.telemetry(spark, sf_dir)
    root = new_folder(spark, "rest-jobs")
    t.jobs.select(F.col("job_id").alias("jobId"), "name", "status").write.json(f"{root}/app-1/jobs.json")
    t.stages.select(F.col("stage_id").alias("stageId"), "name", "status").write.json(f"{root}/app-1/stages.json")
    found = rest_snapshot.read_snapshot(spark, root, json_lines=True)
    sizes = None
    for name, df in found.tables().items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        sizes = part if sizes is None else sizes.unionByName(part)
    return sizes


@register("s8_store")
def _(spark, sf_dir):
    """All telemetry tables and a report written to the store, partitioned by application, and read back."""
    t = _fleet(spark, sf_dir)

    def complete(name: str, df: DataFrame) -> DataFrame:
        return df.select(
            *[
                F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
                for f in M.TABLE_SCHEMAS[name].fields
            ]
        )

    path = new_folder(spark, "store")
    store.write_telemetry(t.map(complete), path)
    back = store.read_telemetry(spark, path)
    report = analysis.analyze(t, ["app_id"])
    store.write_report({"suspects": report.found, "health": report.health}, f"{path}/report", "derived")
    shown = {**back.tables(), "suspects": spark.read.parquet(f"{path}/report/suspects"), "suspects_json": spark.read.json(f"{path}/report/suspects_json")}
    shown["health"] = spark.read.parquet(f"{path}/report/health")
    measures = {
        "tasks": "task_id", "stages": "stage_id", "jobs": "job_id", "job_stages": "stage_id", "sql_executions": "id",
        "sql_jobs": "job_id", "executors": "total_cores", "suspects": "estimated_savings_ms", "suspects_json": "estimated_savings_ms", "health": "0",
    }
    sizes = [
        shown[name].groupBy("app_id").agg(F.count(F.lit(1)).alias("n"), _total(value).alias("total"))
        .select(F.lit(name).alias("table_name"), "app_id", "n", "total")
        for name, value in measures.items()
    ]
    return reduce(DataFrame.unionByName, sizes)


def _logged(spark, sf_dir) -> M.Telemetry:
    return log.telemetry_of(X.staged_events(spark, sf_dir))


@register("p1_applications")
def _(spark, sf_dir):
    """Jobs per application of three logs: two attempts of one id, and one without an id."""
    t = log.read_event_log(spark, X.logs_of_attempts(spark, sf_dir))
    short = F.regexp_replace("app_id", r"^.*/eventlog_v2_", "log ")
    return t.jobs.groupBy(short.alias("app_id")).agg(F.count(F.lit(1)).alias("jobs"), F.sum("job_id").alias("job_ids"))


@register("p2_jobs")
def _(spark, sf_dir):
    return _logged(spark, sf_dir).jobs.select(
        "app_id", "job_id", "name", "status", F.unix_millis("submission_time").alias("submission_ms"),
        F.unix_millis("completion_time").alias("completion_ms"), "num_tasks", "num_completed_tasks",
        "num_failed_tasks",
    )


@register("p2_job_stages")
def _(spark, sf_dir):
    return _logged(spark, sf_dir).job_stages


@register("p6_stages")
def _(spark, sf_dir):
    return _logged(spark, sf_dir).stages.select(
        "app_id", "stage_id", "attempt_id", "status", "name", "num_tasks",
        F.unix_millis("submission_time").alias("submission_ms"),
        F.unix_millis("completion_time").alias("completion_ms"),
    )


@register("p7_tasks")
def _(spark, sf_dir):
    return _logged(spark, sf_dir).tasks.select(
        "app_id", "stage_id", "task_id", "task_index", "executor_id", "host", "status", "duration",
        "executor_cpu_time", "shuffle_read_bytes", F.unix_millis("finish_time").alias("finish_ms"),
    )


@register("p8_stage_metrics")
def _(spark, sf_dir):
    return _logged(spark, sf_dir).stages.select(
        "stage_id", "num_complete_tasks", "num_failed_tasks", *M.TASK_METRICS
    )


@register("p9_executors")
def _(spark, sf_dir):
    return _logged(spark, sf_dir).executors.drop("max_memory")


@register("p10_cluster_resources")
def _(spark, sf_dir):
    return reports.cluster_resources(X.telemetry(spark, sf_dir).executors)


@register("p11_sql_executions")
def _(spark, sf_dir):
    return _logged(spark, sf_dir).sql_executions.select(
        "app_id", "id", "status", "description", "plan_description",
        F.unix_millis("submission_time").alias("submission_ms"), "duration",
    )


@register("p12_sql_jobs")
def _(spark, sf_dir):
    return _logged(spark, sf_dir).sql_jobs


# -- streaming -----------------------------------------------------------------------------
def _task_stream(spark, sf_dir, files: int | None = None) -> DataFrame:
    return live.stream_tasks(live.stream_lines(spark, X.event_log(spark, sf_dir), files))


@register("st1_stream_tasks")
def _(spark, sf_dir):
    """Task rows of the streamed log, appended to a table."""
    out = new_folder(spark, "stream-tasks")
    query = (
        _task_stream(spark, sf_dir).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("compression", "zstd").option("checkpointLocation", new_folder(spark, "stream-checkpoint"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(out).groupBy("executor_id", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration").alias("duration_sum")
    )


@register("st1_growing_log")
def _(spark, sf_dir):
    """Task rows of a rolling log that grows between two triggers, each read once."""
    root, out, checkpoint = new_folder(spark, "growing"), new_folder(spark, "stream-tasks"), new_folder(spark, "stream-checkpoint")
    for whole in (False, True):
        X.grown_log(spark, sf_dir, root, whole)
        query = (
            live.stream_tasks(tail_lines(spark, root)).writeStream.format("parquet").option("path", out).option("compression", "zstd")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.parquet(out).groupBy("executor_id", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration").alias("duration_sum")
    )


def _rolled(spark, sf_dir, summarize, rollup) -> DataFrame:
    path = new_folder(spark, "rollup")
    query = live.run_rollup(
        _task_stream(spark, sf_dir, 4), summarize, path, new_folder(spark, "stream-checkpoint"), once=True
    )
    query.awaitTermination()
    return live.read_rollup(spark, path, rollup)


@register("st2_stream_stage_metrics")
def _(spark, sf_dir):
    return _rolled(spark, sf_dir, live.stage_batch, live.STAGE_ROLLUP).drop("app_id", "attempt_id")


@register("st3_stream_findings")
def _(spark, sf_dir):
    """Findings kept up to date over two streamed logs, one without an application start."""
    state = new_folder(spark, "findings")
    lines = live.stream_lines(spark, X.two_logs(spark, sf_dir))
    live.run_findings(lines, state, new_folder(spark, "stream-checkpoint"), once=True).awaitTermination()
    short = F.regexp_replace("app_id", r"^.*/eventlog_v2_", "log ")
    return live.current_findings(spark, state).groupBy(short.alias("app_id"), "category", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.sum("estimated_savings_ms").alias("savings")
    )


@register("st2_compacted")
def _(spark, sf_dir):
    """The rollup after batches, a compaction, more batches, and the removal of what it covers."""
    path, checkpoint, root = new_folder(spark, "rollup"), new_folder(spark, "stream-checkpoint"), new_folder(spark, "growing")
    for whole in (False, True):
        X.grown_log(spark, sf_dir, root, whole)
        live.run_rollup(live.stream_tasks(tail_lines(spark, root)), live.stage_batch, path, checkpoint, once=True).awaitTermination()
        live.compact_rollup(spark, path, live.STAGE_ROLLUP)
    batches.expire(spark, path, 0)
    return live.read_rollup(spark, path, live.STAGE_ROLLUP).drop("app_id", "attempt_id")


@register("st3_two_attempts")
def _(spark, sf_dir):
    """Findings of two attempts of one application whose logs appear in two batches."""
    root, state, checkpoint = new_folder(spark, "attempts"), new_folder(spark, "findings"), new_folder(spark, "stream-checkpoint")
    for attempt in (1, 2):
        X.attempt_log(spark, sf_dir, root, attempt)
        live.run_findings(tail_lines(spark, root), state, checkpoint, once=True, buckets=8, compact_every=2).awaitTermination()
    return live.current_findings(spark, state).groupBy("app_id", "category", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.sum("estimated_savings_ms").alias("savings")
    )


@register("st4_stream_health")
def _(spark, sf_dir):
    found = _rolled(spark, sf_dir, live.health_batch, live.HEALTH_ROLLUP)
    return found.select(F.unix_millis("window_start").alias("window_start"), "n", "failed", "bytes")


def _complete(stream: DataFrame, spark) -> DataFrame:
    """The last complete output of a stateful stream, as a table."""
    path = new_folder(spark, "stream-complete")
    query = (
        stream.writeStream.outputMode("complete").trigger(availableNow=True)
        .option("checkpointLocation", new_folder(spark, "stream-checkpoint"))
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    )
    query.awaitTermination()
    return spark.read.parquet(path)


@register("st2_native")
def _(spark, sf_dir):
    """The running totals kept in Spark's own state."""
    return _complete(live.live_stage_metrics(_task_stream(spark, sf_dir, 16)), spark).drop("app_id", "attempt_id")


@register("st4_native")
def _(spark, sf_dir):
    """Health windows kept in Spark's own state."""
    found = _complete(live.live_health(_task_stream(spark, sf_dir, 16).where("finish_time IS NOT NULL")), spark)
    return found.select("app_id", F.unix_millis("window_start").alias("window_start"), "n", "failed", "bytes")
