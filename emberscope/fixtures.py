"""Telemetry derived from the given tables, used by the registered queries and tests.

``lineitem`` rows are tasks and ``part`` rows are stages; integer arithmetic on their
columns picks a scenario per stage, so every finding occurs at every scale.  The texts
below run unchanged on Spark and on the engine that checks the results.

``task_id`` is built from the keys of the row, so tasks are a plain projection of the
scan: no window, no shuffle, whatever the size of a stage.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscope.model import Telemetry
from emberscope.operators.quantiles import LARGE_GROUP, parted
from emberscope.sources import tailing
from emberscope.workspace import new_folder, open_files, ship_package

EPOCH_MS = 1704067200000

TASKS = """
SELECT (l_orderkey * 8 + l_linenumber) * 10000 + l_suppkey % 10000 AS task_id,
  CAST(l_linenumber - 1 AS BIGINT) AS task_index, CAST(0 AS BIGINT) AS attempt,
  l_partkey AS stage_id, CAST(0 AS BIGINT) AS stage_attempt_id,
  CONCAT('exec-', CAST(CASE WHEN l_partkey % 9 = 0 AND l_linenumber <= 5 THEN 0 ELSE l_suppkey % 5 END AS STRING)) AS executor_id,
  CONCAT('host-', CAST(l_suppkey % 3 AS STRING)) AS host,
  CASE WHEN c = 7 AND l_linenumber = 7 THEN 'FAILED' ELSE 'SUCCESS' END AS status,
  CASE WHEN l_orderkey % 211 = 0 THEN NULL ELSE ep * hot END AS duration,
  ep * hot - l_linenumber AS executor_run_time,
  (ep * hot - l_linenumber) * 10000 * (5 + (l_partkey * 7) % 96) AS executor_cpu_time,
  CASE WHEN c = 8 THEN q * 10 ELSE ep * q * 64 * hot END AS input_bytes,
  q * 100 * hot AS input_records,
  CASE WHEN c = 1 THEN ep * q * 384 * hot WHEN c = 0 THEN q ELSE ep * q * 32 END AS output_bytes,
  CASE WHEN c = 5 THEN q * 2000 * hot WHEN c = 6 THEN q * 20000 * hot ELSE q * 100 END AS output_records,
  CASE WHEN c = 10 THEN ep * q * 128 ELSE CAST(0 AS BIGINT) END AS shuffle_read_bytes,
  CASE WHEN c = 10 THEN q * 50 ELSE CAST(0 AS BIGINT) END AS shuffle_read_records,
  CASE WHEN c = 2 THEN ep * q * 640 WHEN c = 11 THEN q * 1000 ELSE CAST(0 AS BIGINT) END AS shuffle_write_bytes,
  CASE WHEN c = 2 OR c = 11 THEN q * 10 ELSE CAST(0 AS BIGINT) END AS shuffle_write_records,
  CASE WHEN c = 3 OR c = 4 THEN ep * q * 16 ELSE CAST(0 AS BIGINT) END AS memory_bytes_spilled,
  CASE WHEN c = 3 THEN ep * q * 32 ELSE CAST(0 AS BIGINT) END AS disk_bytes_spilled,
  ep * 4096 AS peak_execution_memory,
  CASE WHEN l_orderkey % 211 = 0 THEN NULL ELSE 1704067200000 + l_partkey * 60000 + ep * hot END AS finish_ms
FROM (
  SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey % 12 AS c,
    CAST(floor(l_extendedprice) AS BIGINT) AS ep, CAST(floor(l_quantity) AS BIGINT) AS q,
    CAST(CASE WHEN l_orderkey % 97 = 0 THEN 40 ELSE 1 END AS BIGINT) AS hot
  FROM lineitem) b
"""

STAGES = """
SELECT CASE WHEN p_partkey % 50 = 49 THEN 'ACTIVE' WHEN a.num_failed_tasks > 0 THEN 'FAILED' ELSE 'COMPLETE' END AS status,
  p_partkey AS stage_id, CAST(0 AS BIGINT) AS attempt_id,
  CAST(CASE WHEN p_partkey % 12 = 8 THEN 20000 WHEN p_partkey % 12 = 9 THEN 2 ELSE a.n END AS BIGINT) AS num_tasks,
  a.n - a.num_failed_tasks AS num_complete_tasks, a.num_failed_tasks, CAST(0 AS BIGINT) AS num_killed_tasks,
  a.executor_run_time, a.executor_cpu_time, a.input_bytes, a.input_records, a.output_bytes, a.output_records,
  a.shuffle_read_bytes, a.shuffle_read_records, a.shuffle_write_bytes, a.shuffle_write_records,
  a.memory_bytes_spilled, a.disk_bytes_spilled, a.peak_execution_memory,
  CASE WHEN p_partkey % 3 = 0 THEN CONCAT('Spark Connect - session_id: "', p_brand, '" - ', p_type) ELSE p_type END AS name,
  1704067200000 + p_partkey * 60000 AS submission_ms,
  CASE WHEN p_partkey % 50 = 49 THEN NULL ELSE 1704067200000 + p_partkey * 60000 + a.max_duration END AS completion_ms
FROM part JOIN (
  SELECT stage_id AS sid, CAST(count(*) AS BIGINT) AS n,
    CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS num_failed_tasks,
    CAST(sum(executor_run_time) AS BIGINT) AS executor_run_time, CAST(sum(executor_cpu_time) AS BIGINT) AS executor_cpu_time,
    CAST(sum(input_bytes) AS BIGINT) AS input_bytes, CAST(sum(input_records) AS BIGINT) AS input_records,
    CAST(sum(output_bytes) AS BIGINT) AS output_bytes, CAST(sum(output_records) AS BIGINT) AS output_records,
    CAST(sum(shuffle_read_bytes) AS BIGINT) AS shuffle_read_bytes, CAST(sum(shuffle_read_records) AS BIGINT) AS shuffle_read_records,
    CAST(sum(shuffle_write_bytes) AS BIGINT) AS shuffle_write_bytes, CAST(sum(shuffle_write_records) AS BIGINT) AS shuffle_write_records,
    CAST(sum(memory_bytes_spilled) AS BIGINT) AS memory_bytes_spilled, CAST(sum(disk_bytes_spilled) AS BIGINT) AS disk_bytes_spilled,
    max(peak_execution_memory) AS peak_execution_memory, max(duration) AS max_duration
  FROM tasks GROUP BY stage_id) a ON p_partkey = a.sid
"""

JOB_STAGES = """
SELECT CAST(floor(stage_id / 10) AS BIGINT) AS job_id, stage_id FROM stages
UNION ALL
SELECT CAST(floor(stage_id / 10) AS BIGINT) + 1 AS job_id, stage_id FROM stages WHERE stage_id % 10 = 0
"""

JOBS = """
SELECT js.job_id, CONCAT('job ', CAST(js.job_id AS STRING)) AS name,
  CASE WHEN sum(CASE WHEN s.status = 'ACTIVE' THEN 1 ELSE 0 END) > 0 THEN 'RUNNING'
       WHEN sum(CASE WHEN s.status = 'FAILED' THEN 1 ELSE 0 END) > 0 AND js.job_id % 2 = 0 THEN 'FAILED'
       ELSE 'SUCCEEDED' END AS status,
  min(s.submission_ms) AS submission_ms,
  CASE WHEN sum(CASE WHEN s.status = 'ACTIVE' THEN 1 ELSE 0 END) > 0 THEN NULL ELSE max(s.completion_ms) END AS completion_ms,
  CAST(sum(s.num_tasks) AS BIGINT) AS num_tasks, CAST(sum(s.num_failed_tasks) AS BIGINT) AS num_failed_tasks
FROM job_stages js JOIN stages s ON js.stage_id = s.stage_id GROUP BY js.job_id
"""

SQL_JOBS = """
SELECT CAST(floor(job_id / 3) AS BIGINT) AS sql_id, job_id,
  CASE status WHEN 'RUNNING' THEN 'running' WHEN 'FAILED' THEN 'failed' ELSE 'success' END AS state
FROM jobs WHERE job_id % 7 <> 6
"""

SQL_EXECUTIONS = """
SELECT sj.sql_id AS id, CASE WHEN max(CASE WHEN sj.state = 'running' THEN 1 ELSE 0 END) = 1 THEN 'RUNNING' ELSE 'COMPLETED' END AS status,
  CONCAT('SELECT * FROM t', CAST(sj.sql_id AS STRING)) AS description,
  replace(CASE sj.sql_id % 5
    WHEN 0 THEN '== Physical Plan ==|AdaptiveSparkPlan (7)|+- SortMergeJoin Inner (6)|   :- Sort (3)|   :  +- Exchange (2)|   :     +- Scan parquet db.a (1)|   +- Sort (5)|      +- Scan parquet db.b (4)'
    WHEN 1 THEN '== Physical Plan ==|AdaptiveSparkPlan (4)|+- Project (3)|   +- ArrowEvalPython [f(x#1)#2], [pythonUDF0#3], 200 (2)|      +- Scan parquet db.a (1)'
    WHEN 2 THEN '== Physical Plan ==|AdaptiveSparkPlan (6)|+- Project (5)|   +- Filter (4)|      +- Sort (3)|         +- BatchEvalPython [g(x#1)#2] (2)|            +- Scan parquet db.a (1)'
    WHEN 3 THEN '== Physical Plan ==|* HashAggregate (5)|+- Exchange hashpartitioning(k#1, 200)|   :- Scan parquet db.a [k#1]|   +- *(1) Filter isnotnull(k#1)'
    ELSE '' END, '|', chr(10)) AS plan_description,
  min(j.submission_ms) AS submission_ms,
  COALESCE(max(j.completion_ms) - min(j.submission_ms), 0) AS duration
FROM sql_jobs sj JOIN jobs j ON sj.job_id = j.job_id GROUP BY sj.sql_id
"""

EXECUTORS = """
SELECT executor_id AS id, CAST(8 AS BIGINT) AS total_cores, CAST(17179869184 AS BIGINT) AS max_memory,
  executor_id <> 'exec-4' AS is_active
FROM (SELECT DISTINCT executor_id FROM tasks) e
UNION ALL
SELECT DISTINCT 'driver' AS id, CAST(4 AS BIGINT) AS total_cores, CAST(4294967296 AS BIGINT) AS max_memory, true AS is_active
FROM tasks
"""

VIEWS = {
    "tasks": TASKS,
    "stages": STAGES,
    "job_stages": JOB_STAGES,
    "jobs": JOBS,
    "sql_jobs": SQL_JOBS,
    "sql_executions": SQL_EXECUTIONS,
    "executors": EXECUTORS,
}


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def _view(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    for name in tables:
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {name}\n", f"{word} {{{name}}}\n")
            text = text.replace(f"{word} {name} ", f"{word} {{{name}}} ")
            text = text.replace(f"{word} {name})", f"{word} {{{name}}})")
    return spark.sql(text, **tables)


def _with_times(df: DataFrame) -> DataFrame:
    times = {
        name: F.timestamp_millis(ms)
        for ms, name in (
            ("submission_ms", "submission_time"),
            ("completion_ms", "completion_time"),
            ("finish_ms", "finish_time"),
        )
        if ms in df.columns
    }
    return df.withColumns(times)


_loaded: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, make):
    """Derive something once per Spark application and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _loaded:
        _loaded[key] = make()
    return _loaded[key]


def task_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_times(_view(spark, TASKS, lineitem=source(spark, sf_dir, "lineitem")))


def stage_table(spark: SparkSession, sf_dir: str, large: int = LARGE_GROUP) -> DataFrame:
    """The stages: tasks of modest stages are dealt out by stage as narrow rows of ``lineitem``, for the sums of a
    stage are wider than its tasks and hardly combine before a shuffle where its tasks lie far apart."""
    part, lines = source(spark, sf_dir, "part"), source(spark, sf_dir, "lineitem")
    used = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    narrow = lines.select(*used, *[F.floor(name).cast("bigint").alias(name) for name in ("l_extendedprice", "l_quantity")])
    small, big = parted(narrow, None, ["l_partkey"], large)
    rows = [_view(spark, STAGES, part=part, tasks=_view(spark, TASKS, lineitem=df)) for df in (small.repartition("l_partkey"), big)]
    return rows[0].unionByName(rows[1])


def telemetry(spark: SparkSession, sf_dir: str) -> Telemetry:
    """The telemetry tables.

    Tasks stay a projection of ``lineitem``.  The tables derived from them are computed
    once per application and written to the shared folder, each from the one before it.
    """
    folder = _once(spark, sf_dir, "tables", lambda: _ingest(spark, sf_dir))

    def stored(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}")

    stages, jobs = stored("stages"), stored("jobs")
    return Telemetry(
        tasks=task_table(spark, sf_dir),
        stages=stages,
        jobs=jobs,
        job_stages=_view(spark, JOB_STAGES, stages=stages),
        sql_executions=stored("sql_executions"),
        sql_jobs=_view(spark, SQL_JOBS, jobs=jobs),
        executors=stored("executors"),
    )


def with_attempts(stages: DataFrame) -> DataFrame:
    """A second attempt of every third stage, numbered 3: longer for even stages, shorter and
    with half the shuffle for odd ones."""
    even = F.col("stage_id") % 2 == 0
    again = stages.where("stage_id % 3 = 0").withColumns(
        {
            "attempt_id": F.lit(3).cast("bigint"),
            "executor_run_time": F.when(even, F.col("executor_run_time") * 2).otherwise(F.expr("executor_run_time div 2")),
            "shuffle_write_bytes": F.when(even, F.col("shuffle_write_bytes")).otherwise(F.expr("shuffle_write_bytes div 2")),
        }
    )
    return stages.unionByName(again)


def _ingest(spark: SparkSession, sf_dir: str) -> str:
    folder = new_folder(spark, "tables")
    tasks = task_table(spark, sf_dir)

    def store(name: str, df: DataFrame) -> DataFrame:
        _with_times(df).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    stages = store("stages", stage_table(spark, sf_dir))
    job_stages = _view(spark, JOB_STAGES, stages=stages)
    jobs = store("jobs", _view(spark, JOBS, job_stages=job_stages, stages=stages))
    sql_jobs = _view(spark, SQL_JOBS, jobs=jobs)
    store("sql_executions", _view(spark, SQL_EXECUTIONS, sql_jobs=sql_jobs, jobs=jobs))
    store("executors", _view(spark, EXECUTORS, tasks=tasks))
    return folder


# ---------------------------------------------------------------------------
# Many applications: thirty stages, three jobs and one SQL execution form a block, and the
# blocks are dealt to seven applications.
# ---------------------------------------------------------------------------
APPS = 7
APP_OF_STAGE = f"concat('app-', cast(cast(floor(stage_id / 30) as bigint) % {APPS} as string))"
APP_OF_JOB = f"concat('app-', cast(cast(floor(job_id / 3) as bigint) % {APPS} as string))"
APP_OF_SQL = f"concat('app-', cast(id % {APPS} as string))"
APP_OF_SQL_JOB = f"concat('app-', cast(sql_id % {APPS} as string))"


def fleet(t: Telemetry) -> Telemetry:
    """The same telemetry dealt to several applications; links across them are left out."""

    def keyed(df: DataFrame, app: str) -> DataFrame:
        return df.withColumn("app_id", F.expr(app))

    return Telemetry(
        tasks=keyed(t.tasks, APP_OF_STAGE),
        stages=keyed(t.stages, APP_OF_STAGE),
        jobs=keyed(t.jobs, APP_OF_JOB),
        job_stages=keyed(t.job_stages, APP_OF_STAGE).where(F.col("app_id") == F.expr(APP_OF_JOB)),
        sql_executions=keyed(t.sql_executions, APP_OF_SQL),
        sql_jobs=keyed(t.sql_jobs, APP_OF_SQL_JOB),
        executors=t.executors.select("*", F.lit("app-0").alias("app_id")),
    )


# ---------------------------------------------------------------------------
# The same telemetry as raw event-log lines and as saved REST answers
# ---------------------------------------------------------------------------
def _line(phase: int, df: DataFrame, event: str, *fields: Column) -> DataFrame:
    value = F.to_json(F.struct(F.lit(event).alias("Event"), *fields))
    return df.select(F.lit(phase).alias("phase"), value.alias("value"))


def _metrics() -> Column:
    third = F.expr("shuffle_read_bytes div 3")
    return F.struct(
        F.col("executor_run_time").alias("Executor Run Time"),
        F.col("executor_cpu_time").alias("Executor CPU Time"),
        F.col("memory_bytes_spilled").alias("Memory Bytes Spilled"),
        F.col("disk_bytes_spilled").alias("Disk Bytes Spilled"),
        F.col("peak_execution_memory").alias("Peak Execution Memory"),
        F.struct(
            F.col("input_bytes").alias("Bytes Read"), F.col("input_records").alias("Records Read")
        ).alias("Input Metrics"),
        F.struct(
            F.col("output_bytes").alias("Bytes Written"), F.col("output_records").alias("Records Written")
        ).alias("Output Metrics"),
        F.struct(
            third.alias("Remote Bytes Read"),
            (F.col("shuffle_read_bytes") - third).alias("Local Bytes Read"),
            F.col("shuffle_read_records").alias("Total Records Read"),
        ).alias("Shuffle Read Metrics"),
        F.struct(
            F.col("shuffle_write_bytes").alias("Shuffle Bytes Written"),
            F.col("shuffle_write_records").alias("Shuffle Records Written"),
        ).alias("Shuffle Write Metrics"),
    )


def _stage_info(*times: Column) -> Column:
    return F.struct(
        F.col("stage_id").alias("Stage ID"),
        F.col("attempt_id").alias("Stage Attempt ID"),
        F.col("name").alias("Stage Name"),
        F.col("num_tasks").alias("Number of Tasks"),
        *times,
    )


def event_lines(t: Telemetry) -> DataFrame:
    """``phase, value``: one application as event-log lines, phases in order of time."""
    started = F.lit(EPOCH_MS).cast("bigint") + F.col("stage_id") * 60000
    task_info = F.struct(
        F.col("task_id").alias("Task ID"), F.col("task_index").alias("Index"),
        F.col("attempt").alias("Attempt"), F.col("executor_id").alias("Executor ID"),
        F.col("host").alias("Host"), started.alias("Launch Time"),
        (started + F.col("duration")).alias("Finish Time"),
        (F.col("status") == "FAILED").alias("Failed"),
    )
    reason = F.struct(
        F.when(F.col("status") == "FAILED", "ExceptionFailure").otherwise("Success").alias("Reason")
    )
    # a job of this data lists at most eleven stages
    infos = (
        t.job_stages.join(t.stages, "stage_id")
        .groupBy("job_id")
        .agg(
            F.array_sort(F.collect_list("stage_id")).alias("ids"),
            F.array_sort(F.collect_list(_stage_info())).alias("infos"),
        )
    )
    jobs = t.jobs.join(infos, "job_id").join(
        t.sql_jobs.select("job_id", "sql_id"), "job_id", "left"
    )
    properties = F.struct(
        F.col("name").alias("callSite.short"), F.col("sql_id").cast("string").alias("spark.sql.execution.id")
    )
    result = F.struct(
        F.when(F.col("status") == "SUCCEEDED", "JobSucceeded").otherwise("JobFailed").alias("Result")
    )
    sql = "org.apache.spark.sql.execution.ui.SparkListenerSQLExecution"
    parts = [
        _line(0, t.executors.where("id = 'driver'"), "SparkListenerApplicationStart",
              F.lit("app-1").alias("App ID"), F.lit("derived").alias("App Name")),
        _line(1, t.executors, "SparkListenerExecutorAdded", F.col("id").alias("Executor ID"),
              F.struct(F.lit("h").alias("Host"), F.col("total_cores").alias("Total Cores"))
              .alias("Executor Info")),
        _line(2, t.sql_executions, sql + "Start", F.col("id").alias("executionId"), "description",
              F.col("plan_description").alias("physicalPlanDescription"),
              F.col("submission_ms").alias("time")),
        _line(3, jobs, "SparkListenerJobStart", F.col("job_id").alias("Job ID"),
              F.col("submission_ms").alias("Submission Time"), F.col("ids").alias("Stage IDs"),
              F.col("infos").alias("Stage Infos"), properties.alias("Properties")),
        _line(4, t.stages, "SparkListenerStageSubmitted",
              _stage_info(F.col("submission_ms").alias("Submission Time")).alias("Stage Info")),
        _line(5, t.tasks, "SparkListenerTaskEnd", F.col("stage_id").alias("Stage ID"),
              F.col("stage_attempt_id").alias("Stage Attempt ID"), task_info.alias("Task Info"),
              reason.alias("Task End Reason"), _metrics().alias("Task Metrics")),
        _line(6, t.stages.where("completion_ms is not null"), "SparkListenerStageCompleted",
              _stage_info(F.col("completion_ms").alias("Completion Time")).alias("Stage Info")),
        _line(7, t.jobs.where("status <> 'RUNNING'"), "SparkListenerJobEnd",
              F.col("job_id").alias("Job ID"), F.col("completion_ms").alias("Completion Time"),
              result.alias("Job Result")),
        _line(8, t.sql_executions.where("status = 'COMPLETED'"), sql + "End",
              F.col("id").alias("executionId"), (F.col("submission_ms") + F.col("duration")).alias("time")),
        _line(8, t.executors.where("not is_active"), "SparkListenerExecutorRemoved",
              F.col("id").alias("Executor ID")),
        _line(8, t.stages.where("stage_id % 100 = 0"), "SparkListenerEnvironmentUpdate"),
        t.stages.where("stage_id % 100 = 1").select(
            F.lit(8).alias("phase"),
            F.concat(F.lit('{"Event":"SparkListenerTaskEnd","Stage ID":'), F.col("stage_id")).alias("value"),
        ),
    ]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines


def _write_phases(lines: DataFrame, path: str, codec: str = "gzip") -> None:
    """Lines in a folder per phase, in the order in which they come."""
    with open_files(lines.sparkSession, PHASES):
        lines.write.partitionBy("phase").options(**{**PACK, "compression": codec}).text(path)


def event_log(spark: SparkSession, sf_dir: str, codec: str = "gzip") -> str:
    """Root folder of the event log of the derived telemetry, written once (packed, as Spark packs rolled logs)."""

    def write() -> str:
        root = new_folder(spark, f"log-{codec}")
        lines = event_lines(telemetry(spark, sf_dir))
        _write_phases(lines, f"{root}/eventlog_v2_app-1", codec)
        return root

    return _once(spark, sf_dir, f"log-{codec}", write)


PHASES = 9
PACK = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}  # half the time of the default, a third more bytes
GROWING = 64  # one task line of so many is in a file that grows
ROLLED_FILES = 1_000_000  # numbers of rolled files for each phase


def _renamed(spark: SparkSession, root: str, name) -> None:
    """Give every data file below a root the name that ``name(old)`` returns (derived logs only)."""
    java = spark._jvm.org.apache.hadoop.fs
    top = java.Path(root)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    files = system.listFiles(top, True)
    found = []
    while files.hasNext():
        found.append(files.next().getPath())
    for path in found:
        if path.getName().startswith("part-"):
            system.rename(path, java.Path(path.getParent(), name(path.getName())))


def bare_gzip_log(spark: SparkSession, sf_dir: str) -> str:
    """The event log gzip-compressed; the files of odd phases have no suffix that says so, or one
    that says they are plain."""

    def write() -> str:
        root = new_folder(spark, "log-bare")
        lines = event_lines(telemetry(spark, sf_dir))
        for rest in (0, 1):
            part = f"{root}/eventlog_v2_app-1/half={rest}"
            _write_phases(lines.where(F.col("phase") % 2 == rest), part)
        _renamed(spark, f"{root}/eventlog_v2_app-1/half=1", lambda name: name.split(".")[0] + ("" if zlib.crc32(name.encode()) % 3 else ".json"))
        return root

    return _once(spark, sf_dir, "log-bare", write)


def grown_log(spark: SparkSession, sf_dir: str, root: str, whole: bool) -> None:
    """Write the event log below a root as a rolling log of a running application: the part that is
    there first, or what makes it whole.

    Most task lines are in closed files, packed and never touched again; those of the rest of the
    log come as new files.  All other lines and one of ``GROWING`` task lines are in plain files of
    which the first part is the beginning, file by file.
    """
    drafts = _once(spark, sf_dir, f"grown-{root}", lambda: _log_drafts(spark, sf_dir))
    java = spark._jvm.org.apache.hadoop.fs
    folder = java.Path(f"{root}/eventlog_v2_app-1")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(folder)
    system.create(java.Path(folder, "appstatus_app-1.inprogress"), True).close()

    def parts(late: bool, number: int) -> list:
        place = java.Path(f"{drafts}/late={str(late).lower()}/number={number}")
        found = system.listStatus(place) if system.exists(place) else []
        return sorted((f.getPath() for f in found if f.getPath().getName().startswith("part-")), key=lambda path: path.getName())

    for at, path in enumerate(parts(whole, 0)):
        system.rename(path, java.Path(folder, f"events_{5 * ROLLED_FILES + 2 * at + 1 + whole}_app-1.gz"))
    files = []
    for number in range(ROLLED_FILES, (PHASES + 1) * ROLLED_FILES, ROLLED_FILES):
        taken = [path.toString() for late in ([False, True] if whole else [False]) for path in parts(late, number)]
        if taken:
            files.append((taken, f"{drafts}/whole={whole}-{number}".lower(), java.Path(folder, f"events_{number}_app-1")))
    ship_package(spark)
    context = spark.sparkContext
    context.parallelize([file[:2] for file in files], max(len(files), 1)).foreach(_unpacked_together)
    for _, draft, target in files:
        system.delete(target, False)
        system.rename(java.Path(draft), target)


def _log_drafts(spark: SparkSession, sf_dir: str) -> str:
    """The lines of the log, packed, in a folder for each of its growing files, by what comes late; number 0 are the closed files."""
    spread = F.when(F.col("phase") == 5, F.pmod(F.xxhash64("value"), F.lit(GROWING))).otherwise(0)
    number = F.when(spread > 0, 0).otherwise((F.col("phase") + 1) * ROLLED_FILES).cast("int")
    late = F.pmod(F.xxhash64("value", F.lit(1)), F.lit(3)) == 0
    drafts = new_folder(spark, "log-drafts")
    lines = event_lines(telemetry(spark, sf_dir)).select(late.alias("late"), number.alias("number"), "value")
    with open_files(spark, 2 * (PHASES + 1)):
        lines.write.partitionBy("late", "number").options(**PACK).text(drafts)
    return drafts


def _unpacked_together(file: tuple[list[str], str]) -> None:
    """Write the bytes of packed files, one after the other, to a plain one."""
    packed, target = file
    system, path, _ = tailing.file_system(target)
    with system.open_output_stream(path, compression=None) as out:
        for part in packed:
            system, path, _ = tailing.file_system(part)
            with system.open_input_file(path) as stream:
                for data in tailing._unpacked(stream, "gzip"):
                    out.write(data)


def attempt_log(spark: SparkSession, sf_dir: str, root: str, attempt: int) -> None:
    """Write the event log of one attempt of the application below a root."""
    t = telemetry(spark, sf_dir)
    lines = event_lines(t).where("phase > 0")
    start = _line(0, t.executors.limit(1), "SparkListenerApplicationStart", F.lit("app-1").alias("App ID"), F.lit(str(attempt)).alias("App Attempt ID"))
    _write_phases(lines.unionByName(start), f"{root}/eventlog_v2_attempt-{attempt}")


def damaged_log(spark: SparkSession, sf_dir: str) -> str:
    """The plain lines of the jobs under names that promise gzip."""

    def write() -> str:
        root = new_folder(spark, "log-damaged")
        event_lines(telemetry(spark, sf_dir)).where("phase = 3").select("value").write.text(root)
        _renamed(spark, root, lambda name: name.split(".")[0] + ".gz")
        return root

    return _once(spark, sf_dir, "log-damaged", write)


def logs_by_application(spark: SparkSession, sf_dir: str) -> str:
    """A folder per application of the fleet with two logs of its jobs: one of the starts of
    the jobs, and a larger one with their ends and the stages' starts too."""

    def write() -> str:
        root = new_folder(spark, "logs-by-app")
        t = fleet(telemetry(spark, sf_dir))
        lines = event_lines(t).where("phase IN (3, 4, 7)")
        job = F.coalesce(F.get_json_object("value", "$.Job ID").cast("bigint"), F.lit(-1))
        stage = F.get_json_object("value", "$.Stage Info.Stage ID").cast("bigint")
        app = F.when(job >= 0, F.expr(APP_OF_JOB.replace("job_id", "job"))).otherwise(F.expr(APP_OF_STAGE.replace("stage_id", "stage")))
        named = lines.withColumns({"job": job, "stage": stage}).withColumn("app", app).select("app", "phase", "value")
        for part in (named.where("phase = 3"), named):
            part.select("app", "value").repartition("app").write.mode("append").partitionBy("app").text(root)
        return root

    return _once(spark, sf_dir, "logs-by-app", write)


def logs_of_attempts(spark: SparkSession, sf_dir: str) -> str:
    """Three logs: two attempts of one application with even and odd jobs, and one of every
    third job that names no application."""

    def write() -> str:
        root = new_folder(spark, "logs-attempts")
        lines = event_lines(telemetry(spark, sf_dir)).where("phase = 3")
        job = F.get_json_object("value", "$.Job ID").cast("bigint")
        start = lines.limit(1)
        for log, wanted, attempt in (("one", job % 2 == 0, "1"), ("two", job % 2 == 1, "2"), ("three", job % 3 == 0, None)):
            body = lines.where(wanted).select("phase", "value")
            if attempt:
                body = body.unionByName(_line(0, start, "SparkListenerApplicationStart", F.lit("app-1").alias("App ID"), F.lit(attempt).alias("App Attempt ID")))
            body.write.partitionBy("phase").text(f"{root}/eventlog_v2_{log}")
        return root

    return _once(spark, sf_dir, "logs-attempts", write)


def two_logs(spark: SparkSession, sf_dir: str) -> str:
    """The event log twice: as written, and as a second application without its start."""

    def write() -> str:
        root = new_folder(spark, "logs-two")
        lines = event_lines(telemetry(spark, sf_dir))
        _write_phases(lines, f"{root}/eventlog_v2_app-1")
        _write_phases(lines.where("phase > 0"), f"{root}/eventlog_v2_app-2")
        return root

    return _once(spark, sf_dir, "logs-two", write)


def _as_arrays(lines: DataFrame) -> DataFrame:
    """Objects, one per line, to the lines of one array a partition with a null at its end.

    Lines are counted first, for the last one to be known.  (A Python function that all lines pass
    through hung at 36 million: Spark waited for its output and the worker for input.)
    """
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # in the partition
    placed = lines.select("value", F.spark_partition_id().alias("part"), at.alias("at"))
    ends = F.broadcast(placed.groupBy(F.col("part").alias("of")).agg(F.max("at").alias("last")))
    begin, end = F.when(F.col("at") == 0, "[").otherwise(""), F.when(F.col("at") == F.col("last"), ",null]").otherwise(",")
    return placed.join(ends, F.col("part") == F.col("of")).select(F.concat(begin, "value", end).alias("value"))


def rest_arrays(spark: SparkSession, sf_dir: str) -> str:
    """The same answers as one JSON array a file (with a null at its end); tasks in several files, packed."""

    def write() -> str:
        root, lines = new_folder(spark, "rest-arrays"), rest_snapshot(spark, sf_dir)
        for file in ("jobs.json", "stages.json", "sql.json", "executors.json"):
            _as_arrays(spark.read.text(f"{lines}/app-1/{file}").coalesce(1)).write.text(f"{root}/app-1/{file}")
        file = "stages/0/0/taskList.json"
        _as_arrays(spark.read.text(f"{lines}/app-1/{file}")).write.options(**PACK).text(f"{root}/app-1/{file}")
        return root

    return _once(spark, sf_dir, "rest-arrays", write)


def broken_rest(spark: SparkSession, sf_dir: str) -> str:
    """Saved answers in which every tenth job has a text for its id and every seventh stage is cut off."""

    def write() -> str:
        root = new_folder(spark, "rest-broken")
        t = telemetry(spark, sf_dir)
        job = F.to_json(F.struct(F.col("job_id").alias("jobId"), "name", "status"))
        odd = F.concat(F.lit('{"jobId": "none", "status": "'), F.col("status"), F.lit('"}'))
        t.jobs.select(F.when(F.col("job_id") % 10 == 0, odd).otherwise(job).alias("value")).write.text(f"{root}/app-1/jobs.json")
        stage = F.to_json(F.struct(F.col("stage_id").alias("stageId"), "name", "status"))
        cut = F.substring(stage, 1, 12)
        t.stages.select(F.when(F.col("stage_id") % 7 == 0, cut).otherwise(stage).alias("value")).write.text(f"{root}/app-1/stages.json")
        return root

    return _once(spark, sf_dir, "rest-broken", write)


def staged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log read back, parsed and staged, once."""
    from emberscope.sources import event_log as log

    def stage() -> str:
        path = new_folder(spark, "events")
        log.stage_events(log.parse_lines(log.read_lines(spark, event_log(spark, sf_dir))), path)
        return path

    return spark.read.parquet(_once(spark, sf_dir, "events", stage))


def rest_snapshot(spark: SparkSession, sf_dir: str) -> str:
    """Root folder of the derived telemetry saved in the form of REST answers, one object
    per line, written once."""

    def write() -> str:
        t = telemetry(spark, sf_dir)
        root = new_folder(spark, "rest")
        iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'GMT'")
        camel = lambda n: n.split("_")[0] + "".join(w.title() for w in n.split("_")[1:])
        metrics = [F.col(n).alias(camel(n)) for n in t.stages.columns
                   if n.endswith(("_bytes", "_records", "_time", "_spilled", "_memory"))
                   and n not in ("submission_time", "completion_time")]
        stages = t.stages.select(
            "status", F.col("stage_id").alias("stageId"), F.col("attempt_id").alias("attemptId"), "name",
            F.col("num_tasks").alias("numTasks"), F.col("num_complete_tasks").alias("numCompleteTasks"),
            F.col("num_failed_tasks").alias("numFailedTasks"),
            iso("submission_time").alias("submissionTime"),
            iso("completion_time").alias("completionTime"), *metrics,
        )
        listed = t.job_stages.groupBy("job_id").agg(F.array_sort(F.collect_list("stage_id")).alias("stageIds"))
        jobs = t.jobs.join(listed, "job_id").select(
            F.col("job_id").alias("jobId"), "name", "status", "stageIds",
            F.col("num_tasks").alias("numTasks"), F.col("num_failed_tasks").alias("numFailedTasks"),
            iso("submission_time").alias("submissionTime"), iso("completion_time").alias("completionTime"),
        )
        # an SQL execution of this data has at most three jobs
        lists = t.sql_jobs.groupBy(F.col("sql_id").alias("id")).agg(
            *[F.array_sort(F.collect_list(F.when(F.col("state") == s, F.col("job_id")))).alias(f"{s}JobIds")
              for s in ("running", "success", "failed")]
        )
        sqls = t.sql_executions.join(lists, "id").select(
            "id", "status", "description", F.col("plan_description").alias("planDescription"),
            iso(F.timestamp_millis("submission_ms")).alias("submissionTime"), "duration",
            "runningJobIds", "successJobIds", "failedJobIds",
        )
        executors = t.executors.select(
            "id", F.col("total_cores").alias("totalCores"), F.col("max_memory").alias("maxMemory"),
            F.col("is_active").alias("isActive"),
        )
        third = F.expr("shuffle_read_bytes div 3")
        tasks = t.tasks.select(
            F.col("task_id").alias("taskId"), F.col("task_index").alias("index"), "attempt",
            F.col("stage_id").alias("stageId"), F.col("executor_id").alias("executorId"), "host",
            "status", "duration",
            F.struct(
                F.col("executor_run_time").alias("executorRunTime"),
                F.col("executor_cpu_time").alias("executorCpuTime"),
                F.col("memory_bytes_spilled").alias("memoryBytesSpilled"),
                F.col("disk_bytes_spilled").alias("diskBytesSpilled"),
                F.col("peak_execution_memory").alias("peakExecutionMemory"),
                F.struct(F.col("input_bytes").alias("bytesRead"), F.col("input_records").alias("recordsRead"))
                .alias("inputMetrics"),
                F.struct(F.col("output_bytes").alias("bytesWritten"),
                         F.col("output_records").alias("recordsWritten")).alias("outputMetrics"),
                F.struct(third.alias("remoteBytesRead"),
                         (F.col("shuffle_read_bytes") - third).alias("localBytesRead"),
                         F.col("shuffle_read_records").alias("recordsRead")).alias("shuffleReadMetrics"),
                F.struct(F.col("shuffle_write_bytes").alias("bytesWritten"),
                         F.col("shuffle_write_records").alias("recordsWritten")).alias("shuffleWriteMetrics"),
            ).alias("taskMetrics"),
        )
        answers = {
            "jobs.json": jobs, "stages.json": stages, "sql.json": sqls, "executors.json": executors,
            "stages/0/0/taskList.json": tasks,
        }
        for file, df in answers.items():
            df.write.options(**PACK).json(f"{root}/app-1/{file}")
        return root

    return _once(spark, sf_dir, "rest", write)
