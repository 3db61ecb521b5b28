"""Saved REST answers to telemetry tables.

Expected layout, one folder per application id::

    <root>/<app_id>/jobs.json
    <root>/<app_id>/stages.json
    <root>/<app_id>/sql.json                       (optional)
    <root>/<app_id>/executors.json                 (optional)
    <root>/<app_id>/stages/<id>/<attempt>/taskList.json   (optional)

Each file holds one JSON array, or one object per line with ``json_lines=True``.  Both are
read by as many tasks as their bytes ask for: arrays are cut between their elements
(``json_arrays``).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscope import model as M
from emberscope.functions.times import parse_time
from emberscope.sources.json_arrays import array_elements

# File names and the field names of the REST answers.
JOBS_FILE, STAGES_FILE, SQL_FILE = "jobs.json", "stages.json", "sql.json"
EXECUTORS_FILE, APPLICATIONS_FILE = "executors.json", "applications.json"
TASKS_FILES = "stages/*/*/taskList.json"

_JOB_COUNTS = (
    "numTasks", "numActiveTasks", "numCompletedTasks", "numSkippedTasks", "numFailedTasks",
    "numKilledTasks", "numCompletedIndices", "numActiveStages", "numCompletedStages",
    "numSkippedStages", "numFailedStages",
)
_STAGE_COUNTS = (
    "numTasks", "numActiveTasks", "numCompleteTasks", "numFailedTasks", "numKilledTasks",
    "executorRunTime", "executorCpuTime", "inputBytes", "inputRecords", "outputBytes",
    "outputRecords", "shuffleReadBytes", "shuffleReadRecords", "shuffleWriteBytes",
    "shuffleWriteRecords", "memoryBytesSpilled", "diskBytesSpilled", "peakExecutionMemory",
)


def _longs(names) -> str:
    return ", ".join(f"{n} bigint" for n in names)


JOB_JSON = (
    "jobId bigint, name string, status string, submissionTime string, completionTime string, "
    f"stageIds array<bigint>, {_longs(_JOB_COUNTS)}"
)
STAGE_JSON = (
    "status string, stageId bigint, attemptId bigint, name string, submissionTime string, "
    f"completionTime string, firstTaskLaunchedTime string, {_longs(_STAGE_COUNTS)}"
)
SQL_JSON = (
    "id bigint, status string, description string, planDescription string, submissionTime string, "
    "duration bigint, runningJobIds array<bigint>, successJobIds array<bigint>, "
    "failedJobIds array<bigint>"
)
EXECUTOR_JSON = "id string, totalCores bigint, maxMemory bigint, isActive boolean"
TASK_JSON = (
    "taskId bigint, index bigint, attempt bigint, stageId bigint, stageAttemptId bigint, "
    "executorId string, host string, status string, duration bigint, launchTime string, "
    "taskMetrics struct<executorRunTime:bigint, executorCpuTime:bigint, memoryBytesSpilled:bigint, "
    "diskBytesSpilled:bigint, peakExecutionMemory:bigint, "
    "inputMetrics:struct<bytesRead:bigint, recordsRead:bigint>, "
    "outputMetrics:struct<bytesWritten:bigint, recordsWritten:bigint>, "
    "shuffleReadMetrics:struct<remoteBytesRead:bigint, localBytesRead:bigint, recordsRead:bigint>, "
    "shuffleWriteMetrics:struct<bytesWritten:bigint, recordsWritten:bigint>>"
)


#: Files, their rows and whether they may be absent.
ANSWERS = (
    (JOBS_FILE, JOB_JSON, False), (STAGES_FILE, STAGE_JSON, False), (SQL_FILE, SQL_JSON, True),
    (EXECUTORS_FILE, EXECUTOR_JSON, True), (TASKS_FILES, TASK_JSON, True),
)


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _answers(spark: SparkSession, root: str, file: str, ddl: str, json_lines: bool, optional: bool) -> DataFrame:
    """Rows of one kind of answer with ``app_id`` and ``file`` from the path.

    Every row is parsed on its own: ``_broken`` holds the text of a row that does not fit, of
    the element in which an array is cut off, or of a file that is no array.  A missing optional answer has no rows.
    """
    pattern = f"{root.rstrip('/')}/*/{file}"
    try:
        if json_lines:
            text = spark.read.text(pattern).select(F.col("_metadata.file_path").alias("file"), "value")
        else:
            text = array_elements(spark, pattern)
    except AnalysisException as missing:
        if optional and missing.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], f"{ddl}, app_id string, file string, _broken string")
        raise
    inside = re.escape(file).replace(r"\*", "[^/]+")
    rows = text.select("value", F.regexp_extract("file", rf"/([^/]+)/{inside}(/[^/]*)?$", 1).alias("app_id"), "file")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    # a generated row: the condition on broken rows would otherwise parse each text once more
    row = F.explode(F.array(F.from_json("value", f"{ddl}, _broken string", options)))
    parsed = rows.where(r"value RLIKE r'\S'").select("app_id", "file", row.alias("r"), "value")
    broken = F.when(F.col("r").isNull() | F.col("r._broken").isNotNull(), F.col("value"))
    return parsed.select("r.*", "app_id", "file", broken.alias("_bad")).drop("_broken").withColumnRenamed("_bad", "_broken")


def _read(spark: SparkSession, root: str, file: str, ddl: str, json_lines: bool, optional: bool) -> DataFrame:
    """The rows that fit."""
    return _answers(spark, root, file, ddl, json_lines, optional).where("_broken IS NULL").drop("_broken")


def broken_rows(spark: SparkSession, root: str, json_lines: bool = False) -> DataFrame:
    """Per application and kind of answer: rows, and those that ``read_snapshot`` leaves out."""
    counted = [
        _answers(spark, root, file, ddl, json_lines, optional)
        .groupBy("app_id", F.lit(file).alias("answer"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count("_broken").alias("n_broken"))
        for file, ddl, optional in ANSWERS
    ]
    return reduce(DataFrame.unionByName, counted)


def task_rows(raw: DataFrame) -> DataFrame:
    """Flat task rows; a missing metric or metric group counts 0.

    Stage and attempt come from the row, or from the path where the row has none.
    """
    in_path = r"/stages/(\d+)/(\d+)/taskList\.json(?:/[^/]*)?$"
    stage = F.coalesce("stageId", F.regexp_extract("file", in_path, 1).try_cast("bigint"), F.lit(0))
    attempt = F.coalesce(
        "stageAttemptId", F.regexp_extract("file", in_path, 2).try_cast("bigint"), F.lit(0)
    )
    m = "taskMetrics"
    launched = F.unix_millis(F.expr(parse_time("launchTime")))
    return raw.where("taskId is not null").select(
        "app_id",
        F.col("taskId").alias("task_id"),
        _zero("index").alias("task_index"),
        _zero("attempt").alias("attempt"),
        stage.alias("stage_id"),
        attempt.alias("stage_attempt_id"),
        F.coalesce("executorId", F.lit("")).alias("executor_id"),
        F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce("status", F.lit("")).alias("status"),
        "duration",
        _zero(f"{m}.executorRunTime").alias("executor_run_time"),
        _zero(f"{m}.executorCpuTime").alias("executor_cpu_time"),
        _zero(f"{m}.inputMetrics.bytesRead").alias("input_bytes"),
        _zero(f"{m}.inputMetrics.recordsRead").alias("input_records"),
        _zero(f"{m}.outputMetrics.bytesWritten").alias("output_bytes"),
        _zero(f"{m}.outputMetrics.recordsWritten").alias("output_records"),
        (
            _zero(f"{m}.shuffleReadMetrics.remoteBytesRead")
            + _zero(f"{m}.shuffleReadMetrics.localBytesRead")
        ).alias("shuffle_read_bytes"),
        _zero(f"{m}.shuffleReadMetrics.recordsRead").alias("shuffle_read_records"),
        _zero(f"{m}.shuffleWriteMetrics.bytesWritten").alias("shuffle_write_bytes"),
        _zero(f"{m}.shuffleWriteMetrics.recordsWritten").alias("shuffle_write_records"),
        _zero(f"{m}.memoryBytesSpilled").alias("memory_bytes_spilled"),
        _zero(f"{m}.diskBytesSpilled").alias("disk_bytes_spilled"),
        _zero(f"{m}.peakExecutionMemory").alias("peak_execution_memory"),
        F.timestamp_millis(launched + F.col("duration")).alias("finish_time"),
    )


def first_application(spark: SparkSession, root: str) -> DataFrame:
    """The first application listed in ``applications.json`` (``id, name``)."""
    apps = (
        spark.read.schema("id string, name string")
        .option("multiLine", "true")
        .json(f"{root.rstrip('/')}/{APPLICATIONS_FILE}")
    )
    return apps.withColumn("at", F.monotonically_increasing_id()).orderBy("at").limit(1).drop("at")


def read_snapshot(spark: SparkSession, root: str, json_lines: bool = False) -> M.Telemetry:
    """All saved answers below a root, keyed by ``app_id``.

    A broken row costs that row, a file that is no array that file; ``broken_rows`` counts them.
    """

    jobs, stages, sqls, executors, tasks = [_read(spark, root, file, ddl, json_lines, optional) for file, ddl, optional in ANSWERS]
    lists = [(F.col(f"{state}JobIds").alias("job_ids"), F.lit(state).alias("state")) for state in ("running", "success", "failed")]
    links = sqls.select("app_id", F.col("id").alias("sql_id"), F.inline(F.array(*[F.struct(*pair) for pair in lists]))).select(
        "app_id", "sql_id", F.explode("job_ids").alias("job_id"), "state"
    )
    tables = {
        "tasks": task_rows(tasks),
        "stages": stages.select(
            "app_id", "status", F.col("stageId").alias("stage_id"), F.col("attemptId").alias("attempt_id"),
            "name", *[_zero(n).alias(_snake(n)) for n in _STAGE_COUNTS],
            *[F.expr(parse_time(n)).alias(_snake(n))
              for n in ("submissionTime", "completionTime", "firstTaskLaunchedTime")],
        ),
        "jobs": jobs.select(
            "app_id", F.col("jobId").alias("job_id"), "name", "status",
            *[_zero(n).alias(_snake(n)) for n in _JOB_COUNTS],
            *[F.expr(parse_time(n)).alias(_snake(n)) for n in ("submissionTime", "completionTime")],
        ),
        "job_stages": jobs.select(
            "app_id", F.col("jobId").alias("job_id"), F.explode("stageIds").alias("stage_id")
        ),
        "sql_executions": sqls.select(
            "app_id", "id", "status", "description", F.col("planDescription").alias("plan_description"),
            F.expr(parse_time("submissionTime")).alias("submission_time"), _zero("duration").alias("duration"),
        ),
        "sql_jobs": links,
        "executors": executors.select(
            "app_id", "id", _zero("totalCores").alias("total_cores"), _zero("maxMemory").alias("max_memory"),
            F.coalesce("isActive", F.lit(False)).alias("is_active"),
        ),
    }
    return M.Telemetry(
        **{name: df.select(*M.TABLE_SCHEMAS[name].fieldNames()) for name, df in tables.items()}
    )
