"""Tables, column lists and fixed values shared by every operator.

All operators take DataFrames with the columns below and an optional key prefix
``by`` (for example ``["app_id"]``).  With ``by=[]`` the tables hold one application.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Units, status words, labels.  Results are compared by these.
# ---------------------------------------------------------------------------
MB = 1_048_576
GB = 1024 * MB

WARN = "WARN"
CRIT = "CRIT"

STAGE_ACTIVE = "ACTIVE"
STAGE_COMPLETE = "COMPLETE"
STAGE_FAILED = "FAILED"
STAGE_PENDING = "PENDING"

JOB_RUNNING = "RUNNING"
JOB_SUCCEEDED = "SUCCEEDED"
JOB_FAILED = "FAILED"
JOB_UNKNOWN = "UNKNOWN"

SLOW_STAGE = "Slow Stage"
DATA_SKEW = "Data Skew"
SIZE_SKEW = "Size Skew"
RECORD_SKEW = "Record Skew"
DISK_SPILL = "Disk Spill"
CPU_BOUND = "CPU Bound"
IO_BOUND = "I/O Bound"
RECORD_EXPLODE = "Rec Explode"
TASK_FAIL = "Task Fail"
MEM_PRESSURE = "Mem Pressure"
EXEC_HOTSPOT = "Exec Hotspot"
TOO_MANY_PARTS = "Too Many Parts"
TOO_FEW_PARTS = "Too Few Parts"
BCAST_JOIN = "Bcast Join"
PYTHON_UDF = "Python UDF"
CACHE_OPPTY = "Cache Oppty"

LARGE_SCAN = "Large Scan"
WIDE_SHUFFLE = "Wide Shuffle"
DATA_EXPLOSION = "Data Explosion"
RECORD_EXPLOSION = "Record Explosion"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
TASK_METRICS = (
    "executor_run_time",
    "executor_cpu_time",
    "input_bytes",
    "input_records",
    "output_bytes",
    "output_records",
    "shuffle_read_bytes",
    "shuffle_read_records",
    "shuffle_write_bytes",
    "shuffle_write_records",
    "memory_bytes_spilled",
    "disk_bytes_spilled",
    "peak_execution_memory",
)

SUMMED_METRICS = TASK_METRICS[:-1]


_TYPES = {
    "bigint": T.LongType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


def _schema(ddl: str) -> T.StructType:
    """Flat ``name type`` lists only; needs no running session."""
    pairs = [field.split() for field in ddl.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


_METRIC_DDL = ", ".join(f"{name} bigint" for name in TASK_METRICS)

TASKS_DDL = (
    "app_id string, task_id bigint, task_index bigint, attempt bigint, stage_id bigint, "
    "stage_attempt_id bigint, executor_id string, host string, status string, "
    f"duration bigint, {_METRIC_DDL}, finish_time timestamp"
)
STAGES_DDL = (
    "app_id string, status string, stage_id bigint, attempt_id bigint, num_tasks bigint, "
    "num_active_tasks bigint, num_complete_tasks bigint, num_failed_tasks bigint, "
    f"num_killed_tasks bigint, {_METRIC_DDL}, name string, submission_time timestamp, "
    "completion_time timestamp, first_task_launched_time timestamp"
)
JOBS_DDL = (
    "app_id string, job_id bigint, name string, status string, submission_time timestamp, "
    "completion_time timestamp, num_tasks bigint, num_active_tasks bigint, "
    "num_completed_tasks bigint, num_skipped_tasks bigint, num_failed_tasks bigint, "
    "num_killed_tasks bigint, num_completed_indices bigint, num_active_stages bigint, "
    "num_completed_stages bigint, num_skipped_stages bigint, num_failed_stages bigint"
)
JOB_STAGES_DDL = "app_id string, job_id bigint, stage_id bigint"
SQL_DDL = (
    "app_id string, id bigint, status string, description string, plan_description string, "
    "submission_time timestamp, duration bigint"
)
SQL_JOBS_DDL = "app_id string, sql_id bigint, job_id bigint, state string"
EXECUTORS_DDL = "app_id string, id string, total_cores bigint, max_memory bigint, is_active boolean"

TABLE_SCHEMAS = {
    "tasks": _schema(TASKS_DDL),
    "stages": _schema(STAGES_DDL),
    "jobs": _schema(JOBS_DDL),
    "job_stages": _schema(JOB_STAGES_DDL),
    "sql_executions": _schema(SQL_DDL),
    "sql_jobs": _schema(SQL_JOBS_DDL),
    "executors": _schema(EXECUTORS_DDL),
}

SUSPECT_COLUMNS = (
    "severity",
    "category",
    "stage_id",
    "job_id",
    "title",
    "detail",
    "stage_name",
    "sql_id",
    "sql_description",
    "io_summary",
    "recommendation",
    "bottleneck",
    "sql_plan_hint",
    "estimated_savings_ms",
)


@dataclass(frozen=True)
class Telemetry:
    """The telemetry of one or many applications.

    ``job_stages`` and ``sql_jobs`` are the list columns of jobs and SQL executions as
    bridge rows, so that linking is an equi-join and never a list scan.
    """

    tasks: DataFrame
    stages: DataFrame
    jobs: DataFrame
    job_stages: DataFrame
    sql_executions: DataFrame
    sql_jobs: DataFrame
    executors: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def map(self, fn) -> "Telemetry":
        """Apply ``fn(name, df)`` to every table."""
        return Telemetry(**{name: fn(name, df) for name, df in self.tables().items()})

    def restrict(self, keys: DataFrame, on: list[str]) -> "Telemetry":
        """Keep only the rows whose key appears in ``keys`` (left semi join)."""
        wanted = keys.select(*on).distinct()
        return self.map(lambda _, df: df.join(wanted, on, "left_semi"))
