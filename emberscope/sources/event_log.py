"""Spark event logs (JSON lines) to typed telemetry tables.

The raw text is read and parsed once.  The parsed events are written to the shared folder
in two parts, task events and all others, because nearly all lines are task events and
every other table should not have to scan them.  The tables are then filters, groupings and
joins over that staged table.

Where the order of lines matters (the first name of a stage wins, the last start of a job
wins, an end counts only after its start) lines are compared by position: rolling file
number, file name, block, line.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberscope import model as M
from emberscope.operators.keys import small_side
from emberscope.sources import tailing
from emberscope.workspace import new_folder, open_files, ship_package

# ---------------------------------------------------------------------------
# Event tags, JSON field names, folder and file name patterns.
# ---------------------------------------------------------------------------
EVENT_KINDS = {
    "SparkListenerApplicationStart": "app_start",
    "SparkListenerApplicationEnd": "app_end",
    "SparkListenerJobStart": "job_start",
    "SparkListenerJobEnd": "job_end",
    "SparkListenerStageSubmitted": "stage_submitted",
    "SparkListenerStageCompleted": "stage_completed",
    "SparkListenerTaskEnd": "task_end",
    "SparkListenerExecutorAdded": "executor_added",
    "SparkListenerExecutorRemoved": "executor_removed",
    "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart": "sql_start",
    "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionEnd": "sql_end",
}
OTHER, MALFORMED = "other", "malformed"
SQL_ID_PROPERTY = "spark.sql.execution.id"
CALL_SITE_PROPERTY = "callSite.short"
DESCRIPTION_PROPERTY = "spark.job.description"

ROLLING_FOLDER = r"^(.*/eventlog_v2_[^/]+)/"
ROLLING_FILE = r"/events_(\d+)_[^/]*$"
PARENT_FOLDER = r"^(.*)/[^/]*$"
CODEC_SUFFIX = r"\.(gz|gzip|zst|zstd|bz2|lz4|snappy|deflate)$"
READ_FAULT = "FAILED_READ_FILE"
DAMAGED = "damaged gzip data"
HEADS_AT_ONCE = 32


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in pairs])


_LONG, _TEXT, _FLAG = T.LongType(), T.StringType(), T.BooleanType()

STAGE_INFO = _fields(
    ("Stage ID", _LONG),
    ("Stage Attempt ID", _LONG),
    ("Stage Name", _TEXT),
    ("Number of Tasks", _LONG),
    ("Submission Time", _LONG),
    ("Completion Time", _LONG),
)
TASK_INFO = _fields(
    ("Task ID", _LONG),
    ("Index", _LONG),
    ("Attempt", _LONG),
    ("Executor ID", _TEXT),
    ("Host", _TEXT),
    ("Launch Time", _LONG),
    ("Finish Time", _LONG),
    ("Failed", _FLAG),
)
TASK_METRICS = _fields(
    ("Executor Run Time", _LONG),
    ("Executor CPU Time", _LONG),
    ("Memory Bytes Spilled", _LONG),
    ("Disk Bytes Spilled", _LONG),
    ("Peak Execution Memory", _LONG),
    ("Input Metrics", _fields(("Bytes Read", _LONG), ("Records Read", _LONG))),
    ("Output Metrics", _fields(("Bytes Written", _LONG), ("Records Written", _LONG))),
    (
        "Shuffle Read Metrics",
        _fields(
            ("Remote Bytes Read", _LONG), ("Local Bytes Read", _LONG), ("Total Records Read", _LONG)
        ),
    ),
    (
        "Shuffle Write Metrics",
        _fields(("Shuffle Bytes Written", _LONG), ("Shuffle Records Written", _LONG)),
    ),
)
EVENT = _fields(
    ("Event", _TEXT),
    ("App ID", _TEXT),
    ("App Attempt ID", _TEXT),
    ("Job ID", _LONG),
    ("Submission Time", _LONG),
    ("Completion Time", _LONG),
    ("Stage IDs", T.ArrayType(_LONG)),
    ("Stage Infos", T.ArrayType(STAGE_INFO)),
    ("Properties", T.MapType(_TEXT, _TEXT)),
    ("Job Result", _fields(("Result", _TEXT))),
    ("Stage Info", STAGE_INFO),
    ("Stage ID", _LONG),
    ("Stage Attempt ID", _LONG),
    ("Task Info", TASK_INFO),
    ("Task Metrics", TASK_METRICS),
    ("Task End Reason", _fields(("Reason", _TEXT))),
    ("Executor ID", _TEXT),
    ("Executor Info", _fields(("Total Cores", _LONG), ("Host", _TEXT))),
    ("executionId", _LONG),
    ("description", _TEXT),
    ("physicalPlanDescription", _TEXT),
    ("time", _LONG),
    ("_corrupt", _TEXT),
)

LINE_POSITION = "struct<file_no:int,file:string,block:bigint,line:bigint>"


# ---------------------------------------------------------------------------
# Lines
# ---------------------------------------------------------------------------
def _located(df: DataFrame, app_from: str, block: Column, line: Column) -> DataFrame:
    """Add the key of the application (its folder or file) and the position of a line."""
    file = F.col("file")
    rolling = F.regexp_extract(file, ROLLING_FOLDER, 1)
    single = file if app_from == "file" else F.regexp_extract(file, PARENT_FOLDER, 1)
    number = F.regexp_extract(file, ROLLING_FILE, 1)
    position = F.struct(
        F.when(number != "", number.cast("int")).otherwise(0).alias("file_no"),
        file.alias("file"),
        block.cast("bigint").alias("block"),
        line.cast("bigint").alias("line"),
    )
    return df.select(
        F.when(rolling != "", rolling).otherwise(single).alias("app_key"),
        position.alias("pos"),
        "value",
    )


def read_lines(
    spark: SparkSession,
    paths: str | Sequence[str],
    app_from: str = "file",
    gzip_by_content: bool = True,
) -> DataFrame:
    """``app_key, pos, value`` for every line below the paths; codecs go by file suffix.

    ``app_from``: a file outside a rolling log folder is one application (``"file"``) or
    part of the application of its folder (``"directory"``).  With ``gzip_by_content``
    files without a codec suffix that begin like gzip are unpacked too, whatever their size.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = _text(spark, paths)
    if not gzip_by_content:
        return _located(raw, app_from, F.col("block"), F.monotonically_increasing_id())
    zipped = gzip_files(spark, paths)
    plain = _located(raw, app_from, F.col("block"), F.monotonically_increasing_id())
    if not zipped:
        return plain
    inflated = _located(_inflated(spark, zipped), app_from, F.lit(0), F.col("line"))
    taken = spark.createDataFrame([(f,) for f in zipped], "taken string")
    # the driver holds these names: broadcast, or all lines would be shuffled to be told apart
    return plain.join(F.broadcast(taken), F.col("pos.file") == F.col("taken"), "left_anti").unionByName(inflated)


def _text(spark: SparkSession, paths: list[str], **options: str) -> DataFrame:
    text = spark.read.options(recursiveFileLookup="true", **options).text(paths)
    return text.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def gzip_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files that begin like gzip but lack the suffix Spark goes by, whatever else their name is.

    Tasks read two bytes of each file; only the names of those found reach the driver, which
    lists all names for Spark's own reader anyway.  Where the tasks have no client for the
    file system, the driver opens the files through Spark's.
    """
    named = reduce(DataFrame.unionByName, [log_files(spark, p) for p in paths])
    untold = named.where(~F.col("path").rlike(CODEC_SUFFIX) & (F.col("length") > 2)).select("path")
    if not _known_to_tasks(paths):
        return _gzip_files_by_driver(spark, untold)
    ship_package(spark)
    return [row["path"] for row in untold.mapInArrow(_zipped, "path string").toLocalIterator()]


def _known_to_tasks(paths: Sequence[str]) -> bool:
    """Whether tasks have a client for the file systems of the paths."""
    try:
        for path in paths:
            tailing.file_system(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([tailing.begins_like_gzip(unquote(p)) for p in batch.column(0).to_pylist()], pa.bool_()))


def _gzip_files_by_driver(spark: SparkSession, untold: DataFrame) -> list[str]:
    java, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def begins_like_gzip(path: str) -> bool:
        place = java.org.apache.hadoop.fs.Path(java.java.net.URI(path))
        stream = place.getFileSystem(conf).open(place)
        try:
            return (stream.read(), stream.read()) == (0x1F, 0x8B)
        finally:
            stream.close()

    with ThreadPoolExecutor(max_workers=HEADS_AT_ONCE) as pool:
        found = [row["path"] for row in untold.toLocalIterator()]
        return [path for path, yes in zip(found, pool.map(begins_like_gzip, found)) if yes]


def _inflated(spark: SparkSession, files: list[str]) -> DataFrame:
    """``file, line, value`` of gzip files that Spark takes for plain text.

    One task opens such a file, unpacks the stream and holds one chunk of it: nothing is shuffled.
    Where tasks have no client for the file system, Spark reads the bytes as lines in pieces of any
    number of tasks; each file's pieces then come in order to one task.
    """
    if _known_to_tasks([unquote(f) for f in files]):
        ship_package(spark)
        named = spark.createDataFrame([(f,) for f in files], "file string")
        return named.mapInPandas(_inflate_files, "file string, line bigint, value string")
    pieces = _text(spark, [unquote(f) for f in files], lineSep="\n").select(
        "file", "block", F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("piece")
    )
    ordered = pieces.repartition("file").sortWithinPartitions("file", "block", "at").select("file", "piece")
    return ordered.mapInPandas(_inflate, "file string, line bigint, value string")


def _inflate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of gzip files, in order, to line rows; a damaged file ends in a line that says so."""
    now, stream = None, None
    for batch in batches:
        for file, rows in batch.groupby("file", sort=False):
            if file != now:
                if stream is not None:
                    yield from stream.end()
                now, stream = file, _GzipLines(file)
            yield from stream.feed(b"\n".join(rows["piece"]) + b"\n")
    if stream is not None:
        yield from stream.end()


def _inflate_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Names of gzip files to line rows, as ``_inflate`` gives them."""
    for batch in batches:
        for file in batch["file"]:
            system, path, _ = tailing.file_system(unquote(file))
            lines = _GzipLines(file)
            with system.open_input_file(path) as stream:
                while not lines.broken and not lines.over and (data := stream.read(1 << 20)):
                    yield from lines.feed(data)
            yield from lines.end()


class _GzipLines:
    """Lines of one gzip file of one or more members; what follows the last member is ignored."""

    lines_per_batch = 20_000

    def __init__(self, file: str):
        self.file, self.number, self.rest, self.ready = file, 0, b"", []
        self.unpack = zlib.decompressobj(wbits=31)
        self.inside, self.members = False, 0  # of a member; members unpacked
        self.broken = self.over = False

    def feed(self, data: bytes) -> Iterator[pd.DataFrame]:
        for at in range(0, len(data), 1 << 20):
            part = data[at : at + (1 << 20)]
            while part and not (self.broken or self.over):
                if not self.inside and self.members and part[:1] != b"\x1f":
                    self.over = True
                    break
                try:
                    text = self.unpack.decompress(part)
                except zlib.error:
                    self.broken = True
                    break
                self.inside = not self.unpack.eof
                yield from self._lines(text)
                part = self.unpack.unused_data
                if self.unpack.eof:
                    self.members += 1
                    self.unpack = zlib.decompressobj(wbits=31)

    def _lines(self, text: bytes) -> Iterator[pd.DataFrame]:
        *whole, self.rest = (self.rest + text).split(b"\n")
        self.ready.extend(whole)
        while len(self.ready) >= self.lines_per_batch:
            yield self._frame(self.ready[: self.lines_per_batch])
            self.ready = self.ready[self.lines_per_batch :]

    def end(self) -> Iterator[pd.DataFrame]:
        self.ready.append(self.rest)
        if self.broken or self.inside:
            self.ready.append(DAMAGED.encode())
        yield self._frame(self.ready)

    def _frame(self, lines: list[bytes]) -> pd.DataFrame:
        first, self.number = self.number, self.number + len(lines)
        return pd.DataFrame(
            {
                "file": self.file,
                "line": range(first, first + len(lines)),
                "value": [line.decode("utf-8", "replace") for line in lines],
            }
        )


# ---------------------------------------------------------------------------
# Events
# ---------------------------------------------------------------------------
def _at(*path: str) -> str:
    """A field of the parsed line."""
    return ".".join(["e", *[f"`{name}`" for name in path]])


def _count(*path: str) -> str:
    return f"coalesce({_at(*path)}, 0)"


def _stage_info(info: str) -> str:
    return (
        f"named_struct('stage_id', {info}.`Stage ID`,"
        f" 'attempt_id', coalesce({info}.`Stage Attempt ID`, 0),"
        f" 'name', coalesce({info}.`Stage Name`, ''),"
        f" 'num_tasks', coalesce({info}.`Number of Tasks`, 0),"
        f" 'submission_ms', {info}.`Submission Time`,"
        f" 'completion_ms', {info}.`Completion Time`)"
    )


def _kind() -> str:
    """The event kind; a handled event without its required ids is malformed."""
    stage = f"{_at('Stage Info', 'Stage ID')} IS NULL"
    missing = {
        "job_start": f"{_at('Job ID')} IS NULL OR {_at('Stage IDs')} IS NULL"
        f" OR coalesce(exists({_at('Stage Infos')}, i -> i.`Stage ID` IS NULL), false)",
        "job_end": f"{_at('Job ID')} IS NULL",
        "stage_submitted": stage,
        "stage_completed": stage,
        "task_end": f"{_at('Stage ID')} IS NULL OR {_at('Stage Attempt ID')} IS NULL"
        f" OR ({_at('Task Info')} IS NOT NULL AND {_at('Task Info', 'Task ID')} IS NULL)",
        "executor_added": f"{_at('Executor ID')} IS NULL",
        "executor_removed": f"{_at('Executor ID')} IS NULL",
        "sql_start": f"{_at('executionId')} IS NULL",
        "sql_end": f"{_at('executionId')} IS NULL",
    }
    branches = [f"WHEN {_at('Event')} IS NULL THEN '{MALFORMED}'"]
    for event, name in EVENT_KINDS.items():
        broken = f"{_at('_corrupt')} IS NOT NULL OR ({missing.get(name, 'false')})"
        branches.append(f"WHEN {_at('Event')} = '{event}' THEN if({broken}, '{MALFORMED}', '{name}')")
    return f"CASE {' '.join(branches)} ELSE '{OTHER}' END"


def parse_lines(lines: DataFrame) -> DataFrame:
    """One flat row per non-blank line, with ``kind`` and the fields of that kind."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    task, metrics = "Task Info", "Task Metrics"
    reason = f"if({_at('Task End Reason')} IS NULL, NULL, coalesce({_at('Task End Reason', 'Reason')}, ''))"
    result = f"if({_at('Job Result')} IS NULL, NULL, coalesce({_at('Job Result', 'Result')}, ''))"
    fetched = _count(metrics, "Shuffle Read Metrics", "Remote Bytes Read")
    local = _count(metrics, "Shuffle Read Metrics", "Local Bytes Read")
    columns = {
        "raw": f"if(kind = '{MALFORMED}', value, NULL)",
        "app_id": _at("App ID"),
        "app_attempt": _at("App Attempt ID"),
        "job_id": _at("Job ID"),
        "submission_ms": _at("Submission Time"),
        "completion_ms": _at("Completion Time"),
        "stage_ids": _at("Stage IDs"),
        "stage_infos": f"transform({_at('Stage Infos')}, i -> {_stage_info('i')})",
        "call_site": f"{_at('Properties')}['{CALL_SITE_PROPERTY}']",
        "job_description": f"{_at('Properties')}['{DESCRIPTION_PROPERTY}']",
        "sql_ref": f"{_at('Properties')}['{SQL_ID_PROPERTY}']",
        "job_result": result,
        "stage": f"if({_at('Stage Info')} IS NULL, NULL, {_stage_info(_at('Stage Info'))})",
        "stage_id": _at("Stage ID"),
        "stage_attempt_id": _at("Stage Attempt ID"),
        "task_id": _at(task, "Task ID"),
        "task_index": _count(task, "Index"),
        "attempt": _count(task, "Attempt"),
        "executor_id": f"coalesce({_at(task, 'Executor ID')}, {_at('Executor ID')}, '')",
        "host": f"coalesce({_at(task, 'Host')}, '')",
        "failed": f"coalesce({reason} <> 'Success', {_at(task, 'Failed')}, false)",
        "finish_ms": _at(task, "Finish Time"),
        "duration": f"{_at(task, 'Finish Time')} - {_at(task, 'Launch Time')}",
        "executor_run_time": _count(metrics, "Executor Run Time"),
        "executor_cpu_time": _count(metrics, "Executor CPU Time"),
        "input_bytes": _count(metrics, "Input Metrics", "Bytes Read"),
        "input_records": _count(metrics, "Input Metrics", "Records Read"),
        "output_bytes": _count(metrics, "Output Metrics", "Bytes Written"),
        "output_records": _count(metrics, "Output Metrics", "Records Written"),
        "shuffle_read_bytes": f"{fetched} + {local}",
        "shuffle_read_records": _count(metrics, "Shuffle Read Metrics", "Total Records Read"),
        "shuffle_write_bytes": _count(metrics, "Shuffle Write Metrics", "Shuffle Bytes Written"),
        "shuffle_write_records": _count(metrics, "Shuffle Write Metrics", "Shuffle Records Written"),
        "memory_bytes_spilled": _count(metrics, "Memory Bytes Spilled"),
        "disk_bytes_spilled": _count(metrics, "Disk Bytes Spilled"),
        "peak_execution_memory": _count(metrics, "Peak Execution Memory"),
        "total_cores": _count("Executor Info", "Total Cores"),
        "execution_id": _at("executionId"),
        "description": _at("description"),
        "plan_description": _at("physicalPlanDescription"),
        "time_ms": _at("time"),
    }
    carried = [c for c in lines.columns if c != "value"]
    parsed = (
        lines.where(r"value RLIKE r'\S'")
        # a generated row: conditions on a plain column would be pushed below it and parse each line once more
        .select("*", F.explode(F.array(F.from_json("value", EVENT, options))).alias("e"))
        .withColumn("kind", F.expr(_kind()))
    )
    return parsed.selectExpr(*carried, "kind", *[f"{text} AS {name}" for name, text in columns.items()])


def stage_events(events: DataFrame, path: str) -> DataFrame:
    """Write parsed events once, task events apart from the rest but unsorted, and read them back."""
    part = F.when(F.col("kind") == "task_end", "tasks").otherwise("others")
    with open_files(events.sparkSession, 2):
        events.withColumn("part", part).write.option("compression", "zstd").partitionBy("part").parquet(path)
    return events.sparkSession.read.schema(f"{_ddl(events)}, part string").parquet(path)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def event_counts(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lines per event kind, ``malformed`` and ``other`` included."""
    return events.groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# Tables
# ---------------------------------------------------------------------------
class _Events:
    def __init__(self, events: DataFrame):
        self.events = events
        self.staged = "part" in events.columns

    def of(self, *kinds: str) -> DataFrame:
        rows = self.events.where(F.col("kind").isin(*kinds))
        if self.staged:
            rows = rows.where(F.col("part") == ("tasks" if kinds == ("task_end",) else "others"))
        return rows


def applications(events: DataFrame) -> DataFrame:
    """``app_key, app_id``: one application per log.

    A log is known by the last application id it names.  Where several logs name the same id
    (attempts of one application, or a log and its copy) they stay apart: the attempt is
    added if all of them name different ones, else the log's key.  A log without an
    application start is known by its key.
    """
    # the starts apart: positions are too wide for the hash aggregation of all lines
    starts = _Events(events).of("app_start").groupBy("app_key").agg(F.max_by(F.struct("app_id", "app_attempt"), "pos").alias("start"))
    logs = events.select("app_key").distinct().join(starts, "app_key", "left").select("app_key", "start.app_id", "start.app_attempt")
    alike = logs.where("app_id IS NOT NULL").groupBy("app_id").agg(
        F.count(F.lit(1)).alias("logs"), F.count_distinct("app_attempt").alias("attempts")
    )
    named = logs.join(alike, "app_id", "left")
    name = (
        F.when(F.col("app_id").isNull(), F.col("app_key"))
        .when(F.col("logs") == 1, F.col("app_id"))
        .when(F.col("attempts") == F.col("logs"), F.concat_ws("/", "app_id", "app_attempt"))
        .otherwise(F.concat_ws("@", "app_id", "app_key"))
    )
    return named.select("app_key", name.alias("app_id"))


def _with_app(df: DataFrame, apps: DataFrame) -> DataFrame:
    return df.drop("app_id", "app_attempt").join(apps, "app_key").drop("app_key")


def task_rows(task_ends: DataFrame) -> DataFrame:
    """Flat task rows from task-end events (events without task info hold no task)."""
    return task_ends.where("task_id is not null").withColumns(
        {
            "status": F.when(F.col("failed"), "FAILED").otherwise("SUCCESS"),
            "finish_time": F.timestamp_millis("finish_ms"),
        }
    )


def stage_metric_sums() -> list[Column]:
    """Aggregates that turn task rows into the metrics of a stage attempt."""
    return [
        *[F.sum(name).alias(name) for name in M.SUMMED_METRICS],
        F.max("peak_execution_memory").alias("peak_execution_memory"),
        F.count_if(F.col("status") != "FAILED").alias("num_complete_tasks"),
        F.count_if(F.col("status") == "FAILED").alias("num_failed_tasks"),
    ]


def stage_metrics(tasks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summed metrics per stage attempt (fixed-width sums, combined before the shuffle)."""
    return tasks.groupBy(*by, "stage_id", F.col("stage_attempt_id").alias("attempt_id")).agg(
        *stage_metric_sums()
    )


def _jobs(events: _Events) -> DataFrame:
    name = F.coalesce("call_site", "job_description", F.concat(F.lit("Job "), F.col("job_id")))
    num_tasks = F.coalesce(
        F.aggregate(
            "stage_infos", F.lit(0).cast("bigint"), lambda total, info: total + info["num_tasks"]
        ),
        F.lit(0),
    )
    start = F.struct(
        name.alias("name"), num_tasks.alias("num_tasks"), F.col("submission_ms"), F.col("stage_ids")
    )
    starts = events.of("job_start").groupBy("app_key", "job_id").agg(
        F.max_by(start, "pos").alias("start"), F.max("pos").alias("start_pos")
    )
    ends = events.of("job_end").groupBy("app_key", "job_id").agg(
        F.max_by(F.struct("completion_ms", "job_result"), "pos").alias("end"),
        F.max("pos").alias("end_pos"),
    )
    ended = F.col("end_pos") > F.col("start_pos")
    status = (
        F.when(~F.coalesce(ended, F.lit(False)), M.JOB_RUNNING)
        .when(F.col("end.job_result").isNull(), M.JOB_UNKNOWN)
        .when(F.col("end.job_result") == "JobSucceeded", M.JOB_SUCCEEDED)
        .otherwise(M.JOB_FAILED)
    )
    zero = F.lit(0).cast("bigint")
    return (
        starts.join(ends, ["app_key", "job_id"], "left")
        .withColumn("status", status)
        .select(
            "app_key",
            "job_id",
            "start.name",
            "status",
            F.timestamp_millis("start.submission_ms").alias("submission_time"),
            F.when(ended, F.timestamp_millis("end.completion_ms")).alias("completion_time"),
            "start.stage_ids",
            "start.num_tasks",
            zero.alias("num_active_tasks"),
            F.when(F.col("status") == M.JOB_SUCCEEDED, F.col("start.num_tasks"))
            .otherwise(zero)
            .alias("num_completed_tasks"),
            zero.alias("num_skipped_tasks"),
            (F.col("status") == M.JOB_FAILED).cast("bigint").alias("num_failed_tasks"),
            *[
                zero.alias(name)
                for name in (
                    "num_killed_tasks", "num_completed_indices", "num_active_stages",
                    "num_completed_stages", "num_skipped_stages", "num_failed_stages",
                )
            ],
        )
    )


STAGE_KEYS = ("app_key", "stage_id", "attempt_id")


def stage_sums(task_ends: DataFrame) -> DataFrame:
    """What tasks add to their stage attempt: summed metrics, and where the first failure is logged."""
    keys = list(STAGE_KEYS)
    tasks = task_rows(task_ends)
    # failed tasks only: positions are too wide for the hash aggregation of the sums
    failures = (
        tasks.where("failed")
        .groupBy("app_key", "stage_id", F.col("stage_attempt_id").alias("attempt_id"))
        .agg(F.min("pos").alias("failed_pos"))
    )
    return stage_metrics(tasks, ["app_key"]).join(failures, keys, "left")


def _stages(events: _Events, sums: DataFrame | None = None) -> DataFrame:
    keys = list(STAGE_KEYS)
    announced = events.of("job_start").select(
        "app_key", "pos", F.explode("stage_infos").alias("stage"),
        F.lit(None).cast(LINE_POSITION).alias("submit_pos"),
    )
    submitted = events.of("stage_submitted").select(
        "app_key", "pos", "stage", F.col("pos").alias("submit_pos")
    )
    known = (
        announced.unionByName(submitted)
        .select("app_key", "pos", "submit_pos", "stage.*")
        .groupBy(*keys)
        .agg(
            F.min_by(F.struct("name", "num_tasks"), "pos").alias("first"),
            F.min("pos").alias("first_pos"),
            F.max_by("submission_ms", "submit_pos").alias("submission_ms"),
            F.max("submit_pos").alias("submit_pos"),
        )
    )
    completed = (
        events.of("stage_completed")
        .select("app_key", "pos", "stage.*")
        .groupBy(*keys)
        .agg(F.max_by("completion_ms", "pos").alias("done_ms"), F.max("pos").alias("done_pos"))
    )
    sums = stage_sums(events.of("task_end")) if sums is None else sums
    done = F.coalesce(F.col("done_pos") > F.col("first_pos"), F.lit(False))
    open_again = F.coalesce(F.col("submit_pos") > F.col("done_pos"), F.lit(False))
    status = (
        F.when(done & ~open_again & (F.col("failed_pos") < F.col("done_pos")), M.STAGE_FAILED)
        .when(done & ~open_again, M.STAGE_COMPLETE)
        .when(F.col("submit_pos").isNotNull(), M.STAGE_ACTIVE)
        .otherwise(M.STAGE_PENDING)
    )
    zero = F.lit(0).cast("bigint")
    return (
        known.join(completed, keys, "left")
        .join(sums, keys, "left")
        .select(
            "app_key",
            status.alias("status"),
            "stage_id",
            "attempt_id",
            "first.num_tasks",
            zero.alias("num_active_tasks"),
            F.coalesce("num_complete_tasks", zero).alias("num_complete_tasks"),
            F.coalesce("num_failed_tasks", zero).alias("num_failed_tasks"),
            zero.alias("num_killed_tasks"),
            *[F.coalesce(m, zero).alias(m) for m in M.TASK_METRICS],
            "first.name",
            F.timestamp_millis("submission_ms").alias("submission_time"),
            F.when(done, F.timestamp_millis("done_ms")).alias("completion_time"),
            F.timestamp_millis("submission_ms").alias("first_task_launched_time"),
        )
    )


def _sql_starts(events: _Events) -> DataFrame:
    return events.of("sql_start").groupBy("app_key", "execution_id").agg(
        F.max_by(F.struct("description", "plan_description", "time_ms"), "pos").alias("start"),
        F.max("pos").alias("sql_pos"),
    )


def _sql_executions(events: _Events) -> DataFrame:
    ends = events.of("sql_end").groupBy("app_key", "execution_id").agg(
        F.max_by("time_ms", "pos").alias("end_ms"), F.max("pos").alias("end_pos")
    )
    end_ms = F.when(F.col("end_pos") > F.col("sql_pos"), F.col("end_ms"))
    return _sql_starts(events).join(ends, ["app_key", "execution_id"], "left").select(
        "app_key",
        F.col("execution_id").alias("id"),
        F.when(end_ms.isNotNull(), "COMPLETED").otherwise("RUNNING").alias("status"),
        F.coalesce("start.description", F.lit("")).alias("description"),
        F.coalesce("start.plan_description", F.lit("")).alias("plan_description"),
        F.timestamp_millis("start.time_ms").alias("submission_time"),
        F.coalesce(end_ms - F.col("start.time_ms"), F.lit(0)).alias("duration"),
    )


def _sql_jobs(events: _Events) -> DataFrame:
    """Jobs that name an SQL execution whose start was logged before theirs."""
    named = events.of("job_start").select(
        "app_key",
        "job_id",
        "pos",
        F.when(F.col("sql_ref").rlike(r"^[+-]?\d+$"), F.col("sql_ref").try_cast("bigint"))
        .alias("execution_id"),
    )
    return (
        named.where("execution_id is not null")
        .join(_sql_starts(events).drop("start"), ["app_key", "execution_id"])
        .where("sql_pos < pos")
        .select("app_key", F.col("execution_id").alias("sql_id"), "job_id", F.lit("success").alias("state"))
        .distinct()
    )


def _executors(events: _Events) -> DataFrame:
    added = events.of("executor_added").groupBy("app_key", "executor_id").agg(
        F.max_by("total_cores", "pos").alias("total_cores"), F.max("pos").alias("add_pos")
    )
    removed = events.of("executor_removed").groupBy("app_key", "executor_id").agg(
        F.max("pos").alias("remove_pos")
    )
    gone = F.coalesce(F.col("remove_pos") > F.col("add_pos"), F.lit(False))
    return added.join(removed, ["app_key", "executor_id"], "left").select(
        "app_key",
        F.col("executor_id").alias("id"),
        "total_cores",
        F.lit(0).cast("bigint").alias("max_memory"),
        (~gone).alias("is_active"),
    )


def telemetry_of(events: DataFrame, sums: DataFrame | None = None, apps: DataFrame | None = None) -> M.Telemetry:
    """The telemetry tables of parsed (best: staged) events, keyed by ``app_id``.

    ``sums`` holds what ``stage_sums`` makes of the task events, where those are not at hand;
    ``apps`` holds the names of the logs (``app_key, app_id``), where they are not to be found
    out from the events.
    """
    ev = _Events(events)
    if apps is None:
        # counted first: a join by shuffle would send all tasks of a log to one task
        apps = small_side(applications(events)) if ev.staged else applications(events)
    jobs = _with_app(_jobs(ev), apps)
    tables = {
        "tasks": _with_app(task_rows(ev.of("task_end")), apps),
        "stages": _with_app(_stages(ev, sums), apps),
        "jobs": jobs,
        "job_stages": jobs.select("app_id", "job_id", F.explode("stage_ids").alias("stage_id")),
        "sql_executions": _with_app(_sql_executions(ev), apps),
        "sql_jobs": _with_app(_sql_jobs(ev), apps),
        "executors": _with_app(_executors(ev), apps),
    }
    return M.Telemetry(
        **{name: df.select(*M.TABLE_SCHEMAS[name].fieldNames()) for name, df in tables.items()}
    )


def read_events(
    spark: SparkSession,
    paths: str | Sequence[str],
    app_from: str = "file",
    gzip_by_content: bool = True,
    staging: bool = True,
    pick: str = "all",
    spread: int | None = None,
) -> DataFrame:
    """Event logs to parsed events, for ``telemetry_of`` and ``skipped_lines``.

    ``pick="largest"`` reads only the largest file of every folder; by default all files
    count, as rolling logs need.  ``staging=False`` re-parses the text for every table.
    ``spread`` deals the lines to that many tasks before parsing: compressed files cannot be
    split, so one very large log would otherwise be parsed by one task.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if pick == "largest":
        chosen = reduce(DataFrame.unionByName, [largest_per_folder(spark, p) for p in paths])
        paths = [unquote(row["path"]) for row in chosen.select("path").toLocalIterator()]
    lines = read_lines(spark, paths, app_from, gzip_by_content)
    events = parse_lines(lines if spread is None else lines.repartition(spread))
    return stage_events(events, new_folder(spark, "events")) if staging else events


def read_event_log(
    spark: SparkSession,
    paths: str | Sequence[str],
    app_from: str = "file",
    gzip_by_content: bool = True,
    staging: bool = True,
    pick: str = "all",
    spread: int | None = None,
) -> M.Telemetry:
    """Event logs to telemetry; the options are those of ``read_events``."""
    return telemetry_of(read_events(spark, paths, app_from, gzip_by_content, staging, pick, spread))


def skipped_lines(events: DataFrame) -> DataFrame:
    """Per log: lines read, and lines skipped because they are malformed."""
    return events.groupBy("app_key").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("kind") == MALFORMED).alias("skipped")
    )


# ---------------------------------------------------------------------------
# Choice of logs
# ---------------------------------------------------------------------------
def log_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, length`` of the files below a root (names and sizes only, no content)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.col("_metadata.file_path").alias("path"), "length")


def discover_event_log(spark: SparkSession, root: str) -> str | None:
    """The largest file of a folder, or of its first sub-folder that holds files."""
    root = root.rstrip("/")
    tail = F.substring_index("path", root + "/", -1)
    try:
        files = log_files(spark, root).where("length > 0")
    except AnalysisException:
        return None
    depth = F.size(F.split(tail, "/"))
    best = (
        files.select("path", "length", depth.alias("depth"), F.substring_index(tail, "/", 1).alias("top"))
        .where("depth <= 2")
        .orderBy(
            "depth", F.when(F.col("depth") > 1, F.col("top")).asc_nulls_first(),
            F.col("length").desc(), "path",
        )
        .first()
    )
    return best["path"] if best else None


def largest_per_folder(spark: SparkSession, root: str) -> DataFrame:
    """The largest file of every folder below a root, for reading one file per application."""
    folder = F.regexp_extract("path", PARENT_FOLDER, 1)
    return (
        log_files(spark, root)
        .groupBy(folder.alias("folder"))
        .agg(F.min_by("path", F.struct((-F.col("length")).alias("size"), "path")).alias("path"))
    )


def load_first(
    spark: SparkSession, roots: Sequence[str], app_from: str = "directory", unreadable: list[tuple[str, str]] | None = None
) -> M.Telemetry | None:
    """The first root whose logs hold a job or a stage.

    A missing, empty or unreadable root is skipped; ``unreadable`` collects (root, reason)
    of the last kind.  Any other failure, a lost executor for one, is raised: the answer never
    comes from a later root because of it.
    """
    for root in roots:
        try:
            events = read_events(spark, root, app_from)
            if events.where(F.col("kind").isin("job_start", "stage_submitted", "stage_completed")).isEmpty():
                continue
            return telemetry_of(events)
        except (PySparkException, Py4JJavaError) as error:
            missing = isinstance(error, AnalysisException) and error.getCondition() == "PATH_NOT_FOUND"
            if not missing and READ_FAULT not in str(error):
                raise
            if not missing and unreadable is not None:
                unreadable.append((root, str(error).splitlines()[0]))
    return None
