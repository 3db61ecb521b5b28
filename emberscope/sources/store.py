"""Telemetry and findings as Parquet (and JSON) tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscope.model import TABLE_SCHEMAS, Telemetry
from emberscope.workspace import new_folder

_CLUSTER_KEYS = ("app_id", "stage_id", "task_id", "job_id", "sql_id", "id")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows computed once, as a table in the shared folder."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replaced(df: DataFrame, path: str) -> DataFrame:
    """The rows computed once, as a table that replaces what lies at the path."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(telemetry: Telemetry, label: str = "telemetry") -> Telemetry:
    """Every table but tasks computed once; tasks stay the scan they are."""
    return telemetry.map(lambda name, df: df if name == "tasks" else written(df, f"{label}-{name}"))


def clustered(df: DataFrame) -> DataFrame:
    """Range-partition by application and ids: neighbours share files, and a large
    application spans as many files as it needs."""
    keys = [k for k in _CLUSTER_KEYS if k in df.columns]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df


def write_telemetry(telemetry: Telemetry, path: str, mode: str = "errorifexists") -> None:
    """One Parquet folder per table; tables with ``app_id`` are partitioned by it."""
    for name, df in telemetry.tables().items():
        writer = clustered(df).write.mode(mode).option("compression", "zstd")
        if "app_id" in df.columns:
            writer = writer.partitionBy("app_id")
        writer.parquet(f"{path.rstrip('/')}/{name}")


def read_telemetry(spark: SparkSession, path: str) -> Telemetry:
    """Stored tables with their declared schema, so filters on ``app_id`` prune folders."""
    return Telemetry(
        **{
            name: spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{name}")
            for name, schema in TABLE_SCHEMAS.items()
        }
    )


# ---------------------------------------------------------------------------
# Tasks by stage
# ---------------------------------------------------------------------------
STAGE_BUCKETS = 64
TASK_PARTS = 16  # of a stage, so that none is one task's work


def _stage_bucket(by: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*by, "stage_id"), F.lit(buckets)).cast("int")


def write_tasks_by_stage(tasks: DataFrame, path: str, by: Sequence[str] = (), buckets: int = STAGE_BUCKETS, mode: str = "errorifexists") -> None:
    """Tasks in folders by a hash of their stage and sorted by stage inside, for ``read_tasks_of``.

    The rows are dealt by range, so a large stage spans as many files as it needs.
    """
    order = ["stage_bucket", *by, "stage_id", "task_id"]
    rows = tasks.withColumn("stage_bucket", _stage_bucket(by, buckets)).repartitionByRange(*order).sortWithinPartitions(*order)
    writer = rows.write.mode(mode).option("parquet.bloom.filter.enabled#stage_id", "true")
    writer.partitionBy("stage_bucket").parquet(path)


def read_tasks_of(spark: SparkSession, path: str, chosen: DataFrame, by: Sequence[str] = (), buckets: int = STAGE_BUCKETS) -> DataFrame:
    """The tasks of the chosen stages (and attempts, if ``chosen`` names them) alone.

    The folders to be read follow from the chosen stages at run time (dynamic partition
    pruning), whether those come from a table or from another part of the same plan.
    ``buckets`` is the number the tasks were written with.
    """
    keys = [*by, "stage_id"]
    attempts = "attempt_id" in chosen.columns
    wanted = chosen.select(*keys, *(["attempt_id"] if attempts else [])).distinct().withColumn("stage_bucket", _stage_bucket(by, buckets))
    if attempts:
        wanted, keys = wanted.withColumnRenamed("attempt_id", "stage_attempt_id"), [*keys, "stage_attempt_id"]
    tasks = spark.read.parquet(path)
    wanted = wanted.where("stage_bucket >= 0")  # lets the optimizer take the side for a selective one
    return tasks.join(wanted, ["stage_bucket", *keys], "left_semi").drop("stage_bucket")


def write_task_table(
    tasks: DataFrame, name: str, path: str, by: Sequence[str] = (), buckets: int = STAGE_BUCKETS, mode: str = "errorifexists"
) -> None:
    """Tasks as a table of the catalog at that path, bucketed by stage and part of the stage, for ``merged_task_table``."""
    part = F.pmod(F.xxhash64("task_id"), F.lit(TASK_PARTS)).cast("int")
    rows = tasks.withColumn("stage_part", part)
    keys = [*by, "stage_id", "stage_part"]
    rows.repartition(buckets, *keys).write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)


def merged_task_table(spark: SparkSession, name: str, new: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The new rows, and the rows of the table for stages that the new ones do not hold.

    The table is joined as it lies, bucket by bucket: only the list of new stages is dealt out.
    """
    keys = [*by, "stage_id"]
    fresh = new.select(*keys).distinct().withColumn("stage_part", F.explode(F.sequence(F.lit(0), F.lit(TASK_PARTS - 1))))
    kept = spark.table(name).join(fresh, [*keys, "stage_part"], "left_anti").drop("stage_part")
    return new.unionByName(kept, allowMissingColumns=True)


def write_report(tables: dict[str, DataFrame], path: str, source: str, mode: str = "errorifexists") -> None:
    """Result tables stamped with their source and the time of writing; findings as JSON too (gzip)."""
    for name, df in tables.items():
        target = f"{path.rstrip('/')}/{name}"
        stamped = df.withColumns({"data_source": F.lit(source), "written_at": F.current_timestamp()})
        stamped.write.mode(mode).parquet(target)
        if name == "suspects":
            df.sparkSession.read.schema(stamped.schema).parquet(target).write.mode(mode).option("compression", "gzip").json(f"{target}_json")
