"""Row numbers over a whole sorted table without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberscope.operators.keys import small_side
from emberscope.workspace import shared_folder

_ROWS_PER_PARTITION_BITS = 33  # layout of monotonically_increasing_id


def with_rank(
    df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "rank"
) -> DataFrame:
    """Number the rows 1, 2, 3, ... in ``order``, restarting for each key.

    The rows are range-partitioned and sorted, so a large key spans many tasks.  The
    sorted rows are checkpointed; the number of rows before each partition (one row per
    partition) then turns positions inside partitions into positions overall.
    """
    spark = df.sparkSession
    shared_folder(spark)
    keys = [F.col(k).asc_nulls_first() for k in by] + list(order)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .checkpoint()
    )
    part = F.shiftright(F.col("_at"), _ROWS_PER_PARTITION_BITS)
    inside = F.col("_at") - F.shiftleft(part, _ROWS_PER_PARTITION_BITS)
    placed = placed.select("*", part.alias("_part"), inside.alias("_inside")).drop("_at")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    # one row per range partition, so its size is known and small
    numbered = placed.join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_offset") + F.col("_inside") + 1
    )
    numbered = numbered.drop("_part", "_inside", "_offset")
    if not by:
        return numbered
    starts = numbered.groupBy(*by).agg(F.min(name).alias("_start"))
    return numbered.join(small_side(starts), list(by)).withColumn(name, F.col(name) - F.col("_start") + 1).drop(
        "_start"
    )
