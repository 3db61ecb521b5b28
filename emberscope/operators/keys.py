"""Small helpers for operators that work per key prefix or over the whole input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_totals(df: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the columns of a one-row-per-key table to every row.

    With a key prefix this is a left equi-join whose small side Spark broadcasts when its
    size allows.  Without one, the single row is read as a scalar subquery.
    """
    if by:
        return df.join(totals, list(by), "left")
    row = totals.select(F.struct("*").alias("row")).scalar()
    names = totals.columns
    return df.withColumn("_row", row).select(*df.columns, *[F.col("_row")[n].alias(n) for n in names])


SMALL_TABLE = 200_000  # rows up to which a narrow lookup table is broadcast


def small_side(lookup: DataFrame, most: int = SMALL_TABLE) -> DataFrame:
    """The lookup marked for broadcast if it is counted to be small; else as it is, so that
    the join shuffles and adaptive execution splits its hot keys."""
    return F.broadcast(lookup) if lookup.limit(most + 1).count() <= most else lookup


def top_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key, with their number in ``row_no``.

    Per key, Spark keeps at most ``n`` rows of a key per task before the shuffle; without
    a key it is a distributed top-n.  Either way a group holds a bounded number of rows.
    """
    if by:
        window = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn("row_no", F.row_number().over(window)).where(F.col("row_no") <= n)
    first = df.orderBy(*order).limit(n)
    return first.withColumn("row_no", F.row_number().over(Window.orderBy(*order)))


def salted_lookup(
    facts: DataFrame, lookup: DataFrame, on: Sequence[str], spread: Column, salts: int = 64
) -> DataFrame:
    """Inner join of a large table with one row per key, safe for a hot key.

    The lookup row is repeated once per salt and the facts carry a salt taken from
    ``spread``, so the facts of one key are spread over ``salts`` partitions.
    """
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"]).drop("_salt")
