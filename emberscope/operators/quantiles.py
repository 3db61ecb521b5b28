"""Exact order statistics per group that survive a group with a third of all rows.

The built-in ``percentile`` keeps the distinct values of a group in one buffer, which is right
for groups of a known modest size; their rows are dealt out by group as they are, for buffers
of parts of groups would be wider than the rows.  The rows of larger groups are counted per (group, value),
which Spark combines before the shuffle and spreads by value.  Values fall into
order-preserving buckets (at most about 55,000 per group) and, inside a bucket, into at most
65,536 parts, so a short window over the sums of the cells finds the cells that hold the
wanted ranks.  Only the values inside those are ordered: one value below 2^28, at most 2^16
different ones below 2^44.  Sizes come from a table of groups and part the rows by a join
inside the plan: nothing runs while it is built, and an empty part is skipped at run time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LARGE_GROUP = 65_536  # rows of a group up to which one buffer may hold its values
LARGE_PARTS = 32  # tasks that share a large group where its rows are told apart
SIZE_CELLS = 32_768  # hash cells whose rows are counted before those of single groups

_BASE_BITS, _STEP_BITS, _VALUE_BITS = 12, 4, 63
_PART_BITS, _PARTS = 16, 1


def value_bucket(value: Column) -> Column:
    """Monotone bucket of a bigint: exact below 4096, then within 1/256 of the value."""
    size = F.abs(value)
    bucket = F.when(size < (1 << _BASE_BITS), size)
    step, bits = 0, _BASE_BITS
    while bits < _VALUE_BITS:
        step, bits = step + 1, bits + _STEP_BITS
        inner = F.shiftright(size, _STEP_BITS * step) + F.lit(step << _BASE_BITS)
        bucket = bucket.when(size < (1 << bits), inner) if bits < _VALUE_BITS else bucket.otherwise(inner)
    return F.when(value < 0, -bucket).otherwise(bucket).cast("int")


def _bucket_bits(value: Column) -> Column:
    """How many low bits of the value its bucket leaves open."""
    size = F.abs(value)
    bits_open = F.when(size < (1 << _BASE_BITS), F.lit(0))
    step, bits = 0, _BASE_BITS
    while bits < _VALUE_BITS:
        step, bits = step + 1, bits + _STEP_BITS
        known = F.lit(_STEP_BITS * step)
        bits_open = bits_open.when(size < (1 << bits), known) if bits < _VALUE_BITS else bits_open.otherwise(known)
    return bits_open


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows per (keys, value); NULL values are left out."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("value"))
        .agg(F.count(F.lit(1)).alias("times"))
    )


def _with_cells(counts: DataFrame) -> DataFrame:
    """Add ``cell_0``, the bucket, and ``cell_1`` and on, the parts inside it, in value order."""
    rows = counts.withColumns({"cell_0": value_bucket(F.col("value")), "_open": _bucket_bits(F.col("value"))})
    inside = "abs(value) & (shiftleft(1L, _open) - 1)"
    for k in range(1, _PARTS + 1):
        part = f"shiftright({inside}, greatest(_open - {_PART_BITS * k}, 0)) & {(1 << _PART_BITS) - 1}"
        known = f"CASE WHEN _open <= {_PART_BITS * (k - 1)} THEN 0L ELSE {part} END"
        rows = rows.withColumn(f"cell_{k}", F.expr(f"CAST(CASE WHEN value < 0 THEN -({known}) ELSE {known} END AS int)"))
    return rows.drop("_open")


def _rank(n: Column, p: float) -> tuple[Column, Column]:
    """0-based lower and upper rank of quantile ``p`` by linear interpolation."""
    at = (n - 1).cast("double") * F.lit(float(p))
    return F.floor(at), F.ceil(at)


def _weight(n: Column, p: float) -> Column:
    at = (n - 1).cast("double") * F.lit(float(p))
    return at - F.floor(at)


def _joined(rows: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which a NULL key is a group like any other."""
    named = found.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(named[f"_{k}"])
    return rows.join(named, same).drop(*[f"_{k}" for k in keys])


def quantiles_of_counts(
    counts: DataFrame, keys: Sequence[str], probs: dict[str, float]
) -> DataFrame:
    """Interpolated quantiles from ``value_counts``, one row per group.

    Returns ``keys, n`` and one double column per entry of ``probs``.
    """
    keys = list(keys)
    rows = _with_cells(counts)
    wanted = F.lit(False)
    for p in probs.values():
        for rank in _rank(F.col("n"), p):
            wanted = wanted | (
                (rank >= F.col("rows_before")) & (rank < F.col("rows_before") + F.col("rows_in"))
            )
    places: list[str] = []
    for k in range(_PARTS + 1):
        cell = f"cell_{k}"
        earlier = Window.partitionBy(*keys, *places).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
        carried = [F.first("rows_before").alias("outside"), F.first("n").alias("n")] if k else []
        sums = rows.groupBy(*keys, *places, cell).agg(F.sum("times").alias("rows_in"), *carried)
        ahead = F.coalesce(F.sum("rows_in").over(earlier), F.lit(0))
        total = F.col("n") if k else F.sum("rows_in").over(Window.partitionBy(*keys))
        placed = sums.select(
            *keys, *places, cell, "rows_in", (ahead + F.col("outside") if k else ahead).alias("rows_before"), total.alias("n")
        )
        places = [*places, cell]
        rows = _joined(rows.drop("rows_before", "n"), placed.where(wanted).drop("rows_in"), [*keys, *places])
    inside = Window.partitionBy(*keys, *places).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn(
        "first", F.col("rows_before") + F.coalesce(F.sum("times").over(inside), F.lit(0))
    ).withColumn("after", F.col("first") + F.col("times"))
    picks, names = [F.max("n").alias("n")], []
    for i, (name, p) in enumerate(probs.items()):
        low, high = _rank(F.col("n"), p)
        for side, rank in (("low", low), ("high", high)):
            hit = (rank >= F.col("first")) & (rank < F.col("after"))
            picks.append(F.max(F.when(hit, F.col("value"))).alias(f"_{side}{i}"))
        names.append((i, name, p))
    found = placed.groupBy(*keys).agg(*picks)
    columns = []
    for i, name, p in names:
        low, high = F.col(f"_low{i}").cast("double"), F.col(f"_high{i}").cast("double")
        weight = _weight(F.col("n"), p)
        columns.append(
            F.when(F.col(f"_low{i}") == F.col(f"_high{i}"), low)
            .otherwise(low * (F.lit(1.0) - weight) + high * weight)
            .alias(name)
        )
    return found.select(*keys, "n", *columns)


def large_sizes(df: DataFrame, keys: Sequence[str], large: int = LARGE_GROUP) -> DataFrame:
    """``keys, n`` of every group of more than ``large`` rows.

    Counts of single groups hardly combine before the shuffle where a task sees few rows of each, so their
    number would follow the rows.  Hash cells are counted first, a bounded number per task; only groups in
    cells of more than ``large`` rows can be that large, and only their rows are counted by group.
    """
    cell = F.pmod(F.xxhash64(*keys), F.lit(SIZE_CELLS)).cast("int")
    cells = df.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > large).select("_cell")
    rows = df.select(*keys).join(F.broadcast(cells), cell == cells["_cell"], "left_semi")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large)


def parted(df: DataFrame, sizes: DataFrame | None, keys: Sequence[str], large: int = LARGE_GROUP) -> tuple[DataFrame, DataFrame]:
    """``(rows of groups of up to large rows, rows of larger groups)`` by a table (keys, n), or as counted here.

    The keys of large groups are broadcast: by their size they are fewer than one in 65,536 rows.
    Where ``large`` is below that, the keys are repeated once per part and the rows dealt to the
    parts, so that a large group is several tasks' work where the join shuffles.
    """
    sizes = large_sizes(df, keys, large) if sizes is None else sizes
    if large >= LARGE_GROUP:
        over = F.broadcast(sizes.where(F.col("n") > large).select(*[F.col(k).alias(f"_{k}") for k in keys]))
        same = reduce(and_, [df[k].eqNullSafe(over[f"_{k}"]) for k in keys])
        return df.join(over, same, "left_anti"), df.join(over, same, "left_semi")
    parts = F.explode(F.sequence(F.lit(0), F.lit(LARGE_PARTS - 1))).alias("_part_of")
    over = sizes.where(F.col("n") > large).select(*[F.col(k).alias(f"_{k}") for k in keys], parts)
    dealt = df.withColumn("_part", (F.monotonically_increasing_id() % LARGE_PARTS).cast("int"))
    same = dealt["_part"] == over["_part_of"]
    for k in keys:  # a NULL key is a group like any other
        same = same & dealt[k].eqNullSafe(over[f"_{k}"])
    return dealt.join(over, same, "left_anti").drop("_part"), dealt.join(over, same, "left_semi").drop("_part")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], large: int = LARGE_GROUP
) -> DataFrame:
    """``keys, n`` and the named quantiles of an integer column, NULLs left out."""
    for p in probs.values():
        if not (0.0 <= p <= 1.0 and math.isfinite(p)):
            raise ValueError(f"quantile outside 0..1: {p}")
    known = df.select(*keys, value).where(F.col(value).isNotNull())
    small, big = parted(known, known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, large)
    levels = F.array(*[F.lit(float(p)) for p in probs.values()])
    buffered = (
        small.repartition(*keys).groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.percentile(value, levels).alias("_levels"))
        .select(*keys, "n", *[F.col("_levels")[i].alias(name) for i, name in enumerate(probs)])
    )
    return buffered.unionByName(quantiles_of_counts(value_counts(big, keys, value), keys, probs))
