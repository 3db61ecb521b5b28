"""Reading the given tables, hash folds, and tables written between steps."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscope.workspace import new_folder

_PACKAGE_PARENT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; Python workers get the package's folder on their path."""
    environment = spark.sparkContext.environment
    if _PACKAGE_PARENT not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [_PACKAGE_PARENT, environment.get("PYTHONPATH")]))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def settled(df: DataFrame, label: str) -> DataFrame:
    """The rows written once below the shared folder and read back: no step before them is
    repeated, and a lost executor loses nothing."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
