"""Where intermediate tables go.

The cluster names a shared folder in ``spark.checkpoint.dir``; every written
intermediate and every checkpoint lives below it, so a lost executor can re-read it.
Only a local session may fall back to a temporary folder.
"""

from __future__ import annotations

import os
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session; sets one for local sessions without it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = context.getCheckpointDir()
    if current is None:
        if not re.match(r"local(\[|$)", context.master):  # one process; not local-cluster
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="emberscope-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; only ``expire_folders`` ever removes one."""
    return f"{shared_folder(spark)}/emberscope/{label}-{uuid.uuid4().hex}"


def expire_folders(spark: SparkSession, older_than_seconds: float) -> list[str]:
    """Remove written intermediates below the shared folder that were last changed longer ago.

    Their tables can no longer be read: give an age beyond that of any session in use.
    Returns the removed paths; checkpoints of Spark itself are not touched.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(f"{shared_folder(spark)}/emberscope")
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(top):
        return []
    before = (time.time() - older_than_seconds) * 1000
    old = [status.getPath() for status in system.listStatus(top) if status.getModificationTime() < before]
    return [path.toString() for path in old if system.delete(path, True)]


@contextmanager
def open_files(spark: SparkSession, most: int) -> Iterator[None]:
    """Writes by partition column inside keep up to so many files open per task; rows are not sorted for it."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


_PACKAGE_PARENT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship_package(spark: SparkSession) -> None:
    """Put the package's folder on the path of Python workers that share it with the driver."""
    environment = spark.sparkContext.environment
    if _PACKAGE_PARENT not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [_PACKAGE_PARENT, environment.get("PYTHONPATH")]))
