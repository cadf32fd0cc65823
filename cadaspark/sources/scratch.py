"""Shared scratch space: intermediate tables used by several branches are written once.

The folder is the cluster's ``spark.checkpoint.dir``, so a lost executor never loses a kept table.
Only a local session without that setting gets a temporary folder.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
# Shuffle files otherwise stay on the executors' disks until the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {SETTING} to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="cadaspark-")
    return _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def large(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the data: sorted and merged, never broadcast.

    Catalyst judges a table by the size of its files, which are compressed and do not count the rows that an explode makes of one.
    """
    return df.hint("merge")


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is run inside deletes its shuffle files as soon as it is done; for results that are written, not read again from their plan."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


_KEPT_AT: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_freed(spark):
        df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    _KEPT_AT[kept] = path
    return kept


def forget(*kept: DataFrame) -> None:
    """Delete tables that ``keep`` has written and that nothing reads any more, not even a result that is still to be run."""
    for df in kept:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(_KEPT_AT.pop(df))
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
