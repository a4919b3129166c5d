"""Tables of intermediate rows in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that setting is absent and all runs in one process (tests, a laptop) is a folder of our
    own set; a cluster without it is an error, as its executors would write to disks of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file:///tmp/checkpoints/linkweave-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
    return found


#: makes Spark delete the shuffle files of an execution when it ends
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Executions within leave no shuffle files: what is written whole needs them no more, and otherwise
    they stay until the driver's garbage collector finds their plans. Only for actions whose plans
    nothing runs again."""
    if not spark.conf.isModifiable(_CLEANUP):
        yield
        return
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back.

    A lost executor then costs no recomputation of what is above the cut, and each reader
    sees the same rows. The table stays, as the result of a query may still read it; `forget`
    removes one that no later plan needs. A write that fails leaves nothing.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    try:
        with freeing_shuffles(spark):
            df.write.parquet(path)
    except BaseException:
        _delete(spark, path)
        raise
    out = spark.read.schema(df.schema).parquet(path)
    out._linkweave_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def forget(df: DataFrame) -> None:
    """Delete a table made by `materialize`."""
    _delete(df.sparkSession, df._linkweave_path)


def settle(df: DataFrame, name: str, *used: DataFrame) -> DataFrame:
    """Materialize df and delete the tables it was made of, whether or not that succeeds."""
    try:
        return materialize(df, name)
    finally:
        for table in used:
            forget(table)
