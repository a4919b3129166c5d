"""Stage tables: work written bucket by bucket, so that an interrupted run goes on where it was."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str) -> tuple[Any, Any]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    p, fs = _path(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def bucket_of(key: str, buckets: int) -> Any:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def todo(spark: SparkSession, path: str, buckets: int) -> list[int]:
    """The buckets that have no finished table yet."""
    return [b for b in range(buckets) if not exists(spark, f"{path}/bucket={b}")]


def run_buckets(spark: SparkSession, source: DataFrame, key: str, path: str, buckets: int, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply work to the rows of each unfinished bucket of key and write them; read all back.

    A bucket's table appears whole or not at all. What a failed try left behind is overwritten.
    """
    for b in todo(spark, path, buckets):
        work(source.where(bucket_of(key, buckets) == b)).write.mode("overwrite").parquet(f"{path}/bucket={b}")
    return spark.read.parquet(*[f"{path}/bucket={b}" for b in range(buckets)])


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table at path: read if it is whole, else made and written."""
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str) -> Any:
    """A small JSON file."""
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def write_json(spark: SparkSession, value: Any, path: str) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(value, indent=1, sort_keys=True).encode()))
    out.close()
