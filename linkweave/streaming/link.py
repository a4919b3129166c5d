"""Linking a stream of query entities against a standing pool.

Blocking and scoring need no state across batches: each micro-batch of query entities is linked to
the static pool by the batch plan and appended. The pool's tables are read anew in every batch, so
keep them prepared on disk; a failed batch is written again under its own number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocking as B
from ..sources.entities import ENTITY, entities


def read_queries(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A stream of query entities from TSV files that arrive in a folder."""
    raw = spark.readStream.schema(ENTITY).option("sep", "\t").option("header", True).option("nullValue", "").option("maxFilesPerTrigger", files_per_batch).csv(path)
    return entities(raw)


def link_stream(
    queries: DataFrame, pool: DataFrame, out: str, checkpoint: str, blocking: B.Blocking = B.Blocking(), then: Callable[[DataFrame, DataFrame], DataFrame] | None = None, once: bool = True
) -> StreamingQuery:
    """Write each batch's candidates to out/batch=N; then, if given, turns (candidates, batch) into
    what is written. once: stop when all waiting files are done."""

    def run(batch: DataFrame, number: int) -> None:
        found = B.candidates(batch, pool, blocking)
        (then(found, batch) if then else found).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
