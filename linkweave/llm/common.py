"""Helpers shared by the corpus operators: shared-folder tables, id handling, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import forget, freeing_shuffles, materialize, settle, shared_dir  # noqa: F401

#: ASCII white space, the separator set of every word rule here: space and bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table; only the named columns reach the scan."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def give_back() -> None:
    """Return freed memory to the system: a worker outlives its task and should not keep what that took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


#: most bytes of an Arrow batch that goes to Python, but for a longer row
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Have the session send batches of at most about BATCH_BYTES to Python. By default they have 10,000
    rows or 64 MB, which a JVM holds outside its heap for every task, in buffers that double as they
    grow, and a worker once more. The setting stays, as DataFrames that are returned run later."""
    if spark.conf.isModifiable(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def batched(
    f: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], max_bytes: int = 8 << 20
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that applies f to slices of at most about max_bytes each.

    A slice holds one row at least, so memory is bounded by max_bytes plus the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = max(1, min(batch.num_rows, -(-batch.nbytes // max_bytes)))
            step = -(-batch.num_rows // parts)
            for at in range(0, batch.num_rows, step):
                got = f(batch.slice(at, step))
                if isinstance(got, pa.RecordBatch):
                    yield got
                else:
                    yield from got
        give_back()

    return run


def texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, None for null."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
