"""Shared plumbing of the corpus operators."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, written  # noqa: F401

#: Rows, and bytes of texts unless one row has more, that Python objects are made of at once.
PART_ROWS, PART_BYTES = 256, 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _bytes_of(column: pa.Array) -> np.ndarray:
    """Bytes of each row's texts, those of structs too."""
    if pa.types.is_struct(column.type):
        return sum((_bytes_of(c) for c in column.flatten()), np.zeros(len(column), np.int64))
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.zeros(len(column), np.int64)


def in_parts(batches, rows: int = PART_ROWS, size: int = PART_BYTES):
    """Batches cut into slices that are small in rows and in bytes."""
    for b in batches:
        total, at = np.cumsum(sum(map(_bytes_of, b.columns), np.zeros(b.num_rows, np.int64))), 0
        while at < b.num_rows:
            before = total[at - 1] if at else 0
            end = max(at + 1, min(at + rows, int(np.searchsorted(total, before + size, "right"))))
            yield b.slice(at, end - at)
            at = end


def clear_of(spans: list[tuple[int, int]]):
    """A function that says of (start, end) whether it touches none of the spans, in logarithmic time."""
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)

    def clear(s: int, e: int) -> bool:
        k = bisect_left(starts, e) - 1  # the last span that starts before the end
        return k < 0 or ends[k] <= s

    return clear


def texts_of(batch: pa.RecordBatch, col: str = "text") -> list[str]:
    """The batch's texts with null read as the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(col)).to_pylist()]


_BYTES, _SPARK_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def arrow(df: DataFrame, fn, schema) -> DataFrame:
    """mapInArrow, with batches of `PART_BYTES` unless the session has a bound of its own.

    Spark's default of 64 MB costs an executor several buffers of that size for every
    task. The bound is read when a plan is run, so it is lowered for the session; it
    has no say in results and is never raised."""
    if df.sparkSession.conf.get(_BYTES, _SPARK_BYTES) == _SPARK_BYTES:
        df.sparkSession.conf.set(_BYTES, str(PART_BYTES))
    return df.mapInArrow(fn, schema)


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """`arrow` over small slices of the batches."""
    return arrow(df, lambda batches: fn(in_parts(batches)), schema)


def name(col: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + col.replace("`", "``") + "`")


def with_row(docs: DataFrame, **cols: Column) -> DataFrame:
    """The given columns, and `row`: all of the input's columns in one struct, where no name can clash with ours."""
    return docs.select(F.struct(*map(name, docs.columns)).alias("row"), *(c.alias(n) for n, c in cols.items()))
