"""Small helpers for operators that run Python over Arrow batches.

Spark cuts batches by rows and bytes, so what a task holds does not grow with
the table. Results are handed back in slices for the same reason.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 4 << 20
#: Spark's setting for the bytes of a batch handed to Python, its default, and what is used here in its place.
BATCH_SETTING, DEFAULT_BATCH, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b"


def in_slices(rows: Iterable[tuple], schema: pa.Schema, slice_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pack tuples into record batches of about ``slice_bytes`` each."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += 64 + sum(_weight(v) for v in row)
        if weight >= slice_bytes:
            yield _packed(held, schema)
            held, weight = [], 0
    if held:
        yield _packed(held, schema)


def _weight(value) -> int:
    if isinstance(value, (str, bytes)):
        return sys.getsizeof(value)
    if hasattr(value, "nbytes"):
        return value.nbytes
    return 8 * len(value) if isinstance(value, (list, tuple)) else 8


def _packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of all batches, a few at a time, as tuples of Python values."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield from zip(*(column.to_pylist() for column in part.columns))


def map_rows(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``fn`` maps a task's rows to result rows of the DDL ``schema``; both sides stream."""
    from pyspark.sql.types import StructType

    arrow = _arrow(StructType.fromDDL(schema))
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) == DEFAULT_BATCH:  # a value that somebody chose stays
        conf.set(BATCH_SETTING, BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_slices(fn(rows_of(batches)), arrow)
        _give_back()

    return df.mapInArrow(run, schema)


def _give_back() -> None:
    """Return freed memory to the system: workers are used again, so what a task needed must not stay with them."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def extend_rows(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterable[tuple]], extra: str) -> DataFrame:
    """``df`` through Python with more columns behind: ``fn`` yields each row with the values of ``extra`` (DDL).

    The columns of ``df`` travel as c0, c1 ..., so none of their names can clash; ``renamed`` gives them back.
    """
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in plain.schema)
    return map_rows(plain, fn, fields + extra)


def renamed(extended: DataFrame, columns: list[str], *extra) -> DataFrame:
    """What ``extend_rows`` gave, its first columns under their names and then ``extra``."""
    from pyspark.sql import functions as F

    return extended.select(*(F.col(f"c{i}").alias(name) for i, name in enumerate(columns)), *extra)


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
