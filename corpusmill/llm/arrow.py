"""Row-wise Python steps over Arrow batches, in bounded memory."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from typing import Any, TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows and bytes of text that one call of a step gets; a single longer text goes alone.
SLICE_ROWS, SLICE_BYTES = 1024, 4 << 20
#: Bytes of the batches that Spark sends to Python, unless the session names a number of its own.
BATCH_BYTES, _SETTING, _UNSET = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864", "67108864b", "64m")

T = TypeVar("T")
_held: tuple[Hashable, Any] | None = None


def held(key: Hashable, make: Callable[[], T]) -> T:
    """What ``make`` returns, kept in this worker until another key is asked for.

    Spark reuses workers for one step after another; so a step's tables and caches go when the
    next step begins, and a worker never holds those of two.
    """
    global _held
    if _held is None or _held[0] != key:
        _held = None
        _held = key, make()
    return _held[1]


def release() -> None:
    """Give memory that was freed back to the system; C libraries without malloc_trim keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Let Spark send batches of at most ``BATCH_BYTES`` where the session holds Spark's default."""
    if spark.conf.get(_SETTING) in _UNSET:
        spark.conf.set(_SETTING, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch``, each of a bounded number of rows and bytes of column ``text``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held_bytes = 0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= SLICE_ROWS or held_bytes + size > SLICE_BYTES):
            yield batch.slice(start, i - start)
            start, held_bytes = i, 0
        held_bytes += size
    if start < batch.num_rows:
        yield batch.slice(start)


def binary_views(column: pa.ChunkedArray, dtype: type) -> list[np.ndarray]:
    """Each value of a binary column as an array over the column's own memory."""
    out = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        out += [whole[a:b].view(dtype) for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def map_texts(rows: DataFrame, text: str, step: Callable[[list[str | None]], dict[str, list]], schema: str) -> DataFrame:
    """Replace column ``text`` of ``rows`` by the columns that ``step`` makes of a list of texts.

    ``step`` is called on the executors and returns a list for each field of ``schema``; the
    other columns of ``rows`` pass through unchanged.
    """
    made = StructType.fromDDL(schema)
    keep = [f for f in rows.schema.fields if f.name != text]
    out = StructType([*keep, *made.fields])
    bound_batches(rows.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        try:
            for batch in batches:
                for part in slices(batch, text):
                    new = step(part.column(text).to_pylist())
                    columns = [part.column(f.name).cast(target.field(f.name).type) for f in keep]
                    columns += [pa.array(new[f.name], target.field(f.name).type) for f in made.fields]
                    yield pa.RecordBatch.from_arrays(columns, schema=target)
        finally:
            release()

    return rows.mapInArrow(each, out)


def filter_texts(rows: DataFrame, text: str, keep: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows, with all their columns, for whose ``text`` the function ``keep`` says so."""
    bound_batches(rows.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in slices(batch, text):
                    yield part.filter(pa.array(keep(part.column(text).to_pylist()), pa.bool_()))
        finally:
            release()

    return rows.mapInArrow(each, rows.schema)
