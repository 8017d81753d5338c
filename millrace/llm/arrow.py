"""Running numpy code over Arrow batches: bounded slices of a batch, and schemas."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship

#: Bytes of text that are worked on at once, but for a single text that is longer.
SLICE_BYTES = 1 << 19
#: Rows that Spark sends at once, so that a batch of long texts stays small on both sides.
BATCH_ROWS = 1000
#: Spark's setting for that and its value where nobody has set it.
_BATCH, _UNSET = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most so many bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
    start = total = 0
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of numbers joined to at least so many rows each, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def give_back() -> None:
    """Give memory that has been freed back to the system, as workers and the driver live on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _each(made: Callable, schema: pa.Schema, args: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for columns in made(batches, *args):
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    give_back()


def map_batches(df: DataFrame, made: Callable, schema: StructType | str, *args: object) -> DataFrame:
    """df through made(batches, *args), which yields lists of columns of the schema."""
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    # a plan takes its batch size when it runs, so a session that was given none keeps this one
    if df.sparkSession.conf.get(_BATCH) == _UNSET:
        df.sparkSession.conf.set(_BATCH, BATCH_ROWS)
    parsed = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    return df.mapInArrow(partial(_each, made, to_arrow_schema(parsed), args), parsed)
