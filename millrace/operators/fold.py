"""Folds of keyed rows in order, with memory for one state however long a key's history is.

Rows are dealt by key and sorted, and a task reads them as a stream of Arrow batches: no array of a
key's history is ever made. A step is a small function of plain values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..session import ship

#: Rows that are held before they are handed on.
ROWS = 10_000


def _folded(batches: Iterator[pa.RecordBatch], start: Callable, step: Callable, end: Callable | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    key: Any = None
    state: Any = None
    some = False

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        for k, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not some or k != key:
                if some and end:
                    out += [(key, *row) for row in end(state)]
                key, state, some = k, start(), True
            state, emitted = step(state, *values)
            out += [(k, *row) for row in emitted]
            if len(out) >= ROWS:
                yield flushed()
                out = []
    if some and end:
        out += [(key, *row) for row in end(state)]
    yield flushed()


def fold(rows: DataFrame, key: str, order: Sequence[str], values: Sequence[str], start: Callable, step: Callable, end: Callable | None, result: str) -> DataFrame:
    """(key, result) from rows in order within each key: step(state, *values) gives the next state and rows to emit, end(state) a key's last rows."""
    ship(rows.sparkSession)
    made = _parse_datatype_string(result)
    schema = StructType([StructField(key, rows.schema[key].dataType), *made.fields])
    sorted_ = rows.repartition(key).sortWithinPartitions(key, *order).select(key, *values)
    return sorted_.mapInArrow(partial(_folded, start=start, step=step, end=end, schema=to_arrow_schema(schema)), schema)
