"""Row-wise Python over Arrow batches, for what built-in expressions cannot say.

``map_rows`` hands a function whole columns of one batch as Python lists and takes whole
columns back, so there is no per-row call between the JVM and Python and no pandas detour.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def schema_of(schema: str | T.StructType) -> T.StructType:
    return T._parse_datatype_string(schema) if isinstance(schema, str) else schema


SMALL_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows of an input that is small and in fewer files than there are cores, dealt out to all cores.

    Larger inputs, and inputs in many files, are left as the scan splits them: no shuffle. Where
    the session gives no estimate of the size (a remote one) the input is left as it is too.
    """
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return df
    return df.repartition(cores) if size <= SMALL_BYTES * cores and 0 < len(df.inputFiles()) < cores else df


def map_batches(df: DataFrame, function: Callable[..., list], schema: str | T.StructType, init: Callable[[], object] | None = None, dealt: bool = True) -> DataFrame:
    """Arrow columns of ``df`` in, columns of ``schema`` out, batch by batch.

    ``function(*columns)`` gets one Arrow array per column (preceded by ``init()``'s value, made
    once per task, if given) and returns one list or Arrow array per output column. ``dealt``:
    deal a small input out to all cores first.
    """
    struct = schema_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(struct)
        state = () if init is None else (init(),)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = function(*state, *batch.columns)
            arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, target)]
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, target)], schema=target)

    return (spread(df) if dealt else df).mapInArrow(run, struct)


def map_rows(df: DataFrame, function: Callable[..., list], schema: str | T.StructType, init: Callable[[], object] | None = None, dealt: bool = True) -> DataFrame:
    """The same with each column as a Python list; ``init()``'s value, if given, comes first."""

    def run(*columns):
        at = 0 if init is None else 1
        return function(*columns[:at], *(column.to_pylist() for column in columns[at:]))

    return map_batches(df, run, schema, init, dealt)


def with_columns(df: DataFrame, inputs: list[str], function: Callable[..., list], added: str | T.StructType, init: Callable[[], object] | None = None) -> DataFrame:
    """All columns of ``df`` with those of ``added`` beside them, made from ``inputs`` (as lists).

    The other columns travel as Arrow buffers and are never touched, so a function that adds to
    a row needs no join by a key: keys may repeat or be null.
    """
    more = schema_of(added)
    kept = T.StructType([f for f in df.schema.fields if f.name not in more.names])
    at = [df.columns.index(c) for c in inputs]
    out = [df.columns.index(f.name) for f in kept]

    def run(*columns):
        state, columns = (columns[:1], columns[1:]) if init is not None else ((), columns)
        made = function(*state, *(columns[i].to_pylist() for i in at))
        return [columns[i] for i in out] + list(made)

    return map_batches(df, run, T.StructType(kept.fields + more.fields), init)
