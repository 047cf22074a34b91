"""Arrow passes that add columns to a table's own, whatever their names."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cadenza.session import ship


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, after which the worker gives memory that it has freed back to the system: workers outlive their tasks."""

    def all_of(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
                ctypes.CDLL(None).malloc_trim(0)

    return all_of


def add_columns(df: DataFrame, inputs: list[str], fields: T.StructType, function: Callable[..., Callable[[list[pa.Array]], list[pa.Array]]], *args, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of df (by default all), then `fields`, computed by function(*args) from the inputs' arrays.

    `function(*args)` is called once a task and returns what is called once a batch.  A field replaces a column of its name.
    """
    ship(df.sparkSession)
    kept = [c for c in (df.columns if keep is None else keep) if c not in fields.names]
    plain = df.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)), *(F.col(f"`{c}`").alias(f"i{i}") for i, c in enumerate(inputs)))
    n, types = len(kept), to_arrow_schema(fields)
    out = T.StructType([T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(kept)] + [T.StructField(f"f{i}", f.dataType) for i, f in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = function(*args)
        for batch in batches:
            made = compute([batch.column(n + i) for i in range(len(inputs))])
            made = [x if isinstance(x, pa.Array) else pa.array(x) for x in made]
            made = [x.cast(types.field(i).type) for i, x in enumerate(made)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + made, names=[f.name for f in out])

    return plain.mapInArrow(trimmed(run), out).toDF(*kept, *fields.names)
