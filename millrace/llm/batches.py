"""Arrow batches in and out of Python tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows handed over at a time.
ROWS = 1_000


def map_batches(df: DataFrame, columns: list[Column], make: Callable[[], Callable], schema: str) -> DataFrame:
    """Run a function over Arrow batches of the given columns.

    ``make`` is called once in each task and returns the function: it takes one Python list per column and
    returns one list or Arrow array per output column. Only the named columns leave the JVM, so extra columns,
    also with clashing names, do no harm.
    """
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    out = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            values = step(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(values, out, strict=True)], schema=out
            )

    return df.select(*columns).mapInArrow(run, schema)


def filter_batches(df: DataFrame, column: str, make: Callable[[], Callable]) -> DataFrame:
    """Rows of ``df`` for which the function that ``make`` returns, given the list of a column's values, says True."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            yield batch.filter(pa.array(step(batch.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)
