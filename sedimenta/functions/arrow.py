"""Turning a Python function of one text into an Arrow column function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..session import ship


def column_function(df: DataFrame, f: Callable, schema: str, *columns: Column) -> Column:
    """f(value, ...) of each row as a column of type `schema`; f gets None for nulls. Values travel in Arrow batches."""
    ship(df.sparkSession)
    kind = to_arrow_type(_parse_datatype_string(schema))

    def run(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arrays in it:
            yield pa.array([f(*v) for v in zip(*(a.to_pylist() for a in arrays))], kind)

    def run_one(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            yield pa.array([f(v) for v in a.to_pylist()], kind)

    run.__annotations__ = {"it": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    run_one.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run_one if len(columns) == 1 else run, schema)(*columns)
