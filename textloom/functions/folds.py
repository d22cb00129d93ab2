"""Folds over the sorted rows of each key, where what was decided before decides what follows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold(df: DataFrame, key: str, order: list[str], values: list[str], start: Callable[[], Callable], results: str) -> DataFrame:
    """``df`` with the columns ``results`` (a schema) that a fold gives each row.

    ``start()`` makes a key's step, which takes a row's ``values`` and gives its result, or a
    tuple of results.  Rows stream by in ``order``, nulls last, and only a step's own state
    is held, so a key may have any number of rows.  A null key is a key of its own.  A row
    with a null among its ``values`` gets null results and changes no state.  All columns
    pass through as Arrow columns, so no value changes its type, and no row is lost.
    """
    added = StructType.fromDDL(results)
    kinds = to_arrow_schema(added)
    nothing = (None,) * len(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = object(), None
        for part in batches:
            out = []
            for k, *row in zip(part[key].to_pylist(), *(part[v].to_pylist() for v in values)):
                if k != last:
                    last, step = k, start()
                told = nothing if any(v is None for v in row) else step(*row)
                out.append(told if isinstance(told, tuple) else (told,))
            new = [pa.array(column, f.type) for column, f in zip(zip(*out), kinds)] if out else [pa.array([], f.type) for f in kinds]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *kinds.names])

    ordered = df.repartition(F.col(key)).sortWithinPartitions(F.col(key), *[F.col(c).asc_nulls_last() for c in order])
    return ordered.mapInArrow(run, StructType(df.schema.fields + added.fields))
