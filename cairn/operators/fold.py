"""Ordered folds whose state depends on the rows before: one streamed pass over sorted partitions.

A fold holds the state of one group and one batch of rows, so a group may be of any size; its rows are sorted by
Spark (which spills) and stay where they are: nothing is collected and joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def stream_fold(rows: DataFrame, by: list[str], order: list[Column], uses: list[Column], start: Callable[[], list], step: Callable[..., tuple], added: str) -> DataFrame:
    """``rows`` with the columns ``added`` (a DDL string). ``step(state, *values of uses)`` changes the state (a list) and
    returns the added values of the row; each group of ``by`` begins with ``start()``. Without ``by`` all rows are one group."""
    names = [f"__f_{k}" for k in range(len(uses))]
    new = StructType.fromDDL(added)
    rows = rows.drop(*new.names)  # those of an earlier fold
    keyed = rows.withColumns(dict(zip(names, uses, strict=True)))
    sorted_ = (keyed.repartition(*by) if by else keyed.repartition(1)).sortWithinPartitions(*by, *order)
    schema = StructType([*rows.schema.fields, *new.fields])
    arrow, kept = to_arrow_schema(schema), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), start()
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in by), strict=True)) if by else [()] * b.num_rows
            out = []
            for key, *values in zip(keys, *(b.column(n).to_pylist() for n in names), strict=True):
                if key != last:
                    last, state = key, start()
                out.append(step(state, *values))
            columns = zip(*out, strict=True) if out else [[] for _ in new.fields]
            made = [pa.array(c, arrow.field(len(kept) + k).type) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *made], [*kept, *new.names])

    return sorted_.mapInArrow(run, schema)


def number(x: Column) -> Column:
    return x.cast("long")


def text(x: str | Column) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))
