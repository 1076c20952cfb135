"""Folds over ordered rows of a group, streamed: a task holds one group's state and never a whole group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a fold gives out at once.
ROWS = 4096


def fold_groups(df: DataFrame, key: str, order: list[str | Column], begin: Callable[[], object], step: Callable, end: Callable, schema: str) -> DataFrame:
    """Rows made by going through each group of ``key`` in order.

    ``begin()`` is a group's first state; ``step(state, row)`` gives the next state and rows to give out (dicts), ``end(key,
    state)`` the last rows. Groups are dealt by their key and sorted in their partition, which may spill; what a task keeps
    is the state. A fold is a chain, so one group runs in one task, however long it is. A null key is a group.
    """
    spark = df.sparkSession
    kinds = StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else spark.createDataFrame([], schema).schema
    shape = to_arrow_schema(kinds)
    dealt = df.repartition(F.col(key)).sortWithinPartitions(F.col(key), *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, some, out = None, None, False, []
        for batch in batches:
            for row in batch.to_pylist():
                if not some or row[key] != now:
                    if some:
                        out += end(now, state)
                    state, now, some = begin(), row[key], True
                state, made = step(state, row)
                out += made
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema=shape)
                    out = []
        if some:
            out += end(now, state)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    return dealt.mapInArrow(run, schema)
