"""How rows are dealt to tasks, and small groups of them for Python, many at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a task.
ROWS = 1 << 18


def dealt(df: DataFrame, n_rows: int | None, *keys: str) -> DataFrame:
    """Rows with equal keys together, some ``ROWS`` a task however many there are, and not joined again to
    fewer tasks. Where the number is not known, Spark deals them as it is set."""
    if n_rows is None:
        return df.repartition(*keys)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n_rows // ROWS)), *keys)


def listed(c: pa.Array) -> list:
    """Values as Python's; arrays of numbers by their offsets, which takes a tenth of the time."""
    if c.null_count:
        return c.to_pylist()
    if pa.types.is_list(c.type) and pa.types.is_integer(c.type.value_type) and not c.values.null_count:
        at, values = c.offsets.to_numpy().tolist(), c.values.to_numpy().tolist()
        return [values[a:b] for a, b in zip(at, at[1:])]
    return c.to_numpy().tolist() if pa.types.is_integer(c.type) else c.to_pylist()


def each(rows: DataFrame, key: str, order: list[str], work: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """Calls ``work`` with the rows of each key, in order; they must lie in one task (``dealt``). A task goes
    through its rows in batches and holds a batch and one key's rows, as lists, at a time."""
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    at = rows.columns.index(key)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, group in groupby((r for f in frames for r in zip(*map(listed, f.columns))), itemgetter(at)):
            out += work(list(group))
            if len(out) >= 10_000:
                yield table(out)
                out = []
        if out:
            yield table(out)

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return rows.sortWithinPartitions(key, *order).mapInArrow(batches, kind)
