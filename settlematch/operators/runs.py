"""Groups of rows solved one at a time, without a call per group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def runs(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows of one value of ``column`` after another, from batches sorted by it; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(column).to_pylist()
        cuts = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and hi > lo and held[0].column(column)[0].as_py() != values[lo]:
                yield pa.Table.from_batches(held)
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def solve_runs(rows: DataFrame, group: str, order: list[str], solve: Callable[[dict[str, list]], Iterable[tuple]], schema: str, *, tables: bool = False) -> DataFrame:
    """``solve`` applied to the columns of each group, its rows in ``order``; it gives rows of ``schema``.

    tables: ``solve`` wants the group as an Arrow table and not as lists.
    """
    empty = rows.sparkSession.createDataFrame([], schema).schema
    names = empty.names

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, out = to_arrow_schema(empty), []

        def flushed():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], names=names)

        for table in runs(batches, group):
            out += solve(table if tables else table.to_pydict())
            if len(out) >= 10_000:
                yield flushed()
                out = []
        yield flushed()

    return rows.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)
