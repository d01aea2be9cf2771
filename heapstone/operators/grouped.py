"""Many small groups in Arrow: each group whole in one task, several groups a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of results that are handed on at once; tasks for each core, as the work of a group is not in proportion to its bytes.
BATCH, TASKS = 4 << 20, 3


def in_groups(rows: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``work`` makes of the rows of each group of ``keys``, which it gets in ``order``.

    As grouping with applyInArrow, which costs some milliseconds a group; here groups share batches, so a group costs what its rows do.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _joined(map(work, _groups(batches, keys))):
            yield from out.to_batches()

    return rows.repartition(TASKS * rows.sparkSession.sparkContext.defaultParallelism, *keys).sortWithinPartitions(*keys, *order).mapInArrow(walk, schema)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Neighbouring rows of equal keys, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        cuts = [0, *(np.flatnonzero([a != b for a, b in zip(values, values[1:], strict=False)]) + 1).tolist(), len(values)]
        for first, end in zip(cuts, cuts[1:], strict=False):
            if held and values[first] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(first, end - first))
            last = values[first]
    if held:
        yield pa.Table.from_batches(held)


def _joined(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
    some, size = [], 0
    for table in tables:
        some.append(table)
        size += table.nbytes
        if size >= BATCH or len(some) >= 2000:
            yield pa.concat_tables(some).combine_chunks()
            some, size = [], 0
    if some:
        yield pa.concat_tables(some).combine_chunks()
