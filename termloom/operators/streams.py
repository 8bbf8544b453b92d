"""Products of two tables, both too large to send: a task holds some rows of one while all rows of the other pass by.

The held rows are dealt to groups, which a task holds one at a time. The passing rows are copied once for each group,
so what is shuffled is the passing table times the number of groups. That number follows the cores, and the
held table only once a group of it would be too large for a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.settings import BLOCK_BYTES

# Groups for each core.
GROUPS_PER_CORE = 2
# Rows of both sides that are multiplied at a time; the product stays in a core's cache.
TILE_HELD, TILE_PASSING = 256, 1024


# Rows of an Arrow batch that a task works on at a time.
SLICE_ROWS = 1024


def sliced(batches):
    """Arrow batches in slices of SLICE_ROWS rows, so that what a task makes of a batch stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def group_count(held: DataFrame, rows: int, row_bytes: int) -> int:
    """Groups for `rows` held rows that take `row_bytes` each: enough for every core, and none above BLOCK_BYTES."""
    wanted = GROUPS_PER_CORE * held.sparkSession.sparkContext.defaultParallelism
    return max(1, min(rows, max(wanted, -(-rows * row_bytes // BLOCK_BYTES))))


def to_every_group(passing: DataFrame, groups: int) -> DataFrame:
    return passing.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"))


def streamed(held: DataFrame, passing: DataFrame, groups: int, start, schema, order: tuple[str | Column, ...] = ()) -> DataFrame:
    """What `start(held rows of a group)` returns after its `meet` has had the passing rows of the group, in batches and
    by `order`: the batches of its `finish`. Both sides have a column _group."""

    def side(rows, number, name):
        columns = [c for c in rows.columns if c != "_group"]
        sort = F.struct(*order) if number and order else F.lit(None)
        return rows.select(
            F.col("_group").cast("int").alias("_group"), F.lit(number).alias("_side"), sort.alias("_order"), F.struct(*columns).alias(name)
        )

    def run(batches):
        import numpy as np
        import pyarrow as pa

        group, first, state = None, [], None
        for batch in batches:
            number, which = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(number.astype(np.int64) * 2 + which)) + 1).tolist(), len(number)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if number[low] != group:
                    if state is not None:
                        yield from state.finish()
                    group, first, state = number[low], [], None
                rows = pa.RecordBatch.from_struct_array(batch.column(2 + int(which[low])).slice(low, high - low))
                if which[low] == 0:
                    first.append(rows)
                elif first:
                    if state is None:
                        state, first = start(pa.Table.from_batches(first)), [True]
                    state.meet(rows)
        if state is not None:
            yield from state.finish()

    left, right = side(held, 0, "_held"), side(passing, 1, "_passing")
    both = left.unionByName(right, allowMissingColumns=True).repartitionById(groups, "_group")
    ordered = both.sortWithinPartitions("_group", "_side", *(["_order"] if order else []))
    return ordered.select("_group", "_side", "_held", "_passing").mapInArrow(run, schema)
