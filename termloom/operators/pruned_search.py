"""Exact nearest-row search for many queries that skips the rows which cannot be among the nearest.

1. Some rows of the table, chosen by hash, become pivots. Every row goes to the pivot at the smallest angle, and by
   that angle into a ring around it; rings with many rows are cut by hash. These blocks are stored.
2. Angles obey the triangle inequality, so the angles of a query to the pivots bound the angle to every block. Each
   query first meets the blocks with the smallest bounds until they hold n rows: the n-th score found is its threshold.
3. Queries are dealt to groups, and the blocks that a bound of any of its queries reaches pass by each group
   (`streams`). A query is multiplied with those blocks whose bound reaches its own threshold, which rises on the way.
   All others cannot change its result.

Only the pivots and one line a block travel to every task; both are bounded. What is shuffled is the queries with
their few first blocks, and the table once for each group at most: pairs of a query and a block stay in the tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.functions import vectors
from termloom.operators.search import SCORE_DIGITS, TOP_RESULTS, Best, held_bytes
from termloom.operators.streams import group_count, streamed
from termloom.settings import BROADCAST_BYTES, stored

# Most pivots, whatever the table's size; rings of this angle (radians) around each.
MAX_PIVOTS = 4096
RING = math.pi / 48
# What rounding may add to an angle (the arc cosine near 1) and to a score.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9


@dataclass(frozen=True)
class PrunedSearch:
    """`found` is the result of the search, `met` the number of rows that each query was multiplied with, `rows` the
    size of the table."""

    found: DataFrame
    met: DataFrame
    rows: int

    def share(self) -> float:
        """The share of all pairs of query and row that were multiplied."""
        pairs, queries = self.met.agg(F.sum("rows"), F.count_distinct("_query_row")).first()
        return (pairs or 0) / max(1, queries * self.rows)


def pruned_nearest(
    queries: DataFrame,
    table: DataFrame,
    query_key: str,
    key: str,
    label: str,
    n: int = TOP_RESULTS,
    mode: str = vectors.VIEWER,
    exclude_self: bool = False,
    ties: str = "label",
    pivots: int | None = None,
    block_rows: int = 8192,
) -> PrunedSearch:
    """For every query its n nearest rows, exactly as `search.batch_nearest` finds them.

    Rows and queries without an embedding take no part. A zero vector scores 0 with everything: zero rows have a block
    of their own, zero queries meet every block. By default there are about sqrt(rows) pivots, at most MAX_PIVOTS
    and no more than the broadcast bound holds. Query keys are unique.
    """
    spark = table.sparkSession
    rows = table.where(F.col("embedding").isNotNull()).select(
        F.col(key).alias("_key"), F.col(label).alias("_label"), vectors.as_doubles(F.col("embedding")).alias("embedding")
    )
    asked = queries.where(F.col("embedding").isNotNull()).select(
        F.col(query_key).alias("_query"), vectors.as_doubles(F.col("embedding")).alias("_wanted")
    )
    total, width = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    most = max(1, BROADCAST_BYTES // (8 * max(1, width or 1)))
    chosen = min(pivots or math.isqrt(total) + 1, MAX_PIVOTS, most)
    centers = _pivots(rows, chosen)
    laid = stored(_in_rings(rows, centers), "rings")
    counted = laid.groupBy("pivot", "ring").agg(
        F.count("*").alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high"),
        F.min("norm").alias("norm"), F.max("norm").alias("most_norm"),
    )
    # At most pivots x rings lines, whatever the number of rows.
    rings = [tuple(r) for r in counted.orderBy("pivot", "ring").collect()]
    layout, block_of = _layout(rings, block_rows)
    places = spark.createDataFrame(
        [(pivot, ring, block, layout[block][1]) for (pivot, ring), block in block_of.items()],
        "pivot int, ring int, block int, parts long",
    )
    in_blocks = laid.join(F.broadcast(places), ["pivot", "ring"]).select(
        "block", F.pmod(F.xxhash64("_key"), F.col("parts")).alias("part"), "_key", "_label", "embedding"
    )
    asked = stored(asked.withColumn("_query_row", F.monotonically_increasing_id()), "queries")
    count = asked.count()
    groups = group_count(asked, count, held_bytes(width or 0, n))
    asked = asked.withColumn("_group", F.pmod(F.xxhash64("_query_row"), F.lit(groups)).cast("int"))

    need = n + 1 if exclude_self else n
    bounds = _Bounds(spark, centers, layout, mode)
    first = stored(bounds.nearest(asked, need), "first_blocks")
    rounded = F.round("score", SCORE_DIGITS)
    order = Window.partitionBy("_query_row").orderBy(rounded.desc())
    best = _scored(first, in_blocks, n, mode, exclude_self, ties, block_rows)
    ranked = best.withColumn("place", F.row_number().over(order)).where(F.col("place") == n)
    reached = ranked.select("_query_row", F.col("score").alias("least"))
    held = stored(asked.join(reached, "_query_row", "left"), "thresholds")
    # At most groups x blocks pairs.
    wanted = bounds.reaching(held, groups).groupBy("block").agg(F.collect_set("_group").alias("_groups"))
    passing = in_blocks.join(F.broadcast(wanted), "block").withColumn("_group", F.explode("_groups"))
    schema = (
        T.StructType().add("_query_row", "long").add("_query", asked.schema["_query"].dataType)
        .add("_key", rows.schema["_key"].dataType).add("_label", rows.schema["_label"].dataType)
        .add("score", "double").add("rows", "long")
    )

    def start(mine):
        return _Searched(mine, bounds, n, mode, exclude_self, ties)

    passing = passing.select("_group", "block", "_key", "_label", "embedding")
    later = stored(streamed(held, passing, groups, start, schema, ("block",)), "later_found")
    partial = later.where("rows is null")

    tie = F.col("_key").asc() if ties == "key" else F.col("_label").desc()
    final = Window.partitionBy("_query").orderBy(rounded.desc(), tie, "_key")
    found = partial.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= n)
    return PrunedSearch(
        found.select(
            F.col("_query").alias(query_key), "rank", F.col("_key").alias(key), F.col("_label").alias(label), "score"
        ),
        first.select("_query_row", "rows").unionByName(later.where("rows is not null").select("_query_row", "rows")),
        total,
    )


def _layout(rings, block_rows: int):
    """Blocks (pivot, parts, rows, low, high, norm, most_norm) and the block of every (pivot, ring). Neighbouring rings
    of a pivot share a block while it is small; a block with many rows is cut into parts of about `block_rows`."""
    layout, block_of = [], {}
    for pivot, ring, rows, low, high, norm, most in rings:
        last = layout[-1] if layout else None
        if last and last[0] == pivot and last[2] < block_rows // 16:
            last[2:] = [last[2] + rows, last[3], high, min(last[5], norm), max(last[6], most)]
        else:
            layout.append([pivot, 1, rows, low, high, norm, most])
        block_of[pivot, ring] = len(layout) - 1
    for line in layout:
        line[1] = -(-line[2] // block_rows)
    return layout, block_of


def _pivots(rows: DataFrame, count: int):
    """Unit vectors of `count` rows with the smallest hashes of their vectors; copies are one pivot."""
    import numpy as np

    drawn = (
        rows.where(vectors.l2_norm(F.col("embedding")) > 0)
        .select(F.xxhash64("embedding").alias("hash"), "embedding")
        .groupBy("hash").agg(F.first("embedding").alias("embedding"))
        .orderBy("hash").limit(count)
    )
    found = np.array([r["embedding"] for r in drawn.collect()], dtype=np.float64)
    return found / np.linalg.norm(found, axis=1, keepdims=True) if len(found) else found


def _matrix(column):
    flat = column.combine_chunks().flatten() if hasattr(column, "combine_chunks") else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _angles(unit, centers):
    import numpy as np

    return np.arccos(np.clip(unit @ centers.T, -1.0, 1.0))


def _unit(x):
    import numpy as np

    norm = np.linalg.norm(x, axis=1)
    return x / np.where(norm > 0, norm, 1.0)[:, None], norm


def _in_rings(rows: DataFrame, centers) -> DataFrame:
    """Each row with its nearest pivot, the angle to it, the ring and its own norm; zero rows have pivot -1."""
    sent = rows.sparkSession.sparkContext.broadcast(centers)
    schema = T.StructType(list(rows.schema)).add("pivot", "integer").add("ring", "integer").add("angle", "double").add("norm", "double")

    def place(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            unit, norm = _unit(_matrix(batch.column("embedding")))
            pivot, angle = np.full(len(unit), -1), np.zeros(len(unit))
            if len(sent.value):
                step = max(1, 4_000_000 // len(sent.value))
                for start in range(0, len(unit), step):
                    part = _angles(unit[start : start + step], sent.value)
                    pivot[start : start + step] = part.argmin(axis=1)
                    angle[start : start + step] = part.min(axis=1)
                pivot[norm == 0], angle[norm == 0] = -1, 0.0
            new = (pivot.astype(np.int32), (angle / RING).astype(np.int32), angle, norm)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, new)], names=schema.names)

    return rows.mapInArrow(place, schema)


class _Bounds:
    """Which blocks a query has to meet, from its angles to the pivots."""

    def __init__(self, spark, centers, layout, mode):
        import numpy as np

        columns = [np.array(c) for c in zip(*layout)] if layout else [np.zeros(0)] * 7
        self.sent = spark.sparkContext.broadcast((centers, *columns))
        self.epsilon = vectors.COSINE_EPSILON[mode]

    def nearest(self, asked: DataFrame, need: int) -> DataFrame:
        """The first part of blocks in falling order of their bounds until they hold `need` rows."""

        def choose(batch, bound, parts, size):
            import numpy as np

            order = np.argsort(-bound, axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order]
            i, j = np.nonzero(before < need)
            return i, order[i, j], np.zeros(len(i), dtype=np.int64)

        met = self._met(asked, asked.columns, choose)
        return met.select(*asked.columns, "block", F.lit(0).cast("long").alias("part"), "rows")

    def reaching(self, held: DataFrame, groups: int) -> DataFrame:
        """(_group, block): the blocks whose bounds reach the n-th score so far of a query of the group."""
        sent, epsilon = self.sent, self.epsilon

        def run(batches):
            import numpy as np
            import pyarrow as pa

            centers, pivot, _, _, *shape = sent.value
            reached = np.zeros((groups, len(pivot)), dtype=bool)
            step = max(1, 500_000 // (len(pivot) + len(centers) + 1))
            for whole in batches if len(pivot) else ():
                for start in range(0, whole.num_rows, step):
                    batch = whole.slice(start, step)
                    unit, length = _unit(_matrix(batch.column("_wanted")))
                    reach = _upper(unit, length, centers, pivot, *shape, epsilon) >= _thresholds(batch.column("least"))[:, None] - SCORE_SLACK
                    group = batch.column("_group").to_numpy()
                    for number in np.unique(group):
                        reached[number] |= reach[group == number].any(axis=0)
            group, block = np.nonzero(reached)
            yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), pa.array(block.astype(np.int32))], names=["_group", "block"])

        return held.select("_wanted", "least", "_group").mapInArrow(run, "_group int, block int")

    def _met(self, asked: DataFrame, kept: list[str], choose) -> DataFrame:
        sent, epsilon = self.sent, self.epsilon
        schema = asked.select(*kept).schema
        for name, kind in (("block", "integer"), ("begin", "long"), ("parts", "long"), ("rows", "long")):
            schema = schema.add(name, kind)

        def emit(batches):
            import numpy as np
            import pyarrow as pa

            centers, pivot, parts, rows, *shape = sent.value
            if not len(pivot):
                return
            # Rows of one part.
            size = -(-rows // parts)
            step = max(1, 2_000_000 // (len(pivot) + len(centers)))
            for whole in batches:
                for start in range(0, whole.num_rows, step):
                    batch = whole.slice(start, step)
                    unit, length = _unit(_matrix(batch.column("_wanted")))
                    i, j, begin = choose(batch, _upper(unit, length, centers, pivot, *shape, epsilon), parts, size)
                    new = (j.astype(np.int32), begin, parts[j], size[j])
                    yield pa.RecordBatch.from_arrays(
                        [*batch.select(kept).take(pa.array(i)).columns, *map(pa.array, new)], names=schema.names
                    )

        return asked.mapInArrow(emit, schema)


def _upper(unit, length, centers, pivot, low, high, norm, most, epsilon):
    """No row of a block scores higher with the query than this."""
    import numpy as np

    if not len(centers):
        return np.zeros((len(unit), len(pivot)))
    own = _angles(unit, centers)[:, np.maximum(pivot, 0)]
    nearest = np.maximum(0.0, np.maximum(own - high, low - own) - ANGLE_SLACK)
    cosine = np.cos(np.minimum(nearest, np.pi))
    # The product of the norms over itself and epsilon lies between these; a negative cosine is largest at the least.
    few, many = np.outer(length, norm), np.outer(length, most)
    bound = np.where(cosine >= 0, cosine * many / (many + epsilon), cosine * few / (few + epsilon))
    return np.where((pivot < 0)[None, :] | (length == 0)[:, None], 0.0, bound)


def _thresholds(column):
    """The scores to reach, without one the least."""
    import numpy as np

    least = column.to_numpy(zero_copy_only=False).astype(float)
    return np.where(np.isnan(least), -np.inf, least)


class _Searched:
    """A group of queries that the blocks of the table pass by; see `streams.streamed`."""

    def __init__(self, queries, bounds, n: int, mode: str, exclude_self: bool, ties: str):
        import numpy as np

        queries = queries.rename_columns(["embedding" if c == "_wanted" else c for c in queries.column_names])
        least = _thresholds(queries.column("least").combine_chunks())
        self.best = Best(queries, n, mode, exclude_self, ties, cut=np.where(np.isneginf(least), least, np.round(least, SCORE_DIGITS)))
        self.unit, self.length = _unit(self.best.q)
        self.bounds, self.met = bounds, np.zeros(len(self.unit), dtype=np.int64)

    def meet(self, rows) -> None:
        import numpy as np

        centers, pivot, _, _, *shape = self.bounds.sent.value
        self.kinds = [rows.schema.field(c).type for c in ("_key", "_label")]
        blocks = rows.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        low, everyone = 0, np.arange(len(self.unit))
        for start, end in zip(edges, edges[1:]):
            line = slice(blocks[start], blocks[start] + 1)
            # Only the pivot of this block; the block of zero rows has none.
            center = centers[max(pivot[blocks[start]], 0) :][:1]
            upper = _upper(self.unit, self.length, center, np.minimum(pivot[line], 0), *(c[line] for c in shape), self.bounds.epsilon)[:, 0]
            some = np.flatnonzero(upper >= self.best.cut - SCORE_SLACK)
            if len(some) == len(everyone):
                # Goes with the blocks after it that all queries meet as well.
                continue
            if low < start:
                self._multiply(rows.slice(low, start - low), everyone)
            self._multiply(rows.slice(start, end - start), some)
            low = end
        if low < len(blocks):
            self._multiply(rows.slice(low), everyone)

    def _multiply(self, rows, some) -> None:
        self.met[some] += rows.num_rows
        self.best.meet(rows, some)

    def finish(self):
        import pyarrow as pa

        names = ["_query_row", "_query", "_key", "_label", "score", "rows"]
        for found in self.best.finish("_query_row", "_query"):
            yield pa.RecordBatch.from_arrays([*found.columns, pa.nulls(found.num_rows, pa.int64())], names=names)
        # And a line for each query with the number of rows it met.
        queries = self.best.queries
        columns = [queries.column(c).combine_chunks() for c in ("_query_row", "_query")]
        columns += [pa.nulls(queries.num_rows, t) for t in (*self.kinds, pa.float64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(self.met)], names=names)


def _scored(met: DataFrame, in_blocks: DataFrame, n: int, mode: str, exclude_self: bool, ties: str, block_rows: int) -> DataFrame:
    """(_query_row, score): the n best scores of every query in every block that it meets."""
    # A block is copied once for each `block_rows` queries that meet it.
    lots = met.groupBy("block", "part").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_lots"))
    asked = met.join(F.broadcast(lots), ["block", "part"]).withColumn("_by", F.pmod(F.xxhash64("_query_row"), F.col("_lots")).cast("int"))
    copies = in_blocks.join(F.broadcast(lots), ["block", "part"]).withColumn("_by", F.explode(F.sequence(F.lit(0), F.col("_lots") - 1)))

    def meet(queries, rows):
        import pyarrow as pa

        best = Best(queries.rename_columns({"_wanted": "embedding"}), n, mode, exclude_self, ties)
        for batch in rows.combine_chunks().to_batches():
            best.meet(batch)
        found = [pa.Table.from_batches([b]).select(["_query_row", "score"]) for b in best.finish("_query_row")]
        return pa.concat_tables(found) if found else pa.table({"_query_row": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    by_block = copies.select("block", "part", "_by", "_key", "_label", "embedding").groupBy("block", "part", "_by")
    by_query = asked.select("block", "part", "_by", "_query_row", "_query", "_wanted").groupBy("block", "part", "_by")
    return by_query.cogroup(by_block).applyInArrow(meet, "_query_row long, score double")
