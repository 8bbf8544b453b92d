"""k-means, silhouette, PCA and the tables behind the cluster plots.

Input tables have a key column and `features`, an array<double>.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.functions import vectors
from termloom.operators.articles import spread_scan
from termloom.operators.lsa import PRODUCT_CELLS, column_signs, list_column
from termloom.operators.streams import GROUPS_PER_CORE, TILE_HELD, TILE_PASSING, group_count, sliced, streamed, to_every_group
from termloom.settings import BROADCAST_BYTES, MAX_CLUSTERS, stored

# Restarts, seed, iteration limit and tolerance of k-means, the swept range, the default k.
RESTARTS = 10
SEED = 42
MAX_ITERATIONS = 300
TOLERANCE = 1e-4
SWEEP = range(2, 15)
DEFAULT_K = 5
# Rounds of drawing candidates for starting centres, before which one point is drawn and after which all are weighed.
ROUNDS = 4
# Draws of which the best is taken when the candidates are clustered.
TRIES = 4
# Points of a cluster that a sampled silhouette scores.
SAMPLED = 200
# Rows of a batch of distance sums, and of sent points that are prepared at a time.
SENT_ROWS = 8192
# Distances to centres that are held at a time, and the points they are from; they stay in a core's cache.
LLOYD_CELLS, LLOYD_POINTS = 1 << 17, 512

EUCLIDEAN, SQUARED_EUCLIDEAN = "euclidean", "squaredEuclidean"


def last_per_term(rows: DataFrame, order_key: str = "term_id") -> DataFrame:
    """(term, embedding, first_seen): one vector per distinct term, that of its last row. `order_key` is unique."""
    # Ids are combined by hash map-side; vectors take no part in the aggregation.
    ends = rows.groupBy("term").agg(F.max(order_key).alias(order_key), F.min(order_key).alias("first_seen"))
    return rows.select("term", order_key, "embedding").join(ends, ["term", order_key]).select(
        "term", "embedding", "first_seen"
    )


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster").agg(F.count("*").alias("count")).orderBy("cluster")


def normalized(points: DataFrame) -> DataFrame:
    """Rows divided by their norm; zero rows stay zero."""
    return points.withColumn("features", vectors.unit(F.col("features")))


def with_vector(points: DataFrame) -> DataFrame:
    return points.withColumn("vector", array_to_vector("features"))


def kmeans(points: DataFrame, key: str, k: int, restarts: int = RESTARTS, seed: int = SEED, **fit) -> DataFrame:
    """(cluster, center) of the cheapest of `restarts` fits. `fit` goes to `fit_centers`."""
    return _center_table(points.sparkSession, fit_centers(points, key, [k], restarts, seed, **fit)[k])


def _center_table(spark: SparkSession, centers: np.ndarray) -> DataFrame:
    rows = [(i, center.tolist()) for i, center in enumerate(centers)]
    return spark.createDataFrame(rows, "cluster int, center array<double>")


def fit_centers(
    points: DataFrame,
    key: str,
    ks,
    restarts: int = RESTARTS,
    seed: int = SEED,
    max_iterations: int = MAX_ITERATIONS,
    tolerance: float = TOLERANCE,
    starts: dict[int, np.ndarray] | None = None,
) -> dict[int, np.ndarray]:
    """Centres of the cheapest of `restarts` k-means fits, for every k of `ks`, or of the one fit from `starts[k]`.

    All fits advance together: one pass over the points serves every k and every restart, so
    the number of passes is that of the slowest fit, not the sum of all. The driver holds only
    centres. A fit rests once its centres move less than `tolerance` times the mean variance.
    """
    ks = sorted(set(ks))
    # Every pass costs each row all its centres: all cores take part, however few files there are.
    rows = _packed(spread_scan(points.select(F.xxhash64(key, F.lit(seed)).alias("_hash"), "features"))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        variance = _variance(rows)
        if starts:
            restarts = 1
            fits = {(k, 0): np.asarray(starts[k], dtype=float) for k in ks}
        else:
            seeds = _seed_centers(rows, max(ks), restarts)
            fits = {(k, r): seeds[r][:k] for k in ks for r in range(restarts)}
        moving = set(fits)
        for _ in range(max_iterations):
            updated, _costs = _lloyd_step(rows, {name: fits[name] for name in moving})
            for name, centers in updated.items():
                if ((centers - fits[name]) ** 2).sum() <= tolerance * variance:
                    moving.discard(name)
                fits[name] = centers
            if not moving:
                break
        if moving:
            warnings.warn(f"{len(moving)} of {len(fits)} fits still moved after {max_iterations} steps", stacklevel=2)
        _, costs = _lloyd_step(rows, fits)
    finally:
        rows.unpersist()
    return {k: fits[min(((k, r) for r in range(restarts)), key=costs.get)] for k in ks}


def _packed(rows: DataFrame) -> DataFrame:
    """(hashes, points): the hashes and the vectors of some rows as bytes."""

    def pack(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            lengths, values = batch.column(1).value_lengths(), batch.column(1).flatten()
            if lengths.null_count or values.null_count or len(lengths.unique()) > 1:
                raise ValueError("vectors must have one length and no null values")
            x = values.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            hashes = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v.tobytes()], pa.binary()) for v in (hashes, x)], names=["hashes", "points"]
            )

    return rows.mapInArrow(pack, "hashes binary, points binary")


def _unpacked(batches):
    """Hashes and vectors of the blocks that `_packed` made."""
    for batch in batches:
        for hashes, points in zip(batch.column(0), batch.column(1), strict=True):
            hashes = np.frombuffer(hashes.as_buffer(), np.int64)
            yield hashes, np.frombuffer(points.as_buffer(), float).reshape(len(hashes), -1)


def _variance(rows: DataFrame) -> float:
    """Mean of the sample variances of all coordinates; a task returns one row of moments."""

    def moments(batches):
        import pyarrow as pa

        count, mean, squares = 0, 0.0, 0.0
        for _, x in _unpacked(batches):
            n, middle = len(x), x.mean(axis=0)
            squares = squares + ((x - middle) ** 2).sum(axis=0) + (middle - mean) ** 2 * (count * n / (count + n))
            mean, count = mean + (middle - mean) * (n / (count + n)), count + n
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([float(count)]), pa.array([mean]), pa.array([squares])], names=["n", "mean", "squares"])

    found = rows.mapInArrow(moments, "n double, mean array<double>, squares array<double>").collect()
    n, means = np.array([r.n for r in found]), np.array([r.mean for r in found])
    mean = n @ means / n.sum()
    squares = np.array([r.squares for r in found]).sum(axis=0) + n @ (means - mean) ** 2
    return float(squares.mean() / max(n.sum() - 1, 1))


def _seed_centers(rows: DataFrame, k: int, restarts: int) -> np.ndarray:
    """k starting centres per restart, each drawn with odds in proportion to the squared distance
    to the nearest one so far.

    A row draws log(u) / distance2 with u from its hash, and the largest draw wins: the same
    odds as sampling from the whole table, with one row per task and restart to compare.
    """
    block = rows.first()
    width = len(block.points) // len(block.hashes)
    if k > ROUNDS + 2 and 8 * restarts * (1 + ROUNDS * k) * width <= BROADCAST_BYTES:
        return _oversampled_centers(rows, k, restarts)
    chosen = None
    for step in range(k):
        found = np.array(_drawn(rows, chosen, step, restarts, 1))
        chosen = found if chosen is None else np.concatenate([chosen, found], axis=1)
    return chosen


def _drawn(rows: DataFrame, chosen, step: int, restarts: int, most: int) -> list[np.ndarray]:
    """The points with the `most` largest draws, per restart; a task returns that many."""
    known = rows.sparkSession.sparkContext.broadcast(chosen)
    draws = rows.mapInArrow(_draw_task(known, step, restarts, most), "restart int, draw double, features array<double>")
    order = Window.partitionBy("restart").orderBy(F.desc("draw"), "features")
    best = draws.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).orderBy("restart", "place").collect()
    known.destroy()
    return [np.array([r.features for r in best if r.restart == restart]) for restart in range(restarts)]


def _oversampled_centers(rows: DataFrame, k: int, restarts: int) -> np.ndarray:
    """The same from ROUNDS + 2 passes, however large k is: k candidates a round, all drawn by their distances to those
    of earlier rounds; then each candidate is weighed by the points nearest to it, and k of them are drawn on the driver."""
    chosen = _drawn(rows, None, 0, restarts, 1)
    for step in range(1, ROUNDS + 1):
        chosen = [np.concatenate([c, *([n] if len(n) else [])]) for c, n in zip(chosen, _drawn(rows, chosen, step, restarts, k), strict=True)]
    known = rows.sparkSession.sparkContext.broadcast(chosen)

    def weigh(batches):
        import pyarrow as pa

        weights = [np.zeros(len(c)) for c in known.value]
        for _, x in _unpacked(batches):
            for weight, c in zip(weights, known.value, strict=True):
                weight += np.bincount(_squares(x, c).argmin(axis=1), minlength=len(c))
        for restart, weight in enumerate(weights):
            yield pa.RecordBatch.from_arrays(
                [pa.array([restart] * len(weight), pa.int32()), pa.array(range(len(weight)), pa.int32()), pa.array(weight)],
                names=["restart", "place", "weight"],
            )

    weighed = rows.mapInArrow(weigh, "restart int, place int, weight double").groupBy("restart", "place").agg(F.sum("weight").alias("weight"))
    weights = [np.zeros(len(c)) for c in chosen]
    for r in weighed.collect():
        weights[r.restart][r.place] = r.weight
    known.destroy()
    return np.array([_weighted_centers(c, w, k, restart) for restart, (c, w) in enumerate(zip(chosen, weights, strict=True))])


def _weighted_centers(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the points, each drawn with odds in proportion to its weight times its squared distance to those before it;
    of a few draws the one that leaves the least distance."""
    rng = np.random.default_rng(seed)
    nearest, out = np.full(len(points), 1.0), []
    for step in range(k):
        odds = weights * nearest
        odds = odds / odds.sum() if odds.sum() > 0 else np.full(len(points), 1 / len(points))
        tries = rng.choice(len(points), 1 if step == 0 else TRIES, p=odds)
        left = [np.minimum(nearest if step else np.inf, _squares(points, points[i : i + 1])[:, 0]) for i in tries]
        best = int(np.argmin([(weights * d).sum() for d in left]))
        nearest = left[best]
        out.append(points[tries[best]])
    return np.array(out)


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (centers * centers).sum(axis=1) - 2 * x @ centers.T, 0.0)


def _draw_task(known, step: int, restarts: int, most: int):
    def mixed(values):
        import numpy as np

        # The SplitMix64 finalizer.
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))

    def draw(batches):
        import numpy as np
        import pyarrow as pa

        centers = known.value
        best_draw, best_row = [np.empty(0)] * restarts, [None] * restarts
        for hashes, x in _unpacked(batches):
            hashes = hashes.view(np.uint64)
            for restart in range(restarts):
                stream = mixed(np.array([step * 1_000_003 + restart + 1], dtype=np.uint64))
                u = (mixed(hashes ^ stream) >> np.uint64(11)).astype(float) + 0.5
                weight = np.ones(len(x))
                if centers is not None:
                    weight = _squares(x, centers[restart]).min(axis=1)
                draws = np.full(len(x), -np.finfo(float).max)
                np.divide(np.log(u / 2.0**53), weight, out=draws, where=weight > 0)
                top = np.argsort(-draws, kind="stable")[:most]
                rows = x[top] if best_row[restart] is None else np.concatenate([best_row[restart], x[top]])
                draws = np.concatenate([best_draw[restart], draws[top]])
                top = np.argsort(-draws, kind="stable")[:most]
                best_draw[restart], best_row[restart] = draws[top], rows[top]
        for restart in range(restarts):
            if len(best_draw[restart]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([restart] * len(best_draw[restart]), pa.int32()), pa.array(best_draw[restart]),
                     pa.array(list(best_row[restart]), pa.list_(pa.float64()))],
                    names=["restart", "draw", "features"],
                )

    return draw


def _lloyd_step(rows: DataFrame, fits: dict) -> tuple[dict, dict]:
    """New centres and current cost of several fits from one pass over the points.

    A task returns one row of sums per fit, so what is shuffled does not grow with the
    points of a task. A centre without points stays where it is.
    """
    names = sorted(fits)
    ends = np.cumsum([len(fits[name]) for name in names])
    centers_now = np.concatenate([fits[name] for name in names])
    if centers_now.nbytes > BROADCAST_BYTES:
        # Fits do not depend on each other: half of them at a time.
        if len(names) == 1:
            raise ValueError(f"{centers_now.nbytes} bytes of centres are too many to send to every task")
        halves = [_lloyd_step(rows, {name: fits[name] for name in part}) for part in (names[::2], names[1::2])]
        return {**halves[0][0], **halves[1][0]}, {**halves[0][1], **halves[1][1]}
    state = rows.sparkSession.sparkContext.broadcast((centers_now, ends))
    schema = "fit int, cost double, total binary"
    sums = rows.mapInArrow(_sum_task(state), schema)
    # Sums stay bytes: an aggregate of their values takes longer than the pass.
    tasks = min(len(names), rows.sparkSession.sparkContext.defaultParallelism)
    reduced = sums.repartitionById(tasks, F.pmod("fit", F.lit(tasks))).mapInArrow(_add_up, schema).collect()
    state.destroy()
    moved, costs = {name: fits[name].copy() for name in names}, {}
    for row in reduced:
        centers = moved[names[row.fit]]
        total = np.frombuffer(row.total, float).reshape(len(centers), -1)
        held = total[:, -1] > 0
        centers[held] = total[held, :-1] / total[held, -1:]
        costs[names[row.fit]] = row.cost
    return moved, costs


def _add_up(batches):
    """Costs and sums of each fit over all tasks."""
    found = {}
    for batch in batches:
        for fit, cost, total in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            cost_so_far, so_far = found.get(fit, (0.0, 0.0))
            found[fit] = cost_so_far + cost, so_far + np.frombuffer(total.as_buffer(), float)
    yield _fit_rows(found)


def _fit_rows(found: dict):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.int32()), pa.array([c for c, _ in found.values()], pa.float64()),
         pa.array([t.tobytes() for _, t in found.values()], pa.binary())],
        names=["fit", "cost", "total"],
    )


def _sum_task(state):
    def sum_up(batches):
        import numpy as np

        centers, ends = state.value
        sizes = np.diff([0, *ends])
        # One product gives the squared distance less that of the point: (-2c, |c|^2) by (x, 1).
        by = np.concatenate([-2.0 * centers, (centers * centers).sum(axis=1)[:, None]], axis=1)
        # Sums of (x, 1) per centre.
        total, cost = np.zeros(by.shape), np.zeros(len(ends))
        # Fits with one number of centres stand side by side and are taken together.
        spans, first = [], 0
        while first < len(sizes):
            k = sizes[first]
            same = first + int(np.argmin([*(sizes[first:] == k), False]))
            last = min(same, first + max(1, LLOYD_CELLS // (int(k) * LLOYD_POINTS)))
            spans.append((slice(first, last), ends[first] - k, ends[last - 1], k))
            first = last
        for _, points in _unpacked(batches):
            for start in range(0, len(points), LLOYD_POINTS):
                x = points[start : start + LLOYD_POINTS]
                norm = (x * x).sum(axis=1)
                x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
                for fits, low, high, k in spans:
                    distance2 = (by[low:high] @ x.T).reshape(-1, k, len(x))
                    best = distance2.min(axis=1)
                    nearest = distance2 == best[:, None]
                    if np.count_nonzero(nearest) != best.size:
                        # Of equally near centres the first.
                        nearest = distance2.argmin(axis=1)[:, None] == np.arange(k)[:, None]
                    total[low:high] += nearest.reshape(high - low, len(x)).astype(float) @ x
                    cost[fits] += np.maximum(best + norm, 0.0).sum(axis=1)
        yield _fit_rows({i: (cost[i], total[end - size : end]) for i, (end, size) in enumerate(zip(ends, sizes, strict=True))})

    return sum_up


def cluster_means(points: DataFrame, label: str = "cluster") -> DataFrame:
    """(cluster, center): mean vector per label, combined map-side."""
    return (
        points.select(F.col(label).alias("cluster"), array_to_vector("features").alias("vector"))
        .groupBy("cluster")
        .agg(vector_to_array(Summarizer.mean(F.col("vector"))).alias("center"))
    )


def assigned(points: DataFrame, centers: DataFrame) -> DataFrame:
    """Add `cluster` and `distance2` of the nearest centre; ties go to the lower cluster.

    The centres (k rows, checked against the broadcast bound) travel with the task; points
    stay put.
    """
    number, width = centers.agg(F.count("*"), F.max(F.size("center"))).first()
    if number * (width or 0) * 8 > BROADCAST_BYTES:
        raise ValueError(f"{number} centres are too many to send to every task: use search.batch_nearest")
    rows = centers.orderBy("cluster").collect()
    labels = np.array([r.cluster for r in rows], dtype=np.int32)
    return _with_nearest(points, {"cluster": np.array([r.center for r in rows])}, labels, distance="distance2")


def _with_nearest(points: DataFrame, centers: dict, labels=None, distance: str | None = None) -> DataFrame:
    """One label column per entry of `centers`, in one pass."""
    size = sum(c.nbytes for c in centers.values())
    if size > BROADCAST_BYTES:
        raise ValueError(f"{size} bytes of centres are too many to send to every task")
    matrices = points.sparkSession.sparkContext.broadcast(centers)
    position = points.columns.index("features")

    def nearest(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = batch.column(position).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            columns, names = list(batch.columns), list(batch.schema.names)
            for name, matrix in matrices.value.items():
                distance2 = np.stack([((x - c) ** 2).sum(axis=1) for c in matrix], axis=1)
                best = distance2.argmin(axis=1)
                columns.append(pa.array((best if labels is None else labels[best]).astype(np.int32)))
                names.append(name)
            if distance:
                columns.append(pa.array(distance2.min(axis=1)))
                names.append(distance)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = points.select("*").schema
    for name in centers:
        schema = schema.add(name, T.IntegerType())
    if distance:
        schema = schema.add(distance, T.DoubleType())
    return points.mapInArrow(nearest, schema)


def silhouette(
    points: DataFrame,
    labelings: list[str],
    key: str,
    metric: str = EUCLIDEAN,
    max_bytes: int = BROADCAST_BYTES,
    block_rows: int | None = None,
) -> DataFrame:
    """(labeling, silhouette): mean silhouette of one or more labelings of the same points.

    "euclidean" is exact and takes every pairwise distance once for all labelings: against a
    broadcast copy of the points while that fits in `max_bytes`, otherwise all points pass by groups of them
    (`streams`). Distances are taken in tiles, of `block_rows` points either way if given.
    "squaredEuclidean" needs one pass and no pairs, but is another number. A one-member cluster
    scores 0.
    """
    if metric == SQUARED_EUCLIDEAN:
        return _silhouette_squared(points, labelings)
    sizes = _sizes(points, labelings)
    if min(len(s) for s in sizes.values()) < 2:
        raise ValueError("a silhouette needs at least two clusters")
    # Slots number the clusters of all labelings one after another.
    slots, counts = {}, []
    for name in labelings:
        slots[name] = {label: len(counts) + i for i, label in enumerate(sizes[name])}
        counts.extend(sizes[name].values())
    slot_columns = []
    for name in labelings:
        slot_of = F.create_map(*[F.lit(x) for pair in slots[name].items() for x in pair])
        slot_columns.append(slot_of[F.col(name).cast("int")])
    slotted = points.select("features", F.array(*slot_columns).alias("_slots"))

    sums = _distance_sums(slotted, len(counts), len(labelings), max_bytes, block_rows)
    bounds = [(min(slots[n].values()), max(slots[n].values()) + 1) for n in labelings]
    return _mean_silhouettes(sums, labelings, bounds, counts)


def _sizes(points: DataFrame, labelings: list[str]) -> dict[str, dict[int, int]]:
    """Members per cluster of every labeling, from one pass."""
    labels = F.explode(F.array(*[
        F.struct(F.lit(name).alias("labeling"), F.col(name).cast("int").alias("label")) for name in labelings
    ]))
    limit = MAX_CLUSTERS * len(labelings)
    counted = points.select(labels.alias("l")).groupBy("l.labeling", "l.label").count()
    counted = counted.orderBy("label").limit(limit + 1).collect()
    if len(counted) > limit:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters in a labeling")
    return {name: {r.label: r["count"] for r in counted if r.labeling == name} for name in labelings}


def _distance_sums(slotted: DataFrame, width: int, labelings: int, max_bytes: int, block_rows: int | None) -> DataFrame:
    """(_slots, sums): for every point its summed distance to the members of every slot."""
    rows, size = slotted.agg(F.count("*"), F.max(F.size("features"))).first()
    tiles = (block_rows, block_rows) if block_rows else (TILE_HELD, TILE_PASSING)
    schema = "_slots array<int>, sums array<double>"

    def start(held):
        return _Sums(held, width, labelings, tiles)

    if rows * (size * 8 + labelings * 4) <= max_bytes:
        table = slotted.toArrow()
        # Points with like labels follow each other, so that a tile has few slots.
        everything = slotted.sparkSession.sparkContext.broadcast(table.take(np.lexsort(_Sums._matrix(table, "_slots").T)))

        def scan(batches):
            for batch in batches:
                sums = start(batch)
                for part in everything.value.to_batches(max_chunksize=SENT_ROWS):
                    sums.meet(part)
                yield from sums.finish()

        # Every row costs as many distances as there are rows: all cores take part, however few files there are.
        dealt = slotted.repartition(GROUPS_PER_CORE * slotted.sparkSession.sparkContext.defaultParallelism)
        return dealt.mapInArrow(scan, schema)

    # A group holds its points and, for each of them, one sum per slot.
    groups = group_count(slotted, rows, 8 * (2 * size + width))
    # Every row has a number of its own, so that rows with one key stay apart; stored, so that it is drawn once.
    numbered = stored(slotted.withColumn("_row", F.monotonically_increasing_id()), "silhouette_points")
    held = numbered.select("features", "_slots", F.pmod(F.xxhash64("_row"), F.lit(groups)).alias("_group"))
    passing = to_every_group(numbered.select("features", "_slots"), groups)
    return streamed(held, passing, groups, start, schema, order=(F.reverse("_slots"),))


class _Sums:
    """For some points (features, _slots) the summed distances to the members of every slot among points that pass by."""

    def __init__(self, held, width: int, labelings: int, tiles):
        self.held = held
        self.tile, self.step = tiles
        x = self._matrix(held, "features")
        # Distances do not change if all points are moved; near the origin they lose fewer digits.
        self.shift = x.mean(axis=0) if len(x) else 0.0
        x = x - self.shift
        # One product gives the squared distance: (-2x, |x|^2, 1) by (y, 1, |y|^2).
        self.x = np.concatenate([-2.0 * x, (x * x).sum(axis=1)[:, None], np.ones((len(x), 1))], axis=1)
        self.sums = np.zeros((len(x), width))
        # With few slots a product with their indicators adds up faster than sorted runs.
        self.few = 40 * labelings

    @staticmethod
    def _matrix(rows, name):
        column = rows.column(name)
        flat = (column.combine_chunks() if hasattr(column, "combine_chunks") else column).flatten()
        return flat.to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)

    def meet(self, rows) -> None:
        if not rows.num_rows or not len(self.x):
            return
        features, slots = self._matrix(rows, "features") - self.shift, self._matrix(rows, "_slots")
        for start in range(0, len(features), self.step):
            y, slot = features[start : start + self.step], slots[start : start + self.step]
            y = np.concatenate([y, np.ones((len(y), 1)), (y * y).sum(axis=1)[:, None]], axis=1).T
            found, place = np.unique(slot, return_inverse=True)
            few = len(found) <= self.few
            if few:
                member = np.zeros((len(slot), len(found)))
                member[np.arange(len(slot))[:, None], place.reshape(slot.shape)] = 1.0
            else:
                # Per labeling the members in the order of their slots, and where each slot begins.
                orders = [np.argsort(labels, kind="stable") for labels in slot.T]
                runs = [(order, *np.unique(labels[order], return_index=True)) for labels, order in zip(slot.T, orders)]
            for low in range(0, len(self.x), self.tile):
                distance = self.x[low : low + self.tile] @ y
                np.maximum(distance, 0.0, out=distance)
                np.sqrt(distance, out=distance)
                if few:
                    self.sums[low : low + self.tile, found] += distance @ member
                    continue
                for order, present, begin in runs:
                    self.sums[low : low + self.tile, present] += np.add.reduceat(distance[:, order], begin, axis=1)

    def finish(self):
        import pyarrow as pa

        slots = self.held.column("_slots")
        slots = slots.combine_chunks() if hasattr(slots, "combine_chunks") else slots
        for low in range(0, len(self.sums), SENT_ROWS):
            part = self.sums[low : low + SENT_ROWS]
            yield pa.RecordBatch.from_arrays([slots.slice(low, len(part)), list_column(part)], names=["_slots", "sums"])


def _mean_silhouettes(sums: DataFrame, labelings: list[str], bounds, counts) -> DataFrame:
    """Silhouette of every point per labeling from its distance sums, then the means."""
    size = F.array(*[F.lit(float(c)) for c in counts])
    means = []
    for i, (low, high) in enumerate(bounds):
        own = F.col("_slots")[i]
        own_size = F.col("size")[own]
        inner = F.try_divide(F.col("sums")[own], own_size - 1)
        others = F.array_min(
            F.filter(
                F.transform(
                    F.sequence(F.lit(low), F.lit(high - 1)),
                    lambda s: F.when(s != own, F.get(F.col("sums"), s) / F.get(F.col("size"), s)),
                ),
                lambda d: d.isNotNull(),
            )
        )
        widest = F.greatest(inner, others)
        score = F.coalesce(F.when(own_size > 1, F.try_divide(others - inner, widest)), F.lit(0.0))
        means.append(F.avg(score).alias(f"s{i}"))
    pairs = F.array(*[
        F.struct(F.lit(name).alias("labeling"), F.col(f"s{i}").alias("silhouette"))
        for i, name in enumerate(labelings)
    ])
    return sums.withColumn("size", size).agg(*means).select(F.inline(pairs))


def sampled_silhouette(
    points: DataFrame, labelings: list[str], key: str, per_cluster: int = SAMPLED, seed: int = SEED, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """(labeling, silhouette, standard_error, sampled): the Euclidean silhouette estimated from some points of each cluster.

    The `per_cluster` points of a cluster with the lowest hashes of their keys are scored against all points, so one
    pass over the points takes the place of all pairs, and each score is exact. Clusters weigh by their sizes; the
    standard error is that of a stratified sample, 0 where all points of every cluster are taken. The sample and its
    distance sums must stay below `max_bytes`. Rows without a label do not belong to a labeling.
    """
    if per_cluster < 2:
        raise ValueError("a standard error needs two points of a cluster")
    sizes = _sizes(points, labelings)
    sizes = {name: {label: n for label, n in found.items() if label is not None} for name, found in sizes.items()}
    if min(len(s) for s in sizes.values()) < 2:
        raise ValueError("a silhouette needs at least two clusters")
    width = points.select(F.max(F.size("features"))).first()[0]
    taken, most = sum(min(n, per_cluster) for s in sizes.values() for n in s.values()), max(map(len, sizes.values()))
    # Sums come back with their places, as a table of three columns and more on the way.
    if 64 * taken * (width + most) > max_bytes:
        raise ValueError("the sample is too large to send: take fewer points per cluster")
    picked = None
    for i, name in enumerate(labelings):
        order = Window.partitionBy("cluster").orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key)
        rows = points.select(F.col(name).cast("int").alias("cluster"), key, "features").where("cluster is not null")
        rows = rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= per_cluster)
        rows = rows.select(F.lit(i).alias("labeling"), "cluster", "features")
        picked = rows if picked is None else picked.unionByName(rows)
    sample = sorted(picked.collect(), key=lambda r: (r.labeling, r.cluster))
    slots = [{label: j for j, label in enumerate(sizes[name])} for name in labelings]
    vectors = np.array([r.features for r in sample], dtype=float)
    span = np.searchsorted([r.labeling for r in sample], np.arange(len(labelings) + 1))
    sent = points.sparkSession.sparkContext.broadcast((vectors, span, slots))

    def run(batches):
        import pyarrow as pa

        vectors, span, slots = sent.value
        total, step = np.zeros((len(vectors), most)), max(1, PRODUCT_CELLS // len(vectors))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            for low in range(0, len(x), step):
                part = x[low : low + step]
                squares = (vectors**2).sum(axis=1)[:, None] + (part**2).sum(axis=1) - 2 * vectors @ part.T
                distance = np.sqrt(np.maximum(squares, 0.0))
                for i, slot in enumerate(slots):
                    labels = batch.column(1 + i).slice(low, len(part)).to_pylist()
                    of = np.array([slot.get(label, -1) for label in labels])
                    member = (of[:, None] == np.arange(len(slot))).astype(float)
                    total[span[i] : span[i + 1], : len(slot)] += distance[span[i] : span[i + 1]] @ member
        point, cluster = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(point), pa.array(cluster), pa.array(total[point, cluster])], names=["point", "slot", "sum"])

    columns = points.select("features", *[F.col(name).cast("int").alias(f"_{i}") for i, name in enumerate(labelings)])
    sums = columns.mapInArrow(run, "point long, slot long, sum double").groupBy("point", "slot").agg(F.sum("sum").alias("sum"))
    # A row for each sampled point and cluster; the bound above holds for them.
    found = np.zeros((len(sample), most))
    table = sums.toArrow()
    found[table["point"].to_numpy(), table["slot"].to_numpy()] = table["sum"].to_numpy()
    out = []
    for i, name in enumerate(labelings):
        counts = np.array(list(sizes[name].values()), dtype=float)
        own = np.array([slots[i][r.cluster] for r in sample[span[i] : span[i + 1]]])
        rows, at = found[span[i] : span[i + 1], : len(counts)], np.arange(len(own))
        inner = rows[at, own] / np.maximum(counts[own] - 1, 1)
        means = rows / counts
        means[at, own] = np.inf
        outer = means.min(axis=1)
        widest = np.maximum(inner, outer)
        scores = np.where((counts[own] > 1) & (widest > 0), (outer - inner) / np.where(widest > 0, widest, 1), 0.0)
        mean, error = 0.0, 0.0
        for c, n in enumerate(counts):
            some = scores[own == c]
            mean += n / counts.sum() * some.mean()
            if len(some) < n:
                error += (n / counts.sum()) ** 2 * some.var(ddof=1) / len(some) * (1 - len(some) / n)
        out.append((name, float(mean), float(np.sqrt(error)), len(own)))
    return points.sparkSession.createDataFrame(out, "labeling string, silhouette double, standard_error double, sampled long")


def _silhouette_squared(points: DataFrame, labelings: list[str]) -> DataFrame:
    prepared = with_vector(points)
    rows = []
    for name in labelings:
        evaluator = ClusteringEvaluator(
            featuresCol="vector", predictionCol="_cluster", distanceMeasure=SQUARED_EUCLIDEAN
        )
        labeled = prepared.select("vector", F.col(name).cast("double").alias("_cluster"))
        rows.append((name, float(evaluator.evaluate(labeled))))
    return points.sparkSession.createDataFrame(rows, "labeling string, silhouette double")


def silhouette_sweep(
    points: DataFrame, key: str, ks=SWEEP, restarts: int = RESTARTS, seed: int = SEED, metric: str = EUCLIDEAN, **fit
) -> DataFrame:
    """(k, silhouette) for every k, on the vectors as they are.

    All fits share their passes and all labelings are scored from the same distances. `fit` goes to `fit_centers`.
    """
    rows = points.select(key, "features")
    centers = fit_centers(rows, key, ks, restarts, seed, **fit)
    # Stored, because the score reads the labels three times.
    labeled = stored(_with_nearest(rows, {f"k{k}": centers[k] for k in centers}), "sweep_labels")
    scores = silhouette(labeled, [f"k{k}" for k in centers], key, metric)
    return scores.select(F.substring("labeling", 2, 9).cast("int").alias("k"), "silhouette")


def pick_k(scores: DataFrame, mode: str = "fixed", k: int = DEFAULT_K) -> DataFrame:
    """One row (k): the configured k, or with mode="argmax" the first k of the best score."""
    if mode == "argmax":
        return scores.orderBy(F.desc("silhouette"), "k").select("k").limit(1)
    if mode != "fixed":
        raise ValueError(f"unknown mode {mode!r}")
    return scores.select(F.lit(k).alias("k")).limit(1)


def final_clusters(
    points: DataFrame, key: str, k: int = DEFAULT_K, restarts: int = RESTARTS, seed: int = SEED, **fit
) -> tuple[DataFrame, DataFrame]:
    """Normalise, cluster, label: (points with `cluster`, centres). `fit` goes to `fit_centers`."""
    unit_points = normalized(points)
    centers = fit_centers(unit_points, key, [k], restarts, seed, **fit)[k]
    return _with_nearest(unit_points, {"cluster": centers}), _center_table(points.sparkSession, centers)


class Projection:
    """Two principal components of centred data, kept to project other rows the same way.

    The loading of largest size on each axis is positive.
    """

    def __init__(self, points: DataFrame):
        prepared = with_vector(points).select("vector")
        self._mean = StandardScaler(
            withMean=True, withStd=False, inputCol="vector", outputCol="centered"
        ).fit(prepared)
        pca = PCA(k=2, inputCol="centered", outputCol="axes").fit(self._mean.transform(prepared))
        loadings = pca.pc.toArray()
        self.axes = loadings * column_signs(loadings)
        self.explained = pca.explainedVariance.toArray()
        self.mean = self._mean.mean.toArray()

    def apply(self, rows: DataFrame, vector: str = "features") -> DataFrame:
        """Replace the vector by x and y, as column expressions."""
        centered = F.zip_with(
            F.col(vector), F.array(*[F.lit(float(m)) for m in self.mean]), lambda a, m: a - m
        )
        axes = [F.array(*[F.lit(float(w)) for w in self.axes[:, i]]) for i in range(2)]
        others = [c for c in rows.columns if c != vector]
        return rows.withColumn("_c", centered).select(
            *others, vectors.dot(F.col("_c"), axes[0]).alias("x"), vectors.dot(F.col("_c"), axes[1]).alias("y")
        )


def scatter_table(labeled: DataFrame, centers: DataFrame, projection: Projection) -> DataFrame:
    """(x, y, cluster, is_center): the projected points followed by the projected centres."""
    points = projection.apply(labeled.select("cluster", "features"))
    middle = projection.apply(centers.select("cluster", F.col("center").alias("features")))
    return (
        points.withColumn("is_center", F.lit(False))
        .unionByName(middle.withColumn("is_center", F.lit(True)))
        .select("x", "y", "cluster", "is_center")
    )


def cluster_radius(points_2d: DataFrame, centers_2d: DataFrame) -> DataFrame:
    """(cluster, radius): mean distance of the points to their centre; empty clusters are left out."""
    centers = centers_2d.select("cluster", F.col("x").alias("cx"), F.col("y").alias("cy"))
    distance = F.sqrt(
        (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx"))
        + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    )
    return points_2d.join(centers, "cluster").groupBy("cluster").agg(F.avg(distance).alias("radius"))


def covariance(points: DataFrame) -> DataFrame:
    """(i, j, covariance) of the vector columns, the sample covariance the components come from."""
    rows = MLUtils.convertVectorColumnsFromML(with_vector(points).select("vector"), "vector")
    matrix = RowMatrix(rows).computeCovariance().toArray()
    cells = [(i, j, float(c)) for i, row in enumerate(matrix) for j, c in enumerate(row)]
    return points.sparkSession.createDataFrame(cells, "i int, j int, covariance double")
