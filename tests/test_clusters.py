import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from termloom.operators import clusters
from termloom.plans import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    middles = np.array([[0, 0], [8, 0], [0, 8], [8, 8]])
    rows = [(i, (middles[i % 4] + rng.normal(scale=0.5, size=2)).tolist()) for i in range(400)]
    return spark.createDataFrame(rows, "id long, features array<double>").repartition(6).cache()


def matrix(points, key="id"):
    rows = points.orderBy(key).collect()
    return np.array([r.features for r in rows])


def cost(x, centers):
    return min_distance2(x, centers).sum()


def min_distance2(x, centers):
    return ((x[:, None, :] - centers[None]) ** 2).sum(axis=2).min(axis=1)


def test_kmeans_finds_the_blobs(blobs):
    centers = clusters.fit_centers(blobs, "id", [4, 2])
    assert set(centers) == {2, 4}
    found = sorted(np.round(centers[4] / 8).astype(int).tolist())
    assert found == [[0, 0], [0, 1], [1, 0], [1, 1]]
    assert centers[2].shape == (2, 2)


def test_kmeans_is_as_cheap_as_the_library_and_does_not_depend_on_partitions(spark):
    points = queries._points(spark, SF_DIR).select("vec_id", "features").cache()
    x = matrix(points, "vec_id")
    ours = clusters.fit_centers(points, "vec_id", [5])[5]
    theirs = min(
        KMeans(k=5, seed=s, maxIter=100, featuresCol="vector").fit(clusters.with_vector(points)).summary.trainingCost
        for s in range(3)
    )
    assert cost(x, ours) <= theirs * 1.02
    again = clusters.fit_centers(points.repartition(3), "vec_id", [5])[5]
    assert np.allclose(ours, again)


def test_centres_are_means_of_their_members(blobs):
    centers = clusters.kmeans(blobs, "id", 4, restarts=3)
    means = clusters.cluster_means(clusters.assigned(blobs, centers))
    a = {r.cluster: r.center for r in centers.collect()}
    b = {r.cluster: r.center for r in means.collect()}
    assert all(np.allclose(a[c], b[c], atol=1e-6) for c in a)


def test_more_clusters_than_points(spark):
    points = spark.createDataFrame([(0, [0.0]), (1, [0.0]), (2, [5.0])], "id long, features array<double>")
    centers = clusters.fit_centers(points, "id", [3], restarts=2)[3]
    assert cost(np.array([[0.0], [5.0]]), centers) == 0.0


def brute_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    scores = []
    for i, own in enumerate(labels):
        same = (labels == own) & (np.arange(len(x)) != i)
        if not same.any():
            scores.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, labels == other].mean() for other in set(labels) - {own})
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


@pytest.mark.parametrize("sizes", [{}, {"max_bytes": 0, "block_rows": 64}])
def test_silhouette_is_exact(blobs, sizes):
    labeled = blobs.select(
        "*",
        (F.col("id") % 4).alias("blob"),
        F.when(F.col("id") == 7, 9).otherwise(F.when(F.col("id") % 3 == 0, 0).otherwise(1)).alias("lonely"),
    )
    x, ids = matrix(blobs), np.arange(400)
    lonely = np.where(ids == 7, 9, np.where(ids % 3 == 0, 0, 1))
    found = {r.labeling: r.silhouette for r in clusters.silhouette(labeled, ["blob", "lonely"], "id", **sizes).collect()}
    assert found["blob"] == pytest.approx(brute_silhouette(x, ids % 4), abs=1e-9)
    assert found["lonely"] == pytest.approx(brute_silhouette(x, lonely), abs=1e-7)


def test_silhouette_needs_two_clusters(blobs):
    with pytest.raises(ValueError, match="two clusters"):
        clusters.silhouette(blobs.withColumn("one", F.lit(0)), ["one"], "id")


def test_sweep_prefers_the_true_number(blobs):
    scores = clusters.silhouette_sweep(blobs, "id", range(2, 7), restarts=4)
    assert scores.count() == 5
    assert clusters.pick_k(scores, "argmax").first().k == 4
    assert clusters.pick_k(scores).first().k == clusters.DEFAULT_K
    with pytest.raises(ValueError, match="unknown mode"):
        clusters.pick_k(scores, "elbow")


def test_zero_rows_stay_zero(spark):
    points = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0])], "id long, features array<double>")
    assert matrix(clusters.normalized(points)).tolist() == [[0.6, 0.8], [0.0, 0.0]]


def test_pca_is_centred_and_explains_the_variance(spark, blobs):
    projection = clusters.Projection(blobs)
    plane = projection.apply(blobs).orderBy("id").toPandas()[["x", "y"]].to_numpy()
    assert np.allclose(plane.mean(axis=0), 0, atol=1e-9)
    x = matrix(blobs)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(plane.var(axis=0, ddof=1), values)
    assert np.all(projection.axes[np.abs(projection.axes).argmax(axis=0), [0, 1]] > 0)


def test_scatter_table(blobs):
    labeled, centers = clusters.final_clusters(blobs, "id", k=3, restarts=2)
    table = clusters.scatter_table(labeled, centers, clusters.Projection(clusters.normalized(blobs)))
    assert table.columns == ["x", "y", "cluster", "is_center"]
    assert table.filter("is_center").count() == 3 and table.count() == 403
    assert sum(r["count"] for r in clusters.cluster_sizes(labeled).collect()) == 400


def test_last_vector_per_term(spark):
    rows = spark.createDataFrame([(0, "a", [1.0]), (1, "b", [2.0]), (2, "a", [3.0])], "term_id long, term string, embedding array<double>")
    found = {r.term: (r.embedding, r.first_seen) for r in clusters.last_per_term(rows).collect()}
    assert found == {"a": ([3.0], 0), "b": ([2.0], 1)}


@pytest.mark.parametrize("sizes", [{}, {"max_bytes": 0, "block_rows": 3}])
def test_silhouette_of_repeated_keys(spark, sizes):
    rows = [(1, [0.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [9.0, 9.0], 1), (None, [9.0, 8.0], 1), (None, [0.0, 1.0], 0)]
    points = spark.createDataFrame(rows, "id long, features array<double>, label int")
    found = clusters.silhouette(points, ["label"], "id", **sizes).first().silhouette
    x, labels = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    scores = []
    for i in range(len(x)):
        d = np.linalg.norm(x - x[i], axis=1)
        same = labels == labels[i]
        a, b = d[same].sum() / (same.sum() - 1), d[~same].mean()
        scores.append((b - a) / max(a, b))
    assert abs(found - np.mean(scores)) < 1e-9


def test_fits_in_halves_are_the_same(spark, monkeypatch):
    points = spark.createDataFrame([(i, [float(i % 5), float(i * i % 7)]) for i in range(60)], "id long, features array<double>")
    whole = clusters.fit_centers(points, "id", [2, 3], restarts=2)
    monkeypatch.setattr(clusters, "BROADCAST_BYTES", 3 * 2 * 8)
    halves = clusters.fit_centers(points, "id", [2, 3], restarts=2)
    assert all(np.allclose(whole[k], halves[k]) for k in whole)


def test_a_fit_cut_short_says_so(spark):
    points = spark.createDataFrame([(i, [float(i * i % 97)]) for i in range(200)], "id long, features array<double>")
    with pytest.warns(UserWarning, match="still moved"):
        clusters.fit_centers(points, "id", [5], restarts=1, max_iterations=1)


def test_sampled_silhouette(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=3) + 4 * (i % 3)).tolist(), i % 3, int(i > 0), None if i % 10 == 0 else i % 2) for i in range(300)]
    points = spark.createDataFrame(rows, "id long, features array<double>, a int, b int, c int").repartition(4)
    exact = {r.labeling: r.silhouette for r in clusters.silhouette(points, ["a", "b"], "id").collect()}
    whole = {r.labeling: r for r in clusters.sampled_silhouette(points, ["a", "b"], "id", 300).collect()}
    for name in ("a", "b"):
        assert whole[name].silhouette == pytest.approx(exact[name], abs=1e-6)
        assert whole[name].standard_error == 0 and whole[name].sampled == 300
    some = {r.labeling: r for r in clusters.sampled_silhouette(points, ["a", "b"], "id", 25).collect()}
    assert some["a"].sampled == 75 and 0 < some["a"].standard_error < 0.05
    assert abs(some["a"].silhouette - exact["a"]) < 4 * some["a"].standard_error
    labelled = points.where("c is not null")
    want = clusters.silhouette(labelled, ["c"], "id").first().silhouette
    assert clusters.sampled_silhouette(points, ["c"], "id", 300).first().silhouette == pytest.approx(want, abs=1e-6)
    with pytest.raises(ValueError, match="fewer points"):
        clusters.sampled_silhouette(points, ["a"], "id", 25, max_bytes=1000)
    with pytest.raises(ValueError, match="two clusters"):
        clusters.sampled_silhouette(points.withColumn("a", F.lit(1)), ["a"], "id")


def test_oversampled_starts(spark, monkeypatch):
    """As many passes for 30 centres as for 10, and fits as cheap as from one draw a pass."""
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(30, 4)) * 20
    rows = [(i, (middles[i % 30] + rng.normal(size=4)).tolist()) for i in range(1500)]
    points = spark.createDataFrame(rows, "id long, features array<double>").repartition(4)
    x = np.array([r[1] for r in rows])

    def cost(centers):
        return ((x[:, None] - np.asarray(centers)[None]) ** 2).sum(axis=2).min(axis=1).sum()

    passes = []
    drawn = clusters._drawn
    monkeypatch.setattr(clusters, "_drawn", lambda *a: (passes.append(1), drawn(*a))[1])
    fits = clusters.fit_centers(points, "id", [10, 30], restarts=3)
    assert len(passes) == clusters.ROUNDS + 1 and {k: len(c) for k, c in fits.items()} == {10: 10, 30: 30}
    monkeypatch.setattr(clusters, "ROUNDS", 100)
    one_by_one = clusters.fit_centers(points, "id", [10, 30], restarts=3)
    for k in (10, 30):
        assert cost(fits[k]) < 1.1 * cost(one_by_one[k])
    assert np.array_equal(clusters._weighted_centers(np.ones((3, 2)), np.ones(3), 2, 0), np.ones((2, 2)))


@pytest.mark.parametrize("sizes", [{}, {"max_bytes": 0, "block_rows": 7}])
def test_silhouette_of_many_clusters_from_one_split(spark, monkeypatch, sizes):
    """Sums by runs where clusters are many; points of one split are scored by all cores, in groups that follow the cores."""
    rng = np.random.default_rng(4)
    x, labels = rng.normal(size=(200, 5)) + 100, np.arange(200) % 50
    rows = [(i, x[i].tolist(), int(labels[i])) for i in range(200)]
    points = spark.createDataFrame(rows, "id long, features array<double>, label int").coalesce(1)
    counted = []
    groups_of = clusters.group_count
    monkeypatch.setattr(clusters, "group_count", lambda *a: (counted.append(groups_of(*a)), counted[-1])[1])
    found = clusters.silhouette(points, ["label"], "id", **sizes)
    assert found.first().silhouette == pytest.approx(brute_silhouette(x, labels), abs=1e-9)
    cores = spark.sparkContext.defaultParallelism
    assert counted == ([2 * cores] if sizes else [])
    slotted = points.selectExpr("features", "array(label) as _slots")
    assert clusters._distance_sums(slotted, 50, 1, sizes.get("max_bytes", 1 << 20), sizes.get("block_rows")).rdd.getNumPartitions() == 2 * cores


def test_fits_use_all_cores_for_one_split(spark, monkeypatch):
    points = spark.createDataFrame([(i, [float(i % 5), float(i % 7)]) for i in range(60)], "id long, features array<double>").coalesce(1)
    found, step = [], clusters._lloyd_step
    monkeypatch.setattr(clusters, "_lloyd_step", lambda rows, fits: (found.append(rows.rdd.getNumPartitions()), step(rows, fits))[1])
    clusters.fit_centers(points, "id", [2], restarts=1, max_iterations=2)
    assert set(found) == {spark.sparkContext.defaultParallelism}


def test_a_pass_reads_blocks_of_points(spark):
    """A pass gets some vectors as one value; of equal centres the first has the points, a centre without points stays."""
    x = np.random.default_rng(9).normal(size=(2500, 3))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "_hash long, features array<double>")
    rows = clusters._packed(points.coalesce(1))
    assert rows.count() == 3
    assert clusters._variance(clusters._packed(points.repartition(5))) == pytest.approx(x.var(axis=0, ddof=1).mean(), rel=1e-12)
    fits = {(2, 0): x[:2], (2, 1): x[[5, 5]], (3, 0): np.array([*x[7:9], [1e3] * 3])}
    moved, costs = clusters._lloyd_step(rows, fits)
    for name, centers in fits.items():
        label = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        want = np.array([x[label == j].mean(axis=0) if (label == j).any() else c for j, c in enumerate(centers)])
        assert np.allclose(moved[name], want, atol=1e-12) and costs[name] == pytest.approx(cost(x, centers))
    assert np.array_equal(moved[2, 1][1], x[5]) and np.array_equal(moved[3, 0][2], [1e3] * 3)


def test_points_pass_by_in_the_order_of_their_labels(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x, a, b = rng.normal(size=(300, 4)), rng.integers(0, 100, 300), rng.integers(0, 3, 300)
    points = spark.createDataFrame([(i, v.tolist(), int(a[i]), int(b[i])) for i, v in enumerate(x)], "id long, features array<double>, a int, b int")
    orders, streamed = [], clusters.streamed
    monkeypatch.setattr(clusters, "streamed", lambda *args, order: (orders.append(order), streamed(*args, order=order))[1])
    for sizes in ({}, {"max_bytes": 0}, {"max_bytes": 0, "block_rows": 16}):
        found = {r.labeling: r.silhouette for r in clusters.silhouette(points, ["a", "b"], "id", **sizes).collect()}
        assert found["a"] == pytest.approx(brute_silhouette(x, a), abs=1e-9)
        assert found["b"] == pytest.approx(brute_silhouette(x, b), abs=1e-9)
    assert len(orders) == 2


@pytest.mark.parametrize("odd", [None, [1.0, None], [1.0]])
def test_fits_of_odd_vectors_fail(spark, odd):
    points = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(15)] + [(15, odd)], "id long, features array<double>")
    with pytest.raises(Exception, match="one length and no null values"):
        clusters.fit_centers(points.coalesce(1), "id", [2], restarts=1)
