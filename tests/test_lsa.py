import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from termloom.operators import lsa
from termloom.plans import lsa_job, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return queries._model(spark, SF_DIR)


def by_id(df, column):
    return {r.doc_id: np.array(r[column]) for r in df.select("doc_id", column).collect()}


def test_factors(model):
    s, v = model.factors.singular_values, model.factors.v
    assert len(s) == queries.RANK and v.shape == (len(model.terms), queries.RANK)
    assert np.all(np.diff(s) <= 0)
    assert np.allclose(v.T @ v, np.eye(len(s)), atol=1e-9)
    assert np.all(v[np.abs(v).argmax(axis=0), range(len(s))] > 0)


def test_singular_values_are_those_of_the_matrix(model):
    matrix = np.array([r.features.toArray() for r in model.features.select("features").collect()])
    exact = np.linalg.svd(matrix, compute_uv=False)
    assert np.allclose(model.factors.singular_values, exact[: queries.RANK], rtol=1e-8)
    assert (model.factors.singular_values**2).sum() <= (matrix**2).sum()


def test_documents_by_every_route(spark, model):
    exact = {
        r.doc_id: r.features.toArray() @ model.factors.v for r in model.features.collect()
    }
    routes = (
        model.doc_embeddings(),
        model.doc_embeddings_us(),
        lsa.project_documents(model.features, model.term_vectors),
        lsa.project_documents(model.features, model.term_vectors, max_bytes=0),
    )
    for route in routes:
        found = by_id(route, "embedding")
        assert found.keys() == exact.keys()
        assert all(np.allclose(found[i], exact[i], atol=1e-9) for i in exact)


def test_column_norms_of_documents_are_singular_values(model):
    norms = {r.topic: r.norm for r in lsa.column_norms(model.doc_embeddings()).collect()}
    assert np.allclose([norms[j] for j in range(queries.RANK)], model.factors.singular_values)


def test_term_embeddings_and_topics(model):
    v, s = model.factors.v, model.factors.singular_values
    for row in model.term_embeddings().limit(50).collect():
        assert np.allclose(row.embedding, v[row.term_id] * s)
    for row in model.topics(5).collect():
        order = sorted(range(len(v)), key=lambda i: (-abs(v[i, row.topic]), i))[:5]
        assert row.terms == [model.terms[i] for i in order]
        assert np.allclose(row.weights, v[order, row.topic])


@pytest.fixture
def tiny(spark):
    rows = [(0, Vectors.dense(1, 0, 0)), (1, Vectors.sparse(3, {0: 2.0})), (2, Vectors.dense(0, 1, 0)),
            (3, Vectors.sparse(3, {}))]
    return spark.createDataFrame(rows, ["doc_id", "features"])


def test_low_rank_gives_fewer_values_and_too_large_k_fails(spark, tiny):
    factors = lsa.truncated_svd(tiny, 3)
    assert np.allclose(factors.singular_values, [np.sqrt(5), 1.0])
    found = by_id(lsa.project_on_factors(tiny, factors), "embedding")
    assert np.allclose(np.abs(found[1]), [2, 0]) and np.allclose(found[3], [0, 0])
    topics = lsa.topics(factors.term_vectors(spark, ["a", "b", "c"]), factors.singular_table(spark))
    assert topics.count() == 2
    with pytest.raises(PySparkException):
        lsa.truncated_svd(tiny, 4)


def test_sampled_vocabulary_still_weighs_the_whole_corpus(spark):
    tokens = spark.createDataFrame(
        [(i, ["aa", f"w{i % 7}"[0] + "bb"] + ["cc"] * (i % 3)) for i in range(200)], "doc_id long, tokens array<string>"
    )
    model = lsa_job.fit(tokens, 1, 1, 10, cv_fit_sample=0.5)
    assert model.features.count() == 200
    cc = model.terms.index("cc")
    documents = sum(1 for i in range(200) if i % 3)
    one = model.features.filter("doc_id = 1").first().features[cc]
    assert one == pytest.approx(np.log(201 / (documents + 1)))


def test_gaps_in_term_ids_are_refused(spark, tiny):
    v = spark.createDataFrame([(0, "a", [1.0]), (2, "c", [1.0])], "term_id int, term string, v array<double>")
    with pytest.raises(ValueError, match="gaps"):
        lsa.project_documents(tiny, v)


def test_topic_strength_in_order(spark):
    rows = spark.createDataFrame([(1, 2.0), (0, 3.0)], "topic int, singular_value double")
    assert [tuple(r) for r in lsa.topic_strength(rows).select(F.col("topic"), "singular_value").collect()] == [
        (0, 3.0), (1, 2.0),
    ]


@pytest.mark.parametrize("max_bytes", [1 << 20, 8 * 3, 0])
def test_projection_of_dense_rows_and_repeated_keys(spark, max_bytes):
    v = np.arange(12.0).reshape(3, 4)
    rows = [(1, Vectors.dense([1.0, 2.0, 0.0])), (1, Vectors.sparse(3, {2: 2.0})), (None, Vectors.sparse(3, {})), (1, Vectors.dense([0.0, 0.0, 1.0]))]
    features = spark.createDataFrame(rows, ["doc_id", "features"])
    table = spark.createDataFrame([(i, f"t{i}", row.tolist()) for i, row in enumerate(v)], "term_id int, term string, v array<double>")
    want = sorted((str(k), (x.toArray() @ v).tolist()) for k, x in rows)
    assert sorted((str(r.doc_id), r.embedding) for r in lsa.project_documents(features, table, max_bytes=max_bytes).collect()) == want
    factors = lsa.Factors(np.array([4.0, 3.0, 2.0, 1.0]), v)
    assert sorted((str(r.doc_id), r.embedding) for r in lsa.project_on_factors(features, factors, max_bytes=max_bytes).collect()) == want
    scaled = sorted((k, np.round(np.array(e) / factors.singular_values, 9).tolist()) for k, e in want)
    u_rows = lsa.left_vectors(features, factors, max_bytes=max_bytes).collect()
    assert sorted((str(r.doc_id), np.round(r.u, 9).tolist()) for r in u_rows) == scaled
    for broken in (table.where("term_id <> 1"), table.union(table)):
        with pytest.raises(ValueError, match="gaps"):
            lsa.project_documents(features, broken, max_bytes=max_bytes)


def test_batches_are_worked_on_in_slices(spark):
    """More rows than a slice, with NULL and empty arrays at the seams, in lemmas and in projections."""
    import pyarrow as pa

    from termloom.operators import lsa, streams, terms

    whole = pa.RecordBatch.from_pydict({"a": list(range(2 * streams.SLICE_ROWS + 5))})
    parts = list(streams.sliced([whole, whole.slice(0, 0)]))
    assert [p.num_rows for p in parts] == [streams.SLICE_ROWS, streams.SLICE_ROWS, 5]
    rows = [(i, None if i % 1024 == 0 else [] if i % 1024 == 1 else [f"w{i % 7}", "x", f"w{i % 3}"]) for i in range(2600)]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>").coalesce(1)
    lexicon = spark.createDataFrame([("w1", "one"), ("x", "ex")], "form string, lemma string")
    lemma = {"w1": "one", "x": "ex"}
    want = {i: t and [lemma.get(w, w) for w in t] for i, t in rows}
    for most in (None, 0):
        assert dict(map(tuple, terms.lemmatized(df, lexicon, most_rows=most).collect())) == want
    tf = terms.term_frequency(df.where("tokens is not null"), ["x", "w0", "w1"])
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [3.0, 1.0])], "term_id int, v array<double>")
    place = {"x": (1.0, 0.0), "w0": (0.0, 2.0), "w1": (3.0, 1.0)}
    want = {i: [sum(place.get(w, (0.0, 0.0))[j] for w in t) for j in range(2)] for i, t in rows if t is not None}
    for bound in ({}, {"max_bytes": 0}):
        assert dict(map(tuple, lsa.project_documents(tf, v, "tf", **bound).collect())) == want


def test_the_solver_passes_over_cached_vectors(tiny, monkeypatch):
    """What RowMatrix reads is cached, not a table that it would decode in every pass; it is released afterwards."""
    seen, solve = [], lsa.RowMatrix.computeSVD

    def watched(self, *args, **named):
        rows = self._java_matrix_wrapper._java_model.rows()
        seen.extend([rows, rows.getStorageLevel().useMemory()])
        return solve(self, *args, **named)

    monkeypatch.setattr(lsa.RowMatrix, "computeSVD", watched)
    assert np.allclose(lsa.truncated_svd(tiny, 2).singular_values, [np.sqrt(5), 1.0])
    assert seen[1] and not seen[0].getStorageLevel().useMemory()
