"""The block solver and the blocked projection against NumPy."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from termloom.operators import block_svd, lsa
from termloom.plans import lsa_job, queries

SF_DIR = "/root/testdata/sf0.001"


def frame(spark, matrix, parts=3):
    rows = [(i, Vectors.sparse(len(r), {int(j): float(r[j]) for j in np.flatnonzero(r)})) for i, r in enumerate(matrix)]
    return spark.createDataFrame(rows, ["id", "features"]).repartition(parts)


def sparse_matrix(rows, columns, seed, rank=None):
    rng = np.random.default_rng(seed)
    matrix = rng.normal(size=(rows, columns)) * (rng.random((rows, columns)) < 0.2)
    if rank:
        matrix = (rng.normal(size=(rows, rank)) * 0.5 ** np.arange(rank)) @ rng.normal(size=(rank, columns))
    matrix[rows // 2] = 0
    return matrix


def table(v):
    return np.array([r.v for r in v.orderBy("term_id").collect()])


@pytest.mark.parametrize("max_bytes", [0, 1 << 28])
@pytest.mark.parametrize("rows, columns, rank", [(60, 25, None), (12, 40, None), (90, 150, 12)])
def test_equals_numpy(spark, max_bytes, rows, columns, rank):
    matrix = sparse_matrix(rows, columns, rows, rank)
    values, v = block_svd.block_svd(frame(spark, matrix), 5, columns, max_bytes=max_bytes)
    _, s, vt = np.linalg.svd(matrix)
    assert np.allclose(values, s[:5], rtol=1e-8)
    found = table(v)
    assert np.allclose(found.T @ found, np.eye(5), atol=1e-9)
    wanted = vt[:5].T * lsa.column_signs(vt[:5].T)
    assert np.allclose(found, wanted, atol=1e-6)


def test_low_rank_and_zero(spark):
    one = np.outer(np.arange(6.0), [1.0, 2.0, 0.0, -3.0])
    values, v = block_svd.block_svd(frame(spark, one), 3, 4)
    assert len(values) == 1 and np.isclose(values[0], np.linalg.norm(one))
    assert np.allclose(one @ table(v), values * (one @ table(v)) / np.linalg.norm(one @ table(v)))
    for matrix in (np.zeros((4, 3)), np.zeros((0, 3))):
        rows = frame(spark, matrix) if len(matrix) else frame(spark, np.ones((1, 3))).where("false")
        values, v = block_svd.block_svd(rows, 2, 3)
        assert len(values) == 0 and [list(r.v) for r in v.collect()] == [[], [], []]


@pytest.mark.parametrize("cells", [1, 40, 1 << 22])
def test_products_in_runs(monkeypatch, cells):
    monkeypatch.setattr(lsa, "PRODUCT_CELLS", cells)
    rng = np.random.default_rng(3)
    matrix = sparse_matrix(30, 11, 3)
    matrix[[0, 29]] = 0
    lengths = (matrix != 0).sum(axis=1)
    ids, values, v = np.nonzero(matrix)[1], matrix[matrix != 0], rng.normal(size=(11, 4))
    assert np.allclose(lsa.products(ids, values, lengths, v), matrix @ v)
    total, y = np.zeros((11, 3)), rng.normal(size=(30, 3))
    lsa.add_outer(total, ids, values, lengths, y)
    assert np.allclose(total, matrix.T @ y)


@pytest.mark.parametrize("block_bytes", [64, 1 << 26])
def test_blocked_projection(spark, monkeypatch, block_bytes):
    """Repeated keys, rows without entries, dense rows, and blocks of one term."""
    monkeypatch.setattr(lsa, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr("termloom.settings.BLOCK_BYTES", block_bytes)
    matrix = sparse_matrix(40, 17, 8)
    v = np.random.default_rng(1).normal(size=(17, 3))
    rows = frame(spark, matrix).withColumn("id", F.col("id") % 7)
    dense = spark.createDataFrame([(9, Vectors.dense([1.0] * 17))], ["id", "features"])
    terms = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "term_id int, v array<double>")
    found = lsa.project_documents(rows.unionByName(dense), terms, max_bytes=0)
    assert found.columns == ["id", "embedding"]
    want = sorted([(i % 7, *r) for i, r in enumerate(matrix @ v)] + [(9, *v.sum(axis=0))])
    assert np.allclose(sorted((r.id, *r.embedding) for r in found.collect()), want)


def test_job_with_v_as_a_table(spark):
    tokens = queries.stored(queries._tokens(spark, SF_DIR), "tokens")
    near, far = (lsa_job.fit(tokens, 4, 5, 80_000, max_bytes=b) for b in (1 << 28, 0))
    assert far.factors.v is None
    assert np.allclose(near.factors.singular_values, far.factors.singular_values, rtol=1e-6)
    for name in ("doc_embeddings", "doc_embeddings_us"):
        a, b = (np.array([r.embedding for r in getattr(m, name)().orderBy("doc_id").collect()]) for m in (near, far))
        assert a.shape == b.shape and np.abs(a - b).max() < 1e-3
    assert [r.terms for r in near.topics().orderBy("topic").collect()][0] == [r.terms for r in far.topics().orderBy("topic").collect()][0]
