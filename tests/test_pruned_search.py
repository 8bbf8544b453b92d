import numpy as np
import pytest

from termloom.functions import vectors
from termloom.operators.pruned_search import pruned_nearest
from tests.test_search import brute, table


def answered(search):
    got = {}
    for r in search.found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.term_id)
    return got


def asked(corpus, rows):
    return corpus.filter(f"term_id < {rows}").selectExpr("term_id as query_id", "embedding")


@pytest.mark.parametrize("ties", ["label", "key"])
@pytest.mark.parametrize("mode", [vectors.VIEWER, vectors.SAMPLE_V3])
def test_equals_brute_force_with_copies_and_zero_vectors(spark, ties, mode):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(150):
        vector = [1.0, 2.0, 3.0] if i % 3 == 0 else [0.0] * 3 if i % 40 == 1 else (rng.normal(size=3) * 10.0 ** rng.integers(-6, 3)).tolist()
        rows.append((i, f"t{i % 50}", vector))
    corpus = table(spark, rows).repartition(5)
    found = pruned_nearest(
        asked(corpus, 60), corpus, "query_id", "term_id", "term", 7, mode, exclude_self=True, ties=ties, pivots=6, block_rows=16
    )
    assert answered(found) == brute([(i, v) for i, _, v in rows[:60]], rows, 7, mode, True, ties)


def clustered(spark, count):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(20, 16))
    rows = [(i, f"t{i}", (centers[i % 20] + 0.1 * rng.normal(size=16)).tolist()) for i in range(count)]
    return rows, table(spark, rows).repartition(4)


def test_far_blocks_are_never_multiplied(spark):
    rows, corpus = clustered(spark, 1200)
    found = pruned_nearest(asked(corpus, 100), corpus, "query_id", "term_id", "term", 5, pivots=60, block_rows=64)
    assert answered(found) == brute([(i, v) for i, _, v in rows[:100]], rows, 5, vectors.VIEWER, False, "label")
    assert 0 < found.share() < 0.2


def test_fewer_rows_than_asked_for_nulls_and_empty_tables(spark):
    corpus = table(spark, [(0, "a", [1.0, 0.0]), (1, "b", None), (2, "c", [0.0, 0.0]), (3, "d", [-1.0, 0.5])])
    queries = corpus.selectExpr("term_id as query_id", "embedding")
    found = pruned_nearest(queries, corpus, "query_id", "term_id", "term", 9)
    assert answered(found) == {0: [0, 2, 3], 2: [3, 2, 0], 3: [3, 2, 0]}
    for a, b in ((queries, corpus.limit(0)), (queries.limit(0), corpus), (queries, corpus.where("term_id = 2"))):
        hits = pruned_nearest(a, b, "query_id", "term_id", "term", 2)
        assert hits.found.count() == a.where("embedding is not null").count() * b.count()


def test_pairs_of_query_and_block_stay_in_the_tasks(spark):
    """Vectors without clusters, where no block can be ruled out: a query is sent to its first blocks and to one group."""
    rng = np.random.default_rng(3)
    rows = [(i, f"t{i}", rng.normal(size=32).tolist()) for i in range(400)]
    corpus = table(spark, rows).repartition(4)
    found = pruned_nearest(asked(corpus, 400), corpus, "query_id", "term_id", "term", 3, pivots=40, block_rows=16)
    assert answered(found) == brute([(i, v) for i, _, v in rows], rows, 3, vectors.VIEWER, False, "label")
    assert found.met.count() <= 400 * (3 + 1) and found.share() > 0.9
