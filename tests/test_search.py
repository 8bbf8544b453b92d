import numpy as np
import pytest

from termloom.functions import vectors
from termloom.operators import search


def table(spark, rows, key="term_id", label="term"):
    return spark.createDataFrame(rows, f"{key} long, {label} string, embedding array<double>")


@pytest.fixture
def terms(spark):
    return table(spark, [
        (0, "apple", [1.0, 0.0]), (1, "berry", [1.0, 0.0]), (2, "cedar", [2.0, 0.0]), (3, "dune", [0.0, 0.0]),
        (4, "elm", [0.0, 1.0]), (5, "fig", [-1.0, 0.0]),
    ])


def test_ties_go_to_the_later_label_and_zero_vectors_score_zero(terms):
    found = [(r.term, r.score) for r in search.similar_terms(terms, " unknown APPLE elm ").collect()]
    assert [t for t, _ in found] == ["cedar", "berry", "elm", "dune", "fig"]
    assert found[0][1] == pytest.approx(1, abs=1e-8) and found[3][1] == 0.0
    assert found[-1][1] == pytest.approx(-1, abs=1e-8)


def test_zero_query_vector(terms):
    assert {r.score for r in search.similar_terms(terms, "dune").collect()} == {0.0}


@pytest.mark.parametrize("text", ["", "   ", "nothing here"])
def test_unknown_terms_find_nothing(terms, text):
    assert search.similar_terms(terms, text).count() == 0


def test_first_known_word_wins(terms):
    assert search.find_term(terms, "zzz elm apple").first().term == "elm"


@pytest.fixture
def docs(spark):
    return table(spark, [
        (7, " Alpha One ", [0.0, 1.0]), (3, "alpha one", [1.0, 0.0]), (5, "Beta", [1.0, 0.1]), (9, "alphabet", [0.5, 0.5]),
    ], "doc_id", "title")


def test_titles(docs):
    assert {(r.doc_id, r.status) for r in search.title_candidates(docs, "ALPHA").collect()} == {
        (7, "many"), (3, "many"), (9, "many"),
    }
    assert [(r.doc_id, r.status) for r in search.title_candidates(docs, "beta ").collect()] == [(5, "one")]
    assert search.title_candidates(docs, "be").count() == 0
    status = {t: search.title_status(docs, t).first().status for t in ("alpha", "beta", "gamma", "be")}
    assert status == {"alpha": "many", "beta": "one", "gamma": "none", "be": "none"}
    first = search.select_title(docs, "Alpha One").first()
    assert (first.doc_id, first.embedding) == (3, [1.0, 0.0])


def test_similar_docs_keep_equal_titles(docs):
    assert [r.doc_id for r in search.similar_docs(docs, 3).collect()] == [5, 9, 7]


def test_modes_agree_on_zero(spark):
    pair = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    for mode in vectors.COSINE_EPSILON:
        assert pair.select(vectors.cosine(pair.a, pair.b, mode)).first()[0] == 0.0


def brute(queries, rows, n, mode, exclude, ties):
    eps = vectors.COSINE_EPSILON[mode]
    found = {}
    for qk, q in queries:
        scored = []
        for key, label, x in rows:
            if exclude and key == qk:
                continue
            score = np.dot(q, x) / (np.linalg.norm(q) * np.linalg.norm(x) + eps)
            scored.append((round(float(score), search.SCORE_DIGITS), label, key))
        if ties == "key":
            scored.sort(key=lambda t: (-t[0], t[2]))
        else:
            scored.sort(key=lambda t: (t[0], t[1], -t[2]), reverse=True)
        found[qk] = [key for _, _, key in scored[:n]]
    return found


@pytest.mark.parametrize("sizes", [{}, {"max_bytes": 0, "block_rows": 16}])
@pytest.mark.parametrize("ties", ["label", "key"])
def test_batch_equals_brute_force_with_a_third_copies(spark, sizes, ties):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        vector = [1.0, 2.0, 3.0] if i % 3 == 0 else [0.0, 0.0, 0.0] if i % 40 == 1 else rng.normal(size=3).tolist()
        rows.append((i, f"t{i % 50}", vector))
    corpus = table(spark, rows).repartition(5)
    queries = corpus.filter("term_id < 45").selectExpr("term_id as query_id", "embedding")
    found = search.batch_nearest(
        queries, corpus, "query_id", "term_id", "term", 7, exclude_self=True, ties=ties, **sizes
    )
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.term_id)
    expected = brute([(i, v) for i, _, v in rows[:45]], rows, 7, vectors.VIEWER, True, ties)
    assert got == expected


def test_neighbor_samples(terms):
    found = search.neighbor_samples(terms, ("fig", "nope", "apple"), candidates=4, n=2).collect()
    assert [r.term for r in found] == ["fig", "apple"]
    assert [h._1 for h in found[1].neighbors] == ["cedar", "apple"]
    assert [h._1 for h in found[0].neighbors] == ["dune", "apple"]
    assert search.neighbor_samples(terms, ("nope",)).isEmpty()


def test_seeds_keep_their_order(spark, terms):
    seeds = spark.createDataFrame([(0, "fig"), (1, "nope"), (2, "apple")], "seed_pos int, term string")
    assert [r.term for r in search.known_seeds(seeds, terms).collect()] == ["fig", "apple"]


def test_copies_of_the_table_do_not_grow_with_its_blocks(spark, monkeypatch):
    """120 rows in blocks of two pass by a group for each core and more, not by 60 blocks."""
    copied = []
    spread = search.to_every_group
    monkeypatch.setattr(search, "to_every_group", lambda rows, groups: (copied.append(groups), spread(rows, groups))[1])
    rng = np.random.default_rng(7)
    rows = [(i, f"t{i}", rng.normal(size=3).tolist()) for i in range(120)]
    corpus = table(spark, rows)
    queries = corpus.selectExpr("term_id as query_id", "embedding")
    found = search.batch_nearest(queries, corpus, "query_id", "term_id", "term", 4, max_bytes=0, block_rows=2)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.term_id)
    assert got == brute([(i, v) for i, _, v in rows], rows, 4, vectors.VIEWER, False, "label")
    assert copied == [2 * spark.sparkContext.defaultParallelism]
