"""What the physical plans must and must not contain."""

import re

import pytest

import __spark_entry__ as entry
from termloom.operators import articles, search, terms
from termloom.plans import queries

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"silhouette_sweep", "final_clusters", "scatter_table", "kmeans"}))
def test_no_cross_join(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_term_stats_shuffles_once_by_term(spark):
    tokens = queries._table(spark, SF_DIR, "documents").select("doc_id", "text")
    text = plan(terms.term_stats(terms.tokenized(tokens)))
    assert text.count("Exchange") == 1 and "partial_sum" in text
    # Once for both counts, and not again below a filter.
    assert text.count("regexp_extract_all") == 1


def test_tfidf_does_not_shuffle(spark):
    rows = queries._table(spark, SF_DIR, "documents").select("doc_id", "text")
    tf = terms.term_frequency(terms.tokenized(rows), ["de", "que"])
    assert "Exchange" not in plan(terms.entries(terms.tfidf(tf, [1.0, 2.0]), "features"))


def test_search_is_one_pass(spark):
    text = plan(search.similar_docs(queries._vector_docs(spark, SF_DIR), 3))
    assert "TakeOrderedAndProject" in text and "Join" not in text


def test_cleaning_runs_once_and_filters_come_first(spark):
    rows = queries._pages(spark, SF_DIR)
    text = plan(articles.article_text(articles.articles(rows)))
    assert text.count("(?is)<ref") == 1


def test_only_needed_columns_are_read(spark):
    text = plan(queries.term_stats(spark, SF_DIR))
    assert re.search(r"ReadSchema: struct<text:string>", text)


@pytest.mark.parametrize("name", ["batch_knn", "topics_fixed_v"])
def test_ranking_is_cut_before_its_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(entry.queries()[name](spark, SF_DIR))
