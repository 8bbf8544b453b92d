"""The registered queries of the operators: SQL where there is some, otherwise the contract's columns."""

import pytest

import corpus_pipeline
from termloom.llm import catalogue
from tests.compare import database, differences, spark_rows, sql_rows

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_html_text": ["page_id", "text", "n_chars"],
    "op2_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op3_lm_scores": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op7_packing": ["doc_id", "piece", "first_word", "n_words", "shard", "bin", "free_words"],
    "op13_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op10_quality": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    left = spark_rows(catalogue.QUERIES[name](spark, SF_DIR))
    assert left[1] and differences(left, sql_rows(database(SF_DIR), catalogue.SQL[name])) == []


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_columns(spark, name):
    found = catalogue.QUERIES[name](spark, SF_DIR)
    assert found.columns == COLUMNS[name] and found.count() > 0


def test_stages():
    assert list(corpus_pipeline.QUERIES) == ["pipeline"] and len(corpus_pipeline.STAGES) == 5
