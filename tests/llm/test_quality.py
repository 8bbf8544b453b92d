import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from termloom.llm import quality
from termloom.llm.words import words_of

from .conftest import EDGES

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{name}.parquet") for name in ("documents", "labels"))
    held_out = quality.fold(F.col("doc_id"), 3) == 1
    model = quality.train(docs, labels.where(~held_out))
    rows = quality.score(docs, model).join(labels, "doc_id").where(held_out).select("score", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([(r["score"] >= 0.5) == r["quality"] for r in rows]) > 0.93


def test_updates_learn_and_shrink():
    rng = np.random.default_rng(0)
    examples = []
    for _ in range(400):
        label = int(rng.random() < 0.5)
        places = np.unique(np.concatenate([rng.integers(10, 60, 5), [label]]))
        examples.append((places, np.ones(len(places), dtype=np.float32), label))
    weights, _ = quality.follow_the_leader(examples, 6, 3)
    assert weights[1] > 0.5 and weights[0] < -0.5
    assert np.abs(weights[10:]).max() < min(weights[1], -weights[0])
    assert weights[2:10].tolist() == [0.0] * 8


def test_features_do_not_cross_rows():
    whole = quality.features(words_of(pa.array(["a b c", None, "", "d E"])), 18)
    first, last = (quality.features(words_of(pa.array([t])), 18)[0] for t in ("a b c", "d E"))
    assert sorted(whole[0][whole[1] == 0]) == sorted(first) and sorted(whole[0][whole[1] == 3]) == sorted(last)
    assert len(first) == 10 and not set(whole[1]) & {1, 2}


def test_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (6, 1), (None, 1), (9, None), (8, 3)], "doc_id long, quality int")
    model = quality.train(edges, labels)
    rows = quality.score(edges, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.accepted(edges, model, least=0.0).collect().__len__() == len(EDGES)
    assert quality.accepted(edges, model).columns == edges.columns
    untrained = quality.train(edges, labels.where("false"))
    assert {r["score"] for r in quality.score(edges, untrained).collect()} == {0.5}
    assert quality.score(nothing, model).collect() == []
