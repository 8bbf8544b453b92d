import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import language_model as lm

from .conftest import EDGES


def words(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [w.translate(lower) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [None]


def brute(rows, held, order, weights):
    """Scores by dictionaries; weights: bucket -> list, uniform first."""
    grams = Counter()
    for key, text in rows:
        if not held(key):
            tokens = [None] * (order - 1) + words(text)
            for i in range(order - 1, len(tokens)):
                for n in range(order):
                    grams[tuple(tokens[i - n : i + 1])] += 1
    total = sum(c for g, c in grams.items() if len(g) == 1)
    distinct = sum(1 for g in grams if len(g) == 1)
    texts = sum(1 for key, _ in rows if not held(key))
    out = []
    for key, text in rows:
        tokens = [None] * (order - 1) + words(text)
        base = score = 0.0
        for i in range(order - 1, len(tokens)):
            base += math.log10((grams[(tokens[i],)] + 0.1) / (total + 0.1 * (distinct + 1)))
            estimates = [grams[(tokens[i],)] / max(total, 1)]
            context = total
            for n in range(1, order):
                before = tuple(tokens[i - n : i])
                context = texts if i == order - 1 else grams[before]
                estimates.append(grams[tuple(tokens[i - n : i + 1])] / max(context, 1))
            own = weights[min(int(context).bit_length(), lm.FREQUENCIES - 1)]
            score += math.log10(own[0] / (distinct + 1) + sum(w * e for w, e in zip(own[1:], estimates, strict=True)))
        known = sum(grams[(t,)] > 0 for t in tokens[order - 1 :])
        out.append((held(key), len(tokens) - order + 1, known, total, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


TEXTS = [(i, " ".join(f"{'Aa'[j % 2]}{(i * j) % 7}" for j in range(i % 23))) for i in range(60)] + [r for r in EDGES if r[0] and r[0] < 6]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_dictionaries(table, monkeypatch, order):
    fixed = np.random.default_rng(order).random((lm.FREQUENCIES, order + 1)) + 0.1
    fixed /= fixed.sum(axis=1, keepdims=True)
    monkeypatch.setattr(lm, "mixture_weights", lambda *_: fixed)
    rest = F.crc32(F.col("doc_id").cast("string")) % 10
    found = lm.lm_scores(table(TEXTS), rest == 0, rest == 1, order=order).collect()
    got = sorted([(r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in found], key=str)
    assert got == brute(TEXTS, lambda k: zlib.crc32(str(k).encode()) % 10 == 0, order, fixed)


def test_trigrams_are_the_default(table, monkeypatch):
    fixed = np.random.default_rng(9).random((lm.FREQUENCIES, 4)) + 0.1
    fixed /= fixed.sum(axis=1, keepdims=True)
    monkeypatch.setattr(lm, "mixture_weights", lambda *_: fixed)
    found = lm.lm_scores(table(TEXTS), F.col("doc_id") % 10 == 0, F.col("doc_id") % 10 == 1).collect()
    assert sorted(round(r["score"], 6) for r in found) == sorted(x[5] for x in brute(TEXTS, lambda k: k % 10 == 0, 3, fixed))


def test_weights_are_learned():
    rng = np.random.default_rng(0)
    estimates = rng.random((4000, 3)) ** 4
    truth = np.array([[0.2, 0.3, 0.5], [0.6, 0.1, 0.3]])
    bucket = np.repeat([1, 2], 2000)
    likelihood = (estimates * truth[bucket - 1]).sum(axis=1)
    found = lm.mixture_weights(bucket, likelihood, estimates)
    assert np.allclose(found.sum(axis=1), 1)
    # No weights fit the held-out counts better than those found, the true ones included.
    for b in (1, 2):
        mine = bucket == b
        fit = lambda w: (likelihood[mine] * np.log(estimates[mine] @ w)).sum()
        assert fit(found[b]) >= fit(truth[b - 1]) - 1e-6
    assert (found[5] == found[0]).all()


def test_learned_model_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rest = F.crc32(F.col("doc_id").cast("string")) % 10
    sums = lm.lm_scores(docs, rest == 0, rest == 1).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert sums["s"] > sums["b"]


def test_edges(edges, nothing):
    assert lm.lm_scores(edges, F.lit(False), F.lit(False)).count() == len(EDGES)
    nobody = lm.lm_scores(edges, F.lit(True), F.lit(False)).collect()
    assert {r["train_tokens"] for r in nobody} == {0} and all(math.isfinite(r["score"]) for r in nobody)
    assert lm.lm_scores(nothing, F.lit(False), F.lit(True)).collect() == []


@pytest.mark.parametrize("order", range(1, 8))
def test_the_grid_is_bounded(order):
    most = lm.levels(order)
    assert most >= 3 and lm.FREQUENCIES * most**order <= lm.CELLS
    estimates = np.array([0.0, 1e-300, 1e-9, 1e-5, 0.3, 1.0])
    for vocabulary in (0, 1, 50_000, 10**10):
        level = lm._level(estimates, vocabulary, most)
        assert level[0] == 0 and level[1] == 1 and level[-1] == most - 1 and (np.diff(level) >= 0).all()


def test_coarse_cells_keep_the_held_out_score(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rest = F.crc32(F.col("doc_id").cast("string")) % 10

    def score():
        return lm.lm_scores(docs, rest == 0, rest == 1).where("held_out").agg(F.sum("score")).first()[0]

    bounded = score()
    monkeypatch.setattr(lm, "CELLS", 1 << 40)
    assert bounded == pytest.approx(score(), rel=2e-3)


def test_a_chunk_is_scored_in_short_runs():
    """Scoring a chunk of 400,000 tokens takes less memory than its estimates would all at once."""
    import tracemalloc

    import pyarrow as pa

    from termloom.llm import language_model as lm

    rng = np.random.default_rng(1)
    tokens, lengths = rng.integers(1, 5000, 400_000).astype(np.uint64), np.full(2000, 200)
    vocabulary, places = np.unique(tokens, return_inverse=True)
    assert all(np.array_equal(a, b) for a, b in zip(lm._distinct(tokens), (vocabulary, places)))
    row = {"chunk": 1, "role": 0, "ids": list(range(2000)), "lengths": lm._small(lengths), "vocabulary": lm._planes(vocabulary, 8), "places": lm._small(places)}
    chunk = lm.Chunk(row["vocabulary"], row["places"], row["lengths"], 3)
    answers = [{"level": i, "bucket": 0, "total": lm._small(chunk.counts(i)), "fold": b""} for i in range(3)]
    score = lm._scores(3, len(tokens), len(vocabulary), np.full((lm.FREQUENCIES, 4), 0.25))
    tables = pa.Table.from_pylist([row]), pa.Table.from_pylist(answers)
    tracemalloc.start()
    found = score(*tables)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 35_000_000 and sum(found["n_tokens"].to_pylist()) == 400_000
    # One run for each text gives the same.
    lm.RUN_TOKENS, most = 1, lm.RUN_TOKENS
    again = score(*tables)
    lm.RUN_TOKENS = most
    assert np.allclose(found["score"].to_numpy(), again["score"].to_numpy()) and found["n_known"] == again["n_known"]


def test_requests_are_steps_between_hashes():
    """Sorted hashes come back from their steps, and the steps of a chunk's requests take fewer bytes than the hashes."""
    edges = [np.array(x, dtype=np.uint64) for x in ([5], [0, 2**64 - 1], [2**63 - 1, 2**63, 2**63 + 7], range(300))]
    assert all((lm._unrising(lm._rising(keys)) == keys).all() for keys in edges)
    tokens = np.sort(lm.mixed(np.arange(1, 50_001, dtype=np.uint64)))
    places, lengths = np.arange(len(tokens)), np.array([20_000, 30_000])
    row = [("vocabulary", lm._planes(tokens, 8)), ("places", lm._small(places)), ("lengths", lm._small(lengths)), ("chunk", 1), ("role", 0)]
    batch = lm.pa.RecordBatch.from_pylist([dict(row)])
    chunk = lm.Chunk(*(dict(row)[k] for k in ("vocabulary", "places", "lengths")), 3)
    asked = [r for b in lm._requests(3, 8)(iter([batch])) for r in b.to_pylist()]
    for level, keys in enumerate(chunk.keys):
        grams = [r["grams"] for r in sorted(asked, key=lambda r: r["bucket"]) if r["level"] == level]
        assert (np.concatenate([lm._unrising(g) for g in grams]) == keys).all()
        assert sum(map(len, grams)) < 0.95 * lm._width(level) * len(keys)
