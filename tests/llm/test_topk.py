import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import topk


def brute(rows, k, scale=64):
    good = [
        (i, tuple(math.floor(scale * x) for x in v)) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in {g for g in good if g[0] % 20 == 0}:
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(2048, 8192), (3, 50)])
@pytest.mark.parametrize("width", [1, 2, 8])
def test_against_brute_force(spark, blocks, width):
    rng = random.Random(width)
    # Few different values, so that ties are common.
    rows = [(i, [rng.choice([-1.5, -0.01, 0.0, 0.5, 1.0, 2.0]) for _ in range(width)]) for i in range(300)]
    rows += [(400, None), (420, [None] * width), (440, [math.nan] * width), (460, [math.inf] * width), (None, [1.0] * width), (7, [2.0] * width)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, rank int, query string")
    found = topk.top_k(frame, F.col("vec_id") % 20 == 0, k=7, query_rows=blocks[0], candidate_rows=blocks[1])
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, 7)


def test_few_rows_and_short_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0]), (2, []), (3, [-1.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(frame, F.col("vec_id") % 20 == 0)
    padded = [(i, v + [0.0] * (2 - len(v))) for i, v in rows]
    assert sorted(map(tuple, found.collect())) == brute(padded, 20)
    assert topk.top_k(frame.where("false"), F.col("vec_id") % 20 == 0).collect() == []


def test_lists_stop_early(monkeypatch):
    """With few dimensions and one strong direction the bound ends the reading of the lists."""
    rng = np.random.default_rng(0)
    vectors = rng.integers(-50, 50, (5000, 2))
    block = topk.Lists(np.arange(5000), vectors)
    read = []
    seen = topk.Lists.seen
    monkeypatch.setattr(topk.Lists, "seen", lambda self, q, depth: (read.append(depth), seen(self, q, depth))[1])
    queries = rng.integers(-50, 50, (20, 2))
    place, column, score = topk.search(block, np.full(20, -1), queries, 5)
    want = [(i, int(s)) for i, q in enumerate(queries) for s in sorted(vectors @ q)[::-1][:5]]
    assert sorted(zip(place, score, strict=True)) == sorted(want)
    assert max(read) < 2500


def test_scores_near_the_end_of_64_bits():
    rng = np.random.default_rng(1)
    vectors = rng.integers(2**26, 2**27, (9000, 64)) * rng.choice([-1, 1], (9000, 1))
    block = topk.Lists(np.arange(9000), vectors)
    place, column, score = topk.search(block, np.array([5]), vectors[5:6], 4)
    exact = sorted((-sum(int(a) * int(b) for a, b in zip(vectors[5], v, strict=True)), i) for i, v in enumerate(vectors[:9000]) if i != 5)[:4]
    assert sorted((-s, c) for s, c in zip(score, column, strict=True)) == exact
