import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import jaccard_join as jj
from termloom.llm.graph import components

from .conftest import EDGES


def grams(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} - {()}


def brute(rows, size, similarity):
    texts = sorted({t or "" for _, t in rows})
    copies = {t: sum((x or "") == t for _, x in rows) for t in texts}
    sets = {t: grams(t, size) for t in texts}
    links = {t: [] for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if shared >= similarity * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                    links[a].append(b)
                    links[b].append(a)
                    root[find(a)] = find(b)
    classes = {}
    for key, t in rows:
        classes.setdefault(find(t or ""), []).append(key)
    out = []
    for key, t in rows:
        t = t or ""
        keys = classes[find(t)]
        least = min((k for k in keys if k is not None), default=None)
        out.append((key, least, len(keys), key == least, sum(copies[x] for x in links[t]) + copies[t] - 1, len(links[t])))
    return sorted(out, key=str)


@pytest.mark.parametrize("block, giant", [(256, 16_384), (3, 16_384), (3, 5)])
def test_against_brute_force(table, monkeypatch, block, giant):
    monkeypatch.setattr(jj, "BLOCK", block)
    monkeypatch.setattr(jj, "GIANT", giant)
    rng = random.Random(5)
    bases = [[f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 60))] for _ in range(12)]
    rows = []
    for i in range(140):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            words[rng.randrange(len(words))] = f"v{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(500 + i, t) for i, (_, t) in enumerate(EDGES)] + [(None, rows[0][1]), (rows[3][0], rows[3][1])]
    # A recall of all but certain, so that the outcome does not hang on chance.
    found = jj.near_duplicates(table(rows), recall=1 - 1e-9).drop("text_hash").collect()
    assert sorted(map(tuple, found), key=str) == brute(rows, 5, 0.8)


def test_recall_of_bands():
    bands = jj.bands_for(0.8, 0.9999, 8)
    assert 1 - (1 - 0.8**8) ** bands >= 0.9999 > 1 - (1 - 0.8**8) ** (bands - 1)
    assert jj.bands_for(1.0, 0.9999, 8) == 1
    # Pairs at the threshold share a band about as often as the choice says.
    rng, hits = np.random.default_rng(1), 0
    for _ in range(300):
        shared, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (80, 10, 10))
        values = np.concatenate([np.sort(np.concatenate([shared, x])) for x in (a, b)])
        x, y = jj.band_hashes(values, np.array([0, 90, 180]), 6, 8)
        hits += (x == y).any()
    expected = 300 * (1 - (1 - 0.8**8) ** 6)
    assert abs(hits - expected) < 4 * expected**0.5


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    frame = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    assert {tuple(r) for r in components(frame).collect()} == {(x, find(x)) for x in root}
    assert components(frame.where("false")).collect() == []


def test_edges(edges, nothing):
    rows = {(r["doc_id"], r["class_id"], r["class_size"], r["kept"]) for r in jj.near_duplicates(edges).collect()}
    assert {(4, 4, 4, True), (5, 4, 4, False), (None, 4, 4, False), (6, 6, 2, True), (7, 6, 2, False), (3, 3, 1, True)} <= rows
    assert {(1, 1, 3, True), (2, 1, 3, False), (None, 1, 3, False)} <= rows
    assert jj.near_duplicates(nothing).collect() == []


def test_plan_has_no_cross_join(edges):
    plan = jj.near_duplicates(edges)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
