import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm import lexical_search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [(1, "one A größe"), (1, "one A größe"), (1, "two"), (2, None), (3, ""), (4, "日本語 one one w1x0 w2x0 w3x29"), (None, "one g h"), (5, "absent words only"), (6, "a b c d e f g h")]


def terms(text):
    return re.findall(lexical_search.TERM, (text or "").translate(LOWER))


def brute(docs, items, k):
    counts = [(key, Counter(terms(text))) for key, text in docs]
    n, words = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    out = []
    for item, asked in {(i, tuple(sorted(set(terms(t))))) for i, t in items}:
        df = {t: sum(1 for _, c in counts if t in c) for t in asked}
        found = []
        for key, c in counts:
            m = 50 + 50 * c.total() * n // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if c[t])
            if score > 0:
                found.append((-score, key is None, key))
        out += [(item, rank, key, -score) for rank, (score, _, key) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def ask(docs, items, **options):
    found = lexical_search.ranked_search(docs, items, **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in ITEMS], "item_id long, text string, doc_id string, score int")


def test_odd_rows(edges, nothing, items):
    docs = [(r["doc_id"], r["text"]) for r in edges.select("doc_id", "text").collect()]
    want = brute(docs, ITEMS, 50)
    assert want and ask(edges, items) == want
    assert ask(edges, items, k=2) == brute(docs, ITEMS, 2)
    assert ask(nothing, items) == [] and ask(edges, items.where("false")) == []


def test_bounds_change_nothing(edges, items, monkeypatch):
    want = ask(edges, items, k=3)
    for name, value in (("PASS_TERMS", 5), ("SHARD_POSTINGS", 7), ("LEAF", 1), ("ITEMS", 2), ("SLICE", 5)):
        monkeypatch.setattr(lexical_search, name, value)
    assert ask(edges, items, k=3) == want


def test_terms():
    text = "Größe A-b_c x1²\x7fy\x00z ΣİK 日本 " * 50_000
    assert lexical_search.term_counts(text) == Counter(t.encode() for t in terms(text))


vectors = st.lists(st.tuples(st.dictionaries(st.integers(0, 11), st.integers(1, 4), max_size=6), st.integers(50, 53)), min_size=1, max_size=60)
asked = st.lists(st.sets(st.integers(0, 11), min_size=1, max_size=5), min_size=1, max_size=4)


@settings(max_examples=60, deadline=None)
@given(vectors, asked, st.integers(1, 5), st.integers(1, 4))
def test_search_equals_scoring_all(docs, items, k, leaf):
    size = np.array([len(d) for d, _ in docs])
    flat = [(t, f) for d, _ in docs for t, f in d.items()]
    number, times = np.array([t for t, _ in flat], dtype=np.int32), np.array([f for _, f in flat], dtype=np.int64)
    df = np.bincount(number, minlength=12)
    rank = np.empty(12, dtype=np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(12)
    weight = np.floor(1000 * np.log((2 * len(docs) + 2) / (2 * df + 1))).astype(np.int64)
    was, lexical_search.LEAF = lexical_search.LEAF, leaf
    try:
        tree = lexical_search.Tree(np.arange(len(docs)), np.array([m for _, m in docs]), size, number, times, rank)
        of_item = np.repeat(np.arange(len(items)), [len(i) for i in items])
        for exact in (True, False):
            found = lexical_search.Items(np.array([t for i in items for t in sorted(i)]), of_item, len(items), weight, k)
            found.exact = exact
            found.search(tree)
            for i, wanted in enumerate(items):
                scores = [sum(int(weight[t]) * (10**9 * d[t] // (1000 * d[t] + 20 * m)) for t in wanted & d.keys()) for d, m in docs]
                best = sorted((-s, place) for place, s in enumerate(scores) if s > 0)[:k]
                assert best == [(-s, d) for s, d in zip(found.scores[i].tolist(), found.ids[i].tolist(), strict=True) if s]
    finally:
        lexical_search.LEAF = was


def test_equal_documents_share_a_path():
    """Copies beyond a leaf, and vectors as long as a recursion would not be."""
    n, width = 500, 3000
    number = np.tile(np.arange(width, dtype=np.int32), n)
    tree = lexical_search.Tree(np.arange(n), np.full(n, 60), np.full(n, width), number, np.ones(n * width, dtype=np.int64), np.arange(width))
    found = lexical_search.Items(np.arange(width), np.zeros(width, dtype=np.int64), 1, np.full(width, 9), 50)
    scored = found.search(tree)
    # All have one score; the bound lets go of subtrees whose keys are larger than those found.
    assert found.ids[0].tolist() == list(range(50)) and scored < n
