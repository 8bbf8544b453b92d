import random
from collections import defaultdict

from termloom.llm import packing

from .conftest import EDGES


def plain(pieces, capacity):
    """The same choice by looking at every bin."""
    bins, chosen = [], []
    for size, source, cluster in pieces:
        fits = [
            (free, i) for i, (free, sources, clusters) in enumerate(bins)
            if free >= size and (source < 0 or source not in sources) and (cluster < 0 or cluster not in clusters)
        ]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append([capacity, set(), set()])
        bins[i][0] -= size
        bins[i][1].add(source)
        bins[i][2].add(cluster)
        chosen.append(i)
    return chosen, [b[0] for b in bins]


def test_tightest_compatible_bin():
    rng = random.Random(3)
    for _ in range(60):
        pieces = [(rng.randint(0, 20), rng.randint(-1, 5), rng.randint(-1, 9)) for _ in range(rng.randint(0, 120))]
        assert packing.pack(pieces, 20) == plain(pieces, 20)


def test_rows(table):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(0, 90)), f"s{rng.randint(0, 3)}") for i in range(300)] + [(500 + i, t, "s0") for i, (_, t) in enumerate(EDGES)]
    found = packing.best_fit_packing(table(rows), capacity=64, shard_rows=100).collect()
    texts = {r[0]: r for r in rows}
    bins, covered = defaultdict(list), defaultdict(int)
    for r in found:
        bins[r["shard"], r["bin"]].append(r)
        assert r["first_word"] == 64 * r["piece"]
        covered[r["doc_id"]] += r["n_words"]
    assert covered == {k: len((t or "").split()) for k, t, _ in rows}
    for members in bins.values():
        used = sum(r["n_words"] for r in members)
        assert used <= 64 and {r["free_words"] for r in members} == {64 - used}
        sources = [texts[r["doc_id"]][2] for r in members]
        assert len(sources) == len(set(sources))
        filled = [texts[r["doc_id"]][1] for r in members if r["n_words"]]
        assert len(filled) == len(set(filled))


def test_edges(edges, nothing):
    found = packing.best_fit_packing(edges).collect()
    assert sum(r["piece"] == 0 for r in found) == len(EDGES)
    assert sum(r["n_words"] for r in found if r["doc_id"] == 6) == 30_000
    assert packing.best_fit_packing(nothing).collect() == []
