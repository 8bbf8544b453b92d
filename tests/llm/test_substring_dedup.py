import random
import re
from collections import Counter

import numpy as np
import pytest

from termloom.llm import substring_dedup as sub
from termloom.llm.fm_index import FMIndex, matching_statistics

from .conftest import EDGES


def brute(rows, width):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    seen = Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    out = []
    for (key, _), w in zip(rows, texts, strict=True):
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((key, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [10**9, 2])
@pytest.mark.parametrize("width, gram", [(6, 3), (35, 8)])
def test_against_brute_force(table, monkeypatch, width, gram, hot):
    monkeypatch.setattr(sub, "HOT_RUNS", hot)
    rng = random.Random(width)
    passages = [[rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(rng.randint(width - 2, 3 * width))] for _ in range(12)]
    rows = []
    for i in range(150):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 2 * width))]
            part = rng.choice(passages)
            text += part[rng.randint(0, 3) : len(part) - rng.randint(0, 3)]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(text)))
    rows += [(300, "x " * 3 * width), (301, "p q " * width), *EDGES]
    found = sub.substring_dedup(table(rows), width=width, gram=gram).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows, width)


def test_edges(edges, nothing):
    as_is = {(r["doc_id"], r["kept"]) for r in sub.substring_dedup(edges, carry=("source",), as_is=True).collect()}
    assert (3, " \n\t ") in as_is and (8, EDGES[10][1]) in as_is and (6, "") in as_is
    assert sub.substring_dedup(nothing).collect() == []


def test_matching_statistics():
    rng = np.random.default_rng(0)
    for trial in range(12):
        parts = [rng.integers(1, 4 if trial % 2 else 30, rng.integers(1, 40)) for _ in range(30)]
        parts += [np.concatenate([rng.integers(1, 30, 3), parts[k][:20]]) for k in range(8)]
        text = np.concatenate([*(np.concatenate(([0], p)) for p in parts), [0]])
        edges = np.flatnonzero(text == 0)
        found = matching_statistics(FMIndex(text), text, edges[:-1] + 1, edges[1:])
        seen = Counter(tuple(p[i:j]) for p in parts for i in range(len(p)) for j in range(i + 1, len(p) + 1))
        for start, p in zip(edges[:-1] + 1, parts, strict=True):
            for i in range(len(p)):
                assert found[start + i] == max([j - i for j in range(i + 1, len(p) + 1) if seen[tuple(p[i:j])] > 1], default=0)
