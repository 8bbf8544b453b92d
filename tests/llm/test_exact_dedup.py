import hashlib

import pytest

from termloom.llm.exact_dedup import exact_dedup

from .conftest import EDGES


def brute(rows):
    groups = {}
    for key, text in rows:
        groups.setdefault(text or "", []).append(key)
    out = []
    for key, text in rows:
        keys = groups[text or ""]
        largest = max((k for k in keys if k is not None), default=None)
        out.append((key, largest, len(keys), key == largest, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("counters, winners", [(4096, 512), (8, 2)])
def test_against_brute_force(table, counters, winners):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 70}") for i in range(400)] + EDGES
    found = exact_dedup(table(rows), counters=counters, winners=winners).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)


def test_frequent_texts_are_not_shuffled(table):
    """The digest of a third of the rows meets its group where it is read."""
    frame = exact_dedup(table([(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(300)]))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_edges(nothing):
    assert exact_dedup(nothing).collect() == []
