import random

import pytest
from pyspark.sql import functions as F

from termloom.llm import line_dedup

from .conftest import EDGES


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def varied(rng, text, most):
    out = list(text)
    for _ in range(rng.randint(0, most)):
        at, kind = rng.randint(0, len(out)), rng.random()
        if kind < 0.4:
            out[at:at] = rng.choice("abé")
        elif at < len(out):
            out[at : at + 1] = rng.choice("abé") if kind < 0.7 else ""
    return "".join(out)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_distance_and_signatures(spark, most):
    rng = random.Random(most)
    pairs = []
    for _ in range(700):
        a = "".join(rng.choice("abé🎉") for _ in range(rng.randint(0, 14)))
        pairs.append((a, varied(rng, a, most + 1)))
    frame = spark.createDataFrame(pairs, "a string, b string")
    found = frame.select("a", "b", line_dedup.edit_distance(F.col("a"), F.col("b"), most).alias("d")).collect()
    texts = sorted({t for pair in pairs for t in pair})
    lines = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "line long, body string, size int")
    keys = {t: (set(), set()) for t in texts}
    for r in line_dedup.signatures(lines, most).collect():
        keys[texts[r["line"]]][0].add(r["key"])
        if r["indexed"]:
            keys[texts[r["line"]]][1].add(r["key"])
    for a, b, d in found:
        true = edits(a, b)
        assert (d == true) if true <= most else d > most
        if true <= most and min(len(a), len(b)) > most:
            assert keys[a][0] & keys[b][1] or keys[b][0] & keys[a][1]


def test_distance_of_very_long_lines(spark):
    text = "ab" * 2_200_000
    half = text[:2_300_000]
    pairs = [
        (half, half[:2_200_000] + "x" + half[2_200_001:2_200_050] + "y" + half[2_200_051:], 2),
        (text, text[:2_200_000] + "x" + text[2_200_000:], 1),
        (half, "xyz" + half[3:], 3),
    ]
    for a, b, true in pairs:
        frame = spark.createDataFrame([(a, b)], "a string, b string")
        assert frame.select(line_dedup.edit_distance(F.col("a"), F.col("b"), 2)).first()[0] == true


def brute(rows, most, least):
    spots, first = [], {}
    for key, text in rows:
        for at, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\n\x0b\f\r"):
                spot = (2**63 - 1 if key is None else key, at)
                spots.append((spot, line))
                first[line] = min(first.get(line, spot), spot)
    lines = sorted(first)
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= most and edits(a, b) <= most:
                root[find(a)] = find(b)
    stays = {}
    for x in lines:
        stays[find(x)] = min(stays.get(find(x), first[x]), first[x])
    out = []
    for key, text in rows:
        kept, owners = [], set()
        parts = (text or "").split("\n")
        for at, line in enumerate(parts):
            spot = (2**63 - 1 if key is None else key, at)
            home = stays[find(line)] if line in root else spot
            if home == spot:
                kept.append(line)
            else:
                owners.add(home[0])
        out.append((key, len(parts), len(parts) - len(kept), "\n".join(kept), sorted(owners - {2**63 - 1})))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [500, 3])
def test_against_brute_force(table, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_COUNT", hot)
    rng = random.Random(7)
    stems = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(6, 25))) for _ in range(25)]
    rows = [(i, "\n".join(varied(rng, rng.choice(stems), 3) for _ in range(rng.randint(0, 8)))) for i in range(120)]
    rows += [(200 + i, stems[0]) for i in range(30)] + [r for r in EDGES if r[0] and r[0] not in (5,)]
    found = line_dedup.line_dedup(table(rows), edits=2, min_chars=8).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows, 2, 8)


def test_edges(edges, nothing):
    found = line_dedup.line_dedup(edges, carry=("source",))
    assert found.columns == ["doc_id", "n_lines", "n_removed", "kept", "kept_in", "rest"]
    rows = {(r["doc_id"], r["kept"]) for r in found.collect()}
    assert found.count() == len(EDGES)
    assert {(4, "one"), (5, ""), (9, ""), (7, ""), (1, ""), (3, " \n\t "), (None, "")} <= rows
    assert line_dedup.line_dedup(nothing).collect() == []
