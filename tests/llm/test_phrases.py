import random
import re
from collections import Counter, defaultdict

import pytest

from termloom.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, at_least, longest=5, share=100, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if a >= at_least}
        found, over = [], Counter()
        for q, b in kept.items():
            for sub in {q[i : i + size] for size in range(2, len(q)) for i in range(len(q) - size + 1)}:
                over[sub] = max(over[sub], b)
        for p, a in kept.items():
            if len(p) < 2 or over[p] and 100 * over[p] >= share * a:
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mine(df, **options):
    found = phrases.collocations(df, **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in found.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = "a b c d e de la Größe 日本 x\x00y A the The".split()
    made = [
        ("".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\r\n", "!? "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None, "und"]))
        for _ in range(120)
    ]
    return made + [("one two three four five six. ", "en")] * 30 + [(None, "en"), ("", None), ("a", "de"), ("x " * 3000, "xx"), (" .,; ", "zz")]


@pytest.mark.parametrize("options", [{"at_least": 5}, {"at_least": 3, "longest": 3, "top": 7}, {"at_least": 4, "share": 60}])
def test_equals_brute_force(spark, rows, options):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    want = brute(rows, **options)
    assert want and mine(df, **options) == want


def test_bounds_change_nothing(spark, rows, monkeypatch):
    """Spills, bursts and new numberings give the same counts; here within one task's trie."""
    want, wanted = None, Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            wanted.update((lang or "und", " ".join(words[i : i + 3])) for i in range(len(words) - 2))
    import pyarrow as pa

    for entries, burst, numbered in ((600_000, 8192, 1_000_000), (40, 4, 1_000_000), (40, 1, 10)):
        monkeypatch.setattr(phrases, "BURST", burst)
        trie, got, batches = phrases.HatTrie(3, 5), Counter(), []
        for at in range(0, len(rows), 7):
            some = rows[at : at + 7]
            phrases._count(phrases.Tokens(pa.array([r[0] for r in some], pa.string()), pa.array([r[1] for r in some], pa.string())), trie, None)
            if trie.entries > entries or len(trie.words) > numbered:
                batches += trie.spill(entries // 2 if len(trie.words) <= numbered else 0)
        batches += trie.spill(0)
        assert trie.entries == 0
        place = {}
        for row in (pa.Table.from_batches([b]).slice(i, 1) for b in batches for i in range(b.num_rows)):
            run = phrases.unpacked(row)
            assert run["phrase"].to_pylist() == sorted(run["phrase"].to_pylist(), key=str.encode)
            for lang, phrase, f in zip(*(c.to_pylist() for c in run.columns), strict=True):
                got[lang, phrase] += f
                assert place.setdefault((lang, phrase), row["prefix"][0]) == row["prefix"][0]
        assert got == wanted
        want = want or got
        assert got == want


def test_odd_rows(edges, nothing):
    found = mine(edges, at_least=2)
    texts = [(r["text"], r["lang"]) for r in edges.select("text", "lang").collect()]
    assert found == brute(texts, 2)
    assert mine(nothing) == []


def test_exact_beyond_64_bits(spark):
    """1000 * a * n and l * r leave 64 bits."""
    big = 3_000_000_019
    df = spark.createDataFrame([(big, big * 7, big + 1, big + 3)], "a long, n long, l long, r long")
    wide = [f"cast({c} as decimal(19, 0))" for c in "anlr"]
    score = df.selectExpr(f"cast((1000BD * {wide[0]} * {wide[1]}) div ({wide[2]} * {wide[3]}) as bigint) s").first()["s"]
    assert score == 1000 * big * big * 7 // ((big + 1) * (big + 3))
