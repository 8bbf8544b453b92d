import re
from collections import Counter

import corpus_pipeline
from tests.llm.test_jaccard_join import grams
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_substring_dedup import brute as brute_passages

SF_DIR = "/root/testdata/sf0.001"


def test_every_stage_on_its_own_input(spark):
    """Each stage against brute force over what the one before kept."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.stored(stage(spark, docs, SF_DIR), name)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        rows = docs.collect()
        after = {r["doc_id"]: r["text"] for r in rows}
        assert len(rows) == len(after) and all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
            right = [(k in after) == bool(labels[k]) for k in before if k in labels]
            assert sum(right) / len(right) > 0.9
            assert all(before[k] == t for k, t in after.items())
        elif name == "line_dedup":
            want = {k: kept for k, _, gone, kept, _ in brute_lines(sorted(before.items()), 2, 20) if kept.strip() or not gone}
            assert after == want
        elif name == "jaccard_join":
            sets = {k: grams(t, 5) for k, t in before.items()}
            for k in before.keys() - after.keys():
                assert any(before[k] == before[o] or 5 * len(sets[k] & sets[o]) >= 4 * len(sets[k] | sets[o]) for o in before if o != k)
            assert all(before[k] == t for k, t in after.items())
        else:
            for k, words, gone, kept in brute_passages(sorted(before.items()), 35):
                assert (k in after) == (gone == 0 or gone < words)
                assert k not in after or after[k] == (kept if gone else before[k])
    bins = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    covered = Counter()
    for r in bins:
        covered[r["doc_id"]] += r["n_words"]
    assert covered == {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in after.items()}


#: Keys that each stage keeps of the odd rows; the two texts of 30,000 words give 15 pieces each.
ODD = {
    "quality": [1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10, None, None],
    "line_dedup": [1, 2, 3, 4, 6, 8, 10, None],
    "jaccard_join": [1, 3, 4, 6, 8, 9, 10],
    "substring_dedup": [1, 2, 3, 4, 5, 5, 8, 9, None, None],
    "packing": [1, 2, 3, 4, 5, 5, *[6] * 15, *[7] * 15, 8, 9, 10, None, None],
}


def test_run_and_odd_documents(spark, edges):
    found = corpus_pipeline.run(spark, SF_DIR)
    assert found.count() > 0
    docs = edges.select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        kept = [r["doc_id"] for r in stage(spark, docs, SF_DIR).collect()]
        assert sorted(kept, key=lambda k: (k is None, k)) == ODD[name], name
        assert stage(spark, docs.where("false"), SF_DIR).count() == 0, name
