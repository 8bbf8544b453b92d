import re

import pytest
from pyspark.ml.feature import RegexTokenizer, StopWordsRemover
from pyspark.sql import functions as F

from termloom.functions import text
from termloom.functions.stopwords import ENGLISH
from termloom.operators import joins, terms

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


def apply(spark, expression, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("s"))).collect()]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("a<ref name=x/> keep? <ref>cite</ref> b", "a b"),
        ("{{t|{{n}} tail}} z", "tail}} z"),
        ("[[File:a.jpg|thumb|cap [[in]] x]] y", "x y"),
        ("[[foo|bar|baz]] [[qux]] [[p|]]", "bar|baz qux p|"),
        ("see https://a.b/c]] d_e <references/> q", "see d e q"),
        ("{{only a template}}", ""),
        (None, None),
    ],
)
def test_strip_markup(spark, raw, clean):
    assert apply(spark, text.strip_markup, [raw]) == [clean]


@pytest.mark.parametrize(
    "raw, clean",
    [
        (None, ""),
        ("", ""),
        ("[[p|]] x", "x"),
        ("x[[a|[[b]]]]y", "x b y"),
        ("[[a|b|c]] d_e", "b|c d_e"),
        (" a b　", "a b"),
        ("see http://h now", "see now"),
        ("x <ref\nname=a>b</ref>c<br/>d", "x c d"),
    ],
)
def test_strip_markup_v1(spark, raw, clean):
    assert apply(spark, text.strip_markup_v1, [raw]) == [clean]


def test_collapse_links_is_one_scan(spark):
    values = ["[[a]]", "[[a|b]]", "[[a|]]", "[[|]]", "[[]]", "[[a|[[b]]]]", "[[[a]]]", "x [[t|u|v]] y [[w]]"]

    def brute(value):
        def body(match):
            inner = match.group(0)[2:-2]
            return inner.partition("|")[2] if "|" in inner else inner

        return re.sub(r"\[\[[^\]]+\]\]", body, value)

    assert apply(spark, text.collapse_links, values) == [brute(v) for v in values]


def test_stopwords_are_sparks(spark):
    assert ENGLISH == StopWordsRemover.loadDefaultStopWords("english")


def test_tokens_match_the_ml_transformers(spark):
    documents = spark.read.parquet(DOCUMENTS).select("doc_id", "text")
    split = RegexTokenizer(inputCol="text", outputCol="raw", pattern="[^A-Za-z]+", minTokenLength=2)
    expected = StopWordsRemover(inputCol="raw", outputCol="expected").transform(split.transform(documents))
    both = expected.select("expected", text.without_stopwords(text.tokenize(F.col("text"))).alias("tokens"))
    assert both.filter(~F.col("expected").eqNullSafe(F.col("tokens"))).count() == 0


@pytest.fixture
def small(spark):
    rows = [(1, ["dogs", "run", "dogs"]), (2, []), (3, ["cat", "dogs"])]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>")


def by_id(df):
    return {r.doc_id: r.tokens for r in df.collect()}


LEMMAS = {1: ["dog", "run", "dog"], 2: [], 3: ["cat", "dog"]}


def test_lemmas_from_map_and_join(spark, small, monkeypatch):
    lexicon = spark.createDataFrame([("dogs", "dog"), ("dogs", "zog"), ("ran", "run")], "form string, lemma string")
    assert by_id(terms.lemmatized(small, lexicon)) == LEMMAS
    monkeypatch.setattr(terms, "LEXICON_ROWS", 1)
    assert by_id(terms.lemmatized(small, lexicon)) == LEMMAS


def test_stop_table_as_set_and_join(spark, small, monkeypatch):
    table = spark.createDataFrame([("Dogs",), ("run",), ("dogs",)], "word string")
    kept = {1: [], 2: [], 3: ["cat"]}
    assert by_id(terms.without_listed(small, table)) == kept
    monkeypatch.setattr(terms, "STOPWORD_ROWS", 0)
    assert by_id(terms.without_listed(small, table)) == kept


def test_both_forms_agree_on_nulls_and_repeated_keys(spark, monkeypatch):
    rows = [(1, ["dogs", None, "run"]), (1, ["dogs"]), (None, ["ran"]), (2, None), (2, []), (None, None)]
    odd = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    lexicon = spark.createDataFrame([("dogs", "dog"), ("ran", "run"), (None, "x")], "form string, lemma string")
    listed = spark.createDataFrame([("run",), (None,)], "word string")

    def both():
        return [sorted(map(str, f.collect())) for f in (terms.lemmatized(odd, lexicon), terms.without_listed(odd, listed))]

    small = both()
    assert "Row(doc_id=1, tokens=['dog', None, 'run'])" in small[0] and "Row(doc_id=2, tokens=None)" in small[0]
    assert "Row(doc_id=1, tokens=['dogs'])" in small[1] and "Row(doc_id=2, tokens=None)" in small[1]
    monkeypatch.setattr(terms, "LEXICON_ROWS", 1)
    monkeypatch.setattr(terms, "STOPWORD_ROWS", 0)
    assert both() == small


def test_term_counts_explode_once(spark):
    tokens = terms.tokenized(spark.createDataFrame([(1, "b a b"), (2, "a c"), (3, None)], "doc_id long, text string"), stopwords=())
    stats = terms.term_stats(spark.createDataFrame([(1, ["b", "a", "b", None]), (2, ["a"]), (3, None)], "doc_id long, tokens array<string>"))
    assert {tuple(r) for r in stats.collect()} == {("a", 2, 2), ("b", 1, 2)}
    plan = terms.term_stats(tokens)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("Generate") == 1


def test_vocabulary_breaks_ties_by_term(spark, small):
    stats = terms.term_stats(small)
    assert {tuple(r) for r in stats.collect()} == {("dogs", 2, 3), ("run", 1, 1), ("cat", 1, 1)}
    vocab = [tuple(r) for r in terms.vocabulary(stats, 1, 2).orderBy("term_id").collect()]
    assert vocab == [(0, "dogs", 2, 3), (1, "cat", 1, 1)]


@pytest.mark.parametrize("size", [1, 3, 7, 40, 100])
def test_vocabulary_cut_is_exact(spark, size):
    rows = [(f"t{i:02d}", i % 4 + 1, i % 9 + 1) for i in range(60)]
    stats = spark.createDataFrame(rows, "term string, df long, cf long")
    expected = sorted((r for r in rows if r[1] >= 2), key=lambda r: (-r[2], r[0]))[:size]
    found = terms.vocabulary(stats, 2, size).orderBy("term_id").collect()
    assert [(r.term, r.df, r.cf) for r in found] == expected
    assert [r.term_id for r in found] == list(range(len(expected)))


def test_idf_both_ways_and_empty_documents(spark, small):
    vocab = terms.vocabulary(terms.term_stats(small), 1, 10)
    tf = terms.term_frequency(small, terms.vocabulary_terms(vocab))
    assert terms.idf_from_counts(tf) == pytest.approx(terms.idf_from_stats(vocab, 3))
    assert terms.tfidf(tf, terms.idf_from_counts(tf)).count() == 3
    assert terms.entries(tf, "tf").filter("doc_id = 2").count() == 0


def test_empty_vocabulary_is_an_error(spark, small):
    with pytest.raises(ValueError, match="min_df"):
        terms.term_frequency(small, terms.vocabulary_terms(terms.vocabulary(terms.term_stats(small), 9, 10)))


def test_normalize_like_python(spark):
    titles = [" A b\t", " X　", "\n", "q"]
    assert apply(spark, text.normalize_title, titles) == [t.strip().lower() for t in titles]
    queries = ["  Two  words here ", "", "\t", "one"]
    assert apply(spark, text.normalize_query, queries) == [q.strip().lower().split() for q in queries]


@pytest.mark.parametrize("bits", [6, 10, 21])
@pytest.mark.parametrize("min_df", [1, 3, 300])
def test_rare_terms_leave_early(spark, bits, min_df):
    """A filter of any size keeps every frequent term; the larger it is the fewer rare ones pass."""
    rows = [(i, [f"w{j}" for j in range(i % 40 * 20, i % 40 * 20 + 20 + i % 3)] + ["all", None, "all"]) for i in range(400)]
    tokens = spark.createDataFrame([*rows, (400, None), (401, [])], "doc_id long, tokens array<string>").repartition(4)
    want = sorted(map(tuple, terms.term_stats(tokens).where(F.col("df") >= min_df).collect()))
    assert sorted(map(tuple, terms.frequent_term_stats(tokens, min_df, bits).collect())) == want
    rare = terms.surely_rare(tokens, min_df, bits)
    words = terms.term_stats(tokens)
    passed = words.where(~rare(F.col("term"))).count()
    assert passed >= len(want)
    if bits == 21:
        assert passed <= len(want) + 2 or min_df > 255
    assert terms.frequent_term_stats(tokens.where("false"), 2, bits).collect() == []


def test_listed_tokens_hold_every_listed_one_and_few_others(spark):
    rows = spark.read.parquet(DOCUMENTS).select(F.col("doc_id").alias("_row"), text.tokenize(F.col("text")).alias("tokens"))
    every = terms.numbered(rows, "tokens", "token", "_row")
    words = every.select("token").distinct().where("xxhash64(token) % 20 = 0")
    listed = every.join(words, "token", "left_semi")
    hits = terms.listed_tokens(rows, words)
    assert listed.select("_row", "pos", "token").exceptAll(hits).isEmpty()
    assert hits.exceptAll(every.select("_row", "pos", "token")).isEmpty()
    assert listed.count() <= hits.count() < every.count() / 4


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_is_the_join(spark, how):
    keys = ["hot"] * 300 + [f"k{i}" for i in range(60)] + [None, "", "x" * 300] * 3
    rows = spark.createDataFrame(list(enumerate(keys)), "i int, token string")
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), ("x" * 300, 3), ("absent", 4)], "token string, v int")
    same = [sorted(map(str, f.collect())) for f in (rows.join(lookup, "token", how), joins.split_join(rows, lookup, "token", how))]
    assert same[0] == same[1] and same[0]
    assert joins.split_join(rows.limit(0), lookup, "token", how).count() == 0


def test_frequent_keys_are_not_shuffled(spark):
    rows = spark.range(1000).selectExpr("case when id % 3 = 0 then 'hot' else string(id) end as token", "id")
    lookup = spark.range(100).selectExpr("string(id) as token", "id as v")
    assert "hot" in joins.frequent_keys(rows, "token")
    plan = joins.split_join(rows, lookup, "token")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan or "strategy=broadcast" in plan


@pytest.mark.parametrize(
    "form, lemma",
    [
        ("dogs", "dog"), ("glasses", "glass"), ("wolves", "wolf"), ("boxes", "box"), ("churches", "church"), ("dishes", "dish"),
        ("firemen", "fireman"), ("cities", "city"), ("cats", None), ("dog", None), ("s", None), ("", None), ("axes", "ax"), ("mice", None),
    ],
)
def test_detached_lemmas(spark, form, lemma):
    bases = ["dog", "glass", "wolf", "box", "church", "dish", "fireman", "city", "axe", "ax"]
    lexicon = spark.createDataFrame([(b, b) for b in bases] + [("mice", "mouse"), (None, "x")], "form string, lemma string")
    forms = spark.createDataFrame([(form,), (form,), (None,)], "form string")
    found = [r.lemma for r in terms.detached_lemmas(forms, lexicon).collect()]
    assert found == ([lemma] if lemma else [])


def test_frequent_listed_words_change_in_place(spark, monkeypatch):
    """Only the tokens of words that are not frequent are moved; a lemma that is a form too is not looked up again."""
    moved, changed = [], terms._changed

    def counted(rows, changes):
        moved.append(changes.count())
        return changed(rows, changes)

    monkeypatch.setattr(terms, "_changed", counted)
    monkeypatch.setattr(joins, "FREQUENT_KEYS", 1)
    rows = [(1, ["a", "b", None, "a", "c"]), (2, None), (3, []), (4, ["c", "a", "a", "d"]), (4, ["a"] * 20), (None, ["x", "b"])]
    df = spark.createDataFrame(rows, "doc_id int, tokens array<string>")

    def found(frame):
        return sorted(map(str, ((r.doc_id, r.tokens) for r in frame.collect())))

    listed = spark.createDataFrame([("A",), ("b",), ("b",), (None,), ("zz",)], "word string")
    without = [(i, t and [w for w in t if w is not None and w not in ("a", "b")]) for i, t in rows]
    assert found(terms.without_listed(df, listed, most_rows=0)) == sorted(map(str, without))
    lexicon = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "e"), ("d", None)], "form string, lemma string")
    lemmas = [(i, t and [{"a": "b", "b": "c"}.get(w, w) for w in t]) for i, t in rows]
    assert found(terms.lemmatized(df, lexicon, most_rows=0)) == sorted(map(str, lemmas))
    assert moved == [2, 2]


def test_term_stats_count_slices_before_the_shuffle(spark):
    """Tasks count by slices of documents, not one row per token; nulls, empty and repeated documents."""
    rows = [(["a", "b", None, "a"],), (None,), ([],), ([None],), (["b"],), (["b"],), (["", "ä"],)] + [(["a", "z"] * 3,)] * 2000
    tokens = spark.createDataFrame(rows, "tokens array<string>").repartition(2)
    found = terms.term_stats(tokens)
    assert sorted(map(tuple, found.collect())) == [("", 1, 1), ("a", 2001, 6002), ("b", 3, 3), ("z", 2000, 6000), ("ä", 1, 1)]
    assert terms.term_stats(tokens.where("false")).collect() == []
    slices = found._jdf.queryExecution().optimizedPlan().toString()
    assert slices.count("MapInArrow") == 1 and slices.index("Generate") < slices.index("MapInArrow")
