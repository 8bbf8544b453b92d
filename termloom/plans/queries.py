"""Every operator as a query over the given tables: name -> (spark, sf_dir) -> DataFrame.

Vectors come from `embeddings`, texts from `documents`. Page rows are `documents` with markup
around their whole text. Where a check needs known factors, V is the fixed cos((i+1)(j+1)) over
the vocabulary of `documents`.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import text, vectors
from termloom.operators import articles, block_svd, clusters, lsa, pruned_search, search, terms, title_index
from termloom.plans import lsa_job
from termloom.settings import scratch_path, stored
from termloom.sources import artifacts, pages

MIN_DF = 5
VOCAB_SIZE = 80_000
SMALL_VOCABULARY = 500
SAMPLE_CANDIDATES = 300
LLOYD_STEPS = 6
SWEEP_GIVEN = (2, 3, 5, 8)
SAMPLED_POINTS = 12
FIXED_RANK = 8
RANK = 20
TOP_TERMS = 10
PAGE_CAP = 500
ODD_TEXT = "</page> <page> <!-- "
SAMPLE_FRACTION = 0.3
FIT_FRACTION = 0.5
COMMON_SHARE = 0.2
TERM_QUERY = "unseen V7 v9"
DOC_QUERY = "The de ci"
TITLE_WORDS = 8
TITLE_QUERIES = (" The ", "de l", "tion", "no such title", "la", "page 1")
SEEDS = (*search.SEED_TERMS, "de", "que", "der")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, sf_dir):
    return articles.spread_scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _pages(spark, sf_dir):
    """documents as page rows with markup; attributes decide namespace, redirect and title."""
    name = F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))
    raw_text = F.concat(
        F.lit("{{Infobox|name="), name, F.lit("}}[[File:pic_1.jpg|thumb|a picture]]See [[Main page|the main page]], [["),
        name, F.lit('|]] and [[Talk_page]]<ref name="r">cited '), name, F.lit("</ref> https://example.org/"),
        F.col("doc_id").cast("string"), F.lit("?x=1 <b>"), F.col("text"), F.lit("</b> [[Category:"), F.col("lang"),
        F.lit("]]"),
    )
    source = F.col("source")
    rows = articles.spread_scan(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return rows.select(
        "doc_id",
        F.when(source == "src3", F.concat(name, F.lit(" (Disambiguation)"))).otherwise(name).alias("title"),
        F.when(source.isin("src5", "src9"), 1).otherwise(0).alias("ns"),
        F.when(source == "src11", F.struct(F.lit("Main page").alias("_title"))).alias("redirect"),
        raw_text.alias("raw_text"),
    )


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select(
        "vec_id", vectors.as_doubles(F.col("embedding")).alias("embedding"), "label"
    )


def _points(spark, sf_dir):
    return _vectors(spark, sf_dir).withColumnRenamed("embedding", "features")


def _vector_terms(spark, sf_dir):
    return _vectors(spark, sf_dir).select(
        F.col("vec_id").alias("term_id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("term"), "embedding"
    )


def _vector_docs(spark, sf_dir):
    return _vectors(spark, sf_dir).select(
        F.col("vec_id").alias("doc_id"),
        F.concat(F.lit(" Label "), F.col("label").cast("string")).alias("title"),
        "embedding",
    )


def _tokens(spark, sf_dir):
    return terms.tokenized(_documents(spark, sf_dir))


def _fit_vocabulary(token_rows):
    """Vocabulary of stored tokens; the statistics read them twice."""
    stats = stored(terms.term_stats(token_rows), "term_stats")
    return terms.vocabulary(stats, MIN_DF, VOCAB_SIZE)


def vocabulary_pruned(spark, sf_dir):
    """The vocabulary from statistics that rare terms have left before the shuffle; a filter so small that it errs."""
    token_rows = stored(_tokens(spark, sf_dir), "tokens")
    stats = stored(terms.frequent_term_stats(token_rows, MIN_DF, bits=16), "term_stats")
    return terms.vocabulary(stats, MIN_DF, VOCAB_SIZE)


def _vocabulary(spark, sf_dir):
    return _fit_vocabulary(stored(_tokens(spark, sf_dir), "tokens"))


def _tf(spark, sf_dir):
    token_rows = stored(_tokens(spark, sf_dir), "tokens")
    vocab = stored(_fit_vocabulary(token_rows), "vocabulary")
    return vocab, terms.term_frequency(token_rows, terms.vocabulary_terms(vocab))


def _features(spark, sf_dir):
    vocab, tf = _tf(spark, sf_dir)
    return vocab, terms.tfidf(tf, terms.idf_from_stats(vocab, _table(spark, sf_dir, "documents").count()))


def _fixed_v(vocab):
    i = F.col("term_id").cast("double") + 1
    return vocab.select("term_id", "term", F.array(*[F.cos(i * (j + 1)) for j in range(FIXED_RANK)]).alias("v"))


_FIXED_S = [float(FIXED_RANK - j) for j in range(FIXED_RANK)]


def _fixed_terms(vocab):
    return lsa.scaled_terms(_fixed_v(vocab), _FIXED_S)


def _fixed_topics(vocab):
    spark = vocab.sparkSession
    s = artifacts.literal_table(spark, list(enumerate(_FIXED_S)), "topic int, singular_value double")
    return lsa.topics(_fixed_v(vocab), s)


@lru_cache(maxsize=8)
def _fitted(app_id: str, spark: SparkSession, sf_dir: str) -> lsa_job.LsaModel:
    tokens = stored(_tokens(spark, sf_dir), "tokens")
    return lsa_job.fit(tokens, RANK, MIN_DF, VOCAB_SIZE)


def _model(spark, sf_dir):
    return _fitted(spark.sparkContext.applicationId, spark, sf_dir)


def _cells(df, array, *keys, name="value"):
    """An array column as rows (keys, pos, value), rounded for comparison."""
    return terms.numbered(df, array, "_x", *keys).select(
        *keys, "pos", F.round("_x", 6).alias(name)
    )


def _ranked(df, *keys):
    return df.select(*keys, F.round("score", 6).alias("score"))


# --- pages -------------------------------------------------------------------------------


def _page_columns(rows):
    return rows.select("title", "ns", F.col("redirect._title").alias("redirect_to"), "raw_text")


def _written_pages(spark, sf_dir):
    path = scratch_path(spark, "pages_xml")
    pages.write_pages(_pages(spark, sf_dir).drop("doc_id"), path)
    return path


def xml_pages_roundtrip(spark, sf_dir):
    return _page_columns(pages.read_pages(spark, _written_pages(spark, sf_dir)))


def xml_pages_by_file(spark, sf_dir):
    """One task a file."""
    return _page_columns(pages.read_pages(spark, _written_pages(spark, sf_dir), by_record=False))


def xml_pages_by_record(spark, sf_dir):
    """The scan in many tasks, with every file cut into records."""
    return _page_columns(pages.read_pages_by_record(spark, _written_pages(spark, sf_dir)))


def xml_pages_inferred(spark, sf_dir):
    return _page_columns(pages.read_pages_inferred(spark, _written_pages(spark, sf_dir)))


def _odd_markup(spark, sf_dir) -> str:
    """documents as a dump with pages in comments, tags in CDATA sections and other markup that is not what it looks like."""
    text = F.col("text")
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    name = F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))
    page = F.concat(
        F.lit("<!-- <page><title>Draft of "), name, F.lit("</title></page> -->\n<page kind='a>b'>\n<title>"), name,
        F.lit("</title><ns>0</ns><?note </page> ?><revision><text bytes='1'><![CDATA[" + ODD_TEXT + "]]>"), text,
        F.lit("</text></revision></page >"),
    )
    path = scratch_path(spark, "odd_xml")
    _documents(spark, sf_dir).where(F.col("text").isNotNull()).select(page.alias("value")).write.text(path)
    return path


def xml_pages_odd_markup(spark, sf_dir):
    """The split scan where most closing row tags are none."""
    return _page_columns(pages.read_pages(spark, _odd_markup(spark, sf_dir)))


def xml_pages_inferred_by_file(spark, sf_dir):
    """One task a file, for inference and scan."""
    return _page_columns(pages.read_pages_inferred(spark, _written_pages(spark, sf_dir), by_record=False))


def articles_filter(spark, sf_dir):
    return articles.articles(_pages(spark, sf_dir)).select("doc_id", "title", "raw_text")


def article_text_nonempty(spark, sf_dir):
    kept = articles.article_text(articles.articles(_pages(spark, sf_dir)))
    return kept.select("doc_id", "title", "text")


def page_limit(spark, sf_dir):
    return articles.cap_rows(_pages(spark, sf_dir), PAGE_CAP, "doc_id").select("doc_id", "title", "ns")


def page_hash_sample(spark, sf_dir):
    return articles.sample_by_key(_pages(spark, sf_dir), "doc_id", SAMPLE_FRACTION).select("doc_id", "title")


def page_sample(spark, sf_dir):
    return articles.sample_rows(_pages(spark, sf_dir), SAMPLE_FRACTION).select("doc_id", "title")


def vocab_fit_sample(spark, sf_dir):
    rows = articles.sample_by_key(_documents(spark, sf_dir), "doc_id", FIT_FRACTION)
    return _fit_vocabulary(stored(terms.tokenized(rows), "tokens"))


def clean_markup(spark, sf_dir):
    return _pages(spark, sf_dir).select("doc_id", text.strip_markup(F.col("raw_text")).alias("text"))


def clean_markup_html(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.strip_markup(F.col("html")).alias("text"))


def clean_markup_v1(spark, sf_dir):
    return _pages(spark, sf_dir).select("doc_id", text.strip_markup_v1(F.col("raw_text")).alias("text"))


def collapse_links(spark, sf_dir):
    return _pages(spark, sf_dir).select("doc_id", text.collapse_links(F.col("raw_text")).alias("text"))


# --- tokens and term statistics ----------------------------------------------------------


def _token_rows(df):
    return terms.numbered(df, "tokens", "token", "doc_id")


def tokens(spark, sf_dir):
    return _token_rows(terms.tokenized(_documents(spark, sf_dir), stopwords=()))


def tokens_no_stopwords(spark, sf_dir):
    return _token_rows(_tokens(spark, sf_dir))


def _without_common(spark, sf_dir, **bound):
    """Own list: the terms that more than a fifth of the documents use."""
    all_tokens = terms.tokenized(_documents(spark, sf_dir), stopwords=())
    documents = _table(spark, sf_dir, "documents").agg(F.count("*")).scalar()
    common = terms.term_stats(all_tokens).filter(F.col("df") > COMMON_SHARE * documents)
    return _token_rows(terms.without_listed(all_tokens, common.select(F.col("term").alias("word")), **bound))


def tokens_custom_stopwords(spark, sf_dir):
    return _without_common(spark, sf_dir)


def tokens_custom_stopwords_join(spark, sf_dir):
    """The same for a list beyond the bound of a literal set."""
    return _without_common(spark, sf_dir, most_rows=0)


def _forms(token_rows):
    return terms.numbered(token_rows, "tokens", "form").select("form").distinct()


def _suffix_lexicon(spark, sf_dir):
    plural = F.col("form").endswith("s") & (F.length("form") >= 4)
    found = _forms(_tokens(spark, sf_dir)).filter(plural)
    return found.select("form", F.regexp_replace("form", "s$", "").alias("lemma"))


def lemmas(spark, sf_dir):
    return _token_rows(terms.lemmatized(_tokens(spark, sf_dir), _suffix_lexicon(spark, sf_dir)))


def lemmas_join(spark, sf_dir):
    """The same for a lexicon beyond the broadcast bound."""
    return _token_rows(terms.lemmatized(_tokens(spark, sf_dir), _suffix_lexicon(spark, sf_dir), most_rows=0))


def lemmas_detached(spark, sf_dir):
    """Lemmas by endings: the terms that do not end in s are the bases."""
    token_rows = stored(_tokens(spark, sf_dir), "tokens")
    forms = stored(_forms(token_rows), "forms")
    bases = forms.where(~F.col("form").endswith("s")).select("form", F.col("form").alias("lemma"))
    return _token_rows(terms.lemmatized(token_rows, terms.detached_lemmas(forms, bases)))


def normalize_title(spark, sf_dir):
    padded = F.concat(F.lit(" \t"), F.upper("source"), F.lit(" Doc "), F.col("doc_id").cast("string"), F.lit(" \n"))
    return _table(spark, sf_dir, "documents").select("doc_id", text.normalize_title(padded).alias("title"))


def normalize_query(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    worded = turns.select("conv_id", "turn", text.normalize_query(F.col("text")).alias("words"))
    return terms.numbered(worded, "words", "word", "conv_id", "turn")


def term_stats(spark, sf_dir):
    return terms.term_stats(_tokens(spark, sf_dir))


def vocabulary_cut(spark, sf_dir):
    """A vocabulary that the size limit cuts."""
    stats = terms.term_stats(_tokens(spark, sf_dir))
    return terms.vocabulary(stored(stats, "term_stats"), MIN_DF, SMALL_VOCABULARY)


def vocabulary(spark, sf_dir):
    return _vocabulary(spark, sf_dir)


def term_frequency(spark, sf_dir):
    _, tf = _tf(spark, sf_dir)
    return terms.entries(tf, "tf", "tf").withColumn("tf", F.col("tf").cast("bigint"))


def idf(spark, sf_dir):
    """Weights counted over the whole corpus by the pass a sampled vocabulary needs."""
    vocab, tf = _tf(spark, sf_dir)
    weights = list(enumerate(terms.idf_from_counts(tf)))
    rows = artifacts.literal_table(spark, weights, "term_id int, idf double")
    return vocab.join(rows, "term_id").select("term_id", "term", F.round("idf", 6).alias("idf"))


def tfidf(spark, sf_dir):
    _, features = _features(spark, sf_dir)
    return terms.entries(features, "features", "tfidf").withColumn("tfidf", F.round("tfidf", 6))


def top_tfidf_terms(spark, sf_dir):
    vocab, features = _features(spark, sf_dir)
    best = terms.top_terms(features, vocab, TOP_TERMS)
    return best.withColumn("tfidf", F.round("tfidf", 6))


# --- latent semantic analysis ------------------------------------------------------------


def _topic_rows(topic_table):
    return topic_table.select(
        "topic", "singular_value", F.posexplode(F.arrays_zip("terms", "weights")).alias("pos", "t")
    ).select("topic", "singular_value", "pos", F.col("t.terms").alias("term"), F.round("t.weights", 6).alias("weight"))


def topics_fixed_v(spark, sf_dir):
    return _topic_rows(_fixed_topics(stored(_vocabulary(spark, sf_dir), "vocabulary")))


def doc_embed_fixed_v(spark, sf_dir):
    vocab, features = _features(spark, sf_dir)
    return _cells(lsa.project_documents(features, _fixed_v(vocab)), "embedding", "doc_id")


def doc_embed_fixed_v_join(spark, sf_dir):
    """The same projection for a V beyond the broadcast bound."""
    vocab, features = _features(spark, sf_dir)
    return _cells(lsa.project_documents(features, _fixed_v(vocab), max_bytes=0), "embedding", "doc_id")


def term_embed_fixed_v(spark, sf_dir):
    return _cells(_fixed_terms(_vocabulary(spark, sf_dir)), "embedding", "term_id", "term")


def topic_strength(spark, sf_dir):
    return lsa.topic_strength(_fixed_topics(stored(_vocabulary(spark, sf_dir), "vocabulary")))


def topic_strength_fitted(spark, sf_dir):
    """The strengths of the topics of a model that is fitted to the vectors."""
    rows, factors = _embedding_factors(spark, sf_dir, 2)
    strengths = lsa.topic_strength(factors.singular_table(spark))
    return strengths.withColumn("singular_value", F.round("singular_value", 4))


def _embedding_factors(spark, sf_dir, rank=None):
    """Factors of the `embeddings` matrix, of full rank if none is given."""
    rows = clusters.with_vector(_points(spark, sf_dir)).select("vec_id", F.col("vector").alias("features"))
    return rows, lsa.truncated_svd(rows, rank or _width(spark, sf_dir))


def _width(spark, sf_dir) -> int:
    return _vectors(spark, sf_dir).select(F.max(F.size("embedding"))).first()[0]


def svd_gram(spark, sf_dir):
    """V S^2 V' at full rank, which is A'A."""
    _, factors = _embedding_factors(spark, sf_dir)
    gram = (factors.v * factors.singular_values**2) @ factors.v.T
    cells = [(i, j, float(g)) for i, row in enumerate(gram) for j, g in enumerate(row)]
    return artifacts.literal_table(spark, cells, "i int, j int, value double").withColumn("value", F.round("value", 6))


def svd_truncated(spark, sf_dir):
    """U S of the two largest singular values: the solver cut at rank 2, then U scaled by S."""
    rows = clusters.with_vector(_points(spark, sf_dir)).select("vec_id", F.col("vector").alias("features"))
    factors = lsa.truncated_svd(rows, 2)
    cells = lsa.scaled_documents(lsa.left_vectors(rows, factors), factors.singular_values.tolist())
    return cells.select(
        "vec_id",
        *[F.round(F.col("embedding")[j], 4).alias(f"us_{j}") for j in range(2)],
        *[F.round(F.lit(float(s)), 4).alias(f"s_{j}") for j, s in enumerate(factors.singular_values)],
    )


def _block_truncated(spark, sf_dir, **bound):
    """A V of the two largest singular values, from the block solver, with V as a table."""
    rows = clusters.with_vector(_points(spark, sf_dir)).select("vec_id", F.col("vector").alias("features"))
    values, v = block_svd.block_svd(rows, 2, _width(spark, sf_dir), **bound)
    return lsa.project_documents(rows, v, **bound).select(
        "vec_id",
        *[F.round(F.col("embedding")[j], 4).alias(f"us_{j}") for j in range(2)],
        *[F.round(F.lit(float(s)), 4).alias(f"s_{j}") for j, s in enumerate(values)],
    )


def svd_block(spark, sf_dir):
    """The block solver where the block is sent to the tasks."""
    return _block_truncated(spark, sf_dir)


def svd_block_join(spark, sf_dir):
    """The block solver, and the projection, for a V beyond the broadcast bound."""
    return _block_truncated(spark, sf_dir, max_bytes=0)


def svd_similar_docs(spark, sf_dir):
    """Search after a full-rank projection A V; the rotation keeps every cosine."""
    rows, factors = _embedding_factors(spark, sf_dir)
    docs = lsa.project_on_factors(rows, factors).select(
        F.col("vec_id").alias("doc_id"), F.col("vec_id").cast("string").alias("title"), "embedding"
    )
    return _ranked(search.similar_docs(docs, 3), "doc_id", "title")


def svd_invariants(spark, sf_dir):
    """Per topic the singular value, the length of A V's column and the length of V's column."""
    model = _model(spark, sf_dir)
    s = model.factors.singular_table(spark)
    of_docs = lsa.column_norms(model.doc_embeddings()).withColumnRenamed("norm", "av_norm")
    of_v = lsa.column_norms(model.term_vectors, "v").withColumnRenamed("norm", "v_norm")
    return s.join(of_docs, "topic").join(of_v, "topic").orderBy("topic")


def topics(spark, sf_dir):
    return _topic_rows(_model(spark, sf_dir).topics())


def doc_embeddings(spark, sf_dir):
    return _model(spark, sf_dir).doc_embeddings()


def doc_embeddings_us(spark, sf_dir):
    return _model(spark, sf_dir).doc_embeddings_us()


def term_embeddings(spark, sf_dir):
    return _model(spark, sf_dir).term_embeddings()


# --- search ------------------------------------------------------------------------------


def vector_norms(spark, sf_dir):
    e, r = F.col("embedding"), F.reverse("embedding")
    return _vectors(spark, sf_dir).select(
        "vec_id",
        F.round(vectors.l2_norm(e), 6).alias("norm"),
        F.round(vectors.l2_norm(e, zero_as_one=True), 6).alias("safe_norm"),
        F.round(vectors.dot(e, r), 6).alias("dot_reversed"),
    )


def cosine_modes(spark, sf_dir):
    """Each vector against its mirror image under the three definitions; label 0 is zeroed."""
    zeroed = F.when(F.col("label") == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    a, b = F.col("a"), F.reverse("embedding")
    return _vectors(spark, sf_dir).withColumn("a", zeroed).select(
        "vec_id", *[F.round(vectors.cosine(a, b, mode), 6).alias(mode) for mode in vectors.COSINE_EPSILON]
    )


def similar_terms(spark, sf_dir):
    return _ranked(search.similar_terms(_vector_terms(spark, sf_dir), TERM_QUERY), "term_id", "term")


def similar_docs(spark, sf_dir):
    return _ranked(search.similar_docs(_vector_docs(spark, sf_dir), 3), "doc_id", "title")


def docs_for_term(spark, sf_dir):
    vocab, features = _features(spark, sf_dir)
    docs = lsa.project_documents(features, _fixed_v(vocab)).withColumn(
        "title", F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    )
    return _ranked(search.docs_for_term(_fixed_terms(vocab), docs, DOC_QUERY), "doc_id", "title")


def _neighbor_rows(samples):
    return samples.select("term", F.posexplode("neighbors").alias("pos", "hit")).select(
        "term", "pos", F.col("hit._1").alias("neighbor"), F.round("hit._2", 6).alias("score")
    )


def neighbor_samples(spark, sf_dir):
    vocab = stored(_vocabulary(spark, sf_dir), "vocabulary")
    return _neighbor_rows(search.neighbor_samples(_fixed_terms(vocab), SEEDS))


def neighbor_samples_cut(spark, sf_dir):
    """Neighbours among the first terms of the vocabulary only."""
    vocab = stored(_vocabulary(spark, sf_dir), "vocabulary")
    return _neighbor_rows(search.neighbor_samples(_fixed_terms(vocab), SEEDS, candidates=SAMPLE_CANDIDATES))


def neighbor_samples_v1(spark, sf_dir):
    vocab = stored(_vocabulary(spark, sf_dir), "vocabulary")
    return _neighbor_rows(search.neighbor_samples(_fixed_terms(vocab), SEEDS, mode=vectors.SAMPLE_V1))


def _all_pairs_search(spark, sf_dir, **sizes):
    table = _vector_terms(spark, sf_dir)
    queries = table.select(F.col("term_id").alias("query_id"), "embedding")
    found = search.batch_nearest(queries, table, "query_id", "term_id", "term", exclude_self=True, **sizes)
    return _ranked(found, "query_id", "rank", "term_id", "term")


def batch_knn(spark, sf_dir):
    return _all_pairs_search(spark, sf_dir)


def batch_knn_blocks(spark, sf_dir):
    """The same search for more queries than may be broadcast."""
    return _all_pairs_search(spark, sf_dir, max_bytes=0, block_rows=512)


def batch_knn_pruned(spark, sf_dir):
    """The same search where bounds from pivots rule blocks out."""
    table = _vector_terms(spark, sf_dir)
    queries = table.select(F.col("term_id").alias("query_id"), "embedding")
    pruned = pruned_search.pruned_nearest(queries, table, "query_id", "term_id", "term", exclude_self=True, block_rows=2048)
    return _ranked(pruned.found, "query_id", "rank", "term_id", "term")


def resolve_title(spark, sf_dir):
    return search.title_candidates(_vector_docs(spark, sf_dir), " LABEL 3 ")


def _document_titles(spark, sf_dir):
    """The first words of every document as its title."""
    first = F.substring_index(F.col("text"), " ", TITLE_WORDS)
    return _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(" "), first, F.lit(" ")).alias("title"))


def resolve_title_index(spark, sf_dir):
    """Several searches of the titles through one index."""
    index = title_index.title_index(_document_titles(spark, sf_dir))
    found = [index.candidates(t).withColumn("query", F.lit(t.strip().lower())) for t in TITLE_QUERIES]
    return reduce(DataFrame.unionByName, found)


def title_status(spark, sf_dir):
    docs = _vector_docs(spark, sf_dir)
    texts = ("label 3", "la", "no such title")
    rows = [search.title_status(docs, t).withColumn("query", F.lit(t)) for t in texts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def select_title(spark, sf_dir):
    first = search.select_title(_vector_docs(spark, sf_dir), "label 3")
    return _cells(first, "embedding", "title", "doc_id")


def first_of_title(spark, sf_dir):
    return _cells(search.first_of_title(_vector_docs(spark, sf_dir)), "embedding", "title", "doc_id")


def seed_semi(spark, sf_dir):
    seeds = artifacts.literal_table(spark, list(enumerate(SEEDS)), "seed_pos int, term string")
    return search.known_seeds(seeds, _vocabulary(spark, sf_dir))


# --- sources and sinks -------------------------------------------------------------------


def json_artifacts_roundtrip(spark, sf_dir):
    """All four result tables written as JSON, read back and laid out as (kind, name, pos, value)."""
    out = scratch_path(spark, "artifacts") + "/"
    vocab, features = _features(spark, sf_dir)
    term_rows = _fixed_terms(vocab)
    docs = lsa.project_documents(features, _fixed_v(vocab)).withColumn(
        "title", F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))
    )
    artifacts.write_topics(_fixed_topics(vocab), out)
    artifacts.write_term_embeddings(term_rows, out)
    artifacts.write_doc_embeddings(docs.select("title", "embedding"), out)
    artifacts.write_neighbors(search.neighbor_samples(term_rows, SEEDS), out)

    def read(kind):
        return artifacts.read_artifact(spark, out, kind)

    def cells(df, kind, label, array):
        return _cells(df.withColumn("kind", F.lit(kind)).withColumn("name", label.cast("string")), array, "kind", "name")

    term_matrix = artifacts.embedding_matrix(read(artifacts.TERMS), "term")
    doc_matrix = artifacts.embedding_matrix(read(artifacts.DOCS), "title")
    return (
        cells(read(artifacts.TOPICS), "topic", F.col("topic"), "weights")
        .unionByName(cells(term_matrix, "term", F.col("term"), "embedding"))
        .unionByName(cells(doc_matrix, "doc", F.col("title"), "embedding"))
        .unionByName(cells(read(artifacts.NEIGHBORS), "neighbor", F.col("term"), "neighbors._2"))
    )


def parquet_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "documents")
    artifacts.write_parquet(_table(spark, sf_dir, "documents"), path)
    return artifacts.read_parquet(spark, path).select("doc_id", "lang", "n_chars", F.md5("text").alias("text_md5"))


def merged_shards(spark, sf_dir):
    """The topic table, the one result small enough for a single file."""
    path = scratch_path(spark, "topics_file")
    artifacts.write_single_file(_fixed_topics(stored(_vocabulary(spark, sf_dir), "vocabulary")), path)
    return _topic_rows(spark.read.schema(artifacts.SCHEMAS[artifacts.TOPICS]).json(path))


def literal_table(spark, sf_dir):
    """Literal seed rows with their corpus counts; 0 for seeds that never occur."""
    seeds = artifacts.literal_table(spark, list(enumerate(SEEDS)), "seed_pos int, term string")
    stats = terms.term_stats(_tokens(spark, sf_dir)).filter(F.col("term").isin(list(SEEDS)))
    zero = F.lit(0).cast("bigint")
    return seeds.join(stats, "term", "left").select(
        "seed_pos", "term", F.coalesce("df", zero).alias("df"), F.coalesce("cf", zero).alias("cf")
    )


def index_range(spark, sf_dir):
    """One id per vocabulary term."""
    return artifacts.index_range(spark, _vocabulary(spark, sf_dir).count())


def list_files(spark, sf_dir):
    return artifacts.list_files(spark, sf_dir)


# --- clusters ----------------------------------------------------------------------------


def dedupe_terms(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select(
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("term"), "vec_id", "embedding"
    )
    return _cells(clusters.last_per_term(rows, "vec_id"), "embedding", "term", "first_seen")


def kmeans_assign(spark, sf_dir):
    points = _points(spark, sf_dir)
    labeled = clusters.assigned(points, clusters.cluster_means(points, "label"))
    return labeled.select("vec_id", "cluster", F.round("distance2", 6).alias("distance2"))


def kmeans_update(spark, sf_dir):
    points = _points(spark, sf_dir)
    labeled = clusters.assigned(points, clusters.cluster_means(points, "label"))
    return _cells(clusters.cluster_means(labeled), "center", "cluster")


def cluster_sizes(spark, sf_dir):
    return clusters.cluster_sizes(_points(spark, sf_dir).withColumnRenamed("label", "cluster"))


def _rounded_scores(scores):
    return scores.withColumn("silhouette", F.round("silhouette", 6))


def silhouette(spark, sf_dir):
    return _rounded_scores(clusters.silhouette(_points(spark, sf_dir), ["label"], "vec_id"))


def silhouette_blocks(spark, sf_dir):
    """The same score for more points than may be broadcast."""
    return _rounded_scores(
        clusters.silhouette(_points(spark, sf_dir), ["label"], "vec_id", max_bytes=0, block_rows=512)
    )


def silhouette_squared(spark, sf_dir):
    scores = clusters.silhouette(_points(spark, sf_dir), ["label"], "vec_id", clusters.SQUARED_EUCLIDEAN)
    return _rounded_scores(scores)


def _modulus_scores(spark, sf_dir):
    """Silhouettes of the labelings vec_id mod k, k = 2..14, from one pass over the distances."""
    points = _points(spark, sf_dir).select(
        "*", *[F.pmod("vec_id", F.lit(k)).alias(f"k{k}") for k in clusters.SWEEP]
    )
    scores = clusters.silhouette(points, [f"k{k}" for k in clusters.SWEEP], "vec_id")
    return scores.select(F.substring("labeling", 2, 9).cast("int").alias("k"), "silhouette")


def silhouette_labelings(spark, sf_dir):
    return _rounded_scores(_modulus_scores(spark, sf_dir))


def silhouette_sampled(spark, sf_dir):
    """Estimates from some points of each cluster, for the labels and for vec_id mod 3."""
    points = _points(spark, sf_dir).withColumn("third", F.pmod("vec_id", F.lit(3)))
    found = clusters.sampled_silhouette(points, ["label", "third"], "vec_id", SAMPLED_POINTS)
    return _rounded_scores(found).withColumn("standard_error", F.round("standard_error", 6))


def pick_k(spark, sf_dir):
    scores = _modulus_scores(spark, sf_dir)
    best = clusters.pick_k(scores, "argmax").withColumn("mode", F.lit("argmax"))
    return best.unionByName(clusters.pick_k(scores).withColumn("mode", F.lit("fixed")))


def normalize_rows(spark, sf_dir):
    return _cells(clusters.normalized(_points(spark, sf_dir)), "features", "vec_id")


def cluster_radius(spark, sf_dir):
    """Labels as clusters, the first two coordinates as the plane."""
    plane = _points(spark, sf_dir).select(
        F.col("label").alias("cluster"), F.col("features")[0].alias("x"), F.col("features")[1].alias("y")
    )
    centers = plane.groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return clusters.cluster_radius(plane, centers).withColumn("radius", F.round("radius", 6))


def pca_covariance(spark, sf_dir):
    normed = clusters.normalized(_points(spark, sf_dir))
    return clusters.covariance(normed).withColumn("covariance", F.round("covariance", 6))


def kmeans(spark, sf_dir):
    points = _points(spark, sf_dir).select("vec_id", "features")
    centers = clusters.kmeans(points, "vec_id", clusters.DEFAULT_K)
    return clusters.cluster_sizes(clusters.assigned(points, centers))


def silhouette_sweep(spark, sf_dir):
    return clusters.silhouette_sweep(_points(spark, sf_dir), "vec_id")


def final_clusters(spark, sf_dir):
    labeled, _ = clusters.final_clusters(_points(spark, sf_dir), "vec_id")
    return clusters.cluster_sizes(labeled)


def _given_fit(points, ks=(clusters.DEFAULT_K,)):
    """Fits from the vectors with the first ids, for a fixed number of steps."""
    first = points.filter(F.col("vec_id") < max(ks)).orderBy("vec_id").select("features").collect()
    starts = {k: [r.features for r in first[:k]] for k in ks}
    return {"starts": starts, "max_iterations": LLOYD_STEPS, "tolerance": 0.0}


def silhouette_sweep_given(spark, sf_dir):
    """The sweep over fits from given starts: labels and scores for every k."""
    points = _points(spark, sf_dir)
    return _rounded_scores(clusters.silhouette_sweep(points, "vec_id", SWEEP_GIVEN, **_given_fit(points, SWEEP_GIVEN)))


def kmeans_given(spark, sf_dir):
    points = _points(spark, sf_dir).select("vec_id", "features")
    centers = clusters.kmeans(points, "vec_id", clusters.DEFAULT_K, **_given_fit(points))
    return centers.select("cluster", F.posexplode("center").alias("pos", "value")).withColumn("value", F.round("value", 6))


def _final_given(spark, sf_dir):
    points = _points(spark, sf_dir).select("vec_id", "features")
    return clusters.final_clusters(points, "vec_id", clusters.DEFAULT_K, **_given_fit(clusters.normalized(points)))


def final_clusters_given(spark, sf_dir):
    return _final_given(spark, sf_dir)[0].select("vec_id", "cluster")


def scatter_given(spark, sf_dir):
    labeled, centers = _final_given(spark, sf_dir)
    table = clusters.scatter_table(labeled, centers, clusters.Projection(labeled.select("vec_id", "features")))
    return table.withColumns({"x": F.round("x", 4), "y": F.round("y", 4)})


def pca_2d(spark, sf_dir):
    normed = clusters.normalized(_points(spark, sf_dir)).select("vec_id", "features")
    return clusters.Projection(normed).apply(normed).withColumns({"x": F.round("x", 4), "y": F.round("y", 4)})


def scatter_table(spark, sf_dir):
    points = _points(spark, sf_dir).select("vec_id", "features")
    labeled, centers = clusters.final_clusters(points, "vec_id")
    return clusters.scatter_table(labeled, centers, clusters.Projection(clusters.normalized(points)))


QUERIES = {
    query.__name__: query
    for query in (
        xml_pages_roundtrip, xml_pages_by_file, xml_pages_by_record, xml_pages_inferred, xml_pages_inferred_by_file, xml_pages_odd_markup, articles_filter, article_text_nonempty, page_limit,
        page_hash_sample, page_sample, vocab_fit_sample, clean_markup, clean_markup_html, clean_markup_v1,
        collapse_links, tokens, tokens_no_stopwords, tokens_custom_stopwords, tokens_custom_stopwords_join, lemmas, lemmas_join, lemmas_detached,
        normalize_title,
        normalize_query, term_stats, vocabulary, vocabulary_pruned, term_frequency, idf, tfidf, top_tfidf_terms, topics_fixed_v,
        doc_embed_fixed_v, doc_embed_fixed_v_join, term_embed_fixed_v, topic_strength, topic_strength_fitted, svd_gram, svd_truncated, svd_block, svd_block_join,
        svd_similar_docs, svd_invariants, topics, doc_embeddings, doc_embeddings_us, term_embeddings,
        vector_norms, cosine_modes, similar_terms, similar_docs, docs_for_term, neighbor_samples,
        neighbor_samples_cut, vocabulary_cut, neighbor_samples_v1, batch_knn, batch_knn_blocks, batch_knn_pruned, resolve_title, resolve_title_index,
        title_status, select_title,
        first_of_title, seed_semi, json_artifacts_roundtrip, parquet_roundtrip, merged_shards, literal_table,
        index_range, list_files, dedupe_terms, kmeans_assign, kmeans_update, cluster_sizes, silhouette,
        silhouette_blocks, silhouette_squared, silhouette_labelings, pick_k, normalize_rows, cluster_radius,
        pca_covariance, kmeans, silhouette_sweep, silhouette_sweep_given, silhouette_sampled, final_clusters, pca_2d, kmeans_given, final_clusters_given, scatter_given, scatter_table,
    )
}
