"""The batch job: page dump to topics, document and term embeddings and neighbour samples.

    python -m termloom.plans.lsa_job --input pages.xml --out out --k 100
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import vectors
from termloom.functions.stopwords import ENGLISH
from termloom.functions.text import strip_markup, strip_markup_v1
from termloom.operators import articles, block_svd, lsa, search, terms
from termloom.settings import BROADCAST_BYTES, stored
from termloom.sources import artifacts, pages


@dataclass(frozen=True)
class LsaParams:
    """Defaults are those of the current generation; `first_generation` gives the older ones."""

    input: str
    out: str
    k: int = 100
    min_df: int = 30
    vocab_size: int = 80_000
    sample: float = 1.0
    cv_fit_sample: float = 1.0
    partitions: int = 64
    limit_pages: int = 0
    infer_schema: bool = False
    split_pages: bool = True
    prune_rare: bool = True
    clean_v1: bool = False
    lexicon: str = ""
    detach_endings: bool = False
    stopwords: str = ""
    cosine: str = vectors.SAMPLE_V3
    format: str = "json"

    @classmethod
    def first_generation(cls, input: str, out: str, **changes) -> "LsaParams":
        values = dict(
            k=400, min_df=5, vocab_size=200_000, cv_fit_sample=1.0, partitions=200,
            infer_schema=True, clean_v1=True, cosine=vectors.SAMPLE_V1,
        )
        return cls(input=input, out=out, **{**values, **changes})


@dataclass(frozen=True)
class LsaModel:
    """What a fit leaves behind. Tables are lazy; `features` is stored in the scratch folder."""

    features: DataFrame
    terms: list[str]
    factors: lsa.Factors
    term_vectors: DataFrame

    def topics(self, top_n: int = lsa.TOPIC_TERMS) -> DataFrame:
        return lsa.topics(
            self.term_vectors, self.factors.singular_table(self.features.sparkSession), top_n
        )

    def term_embeddings(self) -> DataFrame:
        return lsa.scaled_terms(self.term_vectors, self.factors.singular_values.tolist())

    def doc_embeddings(self) -> DataFrame:
        if self.factors.v is None:
            return lsa.project_documents(self.features, self.term_vectors)
        return lsa.project_on_factors(self.features, self.factors)

    def doc_embeddings_us(self) -> DataFrame:
        if self.factors.v is None:
            over_s = lsa.scaled_terms(self.term_vectors, (1 / self.factors.singular_values).tolist())
            u = lsa.project_documents(self.features, over_s.withColumnRenamed("embedding", "v"))
            u = u.withColumnRenamed("embedding", "u")
        else:
            u = lsa.left_vectors(self.features, self.factors)
        return lsa.scaled_documents(u, self.factors.singular_values.tolist())

    def neighbor_samples(self, seeds=search.SEED_TERMS, mode: str = vectors.SAMPLE_V3) -> DataFrame:
        return search.neighbor_samples(self.term_embeddings(), seeds, mode=mode)


def fit(
    tokens: DataFrame, k: int, min_df: int, vocab_size: int, cv_fit_sample: float = 1.0, max_bytes: int = BROADCAST_BYTES,
    prune_rare: bool = False,
) -> LsaModel:
    """Fit on a table of token arrays with a unique doc_id; other columns are carried along.

    The tokens are read twice (vocabulary, counts), so they should be stored, not recomputed.
    With the vocabulary fitted on all rows its document frequencies also give the IDF weights,
    which saves a third pass. A sample is drawn by doc_id, so it does not depend on the layout. A right factor
    above `max_bytes` comes from the block solver and stays a table. `prune_rare` reads the tokens once more to keep
    terms below `min_df` out of the shuffle; the vocabulary is the same.
    """
    on_sample = 0 < cv_fit_sample < 1
    fit_rows = articles.sample_by_key(tokens, "doc_id", cv_fit_sample)
    stats = terms.frequent_term_stats(fit_rows, min_df) if prune_rare else terms.term_stats(fit_rows)
    stats = stored(stats, "term_stats")
    vocab = stored(terms.vocabulary(stats, min_df, vocab_size), "vocabulary")
    names = terms.vocabulary_terms(vocab)
    tf = terms.term_frequency(tokens, names)
    if on_sample:
        idf = terms.idf_from_counts(tf)
    else:
        idf = terms.idf_from_stats(vocab, tokens.count())
    features = stored(terms.tfidf(tf, idf), "features")
    if 8 * len(names) * k > max_bytes:
        values, v = block_svd.block_svd(features, k, len(names))
        factors = lsa.Factors(values, None)
        term_vectors = stored(v.join(vocab.select("term_id", "term"), "term_id").select("term_id", "term", "v"), "term_vectors")
    else:
        factors = lsa.truncated_svd(features, k)
        term_vectors = stored(factors.term_vectors(tokens.sparkSession, names), "term_vectors")
    return LsaModel(features, names, factors, term_vectors)


def article_tokens(spark: SparkSession, params: LsaParams) -> DataFrame:
    """Page dump to (doc_id, title, tokens). The ids number the rows of the scan, before anything is capped,
    sampled or dealt out, so they follow from the files alone; cap and sample go by id. Store the result once."""
    read = pages.read_pages_inferred if params.infer_schema else pages.read_pages
    scan = read(spark, params.input, by_record=params.split_pages)
    few = articles.splits(scan) < params.partitions
    scan = scan.withColumn("doc_id", F.monotonically_increasing_id())
    rows = articles.cap_rows(scan, params.limit_pages, "doc_id")
    rows = articles.articles(articles.sample_by_key(rows, "doc_id", params.sample))
    if few or params.limit_pages > 0:
        # The regular expressions dominate: deal out what the reader could not split, and what a cap
        # leaves, which is in the first splits only.
        rows = articles.spread(rows, params.partitions)
    text = articles.article_text(rows, strip_markup_v1 if params.clean_v1 else strip_markup)
    tokens = terms.tokenized(text, stopwords=() if params.stopwords else ENGLISH)
    # Large word tables make the next steps read the tokens twice, and the new ids must not be
    # drawn twice.
    if params.stopwords:
        words = spark.read.text(params.stopwords).select(F.trim("value").alias("word"))
        tokens = terms.without_listed(stored(tokens, "all_tokens"), words)
    if params.lexicon:
        lexicon = spark.read.schema("form string, lemma string").json(params.lexicon)
        tokens = stored(tokens, "raw_tokens")
        if params.detach_endings:
            forms = terms.numbered(tokens, "tokens", "form").select("form").distinct()
            lexicon = lexicon.union(terms.detached_lemmas(forms, lexicon))
        tokens = terms.lemmatized(tokens, lexicon)
    return tokens.select("doc_id", "title", "tokens")


def run(spark: SparkSession, params: LsaParams) -> LsaModel:
    """Write the four result tables under `params.out` and return the model."""
    tokens = stored(article_tokens(spark, params), "tokens")
    model = fit(tokens, params.k, params.min_df, params.vocab_size, params.cv_fit_sample, prune_rare=params.prune_rare)
    artifacts.write_topics(model.topics(), params.out, params.format)
    artifacts.write_doc_embeddings(model.doc_embeddings(), params.out, params.format)
    artifacts.write_term_embeddings(model.term_embeddings(), params.out, params.format)
    artifacts.write_neighbors(model.neighbor_samples(mode=params.cosine), params.out, params.format)
    return model


def parse(argv: list[str] | None = None) -> LsaParams:
    """Command line to parameters. Unknown options are an error; --first_generation takes the older defaults."""
    older = argparse.ArgumentParser(add_help=False)
    older.add_argument("--first_generation", action="store_true")
    chosen, argv = older.parse_known_args(argv)
    defaults = LsaParams.first_generation("", "") if chosen.first_generation else LsaParams("", "")
    parser = argparse.ArgumentParser(description="Latent semantic analysis of a page dump")
    for field in fields(LsaParams):
        option = f"--{field.name}"
        if field.name in ("input", "out"):
            parser.add_argument(option, required=True)
        elif isinstance(field.default, bool):
            parser.add_argument(option, action=argparse.BooleanOptionalAction, default=getattr(defaults, field.name))
        else:
            parser.add_argument(option, type=type(field.default), default=getattr(defaults, field.name))
    return LsaParams(**vars(parser.parse_args(argv)))


def main(argv: list[str] | None = None) -> None:
    params = parse(argv)
    spark = (
        SparkSession.builder.appName("termloom-lsa")
        .config("spark.sql.shuffle.partitions", str(max(64, params.partitions)))
        .getOrCreate()
    )
    try:
        run(spark, params)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
