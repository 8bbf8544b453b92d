"""Title search that reads the postings of one trigram, not all titles.

A search text of three characters or more can stand only in titles that hold each of its trigrams. Postings
(gram, doc_id, title) are stored in the order of the grams, so a filter on one gram skips the files and row groups of
all others; the titles found are then compared with the whole text. The order is by gram and document, so a gram
that a third of the titles hold is spread over files as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import normalize_title
from termloom.operators.search import MIN_TITLE_QUERY
from termloom.settings import stored

GRAM = MIN_TITLE_QUERY
# Titles with more characters have no postings, which would hold the title once a gram; searches read them all.
LONG_TITLE = 512


@dataclass(frozen=True)
class TitleIndex:
    """`postings` (gram, doc_id, title), `frequencies` (gram, titles), and the `long_titles` (doc_id, title)."""

    postings: DataFrame
    frequencies: DataFrame
    long_titles: DataFrame

    def rarest(self, text: str) -> str | None:
        """The trigram of `text` that the fewest titles hold; None if one of them is in no title."""
        grams = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
        known = self.frequencies.where(F.col("gram").isin(grams)).agg(
            F.count("*").alias("grams"), F.min(F.struct("titles", "gram")).alias("rarest")
        )
        found = known.first()
        return found["rarest"]["gram"] if grams and found["grams"] == len(grams) else None

    def matches(self, text: str) -> DataFrame:
        """(doc_id, title) of the documents whose title contains the text; none for a text of fewer than three characters."""
        text = text.strip().lower()
        held = F.col("title").contains(text)
        if len(text) < GRAM:
            return self.long_titles.limit(0)
        gram = self.rarest(text)
        listed = self.postings.where((F.col("gram") == gram) & held) if gram is not None else self.postings.limit(0)
        return listed.select("doc_id", "title").unionByName(self.long_titles.where(held))

    def candidates(self, text: str) -> DataFrame:
        """What `search.title_candidates` gives: the matches with `status` one or many."""
        found = self.matches(text)
        several = found.limit(2).agg(F.count("*")).scalar()
        return found.withColumn("status", F.when(several > 1, "many").otherwise("one"))


def title_index(docs: DataFrame) -> TitleIndex:
    """Index the titles of `docs` (doc_id, title). NULL titles and those of fewer than three characters match nothing;
    every row is found by itself, also where ids or titles repeat."""
    titles = docs.select("doc_id", normalize_title(F.col("title")).alias("title")).where(F.length("title") >= GRAM)
    short = F.length("title") <= LONG_TITLE
    grams = F.array_distinct(F.regexp_extract_all("title", F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))
    postings = titles.where(short).select(F.explode(grams).alias("gram"), "doc_id", "title")
    postings = stored(_in_order(postings, "gram", "doc_id"), "title_postings")
    counted = postings.groupBy("gram").agg(F.count("*").alias("titles"))
    return TitleIndex(
        postings, stored(_in_order(counted, "gram"), "title_grams"), stored(titles.where(~short), "long_titles")
    )


def _in_order(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
