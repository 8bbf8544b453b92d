"""From raw documents to packed training bins: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import jaccard_join, line_dedup, packing, quality, substring_dedup
from termloom.settings import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CARRIED = ("lang", "source")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labelled documents, less the fold that is
    held out of op10 as well."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(quality.fold(F.col("doc_id"), 3) != 1)
    return quality.accepted(docs, quality.train(docs, labels)).select(*COLUMNS)


def _rebuilt(found: DataFrame, text: F.Column) -> DataFrame:
    rows = found.select("doc_id", text.alias("text"), "rest.*")
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand elsewhere; a document goes when only white space is left of it. Untouched
    documents stay as they are, empty ones too."""
    found = line_dedup.line_dedup(docs, carry=CARRIED)
    return _rebuilt(found.where(F.col("kept").rlike("\\S") | (F.col("n_removed") == 0)), F.col("kept"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest doc_id."""
    found = jaccard_join.near_duplicates(docs)
    place = [F.coalesce(F.col("doc_id"), F.lit(jaccard_join.NO_KEY)).alias("kid"), "text_hash"]
    kept = found.where("kept").select(*place).groupBy("kid", "text_hash").agg(F.count(F.lit(1)).alias("times"))
    named = docs.withColumns({"kid": place[0], "text_hash": F.xxhash64(F.coalesce("text", F.lit("")))})
    stays = named.join(stored(kept, "kept").hint("shuffle_hash"), ["kid", "text_hash"])
    # Rows that repeat key and text are one document; few rows, if any.
    repeated = stays.where("times > 1").dropDuplicates(["kid", "text_hash"])
    return stays.where("times = 1").unionByName(repeated).select(*COLUMNS)


def unrepeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages; a document goes when no word is left of it. Documents that
    lose nothing keep their white space."""
    found = substring_dedup.substring_dedup(docs, carry=CARRIED, as_is=True)
    return _rebuilt(found.where("n_removed = 0 or n_removed < n_words"), F.col("kept"))


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their bins."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality", good_documents),
    ("line_dedup", unrepeated_lines),
    ("jaccard_join", one_of_each_group),
    ("substring_dedup", unrepeated_passages),
    ("packing", bins),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# Models, greedy packing and the removal of what an earlier stage left are beyond one SQL statement; each stage is
# tested against a brute-force version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
