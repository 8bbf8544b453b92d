"""Exact deduplication with heavy hitters taken out of the shuffle. DataFrame functions only.

1. One pass keeps a Misra-Gries summary of the digests (`approx_top_k`, a frequent-items sketch:
   bounded counters a task, merged by adding and cutting down).
2. The digests that it names, a bounded number, are counted exactly, map-side first: largest id
   and group size. These verified winners are broadcast.
3. Rows of a winner's digest get their answer where they are read and are never shuffled. The
   other digests are dealt by digest as usual; none of them can hold more than its share of rows.

The summary only chooses which way a row goes; both ways give the same answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Counters of the summary: a digest with more than about 1/COUNTERS of the rows is seen.
COUNTERS = 4096
# Digests that may be broadcast at most; a row of the broadcast has about 100 bytes.
WINNERS = 512


def exact_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = COUNTERS, winners: int = WINNERS
) -> DataFrame:
    """One row per row of `docs`: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty, so null and empty texts are one group. The
    largest key of a group stays. Rows without a key never stay unless the whole group has none; rows
    that repeat the winning key and text are the same document and are all marked kept. An empty table
    gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"))
    named = rows.agg(F.expr(f"approx_top_k(digest, {winners}, {counters})").alias("top"))
    # At most `winners` strings of 64 characters.
    frequent = [r["digest"] for r in named.select(F.explode("top.item").alias("digest")).collect()]
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(d,) for d in frequent], "digest string"))
    group = (F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    winner = rows.join(chosen, "digest").groupBy("digest").agg(*group).where("group_size > 1")
    winner = F.broadcast(winner)

    heavy = rows.join(winner, "digest")
    same = Window.partitionBy("digest")
    rest = rows.join(winner.select("digest"), "digest", "left_anti").select(
        "id", "digest", F.max("id").over(same).alias("keep_id"), F.count(F.lit(1)).over(same).alias("group_size")
    )
    return heavy.select("id", "digest", "keep_id", "group_size").unionByName(rest).select(
        F.col("id").alias(key),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
