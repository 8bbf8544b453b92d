"""Connected components by star contraction, in DataFrame functions.

Every round joins each node's neighbours to the smallest of them, in turn for larger and for smaller neighbours.
Edges never become more than they were, and each round is stored, so that
lineage stays short and a lost executor costs a re-read. The number of rounds grows with the logarithm of
the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.settings import stored


def _hooked(pairs: DataFrame, partitions: int) -> DataFrame:
    """(u, v, m) for pairs (u, v), where m is the smallest of u and its partners. One shuffle serves both sides."""
    dealt = pairs.repartition(partitions, "u")
    least = dealt.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return dealt.join(least.hint("shuffle_hash"), "u")


def _large_star(edges: DataFrame, partitions: int) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    return _hooked(both, partitions).where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, partitions: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    hooked = _hooked(down, partitions)
    turned = F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))
    return hooked.select(F.inline(turned)).where("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node either is a centre, with no edge to a smaller node, or has one edge, to its centre."""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")),
    )))
    sums = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return sums.where("out > 1 or out = 1 and into = 1").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root for every node of `edges` (two columns of 64-bit numbers): root is the smallest node that it is
    connected to. Loops and repeated edges change nothing; nulls are dropped; no edges give no rows."""
    partitions = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one, two = (F.col(c) for c in edges.columns)
    down = edges.select(F.greatest(one, two).alias("a"), F.least(one, two).alias("b"))
    now = stored(down.where("a is not null and b is not null and a <> b").distinct(), name)
    while not _are_stars(now):
        now = stored(_small_star(_large_star(now, partitions), partitions), name)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select("root", "root").distinct())
