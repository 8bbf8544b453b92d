"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Documents are dealt by a hash of their key to shards of bounded size; a shard is packed by one task
from sizes and codes alone, texts do not move. Inside a shard the largest pieces come first. Open bins
stand in the order of their free space and carry two bitmaps, sources and duplicate clusters. The
search starts at the least free space that holds the piece and goes to the next bin until one is
compatible, so the piece gets the tightest bin that has neither its source nor its cluster.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
# Pieces that one task packs; more rows give more shards.
SHARD_ROWS = 8192

SCHEMA = "doc_id long, piece int, first_word long, n_words long, shard int, bin int, free_words long"


def word_count(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+")
    return F.size(F.filter(parts, lambda w: w != "")).cast("long")


def pack(pieces: Iterable[tuple[int, int, int]], capacity: int) -> tuple[list[int], list[int]]:
    """Bin of every (size, source code, cluster code), in the order given, and free space of every bin.

    A negative code conflicts with nothing. Sizes go from 0 to `capacity`.
    """
    order: list[tuple[int, int]] = []  # (free space, bin), ascending
    free: list[int] = []
    sources: list[int] = []
    clusters: list[int] = []
    chosen = []
    for size, source, cluster in pieces:
        source_bit = 1 << source if source >= 0 else 0
        cluster_bit = 1 << cluster if cluster >= 0 else 0
        at, end = bisect_left(order, (size, -1)), len(order)
        while at < end:
            found = order[at][1]
            if not (sources[found] & source_bit or clusters[found] & cluster_bit):
                break
            at += 1
        if at < end:
            del order[at]
            free[found] -= size
            sources[found] |= source_bit
            clusters[found] |= cluster_bit
        else:
            found = len(free)
            free.append(capacity - size)
            sources.append(source_bit)
            clusters.append(cluster_bit)
        insort(order, (free[found], found))
        chosen.append(found)
    return chosen, free


def _packed_shard(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        sources: dict[str, int] = {}
        clusters: dict[tuple, int] = {}
        members: dict[tuple, int] = {}
        digests = list(zip(rows["cluster_a"], rows["cluster_b"], strict=True))
        for digest in digests:
            members[digest] = members.get(digest, 0) + 1
        pieces = []
        for row, (key, size, source, digest) in enumerate(zip(rows["doc_id"], rows["size"], rows["source"], digests, strict=True)):
            source_code = -1 if source is None else sources.setdefault(source, len(sources))
            cluster_code = clusters.setdefault(digest, len(clusters)) if members[digest] > 1 and size else -1
            first = 0
            while size - first > capacity:
                pieces.append((capacity, row, first, source_code, cluster_code))
                first += capacity
            pieces.append((size - first, row, first, source_code, cluster_code))
        def place(piece):
            key = rows["doc_id"][piece[1]]
            return (-piece[0], key is None, key or 0, digests[piece[1]], piece[2])

        pieces.sort(key=place)
        bins, free = pack(((p[0], p[3], p[4]) for p in pieces), capacity)
        shard = rows["shard"][0]
        return pa.table({
            "doc_id": pa.array([rows["doc_id"][p[1]] for p in pieces], pa.int64()),
            "piece": pa.array([p[2] // capacity for p in pieces], pa.int32()),
            "first_word": pa.array([p[2] for p in pieces], pa.int64()),
            "n_words": pa.array([p[0] for p in pieces], pa.int64()),
            "shard": pa.array([shard] * len(pieces), pa.int32()),
            "bin": pa.array(bins, pa.int32()),
            "free_words": pa.array([free[b] for b in bins], pa.int64()),
        })

    return run


def best_fit_packing(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    capacity: int = CAPACITY,
    shard_rows: int = SHARD_ROWS,
    clusters: tuple[Column, Column] | None = None,
) -> DataFrame:
    """One row per piece of a document: doc_id, piece, first_word, n_words, shard, bin, free_words (of its bin).

    A bin is (shard, bin). It holds `capacity` words at most and no two pieces of one source or of one
    duplicate cluster (`clusters`: two 64-bit codes; by default two hashes of the text). A document with
    more words than fit is cut at the capacity; every full piece fills a bin. Null and empty texts are pieces
    of 0 words that take part in source conflicts only. Null sources conflict with nothing. Rows that repeat are
    packed each for itself. An empty table gives no bins. Other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    first, second = clusters or (F.xxhash64(body), F.xxhash64(F.lit("packing"), body))
    items = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        word_count(F.col(text)).alias("size"),
        F.col(source).cast("string").alias("source"),
        first.alias("cluster_a"),
        second.alias("cluster_b"),
    )
    shards = max(1, -(-docs.count() // shard_rows))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster_a"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(_packed_shard(capacity), SCHEMA)
