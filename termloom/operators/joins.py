"""Equi joins against a lookup table whose keys repeat unevenly on the large side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys taken out of the shuffle at most, counters of the summary that names them, and the longest key that may be one.
FREQUENT_KEYS, COUNTERS, KEY_BYTES = 512, 4096, 256


def frequent_keys(rows: DataFrame, on: str) -> list[str]:
    """The most frequent strings of a column, from one pass with bounded counters a task. A key with more than about
    1/COUNTERS of the rows is among them."""
    short = rows.where(F.octet_length(on) <= KEY_BYTES)
    top = short.agg(F.expr(f"approx_top_k({on}, {FREQUENT_KEYS}, {COUNTERS})").alias("top"))
    return [r["key"] for r in top.select(F.explode("top.item").alias("key")).collect() if r["key"] is not None]


def split_join(rows: DataFrame, lookup: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """`rows.join(lookup, on, how)` for inner, left, semi and anti joins, with the rows of frequent keys left in place.

    `lookup` has one row per key, so that of the frequent keys, FREQUENT_KEYS at most, is broadcast; the other rows are
    shuffled, and none of their keys has many. `rows` is read twice and should be stored.
    """
    frequent = frequent_keys(rows, on)
    if not frequent:
        return rows.join(lookup, on, how)
    is_frequent = F.coalesce(F.col(on).isin(frequent), F.lit(False))
    few = F.broadcast(lookup.where(F.col(on).isin(frequent)))
    in_place = rows.where(is_frequent).join(few, on, how)
    return in_place.unionByName(rows.where(~is_frequent).join(lookup, on, how))
