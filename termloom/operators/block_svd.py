"""Truncated SVD in a fixed number of passes, with both long factors as tables.

A block of random vectors, one row per term, is multiplied by A and by its transpose again and again; the range of the
block turns to the leading right singular vectors. Every pass ends with a tree QR: each task reduces its rows to a small
triangle, triangles are stacked and reduced again, and only the last one, as wide as the block, reaches the driver. So
neither V nor anything else of vocabulary length is ever held there. A block below the broadcast bound is sent to the
tasks, which then do a pass without moving a row; a larger one is multiplied block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators import lsa
from termloom.settings import BROADCAST_BYTES, stored

# Vectors beyond the wanted rank, most passes, and the relative change of the singular values that ends them early.
OVERSAMPLE, PASSES, TOLERANCE = 64, 8, 1e-10
# Singular values below this share of the largest are rank deficiency.
RANK_SHARE = 1e-12

_U64 = 0xFFFFFFFFFFFFFFFF


def _start(spark, terms: int, width: int, seed: int) -> DataFrame:
    """(term_id, v): normal numbers that depend on seed, term and column only."""

    def uniform(ids: np.ndarray, salt: int) -> np.ndarray:
        x = ids[:, None].astype(np.uint64) * np.uint64(width) + np.arange(width, dtype=np.uint64)
        x += np.uint64((seed * 2 + salt) * 0x9E3779B97F4A7C15 & _U64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        return ((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            normal = np.sqrt(-2 * np.log(uniform(ids, 0))) * np.cos(2 * np.pi * uniform(ids, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), lsa.list_column(normal)], names=["term_id", "v"])

    return spark.range(terms).withColumnRenamed("id", "term_id").mapInArrow(run, "term_id long, v array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def triangle(rows: DataFrame, vector: str) -> np.ndarray:
    """R of the QR decomposition of the matrix whose rows are `vector`."""

    def reduced(parts: Iterator[np.ndarray]) -> np.ndarray | None:
        r = None
        for part in parts:
            if len(part):
                r = np.linalg.qr(part if r is None else np.vstack([r, part]), mode="r")
        return r

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = reduced(_matrix(b.column(0)) for b in batches)
        if r is not None:
            yield pa.RecordBatch.from_arrays([lsa.list_column(r)], names=["r"])

    def again(table: pa.Table) -> pa.Table:
        return pa.table({"r": lsa.list_column(reduced([_matrix(table["r"].combine_chunks())]))})

    first = rows.select(vector).mapInArrow(run, "r array<double>").withColumn("task", F.spark_partition_id())
    groups = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    second = first.groupBy((F.col("task") % groups).alias("group")).applyInArrow(again, "r array<double>")
    found = reduced([_matrix(second.toArrow()["r"].combine_chunks())])
    return found if found is not None else np.zeros((0, 0))


def _times(table: DataFrame, small: np.ndarray) -> DataFrame:
    """(term_id, v) with every row multiplied by a matrix that is as small as the block is wide."""
    sent = table.sparkSession.sparkContext.broadcast(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), lsa.list_column(_matrix(batch.column(1)) @ sent.value)], names=["term_id", "v"])

    return table.select("term_id", "v").mapInArrow(run, "term_id long, v array<double>")


def _summed(parts: DataFrame) -> DataFrame:
    """(term_id, v) with the rows of a term added up, map-side first."""
    total = Summarizer.sum(array_to_vector("v"))
    return parts.groupBy("term_id").agg(total.alias("v")).select("term_id", vector_to_array("v").alias("v"))


def _pass_sent(rows: DataFrame, block: np.ndarray) -> DataFrame:
    """A'(A Q) for a Q that is sent to the tasks; a task returns one row per term."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        total, seen = np.zeros_like(q), np.zeros(len(q), dtype=bool)
        for batch in batches:
            ids, values, lengths = lsa.sparse(batch.column(0), batch.column(1))
            product = lsa.products(ids, values, lengths, q)
            lsa.add_outer(total, ids, values, lengths, product)
            seen[ids] = True
        found = np.flatnonzero(seen)
        for at in range(0, len(found), 1024):
            some = found[at : at + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(some), lsa.list_column(total[some])], names=["term_id", "v"])

    return rows.select("_indices", "_values").mapInArrow(run, "term_id long, v array<double>")


def _pass_joined(rows: DataFrame, block: DataFrame, width: int, terms: int) -> DataFrame:
    """A'(A Q) for a Q that stays a table; `rows` have a number."""
    product = lsa.blocked_products(rows, block, terms, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values, lengths = lsa.sparse(batch.column(0), batch.column(1))
            found, place = np.unique(ids, return_inverse=True)
            total = np.zeros((len(found), width))
            lsa.add_outer(total, place, values, lengths, _matrix(batch.column(2)) if batch.num_rows else total)
            for at in range(0, len(found), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(found[at : at + 1024].astype(np.int64)), lsa.list_column(total[at : at + 1024])], names=["term_id", "v"])

    joined = rows.join(product.withColumnRenamed("embedding", "_y"), "_row").select("_indices", "_values", "_y")
    return joined.mapInArrow(run, "term_id long, v array<double>")


def _collected(block: DataFrame, terms: int, width: int) -> np.ndarray:
    """A block below the bound as one array."""
    table = block.toArrow()
    out = np.zeros((terms, width))
    out[table["term_id"].to_numpy()] = _matrix(table["v"].combine_chunks())
    return out


def block_svd(
    features: DataFrame, k: int, terms: int, vector: str = "features", oversample: int = OVERSAMPLE, passes: int = PASSES,
    tolerance: float = TOLERANCE, seed: int = 11, max_bytes: int = BROADCAST_BYTES,
) -> tuple[np.ndarray, DataFrame]:
    """The k largest singular values and (term_id, v) with a row for each of `terms` columns of the matrix.

    Fewer than k values come back when the rank is lower. With at most k + oversample columns the result is that of a
    full decomposition; otherwise it comes from at most `passes` passes, fewer once the values stand still. Each column
    of V has its entry of largest size positive.
    """
    spark = features.sparkSession
    rows = stored(lsa.numbered_rows(features, vector).select("_row", "_indices", "_values"), "svd_rows")
    width = min(terms, k + oversample)
    block, before = stored(_start(spark, terms, width, seed), "svd_block"), None
    for _ in range(passes):
        small = 8 * terms * width <= max_bytes
        parts = _pass_sent(rows, _collected(block, terms, width)) if small else _pass_joined(rows, block, width, terms)
        found = stored(_summed(parts), "svd_pass")
        _, size, turn = np.linalg.svd(triangle(found, "v"), full_matrices=False)
        kept = size > RANK_SHARE * max(size.max(initial=0.0), np.finfo(float).tiny)
        if not kept.any():
            return np.zeros(0), spark.range(terms).select(F.col("id").alias("term_id"), F.array().cast("array<double>").alias("v"))
        width = int(kept.sum())
        block = stored(_times(found, turn[kept].T / size[kept]), "svd_block")
        # The block's values near the squares of the singular values.
        now = np.sqrt(size[kept][:k])
        if width == terms or before is not None and len(now) == len(before) and np.abs(now - before).max() <= tolerance * now[0]:
            break
        before = now
    # Twice, so that rounding leaves the columns orthogonal.
    _, size, turn = np.linalg.svd(triangle(block, "v"), full_matrices=False)
    block = stored(_times(block, turn.T / size), "svd_block")
    if 8 * terms * width <= max_bytes:
        image = lsa.sent_products(rows.select("_indices", "_values"), _collected(block, terms, width), "embedding")
    else:
        image = lsa.blocked_products(rows, block, terms, width)
    _, values, turn = np.linalg.svd(triangle(image, "embedding"), full_matrices=False)
    values = values[:k]
    v = stored(_times(block, turn[: len(values)].T), "svd_v")
    most, least = v.select(Summarizer.max(array_to_vector("v")), Summarizer.min(array_to_vector("v"))).first()
    signs = np.where(-least.toArray() > most.toArray(), -1.0, 1.0)
    # Terms that no row has are not in the block.
    empty = F.array_repeat(F.lit(0.0), len(values))
    every = spark.range(terms).withColumnRenamed("id", "term_id").join(_times(v, np.diag(signs)), "term_id", "left")
    return values, every.select("term_id", F.coalesce("v", empty).alias("v"))
