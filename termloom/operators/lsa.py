"""Truncated SVD of the document-term matrix and the tables that follow from it.

The matrix is never centred. Its right factor V has one row per vocabulary term and is the
only dense factor computed; documents are projected on it row by row with their keys, so no
result is joined back by position.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.operators.streams import sliced
from termloom.settings import BLOCK_BYTES, BROADCAST_BYTES, block_count, stored

# Fixed value: terms listed per topic.
TOPIC_TERMS = 20
# Numbers held at a time by a sparse product.
PRODUCT_CELLS = 1 << 19
# Bytes of entries that meet a block of V in one task.
PIECE_BYTES = 16 << 20


@dataclass(frozen=True)
class Factors:
    """Singular values (descending) and the right factor, one row per term.

    Both are bounded by the vocabulary size times the rank, whatever the corpus size. No `v` where it is a table only.
    """

    singular_values: np.ndarray
    v: np.ndarray | None

    @property
    def rank(self) -> int:
        return len(self.singular_values)

    def term_vectors(self, spark: SparkSession, terms: list[str]) -> DataFrame:
        """(term_id, term, v): rows of V under their terms."""
        import pyarrow as pa

        table = pa.table({
            "term_id": pa.array(np.arange(len(terms), dtype=np.int32)),
            "term": pa.array(terms, pa.string()),
            "v": pa.array(list(self.v), pa.list_(pa.float64())),
        })
        return spark.createDataFrame(table)

    def singular_table(self, spark: SparkSession) -> DataFrame:
        """(topic, singular_value)."""
        rows = [(j, float(s)) for j, s in enumerate(self.singular_values)]
        return spark.createDataFrame(rows, "topic int, singular_value double")


def truncated_svd(features: DataFrame, k: int, vector: str = "features") -> Factors:
    """The k largest singular values and V of the matrix whose rows are `vector`.

    The rows reach the solver as JVM vectors and stay cached while it passes over them. Fewer
    than k values come back when the rank is lower. Each column of V has its entry of largest
    size positive, which makes the result comparable between runs.
    """
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(features.select(vector), vector))
    # The solver's own vectors are cached: a cached DataFrame would decode all of them in each of its many passes.
    rows = matrix._java_matrix_wrapper._java_model.rows()
    rows.persist(features.sparkSession.sparkContext._getJavaStorageLevel(StorageLevel.MEMORY_AND_DISK_DESER))
    try:
        svd = matrix.computeSVD(k, computeU=False)
        singular_values = np.asarray(svd.s.toArray(), dtype=float)
        v = np.ascontiguousarray(svd.V.toArray(), dtype=float)
    finally:
        rows.unpersist(False)
    return Factors(singular_values, v * column_signs(v))


def column_signs(v: np.ndarray) -> np.ndarray:
    """+1 or -1 per column, so that the entry of largest size times it is positive."""
    largest = v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])]
    return np.where(largest < 0, -1.0, 1.0)


def topics(term_vectors: DataFrame, singular_values: DataFrame, top_n: int = TOPIC_TERMS) -> DataFrame:
    """(topic, singular_value, terms, weights): per concept the terms of largest size, signed.

    Ties go to the lower term id. Concepts without a singular value are left out.
    """
    cells = term_vectors.select("term_id", "term", F.posexplode("v").alias("topic", "weight"))
    order = Window.partitionBy("topic").orderBy(F.abs("weight").desc(), "term_id")
    best = cells.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)
    listed = best.groupBy("topic").agg(
        F.sort_array(F.collect_list(F.struct("rank", "term", "weight"))).alias("best")
    )
    return listed.join(singular_values, "topic").select(
        "topic", "singular_value", F.col("best.term").alias("terms"), F.col("best.weight").alias("weights")
    )


def topic_strength(topic_rows: DataFrame) -> DataFrame:
    """(topic, singular_value) in topic order."""
    return topic_rows.select("topic", "singular_value").orderBy("topic")


def scaled_terms(term_vectors: DataFrame, singular_values: list[float]) -> DataFrame:
    """Rows of V times S: (term_id, term, embedding)."""
    return term_vectors.select(
        "term_id", "term", _times(F.col("v"), singular_values).alias("embedding")
    )


def _times(vector: Column, factors: list[float]) -> Column:
    return F.zip_with(vector, F.array(*[F.lit(float(s)) for s in factors]), lambda x, s: x * s)


def project_documents(
    features: DataFrame,
    term_vectors: DataFrame,
    vector: str = "features",
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rows of A times V under their own columns: (..., embedding).

    A V of at most `max_bytes` is sent to the executors and each Arrow batch is multiplied there; no row moves and no
    key is needed. A larger one stays a table: blocks of documents meet blocks of terms, and the partial sums of a
    document are added up; see `blocked_products`. A document without any vocabulary term gets the zero vector.
    """
    terms, known, least, most, width = term_vectors.agg(
        F.count("*"), F.count_distinct("term_id"), F.min("term_id"), F.max("term_id"), F.max(F.size("v"))
    ).first()
    if not terms:
        raise ValueError("there are no term vectors to project on")
    if (known, least, most) != (terms, 0, terms - 1):
        raise ValueError("term ids must run from 0 without gaps")
    if 8 * terms * width > max_bytes:
        rows = stored(numbered_rows(features, vector), "projected_rows")
        others = [c for c in features.columns if c != vector]
        product = blocked_products(rows, term_vectors, terms, width)
        return rows.select("_row", *others).join(product, "_row").select(*others, "embedding")
    table = term_vectors.select("term_id", "v").orderBy("term_id").toArrow()
    v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(terms, width)
    return _projected(features, lambda low, high: v[:, low:high], terms, width, vector, max_bytes)


def sparse_rows(features: DataFrame, vector: str = "features") -> DataFrame:
    """`features` with the vector as _indices and _values."""
    raw = F.unwrap_udt(F.col(vector))
    # Dense vectors store no indices: number their values.
    indices = F.when(raw["type"] == 1, F.sequence(F.lit(0), F.size(raw["values"]) - 1)).otherwise(raw["indices"])
    indices = F.when(F.size(raw["values"]) == 0, F.array().cast("array<int>")).otherwise(indices)
    others = [c for c in features.columns if c != vector]
    return features.select(*others, indices.alias("_indices"), raw["values"].alias("_values"))


def numbered_rows(features: DataFrame, vector: str = "features") -> DataFrame:
    """`sparse_rows` with a number of its own for every row; store it, so that it is drawn once."""
    return sparse_rows(features, vector).withColumn("_row", F.monotonically_increasing_id())


def _projected(features: DataFrame, part, terms: int, width: int, vector: str, max_bytes: int) -> DataFrame:
    """`features` times the columns that `part(low, high)` returns, in parts below `max_bytes`."""
    others = [c for c in features.columns if c != vector]
    rows = sparse_rows(features, vector)
    step = min(width, max(1, max_bytes // (8 * max(terms, 1))))
    names = []
    for low in range(0, width, step):
        names.append(f"_part{low}")
        rows = sent_products(rows, part(low, min(low + step, width)), names[-1])
        if step < width:
            # One part at a time is in memory.
            rows = stored(rows, "projection")
    return rows.select(*others, F.concat(*names).alias("embedding"))


def list_column(matrix: np.ndarray):
    """The rows of a matrix as an Arrow column of lists."""
    import pyarrow as pa

    offsets = pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix, dtype=float).ravel()))


def sparse(indices, values) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices and values of Arrow list columns one after the other, and the entries of each row."""
    lengths = indices.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return indices.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False), lengths


def _runs(lengths: np.ndarray, width: int):
    """Runs of rows whose entries times `width` stay below PRODUCT_CELLS, or single rows: (row from, to, entry from, to)."""
    ends = np.concatenate(([0], np.cumsum(lengths)))
    most, at = max(1, PRODUCT_CELLS // max(width, 1)), 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield at, to, int(ends[at]), int(ends[to])
        at = to


def products(ids: np.ndarray, values: np.ndarray, lengths: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Sparse rows times V, all rows of a run at once."""
    out = np.zeros((len(lengths), v.shape[1]))
    for low, high, a, b in _runs(lengths, v.shape[1]):
        filled = np.flatnonzero(lengths[low:high])
        if len(filled):
            cells = v[ids[a:b]]
            cells *= values[a:b, None]
            starts = (np.cumsum(lengths[low:high]) - lengths[low:high])[filled]
            out[low + filled] = np.add.reduceat(cells, starts, axis=0)
    return out


def add_outer(total: np.ndarray, ids: np.ndarray, values: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> None:
    """Adds the transposed sparse rows times Y to `total`, which has a row per index."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(ids, kind="stable")
    ids, values, row = ids[order], values[order], row[order]
    found, first = np.unique(ids, return_index=True)
    for low, high, a, b in _runs(np.diff(np.append(first, len(ids))), total.shape[1]):
        cells = y[row[a:b]]
        cells *= values[a:b, None]
        total[found[low:high]] += np.add.reduceat(cells, first[low:high] - a, axis=0)


def sent_products(rows: DataFrame, v: np.ndarray, name: str) -> DataFrame:
    """Rows with _indices and _values times a V that is sent to the executors, as column `name`."""
    matrix = rows.sparkSession.sparkContext.broadcast(v)
    id_column, value_column = rows.columns.index("_indices"), rows.columns.index("_values")

    def multiply(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            found = list_column(products(*sparse(batch.column(id_column), batch.column(value_column)), matrix.value))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    # A copy: the frame keeps its schema.
    return rows.mapInArrow(multiply, rows.select("*").schema.add(name, T.ArrayType(T.DoubleType())))


def blocked_products(rows: DataFrame, term_vectors: DataFrame, terms: int, width: int) -> DataFrame:
    """(_row, embedding): stored rows with _row, _indices and _values times a V of any size, which stays a table.

    Terms are cut into blocks that a task can hold. The entries of each Arrow batch leave as one packed row per block
    of terms; such pieces are dealt to groups, each of which meets a copy of its block of V. What the blocks give for a
    document is added up by its number. Entries move once, blocks of V once per group.
    """
    import pyarrow as pa

    # A block of V stays below the bound of `block_count`, and there are at least two, so that one task never gets all of it.
    blocks = block_count(terms, width, 2)
    size = -(-terms // blocks)
    entries = rows.agg(F.sum(F.size("_indices"))).first()[0] or 0
    groups = max(1, math.ceil(24 * entries / (blocks * min(PIECE_BYTES, BLOCK_BYTES))), -(-rows.sparkSession.sparkContext.defaultParallelism // blocks))
    kinds = "block int, piece long, row array<long>, term array<int>, value array<double>"

    def cut(batches):
        for batch in sliced(batches):
            ids, values, lengths = sparse(batch.column(1), batch.column(2))
            number = batch.column(0).to_numpy()
            row = np.repeat(number, lengths)
            # Rows without entries get a piece too, and so a sum of nothing.
            ids, row = np.concatenate([ids, np.zeros(int((lengths == 0).sum()), dtype=ids.dtype)]), np.concatenate([row, number[lengths == 0]])
            values = np.concatenate([values, np.zeros(len(ids) - len(values))])
            if not len(ids):
                continue
            block = ids // size
            order = np.lexsort((row, block))
            first = np.flatnonzero(np.diff(block[order], prepend=-1))
            offsets = pa.array(np.append(first, len(order)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order], t)) for x, t in ((row, pa.int64()), (ids, pa.int32()), (values, pa.float64()))]
            piece = pa.array(np.full(len(first), number[0]))
            yield pa.RecordBatch.from_arrays([pa.array(block[order][first], pa.int32()), piece, *lists], names=["block", "piece", "row", "term", "value"])

    def multiply(pieces, part):
        rows_out, sums = [np.empty(0, dtype=np.int64)], [np.zeros((0, width))]
        if pieces.num_rows:
            v = np.zeros((size, width))
            part = part.combine_chunks()
            if part.num_rows:
                v[part["term_id"].to_numpy() % size] = part["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for i in range(pieces.num_rows):
                row, term, value = (np.asarray(pieces[c][i].values) for c in ("row", "term", "value"))
                first = np.flatnonzero(np.diff(row, prepend=-1))
                rows_out.append(row[first])
                sums.append(products(term % size, value, np.diff(np.append(first, len(row))), v))
        return pa.table({"_row": pa.array(np.concatenate(rows_out)), "part": list_column(np.concatenate(sums))})

    pieces = rows.select("_row", "_indices", "_values").mapInArrow(cut, kinds)
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("piece"), F.lit(groups)).cast("int"))
    copies = term_vectors.select(
        F.expr(f"cast(term_id div {size} as int)").alias("block"), F.col("term_id").cast("long").alias("term_id"), "v",
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
    )
    cells = pieces.groupBy("block", "group").cogroup(copies.groupBy("block", "group"))
    parts = cells.applyInArrow(multiply, "_row long, part array<double>")
    # As many parts as there are blocks at most.
    listed = parts.groupBy("_row").agg(F.collect_list("part").alias("parts"))
    zeros = F.array_repeat(F.lit(0.0), width)
    return listed.select("_row", F.aggregate("parts", zeros, lambda total, part: F.zip_with(total, part, lambda x, y: x + y)).alias("embedding"))


def project_on_factors(
    features: DataFrame, factors: Factors, vector: str = "features", max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """`project_documents` for a V that is already on the driver."""
    terms, width = factors.v.shape
    return _projected(features, lambda low, high: factors.v[:, low:high], terms, width, vector, max_bytes)


def left_vectors(
    features: DataFrame, factors: Factors, vector: str = "features", max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Rows of U = A V / S under their own columns: (..., u). V goes out in parts as in the projection."""
    terms, width = factors.v.shape

    def part(low: int, high: int) -> np.ndarray:
        return factors.v[:, low:high] / factors.singular_values[low:high]

    return _projected(features, part, terms, width, vector, max_bytes).withColumnRenamed("embedding", "u")


def scaled_documents(u_rows: DataFrame, singular_values: list[float]) -> DataFrame:
    """Rows of U times S: (..., embedding). Equal to the projection A V."""
    others = [c for c in u_rows.columns if c != "u"]
    return u_rows.select(*others, _times(F.col("u"), singular_values).alias("embedding"))


def column_norms(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(topic, norm): length of every column. For A V these are the singular values."""
    return (
        embeddings.select(F.posexplode(vector).alias("topic", "x"))
        .groupBy("topic")
        .agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    )


