"""Exact top-k inner-product search by the threshold algorithm over sorted per-dimension lists.

Queries and candidates are dealt to blocks by a hash; a task gets one block of each. In a block every dimension
has its list of rows sorted by value, read from the end that suits the sign of the query's component. Reading all
lists to a first depth and scoring what they name gives a k-th best score. The bound at a depth is the score of
an imagined row with the list values there; no row below can beat it. The lists are read on to the first depth
whose bound is under the k-th score, everything seen is scored, and the query stops. Where the lists to that
depth hold as many places as the block has rows, whole blocks are scored at once instead of row by row. The k
best of every block are ranked again over all blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_ROWS, CANDIDATE_ROWS = 2048, 8192
FIRST_DEPTH = 8
# Queries whose scores against a whole block are held at a time.
GROUP = 128

SCHEMA = "query_id long, query long, vec_id long, score long"


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows; a list shorter than `width` goes on with zeros."""
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _each(blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))


class Lists:
    """A block of candidates, in the order of their ids, with its sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.order = np.argsort(self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.order, axis=0)

    def bound(self, queries: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Score that no row below `depth` of every list can beat, one depth per query."""
        low, high = self.values[depth], self.values[len(self.ids) - 1 - depth]
        return np.maximum(queries * low, queries * high).sum(axis=1)

    def seen(self, query: np.ndarray, depth: int) -> np.ndarray:
        """Rows that the lists name down to `depth`."""
        up, down = query < 0, query > 0
        named = np.concatenate([self.order[:depth, up].ravel(), self.order[-depth:, down].ravel()])
        return np.unique(named)


def _best(scores: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
    """Columns of the k best of each row, ties to the lower column; `own` is never among them."""
    out = []
    for row, mine in zip(scores, own, strict=True):
        columns = np.flatnonzero(~mine)
        if len(columns) > k:
            # All above the k-th score, and those equal to it.
            values = row[columns]
            columns = columns[values >= np.partition(values, len(columns) - k)[len(columns) - k]]
        out.append(columns[np.lexsort((columns, -row[columns]))[:k]])
    return out


def search(block: Lists, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query place, candidate place, score) of the k best of the block for every query."""
    n, width = block.vectors.shape
    found = [], [], []
    if n == 0 or len(queries) == 0:
        return found
    largest = float(np.abs(block.vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * width
    # Products and sums of whole numbers below 2^53 are exact in doubles, below 2^24 in floats.
    kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64
    fast = block.vectors.astype(kind)

    def report(places, columns, scores):
        for place, column, score in zip(places, columns, scores, strict=True):
            found[0].extend([place] * len(column))
            found[1].extend(column.tolist())
            found[2].extend(score.tolist())

    whole = []
    depth = min(FIRST_DEPTH, n)
    for place, query in enumerate(queries):
        rows = block.seen(query, depth)
        rows = rows[block.ids[rows] != query_ids[place]]
        stop = n
        if len(rows) >= k:
            kth = np.partition((fast[rows] @ query.astype(kind)).astype(np.int64), len(rows) - k)[len(rows) - k]
            # The first depth whose bound is under the k-th score: the bound falls with the depth.
            low, high = 0, n - 1
            while low < high:
                middle = (low + high) // 2
                if block.bound(query[None, :], np.array([middle]))[0] < kth:
                    high = middle
                else:
                    low = middle + 1
            stop = low + 1
        if stop * width >= n:
            whole.append(place)
            continue
        rows = block.seen(query, stop)
        scores = (fast[rows] @ query.astype(kind)).astype(np.int64)[None, :]
        own = (block.ids[rows] == query_ids[place])[None, :]
        columns = _best(scores, own, k)[0]
        report([place], [rows[columns]], [scores[0, columns]])
    for at in range(0, len(whole), GROUP):
        places = np.array(whole[at : at + GROUP])
        scores = (queries[places].astype(kind) @ fast.T).astype(np.int64)
        own = query_ids[places][:, None] == block.ids[None, :]
        for i, kept in enumerate(_best(scores, own, k)):
            report([places[i]], [kept], [scores[i, kept]])
    return found


def _cell(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        tables = [t for t in (candidates, queries) if t.num_rows]
        if len(tables) < 2:
            return pa.table({"query_id": pa.array([], pa.int64()), "query": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        width = max(int(np.diff(t["vector"].combine_chunks().offsets.to_numpy()).max()) for t in tables)
        block = Lists(candidates["id"].to_numpy(), _matrix(candidates["vector"], width))
        ids, names = queries["id"].to_numpy(), queries["query"].to_numpy()
        place, column, score = search(block, ids, _matrix(queries["vector"], width), k)
        place = np.array(place, dtype=np.int64)
        return pa.table({
            "query_id": ids[place],
            "query": names[place],
            "vec_id": block.ids[np.array(column, dtype=np.int64)],
            "score": np.array(score, dtype=np.int64),
        })

    return run


def top_k(
    vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, scale: int = 64,
    query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of floor(scale * component).

    Candidates are all rows but those with the query's own key; ties go to the smaller key. Rows without a key, with a
    null vector, or with a null or non-finite component take no part; empty vectors score 0, and a shorter vector goes
    on with zeros. Repeated candidates count each, a repeated query counts once; two vectors under one query key are
    two queries. Fewer than k candidates give all of them; an empty table gives no rows. Components up to 2^27 are
    exact (scores are 64-bit). Other columns are not read.
    """
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    usable = vectors.select(F.col(key).cast("long").alias("id"), wide.alias("wide"), is_query.alias("asks"))
    usable = usable.where(F.col("id").isNotNull() & _usable(F.col("wide")))
    rows = usable.select("id", F.transform("wide", lambda x: F.floor(x * scale).cast("long")).alias("vector"), "asks")
    rows = rows.withColumn("query", F.xxhash64("id", "vector"))
    asking = rows.where("asks").dropDuplicates(["id", "query"])
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    across, down = -(-sizes["n"] // candidate_rows) or 1, -(-sizes["q"] // query_rows) or 1
    blocks = {"candidate": F.pmod(F.xxhash64("query", F.lit(1)), F.lit(across)), "question": F.pmod(F.xxhash64("query", F.lit(2)), F.lit(down))}
    left = rows.select("id", "vector", blocks["candidate"].alias("candidate"), _each(down).alias("question"))
    right = asking.select(
        "id", "query", "vector", _each(across).alias("candidate"), blocks["question"].alias("question")
    )
    cells = left.groupBy("candidate", "question").cogroup(right.groupBy("candidate", "question"))
    best = cells.applyInArrow(_cell(k), SCHEMA)
    ranked = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
