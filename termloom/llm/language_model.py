"""Scores of texts under an n-gram model with deleted interpolation.

The probability of a token is a mixture of maximum-likelihood estimates of all orders and the uniform one. The mixture
weights depend on how often the longest context occurs (buckets by powers of two) and are learned by
expectation-maximisation on held-out counts: a fold of the training texts is scored with its own counts deleted.

1. Texts become chunks of a bounded number of tokens: the chunk's distinct word hashes and, per token, a place
   among them. Chunks are stored once; all later passes read them.
2. Every chunk asks for the corpus counts of its distinct n-grams, as steps between sorted hashes. Requests are dealt by
   ranges of the hash, so a frequent n-gram is one entry per chunk, however often it occurs. The answers are stored.
3. Chunks of the fold meet their answers and give a table of estimates on a grid of at most CELLS cells, the only thing
   that the driver gets, whatever the corpus and the order. A cell carries the sums of its estimates. EM runs on that table.
4. All chunks meet their answers and are scored.

N-grams are told apart by 64-bit hashes, of which orders above 1 keep 56 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.words import mixed, row_blocks, words_of
from termloom.settings import stored

ORDER = 3
CHUNK_TOKENS = 1_250_000
TEXT_BLOCK = 2 << 20
# Tokens of a chunk whose estimates are held at a time; a longer text is one run.
RUN_TOKENS = 1 << 17
BUCKETS_PER_PARTITION = 4
# Context frequencies 0, 1, 2-3, 4-7, ...; cells of the grid at most, for any order and corpus; levels of an estimate at most.
FREQUENCIES = 24
CELLS = 1 << 20
LEVELS = 256
# Estimates of 2^-LOWEST of the uniform one, and smaller ones, share a level.
LOWEST = 10
ROUNDS = 200
FLOOR = 1e-9
TRAIN, FOLD, HELD_OUT = 0, 1, 2
# Stands for a missing key.
NO_KEY = -(2**63)
END = np.uint64(0x6A09E667F3BCC908)

CHUNK_SCHEMA = "chunk long, role int, tokens long, ids array<long>, lengths binary, vocabulary binary, places binary"
REQUEST_SCHEMA = "bucket int, level int, chunk long, role int, grams binary, counts binary"
ANSWER_SCHEMA = "chunk long, role int, level int, bucket int, total binary, fold binary, distinct long"
GRID_SCHEMA = "cell long, n long, " + ", ".join(f"f{i} double" for i in range(1, 8))


def _planes(values: np.ndarray, width: int) -> bytes:
    """Whole numbers byte by byte, lowest bytes of all first: sorted or small numbers then compress well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: bytes, width: int) -> np.ndarray:
    count = len(data) // width
    out = np.zeros((count, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(width, count).T
    return out.reshape(-1).view("<u8")


def _small(values: np.ndarray) -> bytes:
    """Counts with as many bytes each as the largest needs; the first byte says how many."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + _planes(values, width)


def _unsmall(data: bytes) -> np.ndarray:
    return _unplanes(data[1:], data[0]).astype(np.int64)


def _rising(keys: np.ndarray) -> bytes:
    """Sorted keys, at least one: the first, and the steps from each to the next, which take fewer bytes than keys."""
    return keys[:1].astype("<u8").tobytes() + _small(np.diff(keys))


def _unrising(data: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate((np.frombuffer(data[:8], dtype="<u8"), _unplanes(data[9:], data[8]))), dtype=np.uint64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and the place of each key among them, with little memory on the way."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    where = np.empty(len(keys), dtype=np.int32)
    where[order] = np.cumsum(new, dtype=np.int32) - 1
    return ranked[new], where


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of one role each from the rows of a task."""
    open_rows: dict[int, list] = {TRAIN: [], FOLD: [], HELD_OUT: []}
    open_tokens = dict.fromkeys(open_rows, 0)
    number, part = 0, TaskContext.get().partitionId()

    def close(role):
        nonlocal number
        ids, lengths, tokens = (np.concatenate(x) for x in zip(*open_rows[role], strict=True))
        vocabulary, places = _distinct(tokens)
        open_rows[role], open_tokens[role] = [], 0
        number += 1
        return pa.RecordBatch.from_pydict({
            "chunk": [part << 24 | number], "role": pa.array([role], pa.int32()), "tokens": [len(tokens)], "ids": pa.array([ids], pa.list_(pa.int64())),
            "lengths": [_small(lengths)], "vocabulary": [_planes(vocabulary, 8)], "places": [_small(places)],
        })

    for batch in row_blocks(batches, "text", TEXT_BLOCK):
        words = words_of(batch.column(1))
        # One end token after the words of every row.
        ends = words.offsets[1:] + np.arange(words.rows)
        tokens = np.full(len(words.start) + words.rows, END, dtype=np.uint64)
        tokens[np.arange(len(words.start)) + words.row_of_word()] = words.hashes(fold=True)
        lengths, roles = words.counts + 1, batch.column(2).to_numpy()
        row = np.repeat(np.arange(words.rows), lengths)
        assert len(ends) == 0 or ends[-1] == len(tokens) - 1
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for role in open_rows:
            mine = roles == role
            if mine.any():
                open_rows[role].append((ids[mine], lengths[mine], tokens[mine[row]]))
                open_tokens[role] += int(lengths[mine].sum())
                if open_tokens[role] >= CHUNK_TOKENS:
                    yield close(role)
    for role in open_rows:
        if open_rows[role]:
            yield close(role)


class Chunk:
    """Tokens of a chunk and its distinct n-grams of every order, without `keys` only their places."""

    def __init__(self, vocabulary: bytes, places: bytes, lengths: bytes, order: int, keys: bool = True):
        self.words = _unplanes(vocabulary, 8)
        self.tokens = _unsmall(places).astype(np.int32)
        self.lengths = _unsmall(lengths)
        self.first = np.cumsum(self.lengths) - self.lengths
        # Distinct keys and the place among them of each token's n-gram, by order.
        self.keys, self.places = [self.words], [self.tokens]
        if order > 1:
            hashes = self.words[self.tokens]
            place = np.arange(len(hashes), dtype=np.int32) - np.repeat(self.first.astype(np.int32), self.lengths)
            history = hashes.copy()
            for back in range(1, order):
                before = np.empty_like(hashes)
                before[back:] = hashes[: len(hashes) - back]
                before[place < back] = END
                history *= np.uint64(0xD1342543DE82EF95)
                history += before
                del before
                key, where = _distinct(mixed(history.copy()) >> np.uint64(8))
                self.keys.append(key if keys else None)
                self.places.append(where)

    def runs(self):
        """Runs of whole texts with about RUN_TOKENS tokens: (text from, to, token from, to)."""
        ends, at = np.cumsum(self.lengths), 0
        while at < len(ends):
            low = int(ends[at] - self.lengths[at])
            to = max(at + 1, int(np.searchsorted(ends, low + RUN_TOKENS, side="right")))
            yield at, to, low, int(ends[to - 1])
            at = to

    def counts(self, level: int) -> np.ndarray:
        return np.bincount(self.places[level], minlength=len(self.keys[level]))


def _width(level: int) -> int:
    return 7 if level else 8


def _edges(keys: np.ndarray, level: int, buckets: int) -> np.ndarray:
    """Where the bucket of each range of hashes begins among sorted keys."""
    top = 1 << (8 * _width(level))
    limits = np.array([top * b // buckets for b in range(1, buckets)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, limits), [len(keys)]))


def _requests(order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row["vocabulary"], row["places"], row["lengths"], order)
                for level, keys in enumerate(chunk.keys):
                    counts, edges = chunk.counts(level), _edges(keys, level, buckets)
                    some = np.flatnonzero(np.diff(edges))
                    yield pa.RecordBatch.from_pydict({
                        "bucket": pa.array(some, pa.int32()),
                        "level": pa.array([level] * len(some), pa.int32()),
                        "chunk": pa.array([row["chunk"]] * len(some), pa.int64()),
                        "role": pa.array([row["role"]] * len(some), pa.int32()),
                        "grams": [_rising(keys[edges[b] : edges[b + 1]]) for b in some],
                        "counts": [_small(counts[edges[b] : edges[b + 1]]) for b in some],
                    })

    return run


def _answers(table: pa.Table) -> pa.Table:
    """Corpus counts for every request of one bucket and order, and the number of distinct training n-grams."""
    rows = table.to_pylist()
    level = rows[0]["level"]
    grams = [_unrising(r["grams"]) for r in rows]
    sizes = np.cumsum([0, *map(len, grams)])
    distinct, where = _distinct(np.concatenate(grams))
    total = np.zeros(len(distinct), dtype=np.int64)
    fold = np.zeros(len(distinct), dtype=np.int64)
    for i, row in enumerate(rows):
        if row["role"] != HELD_OUT:
            counts = _unsmall(row["counts"])
            total[where[sizes[i] : sizes[i + 1]]] += counts
            if row["role"] == FOLD:
                fold[where[sizes[i] : sizes[i + 1]]] += counts
    mine = [where[sizes[i] : sizes[i + 1]] for i in range(len(rows))]
    known = int((total > 0).sum())
    return pa.table({
        "chunk": table["chunk"],
        "role": table["role"],
        "level": table["level"],
        "bucket": table["bucket"],
        "total": pa.array([_small(total[m]) for m in mine], pa.binary()),
        "fold": pa.array([_small(fold[m]) if r["role"] == FOLD else b"" for m, r in zip(mine, rows, strict=True)], pa.binary()),
        "distinct": pa.array([known if i == 0 and level == 0 else 0 for i in range(len(rows))], pa.int64()),
    })


def _met(chunks: pa.Table, answers: pa.Table, order: int):
    """The chunk with the counts of its distinct n-grams: all of the training texts, and those of the fold."""
    row = chunks.to_pylist()[0]
    chunk = Chunk(row["vocabulary"], row["places"], row["lengths"], order, keys=False)
    total, fold = [], []
    found = sorted(answers.select(["level", "bucket", "total", "fold"]).to_pylist(), key=lambda r: (r["level"], r["bucket"]))
    for level in range(order):
        mine = [r for r in found if r["level"] == level]
        total.append(np.concatenate([_unsmall(r["total"]) for r in mine]))
        fold.append(np.concatenate([_unsmall(r["fold"]) for r in mine]) if row["role"] == FOLD else None)
    return row, chunk, total, fold


def _estimates(chunk: Chunk, counts: list[np.ndarray], tokens: int, run: tuple) -> tuple[np.ndarray, list[np.ndarray]]:
    """For a run of texts the bucket of each token's longest context, and the maximum-likelihood estimates from order 1 up."""
    text, to, low, high = run
    own = [c[p[low:high]] for c, p in zip(counts, chunk.places, strict=True)]
    ends = np.flatnonzero(chunk.words == END)
    texts = int(counts[0][ends[0]]) if len(ends) else 0
    estimates = [own[0] / max(tokens, 1)]
    context = np.full(high - low, tokens, dtype=np.int64)
    for level in range(1, len(own)):
        context = np.empty(high - low, dtype=np.int64)
        context[1:] = own[level - 1][:-1]
        context[chunk.first[text:to] - low] = texts
        estimates.append(own[level] / np.maximum(context, 1))
    bucket = np.minimum(np.frexp(context.astype(np.float64))[1], FREQUENCIES - 1)
    return bucket, estimates


def levels(order: int) -> int:
    """Levels of each estimate on the grid: FREQUENCIES * levels ** order is at most CELLS."""
    most = LEVELS
    while FREQUENCIES * most**order > CELLS:
        most -= 1
    return most


def _level(estimate: np.ndarray, vocabulary: int, most: int) -> np.ndarray:
    """Level 0 for no estimate, then equal steps of its logarithm up to 1."""
    out = np.zeros(len(estimate), dtype=np.int64)
    some = estimate > 0
    share = (np.log2(estimate[some] * (vocabulary + 1)) + LOWEST) / (np.log2(vocabulary + 1) + LOWEST)
    out[some] = 1 + np.clip(np.floor(share * (most - 1)), 0, most - 2).astype(np.int64)
    return out


def _grid(order: int, tokens: int, vocabulary: int):
    """Fold tokens with the fold's counts deleted, summed up on a grid of context bucket and estimates."""
    most = levels(order)

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["cell", "n", *(f"f{i}" for i in range(1, 8))]
        if not chunks.num_rows:
            return pa.table({n: pa.array([], pa.int64() if n in ("cell", "n") else pa.float64()) for n in names})
        _, chunk, total, fold = _met(chunks, answers, order)
        rest = [t - f for t, f in zip(total, fold, strict=True)]
        parts = []
        for run in chunk.runs():
            bucket, estimates = _estimates(chunk, rest, tokens, run)
            cell = bucket.astype(np.int64)
            for estimate in estimates:
                cell = cell * most + _level(estimate, vocabulary, most)
            found, where = np.unique(cell, return_inverse=True)
            parts.append((found, np.bincount(where), *(np.bincount(where, weights=e) for e in estimates)))
        cell, *sums = (np.concatenate(c) for c in zip(*parts, strict=True))
        cells, where = np.unique(cell, return_inverse=True)
        n, *sums = (np.bincount(where, weights=c) for c in sums)
        columns = {"cell": cells, "n": n.astype(np.int64)}
        for i in range(1, 8):
            columns[f"f{i}"] = sums[i - 1] if i <= order else np.zeros(len(cells))
        return pa.table(columns).select(names).cast(pa.schema([(n, pa.int64() if n in ("cell", "n") else pa.float64()) for n in names]))

    return run


def mixture_weights(bucket: np.ndarray, n: np.ndarray, estimates: np.ndarray) -> np.ndarray:
    """EM per context bucket: weights of the components (columns of `estimates`), one row per bucket.

    The start is equal weights; a bucket without held-out tokens takes the weights learned on all of them.
    """
    parts = estimates.shape[1]

    def learn(n, estimates):
        weights = np.full(parts, 1.0 / parts)
        for _ in range(ROUNDS):
            share = weights * estimates
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
            new = (share * n[:, None]).sum(axis=0) / n.sum()
            if np.abs(new - weights).max() < 1e-9:
                break
            weights = new
        # No weight is quite zero, so that no token has probability zero.
        weights = np.maximum(weights, FLOOR)
        return weights / weights.sum()

    out = np.full((FREQUENCIES, parts), 1.0 / parts)
    if n.sum() == 0:
        return out
    out[:] = learn(n, estimates)
    for b in np.unique(bucket):
        out[b] = learn(n[bucket == b], estimates[bucket == b])
    return out


def _scores(order: int, tokens: int, vocabulary: int, weights: np.ndarray):
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        names = {"id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
        if not chunks.num_rows:
            return pa.table({n: pa.array([], kind) for n, kind in names.items()})
        row, chunk, total, _ = _met(chunks, answers, order)
        parts = []
        for run in chunk.runs():
            text, to, low, high = run
            known = total[0][chunk.tokens[low:high]]
            base = np.log10((known + 0.1) / (tokens + 0.1 * (vocabulary + 1)))
            bucket, estimates = _estimates(chunk, total, tokens, run)
            own = weights[bucket]
            probability = own[:, 0] / (vocabulary + 1)
            for i, estimate in enumerate(estimates, 1):
                probability += own[:, i] * estimate
            first = chunk.first[text:to] - low
            parts.append([np.add.reduceat(c, first) for c in ((known > 0).astype(np.int64), base, np.log10(probability))])
        n_known, base, score = (np.concatenate(c) for c in zip(*parts, strict=True))
        columns = {
            "id": row["ids"],
            "held_out": np.full(len(chunk.lengths), row["role"] == HELD_OUT),
            "n_tokens": chunk.lengths,
            "n_known": n_known,
            "base_score": base,
            "score": score,
        }
        return pa.table({n: pa.array(columns[n], kind) for n, kind in names.items()})

    return run


def lm_scores(
    docs: DataFrame, held_out: Column, fold: Column, key: str = "doc_id", text: str = "text", order: int = ORDER
) -> DataFrame:
    """One row per row of `docs`: the key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    `held_out` names the rows that nothing is learned from, `fold` those of the others whose counts are deleted to
    learn the mixture weights. Scores are sums of log10 probabilities over the words and one end token; base_score is
    the add-0.1 unigram estimate. Null and empty texts are the end token alone. Repeated rows count and are scored
    each; null conditions are false. Without training rows every estimate but the uniform one is 0. An empty table gives
    no rows. Other columns are not read. Keys are whole numbers or null.
    """
    if not 1 <= order <= 7:
        raise ValueError("order is from 1 to 7")
    spark = docs.sparkSession
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    role = F.when(held_out, HELD_OUT).when(fold, FOLD).otherwise(TRAIN).cast("int")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("id"), F.col(text).alias("text"), role.alias("role"))
    chunks = stored(rows.mapInArrow(_chunks, CHUNK_SCHEMA), "chunks", "zstd")
    asked = chunks.select("chunk", "role", "lengths", "vocabulary", "places").mapInArrow(_requests(order, buckets), REQUEST_SCHEMA)
    answers = stored(asked.groupBy("bucket", "level").applyInArrow(_answers, ANSWER_SCHEMA), "counts", "zstd")

    sizes = chunks.groupBy("role").agg(F.sum("tokens").alias("n")).collect()  # three rows at most
    tokens = {r["role"]: r["n"] for r in sizes}
    train_tokens = tokens.get(TRAIN, 0) + tokens.get(FOLD, 0)
    vocabulary = answers.agg(F.sum("distinct")).first()[0] or 0

    def met(function, schema, where=None):
        left, right = (t.where(where) if where else t for t in (chunks, answers))
        return left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(function, schema)

    grid = met(_grid(order, train_tokens - tokens.get(FOLD, 0), vocabulary), GRID_SCHEMA, f"role = {FOLD}")
    sums = [F.sum(c).alias(c) for c in ("n", *(f"f{i}" for i in range(1, order + 1)))]
    cells = grid.groupBy("cell").agg(*sums).toPandas()  # CELLS rows at most
    n = cells["n"].to_numpy(dtype=np.float64)
    parts = [np.full(len(n), 1.0 / (vocabulary + 1))] + [cells[f"f{i}"].to_numpy(dtype=np.float64) / np.maximum(n, 1) for i in range(1, order + 1)]
    weights = mixture_weights(cells["cell"].to_numpy(dtype=np.int64) // levels(order) ** order, n, np.stack(parts, axis=1))

    schema = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    found = met(_scores(order, train_tokens, vocabulary, weights), schema)
    return found.select(
        F.nullif("id", F.lit(NO_KEY)).alias(key), "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
