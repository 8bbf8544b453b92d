"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features of a text, all hashed into one table of fixed size: words, pairs of neighbouring words, and
words and pairs once more in a coarse view of a word (kinds of bytes in it, its last byte, whether it
repeats the word before), so that unseen words still say something. A feature's value is its share of
the text's features times SCALE.

Training reads a bounded sample of the labelled rows (`max_rows`, chosen by a hash of the key, so the
same rows on every run) in one task; the model is one table of 2^bits floats, broadcast to the tasks that
score. Scoring is a sparse dot product per text over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.words import Words, gram_hashes, mixed, row_blocks, words_of

BITS = 18
MAX_ROWS = 12_000
EPOCHS = 2
SCALE = 12.0
ALPHA, BETA, L1, L2 = 0.15, 1.0, 0.02, 0.02
# Bytes of text whose features are in memory at a time.
SCORE_BLOCK = 2 << 20
# Longer texts train on their mean over parts of this many words, so a text of any length takes bounded memory.
_SALTS = {name: np.uint64(number * 0x9E3779B97F4A7C15 % (1 << 64)) for number, name in enumerate(("word", "pair", "view", "views"), 1)}

# Kinds of bytes, as bits of the coarse view.
_KINDS = np.zeros(256, dtype=np.uint8)
for _bit, _bytes in enumerate((range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), b".,;:?!'\"-()", range(0x80, 0x100))):
    _KINDS[list(_bytes)] = 1 << _bit
_KINDS[(_KINDS == 0)] = 1 << 5
_KINDS[[0x20, *range(0x09, 0x0E)]] = 0


def _views(words: Words, hashes: np.ndarray) -> np.ndarray:
    kinds = np.bitwise_or.reduceat(_KINDS[words.data], words.start).astype(np.uint64)
    last = words.data[words.end - 1].astype(np.uint64)
    last[last >= 0x80] = 0x80
    letter = (_KINDS[words.data[words.end - 1]] & 0b10111) > 0
    last[letter & (last < 0x80)] = 0
    repeats = np.zeros(len(hashes), dtype=np.uint64)
    repeats[1:] = hashes[1:] == hashes[:-1]
    length = np.minimum(words.end - words.start, 24).astype(np.uint64) // np.uint64(4)
    return kinds | (last << np.uint64(8)) | (repeats << np.uint64(16)) | (length << np.uint64(20))


def features(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Table places of all features of a block, and for each the row it belongs to."""
    if len(words.start) == 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    hashes, row = words.hashes(), words.row_of_word()
    views = mixed(_views(words, hashes))
    together = row[1:] == row[:-1]
    parts = [hashes ^ _SALTS["word"], gram_hashes(hashes, 2)[together] ^ _SALTS["pair"], views ^ _SALTS["view"],
             gram_hashes(views, 2)[together] ^ _SALTS["views"]]
    rows = [row, row[1:][together], row, row[1:][together]]
    places = mixed(np.concatenate(parts)) >> np.uint64(64 - bits)
    return places.astype(np.int64), np.concatenate(rows)


def _trainer(bits: int, epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in row_blocks(batches, "text", SCORE_BLOCK):
            words = words_of(batch.column(batch.schema.get_field_index("text")))
            places, rows = features(words, bits)
            pairs, count = np.unique((rows << bits) | places, return_counts=True)
            ends = np.searchsorted(pairs >> bits, np.arange(words.rows + 1))
            table = (pairs & ((1 << bits) - 1)).astype(np.int32)
            labels = batch.column(batch.schema.get_field_index("label")).to_pylist()
            for i, label in enumerate(labels):
                a, b = ends[i], ends[i + 1]
                total = max(1, int(count[a:b].sum()))
                examples.append((table[a:b].copy(), (count[a:b] * (SCALE / total)).astype(np.float32), label))
        weights, bias = follow_the_leader(examples, bits, epochs)
        yield pa.RecordBatch.from_pydict({"bias": [float(bias)], "weights": [weights.tobytes()], "rows": [len(examples)]})

    return run


def follow_the_leader(examples: list, bits: int, epochs: int) -> tuple[np.ndarray, float]:
    """FTRL-proximal updates, one example after the other: (places, values, 0 or 1)."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0

    def weight(z_part, n_part):
        shrunk = np.sign(z_part) * np.maximum(np.abs(z_part) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n_part)) / ALPHA + L2)

    for _ in range(epochs):
        for places, values, label in examples:
            z_part, n_part = z[places], n[places]
            w = weight(z_part, n_part)
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
            score = 1.0 / (1.0 + np.exp(-np.clip(np.dot(w, values) + bias, -35, 35)))
            wrong = score - label
            gradient = wrong * values
            squares = gradient * gradient
            z[places] = z_part + gradient - (np.sqrt(n_part + squares) - np.sqrt(n_part)) / ALPHA * w
            n[places] = n_part + squares
            bias_z += wrong - (np.sqrt(bias_n + wrong * wrong) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += wrong * wrong
    return weight(z, n).astype(np.float32), float(-bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA))


def fold(key: Column, folds: int) -> Column:
    return F.crc32(key.cast("string")) % folds


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    max_rows: int = MAX_ROWS, bits: int = BITS, epochs: int = EPOCHS,
) -> tuple[bytes, float]:
    """Weights (2^bits floats) and bias. Rows without key, label or a label of 0 or 1 are not used; of
    repeated labels of one key the largest holds. No labelled row at all gives weights of zero."""
    usable = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label"))
    usable = usable.where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    chosen = usable.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").select("text", "label", F.xxhash64("id").alias("turn"))
    one = sample.repartition(1).sortWithinPartitions("turn").select("text", "label")
    found = one.mapInArrow(_trainer(bits, epochs), "bias double, weights binary, rows long").collect()
    if not found:
        return np.zeros(1 << bits, dtype=np.float32).tobytes(), 0.0
    return bytes(found[0]["weights"]), found[0]["bias"]


def _probabilities(texts: pa.Array, model: tuple[bytes, float]) -> np.ndarray:
    weights = np.frombuffer(model[0], dtype=np.float32)
    words = words_of(texts)
    places, rows = features(words, len(weights).bit_length() - 1)
    sums = np.bincount(rows, weights=weights[places], minlength=words.rows)
    total = np.maximum(np.bincount(rows, minlength=words.rows), 1)
    return 1.0 / (1.0 + np.exp(-np.clip(sums * SCALE / total + model[1], -35, 35)))


def score(docs: DataFrame, model: tuple[bytes, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: the key and score, the probability of label 1. Null and empty texts get
    the probability that the bias alone gives. Repeated rows are scored each; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits floats, a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_blocks(batches, "text", SCORE_BLOCK):
            value = pa.array(_probabilities(batch.column(1), shared.value))
            yield pa.RecordBatch.from_arrays([batch.column(0), value], names=["id", "score"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", key)


def accepted(docs: DataFrame, model: tuple[bytes, float], text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose score is at least `least`. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_blocks(batches, text, SCORE_BLOCK):
            good = _probabilities(batch.column(batch.schema.get_field_index(text)), shared.value) >= least
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
