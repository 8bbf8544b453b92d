"""Removal of every word that lies in a run of words found elsewhere, by full-text indexes over shards.

A window is `width` consecutive words. Windows are dealt to shards by content: the smallest hash among the short
word grams of a window (its anchor) is the same wherever the window stands, and neighbouring windows mostly share
it, so a run of windows travels as one passage. Passages whose anchor occurs once in the corpus stay where they
are. A shard builds a compressed FM-index over its passages and streams them against it: matching statistics by
backward search give the places where a whole window occurs at least twice.

Hot content: exact copies are found first and need no search, one text of each is indexed. Anchors that a frequent-items
summary names (a bounded number, broadcast) would fill one shard; their windows are counted one by one by a
128-bit digest, combined map-side. Both ways are exact, so the summary decides only where work is done.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.exact_dedup import exact_dedup
from termloom.llm.fm_index import DEPTH, FMIndex, matching_statistics
from termloom.llm.words import Words, gram_hashes, ranges, row_blocks, words_of
from termloom.settings import stored

WIDTH = 35
GRAM = 8
# An anchor with more runs than this is hot if the summary sees it; at most HOT_ANCHORS are broadcast.
HOT_RUNS = 5_000
HOT_ANCHORS = 512
COUNTERS = 8192
TEXT_BLOCK = 2 << 20
SHARDS_PER_PARTITION = 4
# Stands for a missing key.
NO_KEY = -(2**63)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every `width` neighbours."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Runs:
    """Runs of neighbouring windows of one row that share their anchor: first word (in the block), number of
    windows, anchor, row, and number of the run in its row."""

    def __init__(self, words: Words, hashes: np.ndarray, width: int, gram: int):
        empty = np.empty(0, dtype=np.int64)
        self.first, self.windows, self.anchor, self.row, self.number = empty, empty, empty.astype(np.uint64), empty, empty
        self.times = empty
        if len(hashes) < width:
            return
        grams = gram_hashes(hashes, gram)
        anchors = _sliding_min(grams, width - gram + 1)
        row = words.row_of_word()
        inside = row[: len(anchors)] == row[width - 1 :]
        change = np.ones(len(anchors), dtype=bool)
        change[1:] = (anchors[1:] != anchors[:-1]) | (row[1 : len(anchors)] != row[: len(anchors) - 1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(change)
        windows = np.diff(np.append(first, len(anchors)))
        kept = inside[first]
        first, windows = first[kept], windows[kept]
        # A passage is a pattern of the index, so a long run is cut.
        most = min(width - gram + 1, DEPTH - width)
        parts = -(-windows // most)
        offset = ranges(np.zeros(len(parts), dtype=np.int64), parts) * most
        self.first = np.repeat(first, parts) + offset
        self.windows = np.minimum(np.repeat(windows, parts) - offset, most)
        self.anchor = anchors[self.first]
        self.row = row[self.first]
        starts = np.searchsorted(self.row, np.arange(words.rows))
        self.number = np.arange(len(self.row)) - starts[self.row]
        # Times that the anchor occurs, two for any number: equal windows of one run have it twice in a window.
        twice = np.zeros(len(grams), dtype=bool)
        for distance in range(1, width - gram + 1):
            twice[:-distance] |= grams[:-distance] == grams[distance:]
        place = np.flatnonzero(twice)
        low = np.maximum(place - (width - gram), 0)
        count = np.minimum(place, len(anchors) - 1) - low + 1
        low, count, place = low[count > 0], count[count > 0], place[count > 0]
        window = ranges(low, count)
        window = window[anchors[window] == np.repeat(grams[place], count)]
        self.times = np.ones(len(self.first), dtype=np.int32)
        if len(self.first):
            run = np.maximum(np.searchsorted(self.first, window, side="right") - 1, 0)
            self.times[run] = 2


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def _runs(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_blocks(batches, "text", TEXT_BLOCK):
            words = words_of(_column(batch, "text"))
            runs = Runs(words, words.hashes(), width, gram)
            yield pa.RecordBatch.from_pydict({
                "anchor": _signed(runs.anchor),
                "kid": _column(batch, "kid").to_numpy()[runs.row],
                "th": _column(batch, "th").to_numpy()[runs.row],
                "run": runs.number.astype(np.int32),
                "times": runs.times.astype(np.int32),
            })

    return run


def _joined(words: Words) -> tuple[bytes, np.ndarray]:
    """All words of a block with one space after each, and where each starts there."""
    length = words.end - words.start
    place = np.cumsum(length + 1) - length - 1
    out = np.full(int((length + 1).sum()), 0x20, dtype=np.uint8)
    out[ranges(place, length)] = words.data[ranges(words.start, length)]
    return out.tobytes(), place


def _wanted(batch: pa.RecordBatch, runs: Runs, rows: int) -> np.ndarray:
    """Runs named by the array column `wanted` of their row."""
    lists = _column(batch, "wanted")
    counts = np.diff(lists.offsets.to_numpy())
    base = np.searchsorted(runs.row, np.arange(rows))
    return np.sort(np.repeat(base, counts) + lists.flatten().to_numpy(zero_copy_only=False))


def _passages(width: int, gram: int, shards: int):
    """Passages of the wanted runs: shard, words joined by a space, and where the passage starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_blocks(batches, "text", TEXT_BLOCK):
            words = words_of(_column(batch, "text"))
            runs = Runs(words, words.hashes(), width, gram)
            wanted = _wanted(batch, runs, words.rows)
            first, row = runs.first[wanted], runs.row[wanted]
            body, place = _joined(words)
            last = first + runs.windows[wanted] + width - 2
            end = place[last] + words.end[last] - words.start[last]
            yield pa.RecordBatch.from_pydict({
                "shard": (runs.anchor[wanted] % np.uint64(shards)).astype(np.int32),
                "passage": pa.array([body[a:b] for a, b in zip(place[first].tolist(), end.tolist(), strict=True)], pa.binary()),
                "kid": _column(batch, "kid").to_numpy()[row],
                "th": _column(batch, "th").to_numpy()[row],
                "at": (first - words.offsets[row]).astype(np.int64),
            })

    return run


def _shard(width: int):
    """Word ranges of a shard's passages that lie in windows occurring at least twice."""

    def run(table: pa.Table) -> pa.Table:
        column = table["passage"].combine_chunks()
        seen: dict[bytes, int] = {}
        which = np.array([seen.setdefault(p, len(seen)) for p in column.to_pylist()], dtype=np.int64)
        copies = np.bincount(which)
        words = words_of(pa.array(list(seen), pa.binary()))
        # Symbols from 1; a 0 before every passage and at the end.
        _, symbol = np.unique(words.hashes(), return_inverse=True)
        row = words.row_of_word()
        text = np.zeros(len(symbol) + words.rows + 1, dtype=np.int64)
        text[np.arange(len(symbol)) + row + 1] = symbol + 1
        start = words.offsets[:-1] + np.arange(words.rows) + 1
        end = words.offsets[1:] + np.arange(words.rows) + 1
        single = copies == 1
        statistics = np.zeros(len(text), dtype=np.int64)
        if single.any():
            statistics = matching_statistics(FMIndex(text), text, start[single], end[single])
        # A passage that stands twice needs no search: all its windows do.
        windows = words.counts - width + 1
        many = np.flatnonzero(~single)
        statistics[ranges(start[many], windows[many])] = width
        hit = np.concatenate(([False], statistics >= width, [False]))
        a = np.flatnonzero(hit[1:] & ~hit[:-1])
        b = np.flatnonzero(hit[:-1] & ~hit[1:])
        passage = np.searchsorted(start, a, side="right") - 1
        # Every row of the shard gets the ranges of its passage.
        base = np.searchsorted(passage, np.arange(words.rows + 1))
        count = np.diff(base)[which]
        pick = ranges(base[which], count)
        rows = np.repeat(np.arange(len(which)), count)
        at = table["at"].to_numpy()[rows]
        return pa.table({
            "kid": table["kid"].to_numpy()[rows],
            "th": table["th"].to_numpy()[rows],
            "a": at + (a - start[passage])[pick],
            "b": at + (b - start[passage])[pick] + width - 1,
        })

    return run


def _windows(width: int, gram: int):
    """Each window of the wanted runs by a 128-bit digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_blocks(batches, "text", TEXT_BLOCK):
            words = words_of(_column(batch, "text"))
            hashes = words.hashes()
            runs = Runs(words, hashes, width, gram)
            wanted = _wanted(batch, runs, words.rows)
            at = ranges(runs.first[wanted], runs.windows[wanted])
            row = np.repeat(runs.row[wanted], runs.windows[wanted])
            one = gram_hashes(hashes, width)
            two = gram_hashes(hashes ^ np.uint64(0xA0761D6478BD642F), width)
            yield pa.RecordBatch.from_pydict({
                "one": _signed(one[at] if len(at) else one[:0]),
                "two": _signed(two[at] if len(at) else two[:0]),
                "kid": _column(batch, "kid").to_numpy()[row],
                "th": _column(batch, "th").to_numpy()[row],
                "a": (at - words.offsets[row]).astype(np.int64),
            })

    return run


def _cut(kind: str, width: int, rest: str, as_is: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_blocks(batches, "text", TEXT_BLOCK):
            words = words_of(_column(batch, "text"))
            total = len(words.start)
            cover = _column(batch, "cover")
            depth = np.zeros(total + 1, dtype=np.int64)
            counts = np.diff(cover.offsets.to_numpy())
            base = np.repeat(words.offsets[:-1], counts)
            pairs = cover.flatten()
            for name, sign in (("a", 1), ("b", -1)):
                np.add.at(depth, base + pairs.field(name).to_numpy(zero_copy_only=False), sign)
            gone = np.cumsum(depth)[:total] > 0
            copied = _column(batch, "copied").to_numpy(zero_copy_only=False).astype(bool) & (words.counts >= width)
            row = words.row_of_word()
            gone |= copied[row]
            removed = np.bincount(row[gone], minlength=words.rows)
            kept = np.flatnonzero(~gone)
            length = words.end[kept] - words.start[kept]
            joint = np.ones(len(kept), dtype=np.int64)
            joint[np.flatnonzero(np.diff(row[kept], append=-1))] = 0
            place = np.cumsum(length + joint) - length - joint
            out = np.full(int((length + joint).sum()), 0x20, dtype=np.uint8)
            out[ranges(place, length)] = words.data[ranges(words.start[kept], length)]
            edges = np.append(place, len(out))[np.searchsorted(row[kept], np.arange(words.rows + 1))]
            texts = pa.LargeStringArray.from_buffers(words.rows, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes()))
            texts = texts.cast(pa.string())
            if as_is:
                texts = pc.if_else(pa.array(removed == 0), _column(batch, "text"), texts)
            yield pa.RecordBatch.from_arrays(
                [_column(batch, "id"), pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), texts, _column(batch, "rest")],
                names=["id", "n_words", "n_removed", "kept", "rest"],
            )

    return run, f"id {kind}, n_words long, n_removed long, kept string, rest {rest}"


def substring_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM,
    carry: tuple[str, ...] = (), as_is: bool = False,
) -> DataFrame:
    """One row per row of `docs`: the key, n_words, n_removed, kept (the words left, joined by one space).

    A word goes if a window of `width` words that covers it also starts anywhere else, in the same text or another.
    `width` is at least `gram` and below the depth of the index. Null and empty texts have no words; texts shorter
    than a window lose none. Repeated rows are copies of each other, so every window of theirs is found twice. Rows
    without a key are told apart by their texts. An empty table gives no rows. Other columns are not read, except
    those named in `carry`, which come out in a struct `rest`. With `as_is` a text that loses nothing keeps its white
    space in kept.
    """
    if not gram <= width < DEPTH:
        raise ValueError("width must be at least gram and below the depth of the index")
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = SHARDS_PER_PARTITION * partitions
    kind = docs.schema[key].dataType.simpleString()
    rest = F.struct(*carry) if carry else F.struct(F.lit(None).cast("boolean").alias("none"))
    body, kid = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY))
    whole = docs.select(body.alias("text"), kid.alias("kid"), F.xxhash64(body).alias("th"), rest.alias("rest"))
    rows = whole.drop("rest")
    place = ["kid", "th"]

    # Frequent anchors, read off the scan without a shuffle.
    runs_schema = "anchor long, kid long, th long, run int, times int"
    top = rows.mapInArrow(_runs(width, gram), runs_schema).agg(
        F.expr(f"approx_top_k(anchor, {HOT_ANCHORS}, {COUNTERS})").alias("top")
    )
    hot = [r["item"] for r in top.select(F.explode("top").alias("t")).select("t.item", "t.count").collect() if r["count"] > HOT_RUNS]
    hot_anchor = F.broadcast(spark.createDataFrame([(a,) for a in hot], "anchor long"))

    # Texts move once, by place; the three passes over them reuse that exchange.
    dealt = whole.repartition(partitions, *place)
    copies = exact_dedup(rows.select("text", F.struct(*place).alias("place")), key="place")
    copies = copies.select("place.kid", "place.th", (F.col("group_size") > 1).alias("copied"), "kept").dropDuplicates(place)
    copies = stored(copies, "copies")
    known = dealt.join(copies.hint("shuffle_hash"), place)
    once = known.where("kept").select("text", *place)

    runs = once.mapInArrow(_runs(width, gram), runs_schema)
    cold = runs.join(hot_anchor, "anchor", "left_anti").repartition(partitions, "anchor")
    often = cold.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor")
    again = cold.join(often.hint("shuffle_hash"), "anchor", "left_semi")

    def with_runs(chosen: DataFrame) -> DataFrame:
        lists = chosen.groupBy(*place).agg(F.collect_list("run").alias("wanted"))
        return once.join(lists.hint("shuffle_hash"), place)

    passages = with_runs(again).mapInArrow(
        _passages(width, gram, shards), "shard int, passage binary, kid long, th long, at long"
    )
    found = passages.groupBy("shard").applyInArrow(_shard(width), "kid long, th long, a long, b long")
    if hot:
        single = with_runs(runs.join(hot_anchor, "anchor", "left_semi")).mapInArrow(
            _windows(width, gram), "one long, two long, kid long, th long, a long"
        )
        twice = single.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one", "two")
        # Neighbouring windows are one range each; ranges may overlap.
        windows = single.join(twice, ["one", "two"], "left_semi").select(*place, "a", (F.col("a") + width).alias("b"))
        found = found.unionByName(windows)
    cover = found.groupBy(*place).agg(F.collect_list(F.struct("a", "b")).alias("cover"))
    cut, schema = _cut(kind, width, whole.schema["rest"].dataType.simpleString(), as_is)
    none = F.from_json(F.lit("[]"), "array<struct<a:long,b:long>>")
    last = known.join(cover.hint("shuffle_hash"), place, "left").select(
        F.nullif("kid", F.lit(NO_KEY)).cast(kind).alias("id"), "text", "copied", F.coalesce("cover", none).alias("cover"), "rest"
    )
    found = last.mapInArrow(cut, schema).withColumnRenamed("id", key)
    return found if carry else found.drop("rest")
