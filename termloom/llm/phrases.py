"""Collocations: phrases of several words that occur together more often than their parts suggest.

Phrases are counted by length. A phrase of n words can be frequent only if the two phrases of n - 1 words in it
are, so each pass over the texts counts what a filter of the last pass lets through. The filter is a bitmap of fixed
size, sent to the tasks; it lets some rare phrases through, never drops a frequent one, and counts are exact.

A task counts in a HAT-trie: a shallow trie of word numbers over hash containers. A container holds the rest of its
phrases and bursts into one container per next word when it is full. When the trie has too many entries its largest
subtrees are spilled whole, as runs sorted by prefix partition and phrase and packed. A prefix partition is a hash of
language and first words; there are PARTITIONS for each input partition, so their size does not grow with the input.
Spark deals the runs out, and the runs of each prefix partition are merged.

Scores, cuts and the removal of phrases that lie inside longer ones are joins and aggregations of frequent phrases.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.words import Words, buffers, gram_hashes, mixed, row_blocks
from termloom.settings import stored

LENGTHS = 5
# Bytes of text counted at a time before the counts go into the trie.
BLOCK = 4 << 20
# Entries of a trie before subtrees are spilled, and of a container before it bursts.
ENTRIES, BURST = 500_000, 8192
# Words with numbers before a task spills everything and numbers anew.
NUMBERED = 1_000_000
# Entries spilled together at least, prefix partitions per input partition, and words of a prefix.
ROWS, PARTITIONS, PREFIX = 1 << 18, 8, 3
# Bits of the filter: a broadcast of 16 MB whatever the input.
FILTER_BITS = 27
# Bits that Spark's bitmap functions keep in a row.
BUCKET_BITS = 4096 * 8

RUN = "prefix int, lang string, phrases binary, lengths binary, counts binary"
_PACKED = pa.schema([("prefix", pa.int32()), ("lang", pa.string()), ("phrases", pa.binary()), ("lengths", pa.binary()), ("counts", pa.binary())])
_MERGED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_INSIDE = ~_BREAK
_INSIDE[list(b" \t")] = False
_FOLDED = np.where(_INSIDE, _LOWER, np.uint8(0x20))


class Container:
    """Counts of the rests of phrases, or, once burst, containers by next word. A rest is the big-endian numbers of
    its words."""

    __slots__ = ("table", "children", "entries")

    def __init__(self):
        self.table: dict[bytes, int] | None = {}
        self.children: dict[bytes, Container] | None = None
        self.entries = 0

    def add(self, rests: list[bytes], counts: list[int]) -> int:
        """Returns how many entries are new."""
        before = self.entries
        if self.table is None:
            self._pass_on(zip(rests, counts, strict=True))
            return self.entries - before
        get, table = self.table.get, self.table
        for rest, count in zip(rests, counts, strict=True):
            table[rest] = get(rest, 0) + count
        self.entries = len(table)
        if self.entries > BURST and len(next(iter(table))) > 4:
            self.table, self.children, self.entries = None, {}, 0
            self._pass_on(sorted(table.items()))
        return self.entries - before

    def _pass_on(self, pairs) -> None:
        for word, group in groupby(pairs, key=lambda pair: pair[0][:4]):
            child = self.children.get(word)
            if child is None:
                child = self.children[word] = Container()
            rests, counts = zip(*group, strict=True)
            self.entries += child.add([r[4:] for r in rests], counts)

    def gather(self, prefix: bytes, numbers: list[bytes], counts: list[int]) -> None:
        """Append all phrases below with their counts."""
        if self.table is not None:
            numbers += [prefix + rest for rest in self.table]
            counts += self.table.values()
            return
        for word, child in self.children.items():
            child.gather(prefix + word, numbers, counts)


class HatTrie:
    """Phrases of one length with their counts; the first level is language and first word (of longer phrases)."""

    def __init__(self, length: int, partitions: int):
        self.length, self.partitions = length, partitions
        self.subtrees: dict[tuple[str, bytes], Container] = {}
        self.entries = 0
        self.number: dict[int, int] = {}
        self.words: list[bytes] = []
        self.hashes: list[int] = []

    def add(self, names: list[str], lang: np.ndarray, phrases: np.ndarray, counts: np.ndarray) -> None:
        """`phrases`: a row of word numbers each; `lang`: the place of its language in `names`."""
        order = np.lexsort((*phrases.T[::-1], lang))
        lang, phrases, counts = lang[order], phrases[order], counts[order].tolist()
        head = 4 * min(1, self.length - 1)
        numbers = np.ascontiguousarray(phrases.astype(">i4")).view(f"V{4 * self.length}").ravel().tolist()
        new = np.diff(lang, prepend=-1) != 0
        if head:
            new |= np.diff(phrases[:, 0], prepend=-1) != 0
        starts = np.flatnonzero(new).tolist()
        for at, to in zip(starts, [*starts[1:], len(numbers)], strict=True):
            key = names[lang[at]], numbers[at][:head]
            subtree = self.subtrees.get(key)
            if subtree is None:
                subtree = self.subtrees[key] = Container()
            self.entries += subtree.add([x[head:] for x in numbers[at:to]], counts[at:to])

    def numbers(self, hashes: np.ndarray, text) -> np.ndarray:
        """The numbers of words given by their hashes; `text(i)` gives the bytes of a word that has none yet."""
        get, out = self.number.get, np.empty(len(hashes), dtype=np.int64)
        for i, h in enumerate(hashes.tolist()):
            found = get(h)
            if found is None:
                found = self.number[h] = len(self.words)
                self.words.append(text(i))
                self.hashes.append(h)
            out[i] = found
        return out

    def spill(self, keep: int) -> Iterator[pa.RecordBatch]:
        """The largest subtrees, until `keep` entries are left, as packed runs."""
        largest = [(-s.entries, key) for key, s in self.subtrees.items()]
        heapq.heapify(largest)
        words, hashes = pa.array(self.words, pa.binary()).cast(pa.string()), np.array(self.hashes, dtype=np.uint64)
        keys: list[tuple[str, bytes]] = []
        size = 0
        while largest and self.entries > keep:
            entries, key = heapq.heappop(largest)
            keys.append(key)
            size -= entries
            self.entries += entries
            if size >= ROWS:
                yield _packed(*self._run(keys, words, hashes))
                keys, size = [], 0
        if keys:
            yield _packed(*self._run(keys, words, hashes))
        if not self.subtrees:
            self.number.clear()
            self.words.clear()
            self.hashes.clear()

    def _run(self, keys: list[tuple[str, bytes]], words: pa.Array, hashes: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
        """Prefix partition, language, phrase and count of all entries of some subtrees, in this order."""
        numbers, counts, ends = [], [], [0]
        for lang, first in keys:
            self.subtrees.pop((lang, first)).gather(first, numbers, counts)
            ends.append(len(numbers))
        columns = np.frombuffer(b"".join(numbers), dtype=">i4").reshape(-1, self.length).T.astype(np.int32)
        subtree = np.repeat(np.arange(len(keys)), np.diff(ends))
        names = sorted({lang for lang, _ in keys})
        lang = np.array([names.index(lang) for lang, _ in keys], dtype=np.int32)[subtree]
        prefix = _lang_hash(names)[lang]
        for c in columns[:PREFIX]:
            prefix = mixed(prefix ^ hashes[c])
        prefix = (prefix % np.uint64(self.partitions)).astype(np.int32)
        phrase = pc.binary_join_element_wise(*[words.take(pa.array(c)) for c in columns], " ")
        rows = pa.table({"prefix": prefix, "lang": pa.array(names).take(pa.array(lang)), "phrase": phrase, "f": np.array(counts, dtype=np.int64)})
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("prefix", "lang", "phrase")]))
        return tuple(rows.column(c).combine_chunks() for c in rows.column_names)


def _packed(prefix: pa.Array, lang: pa.Array, phrase: pa.Array, f: pa.Array) -> pa.RecordBatch:
    """A sorted run as one row per prefix partition and language, its columns compressed."""
    part, name = prefix.to_numpy(), lang.dictionary_encode()
    code = name.indices.to_numpy()
    starts = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
    data, offsets = buffers(phrase)
    counts, codec = f.to_numpy(), zstandard.ZstdCompressor(level=1)
    cells = [
        [codec.compress(x.tobytes()) for x in (data[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1]).astype(np.int32), counts[a:b])]
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True)
    ]
    sizes = [pa.array(c, pa.binary()) for c in zip(*cells, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[starts]), lang.take(pa.array(starts)), *sizes], schema=_PACKED)


def unpacked(rows: pa.Table) -> pa.Table:
    """lang, phrase, f of packed runs."""
    parts = []
    for row in rows.select(["lang", "phrases", "lengths", "counts"]).to_pylist():
        lengths, counts = (np.frombuffer(zstandard.decompress(row[c]), dtype=t) for c, t in (("lengths", np.int32), ("counts", np.int64)))
        offsets = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        phrase = pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(zstandard.decompress(row["phrases"]))])
        parts.append(pa.table({"lang": pa.repeat(pa.scalar(row["lang"], pa.string()), len(lengths)), "phrase": phrase, "f": counts}))
    return pa.concat_tables(parts)


def _lang_hash(langs: list[str]) -> np.ndarray:
    """A fixed 64-bit hash of each language name."""
    out = []
    for lang in langs:
        h = 1469598103934665603
        for b in lang.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        out.append(h)
    return mixed(np.array(out, dtype=np.uint64))


class Tokens:
    """The words of a block of texts: bytes, hashes, language, and how many words follow in the same piece."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        raw, rows = buffers(text)
        inside, data = _INSIDE[raw], _FOLDED[raw]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[rows] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.words = Words(data, start, end, np.searchsorted(start, rows))
        self.hashes = self.words.hashes()
        coded = lang.fill_null("und").dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        row = self.words.row_of_word()
        self.lang = coded.indices.to_numpy()[row]
        self.salt = _lang_hash(self.langs)[self.lang]
        # Words of one piece have the same number of breaks before them, and the same row.
        piece = np.cumsum(_BREAK[raw], dtype=np.int32)[start].astype(np.int64) + row * (len(data) + 1)
        last = np.flatnonzero(np.diff(piece, append=-1))
        self.left = np.repeat(last, np.diff(last, prepend=-1)) - np.arange(len(start)) if len(start) else piece

    def word(self, i: int) -> bytes:
        return self.words.data[self.words.start[i] : self.words.end[i]].tobytes()

    def grams(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases of `length` words begin, and their hashes, which tell languages apart."""
        at = np.flatnonzero(self.left[: len(self.hashes) - length + 1] >= length - 1)
        hashes = gram_hashes(self.hashes, length)[at] if len(at) else np.empty(0, dtype=np.uint64)
        return at, mixed(hashes ^ self.salt[at])


def _bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _possible(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = _bits(hashes)
    return (bitmap[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool)


def _count(tokens: Tokens, trie: HatTrie, bitmap: np.ndarray | None) -> None:
    """Add the phrases of a block whose two parts pass the filter of the shorter length."""
    at, hashes = tokens.grams(trie.length)
    if bitmap is not None and len(at):
        shorter, passed = tokens.grams(trie.length - 1)
        fits = np.zeros(len(tokens.hashes) + 1, dtype=bool)
        fits[shorter[_possible(bitmap, passed)]] = True
        kept = fits[at] & fits[at + 1]
        at, hashes = at[kept], hashes[kept]
    if not len(at):
        return
    _, place, counts = np.unique(hashes, return_index=True, return_counts=True)
    at = at[place]
    spots = at[:, None] + np.arange(trie.length)
    each, first, inverse = np.unique(tokens.hashes[spots.ravel()], return_index=True, return_inverse=True)
    spots = spots.ravel()
    numbers = trie.numbers(each, lambda i: tokens.word(spots[first[i]]))[inverse].reshape(-1, trie.length)
    trie.add(tokens.langs, tokens.lang[at], numbers, counts)


def runs(docs: DataFrame, length: int, partitions: int, bitmap=None) -> DataFrame:
    """The counts of each task as packed runs. For length 1 the empty phrase has the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, words = HatTrie(length, partitions), {}
        fits = None if bitmap is None else np.frombuffer(bitmap.value, dtype=np.uint8)
        for batch in row_blocks(batches, "text", BLOCK):
            tokens = Tokens(batch.column(0), batch.column(1))
            _count(tokens, trie, fits)
            if length == 1:
                for lang, n in zip(tokens.langs, np.bincount(tokens.lang, minlength=len(tokens.langs)).tolist(), strict=True):
                    words[lang] = words.get(lang, 0) + n
            if trie.entries > ENTRIES or len(trie.words) > NUMBERED:
                yield from trie.spill(ENTRIES // 2 if len(trie.words) <= NUMBERED else 0)
        yield from trie.spill(0)
        if any(words.values()):
            langs = sorted(lang for lang, n in words.items() if n)
            empty = pa.array([""] * len(langs))
            yield _packed(pa.array([0] * len(langs), pa.int32()), pa.array(langs), empty, pa.array([words[x] for x in langs], pa.int64()))

    return docs.select("text", "lang").mapInArrow(run, RUN)


def merged(found: DataFrame, at_least: int) -> DataFrame:
    """lang, phrase, f: the counts of packed runs added up, from `at_least` on."""

    def merge(rows: pa.Table) -> pa.Table:
        sums = unpacked(rows).group_by(["lang", "phrase"]).aggregate([("f", "sum")])
        sums = sums.filter(pc.or_(pc.greater_equal(sums["f_sum"], at_least), pc.equal(sums["phrase"], "")))
        return pa.table([sums["lang"], sums["phrase"].cast(pa.string()), sums["f_sum"]], schema=_MERGED)

    return found.groupBy("prefix").applyInArrow(merge, "lang string, phrase string, f long")


def filter_bits(frequent: DataFrame, length: int) -> bytes:
    """The bitmap of frequent phrases of one length: at most 2^FILTER_BITS bits, however many phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_blocks(batches, "text", BLOCK):
            _, hashes = Tokens(batch.column(0), batch.column(1)).grams(length)
            yield pa.RecordBatch.from_arrays([pa.array(_bits(hashes))], names=["bit"])

    bits = frequent.select(F.col("phrase").alias("text"), "lang").mapInArrow(run, "bit long")
    parts = bits.groupBy(F.expr(f"bit div {BUCKET_BITS}").alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("bit") % BUCKET_BITS).alias("part")
    )
    bitmap = bytearray(1 << (FILTER_BITS - 3))
    for row in parts.collect():
        at = row["bucket"] * BUCKET_BITS // 8
        bitmap[at : at + BUCKET_BITS // 8] = row["part"]
    return bytes(bitmap)


def frequent_phrases(docs: DataFrame, at_least: int, longest: int = LENGTHS) -> DataFrame:
    """lang, words, phrase, f of all phrases up to `longest` words with f >= at_least, and the empty phrase of 0 words
    with the number of all words of a language. Stored."""
    spark, levels, bitmap = docs.sparkSession, [], None
    partitions = PARTITIONS * max(1, docs.rdd.getNumPartitions())
    for length in range(1, longest + 1):
        counts = merged(runs(docs, length, partitions, bitmap), at_least)
        level = stored(counts.withColumn("words", F.when(F.col("phrase") == "", 0).otherwise(length)), f"phrases{length}")
        levels.append(level)
        if length < longest:
            bitmap = spark.sparkContext.broadcast(filter_bits(level.where("words > 0"), length))
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    return whole


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", at_least: int = 100, longest: int = LENGTHS, share: int = 100, top: int = 2000,
) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z only) and cut into pieces at . , ; : ! ? and line ends; phrases of 2 to `longest` words,
    separated by blanks or tabs, lie within a piece. a is the phrase's count, l and r those of its two parts at the cut
    with the lowest score, floor(1000 * a * n / (l * r)); n counts all words of the language. Phrases inside a longer
    phrase that occurs in at least `share` percent of a are dropped. Null texts count as empty, a null language as
    "und". Repeated rows count each; ties are broken by a, then by the phrase; an empty table gives no rows. Other
    columns are not read. Words are told apart by 64-bit hashes inside a block, phrases by their text.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    found = frequent_phrases(rows, at_least, longest)
    counts = found.where("words > 0").select("lang", F.col("phrase").alias("part"), "f")
    n = found.where("words = 0").select("lang", F.col("f").alias("n"))
    candidates = found.where("words > 1")

    word = F.split("phrase", " ")

    def span(start, length):
        return F.array_join(F.slice(F.col("word"), start, length), " ")

    if share >= 100:
        # A phrase as frequent as one it lies in is as frequent as one that has one word more.
        inside = F.array(span(F.lit(1), F.col("words") - 1), span(F.lit(2), F.col("words") - 1))
    else:
        inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(
            F.sequence(F.lit(1), F.col("words") - size + 1), lambda start: span(start, size))))
    longer = candidates.where("words > 2").withColumn("word", word)
    covered = longer.select("lang", F.explode(inside).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("over"))
    left = candidates.join(covered, ["lang", "phrase"], "left").where(
        F.col("over").isNull() | (F.lit(100) * F.col("over") < F.lit(share) * F.col("f"))
    )
    cuts = left.withColumn("word", word).select("lang", "phrase", F.col("f").alias("a"), "word", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", span(F.lit(1), F.col("k")).alias("first"), span(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(n, "lang")
    wide = "cast({} as decimal(19, 0))"
    score = F.expr(f"cast((1000BD * {wide.format('a')} * {wide.format('n')}) div ({wide.format('l')} * {wide.format('r')}) as bigint)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.select("lang", "phrase", "cut.*").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
