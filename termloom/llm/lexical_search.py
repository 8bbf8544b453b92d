"""Ranked search for texts by weighted terms, by branch and bound in FP-trees of documents.

Every document is restricted to the terms of the items that are asked for. Terms are ordered by document frequency, so
documents with the same frequent terms share a path of a trie; documents are dealt to shards, each with a trie of its
own. A subtree knows the largest term frequency of each term below it and the smallest m, which bound the score of any
document below for any item. The trie is searched depth-first, best child first; an item leaves a subtree whose bound
cannot beat its k-th best document. Children of a few documents share a leaf, where documents are scored exactly. The k
best of every shard are ranked again over all shards.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.words import ranges, row_blocks
from termloom.settings import stored

# Terms of items (with repeats between items) that are sent to the tasks in one pass over the documents.
PASS_TERMS = 1 << 20
# Postings of a shard, documents of a leaf, items that are searched together.
SHARD_POSTINGS, LEAF, ITEMS = 2 << 20, 8, 1024
# Bytes of text read at a time, and of one text counted at a time.
BLOCK, SLICE = 4 << 20, 1 << 20
NO_ID = np.iinfo(np.int64).max

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def term_counts(text: str) -> Counter:
    """How often each term (as UTF-8) occurs in a text."""
    data, counts, at = text.encode().translate(_TABLE), Counter(), 0
    while at < len(data):
        to = data.find(b" ", at + SLICE)
        to = len(data) if to < 0 else to
        counts.update(data[at:to].split())
        at = to
    return counts


def _vectors(docs: DataFrame, vocabulary) -> DataFrame:
    """id, row (place within its task), n, and the numbers and frequencies of the vocabulary's terms of each row."""
    kind = docs.schema["id"].dataType.simpleString()
    numbers: dict[bytes, int] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not numbers:
            numbers.update((term.encode(), i) for i, term in enumerate(vocabulary.value))
        row = 0
        for batch in row_blocks(batches, "text", BLOCK):
            sizes, ends, terms, times = [], [0], [], []
            for text in batch.column(1).to_pylist():
                counts = term_counts(text or "")
                sizes.append(counts.total())
                found = counts.keys() & numbers.keys()
                terms += [numbers[t] for t in found]
                times += [counts[t] for t in found]
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((terms, pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.arange(row, row + batch.num_rows)), pa.array(sizes, pa.int64()), *lists], names=["id", "row", "n", "terms", "times"]
            )
            row += batch.num_rows

    return docs.mapInArrow(run, f"id {kind}, row long, n long, terms array<int>, times array<long>")


def gain(times: np.ndarray, m) -> np.ndarray:
    return 1_000_000_000 * times // (1000 * times + 20 * m)


class Node:
    """A subtree: its documents, the largest frequency of each of its terms, the least m and the least id."""

    __slots__ = ("lo", "hi", "terms", "times", "m", "least_id", "children")

    def __init__(self, lo, hi, terms, times, m, least_id, children):
        self.lo, self.hi, self.terms, self.times, self.m, self.least_id, self.children = lo, hi, terms, times, m, least_id, children


class Tree:
    """The FP-tree of documents given as term lists one after the other. `rank`: place of each term by frequency."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, size: np.ndarray, terms: np.ndarray, times: np.ndarray, rank: np.ndarray):
        row = np.repeat(np.arange(len(ids)), size)
        by_rank = np.lexsort((rank[terms], row))
        terms, times, start = terms[by_rank], times[by_rank], np.cumsum(size) - size
        path = rank[terms].astype(">u4")
        keys = [path[a : a + n].tobytes() for a, n in zip(start.tolist(), size.tolist(), strict=True)]
        order = np.array(sorted(range(len(ids)), key=keys.__getitem__), dtype=np.int64)
        along = ranges(start[order], size[order])
        self.ids, self.m, self.size = ids[order], m[order], size[order]
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.path, self.terms, self.times = path[along].astype(np.int64), terms[along], times[along]
        self.root = self._subtree(0, len(ids)) if len(ids) else None

    def _shared(self, lo: int, hi: int) -> int:
        """How many first terms all documents of a range share: those that its first and last one do."""
        n = min(self.size[lo], self.size[hi - 1])
        a, b = self.start[lo], self.start[hi - 1]
        differ = np.flatnonzero(self.path[a : a + n] != self.path[b : b + n])
        return int(differ[0]) if len(differ) else int(n)

    def _leaf(self, lo: int, hi: int) -> Node:
        a, b = self.start[lo], self.start[hi]
        return self._node(lo, hi, self.terms[a:b], self.times[a:b], [])

    def _node(self, lo, hi, terms, times, children) -> Node:
        order = np.argsort(terms, kind="stable")
        first = np.flatnonzero(np.diff(terms[order], prepend=-1))
        most = np.maximum.reduceat(times[order], first) if len(first) else times
        return Node(lo, hi, terms[order][first], most, int(self.m[lo:hi].min()), int(self.ids[lo:hi].min()), children)

    def _subtree(self, lo: int, hi: int) -> Node:
        """Post-order without recursion: a path may be as long as a document has terms."""
        done: list[Node] = []
        todo: list[tuple] = [(lo, hi, None)]
        while todo:
            lo, hi, parts = todo.pop()
            if parts is not None:
                children, done[-parts:] = done[-parts:], []
                done.append(self._node(lo, hi, np.concatenate([c.terms for c in children]), np.concatenate([c.times for c in children]), children))
                continue
            if hi - lo <= LEAF:
                done.append(self._leaf(lo, hi))
                continue
            cuts = self._cuts(lo, hi)
            todo.append((lo, hi, len(cuts)))
            todo += [(a, b, None) for a, b in cuts]
        return done[0]

    def _cuts(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """The ranges of a node's children; neighbouring small ones together. Equal documents are cut by number."""
        depth = self._shared(lo, hi)
        at = self.start[lo:hi] + depth
        here = np.where(self.size[lo:hi] > depth, self.path[np.minimum(at, max(len(self.path) - 1, 0))], -1) if len(self.path) else np.full(hi - lo, -1)
        edges = [lo, *(lo + 1 + np.flatnonzero(np.diff(here))).tolist(), hi]
        if len(edges) == 2:
            middle = (lo + hi) // 2
            return [(lo, middle), (middle, hi)]
        out: list[tuple[int, int]] = []
        for a, b in zip(edges, edges[1:], strict=False):
            if out and b - out[-1][0] <= LEAF:
                out[-1] = out[-1][0], b
            else:
                out.append((a, b))
        return out


class Items:
    """Some items as lists of items by term, with their best documents so far."""

    def __init__(self, terms: np.ndarray, item: np.ndarray, count: int, weight: np.ndarray, k: int):
        order = np.argsort(terms, kind="stable")
        self.items = item[order]
        self.size = np.bincount(terms, minlength=len(weight))
        self.start = np.cumsum(self.size) - self.size
        self.weight, self.count = weight, count
        self.scores, self.ids = np.zeros((count, k), dtype=np.int64), np.full((count, k), NO_ID)
        # Sums of doubles are exact up to here.
        most = int(np.bincount(item, minlength=1).max(initial=0)) * int(weight.max(initial=0)) * 1_000_000
        self.exact = most < 2**53

    def _sums(self, place: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        if self.exact:
            return np.bincount(place, weights=values, minlength=size).astype(np.int64)
        out = np.zeros(size, dtype=np.int64)
        np.add.at(out, place, values)
        return out

    def bound(self, node: Node) -> np.ndarray:
        """Per item a score that no document of the subtree exceeds."""
        most = self.weight[node.terms] * gain(node.times, node.m)
        size = self.size[node.terms]
        return self._sums(self.items[ranges(self.start[node.terms], size)], np.repeat(most, size), self.count)

    def hopeful(self, node: Node, bound: np.ndarray) -> np.ndarray:
        kth = self.scores[:, -1]
        return (bound > kth) | (bound == kth) & (bound > 0) & (node.least_id < self.ids[:, -1])

    def score(self, tree: Tree, node: Node, asks: np.ndarray) -> None:
        """Score the documents of a leaf for the items that ask and keep the best."""
        a, b, n = tree.start[node.lo], tree.start[node.hi], node.hi - node.lo
        terms, length = tree.terms[a:b], tree.size[node.lo : node.hi]
        row = np.repeat(np.arange(n), length)
        value = self.weight[terms] * gain(tree.times[a:b], np.repeat(tree.m[node.lo : node.hi], length))
        size = self.size[terms]
        item = self.items[ranges(self.start[terms], size)]
        scores = self._sums(item * n + np.repeat(row, size), np.repeat(value, size), self.count * n).reshape(self.count, n)
        ids = tree.ids[node.lo : node.hi]
        kth, last = self.scores[:, -1:], self.ids[:, -1:]
        better = (scores > kth) | (scores == kth) & (scores > 0) & (ids < last)
        some = np.flatnonzero(asks & better.any(axis=1))
        if len(some):
            all_scores = np.concatenate([self.scores[some], scores[some]], axis=1)
            all_ids = np.concatenate([self.ids[some], np.where(scores[some] > 0, ids, NO_ID)], axis=1)
            best = np.lexsort((all_ids, -all_scores), axis=-1)[:, : self.scores.shape[1]]
            self.scores[some], self.ids[some] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_ids, best, 1)

    def search(self, tree: Tree) -> int:
        """Depth-first, best child first. Returns the number of documents that were scored."""
        scored = 0
        stack = [(tree.root, self.bound(tree.root))] if tree.root else []
        while stack:
            node, bound = stack.pop()
            asks = self.hopeful(node, bound)
            if not asks.any():
                continue
            if not node.children:
                self.score(tree, node, asks)
                scored += node.hi - node.lo
                continue
            bounds = [self.bound(child) for child in node.children]
            for i in np.argsort([b[asks].sum() for b in bounds], kind="stable"):
                stack.append((node.children[i], bounds[i]))
        return scored


def _shard(sent, k: int):
    def run(table: pa.Table) -> pa.Table:
        rank, weight, ends, terms, total, words, names = sent.value
        table = table.combine_chunks()
        ids = table["id"].fill_null(NO_ID).to_numpy()
        lists = table["terms"].combine_chunks()
        size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        m = 50 + 50 * table["n"].to_numpy() * total // words
        tree = Tree(ids, m, size, lists.flatten().to_numpy(), table["times"].combine_chunks().flatten().to_numpy(), rank)
        places, found, scores = [], [], []
        for at in range(0, len(ends) - 1, ITEMS):
            to = min(at + ITEMS, len(ends) - 1)
            length = np.diff(ends[at : to + 1])
            items = Items(terms[ends[at] : ends[to]], np.repeat(np.arange(to - at), length), to - at, weight, k)
            items.search(tree)
            item, column = np.nonzero(items.scores)
            places.append(item + at)
            found.append(items.ids[item, column])
            scores.append(items.scores[item, column])
        place, doc = np.concatenate(places), np.concatenate(found)
        return pa.table({
            "item": pa.array(place), "item_id": names.take(pa.array(place)),
            "doc_id": pa.array(doc, mask=doc == NO_ID), "score": pa.array(np.concatenate(scores)),
        })

    return run


def _one_pass(docs: DataFrame, items: DataFrame, kind: str, k: int, part: int) -> DataFrame | None:
    """The best documents of each shard for items whose terms are sent to the tasks; None without terms."""
    context = docs.sparkSession.sparkContext
    rows = items.collect()
    vocabulary = sorted({t for r in rows for t in r["terms"]})
    if not vocabulary:
        return None
    vectors = stored(_vectors(docs, context.broadcast(vocabulary)), f"term_vectors{part}")
    sums = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("words"), F.sum(F.size("terms")).alias("postings")).first()
    if not sums["postings"]:
        return None
    frequency = np.zeros(len(vocabulary), dtype=np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        frequency[r["term"]] = r["count"]
    total = sums["docs"]
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * f + 1))) for f in frequency.tolist()], dtype=np.int64)
    rank = np.empty(len(vocabulary), dtype=np.int64)
    rank[np.argsort(-frequency, kind="stable")] = np.arange(len(vocabulary))
    number = {t: i for i, t in enumerate(vocabulary)}
    ends = np.concatenate(([0], np.cumsum([len(r["terms"]) for r in rows])))
    terms = np.array([number[t] for r in rows for t in r["terms"]], dtype=np.int64)
    names = pa.array([r["item_id"] for r in rows], pa.int64() if kind == "bigint" else None)
    sent = context.broadcast((rank, weight, ends, terms, total, sums["words"], names))
    shards = -(-sums["postings"] // SHARD_POSTINGS)
    dealt = vectors.where(F.size("terms") > 0).withColumn("shard", F.pmod(F.xxhash64("id", "row", "n"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_shard(sent, k), f"item long, item_id {kind}, doc_id long, score long").withColumn("part", F.lit(part))


def ranked_search(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 50,
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents with the highest scores above 0 for each item.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased; null texts have none. A term
    weighs floor(1000 * ln((2N + 2) / (2df + 1))) and adds w * (10^9 tf div (1000 tf + 20 m)) once per item, with
    m = 50 + 50 n N div L. Equal scores are ranked by ascending key, rows without a key last. Every row is a document;
    repeated rows are ranked each, a repeated item (same id and terms) counts once, two texts under one item id are two
    items. Items without terms and empty tables give no rows. Other columns are not read.

    Items are answered in passes over the documents; a pass takes items with about PASS_TERMS terms, which bounds what
    is collected and broadcast. Sums are exact.
    """
    found = F.regexp_extract_all(F.translate(F.col(item_text), _UPPER, _LOWER), F.lit(f"({TERM})"), 1)
    asked = items.select(F.col(item).alias("item_id"), F.array_sort(F.array_distinct(found)).alias("terms")).where(F.size("terms") > 0)
    asked = stored(asked.dropDuplicates(["item_id", "terms"]), "items")
    passes = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // PASS_TERMS))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    kind = asked.schema["item_id"].dataType.simpleString()
    whole = docs.sparkSession.createDataFrame([], f"item long, item_id {kind}, doc_id long, score long, part int")
    for part in range(passes):
        some = asked.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(passes)) == part)
        best = _one_pass(rows, some, kind, k, part)
        whole = whole if best is None else whole.unionByName(best)
    order = Window.partitionBy("part", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
