"""Near duplicates by Jaccard similarity of word n-grams: MinHash banding, then exact verification.

1. Exact copies are grouped first; one text of each group goes on, so copies are never expanded into pairs.
2. Every text gets MinHash values in bands. Band and row counts are chosen for the target recall at the threshold.
   Texts that share a band hash are candidates.
3. Band groups are joined to candidate groups, the components of "shares a band with the smallest text of the band
   group". The texts of a candidate group meet in cells, block against block, and there each pair that shares a band
   is verified on the full n-gram sets. No pair leaves a cell: a cell returns the number of links of each of its
   texts, and as many links as it takes to connect those that are linked.
4. The classes are the components of these links.

Cells hold a bounded number of texts. A candidate group of more than GIANT texts is mostly loose: chance collisions
chain texts that share a passage. Its cells are made per band group, and a pair counts in its first common band.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.exact_dedup import exact_dedup
from termloom.llm.graph import components
from termloom.llm.words import Words, gram_hashes, mixed, row_blocks, words_of
from termloom.settings import stored

GRAM = 5
SIMILARITY = 0.8
RECALL = 0.9999
ROWS = 8
# Texts of one side of a verification cell, and of a candidate group whose cells are made for the group as a whole.
BLOCK = 256
GIANT = 16_384
TEXT_BLOCK = 1 << 20
NO_KEY = -(2**63)


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Bands of `rows` values so that a pair at the threshold shares one with the wanted probability."""
    one = similarity**rows
    return 1 if one >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - one)))


def gram_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of every row, distinct and sorted within the row, and the rows' offsets.

    A row with fewer words than `size` has one n-gram, all of its words; a row without words has none."""
    hashes, counts = words.hashes(), words.counts
    grams = gram_hashes(hashes, size)
    row = words.row_of_word()
    inside = row[: len(grams)] == row[len(row) - len(grams) :] if len(grams) else np.empty(0, dtype=bool)
    values, rows = grams[inside], row[: len(grams)][inside]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.zeros(len(short), dtype=np.uint64)
        for i, r in enumerate(short):
            for h in hashes[words.offsets[r] : words.offsets[r + 1]]:
                whole[i] = (int(whole[i]) * 0xD1342543DE82EF95 + int(h) + 1) % (1 << 64)
        values, rows = np.concatenate([values, mixed(whole)]), np.concatenate([rows, short])
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    first = np.ones(len(values), dtype=bool)
    first[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[first], rows[first]
    return values, np.searchsorted(rows, np.arange(words.rows + 1))


def band_hashes(values: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band for every row that has n-grams; bands of different numbers never agree."""
    some = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, bands), dtype=np.uint64)
    if len(some) == 0:
        return out
    starts = offsets[:-1][some]
    low = (values >> np.uint64(32)).astype(np.uint32)
    high = values.astype(np.uint32)
    salts = mixed(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64)).astype(np.uint32).reshape(bands, rows, 2)
    for band in range(bands):
        joint = np.full(len(some), band + 1, dtype=np.uint64)
        for r in range(rows):
            # Multiply-shift of both halves, 32 bits wide.
            turned = low * (salts[band, r, 0] | np.uint32(1))
            turned ^= turned >> np.uint32(15)
            turned += high * (salts[band, r, 1] | np.uint32(1))
            joint = joint * np.uint64(0xD1342543DE82EF95) + np.minimum.reduceat(turned, starts)
        out[some, band] = mixed(joint)
    return out


def _signatures(bands: int, rows: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_blocks(batches, "text", TEXT_BLOCK):
            words = words_of(batch.column(0))
            values, offsets = gram_sets(words, gram)
            hashes = band_hashes(values, offsets, bands, rows)
            lists = [h.view(np.int64) if size else [] for h, size in zip(hashes, np.diff(offsets), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(lists, pa.list_(pa.int64()))], names=["kid", "th", "bands"]
            )

    return run


CELL_SCHEMA = "doc long, partner long, links long, copies long"


def _verified(similarity: float, gram: int):
    """Links between the texts of side 0 and those of side 1 of a cell, or within side 0 if there is no side 1.

    Rows with a partner are links that connect what the cell links; rows without count the links of a text."""

    def run(table: pa.Table) -> pa.Table:
        side, docs, weight = (table[c].to_numpy() for c in ("side", "doc", "copies"))
        bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(docs), -1)
        # The band that the cell is made for, or null for a whole group.
        only = table["band"][0].as_py()
        values, offsets = gram_sets(words_of(table["text"].combine_chunks()), gram)
        sizes = np.diff(offsets)
        _, places = np.unique(values, return_inverse=True)
        marked = np.zeros(int(places.max(initial=-1)) + 1, dtype=bool)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = len(right) == 0
        links, copies = np.zeros(len(docs), dtype=np.int64), np.zeros(len(docs), dtype=np.int64)
        root = np.arange(len(docs))
        joints = []

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for number, i in enumerate(left):
            other = left[number + 1 :] if alone else right
            least = np.minimum(sizes[other], sizes[i])
            other = other[least >= similarity * np.maximum(sizes[other], sizes[i]) - 1e-9]
            same = bands[other] == bands[i]
            meets = same.any(axis=1)
            if only is not None:
                meets &= bands[i][same.argmax(axis=1)] == only
            other = other[meets]
            if len(other) == 0:
                continue
            own = places[offsets[i] : offsets[i + 1]]
            marked[own] = True
            span = np.concatenate([places[offsets[j] : offsets[j + 1]] for j in other])
            starts = np.cumsum(sizes[other]) - sizes[other]
            shared = np.add.reduceat(marked[span].astype(np.int64), starts)
            marked[own] = False
            # With room for rounding, so that a pair at the threshold itself counts.
            near = other[shared >= similarity * (sizes[i] + sizes[other] - shared) - 1e-9]
            links[i] += len(near)
            copies[i] += weight[near].sum()
            links[near] += 1
            copies[near] += weight[i]
            for j in near:
                a, b = find(i), find(j)
                if a != b:
                    root[b] = a
                    joints.append((docs[i], docs[j]))
        some = np.flatnonzero(links)
        joined = np.array(joints, dtype=np.int64).reshape(-1, 2)
        zero = np.zeros(len(joined), dtype=np.int64)
        return pa.table({
            "doc": np.concatenate([docs[some], joined[:, 0]]),
            "partner": pa.array([None] * len(some) + joined[:, 1].tolist(), pa.int64()),
            "links": np.concatenate([links[some], zero]),
            "copies": np.concatenate([copies[some], zero]),
        })

    return run


def _cells(members: DataFrame) -> DataFrame:
    """Rows (grouping, band, doc) dealt to cells of block against block of their grouping."""
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK).cast("long")
    sized = members.join(members.groupBy("grouping").agg(blocks.alias("blocks")), "grouping")
    own = F.pmod(F.xxhash64("doc"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    placed = sized.select("grouping", "band", "doc", own.alias("own"), other.alias("other"))
    return placed.select(
        "grouping", "band", "doc", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
    )


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, gram: int = GRAM,
    recall: float = RECALL, rows: int = ROWS,
) -> DataFrame:
    """One row per row of `docs`: the key, class_id (smallest key of the class), class_size, kept (the smallest key
    stays), n_links (other rows with an equal text or at least `similarity`), n_texts (different texts linked), text_hash
    (xxhash64 of the text, which tells rows of one key apart).

    Similarity is the Jaccard coefficient of the sets of `gram` consecutive words, unchanged. Texts with fewer words have
    one n-gram; texts without words are linked to equal texts only; null counts as empty. Rows that repeat key and text
    are copies of each other and, where they have the smallest key, are all kept. Rows without a key come after all
    keys in a class and never stay, unless the class has no key. An empty table gives no rows. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    place = ["kid", "th"]
    rows_in = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("kid"))
    rows_in = rows_in.withColumn("th", F.xxhash64("text"))
    known = exact_dedup(rows_in.select("text", F.struct(*place).alias("place")), key="place")
    copies = stored(known.select("place.*", F.col("keep_id.kid").alias("one"), F.col("keep_id.th").alias("digest"), "group_size", "kept"), "copies")

    # Numbers are given once and stored, one per different text.
    bands = bands_for(similarity, recall, rows)
    signed = rows_in.mapInArrow(_signatures(bands, rows, gram), "kid long, th long, bands array<long>")
    kept = copies.where("kept").select(*place, "group_size").dropDuplicates(place)
    signed = signed.join(kept, place).dropDuplicates(place).withColumn("doc", F.monotonically_increasing_id())
    signed = stored(signed, "signatures")

    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    banded = signed.select("doc", F.explode("bands").alias("band")).repartition(partitions, "band")
    groups = banded.groupBy("band").agg(F.min("doc").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(banded.join(groups.hint("shuffle_hash"), "band").select("band", "doc", "centre"), "bands")

    # Texts that share a band with another one.
    loose = components(shared.where("doc <> centre").select("doc", "centre").distinct(), "candidate-groups")
    loose = stored(loose.withColumnRenamed("node", "doc"), "candidate-groups")
    candidates = loose.select("doc").join(signed.select("doc", *place, "bands", F.col("group_size").alias("copies")), "doc")
    texts = rows_in.join(candidates.hint("shuffle_hash"), place).dropDuplicates(["doc"]).select("doc", "text", "bands", "copies")
    texts = stored(texts, "texts")

    sizes = loose.groupBy("root").agg((F.count(F.lit(1)) > GIANT).alias("giant"))
    sized = loose.join(sizes, "root")
    whole = sized.where("not giant").select(F.col("root").alias("grouping"), F.lit(None).cast("long").alias("band"), "doc")
    giant = sized.where("giant").select("doc")
    by_band = shared.join(giant, "doc", "left_semi").select(F.col("band").alias("grouping"), "band", "doc")
    cells = _cells(whole).unionByName(_cells(by_band)).join(texts, "doc")
    cells = cells.withColumn("kind", F.col("band").isNotNull()).groupBy("kind", "grouping", "first", "second")
    found = stored(cells.applyInArrow(_verified(similarity, gram), CELL_SCHEMA), "links")
    links = found.where("partner is null").groupBy("doc").agg(F.sum("links").alias("links"), F.sum("copies").alias("copies"))
    classes = components(found.where("partner is not null").select("doc", "partner"), "classes")
    classes = classes.select(F.col("node").alias("doc"), F.col("root").alias("class"))

    numbered = signed.select("doc", F.col("kid").alias("one"), F.col("th").alias("digest")).join(classes, "doc", "left").join(links, "doc", "left")
    numbered = numbered.select(
        "one", "digest", F.coalesce("class", "doc").alias("class"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("copies", F.lit(0)).alias("copies")
    )
    # Missing keys come last in a class.
    keyed = F.nullif("kid", F.lit(NO_KEY))
    members = copies.select("one", "digest", "group_size", keyed.alias("id"), F.col("th").alias("text_hash"))
    members = stored(members.join(numbered, ["one", "digest"]), "members")
    named = members.groupBy("class").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return members.join(named, "class").select(
        F.col("id").cast(kind).alias(key),
        "class_id",
        "class_size",
        F.col("id").eqNullSafe(F.col("class_id")).alias("kept"),
        (F.col("copies") + F.col("group_size") - 1).alias("n_links"),
        F.col("links").alias("n_texts"),
        "text_hash",
    )
