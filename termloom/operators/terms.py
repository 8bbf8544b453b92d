"""Tokens, term statistics, vocabulary and TF-IDF.

Token arrays stay one row per document and term counts are sparse vectors, so nothing is
shuffled by document. The only shuffle is by term and carries one partial row per term and task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.stopwords import ENGLISH
from termloom.functions.text import tokenize, without_stopwords
from termloom.operators.joins import frequent_keys
from termloom.operators.streams import sliced
from termloom.settings import BROADCAST_BYTES, LEXICON_ROWS, STOPWORD_ROWS, stored


# Counters of the filter of rare terms, as a power of two: 16 MB a task while it counts, 256 KB on the driver.
FILTER_BITS = 21
# Bits of the filter of a word table, as powers of two: 8 KB to 16 MB.
LEAST_LISTED_BITS, MOST_LISTED_BITS = 16, 27

# Endings of English nouns and what stands in their place in the base form.
NOUN_ENDINGS = (
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
)


def tokenized(df: DataFrame, text: str = "text", stopwords: Iterable[str] = ENGLISH) -> DataFrame:
    """Replace the text column by its tokens without stop words."""
    return df.withColumn("tokens", without_stopwords(tokenize(F.col(text)), stopwords)).drop(text)


def without_listed(df: DataFrame, stop_table: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Drop the words of a stop-word table (column `word`) of any size; arrays keep their order.

    NULL elements are dropped as well, NULL arrays stay NULL. Up to `most_rows` (STOPWORD_ROWS) words become a literal
    set and no row moves. Of more words a filter is probed inside the arrays. The most frequent tokens that hit it are
    dropped in place, as from a literal set, and only the others are joined; the result is the same.
    """
    most_rows = STOPWORD_ROWS if most_rows is None else most_rows
    words = stored(stop_table.select(F.lower("word").alias("token")).dropna().distinct(), "words")
    listed = [r.token for r in words.limit(most_rows + 1).collect()]
    present = F.filter("tokens", lambda token: token.isNotNull())
    if len(listed) <= most_rows:
        return df.withColumn("tokens", without_stopwords(present, listed))
    rows = _with_row_number(df.withColumn("tokens", present))
    probe = _probe(words)
    frequent = frequent_keys(probe(rows), "token")
    common = [r.token for r in words.where(F.col("token").isin(frequent)).collect()]
    if common:
        rows = rows.withColumn("tokens", F.filter("tokens", lambda token: ~token.isin(common)))
    # Frequent tokens that are left hit the filter, but are no words of the table.
    found = probe(rows).where(~F.col("token").isin(frequent)).join(words, "token", "left_semi")
    return _changed(rows, found.select("_row", "pos", F.lit(None).cast("string").alias("token")))


def lemmatized(df: DataFrame, lexicon: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Replace each token by its lemma from a (form, lemma) table; unknown forms and NULLs stay.

    A lexicon of at most `most_rows` (LEXICON_ROWS) rows and BROADCAST_BYTES bytes is sent to the executors and looked up
    batch by batch, without moving the tokens. Of a larger one a filter is probed inside the arrays. The most frequent
    tokens that hit it are looked up that way too, and only the others are joined; the result is the same.
    """
    most_rows = LEXICON_ROWS if most_rows is None else most_rows
    known = stored(lexicon.select("form", "lemma").dropna(), "lexicon")
    first = known.limit(most_rows + 1).agg(F.count("*"), F.sum(F.octet_length("form") + F.octet_length("lemma"))).first()
    if first[0] > most_rows or (first[1] or 0) > BROADCAST_BYTES:
        return _lemmatized_by_join(df, known)
    return _looked_up(df, dict(sorted(map(tuple, known.collect()), reverse=True)))


def _looked_up(df: DataFrame, lemmas: dict[str, str]) -> DataFrame:
    """Tokens replaced from a map that is sent to the executors."""
    lemma_of, position = df.sparkSession.sparkContext.broadcast(lemmas), df.columns.index("tokens")

    def look_up(batches):
        import pyarrow as pa

        lemmas = lemma_of.value
        for batch in sliced(batches):
            tokens = batch.column(position)
            flat = tokens.flatten().dictionary_encode()
            words = pa.array([lemmas.get(w, w) for w in flat.dictionary.to_pylist()], pa.string())
            lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets = pa.array([0, *lengths.cumsum().tolist()], pa.int32())
            mask = tokens.is_null() if tokens.null_count else None
            replaced = pa.ListArray.from_arrays(offsets, words.take(flat.indices), mask=mask)
            columns = list(batch.columns)
            columns[position] = replaced
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(look_up, df.schema)


def _lemmatized_by_join(df: DataFrame, known: DataFrame) -> DataFrame:
    forms = stored(known.groupBy(F.col("form").alias("token")).agg(F.min("lemma").alias("lemma")), "forms")
    rows = _with_row_number(df)
    probe = _probe(forms)
    frequent = frequent_keys(probe(rows), "token")
    common = dict(map(tuple, forms.where(F.col("token").isin(frequent)).collect()))
    # Hits are those of the tokens as they were: a lemma may be a form as well.
    found = probe(rows).where(~F.col("token").isin(frequent)).join(forms, "token")
    return _changed(_looked_up(rows, common) if common else rows, found.select("_row", "pos", F.col("lemma").alias("token")))


def detached_lemmas(forms: DataFrame, lexicon: DataFrame, endings=NOUN_ENDINGS) -> DataFrame:
    """(form, lemma) for the forms (column `form`) that a lexicon of (form, lemma) rows does not list, by its own lemmas.

    Each rule of `endings` takes an ending off a form and puts another in its place. A result counts if it is a lemma of the
    lexicon; of several the shortest is taken, then the first by letter. Forms without one give no row, and so
    do empty and NULL ones. The work is per distinct form; a text's tokens do not move.
    """
    listed = lexicon.select("form", "lemma").dropna()
    lemmas = listed.select("lemma").distinct()
    known = listed.select("form").union(lemmas).distinct()
    unknown = forms.select("form").dropna().distinct().join(known, "form", "left_anti")
    form = F.col("form")
    changed = [
        F.when(form.endswith(old) & (F.length(form) > len(old)), F.concat(F.left(form, F.length(form) - len(old)), F.lit(new)))
        for old, new in endings
    ]
    candidates = _exploded(unknown, F.array_distinct(F.array_compact(F.array(*changed))), "lemma", "form")
    best = F.min(F.struct(F.length("lemma").alias("length"), "lemma")).alias("best")
    found = candidates.join(lemmas, "lemma", "left_semi").groupBy("form").agg(best)
    return found.select("form", F.col("best.lemma").alias("lemma"))


def listed_tokens(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(_row, pos, token) of the tokens that may stand in `words` (column token, no repeats): all that do and few others.

    Two bits a word in a filter with 16 bits a word, at most 2^MOST_LISTED_BITS whatever the number of words. It is put
    together in chunks and broadcast, 2^MOST_LISTED_BITS bits at most; the arrays of tokens are probed where they lie.
    """
    return _probe(words)(rows)


def _probe(words: DataFrame):
    """`listed_tokens` as a function of the rows: the filter is built once."""
    bits = min(MOST_LISTED_BITS, max(LEAST_LISTED_BITS, (16 * words.count()).bit_length()))
    sent = words.sparkSession.sparkContext.broadcast(_listed_bits(words, bits))
    mask = (1 << bits) - 1

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = np.frombuffer(sent.value, dtype=np.uint8)

        def holds(place):
            return (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1

        for batch in sliced(batches):
            row, tokens, hashes = batch.columns
            flat = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = np.flatnonzero(holds(flat & mask) & holds((flat >> 32) & mask))
            ends = np.cumsum(lengths)
            of = np.searchsorted(ends, hit, side="right")
            words = tokens.flatten().take(pa.array(hit))
            pos = (hit - (ends[of] - lengths[of])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([row.take(pa.array(of)), pa.array(pos), words], names=["_row", "pos", "token"])

    def probe(rows):
        hashed = rows.select("_row", "tokens", F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"))
        return hashed.mapInArrow(run, "_row long, pos int, token string").where("token is not null")

    return probe


def _listed_bits(words: DataFrame, bits: int) -> bytes:
    """The filter of `listed_tokens`: each task sets its bits, chunks of them are united, the driver gets 2^bits bits."""
    size, chunk = 1 << bits, 1 << min(bits, 20)

    def mark(batches):
        import numpy as np
        import pyarrow as pa

        table = np.zeros(size, dtype=bool)
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False)
            table[hashes & (size - 1)] = True
            table[(hashes >> 32) & (size - 1)] = True
        parts = table.reshape(-1, chunk)
        used = np.flatnonzero(parts.any(axis=1))
        packed = [np.packbits(parts[i], bitorder="little").tobytes() for i in used]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(packed, pa.binary())], names=["chunk", "bitmap"])

    def unite(parts):
        import numpy as np
        import pyarrow as pa

        bitmap = np.bitwise_or.reduce([np.frombuffer(b.as_py(), dtype=np.uint8) for b in parts["bitmap"]])
        return pa.table({"chunk": parts["chunk"].slice(0, 1), "bitmap": pa.array([bitmap.tobytes()], pa.binary())})

    marked = words.select(F.xxhash64("token").alias("hash")).mapInArrow(mark, "chunk int, bitmap binary")
    bitmap = bytearray(size // 8)
    for row in marked.groupBy("chunk").applyInArrow(unite, "chunk int, bitmap binary").collect():
        bitmap[row["chunk"] * chunk // 8 : (row["chunk"] + 1) * chunk // 8] = row["bitmap"]
    return bytes(bitmap)


def _with_row_number(df: DataFrame) -> DataFrame:
    """A number of its own for every row, stored so that it is drawn once; keys may repeat or be NULL."""
    return stored(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def _changed(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """`rows` with the tokens at some places (_row, pos) replaced, or taken out where the new token is NULL.

    The changes are stored, so that the join knows their size: few of them are sent, and the rows stay where they are.
    """
    gathered = stored(changes.groupBy("_row").agg(F.collect_list(F.struct("pos", "token")).alias("_found")), "changes")
    if gathered.isEmpty():
        return rows.drop("_row")
    met = rows.join(gathered, "_row", "left")
    columns = [c for c in rows.columns if c != "_row"]
    position = columns.index("tokens")

    def change(batches):
        import numpy as np
        import pyarrow as pa

        for batch in sliced(batches):
            kept = [batch.column(c) for c in columns]
            tokens, found = kept[position], batch.column("_found")
            flat, entries = tokens.flatten(), found.flatten()
            lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            changed = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            begins = np.cumsum(lengths) - lengths
            place = np.repeat(begins, changed) + entries.field("pos").to_numpy(zero_copy_only=False).astype(np.int64)
            new = entries.field("token")
            source = np.arange(len(flat))
            source[place] = len(flat) + np.arange(len(place))
            gone = np.zeros(len(flat), dtype=bool)
            gone[place] = new.is_null().to_numpy(zero_copy_only=False)
            left = lengths - np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=gone, minlength=len(lengths)).astype(np.int64)
            both = pa.concat_arrays([flat.cast(pa.string()), new.cast(pa.string())])
            offsets = pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32))
            mask = tokens.is_null() if tokens.null_count else None
            kept[position] = pa.ListArray.from_arrays(offsets, both.take(pa.array(source[~gone])), mask=mask)
            yield pa.RecordBatch.from_arrays(kept, names=columns)

    return met.select(*columns, "_found").mapInArrow(change, rows.select(*columns).schema)


def term_stats(tokens: DataFrame) -> DataFrame:
    """Document frequency and collection frequency of every term.

    Tasks count a slice of documents at a time, in numbers that stand for its terms. The counts of a slice are exploded to
    one row per term, not per occurrence, and one aggregation by term, combined map-side, adds them up.
    """

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in sliced(batches):
            column = batch.column(0)
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            document, words = np.repeat(np.arange(len(column)), lengths), column.flatten()
            if words.null_count:
                document = document[words.is_valid().to_numpy(zero_copy_only=False)]
                words = words.drop_null()
            coded = words.dictionary_encode()
            term, found = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
            once = np.unique(document * found + term) % max(found, 1)
            counts = [pa.array(np.bincount(x, minlength=found).astype(np.int64)) for x in (once, term)]
            counted = pa.StructArray.from_arrays([coded.dictionary, *counts], names=["term", "df", "cf"])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, found], pa.int32()), counted)], names=["counts"])

    slices = tokens.select("tokens").mapInArrow(count, "counts array<struct<term: string, df: long, cf: long>>")
    return _exploded(slices, F.col("counts"), "c").groupBy("c.term").agg(F.sum("c.df").alias("df"), F.sum("c.cf").alias("cf"))


def surely_rare(tokens: DataFrame, min_df: int, bits: int = FILTER_BITS):
    """A function from a term column to a condition that holds only for terms of fewer than `min_df` documents.

    Each task counts documents by a hash of their terms, in 2^bits counters that stop at `min_df`; counters of tasks are
    added in chunks, and one bit of each reaches the driver: 2^bits bits, whatever the number of terms. Terms that share
    a counter make it larger, never smaller, so no frequent term is called rare.
    """
    size, chunk = 1 << bits, 1 << min(bits, 14)
    hashes = F.array_distinct(F.transform(F.filter("tokens", lambda t: t.isNotNull()), lambda t: _counter(t, bits)))
    most = min(min_df, 255)

    def count(batches):
        import numpy as np
        import pyarrow as pa

        counters = np.zeros(size, dtype=np.int64)
        for batch in batches:
            counters += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        packed = np.minimum(counters, most).astype(np.uint8).reshape(-1, chunk)
        found = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.astype(np.int32)), pa.array([packed[i].tobytes() for i in found], pa.binary())], names=["chunk", "counters"]
        )

    def add(parts):
        import numpy as np
        import pyarrow as pa

        total = sum(np.frombuffer(c.as_py(), dtype=np.uint8).astype(np.int64) for c in parts["counters"])
        bitmap = np.packbits(total >= most, bitorder="little").tobytes()
        return pa.table({"chunk": parts["chunk"].slice(0, 1), "bitmap": pa.array([bitmap], pa.binary())})

    counted = tokens.select(hashes.alias("hashes")).where("hashes is not null").mapInArrow(count, "chunk int, counters binary")
    bitmap = bytearray(size // 8)
    for row in counted.groupBy("chunk").applyInArrow(add, "chunk int, bitmap binary").collect():
        bitmap[row["chunk"] * chunk // 8 : (row["chunk"] + 1) * chunk // 8] = row["bitmap"]
    # One literal: the optimizer folds the list before the plan runs.
    words = ",".join(str(int.from_bytes(bitmap[i : i + 8], "little", signed=True)) for i in range(0, len(bitmap), 8))
    listed = F.split(F.lit(words), ",").cast("array<bigint>")

    def rare(term: Column) -> Column:
        place = _counter(term, bits)
        word = F.get(listed, F.shiftright(place, 6))
        return F.expr("1L").bitwiseAND(F.call_function("shiftright", word, place.bitwiseAND(F.lit(63)))) == 0

    return rare


def _counter(term: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(1 << bits)).cast("int")


def frequent_term_stats(tokens: DataFrame, min_df: int, bits: int = FILTER_BITS) -> DataFrame:
    """`term_stats` of the terms of at least `min_df` documents. Most others leave before the shuffle; the tokens are
    read twice."""
    rare = surely_rare(tokens, min_df, bits)
    kept = tokens.withColumn("tokens", F.filter("tokens", lambda t: t.isNotNull() & ~rare(t)))
    return term_stats(kept).where(F.col("df") >= min_df)


def _exploded(df: DataFrame, array: Column, name: str, *kept: str) -> DataFrame:
    """One row per element. The outer form, because before an inner explode the optimizer adds a
    size filter that computes the whole array a second time."""
    return df.select(*kept, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def numbered(df: DataFrame, array: str, name: str, *kept: str) -> DataFrame:
    """One row per element with its position: (kept, pos, name); see `_exploded`."""
    return df.select(*kept, F.posexplode_outer(array).alias("pos", name)).filter(F.col("pos").isNotNull())


def vocabulary(stats: DataFrame, min_df: int, vocab_size: int) -> DataFrame:
    """(term_id, term, df, cf): the `vocab_size` most frequent terms with df >= min_df.

    Equal counts are ordered by term, so the cut and the ids are the same on every run. Counting
    the terms per power of two of their frequency (at most 64 rows) first tells which powers
    hold the result; only terms from there up are ordered, a small multiple of `vocab_size`
    whatever the number of terms. `stats` is read twice.
    """
    power = F.floor(F.log2("cf"))
    eligible = stats.filter(F.col("df") >= min_df)
    running = F.sum("terms").over(Window.orderBy(F.desc("power")))
    lowest = (
        eligible.groupBy(power.alias("power"))
        .agg(F.count("*").alias("terms"))
        .select("power", running.alias("terms"))
        .filter(F.col("terms") >= vocab_size)
        .agg(F.coalesce(F.max("power"), F.lit(0)))
    )
    kept = eligible.filter(power >= lowest.scalar()).orderBy(F.desc("cf"), "term").limit(vocab_size)
    rank = F.row_number().over(Window.orderBy(F.desc("cf"), "term"))
    return kept.select((rank - 1).cast("int").alias("term_id"), "term", "df", "cf")


def vocabulary_terms(vocab: DataFrame) -> list[str]:
    """Terms in id order on the driver; bounded by the vocabulary size."""
    return [row.term for row in vocab.select("term_id", "term").orderBy("term_id").collect()]


def term_frequency(tokens: DataFrame, terms: list[str]) -> DataFrame:
    """Replace tokens by sparse counts of the vocabulary terms; other tokens are ignored."""
    if not terms:
        raise ValueError("the vocabulary is empty: no term reaches min_df")
    model = CountVectorizerModel.from_vocabulary(terms, inputCol="tokens", outputCol="tf")
    return model.transform(tokens).drop("tokens")


def idf_from_stats(vocab: DataFrame, documents: int) -> list[float]:
    """ln((N + 1) / (df + 1)) by term id, from frequencies counted over the same N documents."""
    idf = F.log((F.lit(documents) + 1) / (F.col("df") + 1))
    return [row.idf for row in vocab.select("term_id", idf.alias("idf")).orderBy("term_id").collect()]


def idf_from_counts(tf: DataFrame) -> list[float]:
    """The same weights from one pass over the counts, for a vocabulary fitted on a sample."""
    return IDF(inputCol="tf", outputCol="features").fit(tf).idf.toArray().tolist()


def tfidf(tf: DataFrame, idf: list[float]) -> DataFrame:
    """Scale every count by the weight of its term; the vectors stay sparse."""
    scale = ElementwiseProduct(inputCol="tf", outputCol="features", scalingVec=Vectors.dense(idf))
    return scale.transform(tf).drop("tf")


def entries(df: DataFrame, vector: str, value: str = "value") -> DataFrame:
    """Sparse vectors as rows (..., term_id, value), one per stored entry; no shuffle."""
    raw = F.unwrap_udt(F.col(vector))
    others = [c for c in df.columns if c != vector]
    return _exploded(df, F.arrays_zip(raw["indices"], raw["values"]), "e", *others).select(
        *others, F.col("e.indices").alias("term_id"), F.col("e.values").alias(value)
    )


def top_terms(weights: DataFrame, vocab: DataFrame, n: int, key: str = "doc_id", value: str = "tfidf") -> DataFrame:
    """The n heaviest terms of every document, ties in vocabulary order; (key, rank, term, value).

    The cut runs inside each document's own row, so only n rows a document meet the vocabulary.
    """
    raw = F.unwrap_udt(F.col("features"))
    by_weight = F.array_sort(
        F.transform(
            F.arrays_zip(raw["indices"], raw["values"]),
            lambda e: F.struct((-e["values"]).alias("order"), e["indices"].alias("term_id")),
        )
    )
    best = numbered(weights.withColumn("best", F.slice(by_weight, 1, n)), "best", "e", key).select(
        key, (F.col("pos") + 1).alias("rank"), F.col("e.term_id").alias("term_id"), (-F.col("e.order")).alias(value)
    )
    return best.join(vocab.select("term_id", "term"), "term_id").select(key, "rank", "term", value)
