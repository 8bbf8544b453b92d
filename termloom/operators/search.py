"""Cosine search: one vector against a table, many vectors against a table, title lookup.

A single query vector reaches the scan as a scalar subquery, so a search is one pass over the
embeddings and a top-n; no join and no shuffle of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.functions import vectors
from termloom.functions.text import normalize_title
from termloom.operators.streams import GROUPS_PER_CORE, TILE_HELD, TILE_PASSING, group_count, streamed, to_every_group
from termloom.settings import BROADCAST_BYTES

# Result sizes, shortest title search, and the seed terms.
TOP_RESULTS = 20
SAMPLE_NEIGHBORS = 15
MIN_TITLE_QUERY = 3
SEED_TERMS = ("science", "robot", "economics", "football", "quantum")

# Batch scores equal to this many digits are ties: a matrix product may differ in the last bits
# between two copies of one vector.
SCORE_DIGITS = 14
# What rounding to so many digits may add to a score.
CUT_SLACK = 1e-13
# Queries above which the table is dealt out anew.
SPREAD_QUERIES = 1000


def find_term(terms: DataFrame, text: str) -> DataFrame:
    """The row of the first word of `text` that is a known term; empty when there is none."""
    words = text.strip().lower().split()
    if not words:
        return terms.limit(0)
    position = F.array_position(F.array(*[F.lit(w) for w in words]), F.col("term"))
    return terms.filter(F.col("term").isin(words)).orderBy(position, "term_id").limit(1)


def nearest(
    table: DataFrame,
    query: DataFrame,
    key: str,
    label: str,
    n: int = TOP_RESULTS,
    mode: str = vectors.VIEWER,
    exclude_key: str | None = None,
) -> DataFrame:
    """The n rows of `table` most similar to the one row of `query`: (key, label, score).

    `query` has an `embedding` and, with `exclude_key`, that column names the row to leave out.
    Ties go to the later label. An empty query gives an empty result. A `norm` column of the
    table is used instead of computing the norms again.
    """
    wanted = query.select(
        F.struct(
            F.col("embedding").alias("vector"),
            vectors.l2_norm(F.col("embedding")).alias("norm"),
            (F.col(exclude_key) if exclude_key else F.lit(None).cast("string")).alias("own"),
        )
    ).scalar()
    norm = F.col("norm") if "norm" in table.columns else vectors.l2_norm(F.col("embedding"))
    scored = table.select(key, label, "embedding", norm.alias("norm"), wanted.alias("q"))
    if exclude_key:
        scored = scored.filter(~F.col(key).eqNullSafe(F.col("q.own")))
    score = vectors.cosine_from(
        vectors.dot(F.col("embedding"), F.col("q.vector")),
        F.col("norm"),
        F.col("q.norm"),
        mode,
    )
    return (
        scored.filter(F.col("q").isNotNull())
        .select(key, label, score.alias("score"))
        .orderBy(F.desc("score"), F.desc(label), key)
        .limit(n)
    )


def similar_terms(terms: DataFrame, text: str, n: int = TOP_RESULTS) -> DataFrame:
    """Terms nearest to the first known word of `text`, that word left out."""
    return nearest(terms, find_term(terms, text), "term_id", "term", n, exclude_key="term_id")


def similar_docs(docs: DataFrame, doc_id: int, n: int = TOP_RESULTS) -> DataFrame:
    """Documents nearest to one document; others with the same title stay in."""
    return nearest(docs, docs.filter(F.col("doc_id") == doc_id), "doc_id", "title", n, exclude_key="doc_id")


def docs_for_term(terms: DataFrame, docs: DataFrame, text: str, n: int = TOP_RESULTS) -> DataFrame:
    """Documents nearest to the first known word of `text`; nothing is left out."""
    return nearest(docs, find_term(terms, text), "doc_id", "title", n)


def title_candidates(docs: DataFrame, text: str) -> DataFrame:
    """Documents whose title contains the search text, with `status` one or many.

    A text shorter than three characters, like one without a match, finds nothing.
    """
    text = text.strip().lower()
    if len(text) < MIN_TITLE_QUERY:
        return docs.select("doc_id", "title", F.lit("none").alias("status")).limit(0)
    found = docs.select("doc_id", normalize_title(F.col("title")).alias("title")).filter(
        F.col("title").contains(text)
    )
    matches = found.limit(2).agg(F.count("*")).scalar()
    return found.withColumn("status", F.when(matches > 1, "many").otherwise("one"))


def title_status(docs: DataFrame, text: str) -> DataFrame:
    """One row: how many titles match, and none, many or one."""
    found = title_candidates(docs, text).agg(F.count("*").alias("matches"))
    status = F.when(F.col("matches") == 0, "none").when(F.col("matches") == 1, "one").otherwise("many")
    return found.withColumn("status", status)


def first_of_title(docs: DataFrame) -> DataFrame:
    """For every title its first document by id, which is unique. Only ids are aggregated, by hash and map-side."""
    titled = docs.select(normalize_title(F.col("title")).alias("title"), "doc_id", "embedding")
    first = titled.groupBy("title").agg(F.min("doc_id").alias("doc_id"))
    return titled.join(first.select("doc_id"), "doc_id", "left_semi").select("title", "doc_id", "embedding")


def select_title(docs: DataFrame, title: str) -> DataFrame:
    """The first document of one title."""
    return first_of_title(docs.filter(normalize_title(F.col("title")) == title.strip().lower()))


def known_seeds(seeds: DataFrame, vocab: DataFrame) -> DataFrame:
    """Seed terms (columns seed_pos, term) that are in the vocabulary, in seed order."""
    return seeds.join(vocab.select("term"), "term", "left_semi").orderBy("seed_pos")


def neighbor_samples(
    terms: DataFrame,
    seeds: tuple[str, ...] = SEED_TERMS,
    candidates: int | None = None,
    n: int = SAMPLE_NEIGHBORS,
    mode: str = vectors.SAMPLE_V3,
) -> DataFrame:
    """(term, neighbors) for each seed that is a known term, the seed itself not left out.

    All terms are compared, or with `candidates` the first so many of the vocabulary. Ties stay in
    vocabulary order.
    """
    queries = terms.filter(F.col("term").isin(list(seeds))).select(
        F.col("term").alias("query"), "embedding"
    )
    corpus = terms if candidates is None else terms.filter(F.col("term_id") < candidates)
    found = batch_nearest(queries, corpus, "query", "term_id", "term", n, mode, ties="key")
    ranked = F.sort_array(
        F.collect_list(F.struct("rank", F.struct(F.col("term").alias("_1"), F.col("score").alias("_2")).alias("hit")))
    )
    seed_pos = F.array_position(F.array(*[F.lit(s) for s in seeds]), F.col("term"))
    return (
        found.groupBy(F.col("query").alias("term"))
        .agg(ranked.alias("ranked"))
        .orderBy(seed_pos)
        .select("term", F.col("ranked.hit").alias("neighbors"))
    )


def batch_nearest(
    queries: DataFrame,
    table: DataFrame,
    query_key: str,
    key: str,
    label: str,
    n: int = TOP_RESULTS,
    mode: str = vectors.VIEWER,
    exclude_self: bool = False,
    ties: str = "label",
    max_bytes: int = BROADCAST_BYTES,
    block_rows: int | None = None,
) -> DataFrame:
    """For every query its n nearest rows, exactly: (query_key, rank, key, label, score).

    While the query vectors and their results fit in `max_bytes` they are sent to the executors, and every Arrow
    batch of the table is multiplied with them where it lies. Beyond that the queries are dealt to groups, and the
    table passes by each of them (`streams`). Products are taken in tiles, of `block_rows` rows of either side if given.
    Either way a task keeps only its own n best per query, and a ranking window over those picks the result.

    `exclude_self` leaves out the row whose key equals the query's. Scores equal to 14 digits
    are ties and go to the later label, or with ties="key" to the lower key.
    """
    queries = queries.select(F.col(query_key).alias("_query"), "embedding")
    table = table.select(F.col(key).alias("_key"), F.col(label).alias("_label"), "embedding")
    schema = (
        T.StructType()
        .add("_query", queries.schema["_query"].dataType)
        .add("_key", table.schema["_key"].dataType)
        .add("_label", table.schema["_label"].dataType)
        .add("score", "double")
    )
    count, width = queries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    tiles = (block_rows, block_rows) if block_rows else (TILE_HELD, TILE_PASSING)
    query_bytes = held_bytes(width or 0, n)

    def start(wanted):
        return Best(wanted, n, mode, exclude_self, ties, tiles)

    if count * query_bytes <= max_bytes:
        wanted = table.sparkSession.sparkContext.broadcast(queries.toArrow())
        if count > SPREAD_QUERIES:
            # Every row costs as many products as there are queries: all cores take part, however few files there are.
            table = table.repartition(GROUPS_PER_CORE * table.sparkSession.sparkContext.defaultParallelism)

        def scan(batches):
            best = start(wanted.value)
            for batch in batches:
                best.meet(batch)
            yield from best.finish()

        partial = table.mapInArrow(scan, schema)
    else:
        groups = group_count(queries, count, query_bytes)
        held = queries.withColumn("_group", F.pmod(F.xxhash64("_query"), F.lit(groups)))
        partial = streamed(held, to_every_group(table, groups), groups, start, schema)

    tie = F.col("_key").asc() if ties == "key" else F.col("_label").desc()
    order = Window.partitionBy("_query").orderBy(F.round("score", SCORE_DIGITS).desc(), tie, "_key")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select(
            F.col("_query").alias(query_key), "rank", F.col("_key").alias(key), F.col("_label").alias(label), "score"
        )
    )


def held_bytes(width: int, n: int) -> int:
    """What a query takes in a task: its vector as it came and as it is multiplied, and its results while they are ranked."""
    return 16 * width + 200 * n


def _matrix(column):
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _ranks(column):
    """Numbers in the order of the values; NULL comes first."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not column.null_count and pa.types.is_integer(column.type):
        return column.to_numpy()
    coded = column.dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(coded.dictionary, null_placement="at_start").to_numpy()
    ranks = np.empty(len(order), dtype=np.int64)
    ranks[order] = np.arange(len(order))
    return ranks[coded.indices.to_numpy()]


class Best:
    """The n best rows so far of some queries (_query, embedding) among rows that pass by (_key, _label, embedding).

    `cut` is a score per query that its n-th best row reaches for sure; only rows that reach it are looked at further.
    """

    def __init__(self, queries, n: int, mode: str, exclude_self: bool, ties: str, tiles=(TILE_HELD, TILE_PASSING), cut=None):
        import numpy as np

        self.queries, self.n, self.exclude_self, self.ties = queries, n, exclude_self, ties
        self.epsilon = vectors.COSINE_EPSILON[mode]
        self.q = _matrix(queries.column("embedding")) if queries.num_rows else np.zeros((0, 0))
        self.norm = np.linalg.norm(self.q, axis=1)
        self.own = queries.column("_query").to_numpy() if exclude_self else None
        self.cut = np.full(len(self.q), -np.inf) if cut is None else cut
        self.tile, self.step = tiles
        # Candidates by tile of queries.
        self.held = [[] for _ in range(0, len(self.q), self.tile)]

    def meet(self, rows, some=None) -> None:
        """Rows pass by all queries, or by those with the rising numbers `some`."""
        import numpy as np
        import pyarrow as pa

        if not rows.num_rows or not len(self.q):
            return
        key, label = rows.column("_key"), rows.column("_label")
        # Rows in tie order, so that the earlier of two equal scores is the one to keep.
        order = np.lexsort(self._tie(key, label))
        x = _matrix(rows.column("embedding"))[order]
        x_norm = np.linalg.norm(x, axis=1)
        keys = key.to_numpy(zero_copy_only=False)[order] if self.exclude_self else None
        some = np.arange(len(self.q)) if some is None else some
        edges = np.searchsorted(some, np.arange(len(self.held) + 1) * self.tile)
        for tile, (low, high) in enumerate(zip(edges, edges[1:])):
            mine = some[low:high]
            if not len(mine):
                continue
            found = []
            for start in range(0, len(x), self.step):
                part = slice(start, start + self.step)
                i, j, rounded, score = self._above(mine, x[part], x_norm[part], None if keys is None else keys[part])
                if len(i):
                    found.append((mine[i], order[j + start], rounded, score))
            if found:
                i, j, rounded, score = (np.concatenate(c) for c in zip(*found))
                j = pa.array(j)
                self.held[tile].append(pa.table({"query": i, "rounded": rounded, "score": score, "_key": key.take(j), "_label": label.take(j)}))
                if sum(t.num_rows for t in self.held[tile]) > 2 * self.n * self.tile:
                    self._rank(tile)

    def _above(self, mine, x, x_norm, keys):
        """(place in `mine`, place in `x`, score to 14 digits, score) of what may be among the n best."""
        import numpy as np

        score = self.q[mine] @ x.T
        scale = np.multiply.outer(self.norm[mine], x_norm)
        scale += self.epsilon
        # A zero vector has a zero product, so its score is 0 under every mode.
        score /= scale
        cut = self.cut[mine]
        unknown = np.flatnonzero(np.isneginf(cut))
        if len(unknown) and self.n < len(x):
            seen = np.where(np.isfinite(score[unknown]), score[unknown], -np.inf)
            if keys is not None:
                seen[self.own[mine[unknown], None] == keys[None, :]] = -np.inf
            cut[unknown] = np.round(np.partition(seen, len(x) - self.n, axis=1)[:, len(x) - self.n], SCORE_DIGITS)
            self.cut[mine] = cut
        i, j = np.nonzero(score >= (cut - CUT_SLACK)[:, None])
        score = score[i, j]
        kept = np.isfinite(score)
        if keys is not None:
            kept &= self.own[mine[i]] != keys[j]
        i, j, score = i[kept], j[kept], score[kept]
        rounded = np.round(score, SCORE_DIGITS)
        by_score = np.lexsort((j, -rounded, i))
        first = np.searchsorted(i, i, side="left")
        best = by_score[np.arange(len(i)) - first < self.n]
        return i[best], j[best], rounded[best], score[best]

    def _tie(self, key, label):
        return (_ranks(key),) if self.ties == "key" else (_ranks(key), -_ranks(label))

    def _rank(self, tile: int) -> None:
        import numpy as np
        import pyarrow as pa

        found = pa.concat_tables(self.held[tile])
        query, rounded = found["query"].to_numpy(), found["rounded"].to_numpy()
        order = np.lexsort((*self._tie(found["_key"], found["_label"]), -rounded, query))
        ranked = query[order]
        place = np.arange(len(order)) - np.searchsorted(ranked, ranked)
        last = order[place == self.n - 1]
        self.cut[query[last]] = np.maximum(self.cut[query[last]], rounded[last])
        self.held[tile] = [found.take(pa.array(order[place < self.n])).combine_chunks()]

    def finish(self, *names: str):
        """Batches of (columns `names` of the queries or _query, _key, _label, score), a tile at a time."""
        import pyarrow as pa

        names = names or ("_query",)
        for tile in range(len(self.held)):
            if self.held[tile]:
                self._rank(tile)
                found = self.held[tile].pop()
                columns = {c: self.queries.column(c).take(found["query"]) for c in names}
                yield from pa.table({**columns, **{c: found[c] for c in ("_key", "_label", "score")}}).combine_chunks().to_batches()
