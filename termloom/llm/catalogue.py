"""The operators of this subpackage as registered queries, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import bpe, byte_bpe, exact_dedup, html_text, jaccard_join, language_model, lexical_search, line_dedup, packing, phrases, quality, substring_dedup, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark, sf_dir):
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op2_bpe(spark, sf_dir):
    return bpe.encode_decode(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_lm_scores(spark, sf_dir):
    rest = F.crc32(F.col("doc_id").cast("string")) % 10
    return language_model.lm_scores(_table(spark, sf_dir, "documents"), held_out=rest == 0, fold=rest == 1)


def op4_line_dedup(spark, sf_dir):
    found = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "kept_in")


def op5_substring_dedup(spark, sf_dir):
    found = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash")


def op7_packing(spark, sf_dir):
    return packing.best_fit_packing(_table(spark, sf_dir, "documents"))


def op8_topk(spark, sf_dir):
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = quality.fold(F.col("doc_id"), 3) == 1
    model = quality.train(docs, labels.where(~held_out))
    return quality.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op11_lexical_search(spark, sf_dir):
    return lexical_search.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_phrases(spark, sf_dir):
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark, sf_dir):
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return byte_bpe.encode_decode(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_bpe": op2_bpe,
    "op3_lm_scores": op3_lm_scores,
    "op4_line_dedup": op4_line_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_packing": op7_packing,
    "op8_topk": op8_topk,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality": op10_quality,
    "op11_lexical_search": op11_lexical_search,
    "op12_phrases": op12_phrases,
    "op13_byte_bpe": op13_byte_bpe,
}

SQL = {
    "op4_line_dedup": """
        WITH RECURSIVE t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (
            SELECT doc_id, line, place, (doc_id, place) AS spot
            FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM t)
        ), x AS (
            SELECT line, length(line) AS n, min(spot) AS first FROM l
            WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY line
        ), e AS (
            SELECT a.line AS a, b.line AS b FROM x a JOIN x b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.line <> b.line
            -- Two edits leave one of three parts as it was.
            WHERE a.n >= 20 AND b.n >= 20 AND (
                contains(b.line, a.line[:a.n // 3]) OR contains(b.line, a.line[a.n // 3 + 1:2 * (a.n // 3)])
                OR contains(b.line, a.line[2 * (a.n // 3) + 1:])
            ) AND levenshtein(a.line, b.line) <= 2
        ), r(line, other) AS (SELECT a, b FROM e UNION SELECT r.line, e.b FROM r JOIN e ON r.other = e.a),
        c AS (
            SELECT line, min(stays) AS stays
            FROM (SELECT line, first AS stays FROM x UNION ALL SELECT r.line, y.first FROM r JOIN x y ON y.line = r.other)
            GROUP BY line
        ), g AS (SELECT doc_id, place, struct_extract(stays, 1) AS owner FROM l JOIN c USING (line) WHERE spot <> stays)
        SELECT doc_id, count(*) AS n_lines, count(g.owner) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE g.owner IS NULL), '')) AS kept_sha256,
               coalesce(list_sort(list_distinct(list(g.owner) FILTER (WHERE g.owner IS NOT NULL))), []) AS kept_in
        FROM l LEFT JOIN g USING (doc_id, place) GROUP BY doc_id
    """,
    "op5_substring_dedup": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d),
        h AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 34), ' ')) AS x FROM s),
        twice AS (SELECT x FROM h GROUP BY x HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM h SEMI JOIN twice USING (x)),
        word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
        left_over AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept
            FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN left_over USING (doc_id)
    """,
    "op6_jaccard_join": """
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ), one AS (SELECT min(doc_id) AS doc, any_value(w) AS w, count(*) AS copies, text FROM d GROUP BY text),
        s AS (
            SELECT DISTINCT doc, hash(array_to_string(list_slice(w, i, i + 4), ' ')) AS g
            FROM (SELECT doc, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM one WHERE len(w) > 0)
        ), n AS (SELECT doc, count(*) AS n FROM s GROUP BY doc),
        p AS (SELECT a.doc AS a, b.doc AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc <> b.doc GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc = a JOIN n y ON y.doc = b WHERE c >= 0.8 * (x.n + y.n - c)),
        r(doc, root) AS (SELECT a, b FROM e UNION SELECT r.doc, e.b FROM r JOIN e ON r.root = e.a),
        c AS (SELECT doc, least(doc, min(root)) AS class FROM r GROUP BY doc),
        k AS (SELECT a, count(*) AS texts, sum(copies) AS copies FROM e JOIN one ON doc = b GROUP BY a),
        m AS (
            SELECT d.doc_id, coalesce(class, one.doc) AS class_id, coalesce(k.copies, 0) + one.copies - 1 AS n_links,
                   coalesce(k.texts, 0) AS n_texts
            FROM d JOIN one USING (text) LEFT JOIN c ON c.doc = one.doc LEFT JOIN k ON k.a = one.doc
        )
        SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept,
               n_links::BIGINT AS n_links, n_texts
        FROM m
    """,
    "op8_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
        FROM pairs QUALIFY rank <= 20
    """,
    "op9_exact_dedup": """
        WITH rows AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, text_sha256
        FROM rows WINDOW same AS (PARTITION BY text_sha256)
    """,
    "op11_lexical_search": """
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
            FROM documents
        ), g AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
        q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
            FROM benchmark
        ), word AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d),
        tf AS (SELECT doc_id, n, term, count(*) AS tf FROM word SEMI JOIN q USING (term) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * any_value(g.n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, g GROUP BY term),
        s AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * tf.n * g.n) // g.l))))::BIGINT AS score
            FROM q JOIN tf USING (term) JOIN w USING (term), g GROUP BY ALL
        )
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 50
    """,
    "op12_phrases": """
        WITH piece AS (
            SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]'
            )), '[^\\x20\\x09]+') AS w
            FROM documents
        ), n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM piece GROUP BY lang),
        start AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM piece),
        gram AS (SELECT lang, w, i, unnest(range(1, least(6, len(w) - i + 2))) AS size FROM start),
        f AS (
            SELECT lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase, count(*)::HUGEINT AS f
            FROM gram GROUP BY ALL HAVING count(*) >= 100
        ), inside AS (
            SELECT lang, array_to_string(list_slice(string_split(phrase, ' '), i, i + part - 1), ' ') AS phrase, max(f) AS f
            FROM (SELECT *, unnest(range(1, size - part + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS part FROM f WHERE size > 2))
            GROUP BY ALL
        ), cut AS (
            SELECT lang, phrase, size, f, unnest(range(1, size)) AS k, string_split(phrase, ' ') AS w FROM f
            WHERE size > 1 AND NOT EXISTS (SELECT 1 FROM inside x WHERE x.lang = f.lang AND x.phrase = f.phrase AND 100 * x.f >= 100 * f.f)
        ), scored AS (
            SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, n.n, (1000 * c.f * n.n) // (x.f * y.f) AS score, k
            FROM cut c JOIN n USING (lang)
            JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(w, 1, k), ' ')
            JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(w, k + 1, c.size), ' ')
        ), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
               a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
        FROM best QUALIFY rank <= 2000
    """,
}
