"""The same results in plain SQL, for an independent engine to check the queries.

Nothing here runs on Spark. Constants come from the operators, so both sides state them once.
"""

from __future__ import annotations

from termloom.functions.stopwords import ENGLISH
from termloom.functions.text import WIDE_SPACE
from termloom.operators import clusters, search, terms
from termloom.plans import queries as q


def _quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def _word_list(words) -> str:
    return ", ".join(_quoted(w) for w in words)


_SPACE_CLASS = "[" + WIDE_SPACE + "]"

_NAME = "'Doc ' || doc_id"
_PAGES = f"""pages_in AS (
  SELECT doc_id,
         {_NAME} || CASE WHEN source = 'src3' THEN ' (Disambiguation)' ELSE '' END AS title,
         CASE WHEN source IN ('src5', 'src9') THEN 1 ELSE 0 END AS ns,
         CASE WHEN source = 'src11' THEN 'Main page' END AS redirect_to,
         '{{{{Infobox|name=' || {_NAME} || '}}}}[[File:pic_1.jpg|thumb|a picture]]See [[Main page|the main page]], [['
           || {_NAME} || '|]] and [[Talk_page]]<ref name="r">cited ' || {_NAME} || '</ref> https://example.org/'
           || doc_id || '?x=1 <b>' || text || '</b> [[Category:' || lang || ']]' AS raw_text
  FROM documents)"""

_ARTICLE = """ns = 0 AND redirect_to IS NULL AND NOT contains(lower(title), '(disambiguation)') AND raw_text IS NOT NULL"""


def _rewritten(text: str, rules) -> str:
    for pattern, replacement in rules:
        text = f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(replacement)}, 'g')"
    return f"trim({text})"


def _cleaned(text: str) -> str:
    return _rewritten(text, [
        (r"(?is)<ref[^>]*?>.*?</ref>", " "),
        (r"(?s)\{\{.*?\}\}", " "),
        (r"(?s)<[^>]+>", " "),
        (r"(?i)\[\[(?:File|Image):[^\]]*\]\]", " "),
        (r"https?://[^\s\x0B]+", " "),
        (r"\[\[([^|\]]+)\|([^\]]+)\]\]", r"\2"),
        (r"\[\[([^\]]+)\]\]", r"\1"),
        (r"[_\[\]]", " "),
        (r"[\s\x0B]+", " "),
    ])


_LINK = r"\[\[(?:[^|\]]*\|([^\]]*)|([^|\]]+))\]\]"


def _cleaned_v1(text: str) -> str:
    return _rewritten(text, [
        (r"(?is)<ref.*?>.*?</ref>", " "),
        (r"(?s)\{\{.*?\}\}", " "),
        (r"(?i)\[\[(?:File|Image):[^\]]*\]\]", " "),
        (_LINK, r"\1\2"),
        (r"<[^>]+>", " "),
        (f"https?://[^{WIDE_SPACE}]+", " "),
        (r"\[\[|\]\]", " "),
        (f"{_SPACE_CLASS}+", " "),
    ])


def _tokens(name: str, source: str = "documents", stopwords=ENGLISH) -> str:
    """CTE (doc_id, pos, token)."""
    stop = f" AND token NOT IN ({_word_list(stopwords)})" if stopwords else ""
    return f"""{name} AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY raw_pos) - 1 AS INTEGER) AS pos, token
  FROM (SELECT doc_id, unnest(parts) AS token, generate_subscripts(parts, 1) AS raw_pos
        FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z]+') AS parts FROM {source}))
  WHERE length(token) >= 2{stop})"""


def _vocab(name: str, tokens: str, size: int = q.VOCAB_SIZE) -> str:
    """CTE (term_id, term, df, cf)."""
    return f"""{name} AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY cf DESC, term) - 1 AS INTEGER) AS term_id, term, df, cf
  FROM (SELECT token AS term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM {tokens} GROUP BY token)
  WHERE df >= {q.MIN_DF}
  ORDER BY cf DESC, term LIMIT {size})"""


_TOK = _tokens("tok")
_VOCAB = f"{_TOK},\n{_vocab('vocab', 'tok')}"
_TFIDF = f"""{_VOCAB},
tf AS MATERIALIZED (SELECT doc_id, term_id, count(*) AS tf FROM tok JOIN vocab ON token = term GROUP BY doc_id, term_id),
n_docs AS (SELECT count(*) AS n FROM documents),
idf AS MATERIALIZED (SELECT term_id, term, ln((n + 1) / (CAST(d.df AS DOUBLE) + 1)) AS idf
        FROM (SELECT term_id, count(*) AS df FROM tf GROUP BY term_id) d JOIN vocab USING (term_id), n_docs),
tfidf AS (SELECT doc_id, term_id, term, tf * idf AS tfidf FROM tf JOIN idf USING (term_id))"""

_V = "cos((term_id + 1.0) * (topic + 1))"
_S = f"({q.FIXED_RANK} - topic)"
_TOPIC_IDS = f"topic_ids AS (SELECT CAST(unnest(range(0, {q.FIXED_RANK})) AS INTEGER) AS topic)"
_DOC_CELLS = f"""{_TFIDF},
{_TOPIC_IDS},
doc_cells AS (
  SELECT d.doc_id, t.topic, coalesce(p.value, 0.0) AS value
  FROM documents d CROSS JOIN topic_ids t
  LEFT JOIN (SELECT doc_id, topic, sum(tfidf * {_V}) AS value FROM tfidf CROSS JOIN topic_ids GROUP BY doc_id, topic) p
    ON p.doc_id = d.doc_id AND p.topic = t.topic)"""
_TERM_CELLS = f"""term_cells AS (SELECT term_id, term, topic, CAST({_V} * {_S} AS DOUBLE) AS value FROM vocab CROSS JOIN topic_ids),
term_vecs AS (SELECT term_id, term, list(value ORDER BY topic) AS e FROM term_cells GROUP BY term_id, term)"""
_TOPIC_ROWS = f"""topic_rows AS (
  SELECT topic, CAST({_S} AS DOUBLE) AS singular_value, CAST(rank - 1 AS INTEGER) AS pos, term, weight
  FROM (SELECT topic, term, {_V} AS weight,
               row_number() OVER (PARTITION BY topic ORDER BY abs({_V}) DESC, term_id) AS rank
        FROM vocab CROSS JOIN topic_ids)
  WHERE rank <= 20)"""
_TOPICS_FIXED = f"""WITH {_VOCAB}, {_TOPIC_IDS}, {_TOPIC_ROWS}
SELECT topic, singular_value, pos, term, round(weight, 6) AS weight FROM topic_rows"""

_VECS = "vecs AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _iterated(name: str, matrix: str, width: str, steps: int = 3000) -> str:
    """CTE (v): leading eigenvector of a symmetric matrix (CTE with m) by power iteration, largest entry positive."""
    return f"""{name}_steps(n, v) AS (
  SELECT 0, list_transform(range(({width})), lambda i: 1.0 + (i * 7 % 11) / 10.0)
  UNION ALL
  SELECT n + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w)))
  FROM (SELECT n, list_transform(m, lambda r: list_dot_product(r, v)) AS w FROM {name}_steps, {matrix} WHERE n < {steps})),
{name} AS (SELECT list_transform(v, lambda x: x * sign(list_max(v) + list_min(v))) AS v FROM {name}_steps WHERE n = {steps})"""


def _two_axes(matrix: str) -> str:
    """CTEs one and two (v, l): the two leading eigenvectors and eigenvalues of CTE `matrix` (m)."""
    width = f"SELECT len(m) FROM {matrix}"
    return f"""{_iterated("first", matrix, width)},
one AS (SELECT v, m, list_dot_product(list_transform(m, lambda r: list_dot_product(r, v)), v) AS l FROM first, {matrix}),
rest AS (SELECT list_transform(range(1, len(v) + 1), lambda i: list_transform(range(1, len(v) + 1), lambda j: m[i][j] - l * v[i] * v[j])) AS m FROM one),
{_iterated("second", "rest", width)},
two AS (SELECT v, list_dot_product(list_transform(m, lambda r: list_dot_product(r, v)), v) AS l FROM second, {matrix})"""


def _product(name: str, rows: str) -> str:
    """CTE (m): the sums of products of the columns of `rows` (vec_id, e)."""
    return f"""{name}_cells AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM {rows}),
{name} AS (SELECT list(r ORDER BY i) AS m FROM (
  SELECT i, list(g ORDER BY j) AS r FROM (
    SELECT a.pos AS i, b.pos AS j, sum(a.x * b.x) AS g FROM {name}_cells a JOIN {name}_cells b USING (vec_id) GROUP BY ALL)
  GROUP BY i))"""


_UNIT = """unit AS (
  SELECT vec_id, list_transform(e, lambda x: x / CASE WHEN list_dot_product(e, e) > 0 THEN sqrt(list_dot_product(e, e)) ELSE 1 END) AS e
  FROM vecs)"""


def _long_rows(rows: str) -> str:
    return f"{rows}_long AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM {rows})"


def _lloyd(rows: str, k: int = clusters.DEFAULT_K, name: str = "") -> str:
    """CTEs c<name><t> (cluster, e) and a<name><t> (vec_id, cluster): k-means steps from the first k vectors of `rows`.
    The long form of `rows` comes with those without a name."""
    parts = [] if name else [_long_rows(rows)]
    parts.append(f"c{name}0 AS (SELECT CAST(vec_id AS INTEGER) AS cluster, e FROM {rows} WHERE vec_id < {k})")
    for t in range(q.LLOYD_STEPS + 1):
        parts.append(f"""a{name}{t} AS MATERIALIZED (SELECT p.vec_id, arg_min(cluster, list_distance(p.e, c{name}{t}.e)) AS cluster
  FROM {rows} p CROSS JOIN c{name}{t} GROUP BY p.vec_id)""")
        parts.append(f"""c{name}{t + 1} AS (SELECT cluster, list(x ORDER BY pos) AS e FROM (
  SELECT cluster, pos, avg(x) AS x FROM a{name}{t} JOIN {rows}_long USING (vec_id) GROUP BY cluster, pos) GROUP BY cluster)""")
    return ",\n".join(parts)


def _sweep() -> str:
    """CTE by_fit (labeling, vec_id, cluster): the labels of the given fits, the labeling being k."""
    fits = ",\n".join(_lloyd("vecs", k, f"_{k}_") for k in q.SWEEP_GIVEN)
    labels = " UNION ALL ".join(f"SELECT {k} AS labeling, vec_id, cluster FROM a_{k}_{q.LLOYD_STEPS}" for k in q.SWEEP_GIVEN)
    return f"{_long_rows('vecs')},\n{fits},\nby_fit AS ({labels})"


_AXES = f"""mean AS (SELECT list(x ORDER BY pos) AS mu FROM (
  SELECT pos, avg(x) AS x FROM (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM unit) GROUP BY pos)),
middle AS (SELECT vec_id, list_transform(range(1, len(e) + 1), lambda i: e[i] - mu[i]) AS e FROM unit, mean),
{_product("spread", "middle")},
{_two_axes("spread")}"""

_SVD_TRUNCATED = f"""WITH RECURSIVE {_VECS},
{_product("gram", "vecs")},
{_two_axes("gram")}
SELECT vec_id, round(list_dot_product(e, one.v), 4) AS us_0, round(list_dot_product(e, two.v), 4) AS us_1,
       round(sqrt(one.l), 4) AS s_0, round(sqrt(two.l), 4) AS s_1
FROM vecs, one, two"""


def _norm(v: str) -> str:
    return f"sqrt(list_dot_product({v}, {v}))"


def _cosine(a: str, b: str, mode: str = "viewer") -> str:
    na, nb = _norm(a), _norm(b)
    if mode == "viewer":
        return f"CASE WHEN {na} = 0 OR {nb} = 0 THEN 0.0 ELSE list_dot_product({a}, {b}) / ({na} * {nb} + 1e-9) END"
    if mode == "sample_v3":
        na, nb = (f"(CASE WHEN {n} > 0 THEN {n} ELSE 1.0 END)" for n in (na, nb))
    return f"list_dot_product({a}, {b}) / ({na} * {nb} + 1e-12)"


def _similar(corpus: str, key: str, label: str, wanted: str, own: str | None, mode: str = "viewer") -> str:
    """Best 20 of (key, label, e) rows against the e of `wanted`."""
    skip = f"WHERE c.{key} <> w.{own}" if own else ""
    return f"""SELECT {key}, {label}, round(score, 6) AS score FROM (
  SELECT c.{key}, c.{label}, {_cosine('c.e', 'w.e', mode)} AS score FROM {corpus} c CROSS JOIN ({wanted}) w {skip})
ORDER BY score DESC, {label} DESC, {key} LIMIT {search.TOP_RESULTS}"""


_BY_VECTOR = "terms_in AS (SELECT vec_id AS term_id, 'v' || vec_id AS term, e FROM vecs)"
_DOCS_BY_LABEL = "docs_in AS (SELECT vec_id AS doc_id, ' Label ' || label AS title, e FROM vecs)"
_PAIRS = f"""WITH {_VECS}, pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS term_id, 'v' || b.vec_id AS term, {_cosine('a.e', 'b.e')} AS score
  FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, term_id, term, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, {search.SCORE_DIGITS}) DESC, term DESC, term_id) AS rank FROM pairs)
WHERE rank <= {search.TOP_RESULTS}"""


def _cells(rows: str, array: str, *keys: str, name: str = "value") -> str:
    listed = ", ".join(keys)
    return f"""SELECT {listed}, CAST(i - 1 AS INTEGER) AS pos, round(x, 6) AS {name}
FROM (SELECT {listed}, unnest({array}) AS x, generate_subscripts({array}, 1) AS i FROM {rows})"""


def _neighbors(mode: str, candidates: str = "true") -> str:
    return f"""neighbor_rows AS (
  SELECT term, CAST(rank - 1 AS INTEGER) AS pos, neighbor, score
  FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY round(score, {search.SCORE_DIGITS}) DESC, term_id) AS rank
        FROM (SELECT s.term, c.term AS neighbor, c.term_id, {_cosine('s.e', 'c.e', mode)} AS score
              FROM (SELECT * FROM term_vecs WHERE term IN ({_word_list(q.SEEDS)})) s
              CROSS JOIN (SELECT * FROM term_vecs WHERE {candidates}) c))
  WHERE rank <= {search.SAMPLE_NEIGHBORS})"""


def _neighbor_query(mode: str, candidates: str = "true") -> str:
    return f"""WITH {_VOCAB}, {_TOPIC_IDS}, {_TERM_CELLS}, {_neighbors(mode, candidates)}
SELECT term, pos, neighbor, round(score, 6) AS score FROM neighbor_rows"""


_DISTANCES = f"""{_VECS}, dist AS (
  SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.label AS a_label, b.label AS b_label, list_distance(a.e, b.e) AS d
  FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id)"""


def _silhouette(labels: str, distance: str = "d") -> str:
    """Mean silhouette per labeling from CTE `labels` (labeling, vec_id, cluster) and `dist`."""
    return f"""to_cluster AS (
  SELECT la.labeling, la.vec_id, la.cluster, lb.cluster AS other, avg({distance}) AS mean_d
  FROM dist JOIN {labels} la ON la.vec_id = a_id JOIN {labels} lb ON lb.vec_id = b_id AND lb.labeling = la.labeling
  GROUP BY la.labeling, la.vec_id, la.cluster, lb.cluster),
per_point AS (
  SELECT labeling, vec_id, max(CASE WHEN other = cluster THEN mean_d END) AS a,
         min(CASE WHEN other <> cluster THEN mean_d END) AS b
  FROM to_cluster GROUP BY labeling, vec_id),
scores AS (
  SELECT labeling, avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette
  FROM per_point GROUP BY labeling)"""


_BY_LABEL = "by_label AS (SELECT 'label' AS labeling, vec_id, label AS cluster FROM vecs)"
_BY_MODULUS = (
    f"by_modulus AS (SELECT k AS labeling, vec_id, vec_id % k AS cluster FROM vecs "
    f"CROSS JOIN (SELECT CAST(unnest(range({min(clusters.SWEEP)}, {max(clusters.SWEEP) + 1})) AS INTEGER) AS k))"
)
_SILHOUETTE = f"""WITH {_DISTANCES}, {_BY_LABEL}, {_silhouette('by_label')}
SELECT labeling, round(silhouette, 6) AS silhouette FROM scores"""

_LONG = f"""{_VECS}, cells AS (
  SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS pos, x
  FROM (SELECT vec_id, label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM vecs))"""
_CENTERS = f"""{_VECS}, center_cells AS (
  SELECT label AS cluster, i, avg(x) AS x
  FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM vecs) GROUP BY label, i),
centers AS (SELECT cluster, list(x ORDER BY i) AS c FROM center_cells GROUP BY cluster),
assigned AS (
  SELECT vec_id, e, cluster, d * d AS distance2
  FROM (SELECT vec_id, e, cluster, list_distance(e, c) AS d,
               row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(e, c), cluster) AS rank
        FROM vecs CROSS JOIN centers)
  WHERE rank = 1)"""


def _title_status(text: str) -> str:
    hits = f"(SELECT count(*) FROM docs_in WHERE contains(lower(trim(title)), '{text}'))" if len(text) >= 3 else "0"
    return (
        f"SELECT CAST({hits} AS BIGINT) AS matches, CASE WHEN {hits} = 0 THEN 'none' WHEN {hits} = 1 THEN 'one' "
        f"ELSE 'many' END AS status, '{text}' AS query"
    )


_WITHOUT_COMMON = f"""WITH {_tokens('tok', stopwords=())},
common AS (SELECT token FROM tok GROUP BY token
           HAVING count(DISTINCT doc_id) > {q.COMMON_SHARE} * (SELECT count(*) FROM documents))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos, token
FROM tok WHERE token NOT IN (SELECT token FROM common)"""
_LEMMAS = f"""WITH {_TOK} SELECT doc_id, pos,
CASE WHEN token LIKE '%s' AND length(token) >= 4 THEN substr(token, 1, length(token) - 1) ELSE token END AS token FROM tok"""

_SEED_ROWS = ", ".join(f"({i}, {_quoted(s)})" for i, s in enumerate(q.SEEDS))
_FIRST_OF_TITLE = """firsts AS (
  SELECT lower(trim(title)) AS title, min(doc_id) AS doc_id, arg_min(e, doc_id) AS e FROM docs_in GROUP BY 1)"""

_XML = f"WITH {_PAGES} SELECT title, ns, redirect_to, raw_text FROM pages_in"

SQL: dict[str, str] = {
    "xml_pages_roundtrip": _XML,
    "xml_pages_by_record": _XML,
    "xml_pages_inferred": _XML,
    "xml_pages_by_file": _XML,
    "xml_pages_inferred_by_file": _XML,
    "xml_pages_odd_markup": f"""SELECT {_NAME} AS title, 0 AS ns, CAST(NULL AS VARCHAR) AS redirect_to, {_quoted(q.ODD_TEXT)} || text AS raw_text
FROM documents WHERE text IS NOT NULL""",
    "articles_filter": f"WITH {_PAGES} SELECT doc_id, title, raw_text FROM pages_in WHERE {_ARTICLE}",
    "article_text_nonempty": f"""WITH {_PAGES}
SELECT * FROM (SELECT doc_id, title, {_cleaned('raw_text')} AS text FROM pages_in WHERE {_ARTICLE}) WHERE length(text) > 0""",
    "page_limit": f"WITH {_PAGES} SELECT doc_id, title, ns FROM pages_in ORDER BY doc_id LIMIT {q.PAGE_CAP}",
    "page_hash_sample": f"""WITH {_PAGES} SELECT doc_id, title FROM pages_in
WHERE CAST('0x' || substr(md5(doc_id || ':13'), 1, 8) AS BIGINT) < {int(q.SAMPLE_FRACTION * 2**32)}""",
    "vocab_fit_sample": f"""WITH sampled AS (SELECT doc_id, text FROM documents
  WHERE CAST('0x' || substr(md5(doc_id || ':13'), 1, 8) AS BIGINT) < {int(q.FIT_FRACTION * 2**32)}),
{_tokens('tok', 'sampled')}, {_vocab('vocab', 'tok')}
SELECT * FROM vocab""",
    "clean_markup": f"WITH {_PAGES} SELECT doc_id, {_cleaned('raw_text')} AS text FROM pages_in",
    "clean_markup_html": f"SELECT page_id, {_cleaned('html')} AS text FROM pages",
    "clean_markup_v1": f"WITH {_PAGES} SELECT doc_id, {_cleaned_v1('raw_text')} AS text FROM pages_in",
    "collapse_links": f"""WITH {_PAGES}
SELECT doc_id, regexp_replace(raw_text, {_quoted(_LINK)}, '\\1\\2', 'g') AS text FROM pages_in""",
    "tokens": f"WITH {_tokens('tok', stopwords=())} SELECT doc_id, pos, token FROM tok",
    "tokens_no_stopwords": f"WITH {_TOK} SELECT doc_id, pos, token FROM tok",
    "tokens_custom_stopwords": _WITHOUT_COMMON,
    "tokens_custom_stopwords_join": _WITHOUT_COMMON,
    "lemmas": _LEMMAS,
    "lemmas_join": _LEMMAS,
    "lemmas_detached": f"""WITH {_TOK}, forms AS (SELECT DISTINCT token AS form FROM tok),
bases AS (SELECT form FROM forms WHERE NOT form LIKE '%s'),
endings(old, new) AS (VALUES {', '.join(f"({_quoted(old)}, {_quoted(new)})" for old, new in terms.NOUN_ENDINGS)}),
candidates AS (
  SELECT form, substr(form, 1, length(form) - length(old)) || new AS lemma FROM forms JOIN endings ON form LIKE '%' || old
  WHERE length(form) > length(old) AND form NOT IN (SELECT form FROM bases)),
best AS (
  SELECT form, lemma FROM candidates WHERE lemma IN (SELECT form FROM bases)
  QUALIFY row_number() OVER (PARTITION BY form ORDER BY length(lemma), lemma) = 1)
SELECT doc_id, pos, coalesce(lemma, token) AS token FROM tok LEFT JOIN best ON token = form""",
    "normalize_title": "SELECT doc_id, lower(source) || ' doc ' || doc_id AS title FROM documents",
    "normalize_query": f"""SELECT conv_id, turn,
  CAST(row_number() OVER (PARTITION BY conv_id, turn, role, text ORDER BY i) - 1 AS INTEGER) AS pos, word
FROM (SELECT conv_id, turn, role, text, unnest(parts) AS word, generate_subscripts(parts, 1) AS i
      FROM (SELECT *, regexp_split_to_array(lower(text), '{_SPACE_CLASS}+') AS parts FROM conversations))
WHERE word <> ''""",
    "term_stats": f"""WITH {_TOK}
SELECT token AS term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tok GROUP BY token""",
    "vocabulary_cut": f"WITH {_TOK}, {_vocab('vocab', 'tok', q.SMALL_VOCABULARY)} SELECT term_id, term, df, cf FROM vocab",
    "vocabulary_pruned": f"WITH {_VOCAB} SELECT term_id, term, df, cf FROM vocab",
    "vocabulary": f"WITH {_VOCAB} SELECT term_id, term, df, cf FROM vocab",
    "term_frequency": f"WITH {_TFIDF} SELECT doc_id, term_id, tf FROM tf",
    "idf": f"WITH {_TFIDF} SELECT term_id, term, round(idf, 6) AS idf FROM idf",
    "tfidf": f"WITH {_TFIDF} SELECT doc_id, term_id, round(tfidf, 6) AS tfidf FROM tfidf",
    "top_tfidf_terms": f"""WITH {_TFIDF} SELECT doc_id, CAST(rank AS INTEGER) AS rank, term, round(tfidf, 6) AS tfidf
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term_id) AS rank FROM tfidf)
WHERE rank <= {q.TOP_TERMS}""",
    "topics_fixed_v": _TOPICS_FIXED,
    "merged_shards": _TOPICS_FIXED,
    "doc_embed_fixed_v": f"WITH {_DOC_CELLS} SELECT doc_id, topic AS pos, round(value, 6) AS value FROM doc_cells",
    "doc_embed_fixed_v_join": f"WITH {_DOC_CELLS} SELECT doc_id, topic AS pos, round(value, 6) AS value FROM doc_cells",
    "term_embed_fixed_v": f"""WITH {_VOCAB}, {_TOPIC_IDS}, {_TERM_CELLS}
SELECT term_id, term, topic AS pos, round(value, 6) AS value FROM term_cells""",
    "topic_strength": f"""WITH {_VOCAB}, {_TOPIC_IDS}, {_TOPIC_ROWS}
SELECT DISTINCT topic, singular_value FROM topic_rows""",
    "topic_strength_fitted": f"""WITH RECURSIVE {_VECS}, {_product("gram", "vecs")}, {_two_axes("gram")}
SELECT CAST(0 AS INTEGER) AS topic, round(sqrt(one.l), 4) AS singular_value FROM one
UNION ALL SELECT CAST(1 AS INTEGER), round(sqrt(two.l), 4) FROM two""",
    "svd_gram": f"""WITH {_LONG}
SELECT a.pos AS i, b.pos AS j, round(sum(a.x * b.x), 6) AS value
FROM cells a JOIN cells b ON a.vec_id = b.vec_id GROUP BY a.pos, b.pos""",
    "svd_truncated": _SVD_TRUNCATED,
    "svd_block": _SVD_TRUNCATED,
    "svd_block_join": _SVD_TRUNCATED,
    "kmeans_given": f"""WITH {_VECS}, {_lloyd('vecs')}
SELECT cluster, CAST(i - 1 AS INTEGER) AS pos, round(x, 6) AS value
FROM (SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM c{q.LLOYD_STEPS})""",
    "final_clusters_given": f"""WITH {_VECS}, {_UNIT}, {_lloyd('unit')} SELECT vec_id, cluster FROM a{q.LLOYD_STEPS}""",
    "pca_2d": f"""WITH RECURSIVE {_VECS}, {_UNIT}, {_AXES}
SELECT vec_id, round(list_dot_product(e, one.v), 4) AS x, round(list_dot_product(e, two.v), 4) AS y FROM middle, one, two""",
    "scatter_given": f"""WITH RECURSIVE {_VECS}, {_UNIT}, {_lloyd('unit')}, {_AXES}, shown AS (
  SELECT middle.e, cluster, false AS is_center FROM middle JOIN a{q.LLOYD_STEPS} USING (vec_id)
  UNION ALL
  SELECT list_transform(range(1, len(e) + 1), lambda i: e[i] - mu[i]), cluster, true FROM c{q.LLOYD_STEPS}, mean)
SELECT round(list_dot_product(e, one.v), 4) AS x, round(list_dot_product(e, two.v), 4) AS y, cluster, is_center FROM shown, one, two""",
    "svd_similar_docs": f"""WITH {_VECS}, docs_in AS (SELECT vec_id AS doc_id, CAST(vec_id AS VARCHAR) AS title, e FROM vecs)
{_similar('docs_in', 'doc_id', 'title', 'SELECT doc_id AS own, e FROM docs_in WHERE doc_id = 3', 'own')}""",
    "vector_norms": f"""WITH {_VECS} SELECT vec_id, round({_norm('e')}, 6) AS norm,
  round(CASE WHEN {_norm('e')} > 0 THEN {_norm('e')} ELSE 1.0 END, 6) AS safe_norm,
  round(list_dot_product(e, list_reverse(e)), 6) AS dot_reversed FROM vecs""",
    "cosine_modes": f"""WITH {_VECS}, sides AS (
  SELECT vec_id, CASE WHEN label = 0 THEN CAST([x * 0 FOR x IN e] AS DOUBLE[]) ELSE e END AS a, list_reverse(e) AS b FROM vecs)
SELECT vec_id, {", ".join(f"round({_cosine('a', 'b', m)}, 6) AS {m}" for m in ("viewer", "sample_v1", "sample_v3"))}
FROM sides""",
    "similar_terms": f"""WITH {_VECS}, {_BY_VECTOR}
{_similar('terms_in', 'term_id', 'term', "SELECT term_id AS own, e FROM terms_in WHERE term = 'v7'", 'own')}""",
    "similar_docs": f"""WITH {_VECS}, {_DOCS_BY_LABEL}
{_similar('docs_in', 'doc_id', 'title', 'SELECT doc_id AS own, e FROM docs_in WHERE doc_id = 3', 'own')}""",
    "docs_for_term": f"""WITH {_DOC_CELLS}, {_TERM_CELLS},
docs_in AS (SELECT doc_id, 'doc ' || doc_id AS title, list(value ORDER BY topic) AS e FROM doc_cells GROUP BY doc_id)
{_similar('docs_in', 'doc_id', 'title', "SELECT e FROM term_vecs WHERE term = 'de'", None)}""",
    "neighbor_samples": _neighbor_query("sample_v3"),
    "neighbor_samples_cut": _neighbor_query("sample_v3", f"term_id < {q.SAMPLE_CANDIDATES}"),
    "neighbor_samples_v1": _neighbor_query("sample_v1"),
    "batch_knn": _PAIRS,
    "batch_knn_blocks": _PAIRS,
    "batch_knn_pruned": _PAIRS,
    "resolve_title": f"""WITH {_VECS}, {_DOCS_BY_LABEL},
found AS (SELECT doc_id, lower(trim(title)) AS title FROM docs_in WHERE contains(lower(trim(title)), 'label 3'))
SELECT doc_id, title, CASE WHEN (SELECT count(*) FROM found) > 1 THEN 'many' ELSE 'one' END AS status FROM found""",
    "resolve_title_index": f"""WITH titles AS (
  SELECT doc_id, lower(regexp_replace(' ' || array_to_string(string_split(text, ' ')[1:{q.TITLE_WORDS}], ' ') || ' ',
         '^{_SPACE_CLASS}+|{_SPACE_CLASS}+$', '', 'g')) AS title FROM documents),
queries(query) AS (VALUES {', '.join(f"({_quoted(t.strip().lower())})" for t in q.TITLE_QUERIES)})
SELECT doc_id, title, CASE WHEN count(*) OVER (PARTITION BY query) > 1 THEN 'many' ELSE 'one' END AS status, query
FROM titles JOIN queries ON contains(title, query) WHERE length(query) >= 3""",
    "title_status": f"""WITH {_VECS}, {_DOCS_BY_LABEL}
{' UNION ALL '.join(_title_status(t) for t in ('label 3', 'la', 'no such title'))}""",
    "select_title": f"""WITH {_VECS}, {_DOCS_BY_LABEL}, {_FIRST_OF_TITLE}
{_cells('firsts', 'e', 'title', 'doc_id')} WHERE title = 'label 3'""",
    "first_of_title": f"""WITH {_VECS}, {_DOCS_BY_LABEL}, {_FIRST_OF_TITLE}
{_cells('firsts', 'e', 'title', 'doc_id')}""",
    "seed_semi": f"""WITH {_VOCAB}, seeds(seed_pos, term) AS (VALUES {_SEED_ROWS})
SELECT seed_pos, term FROM seeds WHERE term IN (SELECT term FROM vocab)""",
    "json_artifacts_roundtrip": f"""WITH {_DOC_CELLS}, {_TOPIC_ROWS}, {_TERM_CELLS}, {_neighbors('sample_v3')}
SELECT 'topic' AS kind, CAST(topic AS VARCHAR) AS name, pos, round(weight, 6) AS value FROM topic_rows
UNION ALL SELECT 'term', term, topic, round(value, 6) FROM term_cells
UNION ALL SELECT 'doc', 'Doc ' || doc_id, topic, round(value, 6) FROM doc_cells
UNION ALL SELECT 'neighbor', term, pos, round(score, 6) FROM neighbor_rows""",
    "parquet_roundtrip": "SELECT doc_id, lang, n_chars, md5(text) AS text_md5 FROM documents",
    "literal_table": f"""WITH {_TOK}, seeds(seed_pos, term) AS (VALUES {_SEED_ROWS})
SELECT seed_pos, term, count(DISTINCT doc_id) AS df, count(doc_id) AS cf
FROM seeds LEFT JOIN tok ON token = term GROUP BY seed_pos, term""",
    "index_range": f"WITH {_VOCAB} SELECT unnest(range(0, (SELECT count(*) FROM vocab))) AS id",
    "dedupe_terms": f"""WITH {_VECS}, lasts AS (
  SELECT 'label ' || label AS term, min(vec_id) AS first_seen, arg_max(e, vec_id) AS e FROM vecs GROUP BY label)
{_cells('lasts', 'e', 'term', 'first_seen')}""",
    "kmeans_assign": f"WITH {_CENTERS} SELECT vec_id, cluster, round(distance2, 6) AS distance2 FROM assigned",
    "kmeans_update": f"""WITH {_CENTERS} SELECT cluster, CAST(i - 1 AS INTEGER) AS pos, round(avg(x), 6) AS value
FROM (SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM assigned) GROUP BY cluster, i""",
    "cluster_sizes": "SELECT label AS cluster, count(*) AS count FROM embeddings GROUP BY label",
    "silhouette": _SILHOUETTE,
    "silhouette_blocks": _SILHOUETTE,
    "silhouette_squared": f"""WITH {_DISTANCES}, {_BY_LABEL}, {_silhouette('by_label', 'd * d')}
SELECT labeling, round(silhouette, 6) AS silhouette FROM scores""",
    "silhouette_labelings": f"""WITH {_DISTANCES}, {_BY_MODULUS}, {_silhouette('by_modulus')}
SELECT labeling AS k, round(silhouette, 6) AS silhouette FROM scores""",
    "silhouette_sampled": f"""WITH {_DISTANCES},
two AS (SELECT 'label' AS labeling, vec_id, label AS cluster FROM vecs UNION ALL SELECT 'third', vec_id, vec_id % 3 FROM vecs),
{_silhouette('two')},
size AS (SELECT labeling, cluster, count(*) AS n FROM two GROUP BY ALL),
picked AS (SELECT labeling, vec_id, cluster FROM two QUALIFY row_number() OVER (
  PARTITION BY labeling, cluster ORDER BY md5(vec_id || ':{clusters.SEED}'), vec_id) <= {q.SAMPLED_POINTS}),
score AS (
  SELECT labeling, cluster, CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s
  FROM picked JOIN per_point USING (labeling, vec_id)),
stratum AS (
  SELECT labeling, n, count(*) AS m, avg(s) AS mean, coalesce(var_samp(s), 0) AS spread
  FROM score JOIN size USING (labeling, cluster) GROUP BY labeling, cluster, n)
SELECT labeling, round(sum(n * mean) / sum(n), 6) AS silhouette,
       round(sqrt(sum(n * n * spread / m * (1 - m / n))) / sum(n), 6) AS standard_error, sum(m)::BIGINT AS sampled
FROM stratum GROUP BY labeling""",
    "silhouette_sweep_given": f"""WITH {_DISTANCES}, {_sweep()}, {_silhouette('by_fit')}
SELECT CAST(labeling AS INTEGER) AS k, round(silhouette, 6) AS silhouette FROM scores""",
    "pick_k": f"""WITH {_DISTANCES}, {_BY_MODULUS}, {_silhouette('by_modulus')}
SELECT (SELECT labeling FROM scores ORDER BY silhouette DESC, labeling LIMIT 1) AS k, 'argmax' AS mode
UNION ALL SELECT {clusters.DEFAULT_K}, 'fixed'""",
    "normalize_rows": f"""WITH {_LONG}, norms AS (SELECT vec_id, {_norm('e')} AS norm FROM vecs)
SELECT vec_id, pos, round(coalesce(x / nullif(norm, 0), x), 6) AS value FROM cells JOIN norms USING (vec_id)""",
    "cluster_radius": f"""WITH {_VECS}, plane AS (SELECT label AS cluster, e[1] AS x, e[2] AS y FROM vecs),
middle AS (SELECT cluster, avg(x) AS cx, avg(y) AS cy FROM plane GROUP BY cluster)
SELECT cluster, round(avg(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))), 6) AS radius
FROM plane JOIN middle USING (cluster) GROUP BY cluster""",
    "pca_covariance": f"""WITH {_LONG}, norms AS (SELECT vec_id, {_norm('e')} AS norm FROM vecs),
unit AS (SELECT vec_id, pos, coalesce(x / nullif(norm, 0), x) AS x FROM cells JOIN norms USING (vec_id))
SELECT a.pos AS i, b.pos AS j, round(covar_samp(a.x, b.x), 6) AS covariance
FROM unit a JOIN unit b ON a.vec_id = b.vec_id GROUP BY a.pos, b.pos""",
}
