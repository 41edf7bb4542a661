"""Parts of the SQL that the library's queries are checked against, by another engine on the same tables."""

from __future__ import annotations

from skeinwork.functions import text as X

STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def norm(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({x}), '{X.ACCENTED}', '{X.PLAIN}'), '[^a-z0-9]+', ' ', 'g'))"


DOCS = """docs AS MATERIALIZED (
  SELECT doc_id, substr(split_part(coalesce(text, ''), chr(10), 1), 1, 80) AS title, coalesce(text, '') AS content, coalesce(source, 'Uncategorised') AS category FROM documents
)"""

TOKENS = f"""{DOCS}, raw AS (
  SELECT doc_id, 'title' AS field, unnest(string_split({norm('title')}, ' ')) AS surface FROM docs
  UNION ALL SELECT doc_id, 'content', unnest(string_split({norm('content')}, ' ')) FROM docs
), kept AS MATERIALIZED (
  SELECT doc_id, field, surface, count(*) AS n FROM raw WHERE length(surface) > 1 AND surface NOT IN ({STOP}) GROUP BY ALL
), stems AS MATERIALIZED (
  SELECT surface, {X.stem_sql('surface')} AS term FROM (SELECT DISTINCT surface FROM kept)
), tokens AS MATERIALIZED (SELECT doc_id, field, surface, term, n FROM kept JOIN stems USING (surface))"""

INDEX = f"""{TOKENS}, keywords AS MATERIALIZED (
  SELECT doc_id, term AS keyword, rank FROM (
    SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank
    FROM (SELECT doc_id, term, sum(n) AS n FROM tokens WHERE field = 'content' GROUP BY ALL)) WHERE rank <= 6
), keyword_tokens AS (
  SELECT doc_id, 'keywords' AS field, keyword AS surface, {X.stem_sql('keyword')} AS term, count(*) AS n
  FROM keywords WHERE length(keyword) > 1 AND keyword NOT IN ({STOP}) GROUP BY ALL
), every AS MATERIALIZED (SELECT * FROM tokens UNION ALL SELECT * FROM keyword_tokens
), postings AS MATERIALIZED (
  SELECT term, doc_id, CAST(sum(n * CASE field WHEN 'title' THEN 4 WHEN 'content' THEN 1 ELSE 4 END) AS BIGINT) AS wtf FROM every GROUP BY ALL
), votes AS (
  SELECT term, surface, sum(n * CASE field WHEN 'title' THEN 4 WHEN 'content' THEN 1 ELSE 4 END) AS votes FROM every GROUP BY ALL
), vocabulary AS MATERIALIZED (
  SELECT term, display, doc_freq, freq FROM (SELECT term, count(*) AS doc_freq, CAST(sum(wtf) AS BIGINT) AS freq FROM postings GROUP BY term)
  JOIN (SELECT term, surface AS display FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY votes DESC, surface) AS i FROM votes) WHERE i = 1) USING (term)
), bag AS MATERIALIZED (SELECT term, doc_id, sum(n) AS n FROM every GROUP BY ALL
), size AS (SELECT count(*) AS docs FROM documents
), idf AS MATERIALIZED (SELECT term, df, total, ln((1.0 + docs) / (1.0 + df)) + 1.0 AS idf FROM (SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS total FROM bag GROUP BY term), size)"""

WEIGHTS = f"""{INDEX}, raw_weights AS MATERIALIZED (SELECT term, doc_id, n * idf AS x FROM bag JOIN idf USING (term)
), norms AS MATERIALIZED (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM raw_weights GROUP BY doc_id
), weights AS (SELECT term, doc_id, x / norm AS w FROM raw_weights JOIN norms USING (doc_id))"""


def cosine(terms: list[str]) -> str:
    """cos AS (doc_id, score) for terms that are all in the vocabulary or weigh nothing."""
    rows = ", ".join(f"('{t}')" for t in terms)
    return f"""{WEIGHTS}, asked AS (SELECT t AS term, count(*) / {float(len(terms))} AS tf FROM (VALUES {rows}) AS v(t) GROUP BY t
), qraw AS (SELECT term, tf * idf AS x FROM asked JOIN idf USING (term)
), qv AS (SELECT term, x / sqrt((SELECT sum(x * x) FROM qraw)) AS q FROM qraw
), cos AS MATERIALIZED (SELECT doc_id, round(sum(w * q), 6) AS score FROM weights JOIN qv USING (term) GROUP BY doc_id)"""


HISTORY = """history AS MATERIALIZED (
  SELECT event_id AS id, event_type AS query, CASE WHEN value < 10 THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS result_count, value AS execution_time, user_id AS doc_id, ts FROM events
)"""

STEPS = """steps AS MATERIALIZED (
  SELECT * FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst, l_quantity AS quantity, l_extendedprice AS price FROM lineitem) WHERE dst IS NOT NULL AND dst <> src
)"""

SIMILAR = f"""{INDEX}, kw AS MATERIALIZED (SELECT DISTINCT doc_id, lower(keyword) AS keyword FROM keywords
), node AS MATERIALIZED (SELECT doc_id, k, lower(category) AS category FROM (SELECT doc_id, count(*) AS k FROM kw GROUP BY doc_id) JOIN docs USING (doc_id)
), shared AS (
  SELECT a, b, max(common) AS common FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM kw x JOIN kw y USING (keyword) WHERE x.doc_id < y.doc_id GROUP BY ALL
    UNION ALL SELECT x.doc_id, y.doc_id, 0 FROM node x JOIN node y USING (category) WHERE x.doc_id < y.doc_id) GROUP BY ALL
), pairs AS MATERIALIZED (
  SELECT a, b, round(least(1.0, w), 4) AS weight FROM (
    SELECT a, b, common / CAST(na.k + nb.k - common AS DOUBLE) + CASE WHEN na.category = nb.category THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS w
    FROM shared JOIN node na ON na.doc_id = a JOIN node nb ON nb.doc_id = b) WHERE w >= 0.18
)"""
