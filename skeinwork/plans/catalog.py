"""Queries of the library over the driver's tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork import session
from skeinwork.functions import text as X
from skeinwork.operators import graph, overlap, ranking, relational, segments, strings, tfidf
from skeinwork.operators.index import Index
from skeinwork.plans import sql as S
from skeinwork.sources import corpus as C
from skeinwork.streaming import incremental

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_INDEXES: dict[tuple[str, str], Index] = {}

TERMS = ["tion", "ing", "ment"]
#: Ranked queries over the corpus.
FLAGSHIP = "tion ing of the ment"


def query(name: str, oracle: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if oracle:
            _SQL[name] = oracle
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return C.from_documents(session.table(spark, sf, "documents"))


def spread(rows: DataFrame) -> DataFrame:
    """rows in at least as many partitions as there are cores; a table of many files is read as it lies."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def index(spark: SparkSession, sf: str) -> Index:
    """The index of a folder's documents; its tables are written once for each session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        _INDEXES[key] = Index(session.staged(spread(corpus(spark, sf)), "corpus"))
    return _INDEXES[key]


def forget_indexes() -> None:
    """The next query builds its index anew."""
    _INDEXES.clear()


def forget_results() -> None:
    """Indexes stay, but pairs and ranks made from them are made anew."""
    for ix in _INDEXES.values():
        for name in ("keyword_ids", "overlaps", "simrank"):
            ix.__dict__.pop(name, None)


def history(spark: SparkSession, sf: str) -> DataFrame:
    """The events table read as a search log."""
    e = session.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("query"), F.when(F.col("value") < 10, 0).otherwise(F.floor("value")).cast("long").alias("result_count"), F.col("value").alias("execution_time"), F.col("user_id").alias("doc_id"), "ts")


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """src, dst, quantity, price: from each part of an order to the next."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = session.table(spark, sf, "lineitem")
    rows = session.dealt(lines, lines.count(), "l_orderkey").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    return rows.filter("dst is not null and dst <> src")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    found = ranking.Search(index(spark, sf)).results(FLAGSHIP)
    return found.select("doc_id", "title", "category", "phrase_matches", "score").orderBy(F.desc("score"), "doc_id").limit(20)


# A: sources.


@query("scan_corpus", f"WITH {S.DOCS} SELECT doc_id, title, category, CAST(length(content) AS BIGINT) AS n_chars FROM docs")
def _(spark, sf):
    return corpus(spark, sf).select("doc_id", "title", "category", F.length("content").cast("long").alias("n_chars"))


@query("point_lookup", f"WITH {S.DOCS} SELECT doc_id, title FROM docs WHERE doc_id = 42")
def _(spark, sf):
    return corpus(spark, sf).filter("doc_id = 42").select("doc_id", "title")


@query("slugify_title", f"WITH {S.DOCS} SELECT doc_id, coalesce(nullif(substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80), ''), 'document') AS slug FROM docs")
def _(spark, sf):
    return corpus(spark, sf).select("doc_id", X.slugify(F.col("title")).alias("slug"))


@query("validate_documents", f"""WITH {S.DOCS}, base AS (
  SELECT coalesce(nullif(substr(trim(regexp_replace(lower(trim(title)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80), ''), 'document') AS base, trim(title) = '' OR length(trim(content)) < 10 AS bad FROM docs
) SELECT base, count(*) AS documents, count(*) FILTER (bad) AS errors, count(*) FILTER (NOT bad) AS slugs, CASE WHEN count(*) FILTER (NOT bad) > 0 THEN 1 ELSE 0 END AS bare FROM base GROUP BY base""")
def _(spark, sf):
    # Slugs are all different, and one row of each base that is not refused has the base itself.
    rows = C.validated(corpus(spark, sf).drop("hits")).withColumn("base", X.slugify(F.trim("title")))
    return rows.groupBy("base").agg(F.count(F.lit(1)).alias("documents"), F.count("error").alias("errors"), F.countDistinct("slug").alias("slugs"), F.count(F.when(F.col("slug") == F.col("base"), 1)).alias("bare"))


@query("seed_new", f"WITH {S.DOCS}, old AS (SELECT DISTINCT title FROM docs WHERE doc_id % 3 = 0) SELECT count(*) AS inserted FROM docs WHERE title NOT IN (SELECT title FROM old)")
def _(spark, sf):
    docs = corpus(spark, sf).withColumnRenamed("title", "slug").select("doc_id", "slug")
    old = docs.filter("doc_id % 3 = 0")
    return C.seed(old, docs).agg((F.count(F.lit(1)) - old.count()).alias("inserted"))


@query("update_documents", f"WITH {S.DOCS} SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'renamed' ELSE category END AS category, CASE WHEN doc_id % 5 = 0 THEN 3 ELSE len(regexp_extract_all(content, '\\S+')) END AS token_count FROM docs")
def _(spark, sf):
    docs = corpus(spark, sf).withColumn("token_count", C.word_count(F.col("content")))
    changes = docs.select("doc_id", F.when(F.expr("doc_id % 7 = 0"), "renamed").alias("category"), F.when(F.expr("doc_id % 5 = 0"), "three new words").alias("content"))
    return C.apply_updates(docs, changes).select("doc_id", "category", "token_count")


@query("delete_documents", f"WITH {S.DOCS} SELECT category, count(*) AS left_over FROM docs WHERE doc_id % 10 <> 0 GROUP BY category")
def _(spark, sf):
    docs = corpus(spark, sf)
    return C.delete(docs, docs.filter("doc_id % 10 = 0").select("doc_id")).groupBy("category").agg(F.count(F.lit(1)).alias("left_over"))


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS \"rows\" FROM {t}" for t in ("documents", "events", "lineitem", "orders", "pages")))
def _(spark, sf):
    return C.table_counts({t: session.table(spark, sf, t) for t in ("documents", "events", "lineitem", "orders", "pages")})


@query("export_json", """SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}' AS json FROM customer""")
def _(spark, sf):
    path = f"{session.shared_dir(spark)}/export-{uuid.uuid4().hex}"
    C.export_json(session.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), path)
    return spark.read.text(path).select(F.col("value").alias("json"))


@query("text_files_parsed", f"""WITH {S.DOCS} SELECT doc_id, 'Document ' || doc_id AS title, category, 'Unknown' AS author, 'one|two' AS keywords, 'short' AS summary, regexp_replace(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '^[ \\t\\n\\v\\f\\r]+', ''), '[ \\t\\n\\v\\f\\r]+$', '') AS body FROM docs""")
def _(spark, sf):
    d = corpus(spark, sf)
    text = C.render_file(F.concat(F.lit("Document "), F.col("doc_id").cast("string")), F.col("category"), F.lit(""), F.array(F.lit("one"), F.lit("two")), F.lit("short"), F.col("content"))
    made = d.select("doc_id", *[c.alias(n) for n, c in C.parse_file(text, F.lit("/x/file.txt")).items()])
    return made.select("doc_id", "title", "category", "author", F.array_join("keywords", "|").alias("keywords"), "summary", F.col("content").alias("body"))


# B: text.


@query("normalize_text", f"WITH {S.DOCS} SELECT doc_id, {S.norm('content')} AS normalized FROM docs")
def _(spark, sf):
    return corpus(spark, sf).select("doc_id", X.normalize(F.col("content")).alias("normalized"))


@query("token_counts", f"WITH {S.TOKENS} SELECT doc_id, CAST(sum(n) AS BIGINT) AS tokens, count(DISTINCT surface) AS surfaces FROM tokens WHERE field = 'content' GROUP BY doc_id")
def _(spark, sf):
    t = corpus(spark, sf).select("doc_id", X.tokenize(F.col("content")).alias("t")).filter(F.size("t") > 0)
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("surfaces"))


@query("stopword_counts", f"WITH {S.DOCS}, w AS (SELECT unnest(string_split({S.norm('content')}, ' ')) AS word FROM docs) SELECT word, count(*) AS n FROM w WHERE word IN ({S.STOP}) GROUP BY word")
def _(spark, sf):
    w = corpus(spark, sf).select(F.explode(X.stop_words_removed(F.col("content"))).alias("word"))
    return w.filter(F.col("word").isin(X.STOP_WORDS)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("stem_vocab", f"WITH {S.TOKENS} SELECT surface, term FROM stems")
def _(spark, sf):
    return index(spark, sf).tokens.select("surface", "term").distinct()


@query("analyze_titles", f"WITH {S.DOCS}, a AS (SELECT doc_id, list_filter(string_split({S.norm('title')}, ' '), lambda t: length(t) > 1 AND t NOT IN ({S.STOP})) AS t, list_filter(string_split({S.norm('title')}, ' '), lambda t: t <> '' AND (length(t) <= 1 OR t IN ({S.STOP}))) AS s FROM docs) SELECT doc_id, array_to_string(t, ' ') AS tokens, array_to_string(list_sort(list_distinct(t)), ' ') AS unique_tokens, array_to_string(s, ' ') AS removed, len(t) AS length FROM a")
def _(spark, sf):
    a = corpus(spark, sf).select("doc_id", X.analyze(F.col("title")).alias("a"))
    return a.select("doc_id", F.array_join("a.tokens", " ").alias("tokens"), F.array_join("a.unique", " ").alias("unique_tokens"), F.array_join("a.stop_words_removed", " ").alias("removed"), F.col("a.length").cast("long").alias("length"))


@query("doc_keywords_top6", f"WITH {S.INDEX} SELECT doc_id, keyword, rank FROM keywords")
def _(spark, sf):
    return index(spark, sf).keywords.select("doc_id", "keyword", F.col("rank").cast("long").alias("rank"))


@query("word_matches", f"WITH {S.DOCS} SELECT doc_id FROM docs WHERE regexp_matches(content, '(^|[^a-z0-9])the tion([^a-z0-9]|$)', 'i')")
def _(spark, sf):
    return corpus(spark, sf).filter(X.matches_word(F.col("content"), "the tion")).select("doc_id")


@query("phrases_of_pages", r"""SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '"([^"]+)"', 1), lambda p: NORM), lambda p: p <> '' AND p NOT IN (STOPPED)), '|') AS phrases FROM pages""".replace("NORM", S.norm("p")).replace("STOPPED", ", ".join(f"'{p}'" for p in X.STOP_PHRASES)))
def _(spark, sf):
    return session.table(spark, sf, "pages").select("page_id", F.array_join(X.extract_phrases(F.col("html")), "|").alias("phrases"))


@query("reference_links", "WITH d AS (SELECT doc_id, '[[' || (doc_id + 1) || ']] and [[Doc-' || doc_id || ']]' AS t FROM documents) SELECT doc_id, CAST(doc_id + 1 AS VARCHAR) || ',doc-' || doc_id AS links FROM d")
def _(spark, sf):
    d = corpus(spark, sf).select("doc_id", F.concat(F.lit("[["), (F.col("doc_id") + 1).cast("string"), F.lit("]] and [[Doc-"), F.col("doc_id").cast("string"), F.lit("]]")).alias("t"))
    return d.select("doc_id", F.array_join(X.extract_links(F.col("t")), ",").alias("links"))


@query("snippet_html", rf"""WITH {S.DOCS}, p AS (
  SELECT doc_id, content, regexp_extract(content, '(?is)^(.*?)(?:^|[^a-z0-9])tion(?:[^a-z0-9]|$)', 0) AS upto, regexp_matches(content, '(?i)(^|[^a-z0-9])tion([^a-z0-9]|$)') AS hit FROM docs
), s AS (SELECT doc_id, content, CASE WHEN hit THEN greatest(0, length(upto) - length(regexp_extract(upto, '(?is)(^|[^a-z0-9])(tion([^a-z0-9]|$))$', 2)) - 73) ELSE 0 END AS start FROM p
), c AS (SELECT doc_id, CASE WHEN content = '' THEN '' ELSE (CASE WHEN start > 0 THEN '...' ELSE '' END) || substr(content, start + 1, 220) || (CASE WHEN start + 220 < length(content) THEN '...' ELSE '' END) END AS t FROM s
), e AS (SELECT doc_id, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS t FROM c)
SELECT doc_id, regexp_replace(regexp_replace(t, '(^|[^A-Za-z0-9])(tion)([^A-Za-z0-9]|$)', '\1<mark>\2</mark>\3', 'gi'), '(^|[^A-Za-z0-9>])(tion)([^A-Za-z0-9<]|$)', '\1<mark>\2</mark>\3', 'gi') AS snippet FROM e""")
def _(spark, sf):
    return corpus(spark, sf).select("doc_id", X.snippet(F.col("content"), ["tion"]).alias("snippet"))


# C: index and vocabulary.


@query("postings_weighted", f"WITH {S.INDEX} SELECT term, doc_id, wtf FROM postings")
def _(spark, sf):
    return index(spark, sf).postings.select("term", "doc_id", F.col("wtf").cast("long").alias("wtf"))


@query("vocab_stats", f"WITH {S.INDEX} SELECT term, display, doc_freq, freq FROM vocabulary")
def _(spark, sf):
    return index(spark, sf).vocabulary.select("term", "display", "doc_freq", F.col("freq").cast("long").alias("freq"))


@query("surface_display", f"WITH {S.INDEX} SELECT term, surface, CAST(votes AS BIGINT) AS votes FROM votes")
def _(spark, sf):
    return index(spark, sf).surfaces.select("term", "surface", F.col("votes").cast("long").alias("votes"))


@query("term_lookup", f"WITH {S.INDEX} SELECT term, doc_id, document_count FROM postings JOIN (SELECT term, count(*) AS document_count FROM postings GROUP BY term) USING (term) WHERE term IN ('tion', 'ing', 'ment')")
def _(spark, sf):
    ix = index(spark, sf)
    counts = ix.lookup([*TERMS, "absent0"]).filter("in_vocabulary")
    return ix.documents_of(TERMS).join(F.broadcast(counts), "term").select("term", "doc_id", "document_count")


@query("candidates", f"WITH {S.INDEX} SELECT DISTINCT doc_id FROM postings WHERE term IN ('thing', 'ment')")
def _(spark, sf):
    return index(spark, sf).candidates(["thing", "ment"])


@query("autocomplete", f"WITH {S.INDEX} SELECT display AS word, term, round(freq / (1 + 0.35 * (length(term) - 2))::DOUBLE, 4) AS score FROM vocabulary WHERE starts_with(term, 'th') ORDER BY score DESC, word, term LIMIT 10")
def _(spark, sf):
    return index(spark, sf).autocomplete("th", 10)


@query("prefix_terms", f"WITH {S.INDEX} SELECT term FROM vocabulary WHERE starts_with(term, 'an') ORDER BY term LIMIT 50")
def _(spark, sf):
    return index(spark, sf).prefix_terms("an")


@query("terms_with_prefix", f"WITH {S.INDEX} SELECT display, term, doc_freq, freq FROM vocabulary WHERE starts_with(term, 'en') ORDER BY freq DESC, term LIMIT 25")
def _(spark, sf):
    return index(spark, sf).terms_with_prefix("en", 25).withColumn("freq", F.col("freq").cast("long"))


@query("top_terms", f"WITH {S.INDEX} SELECT term, display, doc_freq, freq FROM vocabulary ORDER BY freq DESC, term LIMIT 20")
def _(spark, sf):
    return index(spark, sf).top_terms().withColumn("freq", F.col("freq").cast("long"))


@query("index_stats", f"WITH {S.INDEX}, len AS (SELECT d.doc_id, coalesce(sum(n), 0) AS n FROM docs d LEFT JOIN tokens USING (doc_id) GROUP BY d.doc_id) SELECT (SELECT count(*) FROM len) AS documents, (SELECT CAST(sum(n) AS BIGINT) FROM len) AS total_tokens, (SELECT round(avg(n), 4) FROM len) AS avg_length, (SELECT count(*) FROM vocabulary) AS unique_terms, (SELECT count(*) FROM postings) AS postings")
def _(spark, sf):
    return index(spark, sf).stats()


@query("keyword_tables", f"WITH {S.INDEX} SELECT doc_id, term, CAST(sum(n) AS BIGINT) AS frequency, CAST(max(CASE WHEN field = 'title' THEN 1 ELSE 0 END) AS INTEGER) AS in_title, CAST(max(CASE WHEN field = 'content' THEN 1 ELSE 0 END) AS INTEGER) AS in_content FROM every GROUP BY doc_id, term")
def _(spark, sf):
    return index(spark, sf).keyword_tables()


@query("keyword_stats", f"WITH {S.INDEX}, k AS (SELECT term, count(DISTINCT doc_id) AS doc_freq, CAST(sum(n) AS BIGINT) AS total_freq FROM every GROUP BY term) SELECT term, doc_freq, total_freq, round(ln((1.0 + docs) / (1.0 + doc_freq)) + 1.0, 5) AS idf FROM k, size ORDER BY doc_freq DESC, term LIMIT 25")
def _(spark, sf):
    ix = index(spark, sf)
    return relational.keyword_stats(ix.keyword_tables(), ix.size)


@query("incremental_reindex", f"WITH {S.INDEX} SELECT term, CAST(sum(wtf) AS BIGINT) AS freq FROM postings WHERE doc_id % 4 <> 0 GROUP BY term")
def _(spark, sf):
    ix = index(spark, sf)
    return ix.without(ix.corpus.filter("doc_id % 4 = 0")).postings.groupBy("term").agg(F.sum("wtf").cast("long").alias("freq"))


@query("reindexed_documents", f"WITH {S.INDEX} SELECT term, count(*) AS doc_freq, CAST(sum(wtf) AS BIGINT) AS freq FROM (SELECT term, wtf FROM postings WHERE doc_id % 4 <> 0 UNION ALL SELECT unnest(['brand', 'new', 'text']), unnest([5, 5, 5]) FROM docs WHERE doc_id % 4 = 0) GROUP BY term")
def _(spark, sf):
    ix = index(spark, sf)
    new = ix.corpus.filter("doc_id % 4 = 0").withColumns({"title": F.lit(""), "content": F.lit("brand new text")})
    return ix.with_documents(new).vocabulary.select("term", "doc_freq", F.col("freq").cast("long").alias("freq"))


@query("segmented_index", f"WITH {S.INDEX.replace('FROM documents', 'FROM documents WHERE doc_id % 10 <> 0 OR doc_id % 20 = 0')} SELECT term, display, doc_freq, freq, total, round(idf, 9) AS idf FROM vocabulary JOIN (SELECT term, total, idf FROM idf) USING (term)")
def _(spark, sf):
    """Documents added in three changes, some of them twice, then a tenth deleted, and half of these added again: five versions, of which four are merged."""
    docs = spread(corpus(spark, sf))
    ix = segments.SegmentedIndex(spark, f"{session.shared_dir(spark)}/segments-{uuid.uuid4().hex}")
    session.keep_track(spark, ix.root)
    for part in ("doc_id % 3 = 0", "doc_id % 3 = 1", "doc_id % 3 = 2 or doc_id % 9 = 0"):
        ix = ix.add(docs.filter(part))
    ix = ix.delete(docs.filter("doc_id % 10 = 0").select("doc_id")).add(docs.filter("doc_id % 20 = 0"))
    return ix.vocabulary.select("term", "display", "doc_freq", "freq", "total", F.round("idf", 9).alias("idf"))


# D, E: tries and hashes.

_TITLE_WORDS = f"{S.TOKENS}, words AS MATERIALIZED (SELECT DISTINCT term AS word FROM tokens WHERE field = 'title')"


def _title_words(spark, sf):
    return index(spark, sf).tokens.filter("field = 'title'").select(F.col("term").alias("word")).distinct()


@query("trie_nodes_by_depth", f"WITH {_TITLE_WORDS}, p AS (SELECT DISTINCT word[1:i] AS prefix, i AS depth FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)) SELECT CAST(depth AS INTEGER) AS depth, count(*) AS nodes FROM p GROUP BY depth")
def _(spark, sf):
    return strings.trie_nodes(_title_words(spark, sf)).groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"))


@query("trie_stats", f"WITH {_TITLE_WORDS}, p AS (SELECT DISTINCT word[1:i] AS prefix FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)) SELECT (SELECT count(*) + 1 FROM p) AS nodes, (SELECT count(*) FROM words) AS terminals, (SELECT max(length(prefix)) FROM p) AS max_depth")
def _(spark, sf):
    return strings.trie_nodes(_title_words(spark, sf)).agg((F.count(F.lit(1)) + 1).alias("nodes"), F.sum("terminal").alias("terminals"), F.max("depth").cast("long").alias("max_depth"))


@query("trie_prefix_docs", f"WITH {S.INDEX} SELECT DISTINCT doc_id FROM postings WHERE starts_with(term, 'thing') AND EXISTS (SELECT 1 FROM postings WHERE term = 'thing')")
def _(spark, sf):
    return strings.trie_documents(index(spark, sf).postings, "thing")


@query("trie_insert_trace", "WITH w AS (SELECT p_partkey AS seq, lower(p_brand) AS word FROM part), s AS (SELECT seq, i - 1 AS step, word[1:i] AS prefix FROM (SELECT seq, word, unnest(range(1, length(word) + 1)) AS i FROM w)) SELECT seq, CAST(step AS INTEGER) AS step, prefix, CASE WHEN row_number() OVER (PARTITION BY prefix ORDER BY seq) = 1 THEN 'create' ELSE 'follow' END AS action FROM s")
def _(spark, sf):
    return strings.insert_trace(session.table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.lower("p_brand").alias("word")))


_DJB2 = "list_reduce(list_prepend(5381::BIGINT, list_transform(list_filter(string_split({0}, ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 33 + c) & 4294967295)"
_POLY = "list_reduce(list_prepend(0::BIGINT, list_transform(list_filter(string_split({0}, ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 1000003)"


@query("hash_functions", f"SELECT p_partkey, {_DJB2.format('p_name')} AS djb2, {_POLY.format('p_name')} AS poly FROM part")
def _(spark, sf):
    return session.table(spark, sf, "part").select("p_partkey", X.djb2(F.col("p_name")).alias("djb2"), X.polynomial_hash(F.col("p_name")).alias("poly"))


@query("djb2_buckets", f"SELECT {_DJB2.format('key')} % 4096 AS bucket, count(*) AS n FROM (SELECT DISTINCT p_name AS key FROM part) GROUP BY bucket")
def _(spark, sf):
    return strings.chains(session.table(spark, sf, "part").select(F.col("p_name").alias("key")), 4096)


@query("chain_stats", f"WITH c AS (SELECT {_DJB2.format('key')} % 4096 AS bucket, count(*) AS n FROM (SELECT DISTINCT p_name AS key FROM part) GROUP BY bucket) SELECT CAST(sum(n) AS BIGINT) AS size, max(n) AS max_chain, round(avg(n), 4) AS avg_chain, 4096 - count(*) AS empty_buckets, round(sum(n) / 4096.0::DOUBLE, 4) AS load_factor FROM c")
def _(spark, sf):
    return strings.chain_stats(session.table(spark, sf, "part").select(F.col("p_name").alias("key")), 4096)


# F: string matching.


@query("kmp_positions", f"WITH {S.DOCS}, p AS (SELECT doc_id, l, unnest(range(1, len(l))) AS i FROM (SELECT doc_id, string_split(content, '') AS l FROM docs)) SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos FROM p WHERE l[i] = 't' AND l[i + 1] = 'h'")
def _(spark, sf):
    return corpus(spark, sf).select("doc_id", F.explode(strings.positions(F.col("content"), "th")).alias("pos"))


@query("phrase_counts", f"WITH {S.DOCS}, t AS (SELECT doc_id, lower(title || ' ' || content) AS t FROM docs) SELECT doc_id, (length(t) - length(replace(t, 'of the', ''))) // 6 AS matches FROM t WHERE contains(t, 'of the')")
def _(spark, sf):
    t = corpus(spark, sf).select("doc_id", X.count_overlapping(F.lower(F.concat_ws(" ", "title", "content")), "of the").cast("long").alias("matches"))
    return t.filter("matches > 0")


@query("overlapping_counts", f"WITH {S.DOCS} SELECT doc_id, len(list_filter(range(1, len(l) - 1), lambda i: (l[i] = 't' AND l[i + 1] = 'h' AND l[i + 2] = 't') OR (l[i] = 'e' AND l[i + 1] = 's' AND l[i + 2] = 'e'))) AS n FROM (SELECT doc_id, string_split(content, '') AS l FROM docs)")
def _(spark, sf):
    return corpus(spark, sf).select("doc_id", (X.count_overlapping(F.col("content"), "tht") + X.count_overlapping(F.col("content"), "ese")).cast("long").alias("n"))


@query("multi_pattern", f"WITH {S.DOCS}, p AS (SELECT unnest(['and', 'tion', 'q']) AS pattern) SELECT doc_id, pattern, (length(content) - length(replace(content, pattern, ''))) // length(pattern) AS matches FROM docs, p")
def _(spark, sf):
    m = strings.multi_pattern(corpus(spark, sf).select("doc_id", "content"), "content", ["and", "tion", "q"])
    return m.withColumn("matches", F.col("matches").cast("long"))


_CODES = "chars AS MATERIALIZED (SELECT doc_id, list_transform(list_filter(string_split(content, ''), lambda c: c <> ''), lambda c: unicode(c)::BIGINT) AS c FROM docs)"


@query("rk_window_hash", f"WITH {S.DOCS}, {_CODES}, w AS (SELECT doc_id, c, unnest(range(1, len(c) - 3)) AS i FROM chars WHERE len(c) >= 5) SELECT doc_id, count(*) AS windows, CAST(sum((c[i] * 923521 + c[i + 1] * 29791 + c[i + 2] * 961 + c[i + 3] * 31 + c[i + 4]) % 1000003) AS BIGINT) AS hash_sum FROM w GROUP BY doc_id")
def _(spark, sf):
    h = corpus(spark, sf).select("doc_id", strings.window_sums(F.col("content"), 5).alias("h"))
    return h.select("doc_id", "h.*").filter("windows > 0")


@query("rabin_karp", f"WITH {S.DOCS}, {_CODES}, w AS (SELECT doc_id, c, unnest(range(1, greatest(len(c) - 2, 1))) AS i FROM chars), h AS (SELECT doc_id, (c[i] * 29791 + c[i + 1] * 961 + c[i + 2] * 31 + c[i + 3]) % 1000003 = 560203 AS same, c[i] = 116 AND c[i + 1] = 105 AND c[i + 2] = 111 AND c[i + 3] = 110 AS hit FROM w), n AS (SELECT doc_id, count(*) FILTER (hit) AS matches, count(*) AS comparisons, count(*) FILTER (same AND NOT hit) AS collisions FROM h GROUP BY doc_id) SELECT doc_id, coalesce(matches, 0) AS matches, CAST(coalesce(comparisons, 0) AS INTEGER) AS hash_comparisons, CAST(coalesce(collisions, 0) AS INTEGER) AS collisions FROM docs LEFT JOIN n USING (doc_id)")
def _(spark, sf):
    r = corpus(spark, sf).select("doc_id", strings.rabin_karp(F.col("content"), "tion").alias("r"))
    return r.select("doc_id", F.size("r.matches").cast("long").alias("matches"), "r.hash_comparisons", "r.collisions")


# Patterns from another table, all found in one scan.
@query("pattern_hits", f"WITH {S.DOCS}, p AS (SELECT DISTINCT substr(text, 1, 16) AS pattern FROM benchmark WHERE length(text) >= 16) SELECT doc_id, pattern, (length(content) - length(replace(content, pattern, ''))) // 16 AS matches FROM docs, p WHERE contains(content, pattern)")
def _(spark, sf):
    patterns = session.table(spark, sf, "benchmark").filter("length(text) >= 16").select(F.substring("text", 1, 16).alias("pattern"))
    return strings.pattern_hits(corpus(spark, sf), "doc_id", "content", patterns).groupBy("doc_id", "pattern").agg(F.count(F.lit(1)).alias("matches"))


@query("lps_arrays", "WITH b AS (SELECT DISTINCT p_brand AS s FROM part), e AS (SELECT s, unnest(range(1, length(s) + 1)) AS i FROM b) SELECT s, string_agg(CAST(coalesce((SELECT max(k) FROM range(0, i) AS r(k) WHERE s[1:k] = s[i - k + 1 : i]), 0) AS VARCHAR), ',' ORDER BY i) AS borders FROM e GROUP BY s")
def _(spark, sf):
    b = strings.failure_table("s", session.table(spark, sf, "part").select(F.col("p_brand").alias("s")).distinct())
    return b.select("s", F.array_join(F.transform("borders", lambda x: x.cast("string")), ",").alias("borders"))


# G: searching and sorting.

_SORTED = "v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, s_suppkey AS value FROM supplier)"


def _sorted(spark, sf):
    return session.numbered(session.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("value")), "pos", "value")


@query("binary_search_steps", f"""WITH RECURSIVE {_SORTED}, probe AS (
  SELECT wanted, 1 AS step, 0::BIGINT AS low, (SELECT count(*) - 1 FROM v) AS high FROM (VALUES (1::BIGINT), (17::BIGINT), (1000000::BIGINT)) AS w(wanted)
  UNION ALL SELECT p.wanted, p.step + 1, CASE WHEN v.value < p.wanted THEN v.pos + 1 ELSE p.low END, CASE WHEN v.value < p.wanted THEN p.high ELSE v.pos - 1 END
  FROM probe p JOIN v ON v.pos = (p.low + p.high) // 2 WHERE p.low <= p.high AND v.value <> p.wanted
) SELECT p.wanted, p.step, p.low, p.high, v.pos AS mid, v.value, v.value = p.wanted AS found FROM probe p JOIN v ON v.pos = (p.low + p.high) // 2 WHERE p.low <= p.high""")
def _(spark, sf):
    return strings.binary_search_steps(spark, session.staged(_sorted(spark, sf), "sorted-values"), [1, 17, 1_000_000])


@query("linear_search", f"WITH {_SORTED} SELECT coalesce((SELECT min(pos) FROM v WHERE value = 17), -1) AS \"index\", coalesce((SELECT min(pos) + 1 FROM v WHERE value = 17), (SELECT count(*) FROM v)) AS comparisons")
def _(spark, sf):
    return strings.linear_search(_sorted(spark, sf), 17)


@query("equal_range", "SELECT pos FROM (SELECT row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS pos, p_size AS value FROM part) WHERE value = 7")
def _(spark, sf):
    rows = session.table(spark, sf, "part").select(F.col("p_size").alias("value"), "p_partkey")
    return strings.equal_range(session.numbered(rows, "pos", "value", "p_partkey"), 7)


@query("stable_sort_top", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 100")
def _(spark, sf):
    return session.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("topk_heap", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def _(spark, sf):
    return session.table(spark, sf, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(25)


# H: ranking.


@query("idf_table", f"WITH {S.INDEX} SELECT term, df, round(idf, 5) AS idf FROM idf")
def _(spark, sf):
    return index(spark, sf).idf.select("term", "df", F.round("idf", 5).alias("idf"))


@query("doc_norms", f"WITH {S.WEIGHTS} SELECT doc_id, round(sum(w * w), 6) AS one, count(*) AS terms FROM weights GROUP BY doc_id")
def _(spark, sf):
    # A document's weights have one divisor, its norm, so their squares are added up before they meet it.
    ix = index(spark, sf)
    return ix.squares.join(ix.norms, "doc_id").select("doc_id", F.round(F.col("squares") / (F.col("norm") * F.col("norm")), 6).alias("one"), "terms")


@query("tfidf_query", f"WITH {S.cosine(TERMS)} SELECT docs.doc_id, coalesce(score, 0.0) AS score FROM docs LEFT JOIN cos USING (doc_id)")
def _(spark, sf):
    return tfidf.score_query(index(spark, sf), TERMS)


@query("term_report", f"WITH {S.INDEX}, len AS (SELECT doc_id, sum(n) AS length FROM bag GROUP BY doc_id), r AS (SELECT term, df, round(idf, 5) AS idf, round((1 - df / (SELECT CAST(docs AS DOUBLE) FROM size)) * 100, 2) AS rarity, doc_id, round(n / length * idf, 6) AS tfidf FROM bag JOIN len USING (doc_id) JOIN idf USING (term) WHERE term IN ('tion', 'ing', 'ment')) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY term ORDER BY tfidf DESC, doc_id) AS INTEGER) AS rank FROM r) WHERE rank <= 10")
def _(spark, sf):
    return tfidf.term_report(index(spark, sf), TERMS)


@query("tfidf_stats", f"WITH {S.INDEX}, len AS (SELECT d.doc_id, coalesce(sum(n), 0) AS n FROM docs d LEFT JOIN bag USING (doc_id) GROUP BY d.doc_id) SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS total_tokens, round(avg(n), 4) AS avg_length, CAST(max(n) AS BIGINT) AS max_length, (SELECT count(*) FROM idf) AS vocabulary FROM len")
def _(spark, sf):
    return tfidf.stats(index(spark, sf))


@query("bm25", f"WITH {S.INDEX}, len AS (SELECT doc_id, sum(n) AS length FROM bag GROUP BY doc_id), mean AS (SELECT sum(length) / (SELECT CAST(docs AS DOUBLE) FROM size) AS m FROM len), h AS (SELECT doc_id, greatest(1e-6, ln(((SELECT docs FROM size) - df + 0.5) / (df + 0.5))) * n * 2.2 / (n + 1.2 * (1 - 0.75 + 0.75 * length / m)) AS part FROM bag JOIN idf USING (term) JOIN len USING (doc_id), mean WHERE term IN ('thing', 'tion')) SELECT doc_id, round(sum(part), 6) AS score FROM h GROUP BY doc_id HAVING count(*) = 2")
def _(spark, sf):
    return tfidf.bm25(index(spark, sf), ["thing", "tion"])


def _contains_any(col: str, t: str) -> str:
    return f"(contains({col}, '{t}') OR contains({col}, '{t[:-1]}'))" if len(t) > 3 else f"contains({col}, '{t}')"


_COLUMNS = "doc_id, title, category, phrase_matches, score"


def _ranked_sql(tokens: list[str], phrases: list[str], extra: str = "", known: bool = True, columns: str = _COLUMNS, authority: str = "") -> str:
    """SQL of a ranked search. authority: more tables, of which simrank(node, pagerank) gives the link authority."""
    words = [w for p in phrases for w in p.split()]
    asked = [*tokens, *phrases, *words]
    terms = tokens or [X.stem_word(w) for w in words]
    title = f"CASE WHEN title = '' THEN 0.0::DOUBLE ELSE least(1.0, ({' + '.join(f'CAST({_contains_any("lower(title)", t)} AS INTEGER)' for t in asked)}) / {len(asked)}.0::DOUBLE * 0.8::DOUBLE + CASE WHEN contains(lower(title), '{' '.join(asked)}') THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END) END"
    key = " + ".join(f"CAST(len(list_filter(ks, lambda k: contains(k, '{t}') OR contains('{t}', k))) > 0 AS INTEGER)" for t in asked)
    counts = " + ".join(f"(length(body) - length(replace(body, '{p}', ''))) // {len(p)}" for p in phrases) or "0::BIGINT"
    n_terms = f"JOIN (SELECT doc_id, count(*) AS n_terms FROM postings WHERE term IN ({', '.join(repr(t) for t in tokens)}) GROUP BY doc_id) USING (doc_id)" if known else "CROSS JOIN (SELECT 0::BIGINT AS n_terms)"
    graph_signal = "round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (coalesce(pagerank, 0.0::DOUBLE) - least_rank) / greatest(1e-9::DOUBLE, most_rank - least_rank))), 4)" if authority else "0.0::DOUBLE"
    ranks = "LEFT JOIN simrank ON node = docs.doc_id, (SELECT min(pagerank) AS least_rank, max(pagerank) AS most_rank FROM simrank)" if authority else ""
    return f"""WITH {"RECURSIVE " if authority else ""}{S.cosine(list(dict.fromkeys(terms)))}{authority}, ks AS (SELECT doc_id, list(keyword) AS ks FROM keywords GROUP BY doc_id
), b AS (SELECT docs.doc_id, title, category, lower(title || ' ' || content) AS body, coalesce(ks, []) AS ks, coalesce(score, 0.0::DOUBLE) AS cosine, (SELECT max(score) FROM cos) AS best, n_terms, {graph_signal} AS gr
  FROM docs LEFT JOIN ks USING (doc_id) LEFT JOIN cos USING (doc_id) {n_terms} {ranks}
), g AS (SELECT doc_id, title, category, n_terms, gr, {counts} AS phrase_matches, round({title}, 4) AS t,
  round(CASE WHEN len(ks) > 0 THEN ({key}) / {len(asked)}.0::DOUBLE ELSE 0.0::DOUBLE END, 4) AS k, round(CASE WHEN best > 0 THEN least(1.0, cosine / best) ELSE 0.0::DOUBLE END, 4) AS c,
  {f"contains({S.norm('title')}, '{X.normal_form(' '.join(phrases))}')" if phrases else "false"} AS in_title FROM b
), p AS (SELECT *, round(CASE WHEN phrase_matches > 0 THEN 1 - exp(-phrase_matches / 3.0::DOUBLE) ELSE 0.0::DOUBLE END, 4) AS ph FROM g
), s AS (SELECT doc_id, title, category, phrase_matches, t, k, c, ph, gr, round((round(0.3::DOUBLE * t, 6) + round(0.25::DOUBLE * k, 6) + round(0.25::DOUBLE * c, 6) + round(0.1::DOUBLE * ph, 6) + round(0.1::DOUBLE * gr, 6))
  * CASE WHEN n_terms >= 0.999 * {len(set(terms))} THEN 1.12::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN in_title AND t > 0 THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END
  * CASE WHEN c > 0.75 AND t > 0 THEN 1.08::DOUBLE ELSE 1.0::DOUBLE END + 0.0008::DOUBLE, 6) AS score FROM p)
SELECT {columns} FROM s {extra}"""


@query("search_ranked", _ranked_sql(["tion", "ing", "ment"], []))
def _(spark, sf):
    return ranking.Search(index(spark, sf)).results("tion ing of the ment").select("doc_id", "title", "category", "phrase_matches", "score")


@query("search_with_phrase", _ranked_sql(["ment"], ["of the"]))
def _(spark, sf):
    return ranking.Search(index(spark, sf)).results('ment "of the"').select("doc_id", "title", "category", "phrase_matches", "score")


@query("search_phrase_only", _ranked_sql([], ["tion of"], "WHERE phrase_matches > 0", known=False))
def _(spark, sf):
    return ranking.Search(index(spark, sf)).results('"tion of"').select("doc_id", "title", "category", "phrase_matches", "score")


@query("search_category", _ranked_sql(["tion", "ing"], [], "WHERE lower(category) = 'src3'"))
def _(spark, sf):
    return ranking.Search(index(spark, sf)).results("tion ing", category="SRC3").select("doc_id", "title", "category", "phrase_matches", "score")


@query("header_fallback", f"WITH {S.DOCS} SELECT doc_id FROM docs WHERE contains({S.norm("title || ' ' || category")}, 'src1')")
def _(spark, sf):
    return ranking.Search(index(spark, sf)).results("src1").select("doc_id")


@query("search_page", _ranked_sql(["tion", "ing", "ment"], [], "ORDER BY score DESC, doc_id LIMIT 10 OFFSET 10", columns="doc_id, score, round(least(99.0::DOUBLE, score * 135), 1) AS score_percent"))
def _(spark, sf):
    page = ranking.Search(index(spark, sf)).search(FLAGSHIP, page=2)
    return page["results"].select("doc_id", "score", "score_percent")


@query("search_explained", _ranked_sql(["ment"], ["of the"], "ORDER BY score DESC, doc_id LIMIT 10", columns="doc_id, t AS title_value, round(t * 0.3::DOUBLE, 6) AS title_part, k AS keyword_value, round(k * 0.25::DOUBLE, 6) AS keyword_part, c AS content_value, round(c * 0.25::DOUBLE, 6) AS content_part, ph AS phrase_value, round(ph * 0.1::DOUBLE, 6) AS phrase_part, score AS total"))
def _(spark, sf):
    page = ranking.Search(index(spark, sf)).search('ment "of the"')["results"]
    of = lambda name, what: F.filter("score_breakdown", lambda x: x["signal"] == name)[0][what]
    parts = [of(n, w).alias(f"{n}_{a}") for n in ("title", "keyword", "content", "phrase") for w, a in (("value", "value"), ("contribution", "part"))]
    return page.select("doc_id", *parts, of("total", "value").alias("total"))


@query("search_min_score", f"SELECT * FROM ({_ranked_sql(['tion', 'ing'], [], 'ORDER BY score DESC, doc_id LIMIT 50')}) WHERE score >= 0.3")
def _(spark, sf):
    return ranking.Search(index(spark, sf)).search("tion ing", per_page=50, min_score=0.3)["results"].select("doc_id", "title", "category", "phrase_matches", "score")


@query("search_by_title", _ranked_sql(["tion", "ing"], [], "ORDER BY lower(title), score DESC, doc_id LIMIT 10", columns="doc_id, title, score"))
def _(spark, sf):
    return ranking.Search(index(spark, sf)).search("tion ing", sort="title")["results"].select("doc_id", "title", "score")


@query("suggestions", f"WITH {S.INDEX} SELECT display AS word, term, round(freq / (1 + 0.35 * (length(term) - 4))::DOUBLE, 4) AS score FROM vocabulary WHERE starts_with(term, 'tion') ORDER BY score DESC, word, term LIMIT 6")
def _(spark, sf):
    return ranking.Search(index(spark, sf)).suggestions("tion ing")


# I: relational.


@query("list_documents", f"WITH {S.DOCS} SELECT doc_id, title, category FROM docs WHERE category = 'src2' AND (contains(lower(title), 'th') OR contains(lower(content), 'th')) ORDER BY title, doc_id DESC LIMIT 10 OFFSET 5")
def _(spark, sf):
    page, _ = relational.listing(corpus(spark, sf), 10, 5, "src2", "title", search="TH")
    return page.select("doc_id", "title", "category")


@query("categories", f"WITH {S.DOCS} SELECT category, count(*) AS count FROM docs GROUP BY category")
def _(spark, sf):
    return relational.categories(corpus(spark, sf))


@query("duplicate_titles", f"WITH {S.DOCS} SELECT title, count(*) AS n FROM docs GROUP BY title HAVING count(*) > 1")
def _(spark, sf):
    return relational.duplicate_titles(corpus(spark, sf))


@query("retention_500", f"WITH {S.HISTORY} SELECT id, query FROM history ORDER BY id DESC LIMIT 500")
def _(spark, sf):
    h = history(spark, sf)
    return relational.append_history(h.filter("id % 2 = 0"), h.filter("id % 2 = 1")).select("id", "query")


@query("recent_searches", f"WITH {S.HISTORY} SELECT id, query, execution_time FROM history ORDER BY id DESC LIMIT 50")
def _(spark, sf):
    return relational.recent(history(spark, sf), 60).select("id", "query", "execution_time")


@query("popular_queries", f"WITH {S.HISTORY} SELECT query, count(*) AS count, round(avg(execution_time), 3) AS avg_ms FROM history GROUP BY query ORDER BY count DESC, query LIMIT 8")
def _(spark, sf):
    return relational.popular(history(spark, sf))


@query("slowest_queries", f"WITH {S.HISTORY} SELECT query, round(max(execution_time), 3) AS ms FROM history GROUP BY query ORDER BY ms DESC, query LIMIT 5")
def _(spark, sf):
    return relational.slowest(history(spark, sf))


@query("search_statistics", f"WITH {S.HISTORY} SELECT count(*) AS total_searches, count(DISTINCT query) AS unique_queries, round(avg(execution_time), 3) AS average_time_ms, count(*) FILTER (result_count = 0) AS empty_result_searches, round(100.0::DOUBLE * (count(*) - count(*) FILTER (result_count = 0)) / count(*), 2) AS success_rate FROM history")
def _(spark, sf):
    return relational.search_statistics(history(spark, sf))


_KINDS = f"{S.HISTORY}, log AS (SELECT doc_id, CASE WHEN query IN ('click', 'purchase') THEN 'clicked' ELSE 'shown' END AS kind, ts FROM history), st AS (SELECT doc_id, count(*) FILTER (kind = 'shown') AS times_shown, count(*) FILTER (kind = 'clicked') AS times_clicked FROM log GROUP BY doc_id)"


def _statistics(spark, sf):
    return relational.document_statistics(history(spark, sf).select("doc_id", F.when(F.col("query").isin("click", "purchase"), "clicked").otherwise("shown").alias("kind"), "ts"))


@query("upsert_counts", f"WITH {_KINDS} SELECT * FROM st")
def _(spark, sf):
    return _statistics(spark, sf).drop("last_shown_at")


@query("most_matched", f"WITH {S.DOCS}, {_KINDS} SELECT doc_id, title, category, times_shown, times_clicked FROM st JOIN docs USING (doc_id) ORDER BY times_shown DESC, title, doc_id LIMIT 20")
def _(spark, sf):
    return relational.most_matched(_statistics(spark, sf), corpus(spark, sf), 20)


@query("bump_hits", f"WITH {S.DOCS}, {_KINDS} SELECT docs.doc_id, 1 + coalesce(times_shown, 0) AS hits FROM docs LEFT JOIN st USING (doc_id)")
def _(spark, sf):
    return relational.with_hits(corpus(spark, sf), _statistics(spark, sf)).select("doc_id", "hits")


@query("upsert_last_wins", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS i FROM events) WHERE i = 1")
def _(spark, sf):
    e = session.table(spark, sf, "events").select("user_id", "event_type", "value", F.col("event_id").alias("seq"))
    first = e.groupBy("user_id").agg(F.min_by(F.struct("event_type", "value", "seq"), "seq").alias("m")).select("user_id", "m.event_type", "m.value", "m.seq")
    return relational.upsert(first, e, "user_id").select("user_id", "event_type", "value")


@query("health", "SELECT 1 AS ok, (SELECT count(*) FROM documents) AS documents")
def _(spark, sf):
    return session.table(spark, sf, "documents").agg(F.lit(1).alias("ok"), F.count(F.lit(1)).alias("documents")).select("ok", "documents")


# J: graphs.


def keyword_ids(spark, sf):
    ix = index(spark, sf)
    if not hasattr(ix, "keyword_ids"):
        ix.keyword_ids = graph.keyword_ids(ix.keywords.select("doc_id", "keyword"), ix.corpus.select("doc_id", "category"))
    return ix.keyword_ids


def pairs(spark, sf):
    """All pairs, not staged: they are many, and are made again as fast as they are read."""
    return graph.pairs_of(keyword_ids(spark, sf))


def overlaps(spark, sf):
    """The similarity graph as sums over keyword subsets: what needs no row for each pair."""
    ix = index(spark, sf)
    if not hasattr(ix, "overlaps"):
        ix.overlaps = overlap.Overlaps(overlap.keyword_sets(ix.keywords, ix.corpus))
    return ix.overlaps


def _both(p):
    return p.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").union(p.select("b", "a", "weight"))


_BOTH = f"{S.SIMILAR}, directed AS MATERIALIZED (SELECT a AS src, b AS dst, weight FROM pairs UNION ALL SELECT b, a, weight FROM pairs)"


@query("sim_edges", f"WITH {S.SIMILAR} SELECT a, b, weight FROM pairs")
def _(spark, sf):
    return pairs(spark, sf)


@query("similarity_links", f"WITH {S.SIMILAR}, sets AS (SELECT doc_id, list_sort(list(keyword)) AS w FROM kw GROUP BY doc_id), class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY w, category) AS class_id FROM sets JOIN node USING (doc_id)), n AS (SELECT d, count(*) AS links FROM (SELECT a AS d FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY d) SELECT doc_id, class_id, coalesce(links, 0) AS links FROM class LEFT JOIN n ON d = doc_id")
def _(spark, sf):
    return overlaps(spark, sf).link_counts()


@query("degrees", f"WITH {S.STEPS} SELECT p_partkey AS node, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM part LEFT JOIN (SELECT dst, count(DISTINCT src) AS i FROM steps GROUP BY dst) ON dst = p_partkey LEFT JOIN (SELECT src, count(*) AS o FROM steps GROUP BY src) ON src = p_partkey")
def _(spark, sf):
    return graph.degrees(session.table(spark, sf, "part").select(F.col("p_partkey").alias("node")), steps(spark, sf))


@query("graph_stats", f"WITH {S.STEPS} SELECT (SELECT count(*) FROM part) AS nodes, (SELECT count(*) FROM steps) AS edges, round((SELECT count(*) FROM steps)::DOUBLE / (SELECT count(*) FROM part), 2) AS avg_degree")
def _(spark, sf):
    return graph.graph_stats(session.table(spark, sf, "part").select(F.col("p_partkey").alias("node")), steps(spark, sf))


_PAGERANK = f"""WITH RECURSIVE {S.STEPS}, node AS MATERIALIZED (SELECT p_partkey AS node FROM part), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM node
), deg AS MATERIALIZED (SELECT src, count(*) AS o FROM steps GROUP BY src), link AS MATERIALIZED (SELECT src, dst, count(*) / CAST(any_value(o) AS DOUBLE) AS share FROM steps JOIN deg USING (src) GROUP BY src, dst
), pr AS (
  SELECT 0 AS i, node, 1.0::DOUBLE / n AS r FROM node, n
  UNION ALL
  SELECT i + 1, node, sum(add) AS r FROM (
    SELECT pr.i, link.dst AS node, 0.85::DOUBLE * pr.r * share AS add FROM pr JOIN link ON link.src = pr.node WHERE pr.i < {{k}}
    UNION ALL SELECT x.i, node.node, 0.15::DOUBLE / n + 0.85::DOUBLE * x.lost / n FROM (SELECT pr.i, sum(CASE WHEN deg.src IS NULL THEN pr.r ELSE 0.0::DOUBLE END) AS lost FROM pr LEFT JOIN deg ON deg.src = pr.node WHERE pr.i < {{k}} GROUP BY pr.i) x, node, n
  ) GROUP BY i, node
), final AS MATERIALIZED (SELECT node, r AS pagerank FROM pr WHERE i = {{k}})"""


def _rank(spark, sf, k=None):
    """Ranks after k rounds, or converged ones."""
    how = {"iterations": k, "tolerance": None} if k else {"tolerance": 1e-10}
    return graph.pagerank(session.table(spark, sf, "part").select(F.col("p_partkey").alias("node")), steps(spark, sf), **how)


@query("pagerank_k", _PAGERANK.format(k=6) + " SELECT node, round(pagerank, 8) AS pagerank FROM final")
def _(spark, sf):
    return _rank(spark, sf, 6).select("node", F.round("pagerank", 8).alias("pagerank"))


@query("authority_labels", _PAGERANK.format(k=30) + " SELECT node, CASE WHEN pagerank / m >= 0.8 THEN 'authority' WHEN pagerank / m >= 0.5 THEN 'strong' WHEN pagerank / m >= 0.2 THEN 'linked' ELSE 'peripheral' END AS tier FROM final, (SELECT max(pagerank) AS m FROM final)")
def _(spark, sf):
    return graph.authority_labels(_rank(spark, sf))


@query("hub_scores", _PAGERANK.format(k=30) + " SELECT node, round(pagerank, 8) AS pagerank FROM final ORDER BY round(pagerank, 8) DESC, CAST(node AS VARCHAR) LIMIT 10")
def _(spark, sf):
    return graph.hub_scores(_rank(spark, sf).select("node", F.round("pagerank", 8).alias("pagerank")))


# Converged ranks of the similarity graph: simrank(node, pagerank).
_SIMRANK = """, deg AS MATERIALIZED (SELECT src, count(*) AS o FROM directed GROUP BY src), link AS MATERIALIZED (SELECT src, dst, 1 / CAST(o AS DOUBLE) AS share FROM directed JOIN deg USING (src)
), total AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n FROM docs), pr AS (
  SELECT 0 AS i, doc_id AS node, 1.0::DOUBLE / total.n AS r FROM docs, total
  UNION ALL
  SELECT i + 1, node, sum(add) AS r FROM (
    SELECT pr.i, link.dst AS node, 0.85::DOUBLE * pr.r * share AS add FROM pr JOIN link ON link.src = pr.node WHERE pr.i < 60
    UNION ALL SELECT x.i, docs.doc_id, 0.15::DOUBLE / total.n + 0.85::DOUBLE * x.lost / total.n FROM (SELECT pr.i, sum(CASE WHEN deg.src IS NULL THEN pr.r ELSE 0.0::DOUBLE END) AS lost FROM pr LEFT JOIN deg ON deg.src = pr.node WHERE pr.i < 60 GROUP BY pr.i) x, docs, total
  ) GROUP BY i, node
), simrank AS MATERIALIZED (SELECT node, r AS pagerank FROM pr WHERE i = 60)"""


def simrank(spark, sf):
    ix = index(spark, sf)
    if not hasattr(ix, "simrank"):
        ix.simrank = session.staged(overlaps(spark, sf).pagerank(ix.corpus.select(F.col("doc_id").alias("node")), tolerance=1e-10), "simrank")
    return ix.simrank


@query("related_docs", f"WITH RECURSIVE {_BOTH}{_SIMRANK} SELECT dst, round(sqrt(weight * pagerank / (SELECT max(pagerank) FROM simrank)), 4) AS score FROM directed JOIN simrank ON node = dst WHERE src = 1 ORDER BY score DESC, dst LIMIT 5")
def _(spark, sf):
    near = overlaps(spark, sf).linked_with(1).select(F.lit(1).cast("long").alias("src"), "dst", "weight")
    return graph.related(near, simrank(spark, sf), 1)


@query("search_with_authority", _ranked_sql(["tion", "ing"], [], authority=_BOTH.removeprefix(S.INDEX) + _SIMRANK, columns="doc_id, gr AS graph_signal, score"))
def _(spark, sf):
    ranks = simrank(spark, sf).withColumnRenamed("node", "doc_id")
    return ranking.Search(index(spark, sf), ranks).results("tion ing").select("doc_id", "graph_signal", "score")


def _slugged(spark, sf):
    """The documents, each with a slug and text that names the next one by slug, the one after by number, itself, and nobody."""
    d = F.col("doc_id")
    links = F.concat(F.lit("[[doc-"), (d + 1).cast("string"), F.lit("]] [["), (d + 2).cast("string"), F.lit("]] [[doc-"), d.cast("string"), F.lit("]] [[nobody]] [[Doc-"), (d + 1).cast("string"), F.lit("]]"))
    return corpus(spark, sf).select("doc_id", F.concat(F.lit("doc-"), d.cast("string")).alias("slug"), links.alias("content"))


_REFERENCES = "refs AS MATERIALIZED (SELECT a.doc_id AS src, b.doc_id AS dst, CAST(b.doc_id - a.doc_id - 1 AS INTEGER) AS pos, 1.0::DOUBLE AS weight FROM docs a JOIN docs b ON b.doc_id IN (a.doc_id + 1, a.doc_id + 2))"


@query("reference_edges", f"WITH {S.DOCS}, {_REFERENCES} SELECT src, dst, pos, weight FROM refs")
def _(spark, sf):
    return graph.reference_edges(_slugged(spark, sf)).select("src", "dst", "pos", "weight")


def _documents_graph(spark, sf):
    return graph.document_graph(graph.reference_edges(_slugged(spark, sf)), pairs(spark, sf), keyword_ids(spark, sf))


_GRAPH = f"{_BOTH}, {_REFERENCES}, every_edge AS MATERIALIZED (SELECT refs.src, refs.dst, 'reference' AS type, coalesce(directed.weight, 1.0::DOUBLE) AS weight FROM refs LEFT JOIN directed USING (src, dst) UNION ALL SELECT src, dst, 'similarity', weight FROM directed)"


@query("document_graph", f"WITH {_GRAPH} SELECT src, dst, type, weight FROM every_edge")
def _(spark, sf):
    return _documents_graph(spark, sf).select("src", "dst", "type", "weight")


@query("weighted_costs", f"WITH {_GRAPH} SELECT src, dst, round(min(2.0::DOUBLE - weight), 4) AS cost FROM every_edge GROUP BY src, dst")
def _(spark, sf):
    found = graph.document_costs(graph.reference_edges(_slugged(spark, sf)), pairs(spark, sf), keyword_ids(spark, sf))
    return found.select("src", "dst", F.round("cost", 4).alias("cost"))


@query("document_graph_stats", f"WITH {_GRAPH} SELECT (SELECT count(*) FROM docs) AS nodes, count(*) AS edges, count(*) FILTER (type = 'reference') AS reference_edges, count(*) FILTER (type = 'similarity') AS similarity_edges, round(count(*)::DOUBLE / (SELECT count(*) FROM docs), 2) AS avg_degree FROM every_edge")
def _(spark, sf):
    # Similarity edges are the links of all documents, summed up without a row for each.
    similar = overlaps(spark, sf).class_links.join(overlaps(spark, sf).classes, "class_id").agg(F.coalesce(F.sum(F.col("n") * F.col("links")), F.lit(0)).alias("n"))
    references = graph.reference_edges(_slugged(spark, sf)).agg(F.count(F.lit(1)).alias("n"))
    return graph.counted_stats(corpus(spark, sf).select(F.col("doc_id").alias("node")), {"reference": references, "similarity": similar})


_LINKS = f"{S.STEPS}, links AS MATERIALIZED (SELECT DISTINCT src, dst FROM steps)"


# The SQL walks 25 steps, more than the graph's diameter; the walk itself ends when nothing is new.
@query("bfs_levels", f"WITH RECURSIVE {_LINKS}, first AS (SELECT min(src) AS s FROM links), walk AS (SELECT s AS node, 0 AS depth FROM first UNION SELECT dst, depth + 1 FROM walk JOIN links ON src = node WHERE depth < 25) SELECT node, min(depth) AS depth FROM walk GROUP BY node")
def _(spark, sf):
    e = steps(spark, sf)
    return graph.bfs(e, e.agg(F.min("src")).first()[0]).select("node", "depth")


@query("bfs_order", f"""WITH RECURSIVE {_LINKS}, first AS (SELECT min(src) AS s FROM links), walk AS (SELECT s AS node, 0 AS depth FROM first UNION SELECT dst, depth + 1 FROM walk JOIN links ON src = node WHERE depth < 25
), lev AS MATERIALIZED (SELECT node, min(depth) AS depth FROM walk GROUP BY node
), o AS (
  SELECT 0 AS d, s AS node, 1::BIGINT AS p, NULL::BIGINT AS parent FROM first
  UNION ALL SELECT d, node, row_number() OVER (ORDER BY by_p, node) AS p, parent FROM (SELECT o.d + 1 AS d, dst AS node, min(o.p) AS by_p, arg_min(o.node, o.p) AS parent FROM o JOIN links ON src = o.node JOIN lev ON lev.node = dst AND lev.depth = o.d + 1 GROUP BY o.d + 1, dst)
) SELECT p - 1 + (SELECT count(*) FROM lev WHERE lev.depth < o.d) AS visit, node, d AS depth, parent, d + 1 AS hops FROM o""")
def _(spark, sf):
    e = steps(spark, sf)
    return graph.bfs(e, e.agg(F.min("src")).first()[0]).select("visit", "node", "depth", "parent", (F.col("depth") + 1).alias("hops"))


_ORDERED = f"""WITH RECURSIVE {_LINKS}, first AS (SELECT min(src) AS s FROM links), walk AS (SELECT s AS node, 0 AS depth FROM first UNION SELECT dst, depth + 1 FROM walk JOIN links ON src = node WHERE depth < 25
), lev AS MATERIALIZED (SELECT node, min(depth) AS depth FROM walk GROUP BY node
), o AS (
  SELECT 0 AS d, s AS node, 1::BIGINT AS p, NULL::BIGINT AS parent FROM first
  UNION ALL SELECT d, node, row_number() OVER (ORDER BY by_p, node) AS p, parent FROM (SELECT o.d + 1 AS d, dst AS node, min(o.p) AS by_p, arg_min(o.node, o.p) AS parent FROM o JOIN links ON src = o.node JOIN lev ON lev.node = dst AND lev.depth = o.d + 1 GROUP BY o.d + 1, dst)
)"""


@query("path_tables", _ORDERED + ", up AS (SELECT node AS goal, node, CAST(d AS BIGINT) AS step FROM o UNION ALL SELECT goal, x.parent, step - 1 FROM up JOIN o x ON x.node = up.node WHERE x.parent IS NOT NULL) SELECT goal, step, node FROM up")
def _(spark, sf):
    e = steps(spark, sf)
    return graph.paths(graph.bfs(e, e.agg(F.min("src")).first()[0]))


@query("shortest_paths", f"WITH RECURSIVE {S.STEPS}, cost AS MATERIALIZED (SELECT src, dst, min(quantity) AS cost FROM steps GROUP BY src, dst), d AS (SELECT 0 AS i, 1::BIGINT AS node, 0.0::DOUBLE AS dist UNION ALL SELECT i, node, min(dist) FROM (SELECT d.i + 1 AS i, dst AS node, dist + cost AS dist FROM d JOIN cost ON src = node WHERE d.i < 25 UNION ALL SELECT i + 1, node, dist FROM d WHERE i < 25) GROUP BY i, node) SELECT node, dist FROM d WHERE i = 25")
def _(spark, sf):
    return graph.shortest_paths(steps(spark, sf).select("src", "dst", F.col("quantity").alias("cost")), 1).select("node", "dist")


@query("components", f"WITH RECURSIVE {S.STEPS}, l AS MATERIALIZED (SELECT src, dst FROM steps UNION SELECT dst, src FROM steps), low AS (SELECT 0 AS i, p_partkey AS node, p_partkey AS c FROM part UNION ALL SELECT i, node, min(c) FROM (SELECT low.i + 1 AS i, dst AS node, c FROM low JOIN l ON src = node WHERE low.i < 25 UNION ALL SELECT i + 1, node, c FROM low WHERE i < 25) GROUP BY i, node) SELECT node, c AS component FROM low WHERE i = 25")
def _(spark, sf):
    return graph.components(session.table(spark, sf, "part").select(F.col("p_partkey").alias("node")), steps(spark, sf))


@query("cycle_residue", f"WITH RECURSIVE {_LINKS}, r AS (SELECT 0 AS i, src, dst FROM links UNION ALL SELECT i + 1, src, dst FROM (SELECT r.*, r.src IN (SELECT dst FROM r) AS fed, r.dst IN (SELECT src FROM r) AS feeds FROM r) WHERE fed AND feeds AND i < 25) SELECT src, dst FROM r WHERE i = 25")
def _(spark, sf):
    return graph.cycle_residue(steps(spark, sf))


# The SQL walks 4,000 pointers and looks at the last half, enough for 2,000 nodes; the query has no such limit.
@query("cycle_witness", f"""WITH RECURSIVE {_LINKS}, r AS (SELECT 0 AS i, src, dst FROM links UNION ALL SELECT i + 1, src, dst FROM (SELECT r.*, r.src IN (SELECT dst FROM r) AS fed, r.dst IN (SELECT src FROM r) AS feeds FROM r) WHERE fed AND feeds AND i < 25
), f AS MATERIALIZED (SELECT src, min(dst) AS dst FROM r WHERE i = 25 GROUP BY src), walk AS (SELECT 0 AS i, min(src) AS node FROM f UNION ALL SELECT i + 1, dst FROM walk JOIN f ON src = node WHERE i < 4000
), late AS (SELECT i, node FROM walk WHERE i > 2000), least AS (SELECT i, row_number() OVER (ORDER BY i) AS k FROM late WHERE node = (SELECT min(node) FROM late)
) SELECT CAST(late.i - a.i AS BIGINT) AS step, node, f.dst AS next FROM late JOIN f ON f.src = node, least a, least b WHERE a.k = 1 AND b.k = 2 AND late.i >= a.i AND late.i < b.i""")
def _(spark, sf):
    return graph.cycle_witness(steps(spark, sf))


@query("traverse_dijkstra", f"WITH RECURSIVE {_LINKS}, first AS (SELECT min(src) AS s FROM links), walk AS (SELECT s AS node, 0 AS depth FROM first UNION SELECT dst, depth + 1 FROM walk JOIN links ON src = node WHERE depth < 25) SELECT node, CAST(min(depth) AS DOUBLE) AS dist FROM walk GROUP BY node")
def _(spark, sf):
    e = steps(spark, sf).select("src", "dst", F.lit(1.0).alias("weight"))  # cost 2 - 1 a step
    return graph.traverse(e, "dijkstra", start=-5).select("node", "dist")


# N: the batch side of the streams.


@query("popular_windows", "SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type AS query, count(*) AS count FROM events GROUP BY ALL")
def _(spark, sf):
    return incremental.popular_windows(history(spark, sf).select("ts", "query"), "1 day")


@query("posting_batch", f"WITH {S.TOKENS} SELECT doc_id, term, CAST(sum(n * CASE field WHEN 'title' THEN 4 ELSE 1 END) AS BIGINT) AS wtf FROM tokens GROUP BY doc_id, term")
def _(spark, sf):
    return incremental.posting_rows(corpus(spark, sf)).withColumn("wtf", F.col("wtf").cast("long"))