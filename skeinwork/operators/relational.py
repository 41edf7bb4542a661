"""Listings, statistics and history as relations.

A search history has id, query, result_count, execution_time (and more); statistics are views over event logs instead of
counters that are changed in place, so they never go stale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RETENTION = 500
SORTABLE = {"newest": "created_at", "oldest": "created_at", "title": "title", "category": "category", "hits": "hits", "relevance": "hits", "id": "doc_id"}


def listing(corpus: DataFrame, limit: int = 50, offset: int = 0, category: str = "all", sort: str = "newest", order: str | None = None, search: str = "") -> tuple[DataFrame, DataFrame]:
    """A page of documents, and the number of all that match as a one-row table. Searches are case-insensitive substrings of
    title, content or keywords; ties go by number, latest first."""
    found = corpus.filter("is_published") if "is_published" in corpus.columns else corpus
    if category != "all":
        found = found.filter(F.col("category") == category)
    if search:
        low = search.lower()
        hit = F.contains(F.lower("title"), F.lit(low)) | F.contains(F.lower("content"), F.lit(low))
        if "keywords" in corpus.columns:
            hit = hit | F.exists("keywords", lambda k: F.contains(F.lower(k), F.lit(low)))
        found = found.filter(hit)
    column = SORTABLE.get(sort, "created_at")
    column = column if column in corpus.columns else "doc_id"
    order = order or ("asc" if sort in ("oldest", "title", "category") else "desc")
    by = F.asc(column) if order == "asc" and sort != "relevance" else F.desc(column)
    page = found.orderBy(by, F.desc("doc_id")).offset(max(0, offset)).limit(max(1, min(limit, 500)))
    return page, found.agg(F.count(F.lit(1)).alias("total"))


def categories(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("category").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "category")


def duplicate_count(corpus: DataFrame, title: str) -> DataFrame:
    return corpus.filter(F.col("title") == title.strip()).agg(F.count(F.lit(1)).alias("duplicates"))


def duplicate_titles(corpus: DataFrame) -> DataFrame:
    """title, n of the titles that several documents have."""
    return corpus.groupBy("title").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def append_history(history: DataFrame, rows: DataFrame, retention: int = RETENTION) -> DataFrame:
    """History with new rows, cut to the latest ones by id: a top-k, not a window over all rows."""
    return history.unionByName(rows).orderBy(F.desc("id")).limit(retention)


def recent(history: DataFrame, limit: int = 10) -> DataFrame:
    return history.orderBy(F.desc("id")).limit(max(1, min(limit, 50)))


def delete_searches(history: DataFrame, ids: list[int]) -> DataFrame:
    return history.filter(~F.col("id").isin(*ids)) if ids else history


def popular(history: DataFrame, limit: int = 8) -> DataFrame:
    return history.groupBy("query").agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("execution_time"), 3).alias("avg_ms")).orderBy(F.desc("count"), "query").limit(limit)


def slowest(history: DataFrame, limit: int = 5) -> DataFrame:
    return history.groupBy("query").agg(F.round(F.max("execution_time"), 3).alias("ms")).orderBy(F.desc("ms"), "query").limit(limit)


def search_statistics(history: DataFrame) -> DataFrame:
    n, empty = F.count(F.lit(1)), F.count(F.when(F.col("result_count") == 0, 1))
    return history.agg(
        n.alias("total_searches"), F.countDistinct("query").alias("unique_queries"), F.round(F.coalesce(F.avg("execution_time"), F.lit(0.0)), 3).alias("average_time_ms"),
        empty.alias("empty_result_searches"), F.coalesce(F.round(F.try_divide(100.0 * (n - empty), n), 2), F.lit(0.0)).alias("success_rate"),
    )


def document_statistics(log: DataFrame) -> DataFrame:
    """doc_id, times_shown, times_clicked, last_shown_at from a log (doc_id, kind: shown or clicked, ts)."""
    shown, clicked = F.col("kind") == "shown", F.col("kind") == "clicked"
    return log.groupBy("doc_id").agg(F.count(F.when(shown, 1)).alias("times_shown"), F.count(F.when(clicked, 1)).alias("times_clicked"), F.max(F.when(shown, F.col("ts"))).alias("last_shown_at"))


def with_hits(corpus: DataFrame, statistics: DataFrame) -> DataFrame:
    """corpus with hits raised by the times shown."""
    s = statistics.select(F.col("doc_id").alias("_d"), "times_shown")
    return corpus.join(s, F.col("doc_id") == F.col("_d"), "left").withColumn("hits", F.col("hits") + F.coalesce("times_shown", F.lit(0))).select(*corpus.columns)


def most_matched(statistics: DataFrame, corpus: DataFrame, limit: int = 8) -> DataFrame:
    """The most shown documents; statistics are cut to the possible ones before the join only by the join itself, as titles break ties."""
    return statistics.join(corpus.select("doc_id", "title", "category"), "doc_id").select("doc_id", "title", "category", "times_shown", "times_clicked").orderBy(F.desc("times_shown"), "title", "doc_id").limit(limit)


def upsert(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """table with rows put in place of those of equal keys; of rows with equal keys the last by column seq counts."""
    last = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq")))).filter("_i = 1").select(*table.columns)
    return table.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


def keyword_stats(keyword_table: DataFrame, documents: int, limit: int | None = 25) -> DataFrame:
    """term, doc_freq, total_freq, idf of document keywords, by (-doc_freq, term)."""
    k = keyword_table.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"), F.sum("frequency").alias("total_freq"))
    k = k.withColumn("idf", F.round(F.log((1.0 + documents) / (1.0 + F.col("doc_freq"))) + 1.0, 5)).orderBy(F.desc("doc_freq"), "term")
    return k if limit is None else k.limit(limit)
