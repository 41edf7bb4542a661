"""TF-IDF scores, term reports and BM25 over an index."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.operators.index import Index


def query_weights(index: Index, terms: list[str]) -> dict[str, float]:
    """The L2-normalised query vector; terms the index does not have weigh nothing."""
    counts = Counter(terms)
    if not counts:
        return {}
    idf = {r["term"]: r["idf"] for r in index.idf.filter(F.col("term").isin(*counts)).collect()}  # one row a term of the query
    raw = {t: n / len(terms) * idf.get(t, 0.0) for t, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    return {t: x / norm for t, x in raw.items() if x} if norm else {}


def cosine(index: Index, terms: list[str]) -> DataFrame:
    """doc_id, score (cosine, six places) of documents with any of the terms; all others score 0."""
    weights = query_weights(index, terms)
    if not weights:
        return index.weights.limit(0).select("doc_id", F.lit(0.0).alias("score"))
    w = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    hit = index.weights.filter(F.col("term").isin(*weights))
    return hit.groupBy("doc_id").agg(F.round(F.sum(F.col("w") * w[F.col("term")]), 6).alias("score"))


def score_query(index: Index, terms: list[str]) -> DataFrame:
    """doc_id, score of every document, zeros too, by (-score, doc_id)."""
    return index.corpus.select("doc_id").join(cosine(index, terms), "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "doc_id")


def term_report(index: Index, terms: list[str], top: int = 10) -> DataFrame:
    """term, df, idf, rarity (percent), doc_id, tfidf, rank: each term's best documents by tf times idf."""
    n = index.bag.groupBy("doc_id").agg(F.sum("n").alias("length"))
    hit = index.bag.filter(F.col("term").isin(*terms)).join(n, "doc_id").join(F.broadcast(index.idf.filter(F.col("term").isin(*terms))), "term")
    tfidf = F.round(F.col("n") / F.col("length") * F.col("idf"), 6)
    best = Window.partitionBy("term").orderBy(F.desc("tfidf"), "doc_id")
    rarity = F.round((1 - F.col("df") / F.lit(float(max(1, index.size)))) * 100, 2)
    return hit.select("term", "df", F.round("idf", 5).alias("idf"), rarity.alias("rarity"), "doc_id", tfidf.alias("tfidf")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def stats(index: Index) -> DataFrame:
    n = index.bag.groupBy("doc_id").agg(F.sum("n").alias("n"))
    every = index.corpus.select("doc_id").join(n, "doc_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    lengths = every.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("total_tokens"), F.round(F.avg("n"), 4).alias("avg_length"), F.max("n").alias("max_length"))
    return lengths.crossJoin(F.broadcast(index.idf.agg(F.count(F.lit(1)).alias("vocabulary"))))  # one row each


def bm25(index: Index, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc_id, score of documents with all the terms; the idf of full-text engines, ln((N - df + 0.5) / (df + 0.5)), at least 1e-6."""
    terms = list(dict.fromkeys(terms))
    length = index.bag.groupBy("doc_id").agg(F.sum("n").alias("length"))
    mean = length.agg(F.sum("length") / F.lit(float(max(1, index.size)))).first()[0] or 1.0
    hit = index.bag.filter(F.col("term").isin(*terms)).join(F.broadcast(index.idf.filter(F.col("term").isin(*terms)).select("term", "df")), "term").join(length, "doc_id")
    weight = F.greatest(F.lit(1e-6), F.log((F.lit(float(index.size)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = weight * F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("length") / mean))
    return hit.groupBy("doc_id").agg(F.count(F.lit(1)).alias("found"), F.round(F.sum(part), 6).alias("score")).filter(F.col("found") == len(terms)).select("doc_id", "score")
