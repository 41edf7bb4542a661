"""Streams: an index kept up to date by micro-batches, and popular queries in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions import text as X
from skeinwork.operators import index


def posting_rows(corpus: DataFrame) -> DataFrame:
    """doc_id, term, wtf of documents with title and content, in one pass; for batches, whose vocabulary is small."""
    parts = [F.transform(X.tokenize(F.col("title")), lambda t: F.struct(t.alias("surface"), F.lit(index.TITLE + index.BODY).alias("w"))), F.transform(X.tokenize(F.col("content")), lambda t: F.struct(t.alias("surface"), F.lit(index.BODY).alias("w")))]
    words = corpus.select("doc_id", F.explode(F.concat(*parts)).alias("x")).groupBy("doc_id", F.col("x.surface").alias("surface")).agg(F.sum("x.w").alias("wtf"))
    return words.withColumn("term", X.stem("surface")).groupBy("doc_id", "term").agg(F.sum("wtf").alias("wtf"))


def last_versions(batch: DataFrame) -> DataFrame:
    """One row a document: the last by column seq if there is one, by the whole row otherwise."""
    order = [F.desc("seq")] if "seq" in batch.columns else []
    best = Window.partitionBy("doc_id").orderBy(*order, *[F.desc(c) for c in sorted(batch.columns) if c not in ("doc_id", "seq")])
    return batch.withColumn("_i", F.row_number().over(best)).filter("_i = 1").drop("_i")


def keep_postings(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64, **trigger):
    """Writes each micro-batch's postings under its own number, by buckets of documents, with a mark for each of its documents; a batch
    that is run again after a failure overwrites its own folder. Of several versions of a document in a batch the last counts; a row whose
    column deleted is true has a mark only, so the document is gone. latest() reads what counts, compact() drops what does not."""

    def write(batch: DataFrame, number: int) -> None:
        docs = last_versions(batch)
        marks = docs.select("doc_id", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("wtf"))
        there = docs.filter(~F.coalesce("deleted", F.lit(False))) if "deleted" in docs.columns else docs
        rows = posting_rows(there).select("doc_id", "term", "wtf").unionByName(marks).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _last_rows(spark, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    last = rows.filter("term is null").groupBy("bucket", "doc_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["bucket", "doc_id", "batch"])


def latest(spark, path: str) -> DataFrame:
    """doc_id, term, wtf: for each document the rows of the last batch that had it."""
    return _last_rows(spark, path).filter("term is not null").select("doc_id", "term", "wtf")


def compact(spark, path: str, to: str) -> None:
    """Writes what counts in path to a new folder, as one batch with the number of the last; later batches may go there."""
    last = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    if last is not None:
        _last_rows(spark, path).select("doc_id", "term", "wtf", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{to}/batch={last}")


def popular_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window start, query, count over a stream or table of events (ts, query); late rows are dropped by the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "query").agg(F.count(F.lit(1)).alias("count")).select(F.col("w.start").alias("window_start"), "query", "count")


def top_of_windows(counts: DataFrame, limit: int = 5) -> DataFrame:
    best = Window.partitionBy("window_start").orderBy(F.desc("count"), "query")
    return counts.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= limit)
