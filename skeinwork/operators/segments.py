"""An index that is changed by what changes: segments that are never rewritten, deletions on the side, statistics that add up.

Adding documents writes one segment with their entries; deleting some writes their numbers. A document's entries are those of its last segment, unless a later deletion names it.
Statistics (document frequencies, counts, votes of surface forms) are kept as what each change adds and takes away, so they are sums over segments, and no change
reads the entries of other documents. A segment has its documents' terms by document, written where the documents lie, which is what a deletion looks up, and inverted:
each of its files of entries is sorted by (term, doc_id) and has the documents of one task, so a term's look-up reads its row groups in each, and nothing is shuffled.

Segments of about one size are merged once there are FAN of them, into one of the next tier, so a document is rewritten a logarithm of times. A merge leaves out what is deleted.

    <root>/segment-000007/{entries,forward,statistics,gone}   root/manifest-000007: the segments of version 7

A version is what its manifest names, and the manifest is written last: a change that fails leaves files that no version has. One writer at a time is assumed; readers keep the
version they opened. Old versions' files stay until vacuum().
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork import session
from skeinwork.operators.index import BODY, KEYWORD, TITLE, analysed, idf

FAN = 4
_SEGMENT = "segment int, tier int, documents long, first int"
_SCHEMAS = {
    "entries": "term string, doc_id long, wtf long, n long", "forward": "doc_id long, size long, terms array<struct<term:string,wtf:long,n:long>>, surfaces array<struct<term:string,surface:string,votes:long>>",
    "statistics": "term string, surface string, doc_freq long, freq long, total long, votes long", "gone": "doc_id long",
}


class SegmentedIndex:
    """One version of an index at root. add() and delete() return the next one."""

    def __init__(self, spark: SparkSession, root: str, version: int = 0):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version
        self.segments = spark.read.schema(_SEGMENT).parquet(self._manifest(version)).orderBy("segment").collect() if version else []

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> SegmentedIndex:
        """The last version at root; an empty one if there is none."""
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        done = [int(n[9:]) for n in names if n.startswith("manifest-") and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
        return cls(spark, root, max(done, default=0))

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifest-{version:06d}"

    def _path(self, segment: int, table: str) -> str:
        return f"{self.root}/segment-{segment:06d}/{table}"

    def _read(self, table: str, segments: list | None = None) -> DataFrame:
        """A table of all segments, each row with its segment's number; what is deleted is still there."""
        some = [self.spark.read.schema(_SCHEMAS[table]).parquet(self._path(s["segment"], table)).withColumn("segment", F.lit(s["segment"])) for s in (self.segments if segments is None else segments)]
        empty = self.spark.createDataFrame([], f"{_SCHEMAS[table]}, segment int")
        return functools.reduce(DataFrame.unionByName, some, empty)

    # Readers.

    def _gone(self) -> DataFrame:
        """doc_id, since: its rows in segments before that one are dead. As small as the changes that no merge has taken in."""
        return self._read("gone").groupBy("doc_id").agg(F.max("segment").alias("since"))

    def _forward(self, segments: list, columns: list[str]) -> DataFrame:
        """Documents of these segments that are there, where they lie: numbers that later segments name are sent to them as bitmaps."""
        parts = []
        for s in segments:
            rows, later = self._read("forward", [s]).select(*columns), [x for x in self.segments if x["segment"] > s["segment"]]
            parts.append(session.by_ids(rows, self._read("gone", later).select("doc_id"), "left_anti") if later else rows)
        return functools.reduce(DataFrame.unionByName, parts)

    def _alive(self, rows: DataFrame) -> DataFrame:
        gone = self._gone().withColumnRenamed("doc_id", "_d")
        return rows.join(gone, (F.col("doc_id") == F.col("_d")) & (F.col("segment") < F.col("since")), "left_anti").drop("segment")

    @property
    def entries(self) -> DataFrame:
        """term, doc_id, wtf, n of the documents that are there; a filter on term reads the files of the term."""
        return self._alive(self._read("entries"))

    @property
    def documents(self) -> DataFrame:
        """doc_id and size (tokens of title and text) of the documents that are there."""
        return self._alive(self._read("forward").select("doc_id", "size", "segment"))

    @property
    def size(self) -> int:
        """Documents: what segments hold, less what they took away."""
        return sum(s["documents"] for s in self.segments)

    @property
    def vocabulary(self) -> DataFrame:
        """term, display, doc_freq, freq, total, idf, summed up from what the changes added and took away."""
        rows = self._read("statistics").repartition("term").groupBy("term", "surface").agg(*[F.sum(c).alias(c) for c in ("doc_freq", "freq", "total", "votes")])
        shown = F.min(F.when((F.col("surface") != "") & (F.col("votes") > 0), F.struct((-F.col("votes")).alias("v"), "surface")))["surface"].alias("display")
        terms = rows.groupBy("term").agg(shown, *[F.sum(c).alias(c) for c in ("doc_freq", "freq", "total")])
        return terms.filter("doc_freq > 0").withColumn("idf", idf(F.col("doc_freq"), self.size))

    def documents_of(self, terms: list[str]) -> DataFrame:
        """term, doc_id, wtf for the terms asked for."""
        return self._alive(self._read("entries").filter(F.col("term").isin(*terms))).select("term", "doc_id", "wtf")

    def scored(self, terms: list[str]) -> DataFrame:
        """doc_id, score: the sum of n * idf over the terms asked for."""
        found = self._alive(self._read("entries").filter(F.col("term").isin(*terms))).join(F.broadcast(self.vocabulary.filter(F.col("term").isin(*terms)).select("term", "idf")), "term")
        return found.groupBy("doc_id").agg(F.sum(F.col("n") * F.col("idf")).alias("score"))

    # Changes.

    def add(self, rows: DataFrame) -> SegmentedIndex:
        """With these documents (columns as for an Index), in place of those of equal doc_id. What is written is as large as they are, and as what they replace."""
        number = self._next()
        votes = F.transform("surfaces", lambda x: F.struct(x["term"].alias("term"), x["surface"].alias("surface"), ((TITLE + BODY) * x["title"] + BODY * x["content"] + KEYWORD * x["keywords"]).alias("votes")))
        terms = F.transform("terms", lambda x: F.struct(x["term"].alias("term"), x["wtf"].alias("wtf"), x["n"].alias("n")))
        self._write(number, "forward", analysed(rows).select("doc_id", "size", terms.alias("terms"), votes.alias("surfaces")))
        added = self.spark.read.schema(_SCHEMAS["forward"]).parquet(self._path(number, "forward"))
        self._invert(number, added)
        return self._changed(number, added, added.select("doc_id"))

    def _invert(self, number: int, forward: DataFrame) -> None:
        rows = forward.select("doc_id", F.explode("terms").alias("x")).select("x.term", "doc_id", "x.wtf", "x.n")
        self._write(number, "entries", rows.sortWithinPartitions("term", "doc_id"))

    def delete(self, ids: DataFrame) -> SegmentedIndex:
        """Without these documents (doc_id). Their numbers and what they had in the statistics are written, no more."""
        number = self._next()
        for table in ("entries", "forward"):
            self._write(number, table, self.spark.createDataFrame([], _SCHEMAS[table]))
        return self._changed(number, None, ids)

    def _next(self) -> int:
        return self.version + 1

    def _write(self, number: int, table: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(self._path(number, table))

    def _changed(self, number: int, added: DataFrame | None, ids: DataFrame) -> SegmentedIndex:
        ids = session.staged(ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct(), "segment-ids")
        low, high = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
        # Files of documents in order have row groups that need not be read.
        old = self._forward(self.segments, ["doc_id", "terms", "surfaces"]).filter(F.col("doc_id").between(low, high)) if self.segments and low is not None else self._read("forward", []).drop("size", "segment")
        old = session.staged(session.by_ids(old, ids, "left_semi"), "segment-old")
        parts = [_statistics(old, -1)] + ([_statistics(added, 1)] if added is not None else [])
        total = functools.reduce(DataFrame.unionByName, parts).groupBy("term", "surface").agg(*[F.sum(c).alias(c) for c in ("doc_freq", "freq", "total", "votes")])
        self._write(number, "statistics", total.sortWithinPartitions("term", "surface"))
        self._write(number, "gone", ids)
        documents = (added.count() if added is not None else 0) - old.count()
        out = self._published(number, [*[tuple(s) for s in self.segments], (number, 0, documents, number)])
        return out._compacted()

    def _published(self, version: int, segments: list[tuple]) -> SegmentedIndex:
        self.spark.createDataFrame(segments, _SEGMENT).coalesce(1).write.mode("overwrite").parquet(self._manifest(version))
        return SegmentedIndex(self.spark, self.root, version)

    def _compacted(self) -> SegmentedIndex:
        """Merges the last FAN segments while they are of one tier."""
        tail = self.segments[-FAN:]
        if len(tail) < FAN or len({s["tier"] for s in tail}) > 1:
            return self
        return self.merged(tail)._compacted()

    def merged(self, some: list | None = None) -> SegmentedIndex:
        """The same index with the last segments (all, if none are named) as one. Documents that are dead are left out; deletions stay as long as there are older segments."""
        some = self.segments if some is None else some
        if not some:
            return self
        older = [s for s in self.segments if s["segment"] < some[0]["segment"]]
        number = self._next()
        self._write(number, "forward", self._forward(some, ["doc_id", "size", "terms", "surfaces"]))
        self._invert(number, self.spark.read.schema(_SCHEMAS["forward"]).parquet(self._path(number, "forward")))
        sums = self._read("statistics", some).groupBy("term", "surface").agg(*[F.sum(c).alias(c) for c in ("doc_freq", "freq", "total", "votes")])
        self._write(number, "statistics", sums.filter("doc_freq <> 0 or votes <> 0 or freq <> 0").sortWithinPartitions("term", "surface"))
        gone = self._read("gone", some).select("doc_id").distinct()
        self._write(number, "gone", gone if older else gone.limit(0))
        return self._published(number, [*map(tuple, older), (number, max(s["tier"] for s in some) + 1, sum(s["documents"] for s in some), min(s["first"] for s in some))])

    def vacuum(self) -> None:
        """Deletes the files that this version does not read; versions opened before cannot be read any more."""
        mine = {s["segment"] for s in self.segments}
        for n in range(1, self.version + 1):
            if n not in mine:
                session.remove(self.spark, f"{self.root}/segment-{n:06d}")
            if n != self.version:
                session.remove(self.spark, self._manifest(n))


def _statistics(forward: DataFrame, sign: int) -> DataFrame:
    """What these documents add to (or take from) the statistics: rows to sum up for each term, with surface "", and for each of its surfaces."""
    zero, by = F.lit(0).cast("long"), F.lit(sign).cast("long")
    terms = forward.select(F.explode("terms").alias("x")).select("x.term", F.lit("").alias("surface"), by.alias("doc_freq"), (F.col("x.wtf") * by).alias("freq"), (F.col("x.n") * by).alias("total"), zero.alias("votes"))
    votes = forward.select(F.explode("surfaces").alias("x")).select("x.term", "x.surface", zero.alias("doc_freq"), zero.alias("freq"), zero.alias("total"), (F.col("x.votes") * by).alias("votes"))
    return terms.unionByName(votes)
