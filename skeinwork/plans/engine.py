"""One object for a corpus: what an application asks for, each answer a DataFrame (or a dict around one).

It stands in for a JSON interface: the methods are its routes, the arguments its parameters with the same limits. Changes of the corpus give
a new engine, whose index takes over what did not change; history and the log of shown and clicked documents go along.
"""

from __future__ import annotations

import time
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork import session
from skeinwork.functions import text as X
from skeinwork.operators import graph, ranking, relational, strings, tfidf
from skeinwork.operators.index import Index
from skeinwork.sources import corpus as C

HISTORY = "id long, query string, normalized string, tokens array<string>, result_count long, documents_searched long, execution_time double, is_filtered boolean, ts timestamp"
LOG = "doc_id long, kind string, ts timestamp"


class Engine:
    """corpus: doc_id, title, content, category, hits; slug and keywords where there are any."""

    def __init__(self, corpus: DataFrame, weights: dict[str, float] | None = None, damping: float = 0.85):
        self.spark, self.corpus, self.weights, self.damping = corpus.sparkSession, corpus, weights, damping
        self.index = Index(corpus)
        self.history = self.spark.createDataFrame([], HISTORY)
        self.log = self.spark.createDataFrame([], LOG)

    # Changes.

    def _with(self, index: Index) -> Engine:
        out = Engine(index.corpus, self.weights, self.damping)
        out.index, out.history, out.log = index, self.history, self.log
        return out

    def insert(self, rows: DataFrame) -> tuple[Engine, DataFrame]:
        """The engine with rows (title, content and more of the corpus' columns) that are valid, under new numbers, and the rows that are not, with error."""
        checked = session.staged(C.validated(rows, self.corpus if "slug" in self.corpus.columns else None), "inserted")
        last = self.corpus.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
        good = session.numbered(checked.filter("error is null").drop("doc_id"), "doc_id", "slug", "title", start=last + 1)
        new = good.select(*[(F.col(f.name) if f.name in good.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.corpus.schema.fields])
        return self._with(self.index.with_documents(session.staged(new, "new-documents"))), checked.filter("error is not null")

    def update(self, updates: DataFrame) -> Engine:
        changed = C.apply_updates(self.corpus.join(updates.select("doc_id").distinct(), "doc_id", "left_semi").select(*self.corpus.columns), updates)
        return self._with(self.index.with_documents(session.staged(changed, "changed-documents")))

    def delete(self, ids: list[int]) -> Engine:
        return self._with(self.index.without(self.spark.createDataFrame([(i,) for i in ids], "doc_id long")))

    def import_files(self, path: str, most: int = C.UPLOAD_FILES) -> tuple[Engine, DataFrame]:
        """The engine with the text files at path, and the files that are refused, with reason; more than most files at once are an error."""
        files = C.read_text_files(self.spark, path)
        if files.count() > most:
            raise ValueError(f"at most {most} files are taken at once")
        out, refused = self.insert(files.filter("accepted"))
        bad = files.filter("not accepted").select("path", "reason").unionByName(refused.select("path", F.col("error").alias("reason")))
        return out, bad

    def _noted(self, rows: DataFrame, kind: str) -> None:
        self.log = session.staged(self.log.unionByName(rows.select(F.col("doc_id").cast("long"), F.lit(kind).alias("kind"), F.current_timestamp().alias("ts"))), "log")

    def click(self, doc_id: int) -> None:
        self._noted(self.corpus.filter(F.col("doc_id") == doc_id).select("doc_id"), "clicked")

    def statistics(self) -> DataFrame:
        """doc_id, times_shown, times_clicked, last_shown_at."""
        return relational.document_statistics(self.log)

    def most_matched(self, limit: int = 8) -> DataFrame:
        return relational.most_matched(self.statistics(), self.corpus, limit)

    def clear_history(self, ids: list[int] | None = None) -> None:
        """Deletes these searches, or all."""
        self.history = self.history.limit(0) if ids is None else session.staged(relational.delete_searches(self.history, ids), "history")

    # The graph.

    @cached_property
    def edges(self) -> DataFrame:
        sets = graph.keyword_ids(self.index.keywords.select("doc_id", "keyword"), self.corpus.select("doc_id", "category"))
        refs = graph.reference_edges(self.corpus) if "slug" in self.corpus.columns else self.spark.createDataFrame([], "src long, dst long, pos int, type string, weight double")
        return session.staged(graph.document_graph(refs, graph.pairs_of(sets), sets), "document-graph")

    @cached_property
    def nodes(self) -> DataFrame:
        return self.corpus.select(F.col("doc_id").alias("node"))

    @cached_property
    def ranks(self) -> DataFrame:
        return session.staged(graph.pagerank(self.nodes, self.edges.select("src", "dst"), self.damping), "ranks")

    def traverse(self, algorithm: str = "bfs", start: int | None = None, goal: int | None = None, depth: int | None = None) -> DataFrame:
        found = graph.traverse(self.edges, algorithm, start, goal, depth)
        return found.join(self.corpus.select(F.col("doc_id").alias("node"), "title"), "node", "left")

    def related(self, doc_id: int, limit: int = 5) -> DataFrame:
        return graph.related(self.edges, self.ranks, doc_id, limit).join(self.corpus.select(F.col("doc_id").alias("dst"), "title"), "dst")

    def graph_stats(self) -> DataFrame:
        return graph.graph_stats(self.nodes, self.edges, self.ranks)

    # Search.

    @cached_property
    def searcher(self) -> ranking.Search:
        return ranking.Search(self.index, self.ranks.select(F.col("node").alias("doc_id"), "pagerank"), self.weights)

    def search(self, q: str, page: int = 1, per_page: int = 10, category: str = "all", sort: str = "relevance", record: bool = True, **more) -> dict:
        q = " ".join((q or "").split())[:300]
        if not q:
            raise ValueError("a query is required")
        began = time.perf_counter()
        found = self.searcher.search(q, page, per_page, category, sort, **more)
        if record:
            self.record(q, found, time.perf_counter() - began, category != "all")
        return found

    def page(self, q: str, page: int = 1, per_page: int = 10, min_score: float | None = None, **more) -> dict:
        """A page of results as it is shown: recorded, and its documents noted as shown, which raises their hits."""
        found = self.search(q, page, max(1, min(per_page, 40)), min_score=min_score, **more)
        found["results"] = session.staged(found["results"], "page")
        self._noted(found["results"], "shown")
        return found

    def with_hits(self) -> DataFrame:
        """The corpus with hits raised by the times shown."""
        return relational.with_hits(self.corpus, self.statistics())

    def record(self, q: str, found: dict, seconds: float, filtered: bool) -> None:
        last = self.history.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        row = self.spark.createDataFrame([(last + 1, q, found["normalized_query"], found["tokens"], found["total_results"], self.index.size, seconds * 1000, filtered, None)], HISTORY).withColumn("ts", F.current_timestamp())
        self.history = session.staged(relational.append_history(self.history, row), "history")

    def autocomplete(self, q: str, limit: int = 8) -> DataFrame:
        return self.index.autocomplete(q[:60], max(1, min(limit, 20)))

    def terms(self, prefix: str = "", limit: int = 20) -> DataFrame:
        limit = max(1, min(limit, 100))
        return self.index.terms_with_prefix(prefix.strip().lower(), limit) if prefix.strip() else self.index.top_terms(limit)

    def term_report(self, terms: list[str]) -> DataFrame:
        return tfidf.term_report(self.index, [X.stem_word(t) for t in terms])

    def full_text(self, q: str, limit: int = 20) -> DataFrame:
        return tfidf.bm25(self.index, X.analyze_query(q)["tokens"]).orderBy(F.desc("score"), "doc_id").limit(limit)

    # Documents.

    def document(self, doc_id: int) -> dict:
        return {"document": self.corpus.filter(F.col("doc_id") == doc_id), "statistics": self.statistics().filter(F.col("doc_id") == doc_id), "pagerank": self.ranks.filter(F.col("node") == doc_id), "related": self.related(doc_id)}

    def by_slug(self, slug: str) -> DataFrame:
        return self.corpus.filter(F.col("slug") == slug)

    def browse(self, page: int = 1, per_page: int = 10, **how) -> dict:
        rows, total = relational.listing(self.corpus, per_page, (max(1, page) - 1) * per_page, **how)
        return {"documents": rows, "total": total, "categories": relational.categories(self.corpus)}

    def stats(self) -> dict:
        return {"index": self.index.stats(), "tfidf": tfidf.stats(self.index), "graph": self.graph_stats(), "searches": relational.search_statistics(self.history), "popular": relational.popular(self.history), "slowest": relational.slowest(self.history)}

    def health(self) -> DataFrame:
        return self.corpus.agg(F.lit(1).alias("ok"), F.count(F.lit(1)).alias("documents"))

    # Comparisons.

    def compare_search(self, term: str) -> DataFrame:
        """algorithm, found, comparisons to look a word up in the vocabulary: in order, by halves, in a table with chains, in a trie.

        Each number is that of a run over the whole vocabulary: what comes before the word in order or in its chain, the halves around its
        place, the characters that any word shares with it."""
        stem = X.stem_word(X.normal_form(term))
        capacity = strings.grown_capacity(self.index.vocabulary.count())
        bucket = X.djb2_of(stem) % capacity
        v = self.index.vocabulary.select("term")
        shared = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(len(stem))), lambda k: F.when(F.substr(F.col("term"), F.lit(1), k) == F.substr(F.lit(stem), F.lit(1), k), k).otherwise(0)))
        row = v.agg(
            F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("term") < stem, 1)).alias("before"), F.count(F.when(F.col("term") == stem, 1)).alias("there"),
            F.count(F.when((F.col("term") < stem) & (X.djb2(F.col("term")) % capacity == bucket), 1)).alias("chain"), F.coalesce(F.max(shared), F.lit(0)).alias("shared"),
        ).first()
        found, low, high, probes = bool(row["there"]), 0, row["n"] - 1, 0
        while low <= high:
            probes, mid = probes + 1, (low + high) // 2
            if found and mid == row["before"]:
                break
            low, high = (mid + 1, high) if mid < row["before"] else (low, mid - 1)
        rows = [("linear", found, row["before"] + 1 if found else row["n"]), ("binary", found, probes), ("hash", found, row["chain"] + 1 if found else row["chain"]), ("trie", found, min(len(stem), row["shared"] + (not found)))]
        return self.spark.createDataFrame(rows, "algorithm string, found boolean, comparisons long")
