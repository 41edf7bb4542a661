"""Inverted index: tokens, stems, entries, vocabulary and TF-IDF weights as staged tables.

A document's tokens are counted where it lies (analysis), its keywords and terms with them. One table, entries, has a document's weighted count
and its bag count for each term; it is dealt by ranges of (term, doc_id), so hot terms are split and a query reads the files of its terms. That
is the one shuffle of a build. Postings, bag and weights are views of it. Field weights: a title token counts 3 and
once more as part of the text, a keyword token 4, a body token 1. The bag of TF-IDF has title, text and keywords once each.
"""

from __future__ import annotations

from collections import Counter
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork import session
from skeinwork.functions import text as X

TITLE, KEYWORD, BODY = 3, 4, 1
TOP_KEYWORDS = 6


_COUNTED = "array<struct<term:string,surface:string,title:long,content:long,keywords:long>>"
_TERMS = "array<struct<term:string,wtf:long,n:long,in_title:int,in_content:int>>"
#: What is made of one document; a token's counts by field are those of a surface form.
ANALYSIS = f"doc_id long, size long, keywords array<string>, surfaces {_COUNTED}, terms {_TERMS}"
#: Stems that a Python worker remembers.
MOST_STEMS = 1 << 20


def analysed(corpus: DataFrame) -> DataFrame:
    """ANALYSIS of each document: its surface forms and terms with their counts, its keywords (its own, or its most frequent stems by (-n, term)), and its
    size, the tokens of title and text. A document is one row, so its tokens are counted where it lies, and nothing is shuffled."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    own = F.col("keywords") if "keywords" in corpus.columns else F.lit(None).cast("array<string>")
    rows = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), X.normalize(F.col("title")).alias("title"), X.normalize(F.col("content")).alias("content"), own.alias("own"), F.transform(own, X.normalize).alias("own_words"))
    schema, dropped = StructType.fromDDL(ANALYSIS), {"", *X.STOP_WORDS, *"abcdefghijklmnopqrstuvwxyz0123456789"}
    made, parts = to_arrow_schema(schema), 512
    session.bounded_batches(4 << 20)

    def run(batches):
        import numpy as np

        class Stems(dict):
            def __missing__(self, w: str) -> str:
                if len(self) >= MOST_STEMS:
                    self.clear()
                s = self[w] = X.stem_word(w)
                return s

        stems = Stems()

        def words(text: str | None) -> dict[str, int]:
            # Stop words and single characters go from the distinct words, not from the text.
            found = Counter((text or "").split(" "))
            for w in dropped:
                found.pop(w, None)
            return found

        def lists(sizes, columns, kind):
            columns = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)).cast(f.type) if f.type != pa.string() else pa.array(c, f.type) for c, f in zip(columns, kind.value_type)]
            struct = pa.StructArray.from_arrays(columns, fields=list(kind.value_type))
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), struct, type=kind)

        def part(b):
            size, kept = [], []
            surface, term = ([], [[], [], [], [], []]), ([], [[], [], [], [], []])  # rows of each document, and columns of all
            for title, content, own, own_words in zip(*(c.to_pylist() for c in b.columns[1:])):
                head, body = words(title), words(content)
                by_term: dict[str, int] = {}
                for s, c in zip(map(stems.__getitem__, body), body.values()):
                    by_term[s] = by_term.get(s, 0) + c
                top = own
                if not own:
                    least = sorted(by_term.values())[-TOP_KEYWORDS:][0] if by_term else 0
                    top = [w for _, w in sorted((-c, w) for w, c in by_term.items() if c >= least)[:TOP_KEYWORDS]]
                size.append(sum(head.values()) + sum(body.values()))
                kept.append(top)
                tail: Counter = Counter()
                for k in own_words if own else top:
                    tail.update(words(k))
                # A document's words are nearly all words of its text, so these are columns as they are, and title and keywords are added to some places.
                every = list(dict.fromkeys([*head, *body, *tail]))
                has = [[f.get(w, 0) for w in every] for f in (head, body, tail)]
                of = list(map(stems.__getitem__, every))
                at: dict[str, int] = {}
                place = [at.setdefault(s, len(at)) for s in of]
                counts = [np.array(c, np.int64) for c in has]
                t, c, k = (np.bincount(place, weights=x, minlength=len(at)).astype(np.int64) for x in counts) if every else (np.zeros(0, np.int64),) * 3
                surface[0].append(len(every))
                surface[1][0] += of
                surface[1][1] += every
                for column, x in zip(surface[1][2:], counts):
                    column.append(x)
                term[0].append(len(at))
                term[1][0] += at
                for column, x in zip(term[1][1:], ((TITLE + BODY) * t + BODY * c + KEYWORD * k, t + c + k, (t > 0).astype(np.int64), (c > 0).astype(np.int64))):
                    column.append(x)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(kept, made.field("keywords").type), lists(*surface, made.field("surfaces").type), lists(*term, made.field("terms").type)], schema=made)

        for whole in batches:
            for at in range(0, whole.num_rows, parts):
                yield part(whole.slice(at, parts))

    return rows.mapInArrow(run, schema)


class Index:
    """The index of a corpus (doc_id, title, content, category, hits, keywords optional), each table made when first asked for."""

    def __init__(self, corpus: DataFrame):
        self.spark = corpus.sparkSession
        self.corpus = corpus

    @cached_property
    def analysis(self) -> DataFrame:
        """ANALYSIS of each document, staged."""
        return session.staged(analysed(self.corpus), "analysis")

    @cached_property
    def tokens(self) -> DataFrame:
        """doc_id, field (title, content), surface, term, n."""
        return self.all_tokens.filter("field <> 'keywords'")

    @cached_property
    def keywords(self) -> DataFrame:
        """doc_id, keyword, rank: a document's own keywords, or its most frequent stems by (-n, term)."""
        return self.analysis.select("doc_id", F.posexplode("keywords").alias("rank", "keyword")).select("doc_id", "keyword", (F.col("rank") + 1).alias("rank"))

    @cached_property
    def keyword_tokens(self) -> DataFrame:
        return self.all_tokens.filter("field = 'keywords'")

    @cached_property
    def all_tokens(self) -> DataFrame:
        """Tokens of title and content, and of keywords, which have that field."""
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"x.{f}").alias("n")) for f in ("title", "content", "keywords")]))
        rows = self.analysis.select("doc_id", F.explode("surfaces").alias("x")).select("doc_id", "x.surface", "x.term", each.alias("y")).filter("y.n > 0")
        return rows.select("doc_id", "y.field", "surface", "term", "y.n")

    @cached_property
    def entries(self) -> DataFrame:
        """term, doc_id, wtf (weighted count), n (count in the bag), by ranges of term."""
        return session.staged(self._from_analysis().repartitionByRange("term", "doc_id"), "entries", "term", "doc_id")

    def _from_analysis(self) -> DataFrame:
        return self.analysis.select("doc_id", F.explode("terms").alias("x")).select("x.term", "doc_id", "x.wtf", "x.n")

    def _entry_rows(self) -> DataFrame:
        """The rows of entries, from the analysis where entries are not there."""
        return self.entries if "entries" in self.__dict__ else self._from_analysis()

    @cached_property
    def postings(self) -> DataFrame:
        """term, doc_id, wtf, by term."""
        return self.entries.select("term", "doc_id", "wtf")

    @cached_property
    def surfaces(self) -> DataFrame:
        """term, surface, votes."""
        votes = (TITLE + BODY) * F.col("x.title") + BODY * F.col("x.content") + KEYWORD * F.col("x.keywords")
        return self.analysis.select(F.explode("surfaces").alias("x")).groupBy("x.term", "x.surface").agg(F.sum(votes).alias("votes"))

    @cached_property
    def counts(self) -> DataFrame:
        """term, doc_freq, freq (sum of weighted counts), total (in the bag): all that weights need, without surface forms. Entries are not made for it."""
        return session.staged(_counts(self._entry_rows()), "counts", "term")

    @cached_property
    def vocabulary(self) -> DataFrame:
        """term, display (the surface with most votes, then the first), doc_freq, freq (sum of weighted counts), total (in the bag), idf."""
        return session.staged(self._with_display(self.counts, self.surfaces), "vocabulary", "term")

    def _with_display(self, counts: DataFrame, surfaces: DataFrame) -> DataFrame:
        # Most votes, then the first surface: a sum for each surface, and one minimum a term.
        display = surfaces.groupBy("term").agg(F.min(F.struct((-F.col("votes")).alias("v"), "surface"))["surface"].alias("display"))
        return counts.join(display, "term", "left").select("term", "display", "doc_freq", "freq", "total", idf(F.col("doc_freq"), self.size).alias("idf"))

    def some_vocabulary(self, condition) -> DataFrame:
        """The vocabulary's rows of the terms that meet a condition (on term). Unless its tables are there already, only these terms are summed up, so no other is shuffled."""
        if "vocabulary" in self.__dict__:
            return self.vocabulary.filter(condition)
        return self._with_display(_counts(self._entry_rows().filter(condition)), self.surfaces.filter(condition))

    @cached_property
    def bag(self) -> DataFrame:
        """term, doc_id, n: the bag of TF-IDF."""
        return self.entries.select("term", "doc_id", "n")

    @cached_property
    def size(self) -> int:
        return self.corpus.count()

    @cached_property
    def idf(self) -> DataFrame:
        """term, df, total, idf."""
        return self.counts.select("term", F.col("doc_freq").alias("df"), "total", idf(F.col("doc_freq"), self.size).alias("idf"))

    def _raw(self, rows: DataFrame) -> DataFrame:
        """rows (term, n and more) with x, the raw TF-IDF weight. The idf of up to session.BROADCAST_ROWS of the most frequent terms are sent to the rows; only rows of other terms are shuffled."""
        idf = self.idf.select("term", "df", "idf")
        if not self._frequent:
            found = rows.join(F.broadcast(idf.drop("df")), "term")
        else:
            most = F.broadcast(idf.filter(F.col("df") >= self._frequent).drop("df"))
            others = rows.join(most.select("term"), "term", "left_anti").join(idf.filter(F.col("df") < self._frequent).drop("df"), "term")
            found = rows.join(most, "term").unionByName(others)
        return found.withColumn("x", F.col("n") * F.col("idf"))

    @cached_property
    def _frequent(self) -> int:
        """How many documents the terms have that are sent to rows: the least number that session.BROADCAST_ROWS terms at most reach; 0 if all terms are as few."""
        by_df = self.counts.groupBy("doc_freq").agg(F.count(F.lit(1)).alias("n"))  # a row for each number of documents
        reach = by_df.select("doc_freq", F.sum("n").over(Window.orderBy(F.desc("doc_freq"))).alias("n"))
        terms, most, least = reach.agg(F.max("n"), F.max("doc_freq"), F.min(F.when(F.col("n") <= session.BROADCAST_ROWS, F.col("doc_freq")))).first()
        return 0 if (terms or 0) <= session.BROADCAST_ROWS else least or most + 1

    @cached_property
    def squares(self) -> DataFrame:
        """doc_id, squares (the sum of its squared raw weights), terms. A document's terms of the frequent ones are added up where it lies."""
        raw = self._raw(self.analysis.select("doc_id", F.explode("terms").alias("t")).select("doc_id", "t.term", "t.n"))
        return raw.groupBy("doc_id").agg(F.sum(F.col("x") * F.col("x")).alias("squares"), F.count(F.lit(1)).alias("terms"))

    @cached_property
    def norms(self) -> DataFrame:
        """doc_id, norm of the document's raw TF-IDF vector."""
        return session.staged(self.squares.select("doc_id", F.sqrt("squares").alias("norm")), "norms")

    @cached_property
    def weights(self) -> DataFrame:
        """term, doc_id, w: L2-normalised TF-IDF; a filter on term reaches the files of entries."""
        return self._raw(self.bag).join(self.norms, "doc_id").select("term", "doc_id", (F.col("x") / F.col("norm")).alias("w"))

    @cached_property
    def weights_by_document(self) -> DataFrame:
        """doc_id, term, w: the weights, a document's side by side, as documents meet their norms before their terms are rows."""
        rows = self.analysis.select("doc_id", "terms").join(self.norms, "doc_id").select("doc_id", "norm", F.explode("terms").alias("t"))
        return self._raw(rows.select("doc_id", "norm", "t.term", "t.n")).select("doc_id", "term", (F.col("x") / F.col("norm")).alias("w"))

    @cached_property
    def lengths(self) -> DataFrame:
        """doc_id, n: tokens of title and text, keywords left out; documents without tokens have 0."""
        return self.analysis.select("doc_id", F.col("size").alias("n"))

    # Look-ups.

    def lookup(self, terms: list[str]) -> DataFrame:
        """term, in_vocabulary, document_count for each term asked for."""
        asked = self.spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
        found = self.postings.filter(F.col("term").isin(*terms)).groupBy("term").agg(F.count(F.lit(1)).alias("document_count"))
        return F.broadcast(asked).join(found, "term", "left").select("term", F.col("document_count").isNotNull().alias("in_vocabulary"), F.coalesce("document_count", F.lit(0)).alias("document_count"))

    def documents_of(self, terms: list[str]) -> DataFrame:
        """term, doc_id, wtf for the terms asked for, a row each, as a term may be in any share of the documents."""
        return self.postings.filter(F.col("term").isin(*terms))

    def candidates(self, terms: list[str]) -> DataFrame:
        """doc_id of documents with any of the terms."""
        return self.postings.filter(F.col("term").isin(*terms)).select("doc_id").distinct()

    def prefix_terms(self, prefix: str, limit: int = 50) -> DataFrame:
        return self.some_vocabulary(F.col("term").startswith(prefix)).select("term").orderBy("term").limit(limit)

    def terms_with_prefix(self, prefix: str, limit: int = 50) -> DataFrame:
        found = self.some_vocabulary(F.col("term").startswith(prefix))
        return found.select("display", "term", "doc_freq", "freq").orderBy(F.desc("freq"), "term").limit(limit)

    def top_terms(self, limit: int = 20) -> DataFrame:
        return self.vocabulary.select("term", "display", "doc_freq", "freq").orderBy(F.desc("freq"), "term").limit(limit)

    def autocomplete(self, prefix: str, limit: int = 8) -> DataFrame:
        """display, term, score: frequent words first, the longer the rest of the word the less."""
        prefix = prefix.strip().lower()
        if not prefix:
            return self.vocabulary.limit(0).select(F.col("display").alias("word"), "term", F.lit(0.0).alias("score"))
        found = self.some_vocabulary(F.col("term").startswith(prefix))
        score = F.round(F.col("freq") / (1 + 0.35 * (F.length("term") - len(prefix))), 4)
        return found.select(F.col("display").alias("word"), "term", score.alias("score")).orderBy(F.desc("score"), "word", "term").limit(limit)

    def stats(self) -> DataFrame:
        n = self.lengths.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("total_tokens"), F.round(F.avg("n"), 4).alias("avg_length"))
        v = self.postings.agg(F.countDistinct("term").alias("unique_terms"), F.count(F.lit(1)).alias("postings"))
        return n.crossJoin(F.broadcast(v))  # one row each

    def keyword_tables(self) -> DataFrame:
        """doc_id, term, frequency, in_title, in_content."""
        return self.analysis.select("doc_id", F.explode("terms").alias("x")).select("doc_id", "x.term", F.col("x.n").alias("frequency"), "x.in_title", "x.in_content")

    # Changes.

    def without(self, ids: DataFrame) -> Index:
        """The index of the corpus without these documents."""
        gone = ids.select("doc_id").distinct()
        return self._changed(self.corpus.join(gone, "doc_id", "left_anti"), gone, None)

    def with_documents(self, rows: DataFrame) -> Index:
        """The index of the corpus with these documents, in place of those of equal doc_id."""
        new = rows.select(*self.corpus.columns)
        gone = new.select("doc_id").distinct()
        return self._changed(self.corpus.join(gone, "doc_id", "left_anti").unionByName(new), gone, Index(new))

    def _changed(self, corpus: DataFrame, gone: DataFrame, new: Index | None) -> Index:
        """Tokens, keywords and entries of other documents are taken over as they are; only those of the new documents are made. What
        depends on all documents (vocabulary, norms) is summed up again from the entries."""
        out = Index(corpus)
        for name in ("analysis", "entries"):
            kept = session.by_ids(getattr(self, name), gone, "left_anti")
            kept = kept if new is None else kept.unionByName(getattr(new, name))
            if name == "entries":
                # What is left of the ranges lies in them still; with new rows they are dealt again.
                kept = session.staged(kept if new is None else kept.repartitionByRange("term", "doc_id"), name, "term", "doc_id")
            setattr(out, name, kept)
        return out


def _counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"), F.sum("wtf").alias("freq"), F.sum("n").alias("total"))


def idf(df, documents: int):
    """ln((1 + N) / (1 + df)) + 1."""
    return F.log((F.lit(1.0) + documents) / (F.lit(1.0) + df)) + 1.0


def tf(n, length):
    """A term's share of a document's tokens, 0 for a document without any."""
    return F.coalesce(F.try_divide(n, length), F.lit(0.0))


def tf_idf(n, length, df, documents: int):
    return tf(n, length) * idf(df, documents)
