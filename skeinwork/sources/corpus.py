"""Corpora: from the driver's documents, from text files with a header, from rows in code; and the ways back out.

A corpus has doc_id, title, content, category, hits (and author, url, summary, keywords where the source has them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.functions import text as X

#: Stored documents.
DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("slug", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("summary", T.StringType()), T.StructField("category", T.StringType()), T.StructField("author", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("token_count", T.LongType()), T.StructField("hits", T.LongType()), T.StructField("is_published", T.BooleanType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()),
])

UPLOAD_SUFFIXES = (".txt", ".md", ".text")
UPLOAD_BYTES = 2 * 1024 * 1024
UPLOAD_FILES = 20
MIN_CONTENT = 10
EDITABLE = ("title", "content", "summary", "category", "author", "url", "keywords", "is_published")


def from_documents(documents: DataFrame) -> DataFrame:
    """The driver's documents as a corpus: the first line is the title, the source the category."""
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", F.substring(F.substring_index(text, "\n", 1), 1, 80).alias("title"), text.alias("content"), F.coalesce("source", F.lit("Uncategorised")).alias("category"), F.lit(1).cast("long").alias("hits"))


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A corpus of rows in code, with all columns of DOCUMENT; what a row does not say is null, hits are 1 and is_published is true."""
    base = {"hits": 1, "is_published": True}
    return spark.createDataFrame([tuple((base | r).get(f.name) for f in DOCUMENT) for r in rows], DOCUMENT)


def bootstrap(spark: SparkSession, path: str, rows: DataFrame | None = None) -> bool:
    """Makes the stored corpus at path if there is none, empty or of rows (with DOCUMENT's columns); says whether it did."""
    if not is_empty(spark, path):
        return False
    (from_rows(spark, []) if rows is None else rows.select(*[F.col(f.name).cast(f.dataType) for f in DOCUMENT])).write.mode("overwrite").parquet(path)
    return True


def is_empty(spark: SparkSession, path: str) -> bool:
    """Whether there is no stored corpus at path, or none with rows."""
    from pyspark.errors import AnalysisException

    try:
        return not spark.read.parquet(path).limit(1).count()
    except AnalysisException:
        return True


def word_count(col):
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(r"\S+")).cast("long")


def default_summary(col):
    """The first sentence, at most 240 characters, with its full stop."""
    return F.concat(F.substring(F.trim(F.substring_index(F.coalesce(col, F.lit("")), ".", 1)), 1, 240), F.lit("."))


def validated(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Rows ready to insert, and a column error for those that are not: title and at least MIN_CONTENT characters of content.

    Slugs are unique among rows and existing slugs: of equal ones the first, by title and content, keeps it if it is free, the others get
    the least numbers that make a slug nobody has. A slug with a number has one base only, so bases do not meet; rows with an error get no slug.
    """
    title, content = F.trim(F.coalesce("title", F.lit(""))), F.coalesce("content", F.lit(""))
    error = F.when(title == "", "title is required").when(F.length(F.trim(content)) < MIN_CONTENT, "content is too short")
    out = rows.withColumns({"title": title, "content": content, "error": error, "base": X.slugify(title)})
    old = existing.select("slug").filter("slug is not null").distinct() if existing is not None else rows.sparkSession.createDataFrame([], "slug string")
    good = F.col("error").isNull()
    i = F.row_number().over(Window.partitionBy("base", good).orderBy("title", "content"))
    out = out.withColumn("i", i).join(old.select(F.col("slug").alias("base"), F.lit(True).alias("held")), "base", "left").withColumn("bare", good & (F.col("i") == 1) & F.col("held").isNull())
    # Numbers that are held: by existing slugs, and by rows whose own slug ends in one.
    held = old.union(out.filter("bare").select("base")).select(F.regexp_extract("slug", "^(.*)-[1-9][0-9]{0,8}$", 1).alias("base"), F.regexp_extract("slug", "-([1-9][0-9]{0,8})$", 1).try_cast("int").alias("number"))
    held = held.filter("base <> '' and number is not null").distinct().withColumn("free", F.col("number") - F.row_number().over(Window.partitionBy("base").orderBy("number")))
    # The k-th row without a bare slug gets the k-th free number: k, and one more for each held number with fewer than k free ones below it.
    out = out.withColumn("k", F.when(good & ~F.col("bare"), F.col("i") - F.when(F.col("held").isNull(), 1).otherwise(0)))
    asked = out.filter("k is not null").select("base", "k").distinct()
    places = asked.select("base", "k", F.col("k").alias("at"), F.lit(0).alias("one")).unionByName(held.select("base", F.lit(None).cast("int").alias("k"), (F.col("free") + 1).alias("at"), F.lit(1).alias("one")))
    skipped = places.withColumn("skip", F.sum("one").over(Window.partitionBy("base").orderBy("at"))).filter("k is not null").select("base", "k", "skip")
    out = out.join(skipped, ["base", "k"], "left").withColumn("slug", F.when(F.col("bare"), F.col("base")).when(good, F.concat_ws("-", "base", (F.col("k") + F.col("skip")).cast("string"))))
    summary = F.col("summary") if "summary" in rows.columns else F.lit(None).cast("string")
    return out.withColumns({"summary": F.when(F.length(F.trim(F.coalesce(summary, F.lit("")))) > 0, summary).otherwise(default_summary(F.col("content"))), "token_count": word_count(F.col("content")), "hits": F.lit(1).cast("long")}).drop("base", "i", "held", "bare", "k", "skip")


def apply_updates(documents: DataFrame, updates: DataFrame) -> DataFrame:
    """documents with the non-null editable columns of updates (doc_id and any of EDITABLE); new content renews token_count and summary.

    Of several updates of a document the last value of each column counts, by column seq if there is one, by value otherwise."""
    given = [c for c in EDITABLE if c in updates.columns and c in documents.columns]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("seq", c) if "seq" in updates.columns else F.col(c)))
    u = updates.groupBy(F.col("doc_id").alias("_id")).agg(F.lit(1).alias("_one"), *[last(c).alias(f"_{c}") for c in given])
    out = documents.join(u, F.col("doc_id") == F.col("_id"), "left")
    new = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in given}
    if "content" in given:
        changed = F.col("_content").isNotNull()
        if "token_count" in documents.columns:
            new["token_count"] = F.when(changed, word_count(F.col("_content"))).otherwise(F.col("token_count"))
        if "summary" in documents.columns:
            own = F.col("_summary") if "summary" in given else F.lit(None).cast("string")
            new["summary"] = F.coalesce(own, F.when(changed, default_summary(F.col("_content"))), F.col("summary"))
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in documents.columns])


def delete(documents: DataFrame, ids: DataFrame) -> DataFrame:
    return documents.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def seed(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """existing and those rows whose slug it does not have."""
    return existing.unionByName(rows.join(existing.select("slug"), "slug", "left_anti").select(*existing.columns))


_HEADER = ("title", "category", "author", "keywords", "summary")


def parse_file(content, path):
    """Columns of one text file: up to ten lines NAME: value, ended by a dashed line, then the body; the title defaults to the
    file's name."""
    # A header ends in the first eleven lines; all behind them is one piece, so a long body is not split again for each field.
    lines = F.split(content, "\r?\n", 12)
    dash = F.array_position(F.transform(F.slice(lines, 1, 11), lambda x: x.rlike("^\\s*-{5,}\\s*$")), F.lit(True))
    head = F.slice(lines, 1, F.greatest(dash.cast("int") - 1, F.lit(0)))

    def value(name: str):
        start = f"(?i)^\\s*{name}\\s*:"
        return F.try_element_at(F.transform(F.filter(head, lambda x: x.rlike(start)), lambda x: F.trim(F.regexp_replace(x, start, ""))), F.lit(1))

    field = {n: value(n) for n in _HEADER}
    body = F.when(dash > 0, F.concat_ws("\n", F.filter(F.transform(lines, lambda x, i: F.when(i < 11, x).otherwise(F.replace(x, F.lit("\r\n"), F.lit("\n")))), lambda x, i: i >= dash))).otherwise(content)
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1), "[-_]+", " ")
    return {
        "title": F.coalesce(F.nullif(field["title"], F.lit("")), F.initcap(F.url_decode(F.replace(stem, F.lit("%20"), F.lit(" "))))), "content": F.regexp_replace(body, r"^\s+|\s+$", ""), "category": F.coalesce(F.nullif(field["category"], F.lit("")), F.lit("Uncategorised")),
        "author": F.coalesce(F.nullif(field["author"], F.lit("")), F.lit("Unknown")), "keywords": X.split_keywords(field["keywords"]), "summary": F.coalesce(field["summary"], F.lit("")),
    }


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """A corpus of text files, each read whole; bytes that are not UTF-8 are replaced. Uploads' limits are columns: accepted, reason."""
    files = spark.read.format("binaryFile").load(path)
    content = F.make_valid_utf8(F.col("content").cast("string"))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    rows = files.select("path", "length", suffix.alias("suffix"), content.alias("raw"))
    rows = rows.select("*", *[c.alias(n) for n, c in parse_file(F.col("raw"), F.col("path")).items()])
    reason = F.when(~F.col("suffix").isin(*UPLOAD_SUFFIXES), "type").when(F.col("length") > UPLOAD_BYTES, "size").when(F.length(F.trim("content")) < MIN_CONTENT, "content is too short")
    return rows.drop("raw").withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def with_default_keywords(corpus: DataFrame, top: DataFrame) -> DataFrame:
    """Documents without keywords get their most frequent stems: top has doc_id and top_keywords."""
    return corpus.join(top, "doc_id", "left").withColumn("keywords", F.when(F.size("keywords") > 0, F.col("keywords")).otherwise(F.coalesce("top_keywords", F.array().cast("array<string>")))).drop("top_keywords")


def render_file(title, category, author, keywords, summary, content):
    return F.concat_ws("\n", F.concat(F.lit("TITLE: "), title), F.concat(F.lit("CATEGORY: "), category), F.concat(F.lit("AUTHOR: "), author), F.concat(F.lit("KEYWORDS: "), F.array_join(keywords, ", ")), F.concat(F.lit("SUMMARY: "), summary), F.lit("-" * 60), content)


def write_text_files(corpus: DataFrame, path: str) -> None:
    """One file for each document, in a folder for each slug."""
    body = render_file(*[F.col(c) for c in ("title", "category", "author", "keywords", "summary", "content")])
    corpus.select("slug", body.alias("value")).repartition("slug").write.partitionBy("slug").mode("overwrite").text(path, lineSep="\n")


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
