"""Mixing sources to target weights by capped water-filling; DataFrame operations only.

Targets: every source starts with its weight's share of the total; sources above the maximum number of epochs are
clamped there and the excess is dealt to the others by weight, again and again until none is above. The loop
reads two sums over the table of sources in each round, and that table has one row a source.

Sampling: a source that gets e epochs takes each document floor(e) times, and some documents once more. Which ones is
settled by a seeded 60-bit hash of id and text: documents are passed in the order of that hash until the fraction's
words are taken, the last one if more than half of it is still due. Documents with more than 1 / LARGE of their
source's words, 100 at most, come first, and the others make up for what these took too much or too little. Repeated rows have one
hash and stand in the order of their row numbers, each a document of its own, so some of them may be taken and others not.

The last document taken is found digit by digit: sums over the 2 ** DIGIT values of the hash's next digit, for the documents that
agree with it so far, tell the next digit. So a window has at most so many rows a source, and a source that holds a third of all rows,
or a document that does, is nowhere one group. What is taken is within half a small document of the target.

Defined results: null text has size 0; a null source is one source, the last by code point; an empty table gives no rows; if all
sizes are 0 all targets are 0; a text of any length is counted whole; other columns are kept as they are by mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

HASH_BITS = 60
DIGIT = 12
DIGITS = 3
LARGE = 100
WEIGHTS = (3, 1, 2)
SEED = 7
#: Plans up to so many sources and bytes of their names are broadcast.
MOST_SOURCES, MOST_BYTES = 100_000, 16 << 20
_PART = 33  # row numbers hold the partition above these bits
_ALL = (1 << 63) - 1


def text_size(text):
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def document_hash(seed: int, doc_id, text):
    none = F.lit("")
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), none), F.lit(":"), F.coalesce(text, none))), 1, HASH_BITS // 4), 16, 10).cast("long")


def cyclic_weights(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """sources with columns s (a number) and weight: the given weights, repeating, over sources by code point, null last.

    Numbers come from a range-partitioned sort: a row number inside its partition, and the sizes of the partitions before.
    """
    # The partition number is only sure once written.
    placed = common.staged(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = placed.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    row = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    numbered = placed.withColumn("row", row).join(F.broadcast(before.select("part", "before")), "part").withColumn("s", F.col("before") + F.col("row") - 1)
    return numbered.select("source", "source_size", "s", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights)).cast("int") + 1).alias("weight"))


def water_fill(weighted: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """weighted (source_size, weight) with column target."""
    size, cap, level = F.col("source_size"), F.col("source_size") * F.lit(float(max_epochs)), 0.0
    total = min(share, max_epochs) * (weighted.agg(F.sum(size)).first()[0] or 0)
    while total:
        free = cap > F.col("weight") * F.lit(level)
        clamped, weight = weighted.agg(F.sum(F.when(~free, cap)), F.sum(F.when(free, F.col("weight")))).first()
        if not weight:
            break
        raised = (total - (clamped or 0.0)) / weight
        if raised <= level * (1 + 1e-12):
            break
        level = raised
    return weighted.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def _before(*by: str):
    return Window.partitionBy("s").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)


def _cut(rows: DataFrame, due: DataFrame) -> DataFrame:
    """s, last_h, last_row: of rows (s, h, row, size) in the order of h and row, the last whose middle is not behind due's left (s, left)."""
    state = due.filter("left > 0").select("s", "left", F.lit(0).cast("long").alias("digits"), F.lit(0).cast("long").alias("before"))
    for k in range(1, DIGITS + 1):
        mine, shift = rows.join(state, "s"), HASH_BITS - DIGIT * k
        if k > 1:
            mine = mine.filter(F.shiftright("h", shift + DIGIT) == F.col("digits"))
        sums = mine.groupBy("s", F.shiftright("h", shift).alias("digits"), "left", "before").agg(F.sum("size").alias("words"))
        sums = sums.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(_before("digits")), F.lit(0))).filter("before < left")
        state = sums.groupBy("s").agg(F.max(F.struct("digits", "left", "before")).alias("x")).select("s", "x.left", "x.digits", "x.before")
        state = common.staged(state, "mix-digits")
    last = rows.join(state, "s").filter(F.shiftright("h", HASH_BITS - DIGIT * DIGITS) == F.col("digits"))
    last = last.groupBy("s", "h", "left", "before").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    last = last.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(_before("h")), F.lit(0))).filter("before < left")
    last = last.groupBy("s").agg(F.max(F.struct("h", "left", "before", "words", "n")).alias("x")).select("s", F.col("x.h").alias("last_h"), "x.left", "x.before", "x.words", "x.n")
    many = F.when(F.col("words") > 0, F.floor(F.try_divide((F.col("left") - F.col("before")) * F.col("n"), F.col("words")) + F.lit(0.5))).otherwise(F.col("n"))
    last = common.staged(last.select("s", "last_h", "n", many.alias("many")), "mix-last")
    # Of repeated rows with the last hash the first few may be due: their partition is found by counts, then the row in it.
    some = last.filter("many > 0 and many < n")
    if some.limit(1).count():
        same = rows.join(some, "s").filter("h = last_h").select("s", "row", "many", F.shiftright("row", _PART).alias("part"))
        counts = same.groupBy("s", "part", "many").agg(F.count(F.lit(1)).alias("here")).withColumn("past", F.coalesce(F.sum("here").over(_before("part")), F.lit(0)))
        where = common.staged(counts.filter("past < many and many <= past + here").select("s", "part", (F.col("many") - F.col("past")).alias("nth")), "mix-part")
        inside = same.drop("many").join(where, ["s", "part"]).withColumn("i", F.row_number().over(Window.partitionBy("s").orderBy("row"))).filter("i = nth").select("s", F.col("row").alias("found"))
        last = last.join(inside, "s", "left")
    else:
        last = last.withColumn("found", F.lit(None).cast("long"))
    return last.select("s", "last_h", F.coalesce("found", F.when(F.col("many") >= F.col("n"), F.lit(_ALL)).otherwise(F.lit(-1))).alias("last_row"))


def plan_mix(sized: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """For sized (source, h, row, size; staged, rows numbered), one row a source: source, source_size, target, whole (repetitions of every
    document), and the last large and the last small document in hash order that are taken once more."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = water_fill(cyclic_weights(sources, weights), share, max_epochs)
    epochs = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(epochs + F.lit(1e-9)).cast("long")).withColumn("due", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    plan = common.staged(plan, "mix-targets")
    rows = with_plan(sized, plan.select("source", "s", "source_size", "due"), "source").select("s", "h", "row", "size", _large().alias("large"), F.try_divide("due", "source_size").alias("part"))
    rows = common.staged(rows, "mix-rows")
    # At most LARGE documents of a source are large, as each has more than that share of its words.
    up_to = F.sum("size").over(Window.partitionBy("s").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, 0))
    large = rows.filter("large").withColumn("middle", up_to - F.col("size") / 2.0).withColumn("share", F.col("part") * F.sum("size").over(Window.partitionBy("s"))).filter("middle <= share")
    large = large.groupBy("s").agg(F.max(F.struct("h", "row")).alias("x"), F.sum("size").alias("large_words")).select("s", F.col("x.h").alias("large_h"), F.col("x.row").alias("large_row"), "large_words")
    plan = common.staged(plan.join(large, "s", "left"), "mix-large")
    cut = _cut(rows.filter("not large").select("s", "h", "row", "size"), plan.select("s", (F.col("due") - F.coalesce("large_words", F.lit(0))).alias("left")))
    return common.staged(plan.join(cut, "s", "left").select("source", "source_size", "target", "whole", "large_h", "large_row", "last_h", "last_row"), "mix-plan")


def _large():
    return F.col("size") * LARGE > F.col("source_size")


def repetitions(h, row):
    """Times a row of hash h, number row and column size is taken, given its source's row of plan_mix."""
    up_to = lambda name: F.coalesce((h < F.col(f"{name}_h")) | ((h == F.col(f"{name}_h")) & (row <= F.col(f"{name}_row"))), F.lit(False))
    return F.col("whole") + F.when(F.when(_large(), up_to("large")).otherwise(up_to("last")), 1).otherwise(0)


def sized(rows: DataFrame, doc_id: str, text: str, seed: int = SEED) -> DataFrame:
    """rows staged, with columns h, size and row."""
    hashed = rows.withColumns({"h": document_hash(seed, F.col(doc_id), F.col(text)), "size": text_size(F.col(text))})
    return common.staged((hashed if rows.columns[0] == "_0" else hashed.drop(text)).withColumn("row", F.monotonically_increasing_id()), "mix-sizes")


def with_plan(rows: DataFrame, plan: DataFrame, source: str) -> DataFrame:
    """rows joined to their source's row of plan: broadcast if it is small, else by a join whose hot keys Spark splits."""
    plan = plan.withColumnRenamed("source", "_plan_source")
    n, size = plan.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_plan_source")), F.lit(0))).first()
    plan = F.broadcast(plan) if n <= MOST_SOURCES and size <= MOST_BYTES else plan
    return rows.join(plan, rows[source].eqNullSafe(plan["_plan_source"]))


def mix(documents: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights=WEIGHTS, seed: int = SEED) -> DataFrame:
    """The mixed corpus: documents' own columns, each row as often as the mix takes it."""
    own = [f"_{i}" for i in range(len(documents.columns))]
    doc_id, text, source = (own[documents.columns.index(n)] for n in ("doc_id", "text", "source"))
    rows = sized(documents.toDF(*own), doc_id, text, seed)
    plan = plan_mix(rows.select(F.col(source).alias("source"), "h", "row", "size"), share, max_epochs, weights)
    taken = with_plan(rows, plan, source).withColumn("_n", repetitions(F.col("h"), F.col("row")).cast("int")).filter("_n > 0")
    return taken.select(*own, F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("col").toDF(*documents.columns)


def taken_words(documents: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights=WEIGHTS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of documents."""
    rows = sized(common.pick(documents, "doc_id", "text", "source"), "doc_id", "text", seed)
    joined = with_plan(rows, plan_mix(rows.select("source", "h", "row", "size"), share, max_epochs, weights), "source")
    return joined.select("doc_id", "size", "source_size", "target", (repetitions(F.col("h"), F.col("row")) * F.col("size")).alias("taken"))


def op4_mix(spark, sf_dir: str) -> DataFrame:
    return taken_words(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])) AS size,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, {HASH_BITS // 4}) AS BIGINT) AS h
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), p AS (SELECT *, source_size * 2.0::DOUBLE AS cap, [{', '.join(f'{w}.0::DOUBLE' for w in WEIGHTS)}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight FROM s
), k AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source) AS i, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM p
), level AS (
  SELECT i, cap, weight, (total - coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) / sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS up FROM k
), first_free AS (SELECT min(i) AS i FROM level WHERE cap >= weight * up
), t AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT up FROM level JOIN first_free USING (i)), 1e300::DOUBLE)) AS target FROM k
), w AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-9::DOUBLE) AS BIGINT) ELSE 0 END AS whole FROM t
), due AS (SELECT *, greatest(0.0::DOUBLE, target - whole * source_size) AS due FROM w
), m AS (
  SELECT d.*, source_size, target, whole, due, size * {LARGE} > source_size AS large,
    sum(size) OVER (PARTITION BY d.source, size * {LARGE} > source_size ORDER BY h ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS middle,
    sum(size) OVER (PARTITION BY d.source, size * {LARGE} > source_size) AS words
  FROM d JOIN due ON d.source IS NOT DISTINCT FROM due.source
), big AS (SELECT source, sum(size) AS large_words FROM m WHERE large AND middle <= due / source_size * words GROUP BY source
)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN CASE WHEN large THEN middle <= due / source_size * words ELSE middle <= due - coalesce(large_words, 0) END THEN 1 ELSE 0 END) AS taken
FROM m LEFT JOIN big ON m.source IS NOT DISTINCT FROM big.source
"""
