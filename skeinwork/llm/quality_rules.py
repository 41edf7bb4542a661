"""Quality rules: base counts of each text, and lines that too many documents of a host share.

Lines are normalised (A-Z lower-cased, digits to 0, white space to one space) and hashed together with their host (column source), to 128
bits. For each host and line the distinct documents are counted; a document is its text, so exact copies on a host are one, or its doc_id if one asks for that (null is one id). A line is
removed from texts (cleaned, keep_good) if more than LIMIT documents of its host have it, every time it stands there, and a document whose removed lines hold more than DEPLETED percent of its
words is rejected. Both limits are parameters. No line is spared for the sake of near copies: what more than LIMIT pages of a host say in the
same words is boilerplate here, and copies of one document with small changes are too, once there are so many.

Lines and documents are hashed where they lie. Counts are partial before every shuffle, by (line, document) first, so a line that
stands in a third of all documents is no hot key. Lines above the limit are broadcast up to MOST_BROADCAST of them, 16 bytes each, and joined
beyond that. With a broadcast cleaned and keep_good look lines up where their text lies, so no text is shuffled.

Defined results: null text is empty, has no words and fails the base rule; a null source is one host, apart from the empty one; texts that
are one line and agree once normalised count as different documents with a shared line; repeated rows each get a row and count once; a
text of any length is read whole; an empty table gives no rows; other columns are ignored, and kept as they are by keep_good and cleaned; a text without its removed lines is the others joined by line feeds, lines
without a word included, and texts with nothing to remove are byte for byte what they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LIMIT = 30
DEPLETED = 80
MIN_WORDS = 20
MAX_REPEATED = 30
MOST_BROADCAST = 500_000
SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_LINE = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    import numpy as np

    if len(words) <= width:
        return 0
    joined = b" ".join(words)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    grams = [joined[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends[width - 1 :])]
    if len(set(grams)) == len(grams):
        return 0
    seen: dict[bytes, int] = {}
    hit = np.zeros(len(words) + 1, np.int64)
    for i, g in enumerate(grams):
        if (first := seen.setdefault(g, i)) != i:
            for x in (first, i):
                hit[x] += 1
                hit[x + width] -= 1
    return int((np.cumsum(hit) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(_SPACES)]
    chars = len(text.decode("utf-8", "replace")) - sum(text.count(c) for c in _SPACES)
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


def line_hashes(host: int, text: bytes) -> dict[int, int]:
    """Words of the document in each of its normalised lines, by 128-bit hash of host and line."""
    from xxhash import xxh3_128_intdigest

    out: dict[int, int] = {}
    for line in text.translate(_LINE).split(b"\n"):
        if w := line.split():
            h = xxh3_128_intdigest(b" ".join(w), host)
            out[h] = out.get(h, 0) + len(w)
    return out


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_LINES = "array<struct<h1:long,h2:long,n:long>>"


def features(rows: DataFrame, source: str, text: str, *carried: str, unit: str | None = None) -> DataFrame:
    """A staged row for each of rows: its number row, the carried columns, host, k1 (hash of the text, or of the column unit), base counts, base_failed and lines."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    common.batches(rows.sparkSession)
    host, words = F.col(source).cast("string"), F.col(text).cast("string")
    rows = rows.select(*carried, F.xxhash64(F.coalesce(F.col(unit).cast("string") if unit else words, F.lit(""))).alias("k1"), F.xxhash64(host.isNull(), host).alias("_host"), words.alias("_text"))
    kept = len(carried) + 1

    def run(batches):
        import numpy as np

        for b in batches:
            counts, h, n, sizes = [], [], [], []
            for host, t in zip(b.column("_host").to_pylist(), common.texts(b.column("_text"))):
                counts.append(base_counts(t))
                lines = line_hashes(host & (1 << 64) - 1, t)
                h += lines.keys()
                n += lines.values()
                sizes.append(len(lines))
            made = np.array(counts, np.int64).reshape(-1, 5)
            parts = np.frombuffer(b"".join(x.to_bytes(16, "little") for x in h), "<i8").reshape(-1, 2)
            flat = pa.StructArray.from_arrays([pa.array(parts[:, 0].copy()), pa.array(parts[:, 1].copy()), pa.array(n, pa.int64())], ["h1", "h2", "n"])
            lines = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)
            failed = (made[:, 0] < MIN_WORDS) | (100 * made[:, 4] > MAX_REPEATED * made[:, 0])
            cols = [*b.columns[:kept], b.column("_host"), *[pa.array(made[:, i].copy()) for i in range(5)], pa.array(failed), lines]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:kept], "host", *_COUNTS, "base_failed", "lines"])

    schema = StructType.fromDDL("host long, " + ", ".join(f"{c} long" for c in _COUNTS) + f", base_failed boolean, lines {_LINES}")
    made = rows.mapInArrow(run, StructType([*rows.schema.fields[:kept], *schema.fields]))
    return common.staged(made.withColumn("row", F.monotonically_increasing_id()), "quality")


def frequent_lines(made: DataFrame, limit: int = LIMIT) -> DataFrame:
    """h1, h2 of the lines of features() that more than limit distinct documents of their host have, staged."""
    lines = made.select("k1", F.explode("lines").alias("x")).select("k1", "x.h1", "x.h2")
    often = lines.groupBy("h1", "h2", "k1").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("one").alias("docs")).filter(F.col("docs") > limit)
    return common.staged(often.select("h1", "h2"), "frequent-lines")


def removed_lines(made: DataFrame, limit: int = LIMIT, most_broadcast: int = MOST_BROADCAST, often: DataFrame | None = None) -> DataFrame:
    """row, h1, h2, n (words) for the lines of features() that more than limit distinct documents of their host have."""
    often = frequent_lines(made, limit) if often is None else often
    often = F.broadcast(often) if often.count() <= most_broadcast else often
    lines = made.select("row", F.explode("lines").alias("x")).select("row", "x.*")
    return lines.join(often, ["h1", "h2"], "left_semi").select("row", "h1", "h2", "n")


def removed_words(made: DataFrame, limit: int = LIMIT, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """row, removed (words in removed lines), for rows of features() with such lines."""
    return removed_lines(made, limit, most_broadcast).groupBy("row").agg(F.sum("n").alias("removed"))


def without_lines(host: int, text: bytes, gone: set[tuple[int, int]]) -> bytes:
    """The text without the lines that have these hashes."""
    from xxhash import xxh3_128_intdigest

    kept = []
    for line in text.split(b"\n"):
        if w := line.translate(_LINE).split():
            h = xxh3_128_intdigest(b" ".join(w), host & (1 << 64) - 1)
            low, high = (x - (1 << 64) if x >> 63 else x for x in (h & (1 << 64) - 1, h >> 64))
            if (low, high) in gone:
                continue
        kept.append(line)
    return b"\n".join(kept)


def _cleaned(rows: DataFrame, text: str) -> DataFrame:
    """rows (host and gone, the hashes of removed lines or null, beside their columns) with texts that lack these lines; host and gone are dropped."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    names = [c for c in rows.columns if c not in ("host", "gone")]

    def run(batches):
        for b in batches:
            texts = b.column(text).cast(pa.large_binary()).to_pylist()
            for i, (host, gone) in enumerate(zip(b.column("host").to_pylist(), b.column("gone").to_pylist())):
                if gone is not None:
                    texts[i] = without_lines(host, texts[i] or b"", {(x["h1"], x["h2"]) for x in gone})
            made = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(b.column(text).type)
            yield pa.RecordBatch.from_arrays([made if n == text else b.column(n) for n in names], names)

    touched = rows.filter("gone is not null").mapInArrow(run, StructType([rows.schema[n] for n in names]))
    return rows.filter("gone is null").select(*names).unionByName(touched)


def verdicts(documents: DataFrame, limit: int = LIMIT, depleted: int = DEPLETED, by_id: bool = False) -> DataFrame:
    """doc_id, base counts, removed_words, base_failed, kept for each row of documents. by_id: documents are told apart by doc_id, not by text."""
    rows = common.pick(documents, "doc_id", "source", "text")
    made = features(rows.withColumn("doc_id", F.col("doc_id").cast("long")), "source", "text", "doc_id", unit="doc_id" if by_id else None)
    out = made.drop("lines", "host").join(removed_words(made, limit), "row", "left").withColumn("removed_words", F.coalesce("removed", F.lit(0)))
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("removed_words") <= depleted * F.col("n_words"))).drop("row", "k1", "removed")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return verdicts(common.table(spark, sf_dir, "documents")).select("doc_id", *_COUNTS, "base_failed", "kept", "removed_words")


class LineSet:
    """Lines by (h1, h2), in order; contains() tells which of many are there."""

    def __init__(self, h1, h2):
        import numpy as np

        order = np.lexsort((h2, h1))
        self.h1, self.h2 = h1[order], h2[order]
        #: The most lines with one h1, all but always one.
        self.run = int(np.unique(self.h1, return_counts=True)[1].max()) if len(h1) else 0

    def contains(self, h1, h2):
        import numpy as np

        found, at = np.zeros(len(h1), bool), np.searchsorted(self.h1, h1)
        for i in range(self.run):
            to = np.minimum(at + i, len(self.h1) - 1)
            found |= (self.h1[to] == h1) & (self.h2[to] == h2)
        return found


def _looked_up(made: DataFrame, often: DataFrame, names: list[str], text: str, depleted: int | None) -> DataFrame:
    """The columns names of features(), with texts that lack the lines often (h1, h2), which are sent to the workers; with depleted, the rows that are kept."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    few = often.toArrow()
    sent = made.sparkSession.sparkContext.broadcast(LineSet(few.column("h1").to_numpy(), few.column("h2").to_numpy()))

    def run(batches):
        import numpy as np

        lines_gone = sent.value
        for b in batches:
            lists = b.column("lines")
            flat, starts = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            h1, h2, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            hit = lines_gone.contains(h1, h2)
            hits, words = (np.concatenate([[0], np.cumsum(x)]) for x in (hit, np.where(hit, n, 0)))
            removed, touched = np.diff(words[starts]), np.diff(hits[starts]) > 0
            keep = np.ones(len(b), bool)
            if depleted is not None:
                failed, size = b.column("base_failed").to_numpy(zero_copy_only=False), b.column("n_words").to_numpy()
                keep = ~failed & (100 * removed <= depleted * size)
            texts = b.column(text).cast(pa.large_binary()).to_pylist()
            hosts = b.column("host").to_pylist()
            for i in np.flatnonzero(keep & touched).tolist():
                mine = slice(starts[i], starts[i + 1])
                gone = set(zip(h1[mine][hit[mine]].tolist(), h2[mine][hit[mine]].tolist()))
                texts[i] = without_lines(hosts[i], texts[i] or b"", gone)
            cleaned = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(b.column(text).type)
            whole = pa.RecordBatch.from_arrays([cleaned if c == text else b.column(c) for c in names], names)
            yield whole.filter(pa.array(keep))

    needed = made.select(*names, "host", "n_words", "base_failed", "lines")
    return needed.mapInArrow(run, StructType([made.schema[n] for n in names]))


def _without_frequent(documents: DataFrame, limit: int, depleted: int | None, most_broadcast: int, by_id: bool) -> DataFrame:
    """documents with texts that lack the removed lines; with depleted, the rows that are kept. Texts are staged with their counts, so they are read once."""
    names = [f"_{i}" for i in range(len(documents.columns))]
    source, text = (names[documents.columns.index(n)] for n in ("source", "text"))
    made = features(documents.toDF(*names), source, text, *names, unit=names[documents.columns.index("doc_id")] if by_id else None)
    often = frequent_lines(made, limit)
    if often.count() <= most_broadcast:
        return _looked_up(made, often, names, text, depleted).toDF(*documents.columns)
    # At most a document's own lines.
    lines = common.staged(removed_lines(made, limit, most_broadcast, often).groupBy("row").agg(F.collect_list(F.struct("h1", "h2")).alias("gone"), F.sum("n").alias("removed")), "removed-lines")
    rows = made.drop("lines").join(lines, "row", "left")
    if depleted is not None:
        rows = rows.filter(~F.col("base_failed") & (100 * F.coalesce("removed", F.lit(0)) <= depleted * F.col("n_words")))
    return _cleaned(rows.select(*names, "host", "gone"), text).toDF(*documents.columns)


def cleaned(documents: DataFrame, limit: int = LIMIT, most_broadcast: int = MOST_BROADCAST, by_id: bool = False) -> DataFrame:
    """All rows of documents, with texts that lack the lines that too many documents of their host have."""
    return _without_frequent(documents, limit, None, most_broadcast, by_id)


def keep_good(documents: DataFrame, limit: int = LIMIT, depleted: int = DEPLETED, most_broadcast: int = MOST_BROADCAST, by_id: bool = False) -> DataFrame:
    """The rows of documents that are kept, with texts that lack the removed lines; other columns as they are."""
    return _without_frequent(documents, limit, depleted, most_broadcast, by_id)


def oracle_sql(limit: int = LIMIT, depleted: int = DEPLETED, by_id: bool = False) -> str:
    unit = "coalesce(CAST(doc_id AS VARCHAR), '')" if by_id else "md5(t)"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), raw AS (SELECT r, source, {unit} AS k, unnest(string_split(t, chr(10))) AS x FROM d
), line AS (
  SELECT *, coalesce(regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000'), '[^\x20\x09-\x0D]+'), []) AS lw FROM raw WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
), dup AS (SELECT r, count(*) - count(DISTINCT x) AS n_dup_lines FROM line GROUP BY r
), often AS (SELECT source, lw FROM line GROUP BY source, lw HAVING count(DISTINCT k) > {limit}
), gone AS (SELECT r, CAST(sum(len(line.lw)) AS BIGINT) AS removed FROM line JOIN often ON line.lw = often.lw AND line.source IS NOT DISTINCT FROM often.source GROUP BY r
), gram AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8)
), again AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM gram
), rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM again WHERE n > 1) GROUP BY r
), base AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(removed, 0) AS removed_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND 100 * removed_words <= {depleted} * n_words AS kept FROM base
"""


ORACLE_SQL = oracle_sql()
