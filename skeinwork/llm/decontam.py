"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark, one scan of each text.

Normal form: A-Z lower-cased, words are runs of digits, a-z and characters from U+0080. On UTF-8 bytes both
rules change no byte's place, so a word's place in the normal form is its byte offset in the original text. A window is
ten consecutive words of an item; an item of fewer words, but not none, is one window. The automaton's alphabet are the benchmark's words,
numbered; all other words are one letter that no pattern has. So a window costs at most ten states, and a text is read word by word.

The automaton is built once in each worker, from items that are broadcast. Its memory follows the benchmark's size, about 100 bytes a byte, so
the benchmark is read to the driver in blocks of BLOCK_BYTES of normalised text and one is held at a time. A benchmark of one block, the usual
case by far, is one automaton and one scan; a larger one has an automaton for each block, chained: each scan adds its hits to those before.

Defined results: null text (or one without words) has no words, no hits and no items; an item without words has no
window; equal windows of several items count for each of these items; a null item_id is the item "null"; repeated
document rows each get their result; an empty benchmark hits nothing; without documents there are no rows; a text of any length is
scanned whole; other columns are ignored, and kept as they are by drop_contaminated.
"""

from __future__ import annotations

import uuid

from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
BLOCK_BYTES = 4 << 20
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_cache: dict = {}


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def word_offsets(text: bytes):
    """Byte offsets in the original text where words start and end."""
    import numpy as np

    inside = np.frombuffer(b" " + text.translate(_TABLE) + b" ", np.uint8) != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def automaton(items: list[tuple[str, bytes]], width: int = WINDOW):
    """Numbers of the items' words, the automaton of their windows (None if there are none; its values are a window's length and items), and
    the length of the shortest window."""
    import ahocorasick

    number: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        w = [number.setdefault(x, len(number) + 1) for x in words(text)]
        for i in range(max(1, len(w) - width + 1) if w else 0):
            owners.setdefault(tuple(w[i : i + width]), set()).add(item)
    if not owners:
        return number, None, 0
    made = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for w, own in owners.items():
        made.add_word(w, (len(w), tuple(own)))
    made.make_automaton()
    return number, made, min(map(len, owners))


def _of_worker(key: str, sent, width: int):
    """The automaton of a broadcast block, built when a worker first needs it."""
    if _cache.get("key") != (key, width):
        _cache.clear()
        _cache.update(key=(key, width), made=automaton(sent.value, width))
    return _cache["made"]


def scan(text: bytes, made) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words; runs of hit words (first, behind the last); items with a window in the text."""
    import numpy as np

    number, matcher, shortest = made
    w = words(text)
    if not w or matcher is None:
        return len(w), [], set()
    letters = np.fromiter(map(number.get, w, repeat(0)), np.int64, len(w))
    # A word that no window has takes the automaton back to its start, so it reads the runs between such words that a window fits in.
    cuts = np.concatenate([[-1], np.flatnonzero(letters == 0), [len(w)]])
    found = []
    for k in np.flatnonzero(np.diff(cuts) > shortest).tolist():
        first, behind = int(cuts[k]) + 1, int(cuts[k + 1])
        found += [(first + e, v) for e, v in matcher.iter(tuple(letters[first:behind].tolist()))]
    if not found:
        return len(w), [], set()
    ends = np.array([e for e, _ in found]) + 1
    delta = np.zeros(len(w) + 1, np.int64)
    np.add.at(delta, ends - [n for _, (n, _) in found], 1)
    np.add.at(delta, ends, -1)
    hit = np.concatenate([[False], np.cumsum(delta[:-1]) > 0, [False]])
    edge = np.flatnonzero(hit[1:] != hit[:-1])
    return len(w), list(zip(edge[::2].tolist(), edge[1::2].tolist())), {i for _, (_, own) in found for i in own}


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list:
    """A key and a broadcast of items for each block of at most block_bytes of text (or of one item); the driver holds one block at a time."""
    rows = common.pick(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    sent, block, room = [], [], block_bytes

    def send():
        sent.append((uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast(sorted(block))))

    for r in rows.toLocalIterator():
        text = b" ".join(words(r["text"].encode()))
        if not text:
            continue
        if block and len(text) > room:
            send()
            block, room = [], block_bytes
        block.append(("null" if r["item_id"] is None else r["item_id"], text))
        room -= len(text)
    if block or not sent:
        send()
    return sent


def find_contamination(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, hit_words array<struct<first, behind>>, hit_bytes array<struct<start, end>> (in the original
    UTF-8 text), items array<string> for each row of documents."""
    import pyarrow as pa

    common.batches(documents.sparkSession)
    blocks = benchmark_blocks(benchmark, block_bytes)
    runs = pa.list_(pa.struct([("first", pa.int64()), ("behind", pa.int64())]))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = {"doc_id": pa.int64(), "text": pa.string(), "n_words": pa.int64(), "hit_words": runs, "hit_bytes": spans, "items": pa.list_(pa.string())}
    sql = "doc_id long, text string, n_words long, hit_words array<struct<first:long,behind:long>>, hit_bytes array<struct<start:long,end:long>>, items array<string>"

    def scanner(key, sent, last):
        def run(batches):
            made = _of_worker(key, sent, width)
            for b in batches:
                cols = {k: [] for k in kinds}
                old = b.column("hit_words").to_pylist(), b.column("items").to_pylist()
                for text, had, items in zip(common.texts(b.column("text")), *old):
                    n, hit, own = scan(text, made)
                    hit = merged(hit + [(x["first"], x["behind"]) for x in had])
                    starts, ends = word_offsets(text) if hit and last else ((), ())
                    cols["n_words"].append(n)
                    cols["hit_words"].append([{"first": x, "behind": y} for x, y in hit])
                    cols["hit_bytes"].append([{"start": int(starts[x]), "end": int(ends[y - 1])} for x, y in hit] if last else [])
                    cols["items"].append(sorted(own.union(items)))
                out = {k: pa.array(v, kinds[k]) for k, v in cols.items() if k not in ("doc_id", "text")}
                out |= {"doc_id": b.column("doc_id"), "text": pa.nulls(len(b), pa.string()) if last else b.column("text").cast(pa.string())}
                yield pa.RecordBatch.from_arrays([out[k] for k in kinds], list(kinds))

        return run

    rows = common.pick(documents, "doc_id", "text").selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text", "0L as n_words", "cast(array() as array<struct<first:long,behind:long>>) as hit_words", "cast(array() as array<struct<start:long,end:long>>) as hit_bytes", "cast(array() as array<string>) as items")
    for k, block in enumerate(blocks):
        rows = rows.mapInArrow(scanner(*block, k == len(blocks) - 1), sql)
    return rows.drop("text")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of documents, all columns as they are, in whose text no window of the benchmark occurs."""
    import pyarrow as pa

    common.batches(documents.sparkSession)
    at, names = documents.columns.index("text"), documents.columns
    documents = documents.toDF(*[f"_{i}" for i in range(len(names))])
    for key, sent in benchmark_blocks(benchmark, block_bytes):

        def run(batches, key=key, sent=sent):
            made = _of_worker(key, sent, width)
            for b in batches:
                keep = [not scan(t, made)[1] for t in common.texts(b.column(at))]
                yield b.filter(pa.array(keep, pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents.toDF(*names)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, x: n + x["behind"] - x["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), item AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win
), gram AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)
), hit AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM gram g JOIN win ON g.s = win.s AND g.n = win.n
), word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), own AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT doc.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN own USING (doc_id)
"""
