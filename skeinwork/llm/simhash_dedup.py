"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bits has a nonzero vector of RADIUS + 1 bits. For each nonzero vector v of that length, a mask keeps the
bits whose vectors have an odd product with v. The vectors of RADIUS differing bits span less than the whole space, so
some v is orthogonal to all of them, and its mask keeps none of these bits: each pair within the radius has equal masked
fingerprints in at least one of the 2**(RADIUS + 1) - 1 tables. Pairs that meet are compared exactly.

Only distinct fingerprints are dealt out, so a group of exact copies is one row. A bucket of more than HOT fingerprints is counted before
anything is shuffled to it, and its fingerprints are dealt again, by masks from other vectors: the same guarantee holds for the pairs
inside it, and the new buckets share about half of the bits that were still open. That goes on for up to DEPTH times. A bucket gives no
pairs but a spanning forest of its links, which joins what all its links would join; links are looked for in tiles, so a bucket of any size
takes bounded memory. The forests go to distributed connected components.

Defined results: null text and text without words have fingerprint zero and are linked like any other; fewer words than
a shingle's are one shingle; repeated rows each get a row; component_id is the least non-null doc_id reached, null if there is none; a text of
any length is hashed whole; an empty table gives no rows; other columns are ignored, and kept as they are by keep_one.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
TILE = 1024
HOT = 20_000
DEPTH = 4


def covering_masks(radius: int = RADIUS, bits: int = 64, depth: int = 0) -> list[int]:
    """The masks of one family; each depth deals the vectors to the bits in another order."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    if depth:
        random.Random(depth).shuffle(vectors)
    return [sum(1 << i for i, phi in enumerate(vectors) if (phi & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[width - 1 :] or [len(joined)]
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends)], "<u8")
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def forest(fps, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Index pairs of links within the radius that connect whatever all such links connect."""
    import numpy as np

    label, edges = np.arange(len(fps)), []
    for a in range(0, len(fps), TILE):
        for b in range(a, len(fps), TILE):
            i, j = np.nonzero(np.bitwise_count(fps[a : a + TILE, None] ^ fps[None, b : b + TILE]) <= radius)
            i, j = i + a, j + b
            while True:
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                if not len(i):
                    break
                _, first = np.unique(label[i], return_index=True)
                parent = {}

                def root(x):
                    while parent.get(x, x) != x:
                        x = parent[x]
                    return x

                for x, y in zip(i[first].tolist(), j[first].tolist()):
                    p, q = root(int(label[x])), root(int(label[y]))
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        edges.append((x, y))
                to = np.arange(len(fps))
                for x in parent:
                    to[x] = root(x)
                label = to[label]
    return edges


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (hashes of the text), fp (64 bits as a signed long) for each row of documents."""
    import pyarrow as pa

    common.batches(documents.sparkSession)
    rows = common.pick(documents, "doc_id", "text")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), *common.content_keys(F.col("text")), "text")

    def run(batches):
        import numpy as np

        for b in batches:
            fp = np.array([fingerprint(t) for t in common.texts(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k1"), b.column("k2"), pa.array(fp)], ["doc_id", "k1", "k2", "fp"])

    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, fp long")


def _bucket_links(dealt: DataFrame, radius: int) -> DataFrame:
    """a, b: forests of the links between fingerprints fp of one bucket key."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        def joined(fp, cuts):
            out = []
            for x, y in zip(cuts[:-1], cuts[1:]):
                if y - x == 2:
                    if np.bitwise_count(fp[x] ^ fp[x + 1]) <= radius:
                        out.append((fp[x], fp[x + 1]))
                elif y - x > 2:
                    part = fp[x:y]
                    out += [(part[i], part[j]) for i, j in forest(part, radius)]
            at = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(at[:, 0])), pa.array(np.ascontiguousarray(at[:, 1]))], ["a", "b"])

        held, last = [], None  # fingerprints of the bucket that is not complete
        for b in batches:
            if not len(b):
                continue
            key, fp = b.column("key").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            first = 0 if key[0] != last else int(cuts[0]) if len(cuts) else len(key)
            held.append(fp[:first])
            if first < len(key):
                done = np.concatenate(held)
                yield joined(done, [0, len(done)])
                inner = [first, *[c for c in cuts.tolist() if c > first]]
                yield joined(fp, inner)
                held = [fp[inner[-1] :]]
            last = key[-1]
        done = np.concatenate([np.zeros(0, np.uint64), *held])
        yield joined(done, [0, len(done)])

    return dealt.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, hot: int = HOT, most_broadcast: int = 1_000_000) -> DataFrame:
    """a, b: links between the distinct fingerprints fp that connect whatever all links connect."""
    rows, links = distinct.select(F.lit(0).cast("long").alias("bucket"), "fp"), None
    for depth in range(DEPTH):
        masks = [m - (1 << 64) if m >> 63 else m for m in covering_masks(radius, depth=depth)]
        keys = F.array(*[F.xxhash64("bucket", F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks)])
        dealt = rows.select("fp", F.explode(keys).alias("key"))
        large = common.staged(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("key"), "large-buckets")
        n = large.count() if depth + 1 < DEPTH else 0
        large = F.broadcast(large) if n <= most_broadcast else large
        found = _bucket_links(dealt.join(large, "key", "left_anti") if n else dealt, radius)
        links = found if links is None else links.union(found)
        if not n:
            return links
        rows = common.staged(dealt.join(large, "key", "left_semi").select(F.col("key").alias("bucket"), "fp"), "large-bucket-rows")


def grouped(fps: DataFrame) -> DataFrame:
    """fps (doc_id, k1, k2, fp) with component (the least of its fingerprints as longs) and component_id."""
    by_fp = common.staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    common.batches(fps.sparkSession, 10_000)
    parts = common.staged(components(fingerprint_links(by_fp.select("fp"))), "components")
    labelled = by_fp.join(parts, by_fp["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = labelled.join(ids, "component").select(F.col("fp").alias("f"), "component", "component_id")
    return fps.join(ids, fps["fp"] == ids["f"]).drop("f")


def op5_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    fps = common.staged(fingerprints(common.table(spark, sf_dir, "documents")), "simhash")
    return grouped(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """documents, all columns, with one row of each component: the one of least doc_id, then of least text hash."""
    fps = common.staged(fingerprints(documents), "simhash")
    best = grouped(fps).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")).alias("m")).select(F.col("m.doc_id").alias("_d"), F.col("m.k1").alias("_a"), F.col("m.k2").alias("_b"))
    cols = [f"_{i}" for i in range(len(documents.columns))]
    doc_id, text = (F.col(f"_{documents.columns.index(n)}") for n in ("doc_id", "text"))
    k1, k2 = common.content_keys(text)
    rows = documents.toDF(*cols).withColumns({"_k1": k1, "_k2": k2})
    kept = rows.join(best, (F.col("_k1") == F.col("_a")) & (F.col("_k2") == F.col("_b")) & doc_id.cast("long").eqNullSafe(F.col("_d")), "left_semi")
    # Rows of one id and text share all of this key; the one with the least hash of all its columns stays.
    one = Window.partitionBy("_k1", "_k2", doc_id).orderBy(F.xxhash64(*cols))
    return kept.withColumn("_one", F.row_number().over(one)).filter("_one = 1").select(*cols).toDF(*documents.columns)
