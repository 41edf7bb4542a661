"""Best-fit packing of token sequences, certified by lower bounds.

Documents are encoded where they lie; only those longer than a sequence are cut, from the end, so their first piece may be shorter. A whole piece is a sequence by itself.
All others, rows of a few numbers, are dealt by a seeded hash to partitions of about ITEMS pieces, and each partition is packed best-fit decreasing. How many
sequences a partition needs at least is computed from its counts by length with dual-feasible functions (Fekete and Schepers, 2001: identity,
the rounding functions u(k), the threshold functions U and the step functions phi): whatever fits in one sequence has images that sum to at most 1, so the sum
of all images, rounded up, bounds the number of sequences.

A partition with as many sequences as its bound is certified: it closes all of them but the emptiest. One with a gap closes its full ones only. The documents of
what stays open are exchanged: dealt anew, by another seed, to fewer partitions, and packed and certified again. What comes of it is taken if it has
fewer sequences than before, and so on, until nothing is gained or one certified partition is left. A sequence is named by the row number of its first piece.

Only counts of partitions and sequences come to the driver. A partition's pieces (48 bytes each) are one task's memory, and so is a document's ids.

Defined results: null text is empty and has the end id only; rows of one doc_id, and repeated rows, are documents of their own; ties between pieces of a length, and between sequences with equal room, go
by row number, so a result depends on how the table is split, its counts hardly; a text of any length is encoded whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .token_output import encoder

CAPACITY = 1024
ITEMS = 1 << 15
ROUNDS = 8
END_ID = 2
_PIECE = "row long, doc_id long, piece int, start long, length int, ids_crc32 long"
_PACKED = f"{_PIECE}, sequence_id long, offset int, open boolean, part int, sequences long, bound long"


# Pieces.


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = END_ID, want_ids: bool = False) -> DataFrame:
    """A staged row for each piece: row (unique), doc_id, piece, start, length, ids_crc32, and its ids as little-endian 32-bit integers if asked for."""
    import pyarrow as pa

    common.batches(documents.sparkSession, 256)
    rows = common.pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches):
        for b in batches:
            out = []
            for d, x in zip(b.column("doc_id").to_pylist(), encoder(tokenizer).encode_batch(b.column("text").to_pylist())):
                ids = x + tail
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + n)]
                    out.append((d, k, start, n, zlib.crc32(part), part if want_ids else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, schema.types)], schema=schema)

    made = rows.mapInArrow(run, "doc_id long, piece int, start long, length int, ids_crc32 long, ids binary")
    return common.staged((made if want_ids else made.drop("ids")).withColumn("row", F.monotonically_increasing_id()), "pieces")


# Bounds.


@functools.lru_cache(4)
def dual_feasible(capacity: int):
    """Numerators (a row for each function, a column for each length from 0) and denominators."""
    import numpy as np

    w = np.arange(capacity + 1)
    top, bottom = [w], [capacity]
    for k in range(1, 33):  # u(k): lengths that are no multiple of capacity / (k + 1) are rounded down to multiples of 1 / k
        whole = (k + 1) * w % capacity == 0
        top.append(np.where(whole, w * k, (k + 1) * w // capacity * capacity))
        bottom.append(k * capacity)
    for e in range(1, capacity // 2 + 1):
        top.append(np.where(w > capacity - e, capacity, np.where(w < e, 0, w)))  # U(e): what is below e is nothing, what leaves less than e is all
        bottom.append(capacity)
        steps = capacity // e  # phi(e): steps of e, from below up to a half and from above beyond it
        top.append(np.where(2 * w > capacity, 2 * (steps - (capacity - w) // e), np.where(2 * w == capacity, steps, 2 * (w // e))))
        bottom.append(2 * steps)
    return np.array(top, np.int64), np.array(bottom, np.int64)


def least_sequences(counts, capacity: int = CAPACITY) -> int:
    """A lower bound of the sequences that so many pieces of each length (from 0) need."""
    top, bottom = dual_feasible(capacity)
    return max(-(-int(t) // int(b)) for t, b in zip(top @ counts, bottom))


# Packing.


def best_fit_decreasing(lengths, capacity: int = CAPACITY) -> tuple[list[int], list[int], list[int]]:
    """For lengths in descending order: sequence and offset of each, and the room left in each sequence."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences by the room they have left
    some, left, where, offset = 0, [], [], []  # some: a bit for each room that some sequence has
    for n in lengths:
        if fits := some >> n:
            room = n + (fits & -fits).bit_length() - 1
            s = rooms[room].pop()
            if not rooms[room]:
                some ^= 1 << room
        else:
            room, s = capacity, len(left)
            left.append(capacity)
        where.append(s)
        offset.append(capacity - room)
        left[s] = room - n
        if left[s]:
            rooms[left[s]].append(s)
            some |= 1 << left[s]
    return where, offset, left


def _packed(rows: DataFrame, parts: int, seed: int, capacity: int) -> DataFrame:
    """Pieces (_PIECE) dealt to partitions, packed and certified, as a staged table."""
    import pyarrow as pa

    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        table = table.combine_chunks()
        row, length = (table.column(n).to_numpy() for n in ("row", "length"))
        table = table.take(pa.array(order := np.lexsort((row, -length))))
        row, length = row[order], length[order]
        where, offset, left = best_fit_decreasing(length.tolist(), capacity)
        where, left = np.array(where), np.array(left)
        first = row[np.unique(where, return_index=True)[1]]  # of each sequence, as numbered
        bound = least_sequences(np.bincount(length, minlength=capacity + 1), capacity)
        open_ = left > 0 if len(left) > bound else np.arange(len(left)) == left.argmax()
        made = [table.column(n) for n in names] + [pa.array(first[where]), pa.array(offset, pa.int32()), pa.array(open_[where])]
        same = lambda x, t: pa.array(np.full(len(row), x), t)
        made += [table.column("part"), same(len(left), pa.int64()), same(bound, pa.int64())]
        return pa.table(made, [*names, "sequence_id", "offset", "open", "part", "sequences", "bound"])

    dealt = rows.select(*names, F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(parts)).cast("int").alias("part"))
    return common.staged(dealt.groupBy("part").applyInArrow(run, _PACKED), f"packed-{seed}")


def pack(some: DataFrame, capacity: int = CAPACITY, items: int = ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """Each row of pieces() with sequence_id and offset; part, sequences and bound are of the partition that closed its sequence (null for whole pieces)."""
    rows = some.drop("ids")
    n = rows.filter(F.col("length") < capacity).count()
    whole = rows.filter(F.col("length") >= capacity).select(*[F.col(x.split()[0]) for x in _PIECE.split(", ")], F.col("row").alias("sequence_id"), F.lit(0).alias("offset"), *[F.lit(None).cast(t).alias(c) for c, t in (("part", "int"), ("sequences", "long"), ("bound", "long"))])
    if not n:
        return whole
    parts, seed, closed = math.ceil(n / items), 0, [whole]
    now = _packed(rows.filter(F.col("length") < capacity), parts, seed, capacity)
    while True:
        loose = now.filter("open")
        # Rows and sequences that stay open, and whether all partitions are certified.
        n, before, gap = now.agg(F.count_if("open"), F.count_if(F.col("open") & (F.col("offset") == 0)), F.max(F.col("sequences") - F.col("bound"))).first()
        if seed == rounds or (parts == 1 and not gap) or not n:
            break
        parts, seed = math.ceil(n / items), seed + 1
        again = _packed(loose, parts, seed, capacity)
        if again.filter("offset = 0").count() >= before:
            break
        closed.append(now.filter("not open").drop("open"))
        now = again
    return functools.reduce(DataFrame.unionByName, [*closed, now.drop("open")])


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """Sequences of a packing, and how many its pieces need at least."""
    import numpy as np

    counts = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return packed.filter(F.col("offset") == 0).count(), least_sequences(counts, capacity)


def sequences(some: DataFrame, packed: DataFrame) -> DataFrame:
    """sequence_id, ids and doc_ids (one for each piece) of each sequence, from pieces with their ids; a sequence is at most CAPACITY ids."""
    import pyarrow as pa

    each = packed.select("row", "sequence_id", "offset").join(some.select("row", "doc_id", "ids"), "row")
    rows = each.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("x"))

    def run(batches):
        import numpy as np

        for b in batches:
            ids = [np.frombuffer(b"".join(y["ids"] for y in x), "<u4") for x in b.column("x").to_pylist()]
            docs = [[y["doc_id"] for y in x] for x in b.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("sequence_id"), pa.array(ids, pa.list_(pa.int64())), pa.array(docs, pa.list_(pa.int64()))], ["sequence_id", "ids", "doc_ids"])

    return rows.mapInArrow(run, "sequence_id long, ids array<long>, doc_ids array<long>")


def op11_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    some = pieces(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pack(some).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))
