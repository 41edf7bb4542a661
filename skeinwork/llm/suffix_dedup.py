"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if a string of WINDOW bytes that covers it also starts in a document with a smaller doc_id. The exact rule is
applied to all data, without one suffix array over all of it:

1. Every window holds a gram of GRAM bytes that is least, by hash, of the window's grams (its anchor). Equal windows have equal anchors
   in equal places, so a window can only repeat where its anchor does. Documents are dealt into blocks by
   content; a block sends each anchor's 48-bit key once to the bucket of that key, which answers with the keys that
   other blocks have too, and with those that are hot: more than HOT anchors have them.
2. For each anchor that occurs in two documents or more, its block takes the bytes that windows over it can cover (the context).
   Equal contexts of one block are settled there: one of the least document speaks for all. It goes to the shard of its key. Contexts
   of a hot key, which may have very many surroundings, do not: their windows are dealt one by one, each to the shard of its own hash, so
   no phrase, however frequent, gathers its documents in one task.
3. A shard sorts its windows: a suffix array of these positions, limited to WINDOW bytes, with its array of longest common prefixes.
   Previous and next smaller values of doc_id in suffix order give each position its longest previous factor
   in a smaller document; WINDOW bytes or more mean that the window goes. Equal contexts are one run of this order, and windows whose
   hash no other window of the shard has are left out of the array, as they have no such factor.
4. Blocks put the windows' bytes together to spans.

Exact copies take part once, with their least doc_id; all others' windows are all repeats. They are left out before any
text is shuffled. Hot passages cost a shard at most one context, or one window, a block. No step holds more than a block, a bucket or a
shard, and their number grows with the data.

Defined results: null text is empty; texts under WINDOW bytes keep all; documents of equal doc_id do not take from each other; null
doc_id is smaller than any other; repeated rows each get a row; a text of any length is one block at least, and read whole; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 50
GRAM = 24
SIDE = WINDOW - GRAM
CONTEXT = WINDOW + SIDE
BLOCK_BYTES = 8 << 20
CHUNK = 1 << 20
#: Contexts whose windows are compared at a time, and windows put in one suffix array.
PART_CONTEXTS = 1 << 13
PART_WINDOWS = 1 << 18
#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = 8 << 20
#: Anchors of one key, in all blocks, above which its windows are dealt one by one; blocks count those above FEW.
HOT = 20_000
FEW = 8
NO_ID = -(1 << 63)


# Anchors.


def _slide(x, width: int, best):
    """best (minimum or maximum) over x[i : i + width], by doubling."""
    done = 1
    while done * 2 <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    return best(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def _gram_hashes(data):
    import numpy as np

    n = len(data) - GRAM + 1
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    with np.errstate(over="ignore"):
        h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += words[8 : 8 + n]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h += words[16 : 16 + n]
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h | np.uint64(1)  # 0 means that there is no gram; keys do without the last bits


def anchors(docs: list[bytes]):
    """(document, place, key) of every anchor, in this order."""
    import numpy as np

    found = []
    group, size = [], 0

    def flush():
        data = b"".join(docs[i][a:b] for i, a, b in group)
        lengths = np.array([b - a for _, a, b in group])
        ends = np.cumsum(lengths)
        h = _gram_hashes(np.frombuffer(data, np.uint8))
        least = _slide(h, WINDOW - GRAM + 1, np.minimum)
        least[np.repeat(ends, lengths)[: len(least)] - np.arange(len(least)) < WINDOW] = 0
        pad = np.zeros(WINDOW - GRAM, np.uint64)
        at = np.flatnonzero((_slide(np.concatenate([pad, least, pad]), WINDOW - GRAM + 1, np.maximum) == h) & (h > 0))
        part = np.searchsorted(ends, at, side="right")
        doc, first = np.array([i for i, _, _ in group]), np.array([a for _, a, _ in group])
        found.append((doc[part], at - (ends - lengths)[part] + first[part], h[at] >> np.uint64(16)))

    for i, d in enumerate(docs):
        # Pieces of a long document share WINDOW - 1 bytes, so each window lies in one of them.
        for a in range(0, max(1, len(d) - WINDOW + 1), CHUNK):
            b = min(len(d), a + CHUNK + WINDOW - 1)
            if b - a >= WINDOW:
                group.append((i, a, b))
                size += b - a
                if size >= CHUNK:
                    flush()
                    group.clear()
                    size = 0
    if group:
        flush()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc, at, key = (np.concatenate(x) for x in zip(*found))
    # An anchor where two pieces of a document meet is found in both.
    keep = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])]) if len(doc) else np.zeros(0, bool)
    order = np.lexsort((at, doc)) if not ((doc[1:] > doc[:-1]) | ((doc[1:] == doc[:-1]) & (at[1:] >= at[:-1]))).all() else None
    if order is not None:
        doc, at, key = doc[order], at[order], key[order]
        keep = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])])
    return doc[keep], at[keep], key[keep]


# Arrays as compressed bytes.


def pack(*arrays) -> bytes:
    import io

    import numpy as np
    import zstandard

    out = io.BytesIO()
    for a in arrays:
        a = np.ascontiguousarray(a)
        np.lib.format.write_array(out, np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T) if a.ndim == 1 and a.dtype.itemsize > 1 else a, allow_pickle=False)
    return zstandard.ZstdCompressor(level=3).compress(out.getvalue())


def unpack(data: bytes, *kinds):
    import io

    import numpy as np
    import zstandard

    src = io.BytesIO(zstandard.ZstdDecompressor().decompress(data))
    out = []
    for k in kinds:
        a = np.lib.format.read_array(src, allow_pickle=False)
        out.append(np.ascontiguousarray(a.T).reshape(-1).view(k) if a.ndim == 2 and np.dtype(k).itemsize > 1 else a)
    return out


def pack_sorted(keys) -> bytes:
    """Sorted 48-bit keys; a few stand as they are, as they are sent in rows of any number."""
    import numpy as np

    if len(keys) < 64:
        return b"\0" + keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return b"\1" + pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes):
    import numpy as np

    if data[:1] == b"\0":
        wide = np.zeros((len(data) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, 6)
        return wide.view("<u8").ravel()
    return np.cumsum(unpack(data[1:], np.uint64)[0], dtype=np.uint64)


# Longest previous factors.


def smaller_before(values, lcp, least: int):
    """For each place in suffix order the common prefix with the nearest place before of smaller value, 0 if that is under least.

    lcp[i] belongs to places i - 1 and i. Pointers jump: what lies between a place and its pointer is never smaller.
    """
    import numpy as np

    to, common_ = np.arange(len(values)) - 1, lcp.copy()
    open_ = np.flatnonzero((to >= 0) & (common_ >= least))
    out = np.zeros(len(values), lcp.dtype)
    while len(open_):
        found = values[to[open_]] < values[open_]
        out[open_[found]] = common_[open_[found]]
        open_ = open_[~found]
        common_[open_] = np.minimum(common_[open_], common_[to[open_]])
        to[open_] = to[to[open_]]
        open_ = open_[(to[open_] >= 0) & (common_[open_] >= least)]
    return out


def longest_previous_factor(strings, values, least: int = WINDOW):
    """For rows of bytes (suffixes up to WINDOW bytes) and values: the longest prefix that each shares with a row of smaller
    value, 0 if that is under least."""
    import numpy as np

    n, width = strings.shape
    if not n:
        return np.zeros(0, np.int16)
    wide = np.zeros((n, (width + 7) // 8 * 8), np.uint8)
    wide[:, :width] = strings
    order = np.lexsort(wide.view(">u8").T[::-1])
    srt, v = strings[order], values[order]
    differ = srt[1:] != srt[:-1]
    lcp = np.zeros(n, np.int16)
    lcp[1:] = np.where(differ.any(1), differ.argmax(1), width)
    before = smaller_before(v, lcp, least)
    after = smaller_before(v[::-1], np.concatenate([[0], lcp[:0:-1]]).astype(np.int16), least)[::-1]
    out = np.empty(n, np.int16)
    out[order] = np.maximum(before, after)
    return out


def _bits():
    import numpy as np

    return np.uint32(1) << np.arange(SIDE + 1, dtype=np.uint32)


def _fits(low, high):
    """Which windows of contexts lie in the text."""
    import numpy as np

    return (np.arange(SIDE + 1) >= low[:, None]) & (np.arange(SIDE + 1) + WINDOW <= high[:, None])


def _all_fit(low, high):
    """The bits of _fits, a number for each context."""
    import numpy as np

    one = np.uint32(1)
    return ((one << np.clip(high.astype(np.int64) - WINDOW + 1, 0, SIDE + 1).astype(np.uint32)) - one) & ~((one << low.astype(np.uint32)) - one)


def _among(x, of):
    """Which of x the sorted array of has."""
    import numpy as np

    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x if len(of) else np.zeros(len(x), bool)


def _window_hashes(rows):
    """64-bit hashes of all windows of contexts."""
    import numpy as np

    rng = np.random.default_rng(3)
    padded = np.hstack([rows, np.zeros((len(rows), 8), np.uint8)])
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8, axis=1)[:, :CONTEXT].copy().view("<u8")[:, :, 0]
    h = np.zeros((len(rows), SIDE + 1), np.uint64)
    with np.errstate(over="ignore"):
        for off in (0, 8, 16, 24, 32, 40, WINDOW - 8):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + eights[:, off : off + SIDE + 1] * np.uint64(int(rng.integers(1, 1 << 62)) * 2 + 1)
    return h


def _twice(hashes):
    """Places, in order, whose hash another place has too."""
    import numpy as np

    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    return np.sort(order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]) if len(order) else order


def windows_gone(strings, hashes, oid):
    """For windows (rows of WINDOW bytes), their hashes and doc_ids: which of them a smaller document has."""
    import numpy as np

    gone = np.zeros(len(oid), bool)
    twice = _twice(hashes)
    for part in _parts(hashes[twice], PART_WINDOWS):
        at = twice[part]
        gone[at] = longest_previous_factor(strings(at), oid[at]) >= WINDOW
    return gone


def repeated_windows(contexts, low, high, oid):
    """For contexts (rows of CONTEXT bytes, of which low to high are text) and doc_ids: bit s says that the window at s goes.

    Equal windows have an anchor of the same gram in the same place, so contexts are compared with those about the same gram only: a few
    grams at a time, and memory does not follow the number of windows."""
    import numpy as np

    out = np.zeros(len(oid), np.uint32)
    gram = np.ascontiguousarray(contexts[:, SIDE : SIDE + GRAM]).view("<u8")
    with np.errstate(over="ignore"):
        h = (gram * np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)).sum(1, dtype=np.uint64)
    del gram
    for part in _parts(h, PART_CONTEXTS):
        out[part] = _repeated_among(contexts[part], low[part], high[part], oid[part])
    return out


def _repeated_among(contexts, low, high, oid):
    """repeated_windows of contexts that hold all those about their grams.

    Equal contexts stand together in suffix order whatever window is looked at, so they are one run: its least document speaks for it, and
    in the others all windows go. A run with no other run about the same gram has no window in common with any."""
    import numpy as np

    n = len(oid)
    whole = np.zeros((n, (CONTEXT + 9) // 8 * 8), np.uint8)
    whole[:, :CONTEXT], whole[:, CONTEXT], whole[:, CONTEXT + 1] = contexts, low, high
    words = whole.view("<u8")
    order = np.lexsort((oid, *words.T[::-1]))
    new = np.concatenate([[True], (words[order][1:] != words[order][:-1]).any(1)])
    run = np.empty(n, np.int64)
    run[order] = np.cumsum(new) - 1
    first = order[new]
    mask = np.zeros(len(first), np.uint32)
    gram = np.ascontiguousarray(contexts[first][:, SIDE : SIDE + GRAM]).view("<u8").reshape(-1, GRAM // 8)
    by = np.lexsort(gram.T)
    apart = (gram[by][1:] != gram[by][:-1]).any(1)
    alone = np.concatenate([[True], apart]) & np.concatenate([apart, [True]])
    among = np.sort(by[~alone])
    if len(among):
        rows = contexts[first[among]]
        row, s = np.nonzero(_fits(low[first[among]], high[first[among]]))
        h = _window_hashes(rows)[row, s]
        windows = np.lib.stride_tricks.sliding_window_view(rows, WINDOW, axis=1)
        gone = windows_gone(lambda at: windows[row[at], s[at]], h, oid[first[among]][row])
        np.bitwise_or.at(mask, among[row[gone]], _bits()[s[gone]])
    out = mask[run]
    later = oid > oid[first][run]
    out[later] = _all_fit(low[later], high[later])
    return out


def removed_bytes(n: int, at, mask):
    """Which of n bytes windows cover that go: those that the bits of mask name, about anchors at these places."""
    import numpy as np

    gone = np.zeros(n, bool)
    for i in range(0, len(at), 1 << 14):
        row, s = np.nonzero(mask[i : i + (1 << 14), None] >> np.arange(SIDE + 1, dtype=np.uint32) & 1)
        gone[at[i : i + (1 << 14)][row].astype(np.int64) - SIDE + s] = True
    done = 1  # starts of windows become windows by doubling
    while done < WINDOW:
        step = min(done, WINDOW - done)
        gone[step:] |= gone[:-step].copy()
        done += step
    return gone


def _parts(h, size: int):
    """Index arrays of about size places each; places of equal h fall in one."""
    import numpy as np

    order = np.argsort(h, kind="stable")
    at = 0
    while at < len(order):
        end = min(len(order), at + size)
        while end < len(order) and h[order[end]] == h[order[end - 1]]:
            end += 1
        yield order[at:end]
        at = end


# Steps.


def _block(table):
    """Documents of a block in a fixed order: least ids, texts and keys, each content once."""
    import numpy as np

    k1, k2, oid = (table.column(n).to_numpy() for n in ("k1", "k2", "oid"))
    text = table.column("text").to_pylist()
    order = np.lexsort((oid, k2, k1))
    ids, texts, keys = [], [], []
    for i in order.tolist():
        if not keys or keys[-1] != (k1[i], k2[i]):
            keys.append((k1[i], k2[i]))
            ids.append(oid[i])
            texts.append(None)
        if texts[-1] is None:
            texts[-1] = text[i]
    return np.array(ids, np.int64), texts, keys


def _split(part, *arrays):
    """(number, arrays' rows of that part) for each part."""
    import numpy as np

    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for at in np.split(order, cuts):
        if len(at):
            yield int(part[at[0]]), *(a[at] for a in arrays)


def _joined(texts: list[bytes]):
    """Texts with SIDE zeros before, between and behind them, and where each starts."""
    import numpy as np

    pad = bytes(SIDE)
    data = np.frombuffer(pad + b"".join(x + pad for x in texts) + bytes(8), np.uint8)
    lengths = np.array([len(x) + SIDE for x in texts], np.int64)
    return data, SIDE + np.cumsum(lengths) - lengths


def _context_hashes(data, at, low, high):
    """Two 64-bit hashes of the contexts of anchors at these places, bounds included."""
    import numpy as np

    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    a = low.astype(np.uint64) << np.uint64(8) | high.astype(np.uint64)
    b = ~a
    with np.errstate(over="ignore"):
        for off in (*range(0, CONTEXT - 8, 8), CONTEXT - 8):
            w = words[at - SIDE + off]
            a = (a ^ (a >> np.uint64(29)) ^ w) * np.uint64(0x9E3779B97F4A7C15)
            b = (b ^ (b >> np.uint64(31)) ^ w) * np.uint64(0xBF58476D1CE4E5B9)
    return a ^ a >> np.uint64(32), b ^ b >> np.uint64(32)


def distinct_texts(documents: DataFrame, blocks: int) -> DataFrame:
    """block, k1, k2, oid, text: a task sends each text once; an id that is less than those before follows without text."""
    import pyarrow as pa

    rows = common.pick(documents, "doc_id", "text")
    rows = rows.select(*common.content_keys(F.col("text")), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("oid"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        sent: dict[tuple[int, int], int] = {}
        for b in batches:
            pick, with_text = [], []
            for i, (a, c, o) in enumerate(zip(*[b.column(n).to_pylist() for n in ("k1", "k2", "oid")])):
                if (least := sent.get((a, c))) is None or o < least:
                    sent[a, c] = o
                    pick.append(i)
                    with_text.append(least is None)
            got = b.take(pa.array(pick, pa.int64()))
            text = pa.array([t if w else None for t, w in zip(got.column("text").to_pylist(), with_text)], pa.binary())
            yield pa.RecordBatch.from_arrays([got.column("k1"), got.column("k2"), got.column("oid"), text], ["k1", "k2", "oid", "text"])

    return rows.mapInArrow(run, "k1 long, k2 long, oid long, text binary").withColumn("block", F.pmod("k1", F.lit(blocks)).cast("int"))


def repeated_spans(documents: DataFrame, block_bytes: int = BLOCK_BYTES, hot_anchors: int = HOT) -> DataFrame:
    """k1, k2 (hashes of the text), oid (least doc_id), n_bytes, spans (removed bytes), kept_sha256: a row for each distinct text."""
    import numpy as np
    import pyarrow as pa

    common.batches(documents.sparkSession, size=BATCH_BYTES)
    total = common.pick(documents, "text").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(8, total // block_bytes)
    docs = distinct_texts(documents, blocks)

    def table(rows, schema):
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    buckets = max(8, blocks // 8)
    bucket_of = lambda key, n: (key % np.uint64(n)).astype(np.int64)

    def keys_of_block(t):
        _, texts, _ = _block(t)
        keys, n = np.unique(anchors(texts)[2], return_counts=True)
        block = t.column("block")[0].as_py()
        rows = []
        for b, k, m in _split(bucket_of(keys, buckets), keys, n):
            often = np.flatnonzero(m > FEW)
            rows.append((b, block, pack_sorted(k), pack(often.astype(np.uint32), m[often].astype(np.uint32)) if len(often) else None))
        return table(rows, pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("often", pa.binary())]))

    def shared_keys(t):
        """Back to each block: which of its keys other blocks have too, and which of these are hot."""
        own = t.column("block").to_pylist()
        keys = [unpack_sorted(k) for k in t.column("keys").to_pylist()]
        every, times = np.unique(np.concatenate(keys), return_counts=True)
        total = times.astype(np.int64)
        for k, often in zip(keys, t.column("often").to_pylist()):
            if often is not None:
                at, n = unpack(often, np.uint32, np.uint32)
                total[np.searchsorted(every, k[at])] += n.astype(np.int64) - 1
        shared = times > 1
        often, hot = every[shared], every[shared & (total > hot_anchors)]
        mine = lambda k, x: k[_among(k, x)]
        return table([(b, pack_sorted(x), pack_sorted(mine(k, hot))) for b, k in zip(own, keys) if len(x := mine(k, often))], pa.schema([("block", pa.int32()), ("keys", pa.binary()), ("hot", pa.binary())]))

    def contexts_of_block(t, shared):
        out = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.int32()), ("data", pa.binary())])
        if not len(t):
            return table([], out)
        ids, texts, _ = _block(t)
        block = t.column("block")[0].as_py()
        doc, at, key = anchors(texts)
        told = lambda n: np.concatenate([unpack_sorted(k) for k in shared.column(n).to_pylist()] or [np.zeros(0, np.uint64)])
        elsewhere, hot = told("keys"), told("hot")
        order = np.lexsort((doc, key))
        k, d = key[order], doc[order]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(k)))
        several = d[start] != d[start + size - 1] if len(k) else np.zeros(0, bool)
        take = np.empty(len(k), bool)
        take[order] = np.repeat(several, size)
        take |= np.isin(key, elsewhere)
        doc, at, key = doc[take], at[take], key[take]
        if not len(doc):
            return table([], out)
        lengths = np.array([len(x) for x in texts])
        low, high = np.maximum(0, SIDE - at).astype(np.uint8), np.minimum(CONTEXT, SIDE + lengths[doc] - at).astype(np.uint8)
        data, first_of = _joined(texts)
        place = first_of[doc] + at
        h = [_context_hashes(data, place[i : i + (1 << 18)], low[i : i + (1 << 18)], high[i : i + (1 << 18)]) for i in range(0, len(doc), 1 << 18)]
        h1, h2 = (np.concatenate(x) for x in zip(*h))
        oid = ids[doc]
        # Equal contexts: one of the least document speaks for all; those of later documents are repeats, whatever other blocks have.
        order = np.lexsort((oid, h2, h1))
        new = np.concatenate([[True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])])
        speaker = np.empty(len(doc), np.int64)
        speaker[order] = order[new][np.cumsum(new) - 1]
        later, twin = oid > oid[speaker], np.flatnonzero((oid == oid[speaker]) & (speaker != np.arange(len(doc))))
        u32 = lambda x: x.astype(np.uint32)
        made = [(1, 0, block, pack(u32(doc[later]), u32(at[later]), _all_fit(low[later], high[later])))] if later.any() else []
        if len(twin):
            made.append((3, 0, block, pack(u32(doc[speaker[twin]]), u32(at[speaker[twin]]), u32(doc[twin]), u32(at[twin]))))
        rest = order[new]
        cold = ~np.isin(key[rest], hot)
        around = np.lib.stride_tricks.sliding_window_view(data, CONTEXT)
        rows_of = lambda x: around[place[x] - SIDE]
        for s, x in _split(bucket_of(key[rest[cold]], blocks), rest[cold]):
            made.append((0, s, block, pack(oid[x], u32(doc[x]), u32(at[x]), low[x], high[x], rows_of(x))))
        rest = rest[~cold]
        for i in range(0, len(rest), 1 << 14):
            x = rest[i : i + (1 << 14)]
            rows = rows_of(x)
            row, s = np.nonzero(_fits(low[x], high[x]))
            h, windows = _window_hashes(rows)[row, s], np.lib.stride_tricks.sliding_window_view(rows, WINDOW, axis=1)
            # Of equal windows those of the least document go on; the others are repeats.
            order = np.lexsort((oid[x[row]], h))
            new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
            least = np.empty(len(h), np.int64)
            least[order] = order[new][np.cumsum(new) - 1]
            gone = (oid[x[row]] > oid[x[row[least]]]) & (windows[row, s] == windows[row[least], s[least]]).all(1)
            if gone.any():
                made.append((1, 0, block, pack(u32(doc[x[row[gone]]]), u32(at[x[row[gone]]]), _bits()[s[gone]])))
            row, s, h = row[~gone], s[~gone], h[~gone]
            for shard, r, w, hashes in _split(bucket_of(h, blocks), row, s, h):
                made.append((2, shard, block, pack(oid[x[r]], u32(doc[x[r]]), u32(at[x[r]]), w.astype(np.uint8), hashes, windows[r, w])))
        return table(made, out)

    def repeats_of_shard(t):
        own, kind = t.column("block").to_numpy(), t.column("kind").to_numpy()
        packed = t.column("data").to_pylist()
        answers = []

        def collected(k, *kinds, keep=lambda rows: rows):
            parts = [keep(unpack(packed[i], *kinds)) for i in np.flatnonzero(kind == k)]
            return np.repeat(own[kind == k], [len(p[0]) for p in parts]), *(np.concatenate(x) for x in zip(*parts))

        if (kind == 0).any():
            block, oid, doc, at, low, high, rows = collected(0, np.int64, np.uint32, np.uint32, np.uint8, np.uint8, np.uint8)
            answers.append((block, doc, at, repeated_windows(rows, low, high, oid)))
            del rows
        if (kind == 2).any():
            # Hashes are read first: windows whose hash comes once stay, and their bytes are never held together.
            of_window = (np.int64, np.uint32, np.uint32, np.uint8, np.uint64, np.uint8)
            hashes = collected(2, *of_window, keep=lambda x: x[4:5])[1]
            often = np.unique(hashes[_twice(hashes)])
            block, oid, doc, at, s, h, windows = collected(2, *of_window, keep=lambda x: [a[on] for on in [_among(x[4], often)] for a in x])
            answers.append((block, doc, at, np.where(windows_gone(lambda x: windows[x], h, oid), _bits()[s], np.uint32(0))))
        block, doc, at, mask = (np.concatenate(x) for x in zip(*answers))
        on = mask > 0
        return table([(2, b, pack(d, a, m)) for b, d, a, m in _split(block[on], doc[on], at[on], mask[on])], pa.schema([("kind", pa.int32()), ("block", pa.int32()), ("data", pa.binary())]))

    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def spans_of_block(t, found):
        out = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("oid", pa.int64()), ("n_bytes", pa.int64()), ("spans", spans_type), ("kept_sha256", pa.string())])
        if not len(t):
            return table([], out)
        ids, texts, keys = _block(t)
        hits = {}
        told = list(zip(found.column("kind").to_pylist(), found.column("data").to_pylist()))
        if parts := [unpack(d, np.uint32, np.uint32, np.uint32) for k, d in told if k != 3]:
            doc, at, mask = (np.concatenate(x) for x in zip(*parts))
            for d in [d for k, d in told if k == 3]:  # what goes at a speaker goes at its twins
                other_doc, other_at, twin_doc, twin_at = unpack(d, *[np.uint32] * 4)
                name = lambda d, a: d.astype(np.uint64) << np.uint64(32) | a
                speaker, which = np.unique(name(doc, at), return_inverse=True)
                whole = np.zeros(len(speaker), np.uint32)
                np.bitwise_or.at(whole, which, mask)
                asked = name(other_doc, other_at)
                spot = np.minimum(np.searchsorted(speaker, asked), len(speaker) - 1)
                on = speaker[spot] == asked
                doc, at, mask = np.concatenate([doc, twin_doc[on]]), np.concatenate([at, twin_at[on]]), np.concatenate([mask, whole[spot[on]]])
            hits = {d: (a, m) for d, a, m in _split(doc, at, mask)}
        made = []
        for i, (o, text, (k1, k2)) in enumerate(zip(ids.tolist(), texts, keys)):
            spans, kept = [], text
            if i in hits:
                at, mask = hits[i]
                gone = np.concatenate([[False], removed_bytes(len(text), at, mask), [False]])
                edge = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
                spans = [{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2])]
                kept = np.frombuffer(text, np.uint8)[~gone[1:-1]].tobytes()
            made.append((int(k1), int(k2), o, len(text), spans, hashlib.sha256(kept).hexdigest()))
        return table(made, out)

    keys = docs.groupBy("block").applyInArrow(keys_of_block, "bucket int, block int, keys binary, often binary")
    shared = keys.groupBy("bucket").applyInArrow(shared_keys, "block int, keys binary, hot binary")
    contexts = docs.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(contexts_of_block, "kind int, shard int, block int, data binary")
    contexts = common.staged(contexts, "contexts")
    asked = contexts.filter("kind in (0, 2)").select("shard", "kind", "block", "data")
    found = asked.groupBy("shard").applyInArrow(repeats_of_shard, "kind int, block int, data binary").union(contexts.filter("kind in (1, 3)").select("kind", "block", "data"))
    return docs.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(spans_of_block, "k1 long, k2 long, oid long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string")


def remove_repeats(documents: DataFrame, block_bytes: int = BLOCK_BYTES, hot_anchors: int = HOT) -> DataFrame:
    """doc_id, n_bytes, spans (of removed bytes), kept_sha256 for each row of documents."""
    spans = repeated_spans(documents, block_bytes, hot_anchors)
    rows = common.pick(documents, "doc_id", "text")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(n) for c, n in zip(common.content_keys(F.col("text")), ("a1", "a2"))])
    joined = rows.join(spans, (F.col("a1") == F.col("k1")) & (F.col("a2") == F.col("k2")))
    copy = (F.coalesce("doc_id", F.lit(NO_ID)) > F.col("oid")) & (F.col("n_bytes") >= WINDOW)
    every = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return joined.select("doc_id", "n_bytes", F.when(copy, every).otherwise(F.col("spans")).alias("spans"), F.when(copy, F.lit(hashlib.sha256().hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    rows = remove_repeats(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
