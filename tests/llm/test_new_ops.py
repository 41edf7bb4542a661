"""Packing, prefix tries and clustering against brute force, and their defined results for odd rows."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.llm import centroid_clustering, common, packing, prefix_trie

from test_ops import frame, from_spark, from_sql, some_documents

# 11


@pytest.mark.parametrize("capacity", [9, 12])
def test_dual_feasible_functions_bound_what_fits(capacity):
    top, bottom = packing.dual_feasible(capacity)
    assert top.min() >= 0 and (top[:, -1] == bottom).all()

    def fits(most, room):
        yield []
        for n in range(min(most, room), 0, -1):
            for rest in fits(n, room - n):
                yield [n, *rest]

    for some in fits(capacity, capacity):
        assert (top[:, some].sum(1) <= bottom).all(), some


def test_bounds_and_packings_against_all_partitions():
    rng = random.Random(4)

    def fewest(lengths, capacity):
        best = len(lengths)

        def place(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(lengths):
                best = len(rooms)
                return
            for r in {*rooms}:
                if r >= lengths[i]:
                    k = rooms.index(r)
                    place(i + 1, [*rooms[:k], r - lengths[i], *rooms[k + 1 :]])
            place(i + 1, [*rooms, capacity - lengths[i]])

        place(0, [])
        return best

    certified = 0
    for _ in range(150):
        capacity = rng.choice([10, 17, 24])
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        where, offset, left = packing.best_fit_decreasing(lengths, capacity)
        bound = packing.least_sequences(np.bincount(lengths, minlength=capacity + 1), capacity)
        assert bound <= fewest(lengths, capacity) <= len(left)
        certified += bound == len(left)
        for s in range(len(left)):
            own = sorted((o, n) for w, o, n in zip(where, offset, lengths) if w == s)
            assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1] and sum(n for _, n in own) == capacity - left[s]
    assert certified > 120


def encoded(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    return path, [(i, [*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID]) for i, t, _, _ in rows]


@pytest.mark.parametrize("capacity,items", [(64, 1 << 15), (64, 40), (1024, 20)])
def test_packing(spark, capacity, items):
    rows = some_documents(3, 200) + [(900, "long " * 5000, "en", "s1")] + [(901, "same words here", "en", "s2")] * 30
    path, want = encoded(rows)
    some = packing.pieces(frame(spark, rows), path, capacity, want_ids=True)
    packed = common.staged(packing.pack(some, capacity, items), "packed-test")
    got = packed.collect()
    pieces = Counter()
    for i, ids in want:
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        for k, s in enumerate([0, *range(first, len(ids), capacity)]):
            part = ids[s : first if k == 0 else s + capacity]
            pieces[i, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"], r["doc_id"], r["ids_crc32"]))
    for own in by.values():
        own.sort()
        assert [o for o, *_ in own] == [0, *itertools.accumulate(n for _, n, *_ in own)][:-1] and sum(n for _, n, *_ in own) <= capacity
    count, bound = packing.certificate(packed, capacity)
    assert count == len(by) and bound >= sum(len(ids) for _, ids in want) / capacity
    assert count <= bound * 1.02 + 2, (count, bound)
    for r in packing.sequences(some, packed).collect():
        own = by[r["sequence_id"]]
        assert [d for *_, d, _ in own] == r["doc_ids"] and [zlib.crc32(np.array(r["ids"][o : o + n], "<u4").tobytes()) for o, n, *_ in own] == [c for *_, c in own]


def test_exchange_takes_fewer_sequences(spark):
    rng = random.Random(8)
    lengths = [rng.choice([130, 200, 340, 345, 500]) for _ in range(3000)]
    rows = [(i, i, 0, 0, n, 0) for i, n in enumerate(lengths)]
    some = spark.createDataFrame([(*r, None) for r in rows], packing._PIECE + ", ids binary")
    alone = packing.certificate(packing.pack(some, items=100, rounds=0))
    exchanged = packing.certificate(packing.pack(some, items=100))
    assert exchanged[1] == alone[1] <= exchanged[0] < alone[0]


def test_packing_without_rows(spark):
    path, _ = encoded([])
    none = packing.pieces(frame(spark, some_documents(0, 5)).limit(0), path, want_ids=True)
    assert packing.pack(none).count() == 0 and packing.sequences(none, packing.pack(none)).count() == 0
    one = packing.pieces(frame(spark, [(None, None, None, None)]), path)
    assert [(r["doc_id"], r["length"], r["offset"]) for r in packing.pack(one).collect()] == [(None, 1, 0)]


# 12


CONVERSATIONS = ["conv_id", "turn", "role", "text"]


def some_conversations(seed=0):
    rng = random.Random(seed)
    out = []
    for c in [*range(0, 130), 500, 519, 100_000]:
        if c % 7 == 3:
            continue
        shape = rng.random()
        n = 0 if shape < 0.05 else 120 if c == 24 else rng.randint(1, 6)
        for t in range(n):
            out.append((c, t, rng.choice(["user", "assistant"]) if c % 3 else ("user", "assistant")[t % 2], rng.choice(["hello there", "hello", "a\tb c", "", "é 日"]) if t < 4 else f"turn {t}"))
    out += [(600 + i, t, "user", "the same again") for i in range(60) for t in range(3)]
    return [*out, (5, None, None, None), (5, 2, "user", None), (5, 2, "user", ""), (7, 1, None, "x"), (None, 0, "user", "nobody's"), (40, 1, "user", "long " * 4000)]


def chats(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
    return df.select("*", F.lit(1).alias("depth"), F.lit("x").alias("Text"), F.lit(0).alias("n"))


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, x) for *_, r, _, x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    words = lambda p: len(p[-1][1].encode().split()) if p else 0
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * words(p)
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if full[c] == p).encode()).hexdigest()
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items()), full


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("shard,parts", [(1 << 16, 3), (40, 7), (2, 1)])
def test_prefix_nodes(spark, monkeypatch, shard, parts):
    rows = some_conversations()
    want, _ = brute_trie(rows)
    monkeypatch.setattr(prefix_trie.distinct_ends, "__defaults__", (7,))
    if parts == 7:
        monkeypatch.setattr(prefix_trie, "MOST_BROADCAST", 0)
    nodes, _ = prefix_trie.prefix_nodes(chats(spark, rows, parts), shard)
    assert Counter(tuple(r[c] for c in NODE) for r in nodes.collect()) == want


def test_prefix_nodes_are_those_of_sql(spark):
    rows = [r for r in some_conversations(2) if r[3] is None or len(r[3]) < 1000]
    got = prefix_trie.prefix_nodes(chats(spark, rows))[0]
    assert from_spark(got) == from_sql(prefix_trie.ORACLE_SQL, conversations=(CONVERSATIONS, rows))


def test_prefix_nodes_without_rows(spark):
    assert prefix_trie.prefix_nodes(chats(spark, some_conversations()).limit(0))[0].count() == 0
    only = prefix_trie.prefix_nodes(chats(spark, [(25, 0, "user", "taken by the head")]))[0].collect()
    assert [(r["depth"], r["n_convs"], r["n_leaves"]) for r in only] == [(0, 1, 1)] if zlib.crc32(b"25") % 4 else len(only) == 2


def test_tries_are_walked_by_their_bits(spark):
    rows = some_conversations(4)
    _, full = brute_trie(rows)
    _, tries = prefix_trie.prefix_nodes(chats(spark, rows))
    hashes = {(r["role"], r["text"]): (r["k1"], r["k2"]) for r in spark.createDataFrame([(r or "", x or "") for _, _, r, x in rows], "role string, text string").distinct().select("role", "text", F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(1), "role", "text").alias("k2")).collect()}
    ((trie, labels),) = [(prefix_trie.Trie(t["louds"], t["nodes"]), t) for t in tries.collect()]
    assert len(trie.parent) == len({p[:d] for p in full.values() for d in range(len(p) + 1)})
    for turns in full.values():
        node = prefix_trie.find(trie, labels, [hashes[x] for x in turns])
        assert node is not None and (node == 0 or labels["depth"][node - 1] == len(turns))
        assert prefix_trie.find(trie, labels, [*[hashes[x] for x in turns], (1, 2)]) is None


def test_running_values_cross_tasks(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.randint(-9, 9), rng.getrandbits(62)) for g, n in ((1, 3), (2, 400), (3, 1), (4, 90), (9, 2)) for i in range(n)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "g long, i long, s long, x long")
    got = {(r["g"], r["i"]): (r["s"], r["x"]) for r in prefix_trie.running(df.repartition(5), "g", ["i"], ["g", "i"], ["s"], ["x"]).collect()}
    want, last = {}, {}
    for g, i, s, x in rows:
        a, b = last.get(g, (0, 0))
        want[g, i] = last[g] = (a + s, b ^ x)
    assert got == want


# 13


def vectors(spark, rows, parts=3, clashing=True):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)
    return df if not clashing else df.select("*", F.lit(1).alias("cluster"), F.lit("x").alias("v"), F.lit(0).alias("Vec_id"))


def some_vectors(seed=0, n=400, width=64):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(9, width))
    rows = [(i, (at[i % 9] + rng.normal(size=width) * 0.1).tolist()) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [None] * width), (n + 3, [float("nan")] * width), (n + 4, [float("inf")] + [0.0] * (width - 1)), (n + 5, [1.0] * (width + 1))]
    return rows + [(None, [0.5] * width), (7, rows[7][1]), (7, rows[8][1])] + [(n + 9, rows[3][1])] * 20


SHOWN = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute_clusters(rows, clusters=16, rounds=3, scale=64):
    kept = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    centroids = [v for _, v in sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:clusters]]
    for k in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if k < rounds:
            for j in range(len(centroids)):
                if own := [v for (_, v), (_, x) in zip(kept, near) if x == j]:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    inertia = Counter()
    for d, j in near:
        inertia[j] += d
    return Counter((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, near))


@pytest.mark.parametrize("exact", [1 << 22, 0])
def test_clusters(spark, tmp_path, monkeypatch, exact):
    rows = some_vectors()
    monkeypatch.setattr(centroid_clustering, "EXACT", exact)
    vectors(spark, rows, clashing=False).write.parquet(f"{tmp_path}/embeddings.parquet", mode="overwrite")
    got = Counter(tuple(r[c] for c in SHOWN) for r in centroid_clustering.op13_centroid_clustering(spark, str(tmp_path)).collect())
    assert got == brute_clusters(rows)


def test_clusters_are_those_of_sql(spark, tmp_path):
    rows = [r for r in some_vectors(5, 120) if r[1] is None or None not in r[1]]
    vectors(spark, rows, clashing=False).write.parquet(f"{tmp_path}/embeddings.parquet", mode="overwrite")
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT vec_id, embedding FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = c.execute(centroid_clustering.ORACLE_SQL)
    names = [x[0] for x in found.description]
    want = Counter(tuple(r[names.index(n)] for n in SHOWN) for r in found.fetchall())
    assert Counter(tuple(r[n] for n in SHOWN) for r in centroid_clustering.op13_centroid_clustering(spark, str(tmp_path)).collect()) == want


def test_bounds_spare_scans_and_hold(spark):
    rows = [r for r in some_vectors(2, 900) if r[0] is not None]
    scans: list[int] = []
    states, centroids = centroid_clustering.clustered(vectors(spark, rows), clusters=9, rounds=8, scans=scans)
    assert scans[0] == states.count() and scans[-1] < scans[0] / 4
    for r in states.collect():
        d = sorted((sum((a - b) ** 2 for a, b in zip(r["v"], c)), j) for j, c in enumerate(centroids))
        assert r["cluster"] == d[0][1] and r["distance"] == d[0][0]
        assert r["upper"] >= d[0][0] ** 0.5 and r["lower"] <= d[1][0] ** 0.5


def test_few_and_no_vectors(spark):
    states, centroids = centroid_clustering.clustered(vectors(spark, [(1, [0.1] * 64), (2, [0.2] * 64)]))
    assert sorted((r["vec_id"], r["distance"]) for r in states.collect()) == [(1, 0), (2, 0)] and len(centroids) == 2
    none = vectors(spark, some_vectors()).limit(0)
    assert centroid_clustering.clustered(none)[0].count() == 0
    with pytest.raises(Exception, match="too large"):
        centroid_clustering.clustered(vectors(spark, [(1, [3e30] * 64)]))
