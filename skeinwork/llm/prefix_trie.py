"""The trie of conversation prefixes: what a cache of shared prefixes holds, and what it saves.

A node is a distinct sequence of first turns (role and text), known by a key of 128 bits: the exclusive or of a hash of each turn and its place. Such keys compose,
so they are running values along a conversation that is dealt to any number of tasks (running()), as are the places of turns and the sums
over a long path. Texts are hashed and counted where they lie; nothing but numbers is shuffled.

Conversations with equal turns are one sequence with a count. A prefix whose subtree has more than SHARD turns is heavy; the heavy prefixes are the upper levels of the trie. What is
below them is dealt to shards of about SHARD turns, by the first prefix on each path that is not heavy. A task builds the trie of a shard in
numpy, in level order: a LOUDS bit vector (for each node a 1 a child, then a 0; node 0 stands above the shard's prefixes), and label arrays beside it. Counts come up by reverse
breadth-first order: the nodes of a level are added to their parents with add.at, from the deepest up. Members, children, leaves and saved tokens of heavy prefixes are merged
separately, by aggregations over the paths of one member for each subtree.

Hashes of members' ids: ids are dealt by ranges of (node, id), so one node's may lie in many tasks; what is all in one task is hashed there, and the others' ids
come to one task as blocks of text, in order, as SHA-256 needs them one after the other; it keeps a block. A conversation with a third of all rows is dealt
to as many tasks as its rows are worth, and so is a sequence that a third of all conversations have.

Defined results: null text and null role are empty; turns stand by turn (null first), then role, then text; rows with null conv_id belong to no conversation;
repeated rows are turns of their own; c % 20 has the sign of c; an empty table has no nodes; a text of any length is hashed whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHARD = 1 << 16
GROUP = 20
HEADS = 4
BLOCK = 1 << 16
#: Tables of up to so many heavy prefixes, of numbers only, are broadcast.
MOST_BROADCAST = 200_000
_EMPTY = hashlib.sha256(b"").hexdigest()


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


# Running values.


def running(rows: DataFrame, group: str, order: list, keep: list[str], sums: list[str] = (), xors: list[str] = ()) -> DataFrame:
    """The columns keep, sums and xors (long) of rows, where a value of sums and xors is that of all rows of its group up to it, in this order.

    Rows are sorted by ranges of (group, order), and those of equal order dealt at random, so a group may lie in many tasks. A task starts from zero and marks the rows of
    the group it starts with; what the tasks before have of that group is added after, from a table with a row a task. group is not null.
    """
    import pyarrow as pa
    from pyspark.sql.types import BooleanType, StructField, StructType

    spark, values = rows.sparkSession, [*sums, *xors]
    columns = [*keep, *values]
    rows = rows.withColumn("_salt", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(group, *order, "_salt").sortWithinPartitions(group, *order, "_salt").select(*columns, F.spark_partition_id().alias("_part"))
    common.batches(spark, 50_000)

    def run(batches):
        import numpy as np

        first, last, carry, held = None, None, {}, None
        for b in batches:
            if not len(b):
                continue
            if held:
                yield pa.RecordBatch.from_arrays(*held)
            key, at = b.column(group).to_numpy(), np.zeros(len(b), bool)
            at[0], first = first is None, key[0] if first is None else first
            new = np.concatenate([[True], key[1:] != key[:-1]])
            starts = np.flatnonzero(new)
            segment = np.cumsum(new) - 1
            out = [*map(b.column, keep)]
            for v in values:
                x = b.column(v).to_numpy()
                total = np.cumsum(x) if v in sums else np.bitwise_xor.accumulate(x)
                before = np.where(starts > 0, total[starts - 1], 0)
                if key[0] == last:
                    before[0] = -carry[v] if v in sums else carry[v]
                own = total - before[segment] if v in sums else total ^ before[segment]
                carry[v] = own[-1]
                out.append(pa.array(own))
            last = key[-1]
            held = ([*out, b.column("_part"), pa.array(key == first), pa.array(at), pa.array(np.zeros(len(b), bool))], [*columns, "_part", "_first", "_head", "_last"])
        if held:
            held[0][-1] = pa.array(np.arange(len(key)) == len(key) - 1)
            yield pa.RecordBatch.from_arrays(*held)

    schema = StructType([*rows.schema.fields, *(StructField(c, BooleanType()) for c in ("_first", "_head", "_last"))])
    made = common.staged(rows.mapInArrow(run, schema), "running")
    # The first and the last row of each task.
    before, carried = None, []
    for r in sorted(made.filter("_head or _last").collect(), key=lambda r: (r["_part"], r["_last"])):
        into = before[1] if before and before[0] == r[group] and r["_first"] else None
        if into and r["_head"]:
            carried.append((r["_part"], *(into[v] for v in values)))
        if r["_last"]:
            own = {v: r[v] for v in values}
            here = dict(zip(values, carried[-1][1:])) if carried and carried[-1][0] == r["_part"] and r["_first"] else None
            before = (r[group], own if here is None else {v: own[v] + here[v] if v in sums else own[v] ^ here[v] for v in values})
    if not carried:
        return made.select(*columns)
    more = spark.createDataFrame(carried, "_p int, " + ", ".join(f"_more_{v} long" for v in values))
    joined = made.join(F.broadcast(more), (F.col("_part") == F.col("_p")) & F.col("_first"), "left")
    add = lambda v: F.col(v) + F.coalesce(f"_more_{v}", F.lit(0)) if v in sums else F.col(v).bitwiseXOR(F.coalesce(f"_more_{v}", F.lit(0)))
    return joined.select(*keep, *[add(v).alias(v) for v in values])


# Conversations as paths.


def rebuilt(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(turns, convs). turns: conv_id, depth, size (of its conversation), k1, k2 (hashes of the turn), words, g1, g2, p1, p2 (key of the prefix; without g1, g2 that of the parent).
    convs: conv_id and size of each. A conversation's first crc32 % heads turns are those of the first of its group."""
    rows = common.pick(conversations, "conv_id", "turn", "role", "text")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).filter("conv_id is not null")
    rows = rows.select("conv_id", "turn", "role", F.md5("text").alias("digest"), F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(1), "role", "text").alias("k2"), F.regexp_count("text", F.lit(common.WORD)).cast("long").alias("words"), F.lit(1).cast("long").alias("i"))
    own = running(rows, "conv_id", [F.col("turn").asc_nulls_first(), "role", "digest"], ["conv_id", "k1", "k2", "words"], ["i"])
    head = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(heads)).cast("long")
    convs = own.groupBy("conv_id").agg(F.max("i").alias("n")).select("conv_id", "n", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    bases = convs.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = common.staged(convs.join(bases, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "conversations")
    first = own.filter((F.col("conv_id") % group == 0) & (F.col("i") < heads)).withColumnRenamed("conv_id", "base")
    first = convs.filter("taken > 0").join(first, "base").filter("i <= h").select("conv_id", F.col("i").alias("depth"), "size", "k1", "k2", "words")
    rest = own.filter(F.col("i") > head).join(convs.select("conv_id", "h", "taken", "size"), "conv_id").select("conv_id", (F.col("taken") + F.col("i") - F.col("h")).alias("depth"), "size", "k1", "k2", "words")
    keyed = first.unionByName(rest).withColumns({"g1": F.xxhash64("k1", "k2", "depth"), "g2": F.xxhash64(F.lit(1), "k1", "k2", "depth")}).withColumns({"p1": F.col("g1"), "p2": F.col("g2")})
    return running(keyed, "conv_id", ["depth"], ["conv_id", "depth", "size", "k1", "k2", "words", "g1", "g2"], xors=["p1", "p2"]), convs.select("conv_id", "size")


def distinct_ends(ends: DataFrame, block: int = BLOCK) -> DataFrame:
    """p1, p2, conv_id (the least), n, sha256 of the ids (decimal, ascending, joined by commas) for each key of ends (p1, p2, conv_id), staged."""
    import pyarrow as pa

    schema = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("conv_id", pa.int64()), ("n", pa.int64()), ("sha256", pa.string()), ("ids", pa.binary())])
    ddl = "p1 long, p2 long, conv_id long, n long, sha256 string, ids binary"
    out_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, schema.types)], schema=schema)

    def inside(batches):
        """A group of one block that lies between others of its task is hashed; of others the ids go on, in blocks."""
        key, ids, alone, out = None, [], False, []

        def closed(final):
            text = ",".join(map(str, ids)).encode()
            return (*key, ids[0], len(ids), *((hashlib.sha256(text).hexdigest(), None) if final else (None, text)))

        for b in batches:
            for p1, p2, c in zip(*[b.column(x).to_pylist() for x in ("p1", "p2", "conv_id")]):
                if key != (p1, p2):
                    if key:
                        out.append(closed(alone))
                    alone, key, ids = key is not None, (p1, p2), []
                elif len(ids) == block:
                    out.append(closed(False))
                    alone, ids = False, []
                ids.append(c)
            yield out_of(out)
            out = []
        yield out_of([closed(False)] if key else [])

    def across(batches):
        key, least, n, digest, out = None, None, 0, None, []
        for b in batches:
            for p1, p2, c, k, ids in zip(*[b.column(x).to_pylist() for x in ("p1", "p2", "conv_id", "n", "ids")]):
                if key != (p1, p2):
                    if key:
                        out.append((*key, least, n, digest.hexdigest(), None))
                    key, least, n, digest = (p1, p2), c, 0, hashlib.sha256()
                elif n:
                    digest.update(b",")
                digest.update(ids)
                n += k
            yield out_of(out)
            out = []
        yield out_of([(*key, least, n, digest.hexdigest(), None)] if key else [])

    made = common.staged(ends.repartitionByRange("p1", "p2", "conv_id").sortWithinPartitions("p1", "p2", "conv_id").mapInArrow(inside, ddl), "ends")
    parted = made.filter("sha256 is null").repartition("p1", "p2").sortWithinPartitions("p1", "p2", "conv_id").mapInArrow(across, ddl)
    return common.staged(made.filter("sha256 is not null").unionByName(parted).drop("ids"), "sequences")


# Tries.


class Trie:
    """A LOUDS bit vector, to be walked by rank and select: node 0 stands above the shard's prefixes, the nodes follow in level order."""

    def __init__(self, louds: bytes, nodes: int):
        import numpy as np

        bits = np.unpackbits(np.frombuffer(louds, np.uint8), bitorder="little")[: 2 * nodes - 1]
        self.parent = np.concatenate([[-1], np.flatnonzero(bits) - np.arange(nodes - 1)])  # zeros before the one of each node
        ends = np.flatnonzero(bits == 0)
        self.degree = np.diff(ends, prepend=-1) - 1
        self.first_child = 1 + ends - np.arange(nodes) - self.degree  # ones before a node's own

    def levels(self) -> list[tuple[int, int]]:
        """Node numbers from and up to, by level."""
        out = [(0, 1)]
        while (e := out[-1][1]) < len(self.parent):
            out.append((e, int(self.first_child[e - 1] + self.degree[e - 1])))
        return out


def louds(degree) -> bytes:
    import numpy as np

    bits = np.ones(int(degree.sum()) + len(degree), np.uint8)
    bits[np.cumsum(degree + 1) - 1] = 0
    return np.packbits(bits, bitorder="little").tobytes()


_LABELS = ["k1", "k2", "p1", "p2", "q1", "q2", "depth", "words", "ends", "member"]
_TRIE = "shard int, nodes long, louds binary, " + ", ".join(f"{c} array<long>" for c in _LABELS)


def build_trie(rows: dict) -> tuple[bytes, dict]:
    """From the turns of a shard (arrays by name: level from 1, p1, p2, q1, q2 (the parent's key), k1, k2, depth, words, conv_id, ends): LOUDS bits, and labels of the nodes
    from 1 on. ends is how many conversations end there, member the least of them."""
    import numpy as np

    n = len(rows["p1"])
    code = np.unique(np.concatenate([rows["p1"], rows["q1"]]), return_inverse=True)[1] * (2 * n) + np.unique(np.concatenate([rows["p2"], rows["q2"]]), return_inverse=True)[1]
    names, first, node = np.unique(code[:n], return_index=True, return_inverse=True)
    ends, member = np.zeros(len(names), np.int64), np.full(len(names), -1)
    np.add.at(ends, node, rows["ends"])
    member[node[rows["ends"] > 0]] = rows["conv_id"][rows["ends"] > 0]  # ends of one key are one row
    at = np.searchsorted(names, code[n:][first])
    level = rows["level"][first]
    rank, order, done = np.zeros(len(names), np.int64), [], 0
    by_level = np.argsort(level, kind="stable")
    cuts = np.flatnonzero(np.diff(level[by_level], prepend=0, append=level.max() + 1))
    parents = []
    for a, b in zip(cuts, cuts[1:]):
        here = by_level[a:b]
        above = rank[at[here]] if done else np.zeros(b - a, np.int64)
        sort = np.lexsort((rows["k2"][first[here]], rows["k1"][first[here]], above))
        here = here[sort]
        rank[here] = done + 1 + np.arange(b - a)
        parents.append(above[sort])
        order.append(here)
        done += b - a
    order = np.concatenate(order)
    degree = np.bincount(np.concatenate(parents), minlength=len(names) + 1)
    picked = first[order]
    return louds(degree), {c: rows[c][picked] for c in ("k1", "k2", "p1", "p2", "q1", "q2", "depth", "words")} | {"ends": ends[order], "member": member[order]}


def find(trie: Trie, labels: dict, turns: list[tuple[int, int]], node: int = 0) -> int | None:
    """The node that turns (their hashes k1, k2) lead to from a node, if there is one: children are sorted by label, so each step is a binary search."""
    from bisect import bisect_left

    for turn in turns:
        a = int(trie.first_child[node])
        b = a + int(trie.degree[node])
        node = bisect_left(range(len(trie.parent)), turn, a, b, key=lambda i: (labels["k1"][i - 1], labels["k2"][i - 1]))
        if node == b or (labels["k1"][node - 1], labels["k2"][node - 1]) != turn:
            return None
    return node


def rollups(trie: Trie, labels: dict) -> dict:
    """For nodes from 1 on: conv_id (the least member), n_convs, n_children, n_leaves, saved_tokens."""
    import numpy as np

    far = np.iinfo(np.int64).max
    convs = np.concatenate([[0], labels["ends"]])
    least = np.concatenate([[far], np.where(labels["ends"] > 0, labels["member"], far)])
    upward = [x for x in reversed(trie.levels()) if x != (0, 1)]
    for a, b in upward:
        np.add.at(convs, trie.parent[a:b], convs[a:b])
        np.minimum.at(least, trie.parent[a:b], least[a:b])
    leaves = (trie.degree == 0).astype(np.int64)
    saved = (convs - 1) * np.concatenate([[0], labels["words"]])
    for a, b in upward:
        np.add.at(leaves, trie.parent[a:b], leaves[a:b])
        np.add.at(saved, trie.parent[a:b], saved[a:b])
    return {n: x[1:] for n, x in (("conv_id", least), ("n_convs", convs), ("n_children", trie.degree), ("n_leaves", leaves), ("saved_tokens", saved))} | {"parent_conv_id": np.where(trie.parent[1:] > 0, least[np.maximum(trie.parent[1:], 0)], -1)}


def shard_tries(light: DataFrame) -> DataFrame:
    """A row with the trie of each shard (_TRIE), staged."""
    import pyarrow as pa

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        rows = {c: table.column(c).to_numpy() for c in table.column_names}
        bits, labels = build_trie(rows)
        each = [pa.array([labels[c]], pa.list_(pa.int64())) for c in _LABELS]
        return pa.table([pa.array(rows["shard"][:1]), pa.array([len(labels["k1"]) + 1], pa.int64()), pa.array([bits], pa.binary()), *each], ["shard", "nodes", "louds", *_LABELS])

    return common.staged(light.groupBy("shard").applyInArrow(run, _TRIE), "tries")


_NODE = "p1 long, p2 long, q1 long, q2 long, conv_id long, depth long, parent_conv_id long, top boolean, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long, member long"


def trie_nodes(tries: DataFrame) -> DataFrame:
    """A row for each node of the tries, read from their bits and labels (_NODE). top: its parent is not in the trie, and parent_conv_id is null. q1, q2: the parent's key."""
    import pyarrow as pa

    names = [x.split()[0] for x in _NODE.split(", ")]
    common.batches(tries.sparkSession, 1)

    def run(batches):
        import numpy as np

        for b in batches:
            for nodes, bits, *each in zip(*[b.column(c) for c in ("nodes", "louds", *_LABELS)]):
                labels = {c: x.values.to_numpy() for c, x in zip(_LABELS, each)}
                trie = Trie(bits.as_py(), nodes.as_py())
                made = labels | rollups(trie, labels)
                made["top"] = trie.parent[1:] == 0
                for a in range(0, len(made["p1"]), 50_000):
                    cols = [pa.array(made[c][a : a + 50_000], mask=made["top"][a : a + 50_000] if c == "parent_conv_id" else None) for c in names]
                    yield pa.RecordBatch.from_arrays(cols, names)

    return tries.mapInArrow(run, _NODE)


# The whole.


def prefix_nodes(conversations: DataFrame, shard: int = SHARD, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(nodes, tries): a row for each node (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), and the shards' tries."""
    spark = conversations.sparkSession
    turns, convs = rebuilt(conversations, group, heads)
    parent = [F.col("p1").bitwiseXOR(F.col("g1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("g2")).alias("q2")]
    turns = turns.select("conv_id", "depth", "size", "k1", "k2", "words", "p1", "p2", *parent)
    none = F.lit(0).cast("long")
    ends = turns.filter("depth = size").select("p1", "p2", "conv_id").unionByName(convs.filter("size = 0").select(none.alias("p1"), none.alias("p2"), "conv_id"))
    ends = distinct_ends(ends)
    # One path for each sequence: that of its least member.
    paths = common.staged(turns.join(ends.select("conv_id", "n"), "conv_id"), "paths")
    each = paths.groupBy("p1", "p2").agg(F.sum(F.col("size") - F.col("depth") + 1).alias("weight"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.first(c).alias(c) for c in ("q1", "q2", "depth", "words")])
    heavy = common.staged(each.filter(F.col("weight") > shard).drop("weight"), "heavy")
    upper = _small(heavy.select("p1", "p2"))
    light = paths.join(upper, ["p1", "p2"], "left_anti")
    under = light.join(upper.select(F.col("p1").alias("q1"), F.col("p2").alias("q2")), ["q1", "q2"], "left_semi").select("conv_id", "p1", "p2", "depth")
    tops = under.unionByName(light.filter("depth = 1").select("conv_id", "p1", "p2", "depth"))
    shards = max(1, math.ceil(light.count() / shard))
    tops = tops.select("conv_id", F.pmod(F.xxhash64("p1", "p2"), F.lit(shards)).cast("int").alias("shard"), F.col("depth").alias("top"))
    light = light.join(tops, "conv_id").withColumns({"level": F.col("depth") - F.col("top") + 1, "ends": F.when(F.col("depth") == F.col("size"), F.col("n")).otherwise(0)}).drop("top", "size", "n")
    tries = shard_tries(light)
    below = common.staged(trie_nodes(tries), "nodes")

    # The upper levels.
    least, members = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    root = spark.createDataFrame([(0, 0, members, least, None, None, 0, 0)], "p1 long, p2 long, n_convs long, conv_id long, q1 long, q2 long, depth long, words long")
    above = heavy.select(*root.columns).unionByName(root)
    children = below.filter("top").select("q1", "q2").unionByName(heavy.select("q1", "q2")).groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("n_children"))
    # What each subtree adds to all above it, at its place on the path of its least member.
    own = heavy.select("conv_id", "depth", none.alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    adds = common.staged(own.unionByName(below.filter("top").select("conv_id", "depth", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))), "subtrees")
    on_path = paths.join(upper, ["p1", "p2"], "left_semi").select("conv_id", "depth", "p1", "p2").join(adds.select("conv_id").distinct(), "conv_id", "left_semi")
    steps = on_path.join(adds, ["conv_id", "depth"], "full").withColumns({c: F.coalesce(c, none) for c in ("leaves", "saved")})
    sums = running(steps, "conv_id", [F.col("depth").desc()], ["conv_id", "p1", "p2"], ["leaves", "saved"]).filter("p1 is not null").groupBy("p1", "p2").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    total = adds.agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")).select(none.alias("p1"), none.alias("p2"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", none).alias("saved_tokens"))
    above = above.join(sums.unionByName(total), ["p1", "p2"]).join(children.withColumnsRenamed({"q1": "c1", "q2": "c2"}), (F.col("p1") == F.col("c1")) & (F.col("p2") == F.col("c2")), "left").drop("c1", "c2")
    above = common.staged(above.withColumn("n_children", F.coalesce("n_children", none)), "upper")

    # Parents and members that end there.
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    over = _small(above.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id")))
    shown = lambda sha: [*names, sha.alias("ends_sha256")]
    attached = below.filter("top").drop("parent_conv_id").join(over, ["q1", "q2"], "left").unionByName(below.filter("not top"))
    attached = attached.join(ends.filter("n > 1").select("p1", "p2", "sha256"), ["p1", "p2"], "left")
    attached = attached.select(*shown(F.coalesce("sha256", F.when(F.col("ends") == 1, F.sha2(F.col("member").cast("string"), 256)), F.lit(_EMPTY))))
    up = above.filter("n_convs > 0").join(over, ["q1", "q2"], "left").join(ends.select("p1", "p2", "sha256"), ["p1", "p2"], "left")
    return attached.unionByName(up.select(*shown(F.coalesce("sha256", F.lit(_EMPTY))))), tries


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_nodes(common.table(spark, sf_dir, "conversations"))[0]


#: CRC-32 of a decimal number: an element of a step list is a byte to take in, or -1 for a shift by one bit.
_CRC = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(str_split(CAST({c} AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"


def oracle_sql(group: int = GROUP, heads: int = HEADS) -> str:
    return rf"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, md5(concat(length(role), ':', role, text)) AS k, len(regexp_extract_all(text, '[^ 	-
]+')) AS words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), conv AS (SELECT DISTINCT conv_id, {_CRC.format(c="conv_id")} % {heads} AS h FROM own
), placed AS (
  SELECT conv.conv_id, 0 AS part, i, k, words FROM conv JOIN own ON own.conv_id = conv.conv_id - conv.conv_id % {group} AND i <= h
  UNION ALL SELECT conv_id, 1, i, k, words FROM conv JOIN own USING (conv_id) WHERE i > h
), path AS (
  SELECT conv_id, row_number() OVER w AS depth, list(k) OVER w AS p, words FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)
  UNION ALL SELECT conv_id, 0, CAST([] AS VARCHAR[]), 0 FROM conv
), node AS (SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM path GROUP BY p, depth
), last AS (SELECT conv_id, max_by(p, depth) AS p FROM path GROUP BY conv_id
), ended AS (SELECT p, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM last GROUP BY p
), child AS (SELECT p[: depth - 1] AS p, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1
), above AS (SELECT p[: d] AS p, count(*) FILTER (n_children IS NULL) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens FROM (SELECT node.*, n_children, unnest(range(0, depth + 1)) AS d FROM node LEFT JOIN child USING (p)) GROUP BY 1
)
SELECT node.conv_id, node.depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM node LEFT JOIN child USING (p) JOIN above USING (p) LEFT JOIN ended USING (p) LEFT JOIN node AS up ON node.depth = up.depth + 1 AND node.p[: node.depth - 1] = up.p
"""


ORACLE_SQL = oracle_sql()
