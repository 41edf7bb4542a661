"""Graphs as tables of edges: references, keyword similarity, degrees, PageRank, traversal, shortest paths, components, cycles.

Loops write each round to the shared folder; just a number or two of a round comes to the driver. Nodes are longs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork import session
from skeinwork.functions import text as X


def reference_edges(corpus: DataFrame) -> DataFrame:
    """src, dst, pos, type, weight of [[slug]] references: by slug, else by number; no self references, the first of equal ones."""
    links = corpus.select(F.col("doc_id").alias("src"), F.posexplode(X.extract_links(F.col("content"))).alias("pos", "slug"))
    ids = corpus.select(F.col("slug").alias("s"), F.col("doc_id").alias("by_slug"))
    nums = corpus.select(F.col("doc_id").alias("by_id"))
    hit = links.join(ids, F.col("slug") == F.col("s"), "left").join(nums, F.col("slug").try_cast("long") == F.col("by_id"), "left")
    hit = hit.withColumn("dst", F.coalesce("by_slug", "by_id")).filter("dst is not null and dst <> src")
    return hit.groupBy("src", "dst").agg(F.min("pos").alias("pos")).select("src", "dst", "pos", F.lit("reference").alias("type"), F.lit(1.0).alias("weight"))


#: Targets in one list of a node's edges.
LIST = 4096
#: Documents of a block; two blocks are compared at a time.
BLOCK = 1024
#: Blocks of a side; a group has two sides, so documents are dealt out once for each side.
SIDE = 16
#: Keywords of a document up to which links are looked up in a table of all numbers of keywords.
TABLED = 128


def keyword_ids(keywords: DataFrame, categories: DataFrame) -> DataFrame:
    """doc_id, words (the distinct keywords, in numbers), category (a number), staged; documents without keywords are left out, as they have no links."""
    kw = keywords.select("doc_id", F.lower("keyword").alias("keyword")).filter("doc_id is not null and keyword is not null").distinct()
    named = categories.select("doc_id", F.lower(F.coalesce("category", F.lit("Uncategorised"))).alias("name"))
    number = lambda rows, name, to: session.staged(rows.select(name).distinct().withColumn(to, F.monotonically_increasing_id()), f"similar-{to}")
    words = kw.join(number(kw, "keyword", "word"), "keyword").groupBy("doc_id").agg(F.collect_list("word").alias("words"))  # a document's own keywords
    return session.staged(words.join(named.join(number(named, "name", "category"), "name").select("doc_id", "category"), "doc_id"), "similar-ids")


def pairs_of(sets: DataFrame, least: float = 0.18, bonus: float = 0.25, block: int = BLOCK) -> DataFrame:
    """a < b, weight of similarity_pairs() from keyword_ids(). Documents lie in sides of up to SIDE blocks, and each pair of sides is compared in one group: block by block, by a matrix of shared
    keywords whose links are handed on before the next. So memory is bounded, pairs are not shuffled, and a document is sent once for each side. Time is in proportion to all pairs, as the result is."""
    # Sides as long as they may be, or shorter ones, as long as a block, if there were too few pairs of them for the cores.
    blocks, cores = max(1, -(-sets.count() // block)), sets.sparkSession.sparkContext.defaultParallelism
    sides = min(blocks, max(-(-blocks // SIDE), int((8 * cores) ** 0.5) + 1))
    mine = F.pmod(F.xxhash64("doc_id"), F.lit(sides)).cast("int")
    placed = sets.select("doc_id", "words", "category", mine.alias("side")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    low, high = F.least("side", "other").cast("long"), F.greatest("side", "other").cast("long")
    placed = placed.select((low * sides + high).alias("pair"), (F.col("side") == low).alias("first"), "doc_id", "words", "category")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import ROUND_HALF_UP, Decimal

        import numpy as np

        rows = pa.Table.from_batches(batches)
        if not rows.num_rows:
            return

        def parts(t):
            """Blocks: documents, categories, numbers of keywords, keywords in order, whose they are."""
            out = []
            for start in range(0, t.num_rows, block):
                b = t.slice(start, block).combine_chunks()
                lists = b.column("words").combine_chunks()
                size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                words, at = lists.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
                order = np.argsort(words)
                out.append((b.column("doc_id").to_numpy(), b.column("category").to_numpy(), size, words[order], at[order]))
            return out

        pair, first = rows.column("pair")[0].as_py(), rows.column("first")
        one = pair // sides == pair % sides
        left = parts(rows if one else rows.filter(first))
        right = left if one else parts(rows.filter(pa.compute.invert(first)))
        most = max((int(b[2].max()) for b in (*left, *right)), default=0)

        def weighed(key):
            """Whether documents are linked, and their weight, by ((shared keywords) * (2 * most + 1) + keywords of both) * 2 + (one category)."""
            same, common, both = key % 2 == 1, key // 2 // (2 * most + 1), key // 2 % (2 * most + 1)
            w = common / np.maximum(1, both - common) + np.where(same, bonus, 0.0)
            linked = (w >= least) & ((common > 0) | (same & (bonus >= least)))
            values, which = np.unique(np.where(linked, np.minimum(1.0, w), 0.0), return_inverse=True)
            return linked, np.array([float(Decimal(repr(float(x))).quantize(Decimal("0.0001"), ROUND_HALF_UP)) for x in values], np.float64)[which.reshape(-1)]

        kind = np.int32 if most <= TABLED else np.int64
        table = weighed(np.arange((most + 1) * (2 * most + 1) * 2)) if most <= TABLED else None
        for p, (ids, category, size, words, at) in enumerate(left):
            for ids2, category2, size2, there, at2 in right[p:] if one else right:
                n, m = len(ids), len(ids2)
                start, end = np.searchsorted(there, words), np.searchsorted(there, words, "right")
                often = end - start
                met = np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often) + np.repeat(start, often)
                common = np.bincount(np.repeat(at * m, often) + at2[met], minlength=n * m).astype(kind).reshape(n, m)
                key = common * kind((2 * most + 1) * 2) + (2 * size.astype(kind)[:, None] + 2 * size2.astype(kind)[None, :]) + (category[:, None] == category2[None, :])
                if table:
                    keys, (linked, weights) = key, table
                else:
                    keys, found = np.unique(key, return_inverse=True)
                    (linked, weights), keys = weighed(keys), found.reshape(n, m)
                i, j = np.nonzero(linked[keys] & (ids[:, None] < ids2[None, :]) if ids is ids2 else linked[keys])
                x, y = ids[i], ids2[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(weights[keys[i, j]])], ["a", "b", "weight"])

    pairs = sides * (sides + 1) // 2
    return placed.repartition(max(8 * cores, pairs // 2), "pair").groupBy("pair").applyInArrow(run, "a long, b long, weight double")


def similarity_pairs(keywords: DataFrame, categories: DataFrame, least: float = 0.18, bonus: float = 0.25) -> DataFrame:
    """a < b, weight: Jaccard similarity of keyword sets and a bonus for one category, if that is at least the threshold.

    keywords (doc_id, keyword), categories (doc_id, category). The rule itself links each pair inside a category if the bonus alone is
    enough, so the result is as large as that."""
    return pairs_of(keyword_ids(keywords, categories), least, bonus)


def similarity_weights(references: DataFrame, sets: DataFrame, least: float = 0.18, bonus: float = 0.25) -> DataFrame:
    """references with w, the weight that similarity_pairs() has for their two ends, null if it does not have them; from keyword_ids(), without the pairs."""
    x, y = (sets.select(F.col("doc_id").alias(f"_{n}"), F.col("words").alias(f"w{n}"), F.col("category").alias(f"c{n}")) for n in "ab")
    both = references.join(x, F.col("src") == F.col("_a"), "left").join(y, F.col("dst") == F.col("_b"), "left")
    shared, same = F.size(F.array_intersect("wa", "wb")), F.col("ca") == F.col("cb")
    w = shared / (F.size("wa") + F.size("wb") - shared) + F.when(same, bonus).otherwise(0.0)
    linked = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("src") != F.col("dst")) & (w >= least) & ((shared > 0) | (same & F.lit(bonus >= least)))
    return both.select(*references.columns, F.when(linked, F.round(F.least(F.lit(1.0), w), 4)).alias("w"))


def similar_sets(keywords: DataFrame, categories: DataFrame, least: float = 0.18, bonus: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """The same rule as a join of distinct sets: (classes, links).

    classes: doc_id, class_id (the least document of equal keywords and category), category. links: a < b (classes), weight, where keyword sets are alike enough. Where the
    bonus alone is enough, classes of one category are linked without a row: all of them are, so only links across categories are rows.
    A pair's Jaccard similarity has to be least, less the bonus inside a category. So two sets with that similarity share one of the first
    size - ceil(size * similarity) + 1 keywords of each, rarest first, and the smaller has at least similarity times the size of the larger: pairs are formed on those
    keywords only, and checked on whole sets. Links grow with what is alike, not with the square of a category or of a frequent keyword.
    """
    kw = keywords.select("doc_id", F.lower("keyword").alias("keyword")).distinct()
    sets = kw.groupBy("doc_id").agg(F.sort_array(F.collect_list("keyword")).alias("words"))  # a document's own keywords
    sets = sets.join(categories.select("doc_id", F.lower(F.coalesce("category", F.lit("Uncategorised"))).alias("category")), "doc_id")
    sets = session.staged(sets, "similar-documents")
    classes = session.staged(sets.groupBy("words", "category").agg(F.min("doc_id").alias("class_id")), "similar-classes")
    members = sets.join(classes, ["words", "category"]).select("doc_id", "class_id", "category")
    each = classes.select("class_id", "category", F.size("words").alias("size"), "words")
    df = each.select(F.explode("words").alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("df"))
    placed = each.select("class_id", "category", "size", F.explode("words").alias("keyword")).join(df, "keyword")
    ranked = placed.withColumn("place", F.row_number().over(Window.partitionBy("class_id").orderBy("df", "keyword")))
    inside = least - bonus
    # (similarity, whether the pair is of one category): one join each.
    rules = [(least, False)] + [(inside, True)] * (inside > 0)
    found = None
    for similarity, same in rules:
        prefix = session.staged(ranked.filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1).select("class_id", "category", "size", "keyword"), "similar-prefixes")
        x, y = (prefix.select(F.col("class_id").alias(n), F.col("category").alias(f"c{n}"), F.col("size").alias(f"k{n}"), "keyword") for n in "ab")
        fits = (F.col("ka") >= F.col("kb") * similarity - 1e-9) & (F.col("kb") >= F.col("ka") * similarity - 1e-9) & (F.col("a") < F.col("b"))
        near = x.join(y, "keyword").filter(fits & ((F.col("ca") == F.col("cb")) if same else (F.col("ca") != F.col("cb")))).select("a", "b").distinct()
        near = near.withColumn("same", F.lit(same))
        found = near if found is None else found.unionByName(near)
    wa, wb = (classes.select(F.col("class_id").alias(n), F.col("words").alias(f"w{n}")) for n in "ab")
    both = found.join(wa, "a").join(wb, "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    w = shared / (F.size("wa") + F.size("wb") - shared) + F.when(F.col("same"), bonus).otherwise(0.0)
    links = both.withColumn("w", w).filter(F.col("w") >= least).select("a", "b", F.round(F.least(F.lit(1.0), "w"), 4).alias("weight"))
    return session.staged(members, "similar-members"), session.staged(links, "similar-links")


def link_counts(classes: DataFrame, links: DataFrame, least: float = 0.18, bonus: float = 0.25) -> DataFrame:
    """doc_id, class_id, links: with how many documents each is linked, from similar_sets()."""
    size = classes.groupBy("class_id", "category").agg(F.count(F.lit(1)).alias("n"))
    n = size.select(F.col("class_id").alias("other"), "n")
    both = links.select(F.col("a").alias("class_id"), F.col("b").alias("other")).union(links.select("b", "a"))
    across = both.join(n, "other").groupBy("class_id").agg(F.sum("n").alias("across"))
    own = size.withColumn("own", F.col("n") - 1)  # equal sets have similarity 1
    if bonus >= least:
        own = size.join(size.groupBy("category").agg(F.sum("n").alias("all")), "category").withColumn("own", F.col("all") - 1)
    total = own.join(across, "class_id", "left").select("class_id", (F.col("own") + F.coalesce("across", F.lit(0))).alias("links"))
    return classes.select("doc_id", "class_id").join(total, "class_id").select("doc_id", "class_id", "links")


def _directed(pairs: DataFrame) -> DataFrame:
    """src, dst, weight: pairs in both directions, made once."""
    ends = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return pairs.select("weight", F.inline(ends)).select("src", "dst", "weight")


def document_graph(references: DataFrame, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """src, dst, pos, type, weight: references first, then similarity in both directions by number; a pair's similarity is
    the weight of its reference too, and both edges stay. With sets, the keyword_ids() that pairs are of, references get that weight without a join with all pairs."""
    both = _directed(pairs)
    if sets is None:
        new = both.select(F.col("src").alias("s"), F.col("dst").alias("d"), F.col("weight").alias("w"))
        known = references.join(new, (F.col("src") == F.col("s")) & (F.col("dst") == F.col("d")), "left")
    else:
        known = similarity_weights(references, sets)
    refs = known.select("src", "dst", "pos", "type", F.coalesce("w", "weight").alias("weight"))
    start = 1 << 20
    placed = both.withColumn("pos", F.lit(start) + F.row_number().over(Window.partitionBy("src").orderBy("dst")))
    return refs.unionByName(placed.select("src", "dst", "pos", F.lit("similarity").alias("type"), "weight"))


def document_costs(references: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """costs() of document_graph(). Of parallel edges there are just a reference and a similarity of one weight, so pairs are not grouped: references that are no pairs are added."""
    new = similarity_weights(references, sets).filter("w is null").select("src", "dst", "weight")
    return costs(new).unionByName(_directed(pairs).select("src", "dst", (2.0 - F.col("weight")).alias("cost")))


def costs(edges: DataFrame) -> DataFrame:
    """src, dst, cost = 2 - weight, the least of parallel edges."""
    return edges.groupBy("src", "dst").agg(F.min(2.0 - F.col("weight")).alias("cost"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, in_degree (distinct sources), out_degree (edges, parallel ones too)."""
    i = edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("in_degree"))
    o = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    return nodes.join(i, "node", "left").join(o, "node", "left").select("node", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def graph_stats(nodes: DataFrame, edges: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """nodes, edges, avg_degree; with column type the numbers of reference and similarity edges, with ranks (node, pagerank) their ends."""
    kinds = [F.count(F.when(F.col("type") == t, 1)).alias(f"{t}_edges") for t in ("reference", "similarity")] if "type" in edges.columns else []
    out = nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges"), *kinds)))  # one row each
    out = out.withColumn("avg_degree", F.coalesce(F.round(F.try_divide(F.col("edges"), F.col("nodes")), 2), F.lit(0.0)))
    if ranks is not None:
        out = out.crossJoin(F.broadcast(ranks.agg(F.min("pagerank").alias("pagerank_min"), F.max("pagerank").alias("pagerank_max"))))
    return out


def counted_stats(nodes: DataFrame, counts: dict[str, DataFrame]) -> DataFrame:
    """graph_stats() from numbers of edges by type (a row with n each) instead of edges."""
    out = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    for t, one in counts.items():
        out = out.crossJoin(F.broadcast(one.select(F.col("n").alias(f"{t}_edges"))))  # one row
    edges = sum((F.col(f"{t}_edges") for t in counts), F.lit(0)).cast("long")
    return out.select("nodes", edges.alias("edges"), *[f"{t}_edges" for t in counts], F.coalesce(F.round(F.try_divide(edges, F.col("nodes")), 2), F.lit(0.0)).alias("avg_degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 200, tolerance: float | None = 1e-6, history: list | None = None) -> DataFrame:
    """node, pagerank; history gets (round, L1 change) of each round where a tolerance is given. Parallel edges count each; dangling nodes share with all; edges to unknown nodes are left out.

    A round is one shuffle join and one aggregation; edges are grouped once, to lists of the targets that get an equal share, so a round shuffles eight bytes an edge. Lists of a hub are split."""
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("pagerank"))
    known = edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    grouped = known.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    out = grouped.groupBy("src").agg(F.sum("m").alias("out"))
    part = F.pmod(F.xxhash64("dst"), F.ceil(F.col("out") / LIST))
    lists = grouped.join(out, "src").groupBy("src", (F.col("m") / F.col("out")).alias("share"), part.alias("part")).agg(F.collect_list("dst").alias("targets"))  # about LIST at most
    links = session.staged(lists.select("src", "share", "targets"), "pagerank-links")
    dangling = session.staged(nodes.join(out.select(F.col("src").alias("node")), "node", "left_anti"), "pagerank-dangling")
    rank, staged = nodes.select("node", F.lit(1.0 / n).alias("pagerank")), session.Rounds(nodes.sparkSession, "pagerank")
    for k in range(iterations):
        lost = dangling.join(rank, "node").agg(F.coalesce(F.sum("pagerank"), F.lit(0.0))).first()[0]
        given = links.join(rank, F.col("src") == F.col("node")).select((F.col("pagerank") * F.col("share")).alias("x"), F.explode("targets").alias("dst")).groupBy("dst").agg(F.sum("x").alias("got"))
        new = rank.join(given, F.col("node") == F.col("dst"), "left")
        new = staged(new.select("node", F.col("pagerank").alias("old"), (F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("got", F.lit(0.0))).alias("pagerank")))
        rank = new.select("node", "pagerank")
        if tolerance is not None:
            change = new.agg(F.sum(F.abs(F.col("pagerank") - F.col("old")))).first()[0]
            if history is not None:
                history.append((k + 1, change))
            if change < tolerance:
                break
    return rank


def hub_scores(rank: DataFrame, top: int = 10) -> DataFrame:
    return rank.orderBy(F.desc("pagerank"), F.col("node").cast("string")).limit(top)


def authority_labels(rank: DataFrame) -> DataFrame:
    """node, tier by the share of the greatest rank."""
    top = F.broadcast(rank.agg(F.max("pagerank").alias("top")))  # one row
    share = F.when(F.col("top") > 0, F.col("pagerank") / F.col("top")).otherwise(0.0)
    return rank.crossJoin(top).select("node", F.when(share >= 0.8, "authority").when(share >= 0.5, "strong").when(share >= 0.2, "linked").otherwise("peripheral").alias("tier"))


def related(edges: DataFrame, rank: DataFrame, node: int, limit: int = 5) -> DataFrame:
    """dst, score of a node's neighbours: the root of weight times relative rank."""
    top = rank.agg(F.max("pagerank")).first()[0] or 0.0
    near = edges.filter(F.col("src") == node).groupBy("dst").agg(F.max("weight").alias("weight"))
    score = F.round(F.sqrt(F.col("weight") * F.col("pagerank") / F.lit(max(1e-9, top))), 4)
    return near.join(rank, F.col("dst") == F.col("node")).select("dst", score.alias("score")).orderBy(F.desc("score"), "dst").limit(limit)


def bfs(edges: DataFrame, start: int, goal: int | None = None, max_depth: int | None = None) -> DataFrame:
    """node, depth, parent, visit, examined: breadth first, neighbours by (pos if there is one, dst); visit is the place in the order, examined
    the number of edges that a sequential walk looks at from the node (all of them; none behind a goal or at the last depth).

    A node's parent is the one visited first among those of the depth before. Each level is one folder of one table: a round joins the
    links with the level before, and what it finds with the nodes of the table; path() follows parents."""
    spark = edges.sparkSession
    has_pos = "pos" in edges.columns
    links = session.staged(edges.groupBy("src", "dst").agg((F.min("pos") if has_pos else F.min("dst")).alias("pos"), F.count(F.lit(1)).alias("n")), "bfs-links")
    where, schema = f"{session.shared_dir(spark)}/bfs-{uuid.uuid4().hex}", "node long, depth int, parent long, visit long"
    session.keep_track(spark, where)
    spark.createDataFrame([(start, 0, None, 0)], schema).write.parquet(f"{where}/level=0")
    depth, n, done, staged = 0, 1, start == goal, session.Rounds(spark, "bfs-level")
    table = lambda: spark.read.schema(schema).parquet(*[f"{where}/level={i}" for i in range(depth + 1)])
    while not done and (max_depth is None or depth < max_depth):
        front = spark.read.schema(schema).parquet(f"{where}/level={depth}")
        reach = front.select(F.col("node").alias("src"), F.col("visit").alias("by")).join(links, "src")
        best = reach.groupBy("dst").agg(F.min(F.struct("by", "pos", "src")).alias("m"))
        new = staged(best.join(table().select(F.col("node").alias("dst")), "dst", "left_anti").select(F.col("dst").alias("node"), "m.by", "m.pos", F.col("m.src").alias("parent")))
        size, hits = new.agg(F.count(F.lit(1)), F.count(F.when(F.col("node") == (start if goal is None else goal), 1))).first()
        if not size:
            break
        # Places in the order: a level is ordered by (parent's place, edge's place).
        placed = session.numbered(new, "visit", "by", "pos", "node", start=n, size=size).select("node", F.lit(depth + 1).alias("depth"), "parent", "visit")
        placed.write.parquet(f"{where}/level={depth + 1}")
        depth, n, done = depth + 1, n + size, hits > 0
    found = table()
    last = found.filter(F.col("node") == goal).select(F.col("visit").alias("until")) if goal is not None else None
    looked = found.join(links.groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("edges")), "node", "left")
    stops = F.lit(False) if max_depth is None else F.col("depth") >= max_depth
    if last is not None:
        looked = looked.join(F.broadcast(last), F.lit(True), "left")  # one row at most
        stops = stops | F.coalesce(F.col("visit") >= F.col("until"), F.lit(False))
    return looked.select("node", "depth", "parent", "visit", F.when(stops, 0).otherwise(F.coalesce("edges", F.lit(0))).alias("examined"))


def paths(found: DataFrame, goals: DataFrame | None = None) -> DataFrame:
    """goal, step, node: the nodes from the start (step 0) to each goal (column node; all nodes found if none are given), along column parent.

    Pointers are doubled: a round joins what is known of the paths with the ancestors 1, 2, 4, ... steps up, so a path of n nodes takes a logarithm of n of rounds."""
    known = found.select("node", "parent")
    spark, staged, jumps = found.sparkSession, session.Rounds(found.sparkSession, "paths"), session.Rounds(found.sparkSession, "ancestors")
    up = jumps(known.filter("parent is not null").select("node", F.col("parent").alias("over")))
    ends = known.select("node") if goals is None else goals.select("node").distinct().join(known.select("node"), "node", "left_semi")
    have, width, n = staged(ends.select(F.col("node").alias("goal"), F.lit(0).cast("long").alias("back"), "node")), 1, -1
    while (now := have.count()) != n:
        n = now
        further = have.join(up, "node").select("goal", (F.col("back") + width).alias("back"), F.col("over").alias("node"))
        have = staged(have.unionByName(further))
        up, width = jumps(up.join(up.select(F.col("node").alias("over"), F.col("over").alias("top")), "over").select("node", F.col("top").alias("over"))), 2 * width
    length = have.groupBy("goal").agg(F.max("back").alias("length"))
    return have.join(length, "goal").select("goal", (F.col("length") - F.col("back")).alias("step"), "node")


def path(found: DataFrame, goal: int) -> list[int]:
    """The nodes from the start to a goal along column parent, [] if the goal was not found."""
    rows = paths(found, found.sparkSession.createDataFrame([(goal,)], "node long")).orderBy("step").collect()
    return [r["node"] for r in rows]


def shortest_paths(edges: DataFrame, start: int, goal: int | None = None, delta: float | None = None, history: list | None = None) -> DataFrame:
    """node, dist, parent from start over (src, dst, cost), by delta-stepping; negative costs are refused. settled() gives the order in which a sequential run settles the nodes.

    Distances are settled in buckets of width delta (the mean cost, if none is given). Inside a bucket the edges cheaper than delta are relaxed until nothing changes, from the nodes that
    changed only; then its nodes are written, once, and their other edges relaxed. What a round rewrites is the open nodes, not the graph's: those with a tentative
    distance that is not settled. With a goal the run ends with the bucket that holds it, and only settled nodes are returned. Of equal distances the first found counts, the
    least parent among those of one round. history gets (bucket's upper end, open rows written, nodes settled so far)."""
    spark = edges.sparkSession
    edges = session.staged(edges.select("src", "dst", "cost"), "paths-edges")
    # By ranges of src, so a round reads the files between the least and the greatest node that changed.
    ranged = edges.repartitionByRange(session.parts(spark, edges.count()), "src", "dst")
    links = session.staged(ranged.groupBy("src", "dst").agg(F.min("cost").cast("double").alias("cost")), "paths-links", "src")
    least, mean = links.agg(F.min("cost"), F.avg("cost")).first()
    if least is not None and least < 0:
        raise ValueError("shortest paths need costs that are not negative")
    delta = delta or mean or 1.0
    light, heavy = links.filter(F.col("cost") < delta), links.filter(F.col("cost") >= delta)
    schema, where, buckets, done = "node long, dist double, parent long", f"{session.shared_dir(spark)}/paths-{uuid.uuid4().hex}", [], 0
    session.keep_track(spark, where)
    table = lambda: spark.read.schema(schema).parquet(*buckets) if buckets else spark.createDataFrame([], schema)
    staged = session.Rounds(spark, "paths-open", keep=2)

    def span(nodes):
        return nodes.agg(F.min("node"), F.max("node")).first()

    def relaxed(open_, changed, over, low, high):
        """The open nodes after these edges of changed nodes (from low to high) are tried; fresh ones have a new distance."""
        over = over.filter(F.col("src").between(low, high))
        step = changed.select(F.col("node").alias("src"), F.col("dist").alias("so_far")).join(over, "src")
        best = step.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct((F.col("so_far") + F.col("cost")).alias("dist"), F.col("src").alias("parent"))).alias("m"))
        best = best.join(table().select("node"), "node", "left_anti").select("node", F.col("m.dist").alias("new"), F.col("m.parent").alias("by"))
        better = F.col("new").isNotNull() & (F.col("dist").isNull() | (F.col("new") < F.col("dist")))
        both = open_.select("node", "dist", "parent").join(best, "node", "full_outer")
        return staged(both.select("node", F.when(better, F.col("new")).otherwise(F.col("dist")).alias("dist"), F.when(better, F.col("by")).otherwise(F.col("parent")).alias("parent"), better.alias("fresh")))

    open_ = spark.createDataFrame([(start, 0.0, None, True)], schema + ", fresh boolean")
    while (low := open_.agg(F.min("dist")).first()[0]) is not None:
        limit = (low // delta + 1) * delta
        near = F.col("dist") < limit
        changed = open_.filter(near)
        while (ends := span(changed))[0] is not None:
            open_ = relaxed(open_, changed, light, *ends)
            changed = open_.filter(near & F.col("fresh"))
        buckets.append(f"{where}/bucket={len(buckets)}")
        open_.filter(near).select("node", "dist", "parent").write.parquet(buckets[-1])
        bucket = spark.read.schema(schema).parquet(buckets[-1])
        done += bucket.count()
        if goal is not None and bucket.filter(F.col("node") == goal).limit(1).count():
            break
        open_ = relaxed(open_.filter(~near), bucket, heavy, *span(bucket))
        if history is not None:
            history.append((limit, open_.count(), done))
    return table()


def settled(dist: DataFrame) -> DataFrame:
    """dist with place: the order by (dist, node), in which a sequential run takes nodes off its queue."""
    return session.numbered(dist, "place", "dist", "node")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (its least node): least labels over both directions, with a jump along labels in each round."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct()
    both = session.staged(both, "component-links")
    label, staged = nodes.select("node", F.col("node").alias("component")), session.Rounds(nodes.sparkSession, "component-round", keep=2)
    while True:
        near = both.join(label, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("component").alias("near"))
        low = staged(label.join(near, F.col("node") == F.col("dst"), "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component")))
        over = low.select(F.col("node").alias("at"), F.col("component").alias("further"))
        new = staged(low.join(over, F.col("component") == F.col("at"), "left").select("node", "old", F.least("component", "further").alias("component")))
        label = new.select("node", "component")
        if not new.filter("component <> old").limit(1).count():
            return label


def cycle_residue(edges: DataFrame) -> DataFrame:
    """src, dst: what is left when edges from nodes that no edge enters, and into nodes that none leaves, are taken away
    again and again; empty if and only if there is no cycle."""
    staged = session.Rounds(edges.sparkSession, "cycle")
    left = staged(edges.select("src", "dst").distinct())
    n = left.count()
    while n:
        heads, tails = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        # Nodes are as many as the graph has, so they are shuffled and not sent by way of the driver.
        left = staged(left.join(heads.hint("merge"), "src", "left_semi").join(tails.hint("merge"), "dst", "left_semi").select("src", "dst"))
        n, before = left.count(), n
        if n == before:
            break
    return left


def cycle_witness(edges: DataFrame) -> DataFrame:
    """step, node, next: one cycle of the graph, from its least node on; no rows if there is none.

    Each node that is left by cycle_residue has an edge to another such node; the least one is its pointer. A walk along pointers from the least node is doubled,
    and the pointers with it, until it comes to a node again: a logarithm of its length of rounds, not of the graph's nodes. Pointers are shuffled, none go through the driver."""
    left = cycle_residue(edges)
    if not left.limit(1).count():
        return left.select(F.lit(0).alias("step"), F.col("src").alias("node"), F.col("dst").alias("next"))
    spark = edges.sparkSession
    pointer = session.staged(left.groupBy("src").agg(F.min("dst").alias("over")).withColumnRenamed("src", "node"), "cycle-pointers")
    walks, jumps, width, up = session.Rounds(spark, "cycle-walk"), session.Rounds(spark, "cycle-jumps"), 1, pointer
    walk = spark.createDataFrame([(0, pointer.agg(F.min("node")).first()[0])], "step long, node long")
    while True:
        walk = walks(walk.unionByName(walk.join(up.hint("merge"), "node").select((F.col("step") + width).alias("step"), F.col("over").alias("node"))))
        visits = walk.groupBy("node").agg(F.min("step").alias("first"), F.max("step").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        begin, back = visits.agg(F.min("first"), F.min(F.expr("(last - first) div (n - 1)"))).first()  # visits of a node are a cycle's length apart
        if back:
            break
        over = up.select(F.col("node").alias("over"), F.col("over").alias("top")).hint("merge")
        up, width = jumps(up.join(over, "over").select("node", F.col("top").alias("over"))), 2 * width
    ring = walk.filter((F.col("step") >= begin) & (F.col("step") < begin + back))
    first = ring.agg(F.min_by("step", "node")).first()[0]
    return ring.join(pointer.hint("merge"), "node").select(F.pmod(F.col("step") - first, F.lit(back)).alias("step"), "node", F.col("over").alias("next"))


def has_cycle(edges: DataFrame) -> bool:
    return cycle_residue(edges).limit(1).count() > 0


def traverse(edges: DataFrame, algorithm: str = "bfs", start: int | None = None, goal: int | None = None, depth: int | None = None) -> DataFrame:
    """bfs or dijkstra from a start that is in the graph, the least node otherwise; a goal that is not in the graph is ignored."""
    edges = session.staged(edges, "traverse-edges")  # read several times
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    there = lambda x: x is not None and nodes.filter(F.col("node") == x).limit(1).count() > 0
    start = start if there(start) else nodes.agg(F.min("node")).first()[0]
    goal, depth = goal if there(goal) else None, depth if depth and depth > 0 else None
    if algorithm == "bfs":
        return bfs(edges, start, goal, depth)
    if algorithm == "dijkstra":
        return shortest_paths(edges if "cost" in edges.columns else costs(edges), start)
    raise ValueError(f"unknown algorithm: {algorithm}")
