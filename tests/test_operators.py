import random

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import graph, overlap, ranking, relational, segments, strings, tfidf
from skeinwork.operators.index import Index
from skeinwork.plans import catalog

DOCS = [
    (1, "Graph search", "graph-search", "Graphs are searched by breadth first search. See [[sorting]] and [[5]].", "algorithms", ["graph", "search"], 7),
    (2, "Sorting methods", "sorting", "Merge sort is a sorting method. Merge sort is stable. See [[graph-search]].", "algorithms", ["sort", "merge"], 1),
    (3, "Bread baking", "bread", "Bread needs flour and water. See [[nowhere]] and [[bread]].", "food", ["bread", "flour"], 1),
    (4, "Soup", "soup", "A soup of water and roots, searching for taste.", "food", ["soup", "water"], 1),
    (5, "Empty keywords", "empty", "Nothing of note here, only graph.", "other", [], 1),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(DOCS, "doc_id long, title string, slug string, content string, category string, keywords array<string>, hits long").cache()


@pytest.fixture(scope="module")
def index(corpus):
    return Index(corpus)


def test_postings_weigh_fields(index):
    rows = {(r["term"], r["doc_id"]): r["wtf"] for r in index.postings.collect()}
    # graph in document 1: title 3 + 1, keyword 4, body 1
    assert rows["graph", 1] == 9 and rows["graph", 5] == 1 + 4  # its keywords are its own most frequent stems
    assert rows["sort", 2] == 4 + 4 + 3
    display = {r["term"]: r["display"] for r in index.vocabulary.collect()}
    assert display["sort"] == "sort" and display["graph"] == "graph"


def test_lookup_prefix_and_autocomplete(index):
    found = {r["term"]: (r["in_vocabulary"], r["document_count"]) for r in index.lookup(["graph", "absent"]).collect()}
    assert found == {"graph": (True, 3), "absent": (False, 0)}
    assert {(r["term"], r["doc_id"]) for r in index.documents_of(["graph", "absent"]).collect()} == {("graph", 1), ("graph", 2), ("graph", 5)}
    assert [r["term"] for r in index.prefix_terms("so").collect()] == ["sort", "soup"]
    words = index.autocomplete("so").collect()
    assert words[0]["score"] >= words[-1]["score"] and {w["term"] for w in words} == {"sort", "soup"}
    assert index.autocomplete(" ").count() == 0


def test_default_keywords_are_the_most_frequent_stems(index):
    assert [r["keyword"] for r in index.keywords.filter("doc_id = 5").orderBy("rank").collect()] == ["graph", "note", "noth"]


def test_tfidf(index):
    scores = {r["doc_id"]: r["score"] for r in tfidf.score_query(index, ["graph", "absent"]).collect()}
    assert len(scores) == 5 and 0 < scores[5] <= 1 and 0 < scores[1] <= 1 and scores[3] == 0
    assert all(r["score"] == 0 for r in tfidf.score_query(index, ["absent"]).collect())
    assert index.weights.groupBy("doc_id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).filter("abs(n - 1) > 1e-9").count() == 0


def test_search(index):
    s = ranking.Search(index)
    page = s.search("graph searching")
    ids = [r["doc_id"] for r in page["results"].collect()]
    assert ids[0] == 1 and page["total_results"] == 4 and page["pages"] == 1
    assert s.search("graph", page=999)["page"] == 1
    assert [r["doc_id"] for r in s.search('"merge sort"')["results"].collect()] == [2]
    assert s.search("the of")["total_results"] == 0
    assert {r["doc_id"] for r in s.search("water", category="FOOD")["results"].collect()} == {3, 4}
    assert [r["doc_id"] for r in s.search("zzz other")["results"].collect()] == []
    assert {r["doc_id"] for r in s.search("algorithms")["results"].collect()} == {1, 2}


def test_weights_sum_to_one():
    assert abs(sum(ranking.normalize_weights({"title": 2}).values()) - 1) < 1e-3
    assert ranking.normalize_weights({k: -1 for k in ranking.WEIGHTS}) == ranking.WEIGHTS


def test_boosts(spark):
    sig = {k: F.lit(0.5) for k in ranking.WEIGHTS}
    base = spark.range(1).select(ranking.fused_score(sig, F.lit(0), F.lit(False), F.lit(False)).alias("s")).first()["s"]
    full = spark.range(1).select(ranking.fused_score(sig, F.lit(0), F.lit(True), F.lit(True)).alias("s")).first()["s"]
    assert base == 0.5 and full == pytest.approx(0.5 * 1.12 * 1.15)


def test_references_and_graph(corpus):
    refs = graph.reference_edges(corpus)
    assert {(r["src"], r["dst"]) for r in refs.collect()} == {(1, 2), (1, 5), (2, 1)}
    kw = corpus.select("doc_id", F.explode("keywords").alias("keyword"))
    pairs = graph.similarity_pairs(kw, corpus.select("doc_id", "category"))
    assert {(r["a"], r["b"]): r["weight"] for r in pairs.collect()} == {(1, 2): 0.25, (3, 4): 0.25}
    g = graph.document_graph(refs, pairs)
    assert g.filter("src = 1").orderBy("pos").select("dst", "type", "weight").collect() == [(2, "reference", 0.25), (5, "reference", 1.0), (2, "similarity", 0.25)]
    deg = {r["node"]: (r["in_degree"], r["out_degree"]) for r in graph.degrees(corpus.select(F.col("doc_id").alias("node")), g).collect()}
    assert deg[1] == (1, 3) and deg[5] == (1, 0)


EDGES = [(1, 2), (1, 3), (2, 4), (3, 5), (4, 6), (5, 6)]


def edges(spark, rows=EDGES):
    return spark.createDataFrame(rows, "src long, dst long")


def nodes(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def test_bfs(spark):
    found = graph.bfs(edges(spark), 1)
    got = found.orderBy("visit").collect()
    assert [r["node"] for r in got] == [1, 2, 3, 4, 5, 6] and [r["depth"] for r in got] == [0, 1, 1, 2, 2, 3]
    assert graph.path(found, 6) == [1, 2, 4, 6] and graph.path(found, 99) == []
    assert graph.bfs(edges(spark), 1, max_depth=1).count() == 3
    links = {1: [2, 3], 2: [4], 3: [5], 4: [6], 5: [6]}
    for goal, depth in ((None, None), (4, None), (6, None), (None, 1), (None, 2)):
        order, level, looked = [1], {1: 0}, 0
        for node in order:
            if node == goal:
                break
            for to in links.get(node, []) if level[node] != depth else []:
                looked += 1
                if to not in level:
                    order.append(to)
                    level[to] = level[node] + 1
        order = order[: order.index(goal) + 1] if goal else order
        got = graph.bfs(edges(spark), 1, goal, depth).orderBy("visit").collect()
        assert [r["node"] for r in got[: len(order)]] == order and sum(r["examined"] for r in got[: len(order)]) == looked


def test_walks_take_all_steps(spark):
    sf = "/root/testdata/sf0.001"
    links = {}
    for r in catalog.steps(spark, sf).select("src", "dst").distinct().orderBy("src", "dst").collect():
        links.setdefault(r["src"], []).append(r["dst"])
    first = min(links)
    order, depth, parent = [first], {first: 0}, {first: None}
    for node in order:
        for to in links.get(node, []):
            if to not in depth:
                order.append(to)
                depth[to], parent[to] = depth[node] + 1, node
    got = catalog.queries()["bfs_order"](spark, sf).orderBy("visit").collect()
    assert [(r["visit"], r["node"], r["depth"], r["parent"], r["hops"]) for r in got] == [(i, n, depth[n], parent[n], depth[n] + 1) for i, n in enumerate(order)]


def test_shortest_paths(spark):
    rows = [(0, 1, 4.0), (0, 2, 2.0), (2, 1, 1.0), (1, 3, 5.0), (2, 3, 8.0), (2, 4, 10.0), (3, 5, 6.0), (5, 4, 3.0)]
    directed = spark.createDataFrame(rows, "src long, dst long, cost double")
    dist = {r["node"]: r["dist"] for r in graph.shortest_paths(directed, 0).collect()}
    assert dist == {0: 0, 1: 3, 2: 2, 3: 8, 4: 12, 5: 14}
    order = [r["node"] for r in graph.settled(graph.shortest_paths(directed, 0)).orderBy("place").collect()]
    assert order == [0, 2, 1, 3, 4, 5] and graph.path(graph.shortest_paths(directed, 0), 5) == [0, 2, 1, 3, 5]
    assert {r["node"] for r in graph.shortest_paths(directed, 0, goal=1, delta=2.0).collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        graph.shortest_paths(spark.createDataFrame([(0, 1, -1.0)], "src long, dst long, cost double"), 0)


def test_components_and_cycles(spark):
    got = graph.components(nodes(spark, 1, 2, 3, 4, 9), edges(spark, [(1, 2), (3, 4)])).collect()
    assert {r["node"]: r["component"] for r in got} == {1: 1, 2: 1, 3: 3, 4: 3, 9: 9}
    assert graph.has_cycle(edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])) and not graph.has_cycle(edges(spark, [(1, 2), (2, 3)]))


def test_pagerank(spark):
    got = {r["node"]: r["pagerank"] for r in graph.pagerank(nodes(spark, 1, 2, 3), edges(spark, [(1, 2), (2, 3)]), iterations=30).collect()}
    assert sum(got.values()) == pytest.approx(1, abs=1e-6) and got[3] > got[2] > got[1]
    history: list = []
    graph.pagerank(nodes(spark, 1, 2, 3), edges(spark, [(1, 2), (2, 3)]), history=history)
    assert len(history) > 5 and history[-1][1] < 1e-6 <= history[-2][1] and [k for k, _ in history] == list(range(1, len(history) + 1))
    tiers = {r["node"]: r["tier"] for r in graph.authority_labels(spark.createDataFrame([(1, 1.0), (2, 0.6), (3, 0.1)], "node long, pagerank double")).collect()}
    assert tiers == {1: "authority", 2: "strong", 3: "peripheral"}


def test_matching(spark):
    t = spark.createDataFrame([("ABABDABACDABABCABAB",), ("",), (None,)], "t string")
    assert [r[0] for r in t.select(strings.positions(F.col("t"), "ABABCABAB")).collect()] == [[10], [], []]
    assert strings.failure_function("ABABCABAB") == [0, 0, 1, 2, 0, 1, 2, 3, 4] and strings.failure_function("aaa") == [0, 1, 2]
    r = spark.createDataFrame([("aaaa",)], "t string").select(strings.rabin_karp(F.col("t"), "aa", mod=7).alias("r")).first()["r"]
    assert r["matches"] == [0, 1, 2] and r["hash_comparisons"] == 3


def test_searching_and_sorting(spark):
    rows = spark.createDataFrame(list(enumerate([1, 2, 2, 2, 3, 4])), "pos long, value long")
    assert [r["pos"] for r in strings.equal_range(rows, 2).orderBy("pos").collect()] == [1, 2, 3]
    assert strings.is_sorted(rows) and not strings.is_sorted(rows.union(spark.createDataFrame([(6, 0)], "pos long, value long")))
    assert tuple(strings.linear_search(rows, 9).first()) == (-1, 6)


def test_trie(spark):
    words = spark.createDataFrame([(1, "car"), (2, "cat")], "seq long, word string")
    assert strings.trie_nodes(words).count() + 1 == 5
    steps = strings.insert_trace(words).orderBy("seq", "step").collect()
    assert [r["action"] for r in steps] == ["create"] * 3 + ["follow", "follow", "create"]


def test_history(spark):
    h = spark.createDataFrame([(i, "q%d" % (i % 3), i % 2, float(i)) for i in range(10)], "id long, query string, result_count long, execution_time double")
    assert [r["id"] for r in relational.append_history(h.limit(0), h, 3).collect()] == [9, 8, 7]
    r = relational.search_statistics(h).first()
    assert (r["total_searches"], r["unique_queries"], r["empty_result_searches"], r["success_rate"]) == (10, 3, 5, 50.0)
    assert relational.search_statistics(h.limit(0)).first()["success_rate"] == 0
    assert relational.popular(h).first()["query"] == "q0"


def test_listing(corpus):
    page, total = relational.listing(corpus, limit=2, sort="title", search="SEARCH")
    assert [r["doc_id"] for r in page.collect()] == [1, 2] and total.first()["total"] == 3
    page, total = relational.listing(corpus, search="'; DROP TABLE documents; --")
    assert page.count() == 0 and total.first()["total"] == 0


def test_engine(corpus):
    from skeinwork.plans.engine import Engine

    e = Engine(corpus)
    found = e.search("graph search")
    assert found["results"].first()["doc_id"] == 1 and e.history.count() == 1
    with pytest.raises(ValueError):
        e.search("  ")
    assert {r["dst"] for r in e.related(1).collect()} == {2, 5}
    assert [r["node"] for r in e.traverse("bfs", start=1).orderBy("visit").collect()][0] == 1
    assert e.traverse("dijkstra", start=1).filter("node = 2").count() == 1
    words = sorted(r["term"] for r in e.index.vocabulary.collect())
    got = {r["algorithm"]: r["comparisons"] for r in e.compare_search("sorting").filter("found").collect()}
    assert got["linear"] == words.index("sort") + 1 and 1 <= got["binary"] <= len(words).bit_length() and got["trie"] == 4 and got["hash"] >= 1
    assert e.compare_search("zzz").filter("not found").count() == 4
    assert e.browse(category="food")["total"].first()["total"] == 2
    assert e.by_slug("soup").count() == 1 and e.terms("so").count() == 2 and e.stats()["index"].first()["documents"] == 5


def test_engine_changes(spark, corpus, tmp_path):
    from skeinwork.plans.engine import Engine

    old = Engine(corpus)
    old.search("graph")
    new = spark.createDataFrame([("Soup", "A second soup, of graphs and roots."), ("", "no title, so it is refused")], "title string, content string")
    e, refused = old.insert(new)
    assert refused.count() == 1 and e.corpus.filter("doc_id = 6 and slug = 'soup-1'").count() == 1 and e.history.count() == 1
    fresh = Index(e.corpus)
    same = lambda a, b, key: sorted(map(tuple, a.select(*key).collect())) == sorted(map(tuple, b.select(*key).collect()))
    for table, key in (("postings", ("term", "doc_id", "wtf")), ("vocabulary", ("term", "display", "doc_freq", "freq")), ("keywords", ("doc_id", "keyword", "rank"))):
        assert same(getattr(e.index, table), getattr(fresh, table), key)
    assert 6 in {r["doc_id"] for r in e.search("graph")["results"].collect()}
    e = e.update(spark.createDataFrame([(6, "Nothing of that kind any more.")], "doc_id long, content string"))
    assert 6 not in {r["doc_id"] for r in e.search("graph")["results"].collect()} and same(e.index.postings, Index(e.corpus).postings, ("term", "doc_id", "wtf"))
    e = e.delete([6, 4])
    assert e.corpus.count() == 4 and same(e.index.vocabulary, Index(e.corpus).vocabulary, ("term", "display", "doc_freq", "freq"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "new-text.txt").write_text("TITLE: Fresh\n-----\nA fresh text about tries.")
    (tmp_path / "in" / "bad.txt").write_text("tiny")
    e, refused = e.import_files(str(tmp_path / "in"))
    assert e.corpus.filter("title = 'Fresh'").count() == 1 and refused.count() == 1
    page = e.page("graph")
    shown = [r["doc_id"] for r in page["results"].collect()]
    e.click(shown[0])
    assert {r["doc_id"]: (r["times_shown"], r["times_clicked"]) for r in e.statistics().collect()} == {d: (1, int(d == shown[0])) for d in shown}
    assert e.with_hits().filter("doc_id = 1").first()["hits"] == 8 and e.most_matched(1).count() == 1
    last = e.history.agg(F.max("id")).first()[0]
    e.clear_history([last])
    assert e.history.filter(F.col("id") == last).count() == 0
    e.clear_history()
    assert e.history.count() == 0


def test_newest_first(index):
    assert [r["doc_id"] for r in ranking.Search(index).search("graph", sort="newest")["results"].collect()] == [5, 2, 1]


def test_authority_counts(index, spark):
    ranks = spark.createDataFrame([(i, float(i)) for i in range(1, 6)], "doc_id long, pagerank double")
    got = {r["doc_id"]: r["graph_signal"] for r in ranking.Search(index, ranks).results("graph").collect()}
    assert got == {1: 0.0, 2: 0.25, 5: 1.0}


def test_entries_are_grouped_where_ranges_put_them(index):
    dealt = index.all_tokens.repartitionByRange("term", "doc_id").groupBy("term", "doc_id").agg(F.sum("n"))
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in dealt._jdf.queryExecution().executedPlan().toString()


def test_paths_by_doubling(spark):
    rng = random.Random(4)
    parents = {0: None} | {i: rng.randrange(max(0, i - 3), i) for i in range(1, 70)}
    found = spark.createDataFrame(list(parents.items()), "node long, parent long")
    want = set()
    for goal in parents:
        at, way = goal, []
        while at is not None:
            way.append(at)
            at = parents[at]
        want |= {(goal, k, n) for k, n in enumerate(reversed(way))}
    assert {tuple(r) for r in graph.paths(found).select("goal", "step", "node").collect()} == want
    some = spark.createDataFrame([(69,), (3,), (500,)], "node long")
    assert {tuple(r) for r in graph.paths(found, some).select("goal", "step", "node").collect()} == {w for w in want if w[0] in (69, 3)}


def test_delta_stepping(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(60), rng.randrange(60), float(rng.choice([0, 1, 2, 5, 9]))) for _ in range(150)] + [(60 + i, 61 + i, 1.0) for i in range(30)] + [(5, 60, 3.0)]
    dist = {5: 0.0}
    for _ in range(120):
        for a, b, c in rows:
            if a in dist and dist[a] + c < dist.get(b, 1e9):
                dist[b] = dist[a] + c
    df = spark.createDataFrame(rows, "src long, dst long, cost double")
    for delta in (None, 4.0):
        history: list = []
        got = graph.shortest_paths(df, 5, delta=delta, history=history).collect()
        assert {r["node"]: r["dist"] for r in got} == dist and len(got) == len(dist)
        cost = {}
        for a, b, c in rows:
            cost[a, b] = min(c, cost.get((a, b), 1e9))
        assert all(r["parent"] is None if r["node"] == 5 else dist[r["parent"]] + cost[r["parent"], r["node"]] == r["dist"] for r in got)
        assert all(n < len(dist) for _, n, _ in history) and history[-1][2] == len(dist)
    near = graph.shortest_paths(df, 5, goal=60, delta=2.0).collect()
    assert {r["node"]: r["dist"] for r in near} == {n: d for n, d in dist.items() if d < 4} and len(near) < len(dist)


def test_cycle_witness(spark):
    rng = random.Random(8)
    for rows in ([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1)], [(7, 7)], [(i, (i + 1) % 37) for i in range(37)] + [(40, 3)], [(rng.randrange(20), rng.randrange(20)) for _ in range(40)]):
        got = graph.cycle_witness(edges(spark, rows)).orderBy("step").collect()
        assert [r["step"] for r in got] == list(range(len(got))) and len({r["node"] for r in got}) == len(got) > 0
        assert all((r["node"], r["next"]) in rows for r in got) and [r["next"] for r in got] == [r["node"] for r in got[1:] + got[:1]] and got[0]["node"] == min(r["node"] for r in got)
    assert graph.cycle_witness(edges(spark, [(1, 2), (2, 3)])).count() == 0


@pytest.mark.parametrize("least, bonus", [(0.18, 0.25), (0.5, 0.2), (0.6, 0.0)])
def test_similar_sets(spark, least, bonus):
    rng = random.Random(5)
    words = {i: {f"w{int(rng.paretovariate(0.7)) % 40}" for _ in range(rng.randint(1, 7))} for i in range(80)}
    words |= {100 + i: words[3] for i in range(10)}
    where = {i: rng.choice("ABC") for i in words}
    kw = spark.createDataFrame([(i, w.upper() if i % 2 else w) for i, own in words.items() for w in own], "doc_id long, keyword string")
    cats = spark.createDataFrame(list(where.items()), "doc_id long, category string")
    weight = lambda a, b: len(words[a] & words[b]) / len(words[a] | words[b]) + bonus * (where[a] == where[b])
    linked = {(a, b) for a in words for b in words if a < b and weight(a, b) >= least}
    classes, links = graph.similar_sets(kw, cats, least, bonus)
    own = {r["doc_id"]: r["class_id"] for r in classes.collect()}
    assert all(own[i] == min(j for j in words if words[j] == words[i] and where[j] == where[i]) for i in words)
    pairs = {(r["a"], r["b"]): r["weight"] for r in links.collect()}
    ids = sorted(set(own.values()))
    want = {(a, b) for a in ids for b in ids if a < b and (a, b) in linked and not (bonus >= least and where[a] == where[b])}
    assert set(pairs) == want and all(abs(w - min(1, weight(a, b))) < 1e-4 for (a, b), w in pairs.items())
    got = {r["doc_id"]: r["links"] for r in graph.link_counts(classes, links, least, bonus).collect()}
    assert got == {i: sum(i in p for p in linked) for i in words}


def test_rolling_hashes(spark):
    rng = random.Random(3)

    def plain(w, base, mod):
        h = 0
        for c in w:
            h = (h * base + ord(c)) % mod
        return h

    for base, mod in ((31, 1_000_003), (31, 7), (10, 1000), (257, 2**31 - 1)):
        for _ in range(20):
            text, m = "".join(rng.choices("abé😀 ", k=rng.randint(0, 60))), rng.randint(1, 6)
            codes = strings._codes(text)
            assert strings.rolling_hashes(codes, m, base, mod).tolist() == [plain(text[i : i + m], base, mod) for i in range(len(text) - m + 1)]
    df = spark.createDataFrame([("abé😀",), (None,), ("a",)], "t string")
    assert [r[0] for r in df.select(strings.window_hashes(F.col("t"), 2)).collect()] == [[plain(w, 31, 1_000_003) for w in ("ab", "bé", "é😀")], [], []]


def test_many_patterns_in_one_scan(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcé", k=rng.randint(0, 3000))) for _ in range(20)] + [None, ""]
    patterns = {"".join(rng.choices("abcé", k=rng.randint(5, 8))) for _ in range(1200)}
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {tuple(r) for r in strings.pattern_hits(rows, "id", "t", spark.createDataFrame([(p,) for p in [*patterns, ""]], "pattern string")).collect()}
    assert len(patterns) > 1000 and got == {(k, t[i : i + m], i) for k, t in enumerate(texts) if t for m in range(5, 9) for i in range(len(t) - m + 1) if t[i : i + m] in patterns}


def _files(folder):
    import os

    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_segments(spark, tmp_path):
    rng = random.Random(2)
    root = str(tmp_path / "index")
    words = ["graph", "graphs", "searching", "search", "sort", "water", "trees"] * 50 + ["".join(rng.choices("bdgkmnaeou", k=7)) for _ in range(3000)]
    word = lambda: rng.choice(words)
    row = lambda i, k=30: (i, f"{word()} {word()}", " ".join(word() for _ in range(k)), "c", [word()], 1)
    schema, have = "doc_id long, title string, content string, category string, keywords array<string>, hits long", {}
    ix = segments.SegmentedIndex.open(spark, root)

    def same(ix):
        full = Index(spark.createDataFrame(list(have.values()), schema))
        names = ["term", "display", "doc_freq", "freq", "total"]
        assert {tuple(r) for r in ix.vocabulary.select(*names).collect()} == {tuple(r) for r in full.vocabulary.select(*names).collect()}
        assert sorted(map(tuple, ix.entries.select("term", "doc_id", "wtf", "n").collect())) == sorted(map(tuple, full.entries.select("term", "doc_id", "wtf", "n").collect()))
        assert ix.size == len(have) and {r["doc_id"] for r in ix.documents.collect()} == set(have)

    first = [row(i, 300) for i in range(200)]
    have |= {r[0]: r for r in first}
    ix = ix.add(spark.createDataFrame(first, schema))
    same(ix)
    before = _files(root)
    have[7] = row(7)
    ix = ix.add(spark.createDataFrame([have[7]], schema))  # in place of an older one
    assert _files(root) - before < before / 3
    assert (ix.version, len(ix.segments)) == (2, 2)
    same(ix)
    for i in (3, 7):
        have.pop(i)
    ix = ix.delete(spark.createDataFrame([(3,), (7,), (999,)], "doc_id long"))
    same(ix)
    old = ix
    have[3] = row(3)
    ix = ix.add(spark.createDataFrame([have[3]], schema))  # the fourth segment of the lowest tier: they are merged
    assert len(ix.segments) == 1 and ix.segments[0]["tier"] == 1 and len(old.segments) == 3
    same(ix)
    assert old.size == len(have) - 1 and segments.SegmentedIndex.open(spark, root).version == ix.version
    ix.vacuum()
    same(segments.SegmentedIndex.open(spark, root))
    assert ix.documents_of(["sort"]).count() == ix.vocabulary.filter("term = 'sort'").first()["doc_freq"]


@pytest.mark.parametrize("least, bonus", [(0.18, 0.25), (0.5, 0.2), (0.6, 0.0)])
def test_overlap_sums(spark, least, bonus):
    """Links, neighbours and ranks of the similarity graph, none of which may write a row for each pair."""
    rng = random.Random(6)
    words = {i: {f"w{int(rng.paretovariate(0.7)) % 40}" for _ in range(rng.randint(1, 7))} for i in range(80)}
    words |= {100 + i: words[3] for i in range(10)} | {200: {"alone"}}
    where = {i: rng.choice("ABC") for i in words} | {200: "D"}
    kw = spark.createDataFrame([(i, w.upper() if i % 2 else w) for i, own in words.items() for w in own], "doc_id long, keyword string")
    cats = spark.createDataFrame(list(where.items()), "doc_id long, category string")
    weight = lambda a, b: len(words[a] & words[b]) / len(words[a] | words[b]) + bonus * (where[a] == where[b])
    linked = {a: {b for b in words if b != a and weight(a, b) >= least} for a in words}
    graphs = overlap.Overlaps(overlap.keyword_sets(kw, cats), least, bonus)
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in graphs.link_counts().collect()}
    assert got == {i: (min(j for j in words if words[j] == words[i] and where[j] == where[i]), len(linked[i])) for i in words}
    near = {r["dst"]: r["weight"] for r in graphs.linked_with(3).collect()}
    assert set(near) == linked[3] and all(abs(w - min(1, weight(3, b))) < 1e-4 for b, w in near.items())
    if bonus < least:
        return
    every = [*words, 900]  # 900 has no keywords
    want = dict.fromkeys(every, 1 / len(every))
    for _ in range(60):
        lost = sum(r for n, r in want.items() if not linked.get(n))
        want = {n: (0.15 + 0.85 * lost) / len(every) + 0.85 * sum(want[b] / len(linked[b]) for b in linked.get(n, ())) for n in every}
    have = {r["node"]: r["pagerank"] for r in graphs.pagerank(nodes(spark, *every), tolerance=1e-5).collect()}
    assert set(have) == set(want) and all(abs(have[n] - want[n]) < 1e-5 for n in want)
    with pytest.raises(ValueError):
        overlap.Overlaps(overlap.keyword_sets(spark.createDataFrame([(1, f"w{i}") for i in range(11)], "doc_id long, keyword string"), cats))


def test_index_counts_documents_where_they_lie(spark, corpus):
    """Terms and keywords of a document are made from its own row, without a shuffle, however many there are."""
    fresh = Index(corpus.drop("keywords"))
    from skeinwork.operators import index as module

    made = module.analysed(fresh.corpus)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    fresh.analysis = made  # not staged: the views over it have no shuffle either
    for view in (fresh.tokens, fresh.keywords, fresh.keyword_tables(), fresh.lengths):
        assert "Exchange" not in view._jdf.queryExecution().executedPlan().toString()
    rows = {r["doc_id"]: r for r in made.collect()}
    assert rows[5]["keywords"] == ["graph", "note", "noth"] and rows[5]["size"] == 5
    graph_row = next(x for x in rows[5]["terms"] if x["term"] == "graph")
    assert tuple(graph_row) == ("graph", 5, 2, 0, 1)


def test_window_sums(spark):
    """Sums are those of the hashes; the plan hands no array of hashes on."""
    df = spark.createDataFrame([(1, "abcdefé" * 5), (2, "abcd"), (3, None)], "id long, t string")
    got = df.select("id", strings.window_sums(F.col("t"), 5).alias("s"), strings.window_hashes(F.col("t"), 5).alias("h")).orderBy("id").collect()
    assert [tuple(r["s"]) for r in got] == [(len(r["h"]), sum(r["h"])) for r in got] and got[0]["s"]["windows"] == 31


def test_counted_stats(spark):
    """Statistics from numbers of edges are those of the edges."""
    e = spark.createDataFrame([(1, 2, "reference"), (1, 2, "similarity"), (2, 1, "similarity")], "src long, dst long, type string")
    counts = {t: e.filter(F.col("type") == t).agg(F.count(F.lit(1)).alias("n")) for t in ("reference", "similarity")}
    rows = [f.select("nodes", "edges", "reference_edges", "similarity_edges", "avg_degree").collect() for f in (graph.graph_stats(nodes(spark, 1, 2, 3), e), graph.counted_stats(nodes(spark, 1, 2, 3), counts))]
    assert rows[0] == rows[1] and rows[0][0]["edges"] == 3
