"""PageRank over lists of targets: the same ranks, parallel edges and split hubs included, and rows by node and not by edge."""

from skeinwork import session
from skeinwork.operators import graph


def test_lists_of_targets(spark, monkeypatch):
    edges = [(0, i) for i in range(1, 40)] + [(0, 1), (0, 1)] + [(i, (i * 7) % 40) for i in range(1, 30)] + [(5, 99)]
    written, stage = {}, session.staged
    monkeypatch.setattr(session, "staged", lambda df, name, *sort: written.setdefault(name, stage(df, name, *sort)))
    monkeypatch.setattr(graph, "LIST", 8)
    nodes = spark.createDataFrame([(i,) for i in range(40)], "node long")
    got = {r["node"]: r["pagerank"] for r in graph.pagerank(nodes, spark.createDataFrame(edges, "src long, dst long"), iterations=3, tolerance=None).collect()}
    known = [e for e in edges if e[1] < 40]
    out = {i: sum(a == i for a, _ in known) for i in range(40)}
    rank = dict.fromkeys(range(40), 1 / 40)
    for _ in range(3):
        lost = sum(r for i, r in rank.items() if not out[i])
        rank = {i: 0.15 / 40 + 0.85 * (lost / 40 + sum(rank[a] / out[a] for a, b in known if b == i)) for i in rank}
    assert all(abs(got[i] - rank[i]) < 1e-12 for i in rank)
    links = written["pagerank-links"]
    assert links.count() < len(set(known)) and links.selectExpr("max(size(targets)) m").first()["m"] < 39
