"""Similar pairs by blocks, against a plain double loop; nothing in their plans is dealt out by pairs."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest

from skeinwork.operators import graph


def plain(words, category, least, bonus):
    out = {}
    for a in words:
        for b in words:
            if a < b:
                shared, same = len(words[a] & words[b]), (category[a] or "Uncategorised").lower() == (category[b] or "Uncategorised").lower()
                w = shared / len(words[a] | words[b]) + (bonus if same else 0.0)
                if w >= least and (shared or same and bonus >= least):
                    out[a, b] = float(Decimal(repr(min(1.0, w))).quantize(Decimal("0.0001"), ROUND_HALF_UP))
    return out


@pytest.mark.parametrize("least, bonus, block", [(0.18, 0.25, 7), (0.3, 0.25, 1000), (0.3, 0.0, 16)])
def test_pairs_by_blocks(spark, least, bonus, block):
    rng = random.Random(3)
    words = {i * 3: set(rng.sample("abcdefghijkl", rng.randrange(1, 7))) for i in range(60)}
    category = {i: rng.choice(["x", "X", "y", None]) for i in words}
    kw = spark.createDataFrame([(i, k.upper() if rng.random() < 0.5 else k) for i, ks in words.items() for k in ks], "doc_id long, keyword string")
    sets = graph.keyword_ids(kw, spark.createDataFrame([*category.items(), (999, "x")], "doc_id long, category string"))
    pairs = graph.pairs_of(sets, least, bonus, block)
    got = [tuple(r) for r in pairs.collect()]
    want = plain(words, category, least, bonus)
    assert len(got) == len(want) and {(a, b): w for a, b, w in got} == want
    refs = spark.createDataFrame([(a, b, 0, "reference", 1.0) for a in (0, 3, 6, 999) for b in (0, 9, 12, 15, 999) if a != b], "src long, dst long, pos int, type string, weight double")
    found = {(r["src"], r["dst"]): r["w"] for r in graph.similarity_weights(refs, sets, least, bonus).collect()}
    assert found == {(r["src"], r["dst"]): want.get((min(r["src"], r["dst"]), max(r["src"], r["dst"]))) for r in refs.collect()}
    if (least, bonus) == (0.18, 0.25):
        edges = lambda g: sorted(map(tuple, g.select("src", "dst", "type", "weight").collect()))
        assert edges(graph.document_graph(refs, pairs, sets)) == edges(graph.document_graph(refs, pairs))
        cost = lambda c: sorted((r["src"], r["dst"], round(r["cost"], 9)) for r in c.collect())
        assert cost(graph.document_costs(refs, pairs, sets)) == cost(graph.costs(graph.document_graph(refs, pairs)))
    for df in (graph.document_costs(refs, pairs, sets), graph.document_graph(refs, pairs, sets).select("src", "dst", "type", "weight")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("FlatMapGroupsInArrow") == 1 and "Window" not in plan
