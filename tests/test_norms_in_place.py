"""Norms shuffle no rows of frequent terms, and need no entries."""

import math
from collections import Counter, defaultdict

import pytest

from skeinwork import session
from skeinwork.operators.index import Index


@pytest.mark.parametrize("sent", [0, 3, 8, 1000])
def test_norms(spark, monkeypatch, sent):
    """entries were written and each row was shuffled by its term, once the vocabulary was larger than what is sent; norms and their documents are the same for any such number."""
    rows = [(i, f"Theory of thing{i % 3}", f"the thing and theory of graphs number{i} merges sorted sort", "c", i) for i in range(12)] + [(12, "", "", "c", 0)]
    ix = Index(spark.createDataFrame(rows, "doc_id long, title string, content string, category string, hits long"))
    monkeypatch.setattr(session, "BROADCAST_ROWS", sent)
    got = {r["doc_id"]: (r["squares"], r["terms"]) for r in ix.squares.collect()}
    norms = {r["doc_id"]: r["norm"] for r in ix.norms.collect()}
    assert "entries" not in ix.__dict__
    bag = [tuple(r) for r in ix.bag.collect()]
    df, want = Counter(t for t, _, _ in bag), defaultdict(list)
    for t, d, n in bag:
        want[d].append((n * (math.log((1 + len(rows)) / (1 + df[t])) + 1)) ** 2)
    assert set(got) == set(norms) == set(want) and 12 not in got
    assert all(math.isclose(got[d][0], sum(x)) and got[d][1] == len(x) and math.isclose(norms[d] ** 2, sum(x)) for d, x in want.items())
    assert (ix._frequent == 0) == (len(df) <= sent)
    reach = sorted(df.values(), reverse=True)
    assert not ix._frequent or sum(n >= ix._frequent for n in reach) <= sent
