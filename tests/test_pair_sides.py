"""Documents are sent once for each side of pairs, not once for each block, and all pairs are found."""

import random
import re

import pytest

from skeinwork.operators import graph
from test_pairs import plain


@pytest.mark.parametrize("tabled", [128, 2])
def test_rows_sent(spark, monkeypatch, tabled):
    """each of 65 documents was sent 22 times, once for each block of 3."""
    monkeypatch.setattr(graph, "TABLED", tabled, raising=False)
    rng = random.Random(4)
    words = {i * 3: set(rng.sample("abcdefghijkl", rng.randrange(1, 7))) for i in range(65)}
    category = {i: rng.choice("xyz") for i in words}
    kw = spark.createDataFrame([(i, k) for i, ks in words.items() for k in ks], "doc_id long, keyword string")
    sets = graph.keyword_ids(kw, spark.createDataFrame([*category.items()], "doc_id long, category string"))
    ends, sequence = [], graph.F.sequence
    monkeypatch.setattr(graph.F, "sequence", lambda start, end: (ends.append(end), sequence(start, end))[1])
    pairs = graph.pairs_of(sets, 0.18, 0.25, 3)
    got, want = [tuple(r) for r in pairs.collect()], plain(words, category, 0.18, 0.25)
    assert len(got) == len(want) and {(a, b): w for a, b, w in got} == want
    sides = int(re.search(r"\d+", str(ends[0]))[0]) + 1
    assert sides <= max(-(-22 // 16), (8 * spark.sparkContext.defaultParallelism) ** 0.5 + 1)
