"""Texts are not dealt out again where the hashes of a few lines do."""

import random

import numpy as np

from skeinwork.llm import common, quality_rules

from test_ops import counted, frame, plain_cleaning


def test_lines_by_both_hashes():
    rng = random.Random(5)
    have = [(rng.randrange(-4, 4), rng.randrange(-(1 << 62), 1 << 62)) for _ in range(50)]
    ask = have[::3] + [(a, b + 1) for a, b in have] + [(9, 0), (-9, 0)]
    lines = quality_rules.LineSet(*np.array(have, np.int64).T)
    assert lines.contains(*np.array(ask, np.int64).T).tolist() == [x in set(have) for x in ask]
    none = np.zeros(0, np.int64)
    assert lines.contains(none, none).tolist() == [] and quality_rules.LineSet(none, none).contains(np.ones(2, np.int64), np.ones(2, np.int64)).tolist() == [False, False]


def test_no_text_is_shuffled_for_its_lines(spark):
    rows = [(i, "\n".join(["menu of this host", f"own words {i} " * 12, "", "Menu of  this host"]), "en", None if i % 5 == 0 else f"s{i % 2}") for i in range(40)] + [(99, None, "en", "s1")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if there were many lines to remove
    try:
        found = quality_rules.cleaned(frame(spark, rows), limit=6)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        want = [(r[0], x) for r, x in zip(rows, plain_cleaning(rows, 6))]
        assert counted(map(tuple, common.pick(found, "doc_id", "text").collect())) == counted(want)
        assert "Exchange" not in quality_rules.keep_good(frame(spark, rows), limit=6)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
