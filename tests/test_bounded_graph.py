"""Loops over a graph send none of its nodes by way of the driver."""

from skeinwork import session
from skeinwork.operators import graph


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cycle_without_broadcast(spark, monkeypatch):
    """pointers and nodes are shuffled; rounds follow the walk, not the nodes."""
    rows = [(i, (i + 1) % 3) for i in range(3)] + [(100 + i, 100 + (i + 1) % 64) for i in range(64)]
    plans, names, write = [], [], session._write
    monkeypatch.setattr(session, "_write", lambda df, name, *sort: (plans.append(plan(df)), names.append(name), write(df, name, *sort))[2])
    got = graph.cycle_witness(spark.createDataFrame(rows, "src long, dst long"))
    assert [tuple(r) for r in got.orderBy("step").collect()] == [(0, 0, 1), (1, 1, 2), (2, 2, 0)]
    assert names.count("cycle-walk") == 2 and names.count("cycle-jumps") == 1
    assert "BroadcastHashJoin" not in "".join(plans) + plan(got)
