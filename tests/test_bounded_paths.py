"""Edges of shortest paths are made once, dealt by their number, and read by ranges of their source."""

from skeinwork import session
from skeinwork.operators import graph


def test_paths_read_once_by_ranges(spark, monkeypatch):
    """edges are made once, dealt by their number, and lie by ranges of src."""
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = [(i, i + 1, 1.0) for i in range(100)]
    edges = spark.createDataFrame(rows, "src long, dst long, cost double").mapInArrow(run, "src long, dst long, cost double")
    written, write = {}, session._write
    monkeypatch.setattr(session, "_write", lambda df, name, *sort: (out := write(df, name, *sort), written.setdefault(name, out))[0])
    got = graph.traverse(edges, "dijkstra", start=90)
    assert {r["node"]: r["dist"] for r in got.collect()} == {90 + i: float(i) for i in range(11)}
    assert made.value == 100
    by_file = written["paths-links"][1].selectExpr("input_file_name() f", "src").groupBy("f").agg({"src": "max", "*": "count"}).collect()
    assert len(by_file) >= 8 and max(r["count(1)"] for r in by_file) <= 20
