"""F16, F18: rows stay where they lie when many documents go; numbers are sent as bitmaps."""

import pytest

from skeinwork import session
from skeinwork.operators import segments
from skeinwork.operators.index import Index


@pytest.mark.parametrize("most", [200_000, 0])
def test_by_ids(spark, monkeypatch, most):
    monkeypatch.setattr(session, "BROADCAST_ROWS", most)
    ids = [-200, -65, -64, -63, -1, 0, 1, 31, 32, 62, 63, 64, 127, 128, 2**40, 2**62 + 63, None]
    rows = spark.createDataFrame([(i,) for i in [*range(-300, 300), 2**40, 2**40 + 1, 2**62 + 63, None]], "doc_id long")
    some = spark.createDataFrame([(i,) for i in ids * 2], "doc_id long")
    kept = {r[0] for r in session.by_ids(rows, some, "left_semi").collect()}
    assert kept == set(ids) - {None}
    assert {r[0] for r in session.by_ids(rows, some, "left_anti").collect()} == {r[0] for r in rows.collect()} - kept


def test_changes_do_not_shuffle_entries(spark, monkeypatch, tmp_path):
    plans, write = [], segments.SegmentedIndex._write
    monkeypatch.setattr(segments.SegmentedIndex, "_write", lambda self, n, table, rows: (plans.append((table, rows._jdf.queryExecution().executedPlan().toString())), write(self, n, table, rows))[1])
    docs = spark.createDataFrame([(i, "sorted words", f"graph w{i % 3} graphs", "a", 0) for i in range(30)], "doc_id long, title string, content string, category string, hits long")
    # Few rows as they are here, so that more than BROADCAST_ROWS were gone in the code before: 3 numbers, one bitmap.
    monkeypatch.setattr(session, "BROADCAST_ROWS", 1)
    ix = segments.SegmentedIndex(spark, str(tmp_path / "ix"))
    for part in ("doc_id < 10", "doc_id >= 10 and doc_id < 20", "doc_id >= 18"):
        ix = ix.add(docs.filter(part))
    ix = ix.delete(docs.filter("doc_id % 10 = 0").select("doc_id"))
    assert len(ix.segments) == 1 and ix.size == 27
    assert not [t for t, p in plans if t in ("entries", "forward") and ("rangepartitioning" in p or "hashpartitioning(doc_id" in p)]
    whole = Index(docs.filter("doc_id % 10 <> 0"))
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(ix.entries.select("term", "doc_id", "wtf", "n")) == order(whole.entries.select("term", "doc_id", "wtf", "n"))
    kept = Index(docs).without(docs.filter("doc_id % 10 = 0").select("doc_id"))
    assert order(kept.postings) == order(whole.postings)
