import logging

import __spark_entry__ as entry


def test_missing_parts_are_left_out(caplog):
    with caplog.at_level(logging.WARNING):
        assert entry._optional("skeinwork.no_such_part") is None and "no_such_part" in caplog.text


def test_broken_parts_are_left_out(tmp_path, monkeypatch, caplog):
    (tmp_path / "broken_part_of_a_test.py").write_text("def (:\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with caplog.at_level(logging.WARNING):
        assert entry._optional("broken_part_of_a_test") is None and "broken_part_of_a_test" in caplog.text


def test_queries_and_their_sql():
    queries = entry.queries()
    assert all(callable(q) for q in queries.values()) and set(entry.oracle_sql()) <= set(queries)
    assert all(isinstance(s, str) and s.strip() for s in entry.oracle_sql().values())


def test_smoke(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20 and [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
