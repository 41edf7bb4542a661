from pyspark.sql import functions as F

from skeinwork.sources import corpus as C
from skeinwork.streaming import incremental

ROW = "slug string, title string, category string, author string, keywords array<string>, summary string, content string"


def test_text_files_round_trip(spark, tmp_path):
    rows = [("one", "One", "A", "Me", ["x", "y"], "Sum", "First body.\nSecond line."), ("two", "Two", "B", "You", [], "", "Another body here.")]
    C.write_text_files(spark.createDataFrame(rows, ROW), str(tmp_path / "out"))
    got = {r["title"]: r for r in C.read_text_files(spark, str(tmp_path / "out" / "*" / "*.txt")).collect()}
    assert set(got) == {"One", "Two"}
    assert got["One"]["content"] == "First body.\nSecond line." and got["One"]["keywords"] == ["x", "y"] and got["One"]["accepted"] and got["Two"]["keywords"] == []


def test_files_without_header_and_limits(spark, tmp_path):
    (tmp_path / "my-notes.txt").write_bytes(b"Just a long enough body \xff.")
    (tmp_path / "short.md").write_text("tiny")
    (tmp_path / "image.png").write_text("long enough but no text file")
    got = {r["path"].rsplit("/", 1)[1]: r for r in C.read_text_files(spark, str(tmp_path)).collect()}
    assert got["my-notes.txt"]["title"] == "My Notes" and got["my-notes.txt"]["accepted"]
    assert got["short.md"]["reason"] == "content is too short" and got["image.png"]["reason"] == "type"


def test_validation_and_slugs(spark):
    rows = spark.createDataFrame([("Same", "content one is long."), ("Same", "content two is long."), ("", "long enough content"), ("No", "no")], "title string, content string")
    got = C.validated(rows, spark.createDataFrame([("no",)], "slug string")).collect()
    ok = sorted((r["slug"], r["summary"], r["hits"]) for r in got if r["error"] is None)
    assert ok == [("same", "content one is long.", 1), ("same-1", "content two is long.", 1)]
    assert sorted(r["error"] for r in got if r["error"]) == ["content is too short", "title is required"]


def slugs_by_hand(titles, old):
    """Bare slugs first, then the least free numbers."""
    taken, out, rest = set(old), [], []
    for t in sorted(titles):
        s = "-".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) or "document"
        if s in taken:
            rest.append(s)
        else:
            taken.add(s)
            out.append(s)
    for s in rest:
        n = next(n for n in range(1, 10_000) if f"{s}-{n}" not in taken)
        taken.add(f"{s}-{n}")
        out.append(f"{s}-{n}")
    return sorted(out)


def test_slugs_are_unique(spark):
    for titles, old in ((["A", "A 1", "A"], []), (["A"], ["a", "a-1"]), (["A"] * 5 + ["A 2", "A 4", "B"], ["a-1", "a-6", "b", "b-2"]), (["x y"] * 3 + ["X-Y 1"] * 3, ["x-y-1-1"])):
        got = C.validated(spark.createDataFrame([(t, f"content number {i} is long") for i, t in enumerate(titles)], "title string, content string"), spark.createDataFrame([(s,) for s in old], "slug string"))
        assert sorted(r["slug"] for r in got.collect()) == slugs_by_hand(titles, old)


def test_repeated_updates(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, category string, content string")
    changes = spark.createDataFrame([(1, "first", None, 1), (1, None, "new text", 2), (1, "last", None, 3), (9, "nobody", None, 1)], "doc_id long, category string, content string, seq int")
    assert sorted(map(tuple, C.apply_updates(docs, changes).collect())) == [(1, "last", "new text"), (2, "b", "y")]
    assert C.apply_updates(docs, changes.drop("seq")).filter("doc_id = 1").count() == 1


def test_stored_corpus(spark, tmp_path):
    path = str(tmp_path / "corpus")
    rows = C.from_rows(spark, [{"doc_id": 1, "title": "One", "content": "Some long content."}])
    assert rows.first()["hits"] == 1 and rows.first()["is_published"] and C.is_empty(spark, path)
    assert C.bootstrap(spark, path) and C.is_empty(spark, path) and C.bootstrap(spark, path, rows) and not C.bootstrap(spark, path, rows) and not C.is_empty(spark, path)


def test_seed_update_delete(spark):
    old = spark.createDataFrame([(1, "a", "old text")], "doc_id long, slug string, content string")
    new = spark.createDataFrame([(2, "a", "x"), (3, "b", "y")], "doc_id long, slug string, content string")
    seeded = C.seed(old, new)
    assert sorted(r["slug"] for r in seeded.collect()) == ["a", "b"] and C.seed(seeded, new).count() == 2
    up = C.apply_updates(seeded.withColumn("token_count", F.lit(2).cast("long")), spark.createDataFrame([(3, "one two three")], "doc_id long, content string"))
    assert {r["doc_id"]: (r["content"], r["token_count"]) for r in up.collect()} == {1: ("old text", 2), 3: ("one two three", 3)}
    assert C.delete(seeded, spark.createDataFrame([(1,)], "doc_id long")).count() == 1


def test_stream_keeps_the_last_version(spark, tmp_path):
    schema = "doc_id long, title string, content string"
    for number, rows in enumerate([[(1, "One", "alpha beta"), (2, "Two", "gamma")], [(1, "One", "delta")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in" / str(number)))
        s = spark.readStream.schema(schema).json(str(tmp_path / "in" / "*"))
        incremental.keep_postings(s, str(tmp_path / "postings"), str(tmp_path / "state")).awaitTermination(120)
    got = {(r["doc_id"], r["term"]) for r in incremental.latest(spark, str(tmp_path / "postings")).collect()}
    assert (1, "delta") in got and (2, "gamma") in got and (1, "alpha") not in got


def test_streams_take_last_versions_and_deletions(spark, tmp_path):
    schema = "doc_id long, seq long, title string, content string, deleted boolean"
    batches = [[(1, 1, "One", "alpha", False), (1, 2, "One", "beta", False), (2, 1, "Two", "gamma", False)], [(2, 2, "Two", "gamma", True), (3, 1, "Three", "delta", False)]]
    path = str(tmp_path / "postings")
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in" / str(number)))
        s = spark.readStream.schema(schema).json(str(tmp_path / "in" / "*"))
        incremental.keep_postings(s, path, str(tmp_path / "state"), buckets=4).awaitTermination(120)
    terms = lambda p: {(r["doc_id"], r["term"]) for r in incremental.latest(spark, p).collect()}
    assert terms(path) == {(1, "one"), (1, "beta"), (3, "three"), (3, "delta")}
    incremental.compact(spark, path, str(tmp_path / "compact"))
    assert terms(str(tmp_path / "compact")) == terms(path) and spark.read.parquet(str(tmp_path / "compact")).count() < spark.read.parquet(path).count()


def test_staged_tables_go(spark):
    import os

    from skeinwork import session

    rounds = session.Rounds(spark, "t")
    for i in range(3):
        last = rounds(spark.range(i + 1))
    assert last.count() == 3 and len(rounds.paths) == 1 and os.path.exists(rounds.paths[0])


def test_command_line(spark, tmp_path, capsys):
    from skeinwork import __main__ as cli

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"note-{i}.txt").write_text(f"TITLE: Note\nKEYWORDS: a, b\n-----\nThe text of note number {i}.")
    files, corpus, index = (str(tmp_path / n) for n in ("in", "corpus", "index"))
    for _ in range(2):  # a second time changes nothing
        cli.main(["seed", files, corpus])
        cli.main(["reindex", corpus, index])
    assert "3 documents" in capsys.readouterr().out and sorted(r["slug"] for r in spark.read.parquet(corpus).collect()) == ["note", "note-1", "note-2"]
    assert spark.read.parquet(f"{index}/entries").filter("term = 'note'").count() == 3


def test_long_bodies_are_split_once_behind_the_header(spark):
    """The lines behind the eleventh stay one piece; line ends are mended in all of them as before."""
    lines = ["TITLE: T", "-----", *[f"line {i}" for i in range(30)], "tail\r"]
    df = spark.createDataFrame([("\r\n".join(lines) + "\r\nend",)], "t string")
    made = df.select(C.parse_file(F.col("t"), F.lit("/x/a.txt"))["content"].alias("b"))
    assert made.first()["b"] == "\n".join([*lines[2:], "end"])
    assert ", 12)" in made._jdf.queryExecution().optimizedPlan().toString()
