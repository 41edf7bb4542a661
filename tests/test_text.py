import random

import pytest
from pyspark.sql import functions as F

from skeinwork.functions import text as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("Hello,  WORLD!", "hello world"), ("Crème brûlée", "creme brulee"), (None, ""), ("été", "ete"), ("  ", ""), ("a-b_c", "a b c")])
def test_normalize(spark, raw, want):
    assert one(spark, raw, X.normalize) == want == X.normal_form(raw)
    assert one(spark, raw, X.normalize_exact) == want


def test_compatibility_forms_need_the_exact_one(spark):
    assert one(spark, "ﬁne", X.normalize_exact) == "fine"


def test_tokens(spark):
    assert one(spark, "The quick brown foxes", X.tokenize) == ["quick", "brown", "foxes"]
    assert one(spark, "The quick a", X.stop_words_removed) == ["the", "a"]
    assert one(spark, None, X.tokenize) == []


def test_stem_words(spark):
    cases = {"sorting": "sort", "running": "run", "algorithms": "algorithm", "classes": "clas", "studies": "study", "using": "using", "graphs": "graph", "is": "is", "ab12ing": "ab12ing", "moved": "mov", "enabled": "enable"}
    rows = spark.createDataFrame([(k,) for k in cases], "surface string").withColumn("term", X.stem("surface")).collect()
    assert {r["surface"]: r["term"] for r in rows} == cases == {k: X.stem_word(k) for k in cases}


def test_stem_column_and_function_agree_on_random_words(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abelst") for _ in range(rng.randint(1, 4))) + rng.choice(["", *X.SUFFIXES]) for _ in range(2000)]
    rows = spark.createDataFrame([(w,) for w in words], "surface string").withColumn("term", X.stem("surface")).collect()
    assert all(r["term"] == X.stem_word(r["surface"]) for r in rows)


def test_phrases(spark):
    assert one(spark, 'find "binary search" please', X.extract_phrases) == ["binary search"]
    assert one(spark, '"how to" sort', X.extract_phrases) == []
    q = X.analyze_query('sorted graphs "Merge Sort" the')
    assert q["tokens"] == ["sort", "graph"] and q["phrases"] == ["merge sort"] and q["stop_words_removed"] == ["the"]
    assert X.analyze_query("the and of")["is_empty"]


def test_slugs_links_and_lists(spark):
    assert one(spark, "--Hello, World!", X.slugify) == "hello-world"
    assert one(spark, "!!!", X.slugify) == "document"
    assert one(spark, "see [[Alpha-1]] and [[beta]]", X.extract_links) == ["alpha-1", "beta"]
    assert one(spark, " a, ,b ", X.split_keywords) == ["a", "b"]
    assert one(spark, "3, 4.6 x", X.parse_integers) == [3, 5]
    assert [tuple(r) for r in one(spark, "A-B:4, B-C, C-D:x, E-E:2", X.parse_edges)] == [("A", "B", 4.0), ("B", "C", 1.0), ("C", "D", 1.0)]


def test_snippet_escapes_and_marks_once(spark):
    got = one(spark, "A <script>alert(1)</script> graph about graphs.", lambda c: X.snippet(c, ["graph"]))
    assert got == "A &lt;script&gt;alert(1)&lt;/script&gt; <mark>graph</mark> about graphs."
    assert one(spark, "", lambda c: X.snippet(c, ["graph"])) == ""
    assert one(spark, "fish & chips", lambda c: X.snippet(c, ["amp", "chips"])) == "fish &amp; <mark>chips</mark>"
    assert one(spark, "a & b amp \ue000", lambda c: X.snippet(c, ["amp", "&"])) == "a <mark>&amp;</mark> b <mark>amp</mark> "
    assert one(spark, "it's quot it", lambda c: X.snippet(c, ["quot", "it's"])) == "<mark>it&#x27;s</mark> <mark>quot</mark> it"
    long = one(spark, "x" * 300 + " graph " + "y" * 300, lambda c: X.snippet(c, ["graph"]))
    assert long.startswith("...") and long.endswith("...") and "<mark>graph</mark>" in long


@pytest.mark.parametrize("text, pattern, want", [("abababab", "abab", 3), ("abc", "", 0), ("ab", "abcdef", 0), ("a.b.", ".", 2), ("x\\Ey", "\\E", 1)])
def test_count_overlapping(spark, text, pattern, want):
    assert one(spark, text, lambda c: X.count_overlapping(c, pattern)) == want


def test_sql_functions(spark):
    X.register(spark)
    r = spark.sql("SELECT sk_normalize('Hé, LLo') n, sk_stem('sorting') s, sk_slugify('A b!') g, sk_djb2('ab') d, sk_poly('ab') p").first()
    assert tuple(r) == ("he llo", "sort", "a-b", 5863208, 97 * 31 + 98)


def test_presentation_and_statements(spark):
    from skeinwork import session
    from skeinwork.operators import strings

    r = spark.createDataFrame([(0.5, 1234.0, 0.256)], "a double, b double, c double").select(X.format_ms(F.col("a")), X.format_compact(F.col("b")), X.format_percent(F.col("c"))).first()
    assert tuple(r) == ("0.500 ms", "1.2K", "25.6%")
    assert session.scalar(spark, "SELECT :x + 1", x=2) == 3 and session.scalar(spark, "SELECT null", default=7) == 7


def test_analysis_keeps_forms_together(spark):
    r = one(spark, "The Sorting of graphs", lambda c: X.analyze(c, F.array(F.lit("sort"), F.lit("graph"))))
    assert r["raw"] == "The Sorting of graphs" and [tuple(p) for p in r["pairs"]] == [("sort", "sorting"), ("graph", "graphs")]
    assert one(spark, "Graphs, graph theory", lambda c: X.matched_terms(c, ["theory", "grap", "graph"])) == ["theory", "graph"]
    assert one(spark, "C-A:2, A-B, x, B-C", lambda c: X.edge_nodes(X.parse_edges(c))) == ["C", "A", "B"]


def test_stems_agree(spark):
    words = ["hopping", "hoped", "cities", "relational", "running", "sized", "falling", "bless", "as", "x1ing", "usly", "stables", "agreed", "queuing", "aaing", "tabled"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in rows.select(X.stem("w")).collect()] == [X.stem_word(w) for w in words]
