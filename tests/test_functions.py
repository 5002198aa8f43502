"""Functions that SQL does not express, and edge cases of operators."""

import html as entities
import math
import re

import pytest
from pyspark.sql import Row, functions as F

from weftline.functions import chunk, html, text as T
from weftline.functions.graph import components
from weftline.models import scorers
from weftline.operators import search as S, tables as R, training, vectors as V
from weftline.sources import objects
from weftline.streaming.drain import drain

LONG = "One sentence here. " * 40 + "word " * 300 + "x" * 500 + ". Is it? Yes! " * 30


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text", [None, "", " \n \n", "short  text", LONG, LONG.replace(". ", ".\n"), "y" * 900])
def test_chunks(spark, text):
    got = value(spark, chunk.chunked(F.lit(text).cast("string"), 300))
    assert all(len(x) <= 300 or " " not in x for x in got)
    words = re.sub(r"\s+", " ", text or "").split()
    if len(set(got)) == len(got) and "One sentence" not in (text or ""):
        assert " ".join(got).split() == words
    # Whole sentences of up to 300 characters are never cut.
    assert not any(x.startswith("sentence here") for x in got)
    assert [x.lower() for x in got] == list(dict.fromkeys(x.lower() for x in got))


def test_chunk_packing():
    assert chunk.pieces("Aa bb. Cc dd. Ee ff.", 14) == ["Aa bb. Cc dd.", "Ee ff."]
    assert chunk.pieces("aaa bbb ccc ddd. Ee.", 8) == ["aaa bbb", "ccc ddd.", "Ee."]


def test_html(spark):
    page = "<html><head><style>p{}</style><script>var a='<p>'</script></head><body><h1> A &amp; B </h1><p>x<br>y<b>z</b></p><ul><li>1<li>2</ul></body></html>"
    assert value(spark, html.to_text(F.lit(page))) == "A & B\nx\nyz\n1\n2"
    assert value(spark, html.to_text(F.lit(None).cast("string"))) is None
    assert value(spark, html.stripped(F.lit("<p> a&nbsp;&lt;b&gt;\n c</p>"))) == "a <b> c"
    assert value(spark, html.stripped(F.lit("<br/> "))) is None
    assert value(spark, html.stripped(F.lit("&eacute;"))) == entities.unescape("&eacute;")


def test_fuzzy(spark):
    rows = spark.createDataFrame([(1, "deep sea life", "deep sea lives", 0), (1, "deep sea life", "deep sea life", 1), (2, "a", "b", 0), (3, "same words", "same words", 3)], "k int, title string, candidate string, place int")
    assert [r["place"] for r in training.fuzzy_matches(rows, ["k"], "title", "candidate").collect()] == [0]


def test_ids_of_two_tables_are_apart(spark):
    people = spark.createDataFrame([(7, [1.0, 0.0], None), (8, None, None)], "id bigint, first array<double>, second array<double>")
    goals = spark.createDataFrame([(7, [1.0, 0.0], [0.0, 1.0]), (9, [0.0, 2.0], None), (10, [1.0, 0.0, 0.0], None)], "id bigint, first array<double>, second array<double>")
    found = {(r["query_id"], r["item_id"]): r["score"] for r in V.top_k(people, goals, 5, 0.0).collect()}
    assert found == {(7, 7): 1.0, (7, 9): 0.0, (7, 10): 0.0, (8, 7): 0.0, (8, 9): 0.0, (8, 10): 0.0}
    assert (7, 7) not in {(r["query_id"], r["item_id"]) for r in V.top_k(people, goals, 5, 0.0, skip_equal_ids=True).collect()}
    assert V.top_k(people.limit(0), goals, 5, 0.0).count() == 0


def test_cosine_of_odd_vectors(spark):
    zero, none = F.array(F.lit(0.0)), F.lit(None).cast("array<double>")
    assert value(spark, V.cosine(zero, F.array(F.lit(1.0)))) == 0.0
    assert value(spark, V.cosine(none, zero)) is None
    assert value(spark, V.unit(none)) is None


def test_lexical_score(spark):
    score = lambda q, c: value(spark, T.lexical_score(F.lit(q), F.lit(c)))
    assert score("the of", "anything") == 0.0
    assert score("Deep  Sea", "the deep sea") == 1.0
    assert score("deep ocean", "deep sea") == 0.5
    assert math.isclose(score("deep sea life of fish under ice", "deep sea life fish under the lake"), min(1.0, 5 / 6 + 0.15), abs_tol=1e-9)


def test_operations_on_unknown_rows_fail(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    ops = spark.createDataFrame([(2, "b", "update")], "k int, v string, operation string")
    with pytest.raises(Exception, match="no such row"):
        R.apply_operations(old, ops, ["k"]).collect()
    assert R.apply_operations(old, ops.withColumn("operation", F.lit("delete")), ["k"]).collect() == [Row(k=1, v="a")]


def test_years(spark):
    with pytest.raises(ValueError):
        S.within_years(spark.range(1).withColumn("year", F.lit(1)), "year", 3, 2)


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(50, 60), (60, 55), (7, 7)]
    found = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {found[i] for i in range(31)} == {0} and {found[i] for i in (50, 55, 60)} == {50}


def test_given_functions(spark):
    rows = spark.createDataFrame([(1, " a "), (2, ""), (3, "a"), (4, None)], "k int, text string")
    found = {r["k"]: r["v"] for r in scorers.embedded(rows, "text", "v", lambda texts: [[float(len(t))] for t in texts]).collect()}
    assert found == {1: [1.0], 2: None, 3: [1.0], 4: None}
    pairs = rows.select("text", F.lit("b").alias("spec")).filter("k = 1")
    assert scorers.pair_scorer(lambda a, b: [0.25] * len(a))(pairs).first()["score"] == 0.25


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    rows, run = f"file://{tmp_path}/in", f"file://{tmp_path}/run"
    spark.range(3).write.parquet(rows)
    assert drain(spark, rows, lambda r: r, run, F.col("id") == 1).filter("status = 'failed'").count() == 1
    spark.range(3, 5).write.mode("append").parquet(rows)
    assert sorted(r["id"] for r in drain(spark, rows, lambda r: r, run, F.col("id") == 1).collect()) == [0, 1, 2, 3, 4]


def test_noise_is_looked_for_once(spark):
    """One pattern for all of NOISE says what its parts say; kept elements are known by a short key and cleaned once."""
    fill = "plain words that stand around it so that the line is long enough to count "
    hits = ["COOKIES", "cookie", "Privacy Policy", "skip to content", "skip to main content", "log out", "sitemap", "non-discrimination", "back to top"]
    lines = [fill + x for x in [*hits, "cookiess", "xmenu", "research", "signing in", "menus", "copyrights", "skip to the content", "loginx"]]
    lines += ["A" * 50, "1234567 " * 9 + "letters here", "ÉTÉ " * 12, "www.example.org/" + "a" * 60 + " five more words stand here", "short", "", None]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, t string")
    got = {r["i"]: r["n"] for r in docs.select("i", T.noisy(F.col("t")).alias("n")).collect()}
    old = re.compile("(?i)" + "|".join(T.NOISE))
    assert {i: got[i] for i, x in enumerate(lines[:17])} == {i: bool(old.search(x)) for i, x in enumerate(lines[:17])}
    assert all(got[i] for i in range(17, len(lines)))
    rows = spark.createDataFrame([(1, 3, "Text", fill + "A b"), (1, 2, "Text", fill + " a \n\n B"), (1, 1, "Footer", fill), (2, 1, "Text", fill)], "d int, place int, kind string, text string")
    kept = objects.kept_elements(rows, ["d"])
    assert {(r["d"], r["place"], r["text"]) for r in kept.collect()} == {(1, 2, (fill + " a").rstrip() + "\nB"), (2, 1, fill.rstrip())}
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" in plan and plan.count("array_join") == 1
