"""Sources of keywords: a pair of a keyword and a content costs one product of their vectors."""

from weftline.operators import keywords as K


def test_lengths_of_vectors_are_taken_before_pairs_are_made(spark):
    """Before, each pair took the lengths of both vectors anew, several times over."""
    keys = spark.createDataFrame([(1, "deep sea"), (1, " "), (2, "sea")], "k int, t string")
    catalog = spark.createDataFrame([(1, "a", 1, "deep deep sea"), (1, "a", 2, "sun"), (1, "a", 3, ""), (2, "b", 4, "sea")], "k int, type string, id int, excerpt string")
    found = K.attached_sources(keys, catalog, ["k"])
    rows = {(r["k"], r["t"]): [(x["id"], x["score"]) for x in r["sources"]] for r in found.collect()}
    assert rows == {(1, "deep sea"): [(1, round(3 / 10**0.5, 6))], (1, " "): [], (2, "sea"): [(4, 1.0)]}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("zip_with(__x") for line in plan.split("\n")) <= 2
