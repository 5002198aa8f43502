"""Matching inputs in parts, so that no row grows with a goal's people."""

import hashlib

from pyspark.sql import functions as F

from weftline.operators import payloads as P


def test_parts_of_matching_inputs_are_bounded_and_whole(spark):
    """Before, all people of a goal were one row."""
    members = spark.createDataFrame([(g, p, n, p / 100) for g in "ab" for p in (7, 3, 90, 12, 5, 1, 44) for n in ("y", "x")], "goal string, person bigint, name string, c double")
    needs = spark.createDataFrame([(g, n, 0.5) for g in "abc" for n in ("x", "y")], "goal string, name string, weight double")
    scores = spark.createDataFrame([("a", 3, 0.1), ("a", 8, 0.9), ("b", 44, 0.2)], "goal string, person bigint, score double")
    whole = {r["goal"]: r for r in P.matching_inputs(needs, members, scores).collect()}
    parts = P.matching_parts(needs, members, scores, 3)
    rows = parts.orderBy("goal", "part").collect()
    assert max(len(r["people"]) for r in rows) == 3 and {r["goal"] for r in rows} == set(whole) == {"a", "b"}
    for goal, want in whole.items():
        own = [r for r in rows if r["goal"] == goal]
        assert [p for r in own for p in r["people"]] == want["people"]
        assert {k: v for r in own for k, v in r["coverage"].items()} == want["coverage"]
        assert {k: v for r in own for k, v in r["scores"].items()} == want["scores"]
        assert all(r["requirements"] == want["requirements"] for r in own)
    said = F.array_join(F.transform("people", lambda x: x.cast("string")), ",")
    joined = P.joined_parts(parts.select("goal", "part", F.lit("n").alias("needs"), said.alias("text"), said.alias("people"), F.array_max(F.map_values("scores")).alias("best")), "text")
    text = "1,3,5,7,12,44,90"
    assert sorted(map(tuple, joined.collect())) == [("a", "n", hashlib.md5(text.encode()).hexdigest(), text, 0.9), ("b", "n", hashlib.md5(text.encode()).hexdigest(), text, 0.2)]
