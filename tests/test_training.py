"""Candidate sets and training sets on small tables."""

from collections import Counter, defaultdict

import pytest

from weftline.operators import keywords as K, training as L


def kinds(spark, n, **how):
    df = spark.createDataFrame([(1, i, 1.0 - i / 100) for i in range(n)], "query bigint, item bigint, score double")
    return [(r["item"], r["kind"]) for r in L.candidates(df, ["query"], "item", seed=3, **how).orderBy("place").collect()]


def test_candidates_are_filled_up_to_two_and_capped(spark):
    assert kinds(spark, 6, top=1, hard=0, random=0) == [(0, "top"), (1, "backfill")]
    assert kinds(spark, 6, top=0, hard=0, random=0) == [(0, "backfill"), (1, "backfill")]
    assert kinds(spark, 1, top=1, hard=1, random=1) == []
    found = kinds(spark, 9, top=2, hard=2, random=3)
    assert found[:4] == [(0, "top"), (1, "top"), (2, "hard"), (3, "hard")] and len(found) == 7 and {k for _, k in found[4:]} == {"random"}
    assert kinds(spark, 9, top=2, hard=2, random=3, most=5) == found[:5]
    assert kinds(spark, 9, top=2, hard=2, random=3, most=1) == found[:2]


def test_training_set(spark):
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    queries = spark.createDataFrame([(i, f"{w} study", 0.9) for i, w in enumerate(words)] + [(90, "light", 0.1), (91, " ", 0.9)], "id bigint, text string, weight double")
    items = spark.createDataFrame([(100 + i, f"{words[i % 6]} study of {words[(i + 1) % 6]}", 0.5) for i in range(36)], "id bigint, text string, weight double")
    rows = L.training_set(queries, items, top=2, hard=1, random=2, most=4, least_weight=0.3, seed=7).collect()
    sides = defaultdict(dict)
    for r in rows:
        assert r["positive_score"] > r["negative_score"] and 0 < r["strength"] <= 1
        sides[r["query"]][r["positive"]] = r["positive_kind"]
        sides[r["query"]][r["negative"]] = r["negative_kind"]
    assert set(sides) == set(range(6)) and all(Counter(k.values()) == {"top": 2, "hard": 1, "random": 1} for k in sides.values())
    assert len(rows) == 6 * 6
    again = L.training_set(queries, items, top=2, hard=1, random=2, most=4, least_weight=0.3, seed=7, max_pairs=5).collect()
    assert len(again) == 5 and {tuple(r) for r in again} <= {tuple(r) for r in rows}


def test_nothing_is_shared(spark):
    df = spark.createDataFrame([(1, "word", 1.0)], "id bigint, text string, weight double")
    with pytest.raises(ValueError):
        L.training_set(df, df.limit(0))


def test_a_source_of_just_the_least_score_stays(spark):
    known = {"asked": [1.0, 1.0, 0.0], "rare": [1.0, 0.0, 7.0], "rarer": [1.0, 0.0, 8.0]}  # 1 / (sqrt(2) * sqrt(50)) is a hair under 0.1
    catalog = spark.createDataFrame([(1, "a", 1, "rare"), (1, "a", 2, "rarer")], "o int, type string, id int, excerpt string")
    found = K.attached_sources(spark.createDataFrame([(1, "Asked")], "o int, t string"), catalog, ["o"], lambda texts: [known[t] for t in texts])
    assert [tuple(x) for r in found.collect() for x in r["sources"]] == [("a", 1, 0.1)]
