"""Flat evidence from lists of specializations: the same rows as from pairs."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.models.scorers import pair_scorer
from weftline.operators import coverage as C


def _tables(spark, people):
    r = random.Random(5)
    words = ["red green", "green blue", "blue", "red blue grey", " ", "grey"]
    needs = [(g, s, i % 9, r.choice(words), 0.5) for g in range(3) for s in "ab" for i in range(12)]  # some idx twice
    specs = [(p, s, r.choice([None, 0, 1, 2, 3, 4, 5]), r.choice(words)) for p in range(people) for s in "ab" for _ in range(9) if (p, s) != (4, "b")]
    found = [(g, p) for g in range(3) for p in range(people + 1) if (g, p) != (1, 3)] + [(9, 1), (0, 0)]
    return spark.createDataFrame(needs, "goal int, section string, idx int, text string, weight double"), spark.createDataFrame(specs, "person int, section string, spec_idx int, spec string"), spark.createDataFrame(found, "goal int, person int")


@pytest.mark.parametrize("limit,cells,rows", [(20, 4 << 20, 100_000), (7, 300, 40), (5000, 4 << 20, 50)])
def test_evidence_by_lists_is_that_by_pairs(spark, monkeypatch, limit, cells, rows):
    monkeypatch.setattr(C, "CELLS", cells)
    monkeypatch.setattr(C, "TASK_ROWS", rows)
    needs, specs, found = _tables(spark, 14)
    pairs = C.pair_scores(needs, specs, found, pair_scorer(), ["section"])
    want = C.evidence(pairs, C.means(pairs, ["section"]), limit)
    got = C.text_evidence(found, needs, specs, pair_scorer(), limit).select(want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_evidence_has_no_row_for_each_pair(spark):
    """Before, its sixteen million pairs were rows."""
    needs = spark.range(4000).select(F.lit("g").alias("goal"), F.lit("s").alias("section"), F.col("id").alias("idx"), F.concat_ws(" ", F.lit("red"), (F.col("id") % 5).cast("string")).alias("text"), F.lit(0.5).alias("weight"))
    specs = spark.range(4000).select((F.col("id") % 10).alias("person"), F.lit("s").alias("section"), F.col("id").alias("spec_idx"), F.when(F.col("id") % 10 == 7, "red 3").otherwise("red").alias("spec"))
    found = spark.range(10).select(F.lit("g").alias("goal"), F.col("id").alias("person"))
    rows = C.text_evidence(found, needs, specs, pair_scorer(), 3).orderBy("rank").collect()
    assert [(r["person"], r["idx"], r["spec_idx"], r["score"], r["need_score"]) for r in rows] == [(7, 3, 7, 1.0, 1.0), (7, 3, 17, 1.0, 1.0), (7, 3, 27, 1.0, 1.0)]
    plan = C.text_evidence(found, needs, specs, pair_scorer(), 3)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
