"""Pairs of texts without a row for each: the same results from different texts, and no pair in a shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.models.scorers import pair_scorer
from weftline.operators import coverage as C, matching as M, vectors as V


def _tables(spark):
    r = random.Random(3)
    words = ["red green", "green blue", "blue", "red blue grey", " ", "grey"]
    needs = [(g, s, i, r.choice(words), r.choice([0.0, 0.1, 0.7])) for g in range(3) for s in "ab" for i in range(12)]
    specs = [(p, s, i, r.choice(words)) for p in range(6) for s in "ab" for i in range(9) if (p, s) != (4, "b")]
    found = [(g, p, p / 4) for g in range(3) for p in range(7)] + [(9, 1, 0.5)]  # 6 has no specialization, 9 no requirement
    return spark.createDataFrame(needs, "goal int, section string, idx int, text string, weight double"), spark.createDataFrame(specs, "person int, section string, spec_idx int, spec string"), spark.createDataFrame(found, "goal int, person int, domain_score double")


@pytest.mark.parametrize("threshold", [0.3, 0.0])
def test_match_rows_by_texts_are_those_by_pairs(spark, threshold):
    needs, specs, found = _tables(spark)
    pairs = C.pair_scores(needs, specs, found, pair_scorer(), ["section"])
    want = C.match_rows(found, pairs, needs, threshold, ["section"])
    got = C.text_match_rows(found, needs, specs, pair_scorer(), threshold, ["section"])
    shown = lambda df: sorted((r["goal"], r["person"], r["domain_score"], r["llm_score"], str(sorted((r["covered"] or {"-": 0}).items())), str(r["missing"])) for r in df.collect())
    assert shown(got) == shown(want) and len(shown(got)) == 22


def test_pairs_are_grouped_without_a_shuffle(spark):
    needs, specs, found = _tables(spark)
    pairs = C.pair_scores(needs, specs, found, pair_scorer(), ["section"])
    grouped = pairs.groupBy("goal", "person", "section", "idx").agg(F.count("*").alias("n"))
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") > plan.index("HashAggregate") and "hashpartitioning(goal" not in plan[: plan.index("Generate")]
    assert grouped.agg(F.sum("n")).first()[0] == pairs.count() > 1000


def test_best_coverage_is_that_of_all_people(spark):
    needs, specs, found = _tables(spark)
    pairs = C.pair_scores(needs, specs, found, pair_scorer(), ["section"])
    want = C.coverage(pairs, needs, found.select("goal", "person"), sections=["section"]).groupBy("goal", "section", "idx", "text", "weight").agg(F.max("c").alias("c"))
    got = C.best_coverage(pairs, needs, found, ["section"]).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_match_run_compares_equal_texts_once(spark):
    needs = spark.range(3000).select(F.lit(1).alias("goal"), F.col("id").alias("idx"), F.lit("red green").alias("text"), F.lit(0.5).alias("weight"))
    specs = spark.range(3000).select(F.lit(2).alias("person"), F.col("id").alias("spec_idx"), F.lit("red").alias("spec"))
    found = spark.createDataFrame([(1, 2, 0.8)], "goal int, person int, domain_score double")
    row = M.match_run(found, needs, specs).first()  # nine million pairs of rows
    assert row["llm_score"] == 0.4 and len(row["covered"]) == 3000 and row["missing"] == []


def test_blocks_come_to_python_a_few_at_a_time(spark, monkeypatch):
    """Before, all pairs of blocks of a task came as one batch."""
    monkeypatch.setattr(V, "BLOCK", 4)
    rows = spark.range(80).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("first"), F.lit(None).cast("array<double>").alias("second"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = []
    monkeypatch.setattr(V, "written", lambda df, *a, **k: sizes.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or df)
    found = V.top_k(rows, rows, 3, -1.0)
    assert sizes == [str(V.BLOCKS_A_BATCH)] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert found.count() == 240
