"""Match runs put together from their parts, candidate pools, and rebuilding only what a change touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from weftline.models.scorers import pair_scorer
from weftline.operators import coverage as C, vectors as V
from weftline.session import written

#: Candidates of a person, and of one goal; the least similarity of a candidate.
PER_PERSON, PER_GOAL, FLOOR = 10, 200, 0.30


def candidates(people: DataFrame, goals: DataFrame, k: int = PER_PERSON, floor: float = FLOOR, per: str = "person") -> DataFrame:
    """(goal, person, domain_score): the k nearest goals of each person, or people of each goal (`per`), over the floor.

    people and goals: (id, first, second), two nullable vectors each; the similarity is the greatest of
    their four cosines. The side that asks is the smaller one, or a part of it.
    """
    if per == "person":
        found = V.top_k(people, goals, k, floor)
        return found.select(F.col("item_id").alias("goal"), F.col("query_id").alias("person"), F.col("score").alias("domain_score"))
    found = V.top_k(goals, people, k, floor)
    return found.select(F.col("query_id").alias("goal"), F.col("item_id").alias("person"), F.col("score").alias("domain_score"))


def named_pairs(people: DataFrame, goals: DataFrame, pairs: DataFrame, floor: float = 0.0) -> DataFrame:
    """(goal, person, domain_score) of given pairs (goal, person), over the floor; unknown ids drop out.

    A missing vector is left out of the comparison; with none on a side the score is 0.
    """
    left = people.select(F.col("id").alias("person"), F.array("first", "second").alias("x"))
    right = goals.select(F.col("id").alias("goal"), F.array("first", "second").alias("y"))
    met = pairs.select("goal", "person").distinct().join(left, "person").join(right, "goal")
    four = [V.cosine(F.col("x")[i], F.col("y")[j]) for i in (0, 1) for j in (0, 1)]
    score = F.round(F.coalesce(F.greatest(*four), F.lit(0.0)), 6)
    return met.select("goal", "person", score.alias("domain_score")).filter(F.col("domain_score") >= floor)


def match_run(found: DataFrame, requirements: DataFrame, specializations: DataFrame, score: Callable[[DataFrame], DataFrame] | None = None, sections: tuple[str, ...] = (), threshold: float = C.THRESHOLD) -> DataFrame:
    """(goal, person, domain_score, llm_score, covered, missing) of candidates (goal, person, domain_score).

    requirements: (goal, sections, idx, text, weight); specializations: (person, sections, spec_idx, spec).
    Each different pair of texts is scored once, and equal texts are compared once (see
    `coverage.text_match_rows`). A candidate without a requirement or a
    specialization has a row with score 0. See `candidates` for all people or one goal, and
    `named_pairs` for given ones: a run for one person or goal reads only their rows.
    """
    parts = list(sections)
    found = written(found, "candidates")
    goals = found.select("goal").distinct()
    needs = requirements.join(goals, "goal", "left_semi")
    return C.text_match_rows(found, needs, specializations, score or pair_scorer(), threshold, parts)


def merged(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored match rows with the fresh ones in place of those of the same goal and person."""
    return stored.join(fresh, ["goal", "person"], "left_anti").unionByName(fresh.select(stored.columns))


def pool_with(scores: DataFrame, required: DataFrame, size: int) -> DataFrame:
    """(goal, person, score, required): each goal's required people (goal, person), then its best others up to `size` in all.

    Required people are in, whatever their score and number; one without a score has 0.
    """
    asked = required.select("goal", "person").distinct().withColumn("required", F.lit(True))
    rows = scores.select("goal", "person", "score").join(asked, ["goal", "person"], "full").select("goal", "person", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("required", F.lit(False)).alias("required"))
    rank = F.row_number().over(Window.partitionBy("goal").orderBy(F.desc("required"), F.desc("score"), "person"))
    return rows.withColumn("__rank", rank).filter(F.col("required") | (F.col("__rank") <= size)).drop("__rank")


# ---- incremental rebuild


def stale(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change) of keys whose rows differ in `columns`: new, gone or changed.

    A key's rows are compared as a set with repetitions, by the sum of their hashes and their
    number, which combine before the shuffle; neither side's rows meet the other's.
    """

    def digest(df: DataFrame, name: str) -> DataFrame:
        row = F.xxhash64(*(F.to_json(F.struct(c)) for c in columns)).cast("decimal(38,0)")
        return df.groupBy(key).agg(F.struct(F.sum(row), F.count("*")).alias(name))

    met = digest(before, "old").join(digest(after, "new"), key, "full")
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return met.select(key, change.alias("change")).filter("change IS NOT NULL")


def rebuilt(stored: DataFrame, before: DataFrame, after: DataFrame, key: str, columns: list[str], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stored result as if built anew from `after`, at the cost of the keys that changed since `before`.

    build(rows) makes result rows, each with its `key`, from the rows of some keys alone; it gets
    the rows of changed and new keys. Result rows of changed and gone keys go, the others stay.
    """
    touched = written(stale(before, after, key, columns), "stale")
    fresh = build(after.join(touched, key, "left_semi"))
    return stored.join(touched, key, "left_anti").unionByName(fresh.select(stored.columns))
