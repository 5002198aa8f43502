"""Steps whose time, memory or disk grew faster than their input."""

import time
from decimal import ROUND_HALF_UP, Decimal
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weftline.operators import keywords as K, payloads as P, teams
from weftline.session import CLEANUP, written


def _plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {x for i in range(files.size()) if (x := files.apply(i).getName()).startswith("shuffle_") and x.endswith(".data")}


def test_a_written_step_leaves_no_shuffle_files(spark):
    before, setting = _shuffle_files(spark), spark.conf.get(CLEANUP, None)
    found = written(spark.range(20_000).groupBy(F.col("id") % 5000).count().repartition(3, "count"), small=True)
    until = time.monotonic() + 5
    while _shuffle_files(spark) - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(CLEANUP, None) == setting
    assert found.count() == 5000


def test_coverage_of_matching_inputs_goes_by_people(spark):
    people = [7, 3, 900, 12, 5, 1, 44]
    members = spark.createDataFrame([("g", p, n, p / 1000) for p in people for n in ("b", "a")], "goal string, person bigint, name string, c double")
    needs = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 2.0)], "goal string, name string, weight double")
    row = P.matching_inputs(needs, members, members.select("goal", "person", F.col("c").alias("score"))).first()
    keys = P.matching_inputs(needs, members, members.select("goal", "person", F.col("c").alias("score"))).select(F.map_keys("coverage")).first()[0]
    assert keys == row["people"] == sorted(people)
    assert row["coverage"] == {p: {"a": p / 1000, "b": p / 1000} for p in people}


def test_only_members_of_teams_are_grouped_for_a_justification(spark):
    teams_ = spark.createDataFrame([("g", 1, [2, 1])], "goal string, rank int, team array<bigint>")
    needs = spark.createDataFrame([("g", "s", 1, "need", 1.0)], "goal string, section string, idx int, text string, weight double")
    people = spark.createDataFrame([(1, "One")], "person bigint, name string")
    held = spark.createDataFrame([("g", p, "s", 1, p / 10) for p in range(1, 6)], "goal string, person bigint, section string, idx int, c double")
    pairs = held.select("goal", "person", "section", "idx", F.lit("x").alias("spec"), F.col("c").alias("score"))
    found = P.justification_inputs(teams_, teams_.select("goal"), needs, people, held, pairs)
    assert _plan(found).count("LeftSemi") >= 2
    row = found.first()
    assert [(m["name"], m["covered"]) for m in row["members"]] == [("person_2", {"s.1": 0.2}), ("One", {"s.1": 0.1})]
    assert row["coverage"] == {"s.1": 0.2} and row["evidence"].count("\n") == 1


def test_people_who_hold_the_same_are_not_all_sent_to_the_search(spark, monkeypatch):
    cover = lambda p: [(p % 5) / 4, (p % 3) / 2, (p % 2) * 1.0]
    score = lambda p: (p % 4) / 4
    rows = [("g", p, i, 1.0 + i, c) for p in range(240) for i, c in enumerate(cover(p))]
    held = spark.createDataFrame(rows, "goal string, person bigint, idx int, weight double, c double")
    scores = spark.createDataFrame([("g", p, score(p)) for p in range(240)], "goal string, person bigint, score double")
    sent = []

    def spy(df, name="step", small=False):
        back = written(df, name, small)
        if name == "goals":
            sent.append(back.agg(F.max(F.size("people"))).first()[0])
        return back

    monkeypatch.setattr(teams, "written", spy)
    for required in ([], [77]):
        found = [(r["team"], r["score"]) for r in teams.best_teams(held, 2, 2, required, scores=scores).orderBy("rank").collect()]
        value = lambda t: 0.7 * sum((1.0 + i) * max(cover(p)[i] for p in t) for i in range(3)) / 6.0 + 0.3 * sum(map(score, t)) / 2
        every = [list(t) for t in combinations(range(240), 2)] if not required else [[77, p] for p in range(240) if p != 77]
        best = sorted(every, key=lambda t: (-round(value(t), 6), t))[:2]
        assert [t for t, _ in found] == best
    assert max(sent) <= 60 * 3 + 1


def test_whole_billionths_are_those_of_decimals():
    values = np.concatenate([np.random.default_rng(1).random(2000), np.arange(0, 2000) * 5e-10, [0.1234567885, 0.5, 2e7]])
    want = [int((Decimal(repr(float(v))) * teams.UNIT).quantize(Decimal(1), ROUND_HALF_UP)) for v in values]
    assert teams._whole(values).tolist() == want


def test_places_of_titles_are_added_up_by_hash(spark):
    items = spark.createDataFrame([("b", 2, "t", 1.0), ("b", 1, "t", 3.0)], "b string, pos bigint, t string, w double")
    cited = spark.createDataFrame([("b", 2, 0, 1), ("b", 1, 1, 2), ("b", 1, 0, 3), ("b", 2, 1, 3)], "b string, pos bigint, rank int, id bigint")
    titles = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "id bigint, title string")
    found = P.evidence_titles(items, cited, titles, ["b"], 3)
    assert found.first()["titles"] == ["three", "two", "one"]
    assert "SortAggregate [" not in _plan(found, "executedPlan") and "SortAggregate(key=[b" not in _plan(found, "executedPlan")


def test_mentions_of_a_batch_are_added_up_before_texts_are_made_normal(spark):
    rows = spark.createDataFrame([("b", "Hot-Bolt", "x", 0.5, 3), ("b", "Hot-Bolt", "x", 7.0, 2), ("b", "hot-bolt", "y", None, 1)], "b string, text string, batch string, weight double, pos bigint")
    found = K.concepts(rows, ["b"])
    assert _plan(found).count("Aggregate [") == 2
    row = found.first()
    assert (row["text"], row["n"], row["batches"], float(row["weight_sum"]), row["max_weight"], row["pos"]) == ("hot-bolt", 3, ["x", "y"], 1.5, 1.0, 1)


def test_a_written_step_gives_python_its_rows_by_bytes(spark):
    """Before, a batch held 64 MB whatever the step: 24 rows of a megabyte came as one."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    found = written(spark.range(0, 24, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text")).mapInArrow(sizes, "n bigint"), small=True)
    held = [r["n"] for r in found.collect()]
    assert sum(held) >= 24 << 20 and max(held) <= 5 << 20
    assert spark.conf.get(name) == before
