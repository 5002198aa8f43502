"""Teams of goals with more people than are searched first."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import teams


def _tables(spark):
    r = random.Random(11)
    held = [(g, p, i, [0.5, 1.0, 2.0][i], round(r.random() ** 3, 3)) for g, people in (("a", 60), ("b", 4), ("c", 25), ("d", 1)) for p in range(people) for i in range(3)]
    scores = [(g, p, p % 7 / 7) for g in "abcd" for p in range(0, 60, 2)]
    return spark.createDataFrame(held, "goal string, person bigint, idx int, weight double, c double"), spark.createDataFrame(scores, "goal string, person bigint, score double")


@pytest.mark.parametrize("size,n,required,blend", [(2, 3, [], True), (3, 2, [], False), (3, 4, [0], True)])
def test_people_searched_later_change_no_team(spark, monkeypatch, size, n, required, blend):
    held, scores = _tables(spark)
    run = lambda: sorted(map(str, (tuple(r) for r in teams.best_teams(held, size, n, required, scores if blend else None).collect())))
    want, sent = run(), []
    monkeypatch.setattr(teams, "FIRST", 6)
    real = teams._searched
    monkeypatch.setattr(teams, "_searched", lambda covered, people, *rest: sent.append(people.groupBy("goal").count().agg(F.max("count")).first()[0]) or real(covered, people, *rest))
    assert run() == want
    assert sent[0] <= 6 + len(required) + size + n and len(sent) == 2 and (sent[1] < 60 or size > 2)  # before, all sixty were one row
