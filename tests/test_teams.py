"""Team selection against brute force over all combinations, on two sections and fractional coverage."""

import random
from itertools import combinations

import pytest

from weftline.operators.teams import best_teams

NEEDS = {"a.0": 0.7, "a.4": 0.25, "b.1": 1.3, "b.2": 0.4}
# Persons 5 and 6 cover the same, so that teams tie.
HELD = {
    5: {"a.0": 0.5, "b.1": 0.35},
    6: {"a.0": 0.5, "b.1": 0.35},
    7: {"a.4": 0.9, "b.2": 0.45},
    8: {"b.1": 0.8},
    9: {"a.0": 0.15, "a.4": 0.3, "b.2": 1.0},
    12: {},
}
OWN = {5: 0.9, 7: 0.4, 8: 0.2, 12: 1.0}


@pytest.fixture(scope="module")
def covered(spark):
    rows = [("goal", p, i, w, HELD[p].get(i, 0.0)) for p in HELD for i, w in NEEDS.items()]
    return spark.createDataFrame(rows, "goal string, person bigint, idx string, weight double, c double")


def brute(size, required=(), blend=False):
    first = list(dict.fromkeys(required))
    size = min(size, len(HELD))
    found = []
    for rest in combinations(sorted(set(HELD) - set(first)), size - len(first)):
        team = first + list(rest)
        score = sum(w * max([HELD[p].get(i, 0.0) for p in team], default=0.0) for i, w in NEEDS.items())
        if blend:
            score = 0.7 * score / sum(NEEDS.values()) + 0.3 * sum(OWN.get(p, 0.0) for p in team) / max(1, len(team))
        found.append((-round(score, 6), team))
    return [(team, -score) for score, team in sorted(found)]


@pytest.mark.parametrize("size, required", [(1, []), (2, []), (3, [9]), (3, [12, 5]), (2, [7, 7]), (4, [8, 12, 6]), (9, []), (0, [])])
def test_all_teams(covered, size, required):
    found = [(r["team"], r["score"]) for r in best_teams(covered, size, 100, required).orderBy("rank").collect()]
    want = brute(size, required)
    assert found == [(t, pytest.approx(s, abs=1e-6)) for t, s in want]


def test_blend(spark, covered):
    scores = spark.createDataFrame([("goal", p, s) for p, s in OWN.items()], "goal string, person bigint, score double")
    found = [(r["team"], r["score"]) for r in best_teams(covered, 2, 100, [9], scores).orderBy("rank").collect()]
    assert sorted(found) == [(t, pytest.approx(s, abs=1e-6)) for t, s in sorted(brute(2, [9], True))]


def test_wishes_that_cannot_be_met(covered):
    with pytest.raises(ValueError):
        best_teams(covered, 1, 1, [5, 7])
    with pytest.raises(Exception, match="required person is missing"):
        best_teams(covered, 2, 1, [404]).collect()


def one_goal(spark, held, needs):
    rows = [("g", p, i, w, float(held[p].get(i, 0.0))) for p in held for i, w in needs.items()]
    return spark.createDataFrame(rows, "goal string, person bigint, idx string, weight double, c double")


#: Person p holds requirement p - 1 of either section; later ones weigh more.
OWNERS = {p: {f"{section}.{p - 1}": 1.0 for section in ("application", "research")} for p in (1, 2, 3)}
WEIGHTS = {f"{section}.{i}": w for section in ("application", "research") for i, w in enumerate((0.1, 0.5, 1.0))}


@pytest.mark.parametrize(
    "size, required, n, teams_found",
    [
        (2, None, 1, [[2, 3]]),
        (2, [1], 1, [[1, 3]]),
        (1, [1], 1, [[1]]),
        (2, [1, 1], 1, [[1, 3]]),
        (3, [1, 2], 1, [[1, 2, 3]]),
        (3, [2, 1], 1, [[2, 1, 3]]),
        (2, [1, 2], 1, [[1, 2]]),
        (0, None, 1, [[]]),
        (2, None, 2, [[2, 3], [1, 3]]),
        (2, [1], 2, [[1, 3], [1, 2]]),
        (9, None, 1, [[1, 2, 3]]),
    ],
)
def test_owners_of_one_requirement_each(spark, size, required, n, teams_found):
    found = best_teams(one_goal(spark, OWNERS, WEIGHTS), size, n, required).orderBy("rank").collect()
    assert [r["team"] for r in found] == teams_found
    assert [r["score"] for r in found] == [pytest.approx(sum(2 * (0.1, 0.5, 1.0)[p - 1] for p in t)) for t in teams_found]


@pytest.mark.parametrize("budget", [5, 20_000])
@pytest.mark.parametrize("blend", [False, True])
def test_short_rounds_find_the_same_as_all_teams(spark, budget, blend):
    """Three goals at once: a plain one, one whose best teams all tie (two people cover everything), one with few people."""
    rng = random.Random(8)
    goals = {
        "plain": {p: {str(i): round(rng.random(), 2) for i in rng.sample(range(8), 4)} for p in range(1, 13)},
        "ties": {p: {str(i): 1.0 for i in range(8) if p in (6, 9) and i % 2 == p % 2} for p in range(1, 12)},
        "few": {p: {str(p): 0.5} for p in (3, 1, 2)},
    }
    needs = {str(i): 0.5 + i / 10 for i in range(8)}
    own = {p: rng.random() for p in range(1, 13)}
    rows = [(g, p, i, w, float(held[p].get(i, 0.0))) for g, held in goals.items() for p in held for i, w in needs.items()]
    covered = spark.createDataFrame(rows, "goal string, person bigint, idx string, weight double, c double")
    scores = spark.createDataFrame([(g, p, own[p]) for g in goals for p in goals[g]], "goal string, person bigint, score double") if blend else None
    size, n, expanded = 5, 4, []
    got = {}
    for r in best_teams(covered, size, n, scores=scores, budget=budget, expanded=expanded).orderBy("rank").collect():
        got.setdefault(r["goal"], []).append((r["team"], r["score"]))
    for g, held in goals.items():
        every = []
        for team in combinations(sorted(held), min(size, len(held))):
            score = sum(w * max(held[p].get(i, 0.0) for p in team) for i, w in needs.items())
            if blend:
                score = 0.7 * score / sum(needs.values()) + 0.3 * sum(own[p] for p in team) / len(team)
            every.append((-round(score, 6), list(team)))
        assert got[g] == [(t, pytest.approx(-s, abs=2e-6)) for s, t in sorted(every)[:n]], g
    assert max(expanded) <= 3 * 8 * budget


def test_a_pool_too_large_to_list(spark):
    """C(40, 10) is 848 million teams; some ten thousand partial ones are extended."""
    rng = random.Random(5)
    held = {p: {str(i): round(rng.random() ** 2, 3) for i in rng.sample(range(20), 6)} for p in range(1, 41)}
    expanded = []
    found = best_teams(one_goal(spark, held, {str(i): 1.0 + i % 3 for i in range(20)}), 10, 1, expanded=expanded).collect()
    assert len(found[0]["team"]) == 10 and sum(expanded) < 60_000
    best, team = found[0]["score"], set(found[0]["team"])
    value = lambda t: sum((1.0 + i % 3) * max(held[p].get(str(i), 0.0) for p in t) for i in range(20))
    assert best == pytest.approx(value(team), abs=1e-5)
    # No exchange of one or two members is better.
    for out in [(a,) for a in team] + list(combinations(sorted(team), 2)):
        for into in combinations(sorted(set(held) - team), len(out)):
            assert value(team - set(out) | set(into)) <= best + 1e-6
