"""Search for the teams that cover most, by branch and bound in rounds.

People are taken in the order of what they cover alone, the best first. What a member adds to a partial
team never grows as the team grows, so a partial team's score can rise by no more than the greatest
additions of as many members as are missing, nor above what all people still to come hold
together. Partial teams whose bound is below a goal's n-th best team known are dropped; where they
could but tie with it, so are those whose first possible list would come after its list.

A round deals the open partial teams of every goal over tasks; each extends a bounded number of
them, the deepest first, and hands back what is left open. Rounds are written tables: the best teams
so far tighten the next one's bounds, and a lost executor costs a task of one round.
"""

from __future__ import annotations

import heapq
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from weftline.operators.coverage import BLEND, coverage, match_scores
from weftline.operators.matching import pool_with
from weftline.session import forget, written

#: Partial teams that a task extends in a round, and tasks of a goal.
BUDGET, PARTS = 20_000, 8
#: People of a goal that are searched first; of the others those follow who could still be in its best teams.
FIRST = 1000
#: Coverage is counted in whole billionths, so that sums are exact in any order.
UNIT = 10**9
OPEN, TEAM, TALLY = 0, 1, 2


def _rounded(x: float) -> float:
    """To six places, halves away from zero, as SQL rounds a double."""
    return float(Decimal(repr(float(x))).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def _whole(x: np.ndarray) -> np.ndarray:
    """Values in whole billionths, halves away from zero; what lies near a half is decided by its decimal form."""
    scaled = x * UNIT
    out = np.floor(scaled + 0.5)
    with np.errstate(invalid="ignore"):
        hard = ~((np.abs(scaled - np.floor(scaled) - 0.5) > 1e-3) & (scaled >= 0) & (scaled < 1e12))
    out[hard] = 0
    out = out.astype(np.int64)
    out[hard] = [int((Decimal(repr(float(v))) * UNIT).quantize(Decimal(1), ROUND_HALF_UP)) for v in x[hard]]
    return out


class Goal:
    """One goal's people as matrices, from a row (people, weights) of Arrow; a person is a row of numbers, not of Python objects."""

    def __init__(self, people: pa.Array, weights: pa.Array, size: int, n: int, first: list, blend: bool):
        weights = weights.to_numpy(zero_copy_only=False).astype(float)
        ids = people.field("person").to_pylist()
        owns = people.field("own").fill_null(0.0).to_numpy(zero_copy_only=False)
        x = people.field("c").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), len(weights))
        x = np.concatenate([np.zeros((0, len(weights)), np.int64), *(_whole(x[i : i + 4096] * weights) for i in range(0, len(ids), 4096))])
        self.n, self.fixed, self.full = n, first, min(size, len(ids))
        most = sum(_whole(weights).tolist()) / UNIT
        self.share, self.each = (BLEND[0] / (most or 1.0), BLEND[1] / max(self.full, 1)) if blend else (1.0, 0.0)
        zero = np.zeros(len(weights), np.int64)
        place = {p: i for i, p in enumerate(ids)}
        asked = [place[p] for p in first]
        self.best = np.maximum.reduce([zero, *x[asked]])
        self.own = float(sum(owns[i] for i in asked))
        alone = (-self.share * x.sum(1) / UNIT - self.each * owns).tolist()
        others = sorted(place.keys() - set(first), key=lambda p: (alone[place[p]], p))
        order = [place[p] for p in others]
        self.ids, self.x, self.owns = others, x[order], owns[order]
        # From each place on: what all people there hold, and the best own score among them.
        self.rest = np.vstack([np.maximum.accumulate(self.x[::-1], axis=0)[::-1], zero]) if self.ids else zero[None]
        self.rest_own = np.append(np.maximum.accumulate(self.owns[::-1])[::-1], 0.0) if self.ids else np.zeros(1)

    def value(self, total, own):
        return self.share * (total / UNIT) + self.each * own

    def listed(self, team: list) -> list:
        return [*self.fixed, *sorted(team)]

    def first_list(self, team: list, at: int, missing: int) -> list:
        return self.listed([*team, *sorted(self.ids[at:])[:missing]])

    def explore(self, nodes: list[tuple], low: tuple | None, budget: int) -> tuple[list, list, int]:
        """(open partial teams left, complete teams found, partial teams extended); nodes: (bound, team, at, best, own)."""
        stack, found, used = sorted(nodes, key=lambda x: x[0]), [], 0
        while stack and used < budget:
            bound, team, at, best, own = stack.pop()
            missing = self.full - len(self.fixed) - len(team)
            if not self.alive(bound, team, at, missing, low):
                continue
            used += 1
            if missing == 0:  # only where nobody is left to choose
                found, low = self.better(found, low, self.value(int(best.sum()), own), team)
                continue
            gains = self.value(np.maximum(self.x[at:] - best, 0).sum(1), self.owns[at:])
            after, top, total = np.zeros(len(gains)), [], 0.0
            for j in range(len(gains) - 1, -1, -1):  # the sum of the missing - 1 greatest gains behind j
                after[j] = total
                if missing > 1:
                    if len(top) < missing - 1:
                        heapq.heappush(top, gains[j])
                        total += gains[j]
                    elif gains[j] > top[0]:
                        total += gains[j] - heapq.heapreplace(top, gains[j])
            longer = np.maximum(self.x[at:], best)
            owns = own + self.owns[at:]
            by_rest = self.value(np.maximum(longer, self.rest[at + 1 :]).sum(1), owns + (missing - 1) * np.maximum(self.rest_own[at + 1 :], 0.0))
            bounds = np.minimum(self.value(int(best.sum()), own) + gains + after, by_rest)
            places = np.arange(len(gains) - missing + 1)
            if missing == 1:
                scores = self.value(longer.sum(1), owns)
                for j in places[np.argsort(-scores[places], kind="stable")]:
                    if low is not None and scores[j] < low[0] - 1e-6:
                        break
                    found, low = self.better(found, low, scores[j], [*team, self.ids[at + j]])
                continue
            if low is not None:
                places = places[bounds[places] >= low[0] - 1e-6]
            for j in places[np.argsort(bounds[places], kind="stable")]:
                stack.append((float(bounds[j]), [*team, self.ids[at + j]], at + int(j) + 1, longer[j], float(owns[j])))
        return stack, found, used

    def alive(self, bound: float, team: list, at: int, missing: int, low: tuple | None) -> bool:
        if low is None or bound > low[0] + 1e-6:
            return True
        if bound < low[0] - 1e-6:
            return False
        reach = _rounded(bound + 1e-9)
        return reach > low[0] or (reach == low[0] and self.first_list(team, at, missing) <= low[1])

    def better(self, found: list, low: tuple | None, score: float, team: list) -> tuple[list, tuple | None]:
        """The n best complete teams with this one, and the n-th best known."""
        found = sorted([*found, (-_rounded(score), self.listed(team))])[: self.n]
        if len(found) == self.n and (low is None or found[-1] < (-low[0], low[1])):
            low = (-found[-1][0], found[-1][1])
        return found, low


def best_teams(covered: DataFrame, size: int, n: int = 1, required: list[int] | None = None, scores: DataFrame | None = None, budget: int = BUDGET, expanded: list[int] | None = None) -> DataFrame:
    """(goal, team, score, rank): the n teams of `size` people whose best coverage per requirement weighs most.

    covered: (goal, person, idx, weight, c), sections being part of idx, neither weight nor c below
    zero, and a row for each requirement of a goal and person. Required people come first, in their
    given order; ties go by the team's list. A goal without one of them makes the query fail, as
    a wish that cannot be met. With `scores` (goal, person, score) a team's score is 0.7 of its share
    of the greatest possible coverage and 0.3 of its members' mean score (0 for unknown ones). A team
    of more people than there are is one of all.

    The result is exact. Of people of the same coverage and score (and not required) the first
    size + n - 1 stay: a team with a later one has n teams before it, in which one of those takes the place.
    The FIRST who hold most alone are searched, as one row of a goal, and then those who could be in
    better teams than were found, again as one row.
    `expanded` collects the number of partial teams that each round extended.
    """
    first = list(dict.fromkeys(required or []))
    if size < len(first):
        raise ValueError("size must be at least the number of required people")
    if n < 1:
        raise ValueError("n must be at least 1")
    people = covered.groupBy("goal", "person").agg(F.sort_array(F.collect_list(F.struct("idx", "weight", "c"))).alias("v"))
    people = people.join(scores.select("goal", "person", F.col("score").alias("own")), ["goal", "person"], "left") if scores is not None else people.withColumn("own", F.lit(0.0))
    people = people.select("goal", "person", F.transform("v", lambda x: x["c"].cast("double")).alias("c"), F.coalesce(F.col("own").cast("double"), F.lit(0.0)).alias("own"), F.transform("v", lambda x: x["weight"].cast("double")).alias("w"))
    blend = scores is not None
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda t, y: t + y)
    most = F.when(total("w") > 0, total("w")).otherwise(1.0)
    alone = total(F.zip_with("c", "w", lambda x, y: x * y)) * (BLEND[0] / most) + F.col("own") * BLEND[1] if blend else total(F.zip_with("c", "w", lambda x, y: x * y))
    people = written(people.withColumn("alone", alone), "people")
    weights = people.groupBy("goal").agg(F.first("w").alias("weights"))
    # Of people who hold the same only the first can be in the n best teams.
    same = Window.partitionBy("goal", "c", "own", F.col("person").isin(first)).orderBy("person")
    turn = F.row_number().over(same)
    kept = people.drop("w").withColumn("turn", turn).filter((F.col("turn") <= max(1, size + n - 1)) | F.col("person").isin(first)).drop("turn")
    counts = Window.partitionBy("goal")
    kept = stored = written(kept.withColumn("n", F.count("*").over(counts)), "kept")
    # A share of own scores counts by the team's size, which fewer people than that cut down.
    if blend:
        full = F.greatest(F.lit(1), F.least(F.lit(size), F.col("n")))
        kept = kept.withColumn("alone", F.col("alone") - F.col("own") * BLEND[1] * (1 - 1 / full))
    asked = F.col("person").isin(first)
    reach = max(FIRST, size + n - 1)
    by_alone = F.row_number().over(Window.partitionBy("goal", asked).orderBy(F.desc("alone"), "person"))
    near = kept.withColumn("turn", by_alone).filter((F.col("turn") <= reach) | asked).drop("turn")
    found = _searched(covered, near, weights, None, size, n, first, blend, budget, expanded)
    missing = size - len(first)
    large = kept.filter(F.col("n") > reach + len(first)).select("goal").distinct()
    if not missing or large.isEmpty():
        forget(people, stored)
        return found
    # A team's score is at most the sum of what its members reach alone: who with the best others does not
    # come up to the n-th best team of those searched is in no better one.
    found = written(found, "found", small=True)
    others = near.filter(~asked).groupBy("goal").agg(total(F.slice(F.sort_array(F.collect_list("alone"), asc=False), 1, missing - 1)).alias("others"))
    wanted = near.filter(asked).groupBy("goal").agg(F.sum("alone").alias("wanted"))
    low = found.filter(F.col("rank") == n).select("goal", F.col("score").alias("low"), F.col("team").alias("low_team"))
    low = written(large.join(others, "goal").join(wanted, "goal", "left").join(low, "goal", "left"), "low", small=True)
    slack = 1e-5 + 1e-9 * size * F.size("c")
    can = F.col("alone") + F.col("others") + F.coalesce("wanted", F.lit(0.0)) >= F.col("low") - slack
    rest = kept.join(low.drop("low_team"), "goal").filter(F.col("low").isNull() | can | asked).select(kept.columns)
    last = _searched(covered, rest, weights, low.select("goal", "low", "low_team"), size, n, first, blend, budget, expanded)
    done = written(found.join(large, "goal", "left_anti").unionByName(last), "best", small=True)
    forget(people, stored, found, low)
    return done


def _searched(covered: DataFrame, people: DataFrame, weights: DataFrame, known: DataFrame | None, size: int, n: int, first: list, blend: bool, budget: int, expanded: list[int] | None) -> DataFrame:
    """`best_teams` among these people (goal, person, c, own); known: (goal, low, low_team), a goal's n-th best team if one is known."""
    one = F.struct("person", "c", "own")
    goals = people.groupBy("goal").agg(F.collect_list(one).alias("people"), F.collect_set("person").alias("ids")).join(weights, "goal")
    if first:
        lacks = F.raise_error(F.concat(F.lit("a required person is missing for "), F.col("goal").cast("string"))).cast("boolean")
        goals = goals.filter(F.when(F.size(F.array_intersect("ids", F.array(*map(F.lit, first)).cast(goals.schema["ids"].dataType))) < len(first), lacks).otherwise(F.lit(True)))
    goals = written(goals.drop("ids"), "goals")
    kinds = {c: covered.schema[c].dataType.simpleString() for c in ("goal", "person")}
    schema = f"goal {kinds['goal']}, kind int, score double, bound double, team array<{kinds['person']}>, at int, best array<bigint>, own double"

    def explore(key, nodes: pa.Table, goal: pa.Table) -> pa.Table:
        rows = nodes.to_pylist()
        people, weights = (goal.column(c).combine_chunks()[:1] for c in ("people", "weights"))
        known = Goal(people.flatten(), weights.flatten(), size, n, first, blend)
        low = None if rows[0]["low"] is None else (rows[0]["low"], rows[0]["low_team"])
        # A goal's search begins with nobody but the required people.
        start = [(r["bound"], r["team"], r["at"], known.best if r["best"] is None else np.array(r["best"], np.int64), known.own if r["own"] is None else r["own"]) for r in rows]
        left, teams, used = known.explore(start, low, budget)
        name = goal.column("name")[0].as_py()
        out = [(name, OPEN, None, bound, team, at, best.tolist(), own) for bound, team, at, best, own in left]
        out += [(name, TEAM, -score, None, team, None, None, None) for score, team in teams]
        out.append((name, TALLY, float(used), None, None, None, None, None))
        types = [goal.schema.field("name").type, pa.int32(), pa.float64(), pa.float64(), nodes.schema.field("team").type, pa.int32(), pa.list_(pa.int64()), pa.float64()]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["goal", "kind", "score", "bound", "team", "at", "best", "own"])

    state = goals.select(
        "goal", F.lit(OPEN).alias("kind"), F.lit(None).cast("double").alias("score"), F.lit(float("inf")).alias("bound"), F.array().cast(f"array<{kinds['person']}>").alias("team"), F.lit(0).alias("at"),
        F.lit(None).cast("array<bigint>").alias("best"), F.lit(None).cast("double").alias("own"),
    )
    if known is None:
        known = goals.select("goal", F.lit(None).cast("double").alias("low"), F.lit(None).cast(f"array<{kinds['person']}>").alias("low_team"))
    state = state.join(known, "goal")
    parts = goals.select(F.col("goal").alias("name"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("number"), F.col("people").alias("people"), F.col("weights").alias("weights"))
    while True:
        nodes = state.filter(F.col("kind") == OPEN).withColumn("part", F.pmod(F.hash("team"), F.lit(PARTS)))
        tasks = nodes.select(F.col("goal").alias("name"), F.col("part").alias("number")).distinct()
        made = nodes.groupBy("goal", "part").cogroup(parts.join(tasks, ["name", "number"], "left_semi").groupBy("name", "number")).applyInArrow(explore, schema)
        rows = made.unionByName(state.filter(F.col("kind") == TEAM).select(made.columns)).repartition("goal")
        place = F.row_number().over(Window.partitionBy("goal", "kind").orderBy(F.desc("score"), "team"))
        last = F.max(F.when((F.col("kind") == TEAM) & (F.col("place") == n), F.struct("score", "team"))).over(Window.partitionBy("goal"))
        after = rows.withColumn("place", place).withColumn("last", last).filter((F.col("kind") != TEAM) | (F.col("place") <= n))
        after = written(after.withColumns({"low": F.col("last.score"), "low_team": F.col("last.team")}).drop("last"), "teams", small=True)
        if hasattr(state, "_weftline_folder"):
            forget(state)
        state = after
        seen = state.agg(F.sum(F.when(F.col("kind") == TALLY, F.col("score"))).alias("used"), F.count_if(F.col("kind") == OPEN).alias("open")).first()
        if expanded is not None:
            expanded.append(int(seen["used"] or 0))
        if not seen["open"]:
            forget(goals)
            return state.filter(F.col("kind") == TEAM).select("goal", "team", "score", F.col("place").alias("rank"))


def form_teams(pairs: DataFrame, requirements: DataFrame, size: int, required: list[int] | None = None, n: int = 1, per_seat: int = 4, least: int = 15) -> DataFrame:
    """(goal, team, score, rank): the n best teams of every goal, its required people among them.

    pairs: (goal, person, idx, score); requirements: (goal, idx, weight). The pool of a goal is its
    required people and, for each seat left, the `per_seat` best others (`least` others at least). To
    extend a standing team, give its people as required and a size above theirs.
    """
    given = list(dict.fromkeys(required or []))
    scores = match_scores(pairs, requirements)
    asked = requirements.select("goal").distinct().withColumn("person", F.explode(F.array(*map(F.lit, given)).cast("array<bigint>") if given else F.array().cast("array<bigint>")))
    pool = pool_with(scores, asked, len(given) + max(per_seat * (size - len(given)), least)).select("goal", "person")
    return best_teams(coverage(pairs.join(pool, ["goal", "person"], "left_semi"), requirements, pool), size, n, given)


def collaborators(pairs: DataFrame, requirements: DataFrame, standing: list[int], more: int, n: int = 1) -> DataFrame:
    """(goal, people, score, rank): the `more` people who extend a standing team best, for every goal."""
    found = form_teams(pairs, requirements, len(set(standing)) + more, standing, n)
    return found.select("goal", F.slice("team", len(set(standing)) + 1, more).alias("people"), "score", "rank")
