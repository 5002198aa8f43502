"""How far people cover weighted requirements, match rows and gaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.session import forget, written

THRESHOLD = 0.30
#: Sums in this type do not depend on the order of rows.
EXACT = "decimal(28,9)"
#: Shares of coverage and of the members' mean score in a blended team score.
BLEND = (0.7, 0.3)
#: Specializations that one task of a comparison has, about.
TASK_ROWS = 100_000
#: Scores of pairs that a task holds as a matrix at a time.
CELLS = 4 << 20


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def pair_scores(requirements: DataFrame, specializations: DataFrame, candidates: DataFrame, score, sections: list[str]) -> DataFrame:
    """(goal, person, sections, idx, spec_idx, score) for all requirements and specializations of candidate pairs.

    requirements: (goal, sections, idx, text, weight); specializations: (person, sections, spec_idx, spec);
    candidates: (goal, person). `score` takes different texts (text, spec) and adds `score`: each
    pair of texts is scored once, however many candidates share it. Blank texts score 0 or drop out.
    Both sides come to the candidates as lists of a section, dealt by person, and become pairs only
    there: rows of one person stay in one task, so grouping by person shuffles no pair.
    """
    needs, specs = _sides(requirements, specializations, sections)
    uses = _met(needs, specs, candidates, sections, ["idx", "text"], ["spec_idx", "spec"])
    known = _known(needs, specs, candidates, score, sections)
    return uses.join(known, ["text", "spec"]).select("goal", "person", *sections, "idx", "spec_idx", "score")


def _sides(requirements: DataFrame, specializations: DataFrame, sections: list[str]) -> tuple[DataFrame, DataFrame]:
    """Requirements and specializations without blank texts, written so that Spark knows their sizes."""
    needs = requirements.filter(F.trim("text") != "").withColumn("text", F.trim("text"))
    specs = specializations.filter(F.trim("spec") != "").select("person", *sections, "spec_idx", F.trim("spec").alias("spec"))
    return written(needs.select("goal", *sections, *(c for c in ("idx", "text", "weight") if c in needs.columns)), "needs", small=True), written(specs, "specs")


def _met(needs: DataFrame, specs: DataFrame, candidates: DataFrame, sections: list[str], asked: list[str], given: list[str]) -> DataFrame:
    """(goal, person, sections, asked, given): each candidate's requirements with its specializations of the same section."""
    tasks = max(1, -(-specs.count() // TASK_ROWS))
    own = specs.repartition(tasks, "person").groupBy("person", *sections).agg(F.collect_list(F.struct(*given)).alias("__given"))
    lists = needs.groupBy("goal", *sections).agg(F.collect_list(F.struct(*asked)).alias("__asked"))
    pairs = own.join(candidates.select("goal", "person").repartition(tasks, "person"), "person").join(lists, ["goal", *sections])
    rows = pairs.select("goal", "person", *sections, "__given", F.explode("__asked").alias("__a")).select("goal", "person", *sections, "__a", F.explode("__given").alias("__g"))
    return rows.select("goal", "person", *sections, *(F.col(f"__a.{c}").alias(c) for c in asked), *(F.col(f"__g.{c}").alias(c) for c in given))


def _known(needs: DataFrame, specs: DataFrame, candidates: DataFrame, score, sections: list[str]) -> DataFrame:
    """(text, spec, score) of the different texts that meet in a candidate, each pair scored once."""
    met = _met(needs.select("goal", *sections, "text").distinct(), specs.select("person", *sections, "spec").distinct(), candidates, sections, ["text"], ["spec"])
    return written(score(met.select("text", "spec").distinct()).select("text", "spec", _unit(F.col("score")).alias("score")), "known")


def coverage(pairs: DataFrame, requirements: DataFrame, people: DataFrame, threshold: float = THRESHOLD, sections: list[str] | None = None) -> DataFrame:
    """(goal, person, idx, weight, c, covered): mean pair score per requirement, 0 where there is no pair.

    pairs: (goal, person, idx, score); requirements: (goal, idx, weight); people: (goal, person); all
    but people with `sections`, if there are any. The threshold holds before the mean is rounded.
    """
    parts = sections or []
    means = pairs.groupBy("goal", "person", *parts, "idx").agg(F.avg("score").alias("c"))
    full = people.join(requirements, "goal").join(means, ["goal", "person", *parts, "idx"], "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
    return full.withColumns({"covered": F.round("c", 9) >= max(0.0, min(1.0, threshold)), "c": F.round("c", 6)})


def means(pairs: DataFrame, sections: list[str] | None = None) -> DataFrame:
    """(goal, person, sections, idx, c): `coverage` of the requirements that a person has pairs for, no others."""
    return pairs.groupBy("goal", "person", *(sections or []), "idx").agg(F.round(F.avg("score"), 6).alias("c"))


def best_coverage(pairs: DataFrame, requirements: DataFrame, people: DataFrame, sections: list[str] | None = None) -> DataFrame:
    """requirements of the goals that have people, with c, the greatest `coverage` of any of them: 0 where there is no pair.

    Nobody's zeros are rows, so the cost is that of the pairs.
    """
    keys = ["goal", *(sections or []), "idx"]
    top = means(pairs, sections).groupBy(*keys).agg(F.max("c").alias("c"))
    asked = requirements.join(people.select("goal").distinct(), "goal", "left_semi")
    return asked.join(top, keys, "left").withColumn("c", F.greatest(F.lit(0.0), F.coalesce("c", F.lit(0.0))))


def match_scores(pairs: DataFrame, requirements: DataFrame, sections: list[str] | None = None) -> DataFrame:
    """(goal, person, score): sum of weight * score over sum of weight, over pairs of positive weight."""
    weighed = pairs.join(requirements, ["goal", *(sections or []), "idx"]).filter("weight > 0")
    total = weighed.groupBy("goal", "person").agg(F.sum((F.col("weight") * F.col("score")).cast(EXACT)).alias("ws"), F.sum(F.col("weight").cast(EXACT)).alias("w"))
    share = F.col("ws").cast("double") / F.col("w").cast("double")
    return total.select("goal", "person", F.round(_unit(share).cast("decimal(28,12)"), 6).cast("double").alias("score"))


def match_rows(candidates: DataFrame, pairs: DataFrame, requirements: DataFrame, threshold: float = THRESHOLD, sections: list[str] | None = None) -> DataFrame:
    """(goal, person, domain_score, llm_score, covered, missing) of candidates (goal, person, domain_score).

    llm_score is the weighted pair mean times the domain score, each within 0 and 1; the domain
    score is kept as it is. covered maps idx (with its sections before it, by dots) to the mean
    score, missing lists the others.
    """
    parts = sections or []
    name = F.concat_ws(".", *parts, F.col("idx").cast("string"))
    held = coverage(pairs, requirements, candidates.select("goal", "person").distinct(), threshold, parts)
    listed = held.groupBy("goal", "person").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("covered"), F.struct(name.alias("name"), "c"))))).alias("covered"),
        F.sort_array(F.collect_list(F.when(~F.col("covered"), name))).alias("missing"),
    )
    found = candidates.join(match_scores(pairs, requirements, parts), ["goal", "person"], "left").join(listed, ["goal", "person"], "left")
    final = F.round(_unit(F.coalesce("score", F.lit(0.0))) * _unit(F.col("domain_score")), 6)
    return found.select("goal", "person", "domain_score", final.alias("llm_score"), "covered", "missing")


def text_match_rows(candidates: DataFrame, requirements: DataFrame, specializations: DataFrame, score, threshold: float = THRESHOLD, sections: list[str] | None = None) -> DataFrame:
    """`match_rows` of the pairs that `pair_scores` would give, at the cost of different texts.

    Equal specializations of a person, and requirements of one text and weight, are compared once and
    counted: a mean is the sum of count times score over the counts, and no pair becomes a row.
    Requirements without a pair are known by their names alone.
    """
    parts = sections or []
    needs, specs = _sides(requirements, specializations, parts)
    name = F.concat_ws(".", *parts, F.col("idx").cast("string"))
    asked = written(needs.groupBy("goal", *parts, "text", "weight").agg(F.count("*").alias("__m"), F.collect_list(name).alias("__names")), "asked", small=True)
    given = specs.groupBy("person", *parts, "spec").agg(F.count("*").alias("__n"))
    known = _known(needs, specs, candidates, score, parts)
    met = _met(asked, given, candidates.select("goal", "person").distinct(), parts, ["text", "weight", "__m"], ["spec", "__n"]).join(known, ["text", "spec"])
    # In these types a product keeps all 9 digits of EXACT.
    times, heavy, exact = (F.col("__m") * F.col("__n")).cast("decimal(13,0)"), F.col("weight") > 0, "decimal(24,9)"
    one = met.groupBy("goal", "person", *parts, "text", "weight").agg(
        (F.sum(F.col("__n") * F.col("score")) / F.sum("__n")).alias("c"),
        F.sum(F.when(heavy, (F.col("weight") * F.col("score")).cast(exact) * times)).alias("ws"),
        F.sum(F.when(heavy, F.col("weight").cast(exact) * times)).alias("w"),
    )
    least = max(0.0, min(1.0, threshold))
    held = one.withColumn("covered", F.round("c", 9) >= least)
    shown = F.when(F.col("covered"), F.transform("__names", lambda x: F.struct(x.alias("name"), F.round(F.col("c"), 6).alias("c"))))
    lists = held.join(asked.select("goal", *parts, "text", "weight", "__names"), ["goal", *parts, "text", "weight"]).groupBy("goal", "person").agg(
        F.sum("ws").alias("ws"), F.sum("w").alias("w"), F.flatten(F.collect_list(shown)).alias("held")
    )
    own = requirements.select("goal", name.alias("name")).groupBy("goal").agg(F.sort_array(F.collect_list("name")).alias("__all"))
    found = candidates.join(lists, ["goal", "person"], "left").join(own, "goal", "left")
    entries = F.coalesce("held", F.array().cast(lists.schema["held"].dataType))
    rest = F.array_except("__all", F.transform(entries, lambda x: x["name"]))
    if least <= 0:  # then those without a pair are covered too, by 0
        entries, rest = F.concat(entries, F.transform(rest, lambda x: F.struct(x.alias("name"), F.lit(0.0).alias("c")))), F.slice("__all", 1, 0)
    there = F.col("__all").isNotNull()
    share = _unit(F.coalesce(F.col("ws").cast("double") / F.col("w").cast("double"), F.lit(0.0)))
    final = F.round(F.round(share.cast("decimal(28,12)"), 6).cast("double") * _unit(F.col("domain_score")), 6)
    return found.select("goal", "person", "domain_score", final.alias("llm_score"), F.when(there, F.map_from_entries(F.sort_array(entries))).alias("covered"), F.when(there, rest).alias("missing"))


def evidence(pairs: DataFrame, rows: DataFrame, limit: int = 200) -> DataFrame:
    """Flat evidence: pairs once for each (person, section, requirement, specialization), best pair first, then best requirement, at most `limit` a goal."""
    best = pairs.groupBy("goal", "person", "section", "idx", "spec_idx").agg(F.max("score").alias("score"))
    with_need = best.join(rows.select("goal", "person", "section", "idx", F.col("c").alias("need_score")), ["goal", "person", "section", "idx"])
    return _first_evidence(with_need, limit)


def _first_evidence(rows: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("goal").orderBy(F.desc("score"), F.desc("need_score"), "person", "section", "idx", "spec_idx")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def text_evidence(candidates: DataFrame, requirements: DataFrame, specializations: DataFrame, score, limit: int = 200) -> DataFrame:
    """`evidence` of the pairs that `pair_scores` would give and their `means`, without a row for each pair.

    A goal's people are dealt over tasks by hash, section by section, as lists of their specializations.
    A task has the scores of its different specializations with the goal's requirements as a
    matrix, sums a person's rows of it to the means, and passes on its `limit` best pairs.
    """
    needs = requirements.filter((F.trim("text") != "") & F.col("idx").isNotNull()).select("goal", "section", "idx", F.trim("text").alias("text"))
    needs = written(needs, "needs", small=True)
    specs = specializations.filter(F.trim("spec") != "").select("person", "section", "spec_idx", F.trim("spec").alias("spec"))
    own = written(specs.repartition("person").groupBy("person", "section").agg(F.collect_list(F.struct("spec", "spec_idx")).alias("given")), "own")
    # Only sections that the goal asks something in.
    people = candidates.select("goal", "person").distinct().join(needs.select("goal", "section").distinct(), "goal")
    met = own.join(people, ["person", "section"])
    most = met.groupBy("goal", "section").agg(F.sum(F.size("given")).alias("n")).agg(F.max("n")).first()[0] or 0
    met = met.withColumn("part", F.pmod(F.xxhash64("person"), F.lit(-(-most // TASK_ROWS) or 1)))
    keys = ["goal", "section", "part"]
    texts = F.array_distinct(F.transform("given", lambda x: x["spec"]))
    held = written(met.select(*keys, F.explode(texts).alias("spec")).distinct(), "held")
    pairs = held.select("goal", "section", "spec").distinct().join(needs.select("goal", "section", "text").distinct(), ["goal", "section"])
    known = written(score(pairs.select("text", "spec").distinct()).select("text", "spec", _unit(F.col("score")).alias("score")), "known")
    scored = pairs.join(known, ["text", "spec"]).join(needs, ["goal", "section", "text"])
    lists = scored.groupBy("goal", "section", "spec").agg(F.sort_array(F.collect_list(F.struct("idx", "text", "score"))).alias("asked"))
    lists = lists.withColumn("asked", F.transform("asked", lambda x: F.struct(x["idx"].alias("idx"), x["score"].alias("score"))))
    kinds = {c: df.schema[c].dataType.simpleString() for df, names in ((candidates, ["goal", "person"]), (needs, ["section", "idx"]), (specs, ["spec_idx"])) for c in names}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("goal", "person", "section", "idx", "spec_idx")) + ", score double, need_score double"

    def search(key, own: pa.Table, known: pa.Table) -> pa.Table:
        return _best_pairs(own, known, max(1, limit))

    asked = held.join(lists, ["goal", "section", "spec"]).select(*keys, "spec", "asked").groupBy(*keys)
    best = met.select(*keys, "person", "given").groupBy(*keys).cogroup(asked).applyInArrow(search, schema)
    best = written(best, "best", small=True)
    forget(own, held, known, needs)
    return _first_evidence(best, limit)


def _best_pairs(own: pa.Table, known: pa.Table, limit: int) -> pa.Table:
    """The `limit` best pairs (goal, person, section, idx, spec_idx, score, need_score) of people (person, given) of one goal and section; known: (spec, asked)."""
    given, asked = (t.column(c).combine_chunks() for t, c in ((own, "given"), (known, "asked")))
    sizes, values = pc.list_value_length(given).to_numpy(), given.flatten()
    spec = pc.index_in(values.field("spec"), value_set=known.column("spec").combine_chunks()).to_numpy()
    idx = asked[0].values.field("idx")
    scores = asked.flatten().field("score").to_numpy().reshape(len(asked), -1)
    # Requirements of one idx stand together: a pair has its best score, a mean counts all.
    names = pc.rank(idx, "ascending", tiebreaker="dense").to_numpy()
    at = np.flatnonzero(np.diff(names, prepend=0))
    best, total, times = np.maximum.reduceat(scores, at, 1), np.add.reduceat(scores, at, 1), np.diff(np.append(at, len(names)))
    rank = lambda x: pc.rank(x, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    person, place = rank(own.column("person").combine_chunks()), rank(values.field("spec_idx"))
    ends = np.cumsum(sizes)
    levels = np.unique(best)[::-1]
    found: list[tuple[np.ndarray, ...]] = []
    low = 0
    while low < len(sizes):
        begin = ends[low] - sizes[low]
        high = max(low + 1, int(np.searchsorted(ends, begin + max(1, CELLS // len(at)), side="right")))
        its = spec[begin : ends[high - 1]]
        who = np.repeat(np.arange(low, high), sizes[low:high])
        mean = np.add.reduceat(total[its], ends[low:high] - sizes[low:high] - begin) / (sizes[low:high, None] * times)
        mean = np.floor(mean * 1e6 + 0.5).astype(np.int64)
        kept: set[tuple] = set()
        for level in levels:
            row, need = np.nonzero((best == level)[its])
            keys = (place[begin + row], need, who[row], -mean[who[row] - low, need])
            take = limit
            while len(row):
                some = np.flatnonzero(keys[3] <= np.partition(keys[3], take - 1)[take - 1]) if take < len(row) else np.arange(len(row))
                some = some[np.lexsort((keys[0][some], keys[1][some], person[keys[2][some]], keys[3][some]))]
                # The same requirement and spec_idx of a person once, by the best score.
                name = np.stack([k[some] for k in keys[:3]])
                once = some[np.append(True, (name[:, 1:] != name[:, :-1]).any(0))][: limit + len(kept)]
                once = [i for i in once.tolist() if (keys[0][i], keys[1][i], keys[2][i]) not in kept]
                if len(once) >= limit or take >= len(row):
                    chosen = np.array(once[:limit], np.int64)
                    found.append((np.full(len(chosen), level), keys[3][chosen], keys[2][chosen], need[chosen], begin + row[chosen], keys[0][chosen]))
                    kept.update((keys[0][i], keys[1][i], keys[2][i]) for i in chosen)
                    break
                take *= 4
            if len(kept) >= limit:
                break
        low = high
    score, less, owner, need, row, turn = (np.concatenate(x) for x in zip(*found))
    first = np.lexsort((turn, need, person[owner], less, -score))[:limit]
    owner, need, row = owner[first], need[first], row[first]
    columns = {
        "goal": own.column("goal").take(pa.array(owner)), "person": own.column("person").take(pa.array(owner)), "section": own.column("section").take(pa.array(owner)),
        "idx": idx.take(pa.array(at[need])), "spec_idx": values.field("spec_idx").take(pa.array(row)), "score": pa.array(score[first]), "need_score": pa.array(-less[first] / 1e6),
    }
    return pa.table(columns)


def gaps(held: DataFrame, most: float = 0.05, limit: int = 5) -> DataFrame:
    """(goal, text, weight, rank): the heaviest requirements that a team covers at most by `most`, each text once."""
    low = held.filter(F.col("c") <= most).groupBy("goal", F.lower(F.trim("text")).alias("key")).agg(F.max(F.struct("weight", F.trim("text").alias("text"))).alias("x"))
    order = Window.partitionBy("goal").orderBy(F.desc("x.weight"), "key")
    return low.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("goal", "x.text", "x.weight", "rank")


def member_coverage(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The greatest value for each key: what a member covers over all rows of a match."""
    return rows.groupBy(*keys).agg(F.max(value).alias(value))


def pool(scores: DataFrame, size: int) -> DataFrame:
    """The `size` best people of each goal."""
    rank = F.row_number().over(Window.partitionBy("goal").orderBy(F.desc("score"), "person"))
    return scores.withColumn("__rank", rank).filter(F.col("__rank") <= size).drop("__rank")


def zero_filled(held: DataFrame, requirements: DataFrame, people: DataFrame) -> DataFrame:
    """(goal, person, idx, weight, c) for all people: 0 for whoever has no row for a requirement."""
    full = people.join(requirements, "goal")
    return full.join(held.select("goal", "person", "idx", "c"), ["goal", "person", "idx"], "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
