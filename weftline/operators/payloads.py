"""Nested documents from rows: what an explanation or a scorer is given. Each is a join and a struct."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.functions import text as T
from weftline.session import written


def _listed(rows: DataFrame, key: str, order: list[Column], fields: list[str], name: str) -> DataFrame:
    """(key, name): structs of the fields, in order."""
    named = [o.alias(f"__{i}") for i, o in enumerate(order)]
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*named, *fields))).alias("__x"))
    return lists.select(key, F.transform("__x", lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(name))


def _attached(entities: DataFrame, lists: DataFrame, key: str, name: str) -> DataFrame:
    empty = F.array().cast(lists.schema[name].dataType)
    return entities.join(lists, key, "left").withColumn(name, F.coalesce(name, empty))


def person_context(people: DataFrame, chunks: DataFrame, publications: DataFrame, key: str) -> DataFrame:
    """people with `chunks` (source, chunk_index, content; by source and place), `publications` (title, abstract, year;
    newest first, undated last) and the counts of both."""
    found = _attached(people, _listed(chunks, key, [F.col("source"), F.col("chunk_index")], ["source", "chunk_index", "content"], "chunks"), key, "chunks")
    order = [-F.coalesce(F.col("year"), F.lit(0)), F.col("title")]
    found = _attached(found, _listed(publications, key, order, ["title", "abstract", "year"], "publications"), key, "publications")
    return found.withColumns({"n_chunks": F.size("chunks"), "n_publications": F.size("publications")})


def opportunity_context(goals: DataFrame, infos: DataFrame, attachments: DataFrame, key: str) -> DataFrame:
    """goals with two families of chunks and `link`, the first source of the first."""
    found = _attached(goals, _listed(infos, key, [F.col("source"), F.col("chunk_index")], ["source", "chunk_index", "content"], "infos"), key, "infos")
    found = _attached(found, _listed(attachments, key, [F.col("source"), F.col("chunk_index")], ["source", "chunk_index", "content"], "attachments"), key, "attachments")
    return found.withColumn("link", F.get("infos", F.lit(0))["source"])


def merged_content(parts: DataFrame, key: str) -> DataFrame:
    """(key, content): texts of (key, family, place, text) in order, each once, with blank lines between."""
    lists = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("family", "place", "text"))).alias("x"))
    return lists.select(key, T.joined_once(F.transform("x", lambda x: x["text"])).alias("content"))


def contents(parts: DataFrame, key: str, fallback: DataFrame) -> DataFrame:
    """(key, contents): texts in order, each once, or the fallback text (key, text) where there are none."""
    clean = parts.withColumn("text", F.trim("text")).filter("text <> ''")
    lists = clean.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("family", "place", "text"))).alias("x"))
    found = fallback.join(lists.select(key, F.array_distinct(F.transform("x", lambda x: x["text"])).alias("own")), key, "left")
    spare = F.filter(F.array(F.trim("text")), lambda x: x != "")
    return found.select(key, F.coalesce("own", spare, F.array().cast("array<string>")).alias("contents"))


def person_query(people: DataFrame, publications: DataFrame, key: str, biography: str, most: int = 5) -> DataFrame:
    """(key, query): the biography and, on a line of its own, the newest titles."""
    titled = publications.withColumn("title", T.one_space(F.col("title"))).filter("title <> ''")
    lists = titled.groupBy(key).agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct(F.coalesce("year", F.lit(0)).alias("year"), "id", "title")))), 1, most).alias("x"))
    line = F.concat(F.lit("Recent publications: "), F.array_join(F.transform("x", lambda x: x["title"]), "; "))
    return people.join(lists, key, "left").select(key, T.search_text(F.col(biography), F.when(F.size("x") > 0, line)).alias("query"))


def matching_inputs(requirements: DataFrame, members: DataFrame, scores: DataFrame) -> DataFrame:
    """(goal, requirements, coverage, scores, people): requirement weights by name, each person's coverage by name, scores by person.

    People are in order, in coverage too, so that its entries go with them and none has to be looked up.
    requirements: (goal, name, weight); members: (goal, person, name, c); scores: (goal, person, score).
    """
    needs = requirements.groupBy("goal").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "weight")))).alias("requirements"))
    own = members.repartition("goal", "person").groupBy("goal", "person", "name").agg(F.max("c").alias("c")).groupBy("goal", "person").agg(F.sort_array(F.collect_list(F.struct("name", "c"))).alias("own"))
    listed = own.groupBy("goal").agg(F.sort_array(F.collect_list(F.struct("person", "own"))).alias("x"))
    covered = listed.select("goal", F.map_from_entries(F.transform("x", lambda x: F.struct(x["person"], F.map_from_entries(x["own"])))).alias("coverage"), F.transform("x", lambda x: x["person"]).alias("people"))
    rated = scores.groupBy("goal", "person").agg(F.max("score").alias("score")).groupBy("goal").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("person", "score")))).alias("scores"))
    return needs.join(covered, "goal").join(rated, "goal", "left")


def matching_parts(requirements: DataFrame, members: DataFrame, scores: DataFrame, most: int = 1000) -> DataFrame:
    """(goal, part, requirements, coverage, scores, people): `matching_inputs` in parts of at most `most` people, numbered in the order of people.

    No row grows with a goal's people. Requirements stand in each part. Who has a score but no
    coverage counts as a person of his part, but is not in its people.
    """
    needs = requirements.groupBy("goal").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "weight")))).alias("requirements"))
    own = members.repartition("goal", "person").groupBy("goal", "person", "name").agg(F.max("c").alias("c")).groupBy("goal", "person").agg(F.sort_array(F.collect_list(F.struct("name", "c"))).alias("own"))
    rated = scores.groupBy("goal", "person").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("goal").orderBy("person")) - 1
    # Names wait in the table while people are numbered: only their ids are sorted as a whole.
    people = written(own.join(rated, ["goal", "person"], "full_outer"), "people")
    dealt = people.select("goal", "person").withColumn("part", F.floor(place / most))
    lists = people.join(dealt, ["goal", "person"]).groupBy("goal", "part").agg(F.sort_array(F.collect_list(F.struct("person", "own", "score"))).alias("x"))
    held = F.filter("x", lambda x: x["own"].isNotNull())
    known = F.filter("x", lambda x: x["score"].isNotNull())
    covered = F.map_from_entries(F.transform(held, lambda x: F.struct(x["person"], F.map_from_entries(x["own"]))))
    parts = lists.select("goal", "part", covered.alias("coverage"), F.map_from_entries(F.transform(known, lambda x: F.struct(x["person"], x["score"]))).alias("scores"), F.transform(held, lambda x: x["person"]).alias("people"))
    return needs.join(parts, "goal").select("goal", "part", "requirements", "coverage", "scores", "people")


def joined_parts(parts: DataFrame, text: str) -> DataFrame:
    """(goal, needs, hash, people, best) of parts (goal, part, needs, text, people, best): the md5 of a goal's texts in the order of parts, by commas, its people as one text, the best of all.

    A goal's texts go through one task one after another and are never held together.
    """
    goal = parts.schema["goal"].dataType.simpleString()

    def run(batches):
        name, state = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((name, state[0], state[1].hexdigest(), ",".join(state[2]), state[3]), kinds)], names=["goal", "needs", "hash", "people", "best"])
        for batch in batches:
            kinds = [batch.schema.field("goal").type, pa.string(), pa.string(), pa.string(), pa.float64()]
            for own, needs, said, people, best in zip(*(batch.column(c) for c in ("goal", "needs", text, "people", "best"))):
                if state is None or own.as_py() != name:
                    if state is not None:
                        yield done()
                    name, state = own.as_py(), [needs.as_py(), hashlib.md5(), [], None]
                if people.as_py():  # a part of scores alone has no text
                    state[1].update((("," if state[2] else "") + said.as_py()).encode())
                    state[2].append(people.as_py())
                state[3] = max((x for x in (state[3], best.as_py()) if x is not None), default=None)
        if state is not None:
            yield done()

    rows = parts.select("goal", "part", "needs", text, "people", "best").repartition("goal").sortWithinPartitions("goal", "part")
    return rows.mapInArrow(run, f"goal {goal}, needs string, hash string, people string, best double")


def rerank_inventory(matches: DataFrame, one: DataFrame, many: DataFrame, one_key: str, many_key: str, score: str) -> DataFrame:
    """(one_key, own, candidates): an inventory (key, domain, specialization) beside those of its matches, best first."""
    fields = ["domain", "specialization"]
    other = many.select(many_key, F.struct(*fields).alias("inventory"))
    rows = matches.join(other, many_key).select(one_key, F.struct((-F.col(score)).alias("turn"), many_key).alias("place"), F.struct(F.col(many_key), F.col(score), "inventory").alias("x"))
    lists = rows.groupBy(one_key).agg(F.collect_list(F.struct("place", "x")).alias("l"))
    ordered = F.transform(F.array_sort("l", lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0)), lambda r: r["x"])
    return one.select(one_key, F.struct(*fields).alias("own")).join(lists.select(one_key, ordered.alias("candidates")), one_key)


def team_context(teams: DataFrame, goals: DataFrame, people: DataFrame, held: DataFrame) -> DataFrame:
    """(goal, rank, ..., members): each team with its members' rows, in order, and what each covers.

    teams: (goal, rank, team, score); goals: (goal, ...); people: (person, name); held: (goal, person, name, c).
    """
    own = held.select("goal", "person", F.col("name").alias("need"), "c").groupBy("goal", "person").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("need", "c")))).alias("covers"))
    rows = teams.select("goal", "rank", F.posexplode("team").alias("place", "person")).join(people, "person").join(own, ["goal", "person"], "left")
    lists = rows.groupBy("goal", "rank").agg(F.sort_array(F.collect_list(F.struct("place", "person", "name"))).alias("members"), F.map_from_entries(F.collect_list(F.when(F.col("covers").isNotNull(), F.struct("person", "covers")))).alias("coverage"))
    return teams.join(goals, "goal").join(lists, ["goal", "rank"])


def expanded_teams(results: DataFrame, team: str) -> DataFrame:
    """One row for each member of each team, ids given as text with commas; what is no number drops out."""
    ids = F.transform(F.split(F.coalesce(team, F.lit("")), ",", -1), lambda x: F.trim(x).try_cast("bigint"))
    return results.select(*(c for c in results.columns if c != team), F.posexplode(F.filter(ids, lambda x: x.isNotNull())).alias("place", "person"))


def profiles(people: DataFrame, publications: DataFrame, key: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """people with their publications of the years first..last, newest first, the first and latest year of all, and the year fetched up to.

    Publications without a year are left out only where a bound is set.
    """
    year = F.col("year")
    inside = (year.isNotNull() if first is not None or last is not None else F.lit(True)) & (F.lit(True) if first is None else year >= first) & (F.lit(True) if last is None else year <= last)
    inside = F.coalesce(inside, F.lit(False))
    item = F.when(inside, F.struct((-F.coalesce(year, F.lit(0))).alias("turn"), "title", "year"))
    found = publications.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("x"), F.min("year").alias("first_year"), F.max("year").alias("latest_year"), F.max(F.when(inside, year)).alias("fetched_upto"))
    lists = found.select(key, F.transform("x", lambda x: F.struct(x["title"].alias("title"), x["year"].alias("year"))).alias("publications"), "first_year", "latest_year", "fetched_upto")
    return _attached(people, lists, key, "publications")


def decoded(held: DataFrame, labels: DataFrame, least: float = 0.0) -> DataFrame:
    """(goal, person, covered, missing): names of the requirements over `least` and of the others; unknown numbers drop out.

    held: (goal, person, idx, c); labels: (goal, idx, label).
    """
    named = held.join(labels, ["goal", "idx"])
    return named.groupBy("goal", "person").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("c") > least, F.struct("idx", "label")))), lambda x: x["label"]).alias("covered"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("c") <= least, F.struct("idx", "label")))), lambda x: x["label"]).alias("missing"),
    )


def source_texts(references: DataFrame, sources: DataFrame, by: list[str], most: int) -> DataFrame:
    """(by, texts): the texts of referred rows (by, rank, type, id), in order, different ones, at most `most`.

    sources: (type, id, text).
    """
    rows = references.join(sources, ["type", "id"]).withColumn("text", T.one_space(F.col("text"))).filter("text <> ''")
    lists = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", "type", "id", "text"))).alias("x"))
    return lists.select(*by, F.slice(F.array_distinct(F.transform("x", lambda x: x["text"])), 1, most).alias("texts"))


def source_catalog(families: list[tuple[str, DataFrame]], key: str, most: int = 120, size: int = 260) -> DataFrame:
    """(key, type, id, excerpt, place): excerpts of all families (key, id, text) in their order, equal ones once, at most `most` a key."""
    from pyspark.sql import Window

    rows = None
    for turn, (kind, df) in enumerate(families):
        part = df.select(key, F.lit(turn).alias("turn"), F.lit(kind).alias("type"), "id", T.excerpt(F.col("text"), size).alias("excerpt"))
        rows = part if rows is None else rows.unionByName(part)
    once = rows.filter("excerpt <> ''").dropDuplicates([key, "type", "id", "excerpt"])
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("turn", "id", "excerpt")))
    return placed.filter(F.col("place") <= most).drop("turn")


def details(people: DataFrame, wanted: DataFrame, members: DataFrame, keywords: DataFrame, key: str) -> DataFrame:
    """People of the wanted ids with their domains and whether they are members already; unknown ids drop out.

    wanted and members: one column of ids each; keywords: (key, section, domains). A person without
    keywords has empty domains.
    """
    asked = wanted.select(F.col(wanted.columns[0]).alias(key)).distinct()
    mine = members.select(F.col(members.columns[0]).alias(key), F.lit(True).alias("__member")).distinct()
    none = F.array().cast("array<string>")
    domains = keywords.groupBy(key).agg(*(F.max(F.when(F.col("section") == s, F.col("domains"))).alias(f"{s}_domains") for s in ("research", "application")))
    found = people.join(asked, key, "left_semi").join(domains, key, "left").join(mine, key, "left")
    return found.withColumns({"research_domains": F.coalesce("research_domains", none), "application_domains": F.coalesce("application_domains", none), "is_existing_member": F.coalesce("__member", F.lit(False))}).drop("__member")


def evidence_titles(items: DataFrame, references: DataFrame, titles: DataFrame, by: list[str], most: int = 2) -> DataFrame:
    """(by, t, w, titles): each single-spaced text's greatest weight and the first `most` different titles that its sources name.

    items: (by, pos, t, w); references: (by, pos, rank, id) of an item's publications; titles: (id,
    title). An earlier item's titles come first, blank and unknown ones drop out. pos and rank are
    integers: places are aggregated as one number, by hash, where a least struct would sort all references.
    """
    keyed = items.withColumn("t", T.one_space(F.col("t"))).filter("t <> ''")
    named = titles.select("id", T.one_space(F.col("title")).alias("title")).filter("title <> ''")
    cited = keyed.select(*by, "pos", "t").join(references, [*by, "pos"]).join(named, "id")
    at = F.col("pos").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.coalesce("rank", F.lit(-1))
    first = cited.groupBy(*by, "t", "title").agg(F.min(at).alias("at"))
    lists = first.groupBy(*by, "t").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("at", "title"))), lambda x: x["title"]), 1, most).alias("titles"))
    weights = keyed.groupBy(*by, "t").agg(F.round(F.max(F.coalesce("w", F.lit(0.0))), 6).alias("w"))
    return weights.join(lists, [*by, "t"], "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))


def justification_inputs(teams: DataFrame, goals: DataFrame, needs: DataFrame, people: DataFrame, held: DataFrame, pairs: DataFrame, most: int = 200) -> DataFrame:
    """(goal, rank, ..., requirements, members, coverage, evidence): what a team's justification is written from.

    teams: (goal, rank, team); goals: (goal, ...); needs: (goal, section, idx, text, weight); people:
    (person, name); held: (goal, person, section, idx, c); pairs: (goal, person, section, idx, spec, score).
    requirements maps section.idx to text and weight; members follow the team's order, each with
    what it covers; coverage is the team's best for each requirement; evidence has a line for each
    different pair, best first, `most` at the most. Unnamed people are person_<id>.
    """
    name = F.concat_ws(".", "section", F.col("idx").cast("string")).alias("name")
    # Only what concerns a member of a team is grouped and joined.
    wanted = teams.select("goal", F.explode("team").alias("person")).distinct()
    held, pairs = (x.join(wanted, ["goal", "person"], "left_semi") for x in (held, pairs))
    asked = needs.groupBy("goal").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, F.struct("text", "weight"))))).alias("requirements"))
    rows = teams.select("goal", "rank", F.posexplode("team").alias("place", "person")).join(people, "person", "left")
    rows = rows.withColumn("name", F.coalesce(T.blank_to_null(F.col("name")), F.concat(F.lit("person_"), F.col("person").cast("string"))))
    own = held.filter("c > 0").groupBy("goal", "person").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, "c")))).alias("covered"))
    member = F.struct("place", "person", "name", F.coalesce("covered", F.create_map().cast("map<string,double>")).alias("covered"))
    # Maps have no order, so the places are sorted apart.
    members = rows.join(own, ["goal", "person"], "left").groupBy("goal", "rank").agg(F.collect_list(member).alias("m"))
    ordered = F.array_sort("m", lambda a, b: a["place"] - b["place"])
    best = rows.join(held, ["goal", "person"]).groupBy("goal", "rank", "section", "idx").agg(F.max("c").alias("c"))
    covered = best.groupBy("goal", "rank").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, "c")))).alias("coverage"))
    scored = pairs.groupBy("goal", "person", "section", "idx", "spec").agg(F.max("score").alias("score"))
    said = rows.join(scored, ["goal", "person"]).join(held, ["goal", "person", "section", "idx"]).join(needs.select("goal", "section", "idx", "text"), ["goal", "section", "idx"])
    order = Window.partitionBy("goal", "rank").orderBy(F.desc("score"), F.desc("c"), "person", "section", "idx", "spec")
    said = said.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= most)
    line = F.format_string("[%s] %s | requirement: %s | specialization: %s | pair=%.4f | req=%.4f", "section", "name", "text", "spec", F.col("score").cast("double"), F.col("c").cast("double"))
    texts = said.groupBy("goal", "rank").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("evidence"))
    found = teams.select("goal", "rank", "team").join(goals, "goal").join(asked, "goal", "left").join(members.select("goal", "rank", ordered.alias("members")), ["goal", "rank"], "left")
    return found.join(covered, ["goal", "rank"], "left").join(texts, ["goal", "rank"], "left").withColumn("evidence", F.coalesce("evidence", F.lit("")))
