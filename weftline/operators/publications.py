"""Publications: upserts that keep vectors, lists of several authors, lookups by title, additions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions import text as T


def upserted(old: DataFrame, new: DataFrame, owner: str, order: str) -> DataFrame:
    """Publications (owner, work_id, title, abstract, year, vector) with those of new put in.

    Rows of new without a work id or title are left out; of several with one key the last by `order`
    counts. A blank abstract makes the vector null; a missing vector beside an abstract (its
    embedding failed) leaves the stored one.
    """
    keys, fields = [owner, "work_id"], ["title", "abstract", "year", "vector"]
    whole = new.filter(T.blank_to_null(F.col("work_id")).isNotNull() & T.blank_to_null(F.col("title")).isNotNull())
    last = whole.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("x")).select(*keys, F.lit(True).alias("__new"), *(F.col(f"x.{c}").alias(f"__{c}") for c in fields))
    met = old.join(last, keys, "full")
    vector = F.when(T.blank_to_null(F.col("__abstract")).isNull(), None).otherwise(F.coalesce("__vector", "vector"))
    taken = lambda c: F.when(F.col("__new"), vector if c == "vector" else F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    return met.select(*keys, *(taken(c) for c in fields))


def of_authors(works: DataFrame, authors: DataFrame, first: int, last: int) -> DataFrame:
    """Works (author, pos, work_id, title, year) of the asked authors (author, turn) within the years, a work id once: that of the first author who has it.

    Works without an id are all kept. `place` orders them by year and title, latest first; years that
    are the wrong way round give nothing. Ids are compared in their normal form.
    """
    rows = works.join(authors, "author").filter(F.col("year").between(first, last)).withColumn("work_id", T.work_id(F.col("work_id")))
    known = rows.filter("work_id IS NOT NULL").groupBy("work_id").agg(F.min(F.struct("turn", "pos", "author", "title", "year")).alias("x"))
    fields = ["author", "turn", "pos", "title", "year"]
    once = known.select("work_id", *(F.col(f"x.{c}").alias(c) for c in fields)).unionByName(rows.filter("work_id IS NULL").select("work_id", *fields))
    return once.select("author", "turn", "pos", "work_id", "title", "year", F.struct(F.coalesce("year", F.lit(0)).alias("year"), F.lower(T.one_space(F.coalesce("title", F.lit("")))).alias("title")).alias("sort_key"))


def abstracts(wanted: DataFrame, hits: DataFrame) -> DataFrame:
    """(title, abstract) of each wanted title once, null where no hit has one.

    hits: (query, pos, title, abstract, summary). An abstract of any hit goes before a summary of any;
    among either, hits of exactly this title before others, then the first. Titles are compared in
    lower case and single-spaced.
    """
    key = lambda c: F.lower(T.one_space(c))
    asked = wanted.select(key(F.col("title")).alias("title")).filter("title <> ''").distinct()
    text = F.coalesce(T.blank_to_null(F.col("abstract")), T.blank_to_null(F.col("summary")))
    rank = F.struct(T.blank_to_null(F.col("abstract")).isNull().alias("late"), (key(F.col("title")) != F.col("__q")).alias("other"), "pos")
    found = hits.withColumn("__q", key(F.col("query"))).filter(text.isNotNull()).groupBy(F.col("__q")).agg(F.min_by(text, rank).alias("abstract"))
    return asked.join(found, asked["title"] == F.col("__q"), "left").select("title", "abstract")


def added(current: DataFrame, additions: DataFrame, fetched: DataFrame, owner: str) -> DataFrame:
    """(owner, n, id, title, year, how): what each addition (owner, n, doi, title, year) does to current publications (owner, id, doi, title, year).

    A known DOI updates its publication, else a known title the newest of that title, else it is new
    (id null). Title and year are the given ones, else those fetched for the DOI (doi, title, year),
    else the current ones. An addition without a title from anywhere is `skipped`.
    """
    doi = lambda c: T.doi(F.col(c))
    key = lambda c: F.lower(T.one_space(F.coalesce(c, F.lit(""))))
    fetched = fetched.select(doi("doi").alias("__doi"), F.col("title").alias("__title"), F.col("year").alias("__year")).filter("__doi IS NOT NULL").dropDuplicates(["__doi"])
    asked = additions.select(owner, "n", doi("doi").alias("__doi"), T.blank_to_null(F.col("title")).alias("__given"), F.col("year").alias("__given_year")).join(fetched, "__doi", "left")
    asked = asked.withColumns({"__given": F.coalesce("__given", T.blank_to_null(F.col("__title"))), "__given_year": F.coalesce("__given_year", "__year")})
    newest = F.max_by(F.struct("id", "title", "year"), F.struct(F.coalesce("year", F.lit(0)), "id"))
    by_doi = current.select(owner, doi("doi").alias("__doi"), "id", "title", "year").filter("__doi IS NOT NULL").groupBy(owner, "__doi").agg(newest.alias("same_doi"))
    by_title = current.select(owner, key(F.col("title")).alias("__key"), "id", "title", "year").filter("__key <> ''").groupBy(owner, "__key").agg(newest.alias("same_title"))
    met = asked.join(by_doi, [owner, "__doi"], "left").withColumn("__key", key(F.col("__given"))).join(by_title, [owner, "__key"], "left")
    match = F.coalesce("same_doi", "same_title")
    title = F.coalesce("__given", match["title"])
    how = F.when(title.isNull(), "skipped").when(F.col("same_doi").isNotNull(), "doi").when(F.col("same_title").isNotNull(), "title").otherwise("new")
    return met.select(owner, "n", match["id"].alias("id"), title.alias("title"), F.coalesce("__given_year", match["year"]).alias("year"), how.alias("how"))


def newest_first() -> list[Column]:
    """The order of a list of works (see of_authors): by year, then title, both falling."""
    return [F.desc("sort_key.year"), F.desc("sort_key.title"), F.asc("turn"), F.asc("pos")]
