"""Filters on opportunities and people, and retrieval of text chunks by vector or by words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.functions import text as T

# What an agency's short name stands for.
AGENCIES = {
    "nsf": ["nsf", "national science foundation"],
    "darpa": ["darpa", "defense advanced research projects agency", "defense sciences office", "dso"],
    "nih": ["nih", "national institutes of health", "national institute of health", "hhs nih"],
    "nasa": ["nasa", "national aeronautics and space administration"],
    "doe": ["doe", "department of energy", "u.s. department of energy"],
    "usda": ["usda", "u.s. department of agriculture", "department of agriculture"],
    "fda": ["fda", "food and drug administration"],
    "va": ["va", "vha", "veterans affairs", "veterans health administration"],
    "usace": ["usace", "u.s. army corps of engineers", "army corps of engineers"],
}
# The broad categories that a filter may name.
CATEGORIES = ("basic_research", "applied_research", "educational")


# ---- filters

def in_range(df: DataFrame, least: dict[str, float | None], order: list[Column], limit: int | None = None) -> DataFrame:
    """Rows at or over each bound that is given (null counts as 0), in order, at most `limit`."""
    for column, bound in least.items():
        if bound is not None:
            df = df.filter(F.coalesce(column, F.lit(0.0)) >= bound)
    df = df.orderBy(*order)
    return df if limit is None or limit <= 0 else df.limit(limit)


def containing(df: DataFrame, **parts: str | None) -> DataFrame:
    """Rows whose columns hold the given texts, in any case; blank ones filter nothing, null columns hold nothing."""
    for column, part in parts.items():
        if part and part.strip():
            df = df.filter(F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(part.strip().lower())))
    return df


def by_title(df: DataFrame, title: Column, summary: Column, wanted: str, newest: Column) -> DataFrame:
    """The newest row of the first stage that finds any: equal titles, titles like it, summaries like it (any case).

    % and _ in the wanted text stand for any text and any character in the last two.
    """
    q = wanted.strip().lower()
    like = f"%{q}%"
    stage = F.when(F.lower(title) == q, 1).when(F.lower(title).like(like), 2).when(F.lower(summary).like(like), 3)
    found = df.withColumn("stage", stage if q else F.lit(None).cast("int")).filter("stage is not null")
    return found.orderBy("stage", newest.desc_nulls_last(), *df.columns).limit(1)


def agency_terms(wanted: str | None) -> list[str]:
    """The wanted agency and the aliases of each of its words, in normal form."""
    import re

    plain = lambda s: re.sub(r"[^a-z0-9]+", " ", (s or "").lower()).strip()
    whole = plain(wanted)
    return list(dict.fromkeys([x for x in [whole, *(plain(a) for word in whole.split() for a in AGENCIES.get(word, []))] if x]))


def of_agency(df: DataFrame, agency: Column, wanted: str | None) -> DataFrame:
    """Rows whose agency holds one of the terms; unknown agencies do not, and no terms filter nothing."""
    terms = agency_terms(wanted)
    return df.filter(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(T.free_text(agency), t))) if terms else df


def of_category(df: DataFrame, category: Column, wanted) -> DataFrame:
    """Rows of the wanted broad categories; other wishes filter nothing."""
    asked = [wanted] if isinstance(wanted, str) else list(wanted or [])
    known = [x for x in (str(a or "").strip().lower() for a in asked) if x in CATEGORIES]
    return df.filter(F.lower(F.trim(category)).isin(known)) if known else df


def near_best(df: DataFrame, by: list[str], score: str, least: float = 0.20, margin: float = 0.12) -> DataFrame:
    """Rows whose score is at least `least` and no more than `margin` under the group's best."""
    best = df.groupBy(*by).agg(F.max(F.coalesce(score, F.lit(0.0))).alias("__best"))
    floor = F.greatest(F.lit(least), F.round(F.col("__best") - margin, 9))
    return df.join(best, by).filter(F.coalesce(score, F.lit(0.0)) >= floor).drop("__best")


def best_matches(df: DataFrame, by: list[str], k: int, last: str) -> DataFrame:
    """The k rows with the greatest llm_score, then domain_score, for each group; ties go by `last`."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.coalesce("llm_score", F.lit(0.0))), F.desc(F.coalesce("domain_score", F.lit(0.0))), last)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def freshness(wanted: DataFrame, known: DataFrame, key: str, refreshed: str, now: Column, url: str, days: int = 30) -> DataFrame:
    """wanted with `state`: known, stale (no time, or older than `days`) or unknown; stale ones without a URL count as
    known, unknown ones without a URL (in `wanted`) as failed."""
    joined = wanted.join(known.select(key, refreshed, F.lit(True).alias("__there")), key, "left")
    old = F.col(refreshed).isNull() | (F.col(refreshed) < now - F.expr(f"interval {int(days)} days"))
    has_url = T.blank_to_null(F.col(url)).isNotNull()
    state = F.when(F.col("__there").isNull(), F.when(has_url, "unknown").otherwise("failed")).when(old & has_url, "stale").otherwise("known")
    return joined.select(*wanted.columns, state.alias("state"))


def within_years(df: DataFrame, year: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of the years first..last; rows without a year go only if a bound is set."""
    if first is not None and last is not None and first > last:
        raise ValueError("the first year is after the last")
    if first is not None:
        df = df.filter(F.col(year) >= first)
    return df.filter(F.col(year) <= last) if last is not None else df


def exact_author(df: DataFrame, name: Column, institutions: Column, wanted: str, institution: str) -> DataFrame:
    """Rows with this name and this institution among theirs, in normal form; without an institution there is none."""
    key = lambda c: F.lower(T.one_space(c))
    named = key(name) == key(F.lit(wanted))
    there = F.exists(institutions, lambda x: key(x) == key(F.lit(institution)))
    return df.filter(named & there) if institution.strip() else df.filter(F.lit(False))


def missing_cache(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that lack one of the cached columns."""
    lacks = F.lit(False)
    for c in columns:
        lacks = lacks | F.col(c).isNull()
    return df.filter(lacks)


def usable(status: Column, error: Column, path: Column, vector: Column) -> Column:
    """Chunks that were extracted without an error and have a path and a vector."""
    return status.isin("done", "success") & (F.coalesce(error, F.lit("")) == "") & (F.coalesce(path, F.lit("")) != "") & vector.isNotNull()


# ---- retrieval

def source_key(*parts: Column, row: Column) -> Column:
    """The first part that is not blank, else row:<id>."""
    return F.coalesce(*(T.blank_to_null(p) for p in parts), F.concat(F.lit("row:"), row.cast("string")))


def per_source_by_score(scored: DataFrame, owner: list[str], k: int, last: str) -> DataFrame:
    """(.., best, rank, place): the k best rows of each source, sources with the best row first.

    scored: (owner, source, score, ...); ties go by `last`. place counts an owner's rows in this order.
    """
    own = Window.partitionBy(*owner, "source")
    ranked = scored.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), last))).filter(F.col("rank") <= max(1, k))
    ranked = ranked.withColumn("best", F.max("score").over(own))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(*owner).orderBy(F.desc("best"), "source", "rank")))


def per_source_in_order(rows: DataFrame, owner: list[str], k: int, order: list[str]) -> DataFrame:
    """(.., rank, place): the first k rows of each source in the given order, sources by name."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*owner, "source").orderBy(*order))).filter(F.col("rank") <= max(1, k))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(*owner).orderBy("source", "rank")))


def source_fallback(rows: DataFrame, owners: DataFrame, ranked: DataFrame, k: int, order: list[str]) -> DataFrame:
    """Ranked rows, and for the owners (owner) that have none the first k rows of each source (source, ...), which are chosen once for all."""
    first = per_source_in_order(rows.withColumn("__all", F.lit(0)), ["__all"], k, order).drop("__all")
    rest = owners.select("owner").distinct().join(ranked.select("owner").distinct(), "owner", "left_anti")
    return ranked.unionByName(first.crossJoin(rest), allowMissingColumns=True)


def by_requirements(blocks: DataFrame, queries: DataFrame, owner: list[str], k: int, total: int, least: float = 0.10) -> DataFrame:
    """Blocks by their best requirement: (owner, source, id, chunk_index, idx, lexical, score, place).

    blocks: (owner, source, id, chunk_index, content); queries: (owner, idx, text, coverage). A block's
    score is the greatest lexical score weighted by coverage (the first requirement of equal ones);
    the k best blocks of a source stay, lower chunk first, and `total` of them all (0: no limit).
    """
    met = blocks.join(queries, owner).withColumn("lexical", T.lexical_score(F.col("text"), F.col("content")))
    met = met.withColumn("score", F.round(T.coverage_weighted(F.col("lexical"), F.col("coverage")), 6))
    best = met.groupBy(*owner, "source", "id", "chunk_index").agg(F.max(F.struct("score", (-F.col("idx")).alias("turn"), "lexical")).alias("x"))
    found = best.select(*owner, "source", "id", "chunk_index", (-F.col("x.turn")).alias("idx"), F.round("x.lexical", 6).alias("lexical"), F.col("x.score").alias("score")).filter(F.col("score") >= least)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*owner, "source").orderBy(F.desc("score"), "chunk_index", "id"))).filter(F.col("rank") <= max(1, k))
    placed = ranked.withColumn("place", F.row_number().over(Window.partitionBy(*owner).orderBy(F.desc("score"), "source", "rank"))).drop("rank")
    return placed.filter(F.col("place") <= total) if total > 0 else placed


def two_stage(first: DataFrame, rescore, by: list[str], k: int, last: str, wider: int = 5) -> DataFrame:
    """Retrieve k * wider candidates by domain_score, rescore them (adds llm_score), keep the k best."""
    order = Window.partitionBy(*by).orderBy(F.desc("domain_score"), last)
    pool = first.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= k * wider).drop("__rank")
    return best_matches(rescore(pool), by, k, last)
