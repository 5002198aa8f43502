"""Weighted keywords: documents of keywords, concepts, clusters of them, merging over batches and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.functions import text as T
from weftline.functions.graph import components
from weftline.operators.vectors import dot, links_over
from weftline.session import written

SECTIONS = ("research", "application")


# ---- keyword documents

def specializations(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, section, pos, t, w) from keyword documents in JSON text.

    Items are strings (weight 1) or objects with t and w (weight 1 if it is missing or no number);
    others are left out. A section may itself be JSON text. pos is the item's place in its list.
    """
    parsed = docs.select(key, F.try_parse_json(column).alias("doc"))
    section = lambda s: F.coalesce(
        F.try_variant_get("doc", f"$.{s}.specialization", "array<variant>"),
        F.try_variant_get(F.try_parse_json(F.try_variant_get("doc", f"$.{s}", "string")), "$.specialization", "array<variant>"),
    )
    lists = parsed.select(key, F.explode(F.array(*(F.struct(F.lit(s).alias("section"), section(s).alias("items")) for s in SECTIONS))).alias("x"))
    rows = lists.select(key, "x.section", F.posexplode("x.items").alias("pos", "item"))
    plain = F.schema_of_variant("item") == "STRING"
    text = F.when(plain, F.try_variant_get("item", "$", "string")).otherwise(F.try_variant_get("item", "$.t", "string"))
    weight = F.when(plain, 1.0).otherwise(F.coalesce(F.try_variant_get("item", "$.w", "double"), F.lit(1.0)))
    return rows.select(key, "section", "pos", text.alias("t"), weight.alias("w")).filter("t is not null")


def domains(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, section, pos, t): the domain texts of keyword documents, single-spaced, blanks left out."""
    parsed = docs.select(key, F.try_parse_json(column).alias("doc"))
    lists = F.array(*(F.struct(F.lit(s).alias("section"), F.try_variant_get("doc", f"$.{s}.domain", "array<string>").alias("items")) for s in SECTIONS))
    rows = parsed.select(key, F.explode(lists).alias("x")).select(key, "x.section", F.posexplode("x.items").alias("pos", "t"))
    return rows.withColumn("t", T.one_space(F.col("t"))).filter("t <> ''")


def inventory(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, domain, specialization): domains once in order, and a map of each specialization's first weight with two decimals."""
    order = F.when(F.col("section") == SECTIONS[0], 0).otherwise(1)
    named = domains(docs, key, column).select(key, F.struct(order.alias("s"), "pos", "t").alias("x"))
    d = named.groupBy(key).agg(F.array_distinct(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"])).alias("domain"))
    specs = specializations(docs, key, column).withColumn("t", F.trim("t")).filter("t <> ''")
    first = specs.groupBy(key, "t").agg(F.min(F.struct(order.alias("s"), "pos", "w")).alias("x"))
    s = first.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("t", T.two_decimals(F.col("x.w")))))).alias("specialization"))
    found = docs.select(key).distinct().join(d, key, "left").join(s, key, "left")
    return found.select(key, F.coalesce("domain", F.array().cast("array<string>")).alias("domain"), F.coalesce("specialization", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("specialization"))


# ---- concepts and clusters

def concepts(mentions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, key, text, n, batches, weights, weight_sum, max_weight) from mentions (by, text, batch, weight, pos).

    key is the normal form of the phrase, text the first mention's, batches the different ones, and
    weights are taken within 0 and 1.
    """
    by = by or []
    key = T.phrase(F.col("text"))
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("weight", F.lit(0.0))))
    # A text's mentions in a batch are added up first, by hash, so that it is made normal once and lists stay short.
    once = mentions.groupBy(*by, "text", "batch").agg(F.min("pos").alias("pos"), F.count("*").alias("n"), F.sum(weight.cast("decimal(28,9)")).alias("sum"), F.max(weight).alias("weight"))
    rows = once.withColumn("key", key).filter("key <> ''")
    return rows.groupBy(*by, "key").agg(
        F.min_by("text", "pos").alias("text"),
        F.sum("n").alias("n"),
        F.sort_array(F.collect_set("batch")).alias("batches"),
        F.sum("sum").alias("weight_sum"),
        F.max("weight").alias("max_weight"),
        F.min("pos").alias("pos"),
    )


def clusters(found: DataFrame, vectors: DataFrame, by: list[str], threshold: float = 0.84) -> DataFrame:
    """(by, cluster, members): concepts joined where their vectors' cosine reaches the threshold, directly or through others.

    vectors: (by, key, vector). Members are ordered by count, batches and greatest weight, all
    falling, then by their first mention; the cluster goes by its first member's key.
    """
    numbered = found.select(*by, "key", F.xxhash64(*by, "key").alias("id"))
    links = links_over(numbered.join(vectors, [*by, "key"]), "id", "vector", threshold, by)
    roots = components(links)
    member = F.struct((-F.col("n")).alias("less_n"), (-F.size("batches")).alias("less_batches"), (-F.col("max_weight")).alias("less_weight"), "pos", "key", "text", "n", "batches", "weight_sum", "max_weight")
    grouped = found.join(numbered, [*by, "key"]).join(roots, "id", "left").groupBy(*by, F.coalesce("root", "id").alias("root"))
    listed = grouped.agg(F.array_sort(F.collect_list(member)).alias("members"))
    return listed.select(*by, F.col("members")[0]["key"].alias("cluster"), "members")


def penalty(label: Column, n: Column) -> Column:
    """1 for a blank label; else for a single mention, for more than 12 words and for digits."""
    words = F.size(F.regexp_extract_all(F.lower(label), F.lit("[a-z0-9]+"), F.lit(0)))
    found = F.when(n <= 1, 0.25).otherwise(0.0) + 0.25 * F.greatest(F.lit(0.0), (words - 12) / 18) + F.when(label.rlike("[0-9]"), 0.10).otherwise(0.0)
    return F.when(F.trim(label) == "", 1.0).otherwise(F.least(F.lit(1.0), found))


def cluster_scores(grouped: DataFrame, by: list[str], n_batches: DataFrame) -> DataFrame:
    """(by, label, support, quality, global_support, batch_coverage, penalty, weight) of clusters (by, members).

    quality is the mean weight of all mentions, global_support the logarithm of the mentions against
    the most mentioned cluster's; n_batches: (by, all_batches).
    """
    total = lambda field, kind: F.aggregate("members", F.lit(0).cast(kind), lambda s, m: (s + m[field]).cast(kind))
    rows = grouped.select(*by, F.col("members")[0]["text"].alias("label"), total("n", "bigint").alias("support"), total("weight_sum", "decimal(28,9)").alias("sum"), F.size(F.array_distinct(F.flatten(F.transform("members", lambda m: m["batches"])))).alias("batches"))
    most = rows.groupBy(*by).agg(F.max("support").alias("most"))
    joined = rows.join(most, by).join(n_batches, by)
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    scored = joined.select(
        *by,
        "label",
        "support",
        (F.col("sum").cast("double") / F.col("support")).alias("quality"),
        (F.log1p("support") / F.log1p(F.greatest("most", F.lit(1)))).alias("global_support"),
        (F.col("batches") / F.greatest("all_batches", F.lit(1))).alias("batch_coverage"),
        penalty(F.col("label"), F.col("support")).alias("penalty"),
    )
    weight = 0.45 * F.col("quality") + 0.35 * F.col("global_support") + 0.20 * F.col("batch_coverage") - 0.25 * F.col("penalty")
    return scored.withColumn("weight", F.round(unit(weight).cast("decimal(28,12)"), 6).cast("double"))


def section_keywords(scored: DataFrame, by: list[str], limit: int = 15) -> DataFrame:
    """The `limit` (1 at least) heaviest labels, with their rank: by weight, support and coverage, all falling, then by name."""
    order = Window.partitionBy(*by).orderBy(F.desc("weight"), F.desc("support"), F.desc("batch_coverage"), "label")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(1, limit))


def valid_label(candidate: Column, aliases: Column, fallback: Column) -> Column:
    """The candidate if it shares a token (no stop word) with an alias, else the fallback."""
    own = T.match_tokens(candidate, 1)
    known = F.flatten(F.transform(aliases, lambda a: T.match_tokens(a, 1)))
    return F.when(F.arrays_overlap(own, known), F.trim(candidate)).otherwise(fallback)


# ---- merging

def merged_once(items: DataFrame, by: list[str], limit: int) -> DataFrame:
    """(by, items): texts of all batches (by, batch, pos, text) single-spaced, each once in order, at most `limit`."""
    clean = T.one_space(F.col("text"))
    rows = items.withColumn("text", clean).filter("text <> ''").groupBy(*by, F.lower("text").alias("key")).agg(F.min(F.struct("batch", "pos", "text")).alias("x"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("x.batch", "x.pos"))).filter(F.col("rank") <= limit)
    return ranked.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "x.text"))), lambda x: x["text"]).alias("items"))


def merged_weights(items: DataFrame, merged: DataFrame, by: list[str]) -> DataFrame:
    """(by, key, t, w, support): the greatest weight of each keyword over batches, its text, and in how many batches it is.

    items: (by, batch, pos, t, w); within a batch a keyword counts by its first row. `merged` (by, t)
    has keywords to keep even if no batch weighs them: weight 0 and support 0. Ties go to the first batch.
    """
    key = F.lower(T.one_space(F.col("t")))
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("w", F.lit(0.0))))
    first = items.select(*by, "batch", "pos", F.trim("t").alias("t"), weight.alias("w"), key.alias("key")).filter("key <> ''").groupBy(*by, "batch", "key").agg(F.min_by(F.struct("t", "w"), "pos").alias("x"))
    best = first.groupBy(*by, "key").agg(F.max(F.struct(F.col("x.w").alias("w"), (-F.col("batch")).alias("turn"), F.col("x.t").alias("t"))).alias("b"), F.count("*").alias("support"))
    rest = merged.select(*by, key.alias("key"), F.trim("t").alias("extra")).filter("key <> ''").groupBy(*by, "key").agg(F.min("extra").alias("extra"))
    both = best.join(rest, [*by, "key"], "full_outer")
    return both.select(*by, "key", F.coalesce("b.t", "extra").alias("t"), F.coalesce("b.w", F.lit(0.0)).alias("w"), F.coalesce("support", F.lit(0)).alias("support"))


def differences(old: DataFrame, new: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows of keys and old_weight, new_weight, change (added, deleted or weight_changed)."""
    both = old.withColumnRenamed("weight", "old_weight").join(new.withColumnRenamed("weight", "new_weight"), keys, "full_outer")
    change = F.when(F.col("old_weight").isNull(), "added").when(F.col("new_weight").isNull(), "deleted").when(F.abs(F.col("new_weight") - F.col("old_weight")) > tolerance, "weight_changed")
    return both.withColumn("change", change).filter(F.col("change").isNotNull())


def keyword_differences(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """differences() of keyword lists (by, pos, t, w) by single-spaced lower-case text; of equal ones the first counts."""

    def first(rows: DataFrame) -> DataFrame:
        keyed = rows.withColumn("key", F.lower(T.one_space(F.col("t")))).filter("key <> ''")
        return keyed.groupBy(*by, "key").agg(F.min_by("w", "pos").alias("weight"))

    return differences(first(old), first(new), [*by, "key"])


def with_sources(requested: DataFrame, added: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """requested with `sources`: those found for added keywords, else the previous ones, else none."""
    a = added.select(*keys, F.col("sources").alias("__added"))
    p = previous.select(*keys, F.col("sources").alias("__before"))
    joined = requested.join(a, keys, "left").join(p, keys, "left")
    return joined.withColumn("sources", F.coalesce("__added", "__before", F.array().cast(added.schema["sources"].dataType))).drop("__added", "__before")


def weight_map(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, weights): the greatest weight of each single-spaced text."""
    best = items.withColumn("t", T.one_space(F.col("t"))).filter("t <> ''").groupBy(*by, "t").agg(F.max("w").alias("w"))
    return best.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("t", "w")))).alias("weights"))


def best_sources(scored: DataFrame, by: list[str], least: float = 0.10, limit: int = 4) -> DataFrame:
    """(by, id, type, score, rank): for each keyword the best sources, each once, over the least score; scores within 0 and 1."""
    rows = scored.filter(F.col("score") >= least).groupBy(*by, "id", "type").agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.max("score"))), 6).alias("score"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "type", "id")))
    return ranked.filter(F.col("rank") <= max(1, limit))


def quality_bands(scores: DataFrame, by: list[str], edges: tuple[float, ...] = (0.75, 0.50, 0.35)) -> DataFrame:
    """(by, n, at_0, at_1, ..., below, mean, least, most): how many scores reach each edge first."""
    s, counts, above = F.col("score"), [], F.lit(False)
    for i, edge in enumerate(edges):
        counts.append(F.count_if((s >= edge) & ~above).alias(f"at_{i}"))
        above = s >= edge
    return scores.groupBy(*by).agg(F.count("*").alias("n"), *counts, F.count_if(s < edges[-1]).alias("below"), F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"))


def attached_sources(keywords: DataFrame, catalog: DataFrame, by: list[str], embed=None, least: float = 0.10, limit: int = 4) -> DataFrame:
    """keywords (by, t, ...) with `sources`: the catalog's rows (by, type, id, excerpt) most like each keyword, by the cosine of their vectors.

    A keyword has at most `limit` sources of `least` or more (as rounded to 6 digits), best first; equal
    keywords (in any case and spacing) have the same ones, and one without a source has an empty list. An owner's catalog
    is bounded (see payloads.source_catalog), so owners' keywords meet it in a join.
    """
    from weftline.models.scorers import embedded

    keyed = keywords.withColumn("__key", F.lower(T.one_space(F.col("t"))))
    left = embedded(keyed.select(*by, "__key").filter("__key <> ''").distinct(), "__key", "__x", embed)
    right = embedded(catalog.select(*by, "type", "id", "excerpt"), "excerpt", "__y", embed).drop("excerpt")
    # Lengths are taken once for each text, so that a pair costs one product (see vectors.cosine).
    left, right = (df.filter(F.col(x).isNotNull()).withColumn(f"{x}n", F.sqrt(dot(F.col(x), F.col(x)))) for df, x in ((left, "__x"), (right, "__y")))
    norms = F.col("__xn") * F.col("__yn")
    met = left.join(right, by).filter(F.size("__x") == F.size("__y"))
    met = met.withColumn("score", F.round(F.when(norms <= 1e-12, 0.0).otherwise(dot(F.col("__x"), F.col("__y")) / norms), 6))
    best = best_sources(met, [*by, "__key"], least, limit)
    lists = best.groupBy(*by, "__key").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "type", "id", "score"))), lambda x: F.struct(x["type"].alias("type"), x["id"].alias("id"), x["score"].alias("score"))).alias("sources"))
    found = keyed.join(lists, [*by, "__key"], "left").drop("__key")
    return found.withColumn("sources", F.coalesce("sources", F.array().cast(lists.schema["sources"].dataType)))


def mentions_of_words(contents: DataFrame, by: list[str], least: int = 4) -> DataFrame:
    """(by, text, batch, weight, pos) from contents (by, pos, batch, text): the words of `least` characters that are no stop words.

    A word weighs a tenth for each character, 1 at most: a stand-in for a model that names phrases.
    """
    words = contents.select(*by, "batch", F.col("pos").alias("__at"), F.posexplode(T.match_tokens(F.col("text"), least)).alias("__i", "text"))
    return words.select(*by, "text", "batch", F.least(F.lit(1.0), F.char_length("text") / 10).alias("weight"), (F.col("__at").cast("bigint") * (1 << 24) + F.col("__i")).alias("pos"))


def generated(contents: DataFrame, by: list[str], extract=mentions_of_words, embed=None, batch_chars: int = 50_000, most: int = 50, limit: int = 20, sources: int = 4) -> DataFrame:
    """(by, t, weight, rank, sources): keywords of an owner's contents (by, pos, text), end to end.

    Contents are packed into batches of `batch_chars`; `extract` names phrases in them (by, text, batch,
    weight, pos), of which the `most` heaviest of a batch stay; phrases become concepts, like concepts
    one cluster, and the `limit` heaviest clusters keywords, each with the contents most like
    it. Owners without a phrase have no row.
    """
    from weftline.models.scorers import embedded
    from weftline.operators.tables import batches

    rows = contents.withColumn("text", F.trim("text")).filter("text <> ''")
    packed = batches(rows, by, ["pos"], F.char_length("text"), batch_chars).join(rows, [*by, "pos"])
    named = extract(packed, by)
    turn = F.row_number().over(Window.partitionBy(*by, "batch").orderBy(F.desc("weight"), "pos"))
    named = written(named.withColumn("__turn", turn).filter(F.col("__turn") <= most).drop("__turn"), "mentions")
    found = written(concepts(named, by), "concepts")
    vectors = embedded(found.select(*by, "key"), "key", "vector", embed)
    all_batches = named.groupBy(*by).agg(F.countDistinct("batch").alias("all_batches"))
    scored = cluster_scores(clusters(found, vectors.filter("vector IS NOT NULL"), by), by, all_batches)
    top = section_keywords(scored, by, limit).select(*by, F.col("label").alias("t"), "weight", "rank")
    catalog = rows.select(*by, F.lit("content").alias("type"), F.col("pos").alias("id"), F.col("text").alias("excerpt"))
    return attached_sources(top, catalog, by, embed, limit=sources)
