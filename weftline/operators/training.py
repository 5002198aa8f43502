"""Training rows for rerankers: candidate sets, ranked pairs and single rows."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.session import written


def candidates(scored: DataFrame, by: list[str], item: str, top: int, hard: int, random: int, seed: int, most: int = 0) -> DataFrame:
    """(by, item, score, kind, place): for each query the `top` best, the `hard` next ones and `random` others, in this order.

    Others are drawn by hash of the seed, so that the same rows come again. A query with fewer than two
    is filled up to two by the best of the rest (kind backfill); one that has but one item drops out. `most`
    keeps that many of each query, two at least; 0 keeps all.
    """
    own = Window.partitionBy(*by)
    placed = scored.withColumn("__place", F.row_number().over(own.orderBy(F.desc("score"), item))).withColumn("__n", F.count("*").over(own)).filter("__n >= 2")
    kind = F.when(F.col("__place") <= top, "top").when(F.col("__place") <= top + hard, "hard")
    kinds = placed.withColumn("kind", kind)
    draw = F.row_number().over(Window.partitionBy(*by, "kind").orderBy(F.xxhash64(F.lit(seed), item), item))
    kinds = kinds.withColumn("__draw", F.when(F.col("kind").isNull(), draw))
    kinds = kinds.withColumn("kind", F.coalesce("kind", F.when(F.col("__draw") <= random, "random")))
    chosen = F.count("kind").over(own)
    left = F.row_number().over(Window.partitionBy(*by, F.col("kind").isNull()).orderBy("__place"))
    kinds = kinds.withColumns({"__chosen": chosen, "__left": left})
    kinds = kinds.withColumn("kind", F.coalesce("kind", F.when(F.col("__left") <= 2 - F.col("__chosen"), "backfill"))).filter("kind IS NOT NULL")
    turn = F.when(F.col("kind") == "random", F.col("__draw")).otherwise(F.col("__place"))
    ordered = kinds.withColumn("place", F.row_number().over(own.orderBy(F.array_position(F.array(*map(F.lit, ("top", "hard", "random", "backfill"))), F.col("kind")), turn)))
    return (ordered.filter(F.col("place") <= max(2, most)) if most > 0 else ordered).select(*by, item, "score", "kind", "place")


def ranks(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df with `place` (from 0) in its query's order and the number of its items."""
    own = Window.partitionBy(*by)
    return df.withColumns({"place": F.row_number().over(own.orderBy(*order)) - 1, "n_items": F.count("*").over(own)})


def pairs(ranked: DataFrame, by: list[str], item: str) -> DataFrame:
    """(by, positive, negative, scores, strength): each better item with each worse one of its query.

    A score falls from 1 to 0 over the places; strength is the difference of places against the greatest.
    """
    better = ranked.select(*by, F.col(item).alias("positive"), F.col("place").alias("__p"), "n_items")
    worse = ranked.select(*by, F.col(item).alias("negative"), F.col("place").alias("__q"))
    met = better.join(worse, by).filter("__p < __q")
    last = F.col("n_items") - 1
    return met.select(*by, "positive", "negative", F.round(1 - F.col("__p") / last, 6).alias("positive_score"), F.round(1 - F.col("__q") / last, 6).alias("negative_score"), F.round((F.col("__q") - F.col("__p")) / last, 6).alias("strength"))


def pointwise(found: DataFrame, by: list[str], least_gap: float = 1e-3, least_weight: float = 0.10, least_strength: float = 0.0) -> DataFrame:
    """(by, item, label, weight): two rows of each pair whose labels differ enough and that is strong enough."""
    strong = found.filter(((F.col("positive_score") - F.col("negative_score")) >= least_gap) & (F.col("strength") >= least_strength))
    weight = F.greatest(F.lit(least_weight), F.col("strength"))
    both = F.array(*(F.struct(F.col(side).alias("item"), F.col(f"{side}_score").alias("label"), weight.alias("weight")) for side in ("positive", "negative")))
    return strong.select(*by, F.explode(both).alias("x")).select(*by, "x.item", "x.label", "x.weight")


def common_dimension(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """(by, dim): the most frequent length of the vectors; of several the least."""
    counts = df.filter(F.col(vector).isNotNull()).groupBy(*by, F.size(vector).alias("dim")).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg((-F.max(F.struct("n", (-F.col("dim")).alias("less")))["less"]).alias("dim"))


def shared_dimension(left: DataFrame, right: DataFrame, vector: str) -> DataFrame:
    """(dim): the length that vectors of both sides have, by the greatest product of their numbers, then sum, then length; no row if none is shared."""
    count = lambda df, n: df.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias(n))
    met = count(left, "a").join(count(right, "b"), "dim")
    return met.agg(F.max(F.struct((F.col("a") * F.col("b")).alias("product"), (F.col("a") + F.col("b")).alias("sum"), "dim")).alias("x")).filter("x IS NOT NULL").select("x.dim")


def training_set(queries: DataFrame, items: DataFrame, embed=None, score=None, top: int = 8, hard: int = 4, random: int = 4, most: int = 16, least_weight: float = 0.0, max_pairs: int = 0, seed: int = 0) -> DataFrame:
    """(query, positive, negative, positive_score, negative_score, strength, kinds) from texts with weights, end to end.

    queries and items: (id, text, weight). Texts under `least_weight` go; the others are embedded and
    those of the dimension that both sides share are compared. A query's candidates are its `top`
    nearest items, the `hard` next ones and `random` others (see candidates); `score` (a pair scorer, by
    default the shared tokens) ranks them, and each better one is paired with each worse one.
    `max_pairs` keeps that many pairs, chosen by hash; 0 keeps all. Others are drawn from one bucket
    of the items for each query, eight times as many as are asked for, so queries never meet all
    items outside the block products.
    """
    from weftline.models.scorers import embedded, pair_scorer
    from weftline.operators.vectors import top_k

    sides = [written(embedded(df.filter(F.col("weight") >= least_weight).select("id", "text"), "text", "first", embed).filter("first IS NOT NULL"), "side") for df in (queries, items)]
    shared = shared_dimension(sides[0], sides[1], "first").first()
    if shared is None:
        raise ValueError("queries and items share no dimension")
    asked, given = (df.filter(F.size("first") == shared["dim"]).withColumn("second", F.lit(None).cast(df.schema["first"].dataType)) for df in sides)
    near = written(top_k(asked, given, top + hard, -1.0).select(F.col("query_id").alias("query"), F.col("item_id").alias("item"), "score"), "near")
    if random > 0:
        buckets = max(1, given.count() // (8 * random))
        bucket = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(buckets))
        others = asked.select(F.col("id").alias("query"), bucket.alias("bucket")).join(given.select(F.col("id").alias("item"), bucket.alias("bucket")), "bucket").drop("bucket")
        # Below all that are near, in an order of their own.
        near = near.unionByName(others.join(near, ["query", "item"], "left_anti").withColumn("score", F.lit(-2.0)))
    found = candidates(near, ["query"], "item", top, hard, random, seed, most)
    texts = found.join(asked.select(F.col("id").alias("query"), F.col("text").alias("__query")), "query").join(given.select(F.col("id").alias("item"), F.col("text").alias("__item")), "item")
    scored = (score or pair_scorer(left="__query", right="__item"))(texts.withColumnRenamed("score", "cosine")).drop("__query", "__item")
    ranked = written(ranks(scored, ["query"], [F.desc("score"), F.desc("cosine"), F.asc("item")]), "ranked")
    made = pairs(ranked, ["query"], "item")
    kind = lambda side: ranked.select("query", F.col("item").alias(side), F.col("kind").alias(f"{side}_kind"))
    made = made.join(kind("positive"), ["query", "positive"]).join(kind("negative"), ["query", "negative"])
    return made.orderBy(F.xxhash64(F.lit(seed), "query", "positive", "negative")).limit(max_pairs) if max_pairs > 0 else made


def fuzzy_matches(rows: DataFrame, by: list[str], title: str, candidate: str, least: float = 0.85, first: int = 3) -> DataFrame:
    """(by, title, candidate, place): the first of the first few candidates (by `place`) whose matching blocks make up `least` of both titles."""

    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b)], dtype="float64")

    near = rows.filter(F.col("place") < first).filter(F.pandas_udf(ratio, "double")(title, candidate) >= least)
    best = near.groupBy(*by).agg(F.min(F.struct("place", title, candidate)).alias("x"))
    return best.select(*by, *(F.col(f"x.{c}").alias(c) for c in (title, candidate, "place")))
