"""Text vectors and pair scores. A caller may give a function of its own; the defaults are deterministic."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions import text as T

#: Texts -> one vector each. Loaded models belong in a cached factory inside it, so that a worker loads once.
Embed = Callable[[list[str]], list[list[float]]]


def hashed_vector(text: Column, size: int = 64) -> Column:
    """A vector that counts the text's tokens by hash; null for a text without tokens."""
    places = F.sort_array(F.transform(T.tokens(F.coalesce(text, F.lit(""))), lambda t: F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("int") % size))
    zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n)

    def counts(x: Column) -> Column:
        """A count for each place that occurs, after zeros for those between it and the one before."""
        at, ends = x["at"], x["ends"]
        start = lambda i: F.coalesce(F.array_position(at, F.get(ends, i)), F.size(at) + 1)
        runs = F.transform(ends, lambda p, i: F.concat(zeros(p - F.when(i == 0, -1).otherwise(F.get(ends, i - 1)) - 1), F.array((start(i + 1) - start(i)).cast("float"))))
        return F.concat(F.flatten(runs), zeros(size - 1 - F.element_at(ends, -1)))

    listed = lambda at: T._let(F.struct(at.alias("at"), F.array_distinct(at).alias("ends")), counts)
    return T._let(places, lambda at: F.when(F.size(at) > 0, listed(at)))


def embedded(df: DataFrame, text: str, into: str, embed: Embed | None = None, key: str | None = None) -> DataFrame:
    """df with a vector of the trimmed text, null for blank ones; each different text is embedded once."""
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    texts = df.select(trimmed.alias("__text")).filter("__text <> ''").distinct()
    if embed is None:
        known = texts.withColumn(into, hashed_vector(F.col("__text")))
    else:

        def run(batches):
            for batch in batches:
                yield pd.Series(embed(batch.tolist()))

        known = texts.withColumn(into, F.pandas_udf(run, "array<float>", F.PandasUDFType.SCALAR_ITER)("__text"))
    return df.withColumn("__text", trimmed).join(known, "__text", "left").drop("__text")


def bucket_text(texts: Column) -> Column:
    """Texts of a list as one, by semicolons; null if all are blank."""
    clean = F.filter(F.transform(texts, lambda x: F.trim(x)), lambda x: x != "")
    return F.nullif(F.array_join(clean, " ; "), F.lit(""))


def token_overlap(left: Column, right: Column) -> Column:
    """Shared tokens over all tokens of both texts, stop words aside; 0 if a side has none."""
    def score(x: Column) -> Column:
        union = F.size(F.array_union(x["a"], x["b"]))
        return F.when((F.size(x["a"]) == 0) | (F.size(x["b"]) == 0), 0.0).otherwise(F.size(F.array_intersect(x["a"], x["b"])) / union)

    return T._let(F.struct(T.match_tokens(left, 1).alias("a"), T.match_tokens(right, 1).alias("b")), score)


def pair_scorer(score: Callable[[list[str], list[str]], list[float]] | None = None, left: str = "text", right: str = "spec"):
    """A function for `coverage.pair_scores`: adds `score` to different pairs of texts; by default their token overlap."""

    def add(pairs: DataFrame) -> DataFrame:
        if score is None:
            return pairs.withColumn("score", token_overlap(F.col(left), F.col(right)))

        def run(batches):
            for a, b in batches:
                yield pd.Series(score(a.tolist(), b.tolist()), dtype="float64")

        return pairs.withColumn("score", F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)(left, right))

    return add


def rescored(candidates: DataFrame, scores: DataFrame, keys: list[str], base: str, into: str) -> DataFrame:
    """candidates with a scorer's answer, clamped to 0..1; the base score where it has none."""
    known = scores.select(*keys, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("__score"))
    return candidates.join(known, keys, "left").withColumn(into, F.coalesce("__score", base)).drop("__score")
