"""Benchmark decontamination by a positional inverted index, with DataFrame functions alone.

The corpus is tokenised once into a written table and counted for the benchmark's vocabulary. Every window of an item (13 words in a
row, or the whole of a shorter item) is probed by its rarest terms: the index holds the postings
(term, document, position) of these terms, and only of these. Subtracting a term's place in the
item from its positions gives the diagonal on which an occurrence would lie; windows whose probe
terms all meet on a diagonal are candidates, and each is compared word by word with the text.

Nothing is collected. Terms and candidate rows are broadcast if their counted rows and bytes stay
under a bound, else joined by shuffle. Postings are keyed by document as well as term, so a passage that a third of
the corpus shares makes no large group.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.session import table, written

WINDOW = 13
PROBES = 3
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20

# Fixed value: a word of the text before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """Words of a text column with A-Z in lower case; null has none."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))
    return F.transform(found, _lower)


def _lower(word: Column) -> Column:
    """lower() is quick, but also changes letters beyond ASCII: those words are translated."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, words, length of its windows and their number; items without words are left out."""
    items = benchmark.filter(F.col("item_id").isNotNull()).select("item_id", words("text").alias("words")).filter(F.size("words") > 0).distinct()
    length = F.least(F.size("words"), F.lit(window))
    return items.select(F.xxhash64("item_id", "words").alias("key"), "item_id", "words", length.alias("length"), (F.size("words") - length + 1).alias("n_windows"))


def tokenised(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number for each row), text_key (md5 of the text) and tokens, written once: all passes read this."""
    text_key = F.md5(F.coalesce("text", F.lit("")))
    return written(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text_key.alias("text_key"), words("text").alias("tokens")), "tokens")


def _small(df: DataFrame) -> bool:
    """Whether a table of numbers and single terms is under BROADCAST_ROWS rows and BROADCAST_BYTES bytes."""
    texts = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    rows, *sizes = df.agg(F.count("*"), *texts).first()
    return rows <= BROADCAST_ROWS and 16 * rows * len(df.columns) + sum(sizes) <= BROADCAST_BYTES


def _spread(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if _small(df) else df


def term_counts(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Occurrences in the corpus of each term of `vocabulary`, where there are any."""
    terms = tokens.select(F.explode("tokens").alias("term"))
    return terms.join(_spread(vocabulary), "term").groupBy("term").agg(F.count("*").alias("n"))


def probes(tokens: DataFrame, items: DataFrame, per_window: int = PROBES) -> DataFrame:
    """Items with `probe` and `near`: for each window the places in the item of its rarest terms.

    Windows with a term that the corpus lacks cannot occur and have an empty probe; `near` takes the
    rarest of the terms that do occur, and is empty where these are fewer than `per_window` (or the
    window's length).
    """
    places = items.select("key", F.posexplode("words").alias("place", "term"))
    vocabulary = written(places.select("term").distinct(), "vocabulary")
    counted = places.join(term_counts(tokens, vocabulary), "term", "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("n", F.lit(0)).alias("n")))).alias("counts"))

    def rarest(start: Column) -> Column:
        inside = F.slice(F.col("counts"), start + 1, F.col("length"))
        ranked = F.array_sort(F.transform(inside, lambda x: F.struct(x["n"].alias("n"), x["place"].alias("place"))))
        there = F.transform(F.slice(F.filter(ranked, lambda x: x["n"] > 0), 1, per_window), lambda x: x["place"])
        none = F.array().cast("array<int>")
        probe = F.when(F.exists(inside, lambda x: x["n"] == 0), none).otherwise(there)
        return F.struct(probe.alias("probe"), F.when(F.size(there) >= F.least(F.lit(per_window), F.col("length")), there).otherwise(none).alias("near"))

    joined = items.join(counted, "key").withColumn("both", F.transform(F.sequence(F.lit(0), F.col("n_windows") - 1), rarest))
    return joined.select("key", "item_id", "words", "length", "n_windows", F.transform("both", lambda x: x["probe"]).alias("probe"), F.transform("both", lambda x: x["near"]).alias("near"))


def postings(tokens: DataFrame, probed: DataFrame, column: str) -> DataFrame:
    """The positional index of the probed terms (row, position, key, place): a row for each occurrence and probe."""
    places = probed.select("key", "words", F.explode(F.array_distinct(F.flatten(column))).alias("place"))
    terms = written(places.select(F.get("words", F.col("place")).alias("term"), "key", "place"), "terms")
    found = tokens.select("row", F.posexplode("tokens").alias("position", "term"))
    return written(found.join(_spread(terms), "term").select("row", "position", "key", "place"), "postings")


def candidates(index: DataFrame, probed: DataFrame) -> DataFrame:
    """row, item_id, diagonal, and the span of words from the first to the last candidate window."""
    met = index.groupBy("row", "key", (F.col("position") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("met"))

    def whole(start: Column) -> Column:
        places = F.get("probe", start)
        return (F.size(places) > 0) & F.forall(places, lambda p: F.array_contains("met", p))

    found = met.join(probed, "key").withColumn("starts", F.filter(F.sequence(F.lit(0), F.col("n_windows") - 1), whole)).filter(F.size("starts") > 0)
    first, last = F.array_min("starts"), F.array_max("starts")
    span = F.slice("words", first + 1, last - first + F.col("length"))
    return found.select("row", "item_id", (F.col("diagonal") + first).alias("at"), "length", span.alias("span"))


def matches(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """row, hits (positions) and items of exact window matches, for rows that have any. Only candidate rows are shuffled."""
    found = written(found, "candidates")
    spans = found.groupBy("row").agg(F.collect_list(F.struct("item_id", "at", "length", "span")).alias("spans"))
    chosen = tokens.join(_spread(found.select("row").distinct()), "row", "left_semi").select("row", "tokens")
    joined = chosen.join(spans, "row")

    def exact(x: Column) -> Column:
        begin = F.sequence(F.lit(0), F.size(x["span"]) - x["length"])
        inside = F.filter(begin, lambda o: (x["at"] + o >= 0) & (x["at"] + o + x["length"] <= F.size("tokens")))
        same = F.filter(inside, lambda o: F.slice("tokens", x["at"] + o + 1, x["length"]) == F.slice(x["span"], o + 1, x["length"]))
        return F.struct(x["item_id"].alias("item_id"), F.flatten(F.transform(same, lambda o: F.sequence(x["at"] + o, x["at"] + o + x["length"] - 1))).alias("hits"))

    checked = joined.withColumn("exact", F.filter(F.transform("spans", exact), lambda x: F.size(x["hits"]) > 0)).filter(F.size("exact") > 0)
    return checked.select("row", F.array_sort(F.array_distinct(F.flatten(F.transform("exact", lambda x: x["hits"])))).alias("hits"), F.array_sort(F.array_distinct(F.transform("exact", lambda x: x["item_id"].cast("string")))).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, per_window: int = PROBES) -> DataFrame:
    """doc_id, text_key, n_words, hits (word positions inside an occurring window), items and contaminated, one row per row of docs.

    A row is contaminated if a twentieth of its words or more are hit. Other columns of docs are not
    used. Null texts have no words and are not contaminated; rows without a doc_id and rows that
    repeat one are judged each by its own text, whole, however long. Items with null id or without
    words match nothing; repeated items count once, and different texts under one item_id count as
    that item. An empty benchmark hits nothing; an empty table gives an empty table.
    """
    tokens = tokenised(docs)
    probed = written(probes(tokens, item_windows(benchmark, window), per_window), "probes")
    found = matches(tokens, candidates(postings(tokens, probed, "probe"), probed))
    full = tokens.select("doc_id", "row", "text_key", F.size("tokens").cast("long").alias("n_words")).join(written(found, "matches"), "row", "left")
    hits = F.coalesce("hits", F.array().cast("array<int>"))
    contaminated = (F.size(hits) > 0) & (20 * F.size(hits) >= F.col("n_words"))
    return full.select("doc_id", "text_key", "n_words", hits.alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), contaminated.alias("contaminated"))


def proximity(docs: DataFrame, benchmark: DataFrame, slop: int = 5, window: int = WINDOW, per_window: int = PROBES) -> DataFrame:
    """doc_id, text_key, item_id where the rarest known terms of a window lie near their places in the phrase.

    Near means: on diagonals within one block of 2 * slop (blocks begin at every multiple of slop),
    which includes all that differ by at most slop, and exact phrases. Edited passages are found as
    long as the rarest terms that the corpus has stay.
    """
    tokens = tokenised(docs)
    probed = written(probes(tokens, item_windows(benchmark, window), per_window), "probes")
    block = F.floor((F.col("position") - F.col("place")) / F.lit(max(slop, 1)))
    placed = postings(tokens, probed, "near").select("row", "key", "place", F.explode(F.array(block, block - 1)).alias("block"))
    met = placed.groupBy("row", "key", "block").agg(F.collect_set("place").alias("met"))
    whole = F.exists("near", lambda places: (F.size(places) > 0) & F.forall(places, lambda p: F.array_contains("met", p)))
    found = met.join(probed, "key").filter(whole).select("row", "item_id").distinct()
    return found.join(tokens.select("row", "doc_id", "text_key"), "row").select("doc_id", "text_key", "item_id").distinct()


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_SPLIT = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_SPLIT} AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM bs),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM ds),
m AS (SELECT doc_id, item_id, dw.n, s FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""

QUERIES = {"op7_decontamination": op7_decontamination}
ORACLES = {"op7_decontamination": ORACLE}
