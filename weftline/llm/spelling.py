"""Spelling variants: words that one insertion, deletion or replacement makes alike.

The even-partition pigeonhole join: a word of length l is cut into two segments, the first of
l // 2 code points, and both are indexed under l. One edit spoils one segment at most, so a word
of length l or l + 1 within one edit has the other: at its place, or shifted by the difference in
length. Words are probed by those two places for equal and for one-longer words.

A segment that many words share (a common prefix) would make all their pairs. There the spoiled
part is cut in two again, and its members are indexed by all but one of the two pieces, as often as
a bucket stays large. When the spoiled part is one code point, a bucket holds at most one word for
each letter, so every pair that is compared is near, or nearly so, whatever the vocabulary.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.llm.sql import CRC32
from weftline.session import forget, table, written

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, SPOILED, RATIO = 6, 5, 199, 5
#: Buckets with more indexed words are cut further.
BUCKET = 32

KEY = ["length", "low", "high", "intact"]


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, spoiled: int = SPOILED) -> DataFrame:
    """(word, n): words of whole texts of docs(doc_id, text) by the number of their occurrences.

    A word is a maximal run of letters, A-Z lower-cased; where `spoiled` divides the checksum of
    `<doc_id>:<run>`, a code point is dropped. Null and empty texts have no words; rows that
    repeat an id or a text count each; the runs of rows without an id stay as they are. Counts are
    combined before the shuffle, so a hot word is a row for each task.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.filter(F.char_length("run") >= least_length)
    check = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (check % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    words = runs.select(F.when(check % spoiled == 0, shorter).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _cut(rows: DataFrame, spans: Column) -> DataFrame:
    """One row for each (low, high) of `spans`: `middle` may hold the edit, `intact` is the rest.

    rows: (word, n, length, longer); a word with longer = 1 is probed as one code point longer
    than the indexed words of `length`, so what follows the span is shifted by one.
    """
    word, low, high, longer = (F.col(c) for c in ("word", "low", "high", "longer"))
    cut = rows.select("word", "n", "length", "longer", F.explode(spans).alias("span")).select("word", "n", "length", "longer", "span.*")
    middle = F.substring(word, low + 1, high - low + longer)
    intact = F.concat(F.substring(word, F.lit(1), low), F.substring(word, high + longer + 1, F.col("length")))
    return cut.withColumns({"middle": middle, "intact": intact})


def _span(low: Column, high: Column) -> Column:
    return F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))


def near_pairs(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(word, n, other, other_n), once a pair: words(word, n) that differ by exactly one edit.

    `words` holds each word once. A null or empty word is near none. A pair compares one indexed
    word with one that shares its bucket; buckets of more than `bucket` indexed words are cut on.
    """
    half = F.floor(F.col("length") / 2)
    probes = words.filter("word <> ''").select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"))
    probes = probes.select("word", "n", (F.char_length("word") - F.col("longer")).alias("length"), "longer").filter("length > 0")
    rows = _cut(probes, F.array(_span(F.lit(0), half), _span(half, F.col("length"))))
    pairs, tables = [], []
    while True:
        sizes = rows.groupBy(*KEY).agg(F.count_if(F.col("longer") == 0).alias("indexed"), F.count("*").alias("all"))
        sizes = sizes.filter("indexed > 0 AND all > 1").withColumn("hot", (F.col("indexed") > bucket) & (F.col("high") - F.col("low") > 1))
        members = written(rows.join(sizes.drop("indexed", "all"), KEY), "members")
        tables.append(members)
        here = members.filter(~F.col("hot"))
        left = here.filter("longer = 0").select(*KEY, "word", "n", "middle")
        right = here.select(*KEY, F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("middle").alias("its_middle"), "longer")
        once = ((F.col("longer") == 1) | (F.col("word") < F.col("other"))) & (F.levenshtein("middle", "its_middle", 1) == 1)
        pairs.append(left.join(right, KEY).filter(once).select("word", "n", "other", "other_n"))
        hot = members.filter("hot")
        if hot.isEmpty():
            break
        low, high = F.col("low"), F.col("high")
        middle = F.floor((low + high) / 2)
        rows = _cut(hot.withColumn("spans", F.array(_span(low, middle), _span(middle, high))).drop("low", "high"), F.col("spans"))
    # An insertion beside an equal letter is found in both pieces.
    found = written(reduce(DataFrame.unionByName, pairs).distinct(), "near")
    forget(*tables)
    return found


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of words(word, n), each word once.

    form is the near word of largest n (ties: first in code-point order) if that is at least `ratio`
    times the word's own, else null; root follows forms to the last. A chain of forms grows by
    `ratio` at each step, so its length is a logarithm of the largest n and steps are doubled. An
    empty table gives an empty table.
    """
    words = written(words.select("word", "n"), "words")
    pairs = near_pairs(words)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    # A word has no more near words than letters times twice its length.
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form")))
    near = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    strong = -F.col("best.minus") >= ratio * F.col("n")
    near = written(near.select("word", "n_near", F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.minus")).alias("form_n")), "forms")
    roots = near.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(roots.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = after.select("word", "root")
        if after.filter("moved").isEmpty():
            break
    joined = words.join(near, "word", "left").join(roots, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Variants among the words of docs(doc_id, text); see word_counts and variants. Other columns are not used."""
    return variants(word_counts(docs))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE crc AS MATERIALIZED ({CRC32.TABLE}),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
counted AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY doc_id, run),
hashed AS (SELECT doc_id, run, n, {CRC32.of("doc_id || ':' || run")} AS h FROM counted, crc),
words AS MATERIALIZED (SELECT CASE WHEN h % {SPOILED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= {LEAST_LENGTH} AND sum(n) >= {LEAST_COUNT}),
spots AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
without AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM spots),
near AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM without a JOIN without b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM without a JOIN words b ON b.word = a.rest
  UNION SELECT b.word, b.n, a.word, a.n FROM without a JOIN words b ON b.word = a.rest),
best AS (SELECT word, n, count(*) AS n_near, max(other_n) AS m FROM near GROUP BY word, n),
forms AS MATERIALIZED (SELECT b.word, min(o.other) AS form FROM best b JOIN near o ON o.word = b.word AND o.other_n = b.m WHERE b.m >= {RATIO} * b.n GROUP BY b.word),
chain AS (SELECT word, form AS link FROM forms UNION SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.link),
roots AS (SELECT word, link AS root FROM chain WHERE link NOT IN (SELECT word FROM forms))
SELECT w.word, f.form, coalesce(r.root, w.word) AS root, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN f.form IS NOT NULL THEN b.m END AS form_n
FROM words w LEFT JOIN best b ON b.word = w.word LEFT JOIN forms f ON f.word = w.word LEFT JOIN roots r ON r.word = w.word
"""

QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLES = {"op13_spelling_variants": ORACLE}
