"""Quality classifier: document evidence shrunk towards its site by hierarchical empirical Bayes.

Two logistic models, of low quality and of toxicity, are fitted on a bounded sample of the
labelled rows (Limits.max_rows, an even sample by hash of the id). Their evidence is then summed
per path and host over all documents in one grouped aggregation. Each host's rate is drawn to the
global rate and each path's to its host's, by Beta priors whose strengths come from the spread
between hosts and between paths (method of moments), so that sparse sites hardly move. A
document's posterior adds its own log odds to the shift of its path, without its own share in it.
Toxicity is judged by the document alone: a good site does not excuse a toxic text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.llm import utf8
from weftline.llm.quality_rules import base_counts
from weftline.session import table, written

# ASCII letters in lower case, bytes beyond ASCII as they are, all others as spaces.
LETTERS = np.full(256, 32, np.uint8)
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalpha():
        LETTERS[_b] = ord(chr(_b).lower())
    elif _b >= 128:
        LETTERS[_b] = _b
HEADS = ("low", "toxic")
SHAPE = 7


@dataclass(frozen=True)
class Limits:
    """max_rows bounds the labelled sample and max_words the vocabulary, hence what the driver holds.
    A path or host of over 1 / hot_share of all rows is joined by broadcast (at most hot_share of them)."""

    max_rows: int = 20_000
    max_words: int = 4096
    least_docs: int = 3
    penalty: float = 1.0
    max_strength: float = 1000.0
    hot_share: int = 64


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # sorted hashes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # head x (bias, shape features, words)


def _letters(part: utf8.Texts) -> tuple[utf8.Words, np.ndarray]:
    folded = utf8.Texts(LETTERS[part.data], part.starts, part.first)
    words = utf8.words(folded)
    return words, utf8.range_hashes(utf8.byte_sums(folded.data), words.start, words.end)


def _shape(part: utf8.Texts) -> np.ndarray:
    """Length, and shares of upper case, digits, punctuation, symbols, repeated words and lines."""
    counts, _, _ = base_counts(part)
    data, size = part.data, np.maximum(np.diff(part.starts), 1)
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    mark = (data > 32) & (data < 127) & (LETTERS[data] == 32) & ~digit

    def share(flags: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flags))
        return (sums[part.starts[1:]] - sums[part.starts[:-1]]) / size

    n = np.maximum(counts["n_words"], 1)
    return np.stack([np.log1p(counts["n_words"]), share(upper), share(digit), share(mark), counts["n_symbols"] / size, counts["n_repeat_words"] / n, np.log1p(counts["n_dup_lines"])], 1)


def _vocabulary(sample: DataFrame, limits: Limits) -> np.ndarray:
    """Hashes of the words whose presence tells most (by log likelihood) about either label.

    The gain must pass log(words tested) + 2, so that hardly a word gets in by chance.
    """

    def run(batches):
        for batch in batches:
            low, toxic = batch.column("low").to_numpy(zero_copy_only=False), batch.column("toxic").to_numpy(zero_copy_only=False)
            for part in utf8.slices(batch.column("text")):
                words, hashes = _letters(part)
                pairs = np.unique(np.stack([words.text.astype(np.uint64), hashes]), axis=1)
                row = pairs[0].astype(np.int64) + part.first
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64)), pa.array(low[row].astype(np.int64)), pa.array(toxic[row].astype(np.int64))], names=["word", "low", "toxic"])

    seen = sample.mapInArrow(run, "word bigint, low bigint, toxic bigint").groupBy("word").agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic"))
    total = sample.agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic")).first()

    def gain(head: str) -> Column:
        """Log likelihood of the label's rate among texts with the word, over that of its rate in all."""
        base = (total[head] + 0.5) / (total["n"] + 1)
        rate = (F.col(head) + base) / (F.col("n") + 1)
        return F.col("n") * (rate * F.log(rate / base) + (1 - rate) * F.log((1 - rate) / (1 - base)))

    seen = written(seen.filter(F.col("n") >= limits.least_docs).withColumn("gain", F.greatest(*map(gain, HEADS))), "words")
    best = seen.filter(F.col("gain") > float(np.log(max(seen.count(), 1)) + 2)).orderBy(F.desc("gain"), "word").limit(limits.max_words)
    return np.sort(np.array([r["word"] for r in best.select("word").collect()], np.int64).view(np.uint64))


def _present(part: utf8.Texts, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in the vocabulary) once for each vocabulary word of each text."""
    words, hashes = _letters(part)
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    hit = vocabulary[at] == hashes
    key = np.unique(words.text[hit] * len(vocabulary) + at[hit])
    return key // len(vocabulary), key % len(vocabulary)


def _logistic(dense: np.ndarray, row: np.ndarray, word: np.ndarray, n_words: int, y: np.ndarray, penalty: float, steps: int = 400) -> np.ndarray:
    """Ridge logistic regression by accelerated gradient steps; column 0 is the bias, not penalised.

    Features are the dense columns and then, for each (row, word), a one.
    """
    n, k = dense.shape
    ridge = np.full(k + n_words, penalty)
    ridge[0] = 1e-3

    def times(w: np.ndarray) -> np.ndarray:
        return dense @ w[:k] + np.bincount(row, w[k:][word], n)

    def back(r: np.ndarray) -> np.ndarray:
        return np.concatenate([r @ dense, np.bincount(word, r[row], n_words)])

    probe = np.ones(k + n_words)
    for _ in range(20):  # largest eigenvalue, for the step
        probe = back(times(probe))
        probe /= np.linalg.norm(probe)
    step = 1 / (np.linalg.norm(times(probe)) ** 2 / 4 + penalty)
    w = ahead = np.zeros(k + n_words)
    for i in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(ahead), -30, 30)))
        new = ahead - step * (back(p - y) + ridge * ahead)
        ahead, w = new + i / (i + 3) * (new - w), new
    return w


def fit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> Model | None:
    """The two models, or None where no labelled row has a text. Null labels and ids are left out.

    Of repeated labels of a doc_id the worse counts (low quality, toxic), of its texts the least.
    """
    marks = labels.select("doc_id", "quality", "toxic").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limits.max_rows)
    found = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(marks, "doc_id")
    chosen = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    sample = written(chosen.select("text", (F.col("quality") == 0).cast("int").alias("low"), (F.col("toxic") == 1).cast("int").alias("toxic")), "sample")
    if sample.isEmpty():
        return None
    vocabulary = _vocabulary(sample, limits)

    def rows(batches):
        for batch in batches:
            for part in utf8.slices(batch.column("text")):
                own, at = _present(part, vocabulary)
                lists = np.split(at.astype(np.int32), np.searchsorted(own, np.arange(1, len(part))))
                low, toxic = (batch.column(c).slice(part.first, len(part)) for c in HEADS)
                yield pa.RecordBatch.from_arrays([low, toxic, pa.array(list(_shape(part)), pa.list_(pa.float64())), pa.array(lists, pa.list_(pa.int32()))], names=["low", "toxic", "shape", "words"])

    # Rows of a few numbers each: at most max_rows of them, with the places of their words.
    found = sample.mapInArrow(rows, "low int, toxic int, shape array<double>, words array<int>").toArrow().combine_chunks()
    shape = found.column("shape").combine_chunks().flatten().to_numpy().reshape(-1, SHAPE)
    words = found.column("words").combine_chunks()
    row = np.repeat(np.arange(len(found)), np.diff(words.offsets.to_numpy()))
    word = words.flatten().to_numpy()
    mean, scale = shape.mean(0), np.maximum(shape.std(0), 1e-6)
    dense = np.hstack([np.ones((len(found), 1)), (shape - mean) / scale])
    return Model(vocabulary, mean, scale, np.stack([_logistic(dense, row, word, len(vocabulary), found.column(head).to_numpy().astype(float), limits.penalty) for head in HEADS]))


def evidence(docs: DataFrame, model: Model | None, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path and the log odds `low` and `toxic` of every row; null where there is nothing to judge."""

    def run(batches):
        for batch in batches:
            for part in utf8.slices(batch.column("text")):
                n = len(part)
                logits, known = np.zeros((n, 2)), np.zeros(n, bool)
                if model is not None:
                    known = np.diff(part.starts) > 0
                    own, at = _present(part, model.words)
                    shape = np.clip((_shape(part) - model.mean) / model.scale, -5, 5)
                    for head in range(2):
                        w = model.weights[head]
                        logits[:, head] = w[0] + shape @ w[1 : 1 + SHAPE] + np.bincount(own, w[1 + SHAPE :][at], n)
                logits = np.clip(logits, -30, 30)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(part.first, n) for c in ("doc_id", "host", "path")] + [pa.array(logits[:, h], mask=~known) for h in range(2)],
                    names=["doc_id", "host", "path", *HEADS],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", "text", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    return named.select("doc_id", "host", "path", "text").mapInArrow(run, f"doc_id {kind}, host string, path string, low double, toxic double")


def _strength(sums: DataFrame, mean: float, limits: Limits) -> float:
    """Beta strength a + b from the variance between groups beyond what their sizes explain."""
    within = mean * (1 - mean)
    rate = F.col("s") / F.col("n")
    r = sums.filter("n > 0").agg(F.sum(F.col("n") * (rate - mean) ** 2).alias("ss"), F.count("*").alias("k"), F.sum("n").alias("n")).first()
    if not r["k"] or within <= 0 or r["n"] <= 1:
        return limits.max_strength
    between = max((r["ss"] - r["k"] * within) / r["n"], 1e-9)
    return float(np.clip(within / between - 1, 2.0, limits.max_strength))


def posteriors(scored: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """scored plus p_site (the path's rate of low quality without the row itself) and p_global."""
    p = 1 / (1 + F.exp(-F.col("low")))
    paths = written(scored.groupBy("host", "path").agg(F.count("low").alias("n"), F.coalesce(F.sum(p), F.lit(0.0)).alias("s"), F.count("*").alias("all_rows")), "paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("all_rows").alias("all_rows")).first()
    mean = (total["s"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    for_host, for_path = _strength(hosts, mean, limits), _strength(paths, mean, limits)
    sites = paths.join(hosts.withColumnsRenamed({"n": "host_n", "s": "host_s"}), "host")
    hot = sites.filter(F.col("all_rows") * limits.hot_share > (total["all_rows"] or 0))
    cold = sites.filter(F.col("all_rows") * limits.hot_share <= (total["all_rows"] or 0))
    values = ["n", "s", "host_n", "host_s"]
    # Rows of hot paths take their sums by broadcast; in the shuffle of the others they go by a key of their own.
    first = scored.join(F.broadcast(hot.select("host", "path", *(F.col(c).alias(f"hot_{c}") for c in values))), ["host", "path"], "left")
    first = first.withColumn("salt", F.when(F.col("hot_n").isNotNull(), F.xxhash64("doc_id")).otherwise(F.lit(0)))
    both = first.join(cold.select("host", "path", F.lit(0).cast("long").alias("salt"), *values), ["host", "path", "salt"], "left")
    n, s, host_n, host_s = (F.coalesce(F.col(f"hot_{c}"), F.col(c)) for c in values)
    own, one = F.coalesce(p, F.lit(0.0)), F.col("low").isNotNull().cast("int")
    host_rate = (host_s - own + for_host * mean) / (host_n - one + for_host)
    site = (s - own + for_path * host_rate) / (n - one + for_path)
    return both.select("doc_id", "host", "path", *HEADS, site.alias("p_site"), F.lit(mean).alias("p_global"))


def _odds(p: Column) -> Column:
    held = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(held / (1 - held))


def site_of(docs: DataFrame) -> tuple[Column, Column]:
    """Host and path of `documents`: the source, and the language as the section (as in the urls of `pages`)."""
    return F.col("source"), F.col("lang")


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, limits: Limits = Limits()) -> DataFrame:
    """doc_id, host, path, p_document, p_site, p_low, p_toxic and kept for each row; other columns are not used.

    Repeated rows and ids are judged each by its own text. Texts count whole, however long they are.
    An empty table gives an empty table. Null and empty texts have no evidence of their own: p_document and p_toxic are null and p_low
    is the site's. Without labels nothing is known and every row is kept. A null host or path is
    the empty one. kept: p_low < 0.5 and not p_toxic >= 0.5.
    """
    if host is None or path is None:
        host, path = site_of(docs)
    model = fit(docs, labels, limits)
    scored = written(evidence(docs, model, host, path), "evidence")
    found = posteriors(scored, limits)
    logit = F.coalesce(F.col("low"), _odds(F.col("p_global"))) + _odds(F.col("p_site")) - _odds(F.col("p_global"))
    found = found.withColumns({"p_document": 1 / (1 + F.exp(-F.col("low"))), "p_low": 1 / (1 + F.exp(-logit)), "p_toxic": 1 / (1 + F.exp(-F.col("toxic")))})
    toxic = F.coalesce(F.col("p_toxic") >= 0.5, F.lit(False))
    kept = F.lit(True) if model is None else (F.col("p_low") < 0.5) & ~toxic
    return found.select("doc_id", "host", "path", "p_document", "p_site", "p_low", "p_toxic", kept.alias("kept"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLES: dict[str, str] = {}
