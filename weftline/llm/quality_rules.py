"""Quality rules: counts with fixed limits, and divergence from language references.

The references come from the whole corpus by one grouped aggregation: for every language the
histogram of character classes and the counts of its most common words. A document is held
against them by Jensen-Shannon distance (base 2, between 0 and 1) of its own two histograms; the
nearest language counts. Short documents have too few words for a histogram, and a language of few
documents gives no reference: guards leave both to the fixed limits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weftline.llm import utf8
from weftline.session import forget, table, written

# The symbol characters counted as n_symbols.
SYMBOLS = b"#*$%&|<>"
# Character classes by byte: 0 lower case, 1 upper case, 2 digit, 3 space, 4 line end, 5 sentence
# punctuation, 6 other ASCII punctuation, 7 start of a character beyond ASCII, 8 other control.
CLASSES = np.full(256, 255, np.uint8)
for _kind, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\v\f", b".,;:!?'\"-()")):
    CLASSES[list(_bytes)] = _kind
CLASSES[[b for b in range(33, 127) if CLASSES[b] == 255]] = 6
CLASSES[192:] = 7
CLASSES[[b for b in range(128) if CLASSES[b] == 255]] = 8
N_CLASSES = 9
# Among the counts of a language, keys below N_CLASSES are classes, DOCS its documents and greater ones words.
DOCS = N_CLASSES


@dataclass(frozen=True)
class Limits:
    """Rejects: under `min_words`, over `max_repeat_percent` of words in repeated 3-word windows, or
    farther than the distances from every reference (for words plus word_slack / n_words, as a
    histogram of few words is noisy). Distances need `class_min_chars` characters or
    `word_min_words` words, and a language with `reference_min_docs` documents of `word_min_words`."""

    min_words: int = 50
    max_repeat_percent: int = 50
    class_distance: float = 0.25
    word_distance: float = 0.75
    word_slack: float = 5.0
    class_min_chars: int = 200
    word_min_words: int = 50
    common_words: int = 100
    reference_min_docs: int = 20


def _per_text(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[starts[1:]] - sums[starts[:-1]]


def _distinct_in_text(text: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes per text."""
    order = np.lexsort((hashes, text))
    t, h = text[order], hashes[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    return np.bincount(t[new], minlength=n)


def base_counts(texts: utf8.Texts) -> tuple[dict[str, np.ndarray], utf8.Words, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text, its words and their hashes."""
    data, n = texts.data, len(texts)
    words = utf8.words(texts)
    sums = utf8.byte_sums(data)
    hashes = utf8.range_hashes(sums, words.start, words.end)
    n_words = np.diff(words.first)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.start] += 1
    np.subtract.at(inside, words.end, 1)
    in_word = np.cumsum(inside[:-1], dtype=np.int8) > 0
    word_chars = _per_text(in_word & ((data & 0xC0) != 0x80), texts.starts)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    # Lines: cut at \n and at the ends of texts; only those with a word count.
    breaks = np.flatnonzero(data == 10)
    begin = np.union1d(breaks + 1, texts.starts[:-1][np.diff(texts.starts) > 0])
    begin = begin[begin < len(data)]
    end = np.append(begin[1:], len(data))
    end = end - ((data[end - 1] == 10) if len(end) else 0)
    worded = np.searchsorted(words.start, end) > np.searchsorted(words.start, begin)
    begin, end = begin[worded], np.maximum(end, begin)[worded]
    line_text = np.searchsorted(texts.starts, begin, side="right") - 1
    n_lines = np.bincount(line_text, minlength=n)
    n_dup_lines = n_lines - _distinct_in_text(line_text, utf8.range_hashes(sums, begin, end), n)
    # Words in 3-word windows that the text has twice or more.
    windows = utf8.grams(hashes, 3)
    own = words.text[: len(windows)]
    whole = own == words.text[2:] if len(windows) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    _, group, times = np.unique(utf8.mix(windows[at] ^ utf8.mix(own[at].astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
    cover = np.zeros(len(hashes) + 1, np.int64)
    twice = at[times[group] > 1]
    np.add.at(cover, twice, 1)
    np.subtract.at(cover, np.minimum(twice + 3, len(hashes)), 1)
    n_repeat = _per_text(np.cumsum(cover[:-1]) > 0, words.first)
    counts = {"n_words": n_words, "word_chars": word_chars, "n_symbols": _per_text(symbol[data], texts.starts), "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat}
    return counts, words, hashes


def _folded_words(texts: utf8.Texts, words: utf8.Words) -> np.ndarray:
    """Hashes of the words with A-Z in lower case."""
    data = texts.data
    upper = (data >= 65) & (data <= 90)
    return utf8.range_hashes(utf8.byte_sums(np.where(upper, data + 32, data).astype(np.uint8)), words.start, words.end)


def _class_counts(texts: utf8.Texts) -> np.ndarray:
    kind = CLASSES[texts.data]
    own = np.repeat(np.arange(len(texts)), np.diff(texts.starts))
    known = kind < N_CLASSES
    return np.bincount(own[known] * N_CLASSES + kind[known], minlength=len(texts) * N_CLASSES).reshape(-1, N_CLASSES)


def references(docs: DataFrame, limits: Limits = Limits()) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """language -> (class histogram, common word hashes, their share of all words), over all rows.

    Counts are combined per task and then by key. Every language of reference_min_docs documents has
    a reference, of 9 + common_words rows at the driver; labels of fewer do not reach it.
    """

    def run(batches):
        langs: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush():
            lang, key, n = _merge(held)
            held.clear()
            names = list(langs)
            kind = key <= np.uint64(DOCS)
            return pa.RecordBatch.from_arrays(
                [pa.DictionaryArray.from_arrays(pa.array(lang, pa.int32()), pa.array(names, pa.string())).cast(pa.string()), pa.array(kind), pa.array(key.view(np.int64)), pa.array(n)],
                names=["lang", "of_class", "key", "n"],
            )

        for batch in batches:
            column = batch.column("lang").fill_null("")
            for part in utf8.slices(batch.column("text")):
                own = np.array([langs.setdefault(x, len(langs)) for x in column.slice(part.first, len(part)).to_pylist()], np.int64)
                words = utf8.words(part)
                hashes = np.maximum(_folded_words(part, words), np.uint64(DOCS + 1))
                classes = _class_counts(part)
                held.append(_merge([(own[words.text], hashes, np.ones(len(hashes), np.int64))]))
                held.append((own, np.full(len(part), DOCS, np.uint64), (np.diff(words.first) >= limits.word_min_words).astype(np.int64)))
                held.append((np.repeat(own, N_CLASSES), np.tile(np.arange(N_CLASSES, dtype=np.uint64), len(part)), classes.ravel()))
                if sum(len(x[0]) for x in held) > 2_000_000:
                    held[:] = [_merge(held)]
                    if len(held[0][0]) > 1_000_000:
                        yield flush()
        if held:
            yield flush()

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, of_class boolean, key bigint, n bigint")
    counted = written(counted.groupBy("lang", "of_class", "key").agg(F.sum("n").alias("n")), "counts")
    # A plain bound on the rank lets each task drop all but a language's commonest words before the shuffle.
    words = counted.filter(~F.col("of_class")).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))).filter(F.col("rank") <= limits.common_words)
    ranked = words.drop("rank").unionByName(counted.filter("of_class"))
    enough = F.max(F.when(F.col("of_class") & (F.col("key") == DOCS), F.col("n"))).over(Window.partitionBy("lang"))
    ranked = ranked.withColumn("docs", enough).filter(F.col("docs") >= limits.reference_min_docs).filter(~F.col("of_class") | (F.col("key") != DOCS))
    out: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    rows: dict[str, list] = {}
    for r in ranked.collect():
        rows.setdefault(r["lang"], []).append(r)
    forget(counted)
    for lang, found in rows.items():
        classes = np.zeros(N_CLASSES)
        for r in found:
            if r["of_class"]:
                classes[r["key"]] = r["n"]
        common = sorted((r for r in found if not r["of_class"]), key=lambda r: r["key"])
        if not classes.sum() or not common:
            continue
        keys = np.array([r["key"] for r in common], np.int64).view(np.uint64)
        order = np.argsort(keys)
        n = np.array([r["n"] for r in common], np.float64)[order]
        out[lang] = classes / classes.sum(), keys[order], n / n.sum()
    return out


def _merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lang, key, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((key, lang))
    lang, key, n = lang[order], key[order], n[order]
    new = np.ones(len(lang), bool)
    new[1:] = (lang[1:] != lang[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return lang[at], key[at], np.add.reduceat(n, at) if len(at) else n


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence in bits, along the last axis."""
    m = (p + q) / 2

    def kl(a: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0).sum(-1)

    return np.sqrt(np.maximum((kl(p) + kl(q)) / 2, 0))


def judge(docs: DataFrame, refs: dict, limits: Limits = Limits(), id_column: str = "doc_id") -> DataFrame:
    """doc_id, text_key (md5 of the text), the counts, base_failed, kept, class_distance, word_distance and reason for each row.

    Each row is judged by its own text, whole, however long: repeated rows and ids alike, null ids
    too; other columns than doc_id, text and lang are not used. An empty table gives an empty table.
    Of equally common words the one of the lesser hash is in the reference. A null text has no words and fails on length. Where the document's language (null and '' are one)
    has no reference, or under the length guards, a distance is null and rejects nothing. The word histogram is over the
    language's common words alone; a document without any of them has distance 1.
    """

    shared = docs.sparkSession.sparkContext.broadcast(refs)

    def run(batches):
        refs = shared.value
        for batch in batches:
            langs = batch.column("lang").fill_null("")
            for part in utf8.slices(batch.column("text")):
                known = np.array([x in refs for x in langs.slice(part.first, len(part)).to_pylist()], bool)
                counts, words, _ = base_counts(part)
                n, n_words = len(part), counts["n_words"]
                classes = _class_counts(part).astype(float)
                chars = classes.sum(1)
                hashes = np.maximum(_folded_words(part, words), np.uint64(DOCS + 1))
                by_class, by_word = np.full(n, np.inf), np.full(n, np.inf)
                share = classes / np.maximum(chars, 1)[:, None]
                for ref_classes, keys, ref_words in refs.values():
                    by_class = np.minimum(by_class, js_distance(share, ref_classes[None]))
                    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                    hit = keys[at] == hashes
                    own = np.bincount(words.text[hit] * len(keys) + at[hit], minlength=n * len(keys)).reshape(n, -1).astype(float)
                    total = own.sum(1)
                    distance = js_distance(own / np.maximum(total, 1)[:, None], ref_words[None])
                    by_word = np.minimum(by_word, np.where(total > 0, distance, 1.0))
                use_class = known & np.isfinite(by_class) & (chars >= limits.class_min_chars)
                use_word = known & np.isfinite(by_word) & (n_words >= limits.word_min_words)
                short, repeats = n_words < limits.min_words, 100 * counts["n_repeat_words"] > limits.max_repeat_percent * n_words
                far_class, far_word = use_class & (by_class > limits.class_distance), use_word & (by_word > limits.word_distance + limits.word_slack / np.maximum(n_words, 1))
                reason = np.select([short, repeats, far_class, far_word], ["short", "repeats", "characters", "words"], "")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(part.first, n),
                        batch.column("text_key").slice(part.first, n),
                        *(pa.array(counts[c].astype(np.int64)) for c in COUNTS),
                        pa.array(short | repeats),
                        pa.array(reason == ""),
                        pa.array(by_class, mask=~use_class),
                        pa.array(by_word, mask=~use_word),
                        pa.array(reason.astype(object), pa.string()),
                    ],
                    names=[id_column, "text_key", *COUNTS, "base_failed", "kept", "class_distance", "word_distance", "reason"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, text_key string, {', '.join(f'{c} bigint' for c in COUNTS)}, base_failed boolean, kept boolean, class_distance double, word_distance double, reason string"
    return docs.select(F.col(id_column).alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), "text", "lang").mapInArrow(run, schema)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """judge() against references drawn from docs themselves; see there for nulls, repeats, ties, long texts and empty tables."""
    return judge(docs, references(docs, limits), limits)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("text_key")


QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLES: dict[str, str] = {}
