"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles of five words.

Equal texts are collapsed to the one of least doc_id and packed into units of a few MB. Document
frequencies of shingles count all documents: each unit sends its different shingles to buckets by
hash, packed, and gets back how many documents elsewhere hold each. Each text then draws BANDS * ROWS samples by improved consistent weighted sampling
(two texts draw the same with the probability of their weighted Jaccard similarity); bands of
equal samples give candidates, each checked by the exact weighted Jaccard similarity, and
union-find makes groups of the links.

Document frequencies also tell which shingles no other text has. Their weight can't overlap with
anything, so a text with more than a fifth of its weight in them has no partner, and what is left
bounds every pair before texts are joined. The bound is exact and turns no partner away.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm import utf8
from weftline.llm.links import ROUNDING, leader_links, sketch
from weftline.session import forget, table, written

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 4
#: Text of a unit that sends its shingles together, and text for each bucket of shingles.
UNIT_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
#: Ids that choose texts are broadcast up to this number (16 MB), else joined by shuffle.
BROADCAST_IDS = 2_000_000


def shingle_counts(part: utf8.Texts, size: int = WORDS):
    """For each text of the slice: (index, sorted distinct shingle hashes, times); texts without words are left out.

    A text of fewer words than a shingle has one shingle of them all.
    """
    words = utf8.words(part)
    hashes = utf8.range_hashes(utf8.byte_sums(part.data), words.start, words.end)
    for i in range(len(part)):
        own = hashes[words.first[i] : words.first[i + 1]]
        if len(own):
            yield i, *np.unique(utf8.grams(own, min(size, len(own))), return_counts=True)


#: Shingles whose samples are drawn together.
BLOCK = 8192


@lru_cache(1)
def _quantiles() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1) at 65,536 equal steps of its distribution, its inverse and its logarithm."""
    p = (np.arange(65536) + 0.5) / 65536
    low, high = np.zeros(65536), np.full(65536, 64.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return high.astype(np.float32), (1 / high).astype(np.float32), np.log(high).astype(np.float32)


def samples(shingles: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """n consistent weighted samples (shingle and its level, hashed together).

    Sample k of a shingle draws r and c from Gamma(2, 1) and beta from 0..1 by its hash, takes the
    level floor(log(weight) / r + beta), and the least of c / exp(r * (level - beta + 1)) wins.
    """
    gamma, inverse, log_gamma = _quantiles()
    odd = (utf8.mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1))[:, None]
    low, out, rows = np.full(n, np.inf, np.float32), np.zeros(n, np.uint64), np.arange(n)
    for first in range(0, len(shingles), BLOCK):
        own = shingles[first : first + BLOCK]
        x = own * odd
        x ^= x >> np.uint64(29)
        x *= utf8.MIX_A
        draws = x.view(np.uint16).reshape(n, -1, 4)  # the lowest 16 bits are the least mixed and stay unused
        beta = draws[:, :, 2] * np.float32(1 / 65536)
        r = draws[:, :, 3].astype(np.intp)
        level = np.log(weights[first : first + BLOCK]).astype(np.float32) * inverse.take(r, mode="clip")
        level += beta
        np.floor(level, out=level)
        a = level - beta
        a += 1
        a *= gamma.take(r, mode="clip")
        np.subtract(log_gamma.take(draws[:, :, 1], mode="clip"), a, out=a)
        at = a.argmin(1)
        least = a[rows, at]
        better = least < low
        low[better] = least[better]
        out[better] = utf8.mix(own[at] ^ utf8.mix(level[rows, at].astype(np.int64).view(np.uint64)))[better]
    return out


def _units(texts: DataFrame) -> DataFrame:
    """Texts packed into rows of about UNIT_BYTES: unit (the first text's id), ids, copies and texts."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            ids, copies, own = (pa.concat_arrays([x.column(c) for x in held]) for c in ("id", "copies", "text"))
            ends = pa.array([0, len(ids)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (ids, copies, own)]
            return pa.RecordBatch.from_arrays([ids.slice(0, 1), *lists], names=["unit", "ids", "copies", "texts"])

        size = 0
        for batch in batches:
            for part in utf8.slices(batch.column("text")):
                held.append(batch.slice(part.first, len(part)))
                size += len(part.data)
                if size >= UNIT_BYTES:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    return texts.select("id", "copies", "text").mapInArrow(run, "unit bigint, ids array<bigint>, copies array<bigint>, texts array<string>")


def _unit_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of a unit: distinct hashes of each text, one text after another, and each text's number and times."""
    found = [(s, np.full(len(s), part.first + i), n) for part in utf8.slices(texts) for i, s, n in shingle_counts(part)]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _squeeze(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _expand(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64)


def _elsewhere(units: DataFrame, buckets: int) -> DataFrame:
    """unit, bucket and blob: how many documents outside the unit hold each shingle of it, in order of the hash.

    A unit sends each of its shingles once, with the number of its documents, to the bucket of its
    hash; the buckets add up and answer. So a shingle that a third of the corpus holds reaches its
    bucket once per unit, and a bucket's size follows from the number of buckets.
    """

    def send(batches):
        for batch in batches:
            for unit, copies, texts in zip(batch.column("unit"), batch.column("copies"), batch.column("texts")):
                shingles, text, _ = _unit_shingles(texts.values)
                unique, place = np.unique(shingles, return_inverse=True)
                held = np.bincount(place, copies.values.to_numpy()[text], len(unique)).astype(np.int64)
                edges = np.searchsorted((unique >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
                rows = np.flatnonzero(np.diff(edges))
                blobs = [unique[edges[k] : edges[k + 1]].tobytes() for k in rows]
                counts = [_squeeze(held[edges[k] : edges[k + 1]]) for k in rows]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([unit.as_py()] * len(rows), pa.int64()), pa.array(blobs, pa.binary()), pa.array(counts, pa.binary())], names=["bucket", "unit", "shingles", "held"])

    def add(table: pa.Table) -> pa.Table:
        shingles = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        held = [_expand(x) for x in table.column("held").to_pylist()]
        unique, place = np.unique(np.concatenate(shingles), return_inverse=True)
        others = np.bincount(place, np.concatenate(held), len(unique)).astype(np.int64)[place] - np.concatenate(held)
        ends = np.cumsum([len(x) for x in shingles])
        blobs = [_squeeze(x) for x in np.split(others, ends[:-1])]
        return pa.table([table.column("unit"), table.column("bucket"), pa.array(blobs, pa.binary())], names=["unit", "bucket", "blob"])

    sent = units.mapInArrow(send, "bucket bigint, unit bigint, shingles binary, held binary")
    return sent.groupBy("bucket").applyInArrow(add, "unit bigint, bucket bigint, blob binary")


def _drawn(units: DataFrame, n_docs: int, bands: int, rows: int) -> DataFrame:
    """(id, text, df, keys, s0, s1, whole, shared).

    df: document frequencies in the order of shingle_counts; keys: the band keys of the samples;
    s0 and s1: their sketch; whole: the text's weight; shared: that of shingles which other texts have too.
    """

    def run(batches):
        for batch in batches:
            for copies, texts, ids, answers in zip(batch.column("copies"), batch.column("texts"), batch.column("ids"), batch.column("answers")):
                shingles, text, times = _unit_shingles(texts.values)
                unique, place = np.unique(shingles, return_inverse=True)
                copies = copies.values.to_numpy()
                others = np.concatenate([_expand(x["blob"].as_py()) for x in sorted(answers, key=lambda x: x["bucket"].as_py())]) if answers.is_valid else np.zeros(0, np.int64)
                df = (others + np.bincount(place, copies[text], len(unique)).astype(np.int64))[place]
                ends = np.searchsorted(text, np.arange(len(copies) + 1))
                elsewhere = df > copies[text]
                weights = times * (1 + np.log((1 + n_docs) / (1 + df)))
                keys, halves = np.zeros((len(copies), bands), np.int64), np.zeros((len(copies), 2), np.int64)
                for i in range(len(copies)):
                    own = slice(ends[i], ends[i + 1])
                    drawn = samples(shingles[own], weights[own], bands * rows)
                    halves[i] = sketch(drawn[None])[0]
                    drawn = drawn.reshape(bands, rows)
                    key = np.arange(bands, dtype=np.uint64)
                    for j in range(rows):
                        key = utf8.mix(key * np.uint64(utf8.BASE) + drawn[:, j])
                    keys[i] = key.view(np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(x, pa.int32()), pa.array(v)) for x, v in ((ends, df), (np.arange(0, keys.size + 1, bands), keys.ravel()))]
                sums = [np.bincount(text, x, len(copies)) for x in (weights, weights * elsewhere)]
                numbers = map(pa.array, (*np.ascontiguousarray(halves.T), *sums))
                yield pa.RecordBatch.from_arrays([ids.values, texts.values, *lists, *numbers], names=["id", "text", "df", "keys", "s0", "s1", "whole", "shared"])

    return units.mapInArrow(run, "id bigint, text string, df array<bigint>, keys array<bigint>, s0 bigint, s1 bigint, whole double, shared double")


def _weights(texts: pa.Array, df: pa.Array, n_docs: int):
    """(row, shingles, weights) of each text with words: tf * (1 + log((1 + documents) / (1 + df)))."""
    for part in utf8.slices(texts):
        for i, s, times in shingle_counts(part):
            row = part.first + i
            yield row, s, times * (1 + np.log((1 + n_docs) / (1 + df[row].values.to_numpy(zero_copy_only=False))))


def _chosen(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts with these ids. Ids are counted first, so that texts are not shuffled to find a few of them."""
    ids = written(ids.distinct(), "ids", small=True)
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def _checked(texts: DataFrame, n_docs: int, similarity: float):
    """The check for leader_links: exact weighted Jaccard similarity."""

    def compare(batches):
        for batch in batches:
            same = np.zeros(batch.num_rows, bool)
            both = zip(_weights(batch.column("x"), batch.column("xdf"), n_docs), _weights(batch.column("y"), batch.column("ydf"), n_docs))
            for (row, s, w), (_, t, v) in both:
                _, p, q = np.intersect1d(s, t, assume_unique=True, return_indices=True)
                shared = np.minimum(w[p], v[q]).sum()
                same[row] = shared >= similarity * (w.sum() + v.sum() - shared)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(same))

    def verify(pairs: DataFrame) -> DataFrame:
        held = _chosen(texts, pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
        left, right = (held.select(F.col("id").alias(one), F.col("text").alias(x), F.col("df").alias(f"{x}df")) for one, x in (("a", "x"), ("b", "y")))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "xdf", "y", "ydf").mapInArrow(compare, "a bigint, b bigint")

    return verify


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key (md5 of the text), class_id, group_id and kept, one row per row of docs (doc_id long, text; other columns are not used).

    class_id is the least doc_id of the same text, group_id the least of the classes that links
    join; kept is true for the group's least doc_id (and, of its texts, the one of least md5). Texts without words and null texts are in no
    group and are kept, as are rows without a doc_id. Rows that repeat a doc_id and text are both
    kept or not; a doc_id with several texts counts once for each, and each row is in the group of
    its own text. All shingles of a text count, however long it is. An empty table gives an empty table.
    """
    all_rows = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("text_key"))
    worded = all_rows.filter(F.col("doc_id").isNotNull() & F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    classes = written(worded.groupBy("text_key").agg(F.min("doc_id").alias("class_id"), F.countDistinct("doc_id").alias("copies")), "classes")
    total = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    own = classes.select(F.col("class_id").alias("doc_id"), "text_key", "copies")
    texts = worded.join(own, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    # A doc_id under two texts would stand for two classes: a class then goes by its text too.
    units = written(_units(texts.select(F.xxhash64("doc_id", "text_key").alias("id"), "text", "copies")), "units")
    size = units.select(F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x)))).first()[0] or 0
    answers = _elsewhere(units, max(1, math.ceil(size / BUCKET_BYTES))).groupBy("unit").agg(F.collect_list(F.struct("bucket", "blob")).alias("answers"))
    answers = written(answers, "answers")
    full = written(_drawn(units.join(answers, "unit"), total, bands, rows), "texts")
    forget(units, answers)
    possible = full.filter(F.col("shared") >= (similarity - ROUNDING) * F.col("whole"))
    banded = possible.select("id", "s0", "s1", "whole", "shared", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least <> most").select("key")
    members = written(banded.join(shared, "key", "left_semi").select("key", "id", "s0", "s1", "whole", "shared"), "members")
    held = written(_chosen(full.select("id", "text", "df"), members.select("id")), "held")
    forget(full)
    _, roots = leader_links(members, _checked(held, total, similarity), similarity)
    forget(members, held)
    named = classes.select("text_key", "class_id", F.xxhash64("class_id", "text_key").alias("id")).join(roots, "id", "left")
    named = written(named.select("text_key", "class_id", F.coalesce("root", "id").alias("root")), "named")
    groups = named.groupBy("root").agg(F.min(F.struct("class_id", "text_key")).alias("first"))
    known = named.join(groups, "root").select("text_key", "class_id", F.col("first.class_id").alias("group_id"), F.col("first.text_key").alias("group_key"))
    found = all_rows.drop("text").join(known, "text_key", "left")
    alone = F.col("doc_id").isNull() | F.col("group_id").isNull()
    return found.select(
        "doc_id",
        "text_key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"),
        (alone | ((F.col("doc_id") == F.col("group_id")) & (F.col("text_key") == F.col("group_key")))).alias("kept"),
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


QUERIES = {"op3_near_dedup": op3_near_dedup}
ORACLES: dict[str, str] = {}
