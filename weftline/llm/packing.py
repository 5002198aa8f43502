"""Best-fit packing: tokenised documents into the fewest sequences of a fixed length.

Documents are tokenised in tasks; only the histogram of piece lengths (at most `capacity` rows,
whatever the corpus) reaches the driver. There the configuration linear program is solved: every
step prices lengths by multiplicative weights and finds the dearest pattern by knapsack dynamic
programming; the fractional pattern counts are then rounded down, and what is left fills sequences
as full as its lengths allow. Pieces get their place by rank within (length, salt), so
neither a frequent length nor a hot group of copies meets in one task.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weftline.llm import utf8
from weftline.session import table, written

CAPACITY = 4096
CACHE_WORDS = 600_000


SEPARATOR = "\x00"
#: A text with what could tell a tokenizer that spans white space or minds case.
SAMPLE = " The Quick  brown FOX's\n\n  path/to 3.14 (again)\t don't. "
#: Words that the tokenizer takes as one run of letters, whatever stands beside them.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch


@lru_cache(1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = tuple(x.content for x in tokenizer.get_added_tokens_decoder().values())
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    last = np.zeros(max(vocabulary.values()) + 1, bool)
    for token, number in vocabulary.items():
        last[number] = token.endswith("</w>")
    return tokenizer, special, last


class WordIds:
    """Token ids of white-space-separated words, encoded by the tokenizer once and kept.

    No token of this tokenizer spans white space, so a text's ids are those of its words in
    order. Texts where that could fail (separators that only Python splits at, zero bytes,
    spelled-out special tokens) are encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer, self.special, self.last = _tokenizer(path)
        found = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.separator = found[0] if len(found) == 1 else None
        self.apart = self.separator is not None and self._keeps_words_apart()
        self.clear()

    def _keeps_words_apart(self) -> bool:
        """Whether ids of a text are those of its lower-cased words in turn, judged on a sample; if not, texts are encoded whole."""
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        return ids(SAMPLE) == [i for word in SAMPLE.lower().split() for i in ids(word)]

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def add(self, words: list[str]) -> None:
        """Encode new words, many at a time: those of plain letters end in one marked token each,
        others are told apart by a separator word between them."""
        plain, other = [], []
        for word in words:
            (plain if PLAIN(word) else other).append(word)
        for group, between in ((plain, " "), (other, f" {SEPARATOR} ")):
            if not group:
                continue
            lines = [between.join(group[i : i + 500]) + between for i in range(0, len(group), 500)]
            ids = np.concatenate([np.asarray(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            if group is plain:
                ends = np.flatnonzero(self.last[ids]) + 1
            else:
                at = np.flatnonzero(ids == self.separator)
                ends, ids = at - np.arange(len(at)), ids[ids != self.separator]
            if len(ends) != len(group):
                raise ValueError("the tokenizer does not keep words apart")
            self.number.update(zip(group, range(len(self.number), len(self.number) + len(group))))
            self.first = np.append(self.first, ends + len(self.ids))
            self.ids = np.append(self.ids, ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > CACHE_WORDS:
            self.clear()
        whole: dict[int, np.ndarray] = {}
        flat: list[str] = []
        n_words = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if self.odd(text):
                whole[i] = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            found = (text.lower() if text.isascii() else text).split()
            n_words[i] = len(found)
            flat += found
        numbers = list(map(self.number.get, flat))
        if None in numbers:
            self.add(list(dict.fromkeys(w for w, n in zip(flat, numbers) if n is None)))
            numbers = list(map(self.number.__getitem__, flat))
        at = np.array(numbers, np.int64)
        begin = self.first[at]
        size = self.first[at + 1] - begin
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(begin - (ends - size), size) + np.arange(int(size.sum()))]
        cuts = np.append(0, ends)[np.cumsum(n_words)]
        return [whole.get(i, x) for i, x in enumerate(np.split(ids, cuts[:-1]))]

    def odd(self, text: str) -> bool:
        return not self.apart or any(c in text for c in "\x00\x1c\x1d\x1e\x1f") or any(s in text for s in self.special)


@lru_cache(1)
def _words(path: str) -> WordIds:
    """One for a Python worker, which serves many tasks."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    A document is its token ids and then id 1; a null or empty text is the id 1 alone. Only
    documents over `capacity` are cut. Null ids and repeated rows are kept as they are.
    """

    def run(batches):
        words = _words(tokenizer_path)
        for batch in batches:
            for part in utf8.slices(batch.column("text")):
                keys = batch.column("id").slice(part.first, len(part))
                cols: list[list[int]] = [[], [], [], [], []]
                for row, ids in enumerate(words.encode([part.raw(i).decode() for i in range(len(part))])):
                    ids = np.append(ids, np.uint32(1)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        cut = ids[start : start + capacity]
                        for col, value in zip(cols, (row, piece, start, len(cut), zlib.crc32(cut.tobytes()))):
                            col.append(value)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                    names=[id_column, "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"`{id_column}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def _best_pattern(price: np.ndarray, capacity: int, grid: int) -> dict[int, int]:
    """The pattern of most value: unbounded knapsack by dynamic programming over multiples of `grid`.

    `price[l]` is that of length l (0 for lengths that do not occur). A length counts as the next
    multiple, and of those that count alike the dearest is taken, so the pattern fits the capacity.
    """
    m = capacity // grid
    by_class = price[1 : m * grid + 1].reshape(m, grid)
    dearest = by_class.argmax(1)
    value = by_class[np.arange(m), dearest]
    take = np.zeros(m + 1, np.int64)
    backwards = np.zeros(m + 1)  # the best values of m, ..., 0: no copy per step
    for c in range(1, m + 1):
        total = value[:c] + backwards[m - c + 1 :]
        take[c] = total.argmax()
        backwards[m - c] = total[take[c]]
    counts: dict[int, int] = {}
    c = m
    while c > 0:
        k = int(take[c])
        if value[k] > 0:
            length = k * grid + 1 + int(dearest[k])
            counts[length] = counts.get(length, 0) + 1
        c -= k + 1
    return counts


def fractional(need: np.ndarray, capacity: int, steps: int, grid: int, rate: float = 0.5) -> tuple[dict[tuple, float], float]:
    """The configuration linear program by multiplicative weights: counts of patterns, and a lower bound on any solution.

    The program is: least sum of x over patterns, with each length covered as often as it occurs.
    Each step prices the lengths, takes the pattern of most value and raises its count until one of
    its lengths is covered once more; prices fall with the cover of a length. In the end all counts
    are scaled down by the greatest cover, so that no length is covered more than once over.
    The bound is the value of all items over that of the best pattern, at its greatest.
    """
    cover, counts, bound = np.zeros(capacity + 1), {}, 0.0
    price = np.where(need > 0, np.arange(capacity + 1) / capacity, 0.0)
    for _ in range(steps):
        pattern = _best_pattern(price, capacity, grid)
        lengths, times = np.array(list(pattern)), np.array(list(pattern.values()))
        if grid == 1:
            bound = max(bound, float(price @ need) / float(price[lengths] @ times))
        step = float((need[lengths] / times).min())
        key = tuple(sorted(pattern.items()))
        counts[key] = counts.get(key, 0.0) + step
        gained = times * step / need[lengths]
        cover[lengths] += gained
        price[lengths] *= np.exp(-rate * gained)
    most = cover.max(initial=1.0)
    return {key: x / most for key, x in counts.items()}, bound


def solve(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = 1000, grid: int = 4) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> items in a sequence) and how many sequences use each; every item once.

    The fractional counts of the linear program are rounded down, and what is left is filled by
    `best_fill`. On small histograms, where rounding leaves little, that may do better alone: the
    solution of fewer sequences counts. Work and memory depend on the capacity, not on the corpus.
    """
    need = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        need[length] += count
    if not need.any():
        return []
    left, rounded = need.copy(), []
    found, _ = fractional(need, capacity, steps, grid if capacity >= 64 * grid else 1)
    for key, x in sorted(found.items(), key=lambda item: (-item[1], item[0])):
        times = min([int(x), *(int(left[length]) // each for length, each in key)])
        if times:
            rounded.append((dict(key), times))
            for length, each in key:
                left[length] -= each * times
    return min(rounded + best_fill(left, capacity), best_fill(need, capacity), key=lambda all_of: sum(times for _, times in all_of))


def best_fill(need: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Sequences one kind after another: the longest item left, and the items that fill its rest best.

    Reachable sums are bits of an integer, a layer for each length, longer ones first; a sum that fills
    the rest ends the search. A kind is used as often as the counts allow, so there are at most about
    as many kinds as lengths.
    """
    left, out, longest = need.copy(), [], capacity
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return out
        left[longest] -= 1
        pattern, rest = {longest: 1}, capacity - longest
        reach, layers, mask = 1, [], (1 << (rest + 1)) - 1
        for length in map(int, np.flatnonzero(left[: rest + 1])[::-1]):
            before, count, size = reach, min(int(left[length]), rest // length), 1
            while count > 0:  # 1, 2, 4, ... items at once
                now = min(size, count)
                reach |= reach << length * now & mask
                count, size = count - now, 2 * size
            layers.append((length, before))
            if reach >> rest & 1:
                break
        total = reach.bit_length() - 1
        for length, before in reversed(layers):
            each = 0
            while not before >> total & 1:
                total, each = total - length, each + 1
            if each:
                pattern[length] = pattern.get(length, 0) + each
                left[length] -= each
        more = min(int(left[length]) // each for length, each in pattern.items())
        for length, each in pattern.items():
            left[length] -= each * more
        out.append((pattern, 1 + more))


def places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, items per sequence, first sequence, offset of the first item)."""
    rows: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for content, times in patterns:
        offset = 0
        for length, each in content.items():
            rank = ranks.get(length, 0)
            rows.setdefault(length, []).append((rank, each, sequence, offset))
            ranks[length] = rank + each * times
            offset += each * length
        sequence += times
    return {length: np.array(x, np.int64) for length, x in rows.items()}


def pack(pieces_df: DataFrame, capacity: int = CAPACITY, rows_per_salt: int = 20_000, **solver) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (with `length`); the table is read twice.

    Offsets are gapless from 0 in every sequence. Which of several pieces of one length gets
    which place is arbitrary but fixed by the written ranks.
    """
    spark = pieces_df.sparkSession
    columns = pieces_df.columns
    total = pieces_df.count()
    salts = max(1, math.ceil(total / rows_per_salt))
    salted = pieces_df.withColumn("__salt", F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "__salt").count()
    # At most capacity x salts rows; the running count per length is what ranks need.
    before = counts.select("length", "__salt", (F.sum("count").over(_window("length", "__salt")) - F.col("count")).alias("__before"))
    histogram = {r["length"]: r["n"] for r in salted.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table_of = spark.sparkContext.broadcast(places(solve(histogram, capacity, **solver)))
    ranked = salted.withColumn("__rank", F.row_number().over(_window(["length", "__salt"], *columns)) - 1)
    ranked = ranked.join(before, ["length", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__before"))

    def put(batches):
        place = table_of.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                size = int(length[rows[0]])
                rule = place[size]
                first, each, base, start = rule[np.searchsorted(rule[:, 0], rank[rows], side="right") - 1].T
                inside = rank[rows] - first
                sequence[rows], offset[rows] = base + inside // each, start + inside % each * size
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces_df.schema)
    return ranked.select(*columns, "__rank").mapInArrow(put, f"{schema}, sequence_id bigint, offset bigint")


def _window(by, *order):
    return Window.partitionBy(by).orderBy(*order)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and pack a table of documents (doc_id, text; other columns are not used).

    A null or empty text is one piece of one token. Null ids and rows that repeat an id or a text are
    packed each on its own. Texts are tokenised whole, however long. An empty table gives an empty
    table. Pieces of one length are interchangeable; which goes where is fixed by their values.
    """
    found = pieces(docs.select("doc_id", "text"), tokenizer_path or default_tokenizer(), capacity)
    return pack(written(found, "pieces"), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLES: dict[str, str] = {}
