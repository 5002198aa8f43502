"""Spelling variants against all pairs in plain Python, with hot segments and awkward words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    rows = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return rows


def words_of(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def variants_of(spark, words, **how):
    return {tuple(r) for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n bigint"), **how).collect()}


def test_same_as_all_pairs(spark):
    rng = random.Random(2)
    words = {}
    for _ in range(60):
        w = "".join(rng.choices("abcàé", k=rng.randint(1, 9)))
        for _ in range(8):
            i = rng.randrange(len(w) + 1)
            words[rng.choice((w, w[:i] + rng.choice("abcé") + w[i:], w[:i] + w[i + 1 :], w[:i] + "b" + w[i + 1 :]))] = rng.choice((5, 25, 124, 125, 700, 4000))
    words.pop("", None)
    assert variants_of(spark, words) == brute(words)


def test_a_segment_that_all_words_share(spark):
    """A third of the words share their first half, another third their second: buckets are cut down to one code point."""
    rng = random.Random(3)
    words = {"prefix" + "".join(rng.choices("abcd", k=6)): rng.randint(5, 90) for _ in range(300)}
    words |= {"".join(rng.choices("abcd", k=5)) + "suffix": rng.randint(5, 900) for _ in range(300)}
    words |= {"aaaaaa" + "a" * i: 5 ** (i % 7) for i in range(30)}  # insertions found in both pieces
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    found = [(r["word"], r["other"]) for r in spelling.near_pairs(df, bucket=4).collect()]
    expected = {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}
    assert len(found) == len(expected) and {frozenset(p) for p in found} == expected
    assert variants_of(spark, words) == brute(words)


def test_ties_and_chains(spark):
    chain = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125}
    assert {(r[0], r[1], r[2]) for r in variants_of(spark, chain)} == {("aaaaaa", "aaaaab", "aabbbb"), ("aaaaab", "aaaabb", "aabbbb"), ("aaaabb", "aaabbb", "aabbbb"), ("aaabbb", "aabbbb", "aabbbb"), ("aabbbb", None, "aabbbb")}
    tie = {"middle": 5, "middlx": 25, "middla": 25, "fiddle": 24}
    assert {r for r in variants_of(spark, tie) if r[0] == "middle"} == {("middle", "middla", "middla", 5, 3, 25)}


def test_counts_of_whole_texts(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(5, 9))) for _ in range(40)] + ["Éclairs", "éclairs", "HOUSES", "Houses", "s×t÷uvw", "x" * 300_000]
    rows = [(i, " ".join(rng.choices(vocabulary[:-1], k=60)) + "1") for i in range(60)]
    rows += [(1, "houses-houses_houses"), (1, "houses-houses_houses"), (None, " ".join(vocabulary[:-1])), (2, None), (3, ""), (None, None)]
    rows += [(70 + i, vocabulary[-1] + " " + vocabulary[-1] + "y") for i in range(5)] + [(80, "words word's wŠrds ÀÿÀÿÀÿ " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("word", "n", "run", "length", "low", "form")}).repartition(3)
    expected = words_of(rows)
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()} == expected
    assert {tuple(r) for r in spelling.spelling_variants(docs).collect()} == brute(expected)


@pytest.mark.parametrize("rows", [[], [("", 3)], [("a", 5)], [("a", 5), ("b", 50)]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, "word string, n bigint")
    assert {tuple(r) for r in spelling.variants(df).collect()} == {(w, ("b" if len(rows) == 2 and w == "a" else None), "b" if len(rows) == 2 else w, n, len(rows) - 1, 50 if len(rows) == 2 and w == "a" else None) for w, n in rows}
