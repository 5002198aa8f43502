"""Operators against brute force on small fixtures with nulls, empty texts, copies and ties."""

import itertools
import math
import random
import re
from collections import Counter

import pytest

from weftline.llm import decontamination, line_dedup, near_dedup, packing, quality_classifier, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(400)]
    texts = ["\n".join(" ".join(rng.choices(vocabulary, k=12)) for _ in range(rng.randint(3, 8))) for _ in range(40)]
    texts += texts[:4]
    for n, text in enumerate(texts[4:12]):
        if n % 2:
            text = text.replace("\n", "x\n")
        words = text.split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [None, "", "   \n\t", "one", "one", "two words", "same\nsame\nsame"]
    return [(i, t, "en", f"src{i % 3}", len(t or ""), "clash") for i, t in enumerate(texts)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tokens string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def groups(ids, links):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_line_dedup(docs):
    lines = [(i, p, re.sub(r"\s+", " ", x).strip(" ").lower()) for i, t, *_ in documents() for p, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    first = {}
    for at, (_, _, text) in enumerate(lines):
        first.setdefault(text, at)
    size = line_dedup.SHINGLE
    sets = {t: {t[i : i + size] for i in range(len(t) - size + 1)} for t in first}
    links = [(first[a], first[b]) for a, b in itertools.combinations(first, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = groups(first.values(), links)
    lost = Counter(i for at, (i, _, t) in enumerate(lines) if root[first[t]] != at)
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert {i: r["n_removed"] for i, r in got.items()} == {i: lost[i] for i in got}
    assert links and got[52]["text"] is None and got[52]["tokens"] == "clash" and got[58]["text"] == "same"


def test_near_duplicates(docs):
    counts = {}
    for i, t, *_ in documents():
        words = WORD.findall(t or "")
        n = min(5, len(words))
        if n:
            counts[i] = Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    df = Counter(s for c in counts.values() for s in c)
    weight = {i: {s: k * (1 + math.log((1 + len(counts)) / (1 + df[s]))) for s, k in c.items()} for i, c in counts.items()}
    links = []
    for a, b in itertools.combinations(weight, 2):
        x, y = weight[a], weight[b]
        shared = sum(min(w, y[s]) for s, w in x.items() if s in y)
        if shared >= 0.8 * (sum(x.values()) + sum(y.values()) - shared):
            links.append((a, b))
    want = groups([r[0] for r in documents()], links)
    got = near_dedup.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["group_id"] for r in got} == want
    assert {r["doc_id"] for r in got if r["kept"]} == {i for i, g in want.items() if i == g}


def test_quality_rules_counts(docs):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t, *_ in documents():
        words = WORD.findall(t or "")
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        times = Counter(windows)
        repeated = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_repeat_words"]) == (len(words), sum(map(len, words)), len(repeated))
        assert got[i]["base_failed"] == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))
        assert not (got[i]["kept"] and got[i]["base_failed"])


def test_decontamination(spark, docs):
    passage = " ".join(documents()[20][1].split()[3:25])
    items = spark.createDataFrame([("a", passage), ("b", None), ("c", ""), ("d", "one"), ("d", "one")], "item_id string, text string")
    got = {r["doc_id"]: r for r in decontamination.decontaminate(docs, items).collect()}
    assert got[20]["items"] == ["a"] and len(got[20]["hits"]) == 22 and got[20]["contaminated"]
    assert got[55]["items"] == ["d"] and not got[52]["contaminated"] and len(got) == len(documents())


def test_packing(docs):
    rows = packing.pack_documents(docs).collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in documents()}
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY


def test_classifier_held_out(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(200)]
    rows, labels = [], []
    for i in range(300):
        text = rng.choices(words, k=80)
        toxic, low = i % 4 == 0, i % 5 == 0
        if toxic:
            text[7], text[40] = "nastyword", "vileword"
        if low:
            text = [w + "$$$" for w in text]
        rows.append((i, " ".join(text), "en", f"s{i % 7}"))
        if i < 200:
            labels.append((i, int(not low), int(toxic)))
    rows += [(300, None, None, None), (301, "", "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality_classifier.classify(docs, marks).collect()}
    right = sum(kept[i] == (i % 4 != 0 and i % 5 != 0) for i in range(200, 300))
    assert len(kept) == 302 and right >= 95
    assert all(r["kept"] for r in quality_classifier.classify(docs, marks.limit(0)).collect())


def test_empty_tables(none, spark):
    items = spark.createDataFrame([], "item_id string, text string")
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert line_dedup.line_dedup(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert quality_rules.quality_rules(none).count() == 0
    assert decontamination.decontaminate(none, items).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert quality_classifier.classify(none, marks).count() == 0
