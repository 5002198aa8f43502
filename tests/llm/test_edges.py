"""One table of awkward rows through every operator and pipeline stage: null and repeated ids, equal and
other texts under one id, columns of names that operators use inside, a text of several MB, ties."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import decontamination, line_dedup, near_dedup, packing, quality_classifier, quality_rules, suffix_arrays, suffix_trees, token_counts, warc
from weftline.session import shared_dir

CLASHES = ("tokens", "spans", "hits", "items", "exact", "row", "n_lines", "n_removed", "places", "keys", "number", "id", "piece", "length", "offset", "__salt", "ranges", "unit", "text_key", "kept", "s0", "__row", "low", "host", "path")
rng = random.Random(11)
VOCABULARY = ["".join(rng.choices("abcdefghijklmnopqrstuvw", k=rng.randint(2, 9))) for _ in range(3000)]


def words(n, seed):
    return random.Random(seed).choices(VOCABULARY, k=n)


X = "\n".join(" ".join(words(20, i)) for i in range(5))
Y = "\n".join(" ".join(words(20, 50 + i)) for i in range(5))
BIG = "\n".join(" ".join(words(400, 1000 + i)) for i in range(1200))
ROWS = [
    (1, X, "en"),
    (2, X, "en"),
    (2, Y, "en"),
    (2, Y, "en"),
    (None, X, "en"),
    (None, None, None),
    (3, None, "fr"),
    (4, "", ""),
    (5, " \n\t", None),
    (6, BIG, "en"),
    (7, "Short line", "en"),
    (8, "short  LINE", "en"),
    (9, "zz yy " + X, "en"),
    (9, "q", "en"),
]


def table(spark, rows):
    made = spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return made.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, []).limit(0)


def found(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def per_row(value):
    return Counter((i, value(t)) for i, t, _ in ROWS)


def test_token_counts(docs, none):
    got = token_counts.token_counts(docs, token_counts.default_model())
    counted = {t: n for t, n in {(r["doc_id"], r["n_tokens"]) for r in got.collect()}}
    assert counted[4] == counted[3] == 0 and counted[6] > 400_000
    assert found(got, "doc_id").total() == len(ROWS) and token_counts.token_counts(none, token_counts.default_model()).count() == 0


def test_line_dedup(docs, none):
    got = line_dedup.line_dedup(docs)
    assert set(got.columns) == set(docs.columns)
    rows = {(r["doc_id"], r["text"], r["n_removed"]) for r in got.collect()}
    # The row without an id comes first; both rows of id 2 that hold Y keep their lines.
    assert (None, X, 0) in rows and (1, "", 5) in rows and (2, "", 5) in rows and (2, Y, 0) in rows
    assert (6, BIG, 0) in rows and (7, "Short line", 0) in rows and (8, "", 1) in rows and (3, None, 0) in rows and (4, "", 0) in rows
    assert got.count() == len(ROWS) and line_dedup.line_dedup(none).count() == 0


def test_near_dedup(docs, none):
    got = near_dedup.near_duplicates(docs)
    key = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    rows = Counter((r["doc_id"], r["text_key"], r["group_id"], r["kept"]) for r in got.collect())
    assert rows[(1, key(X), 1, True)] == 1 and rows[(2, key(X), 1, False)] == 1 and rows[(2, key(Y), 2, True)] == 2
    assert rows[(None, key(X), None, True)] == 1 and rows[(3, key(None), 3, True)] == 1 and rows[(6, key(BIG), 6, True)] == 1
    assert rows[(9, key(ROWS[12][1]), 1, False)] == 1 and rows.total() == len(ROWS) and near_dedup.near_duplicates(none).count() == 0


def test_quality_rules(docs, none):
    got = quality_rules.quality_rules(docs)
    assert found(got, "doc_id", "n_words") == per_row(lambda t: len((t or "").split()))
    assert quality_rules.quality_rules(none).count() == 0


def test_substrings_by_words(docs, none):
    got = suffix_trees.dedup_words(docs)
    rows = found(got, "doc_id", "n_words", "n_removed")
    assert rows[(1, 100, 0)] == 1 and rows[(2, 100, 100)] == 1 and rows[(2, 100, 0)] == 2 and rows[(None, 100, 0)] == 1
    assert rows[(9, 102, 100)] == 1 and rows[(9, 1, 0)] == 1 and rows[(6, 480_000, 0)] == 1
    assert rows.total() == len(ROWS) and suffix_trees.dedup_words(none).count() == 0


def test_substrings_by_bytes(docs, none):
    rows = found(suffix_arrays.dedup_bytes(docs), "doc_id", "n_bytes", "n_removed", "n_spans")
    n = len(X.encode())
    assert rows[(1, n, 0, 0)] == 1 and rows[(2, n, n, 1)] == 1 and rows[(9, n + 6, n, 1)] == 1 and rows[(9, 1, 0, 0)] == 1
    assert rows[(2, len(Y.encode()), 0, 0)] == 2 and rows[(6, len(BIG.encode()), 0, 0)] == 1 and rows.total() == len(ROWS)
    assert suffix_arrays.dedup_bytes(none).count() == 0


def test_classifier(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (6, 1, 0), (None, 0, 0), (7, None, 1)], "doc_id bigint, quality int, toxic int")
    got = quality_classifier.classify(docs, labels)
    assert got.count() == len(ROWS) and quality_classifier.classify(none, labels).count() == 0
    assert all(r["p_document"] is None and r["p_low"] is not None for r in got.filter("doc_id in (3, 4)").collect())


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([("a", " ".join(X.split()[3:30])), ("a", " ".join(X.split()[3:30])), (None, Y), ("b", None), ("c", "??"), ("d", "short LINE")], "item_id string, text string")
    rows = found(decontamination.decontaminate(docs, items), "doc_id", "n_words", "contaminated")
    assert rows[(1, 100, True)] == rows[(2, 100, True)] == rows[(None, 100, True)] == rows[(9, 102, True)] == 1
    assert rows[(2, 100, False)] == 2 and rows[(7, 2, True)] == rows[(8, 2, True)] == 1 and rows[(6, 480_000, False)] == 1
    assert rows.total() == len(ROWS) and decontamination.decontaminate(none, items).count() == 0
    assert decontamination.decontaminate(docs, items.limit(0)).filter("contaminated").count() == 0


def test_proximity(spark, docs):
    edited = X.split()[3:30]
    edited[5] = "unheardof"
    items = spark.createDataFrame([("a", " ".join(edited)), ("b", "none of this is there at all")], "item_id string, text string")
    got = decontamination.proximity(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, "a") for i in (None, 1, 2, 9)}


def test_packing(docs, none):
    got = packing.pack_documents(docs).collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(i for i, _, _ in ROWS)
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= packing.CAPACITY and packing.pack_documents(none).count() == 0


def test_archives(spark):
    big = BIG + "é"
    pages = [(1, "u", "x"), (5, "u", "x"), (5, None, "x"), (None, "u", "x"), (None, None, "only"), (None, None, "only"), (7, " a b\n", None), (8, "", ""), (9, "u", big)]
    table_of = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumns({c: F.lit("clash") for c in ("id", "payload", "path", "refers_to", "record_type")})
    got = warc.round_trip(table_of, f"{shared_dir(spark)}/warc")
    rows = found(got, "page_id", "payload_bytes", "record_type", "refers_to")
    assert rows == Counter({(1, 1, "revisit", 5): 1, (5, 1, "response", None): 2, (None, 1, "revisit", 5): 1, (None, 4, "response", None): 2, (7, 0, "revisit", 8): 1, (8, 0, "response", None): 1, (9, len(big.encode()), "response", None): 1})
    assert warc.round_trip(table_of.limit(0), f"{shared_dir(spark)}/warc").count() == 0


def test_stages(spark, docs, none, tmp_path):
    sf_dir = f"file://{tmp_path}"
    spark.createDataFrame([(1, " ".join(Y.split()[10:40]))], "item_id bigint, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    keys = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    kept = stages["quality_rules"](spark, docs, sf_dir)
    assert keys(kept) == Counter({(1, X): 1, (2, X): 1, (2, Y): 2, (None, X): 1, (6, BIG): 1, (9, ROWS[12][1]): 1}) and kept.columns == docs.columns
    lines = stages["line_dedup"](spark, kept, sf_dir)
    assert keys(lines)[(2, Y)] == 2 and keys(lines)[(None, X)] == 1 and (1, "") not in keys(lines) and lines.columns == docs.columns
    assert {r["n_lines"] for r in lines.collect()} == {"clash"} and all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    near = stages["near_dedup"](spark, kept, sf_dir)
    assert keys(near) == Counter({(1, X): 1, (2, Y): 2, (None, X): 1, (6, BIG): 1}) and near.columns == docs.columns
    clean = stages["decontamination"](spark, near, sf_dir)
    assert keys(clean) == Counter({(1, X): 1, (None, X): 1, (6, BIG): 1}) and clean.columns == docs.columns
    assert stages["packing"](spark, clean, sf_dir).filter("piece = 0").count() == 3
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0, name
