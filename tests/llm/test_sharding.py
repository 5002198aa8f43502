"""Sharding: the law of one more shard, movement confined to changed subtrees, gapless slots, awkward rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from weftline.llm import sharding

CLASHES = ("shard", "slot", "n", "order", "bucket", "size", "law", "before", "start", "rows", "i", "part")


def descend(key, tree):
    """The same descent in plain Python."""
    node = ""
    for _ in range(3):
        draws = []
        for name, weight in tree[node]:
            u = (int(hashlib.md5(f"{name}:{key}".encode()).hexdigest()[:13], 16) + 1) / 2**52
            draws.append((math.log(u) / weight, name))
        node = max(draws)[1]
    return node


def placed(spark, tree, n=4000):
    return {r["id"]: r["s"] for r in spark.range(n).select("id", sharding.shard_of(F.col("id"), tree).alias("s")).collect()}


def weights(**changed):
    base = {(f"r{i // 8}", str(i // 4 % 2), str(i)): 1.0 for i in range(16)}
    return base | {k: v for k, v in changed.values()}


def test_same_as_plain_python(spark):
    tree = sharding.tree_of(weights(a=(("r0", "1", "5"), 2.5), b=(("r1", "0", "9"), 0.0)))
    got = placed(spark, tree, 500)
    assert got == {i: descend(i, tree) for i in range(500)} and "9" not in got.values()


def test_one_more_shard_takes_rows_only_into_itself(spark):
    before = placed(spark, sharding.equal_shards(16))
    for n in (17, 18):
        after = placed(spark, sharding.equal_shards(n))
        assert {s for i, s in after.items() if s != before[i]} == {str(n - 1)}
        assert 0.7 < sum(s == str(n - 1) for s in after.values()) * n / len(after) < 1.3
        before = after


def test_movement_stays_in_subtrees_whose_weights_change(spark):
    before = placed(spark, sharding.tree_of(weights()))
    after = placed(spark, sharding.tree_of(weights(a=(("r1", "0", "9"), 3.0))))
    region, rack = {str(i): i // 8 for i in range(16)}, {str(i): i // 4 for i in range(16)}
    for i, s in after.items():
        if s != before[i]:
            # It entered region 1, or stayed there and entered rack 2, or stayed there and entered shard 9.
            assert region[s] == 1
            if region[before[i]] == 1:
                assert rack[s] == 2 and (rack[before[i]] != 2 or s == "9")
    share = Counter(after.values())
    assert abs(share["9"] / len(after) - 3 / 18) < 0.03 and abs(share["0"] / len(after) - 1 / 18) < 0.02


def test_rows_with_null_and_repeated_ids(spark):
    rows = [(i, f"text {i}") for i in range(300)] + [(7, "other"), (7, "other"), (None, None), (None, ""), (None, "é"), (3, "x" * 2_000_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in CLASHES}).repartition(5)
    got = sharding.place(docs, 16, 17).collect()
    plain = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == plain
    slots, shards = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        shards[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shards.values())
    assert sharding.place(docs.limit(0), 16, 17).count() == 0
    assert {r["grown_shard"] for r in sharding.place(docs, 16).collect()} == {None}


def test_many_equal_rows_are_unfolded(spark, monkeypatch):
    monkeypatch.setattr(sharding, "UNFOLD", 16)
    docs = spark.createDataFrame([(1, "same")] * 100 + [(2, "b")] * 33 + [(3, "c")], "doc_id bigint, text string")
    got = sharding.place(docs, 2).collect()
    for shard in {r["shard"] for r in got}:
        own = sorted((r["slot"], r["doc_id"]) for r in got if r["shard"] == shard)
        assert [s for s, _ in own] == list(range(len(own)))
    assert Counter(r["doc_id"] for r in got) == {1: 100, 2: 33, 3: 1}


def test_files_of_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id bigint, text string")
    sharding.write_shards(docs, f"{tmp_path}/out", 16, files_per_shard=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    tree = sharding.equal_shards(16)
    assert {(r["doc_id"], r["text"], r["shard"]) for r in back.collect()} == {(i, f"text {i}", int(descend(i, tree))) for i in range(200)}
