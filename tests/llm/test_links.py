"""Links and components against brute force in a bucket of many variants."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_operators import groups
from weftline.llm import utf8
from weftline.llm.links import PARITY, SLOTS, agreement, bucket_pairs, leader_links, parities, sketch, threshold


def jaccard(a, b):
    return len(a & b) / len(a | b)


def sketched(sets):
    """Sketches of one MinHash sample for each slot."""
    seeds = utf8.mix(np.arange(1, SLOTS + 1, dtype=np.uint64))
    rows = np.array([[utf8.mix(np.array(sorted(s), np.uint64) * np.uint64(utf8.BASE) ^ seed).min() for seed in seeds] for s in sets])
    return sketch(rows)


@pytest.mark.parametrize("bounded", [False, True])
def test_members_linked_to_one_variant_only(spark, bounded):
    rng = random.Random(8)
    base = set(range(100))
    sets = {i: base - set(rng.sample(range(100), 10)) | {1000 + i} for i in range(1100)}
    for k in range(12):
        own = sets[rng.randrange(1100)]
        sets[2000 + k] = own - set(rng.sample(sorted(own), 6)) | {50_000 + 100 * k + j for j in range(12)}
        sets[3000 + k] = set(rng.sample(range(100), 40)) | {90_000 + 100 * k + j for j in range(60)}
    links = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8}
    assert all(sum(x in link for link in links) == 1 for x in range(2000, 2012))
    halves = sketched(sets.values())
    items = spark.createDataFrame([(i, sorted(s), int(x), int(y)) for (i, s), (x, y) in zip(sets.items(), halves)], "id bigint, items array<int>, s0 bigint, s1 bigint").cache()
    asked = []

    def verify(pairs):
        asked.append(pairs.count())
        left, right = (items.select(F.col("id").alias(one), F.col("items").alias(x)) for one, x in (("a", "x"), ("b", "y")))
        shared, union = F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))
        return pairs.join(left, "a").join(right, "b").filter(shared >= 0.8 * union).select("a", "b")

    members = items.select(F.lit(1).cast("bigint").alias("key"), "id", "s0", "s1")
    if bounded:
        held = Counter(x for s in sets.values() for x in s)
        weights = [(i, float(len(s)), float(sum(held[x] > 1 for x in s))) for i, s in sets.items()]
        members = members.join(spark.createDataFrame(weights, "id bigint, whole double, shared double"), "id")
    found, roots = leader_links(members, verify, 0.8)
    assert {i: i for i in sets} | {r["id"]: r["root"] for r in roots.collect()} == groups(sets, sorted(links))
    assert {(r["a"], r["b"]) for r in found.collect()} <= links
    assert sum(asked) < len(sets) ** 2 / 8


def test_sketches(spark):
    rng = random.Random(2)
    kept = 0
    pairs = []
    for _ in range(400):
        shared, own = [{rng.getrandbits(60) for _ in range(n)} for n in (80, 10)]
        pairs += [shared | own, shared | {rng.getrandbits(60) for _ in range(10)}]
    halves = sketched(pairs)
    rows = [(*map(int, halves[i]), *map(int, halves[i + 1])) for i in range(0, 800, 2)]
    found = spark.createDataFrame([*rows, (None, None, 1, 1)], "a bigint, b bigint, c bigint, d bigint").select(agreement(("a", "b"), ("c", "d")).alias("n")).collect()
    for row, (a, b, c, d) in zip(found, rows):
        assert row["n"] == sum(((x >> s) & 15) == ((y >> s) & 15) for x, y in ((a, c), (b, d)) for s in range(0, 64, 4))
        kept += row["n"] >= threshold(0.8)
    assert kept >= 397 and found[-1]["n"] == SLOTS


def test_variants_with_much_of_their_own_make_no_pairs(spark):
    """400 variants alike by 0.73 or so among each other, by shared words in one bucket: none is held against another."""
    rng = random.Random(5)
    sets = {i: set(rng.sample(range(100), 97)) | {1000 + 100 * i + j for j in range(14)} for i in range(400)}
    assert all(0.6 < jaccard(sets[0], sets[i]) < 0.8 for i in range(1, 400))
    halves = sketched(sets.values())
    rows = [(1, i, int(x), int(y), float(len(s)), float(len(s & set(range(100))))) for (i, s), (x, y) in zip(sets.items(), halves)]
    members = spark.createDataFrame(rows, "key bigint, id bigint, s0 bigint, s1 bigint, whole double, shared double")
    asked = []

    def verify(pairs):
        asked.append(pairs.count())
        return pairs.filter("a = b")

    for bounded, few in ((True, True), (False, False)):
        asked.clear()
        leader_links(members if bounded else members.drop("whole", "shared"), verify, 0.8)
        assert (sum(asked) == 0) == few


def test_bounds_of_sets_turn_near_misses_away(spark):
    """300 sets of one bucket alike by 0.7 or so, and 12 copies alike by 0.8 to 0.9: pairs follow the copies, not the square of the bucket."""
    rng = random.Random(7)
    sets = {i: set(rng.sample(range(400), 370)) | {1000 + 100 * i + j for j in range(40)} for i in range(300)}
    for k in range(12):
        own = sorted(sets[k])
        sets[500 + k] = set(rng.sample(own, len(own) - 2 - 3 * k)) | {90_000 + 100 * k + j for j in range(3 * k)}
    links = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8}
    assert len(links) >= 12 and 0.65 < jaccard(sets[100], sets[200]) < 0.8
    classes = [utf8.mix(np.array(sorted(x), np.uint64) * np.uint64(utf8.BASE)) >> np.uint64(55) for x in sets.values()]
    odd = parities(np.concatenate(classes).astype(np.int64), np.repeat(np.arange(len(sets)), [len(x) for x in classes]), len(sets))
    for a, b in ((0, 1), (0, 300), (11, 311), (5, 9)):
        x, y = (sets[sorted(sets)[i]] for i in (a, b))
        assert sum(int(v).bit_count() for v in (odd[a] ^ odd[b]).view(np.uint64)) <= len(x ^ y)
    reach = spark.createDataFrame([(i, len(x), *map(int, p)) for (i, x), p in zip(sets.items(), odd)], "id bigint, whole bigint, " + ", ".join(f"{p} bigint" for p in PARITY))
    members = spark.createDataFrame([(1, i, int(x), int(y)) for i, (x, y) in zip(sets, sketched(sets.values()))], "key bigint, id bigint, s0 bigint, s1 bigint")
    asked = []

    def verify(pairs):
        held = [(r["a"], r["b"]) for r in pairs.collect()]
        asked.append(len(held))
        return spark.createDataFrame([x for x in held if jaccard(sets[x[0]], sets[x[1]]) >= 0.8], "a bigint, b bigint")

    _, roots = leader_links(members, verify, 0.8, reach)
    assert {i: i for i in sets} | {r["id"]: r["root"] for r in roots.collect()} == groups(sets, sorted(links))
    assert sum(asked) < 4000


def test_line_bounds():
    from weftline.llm.line_dedup import SHINGLE, bounds

    lines = ["abcdefgh", "abc", "------------", "the same words again and the same words again", "\u00e9\U0001f600" * 9]
    whole, odd = bounds(lines, SHINGLE)
    sets = [{x[i : i + SHINGLE] for i in range(len(x) - SHINGLE + 1)} for x in lines]
    assert whole.tolist() == [len(x) for x in sets]
    assert [sum(int(v).bit_count() for v in row.view(np.uint64)) % 2 for row in odd] == [len(x) % 2 for x in sets]


def test_small_buckets_meet_directly(spark):
    """Pairs of small buckets and links of a large one make the components of all links in buckets."""
    rng = random.Random(11)
    base = set(range(200))
    sets = {i: base - set(rng.sample(range(200), 12)) | {1000 + i} for i in range(60)}
    keys = [(1, i) for i in range(60)]
    for k in range(90):
        own = {10_000 + 100 * k + j for j in range(80)}
        for c in range(3):
            sets[100 + 3 * k + c] = own - set(rng.sample(sorted(own), 2)) | {90_000 + 3 * k + c} if c < 2 else {200_000 + 100 * k + j for j in range(80)}
            keys.append((100 + k, 100 + 3 * k + c))
    keys += [(500, 0), (500, 100)]
    halves = dict(zip(sets, sketched(sets.values())))
    members = spark.createDataFrame([(key, i, *map(int, halves[i])) for key, i in keys], "key bigint, id bigint, s0 bigint, s1 bigint")
    asked = []

    def verify(pairs):
        held = [(r["a"], r["b"]) for r in pairs.collect()]
        asked.extend(held)
        return spark.createDataFrame([x for x in held if jaccard(sets[x[0]], sets[x[1]]) >= 0.8], "a bigint, b bigint")

    pairs, large = bucket_pairs(members, 0.8)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(100 + 3 * k, 101 + 3 * k) for k in range(90)} and large.count() == 60
    _, roots = leader_links(large, verify, 0.8, pairs=pairs)
    links = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    assert {i: i for i in sets} | {r["id"]: r["root"] for r in roots.collect()} == groups(sets, links)
    assert len(asked) < 400
