"""Centroid clustering against plain Python integers, and its bounds."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import centroids


def plain(rows, k, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: ("z" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, members in groups.items():
            c[j] = [sum(column) // len(members) for column in zip(*members)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    own = {j: sum(d for _, d, at in found if at == j) for j in range(len(c))}
    return sorted(((i, j, d, own[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found), key=repr)


def vectors(n, seed):
    rng = random.Random(seed)
    tops = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(6)]
    return [(i, [float(np.float32(x + rng.gauss(0, 0.1))) for x in rng.choice(tops)]) for i in range(n)]


def test_same_as_plain_python(spark):
    rows = vectors(300, 3)
    same = rows[5][1]
    rows += [(i, same) for i in range(400, 500)]  # a quarter of the rows is one vector
    rows += [(7, rows[8][1]), (7, same), (None, rows[9][1]), (None, rows[10][1])]
    rows += [(900, None), (901, [0.0] * 63), (902, [0.0] * 65), (903, [0.0] * 63 + [None]), (904, [math.nan] * 64), (905, [0.0] * 63 + [math.inf]), (906, [])]
    rows += [(910, [0.0] * 64), (911, [-0.001] * 64), (912, [200_000.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({c: F.lit("x") for c in ("v", "norms", "cluster", "n", "label", "distance")}).repartition(4)
    got = centroids.cluster(df, k=8, rounds=3)
    assert sorted((tuple(r)[:3] + tuple(r)[4:] for r in got.collect()), key=repr) == plain(rows, 8, 3)
    taken = [r["n_exact"] for r in got.collect()]
    assert min(taken) >= 1 and sum(taken) < 8 * len(taken)  # the bound turned some away


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vectors(5, 4)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert sorted((tuple(r)[:3] + tuple(r)[4:] for r in centroids.cluster(df).collect()), key=repr) == plain(rows, 40, 5)
    empty = centroids.cluster(df.limit(0))
    assert empty.count() == 0 and empty.columns == centroids.cluster(df).columns
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id bigint, embedding array<float>")).collect()


def test_no_centroid_within_reach_is_screened_out():
    rng = np.random.default_rng(5)
    for scale in (1, 50, 10_000, centroids.LARGEST):
        x = rng.integers(-scale, scale + 1, (500, 64))
        c = np.concatenate([x[:10], rng.integers(-scale, scale + 1, (20, 64)), x[:10]])  # ties: the first of equal ones
        label, distance, taken = centroids.nearest(x, centroids.segment_norms(x), c)
        full = ((x[:, None, :] - c[None]) ** 2).sum(2)
        assert (label == full.argmin(1)).all() and (distance == full.min(1)).all() and (taken <= len(c)).all()
