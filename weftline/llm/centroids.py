"""Centroid clustering of integer vectors, screened by block norms.

A vector is cut into segments and the norm of each is kept beside it. By Cauchy and Schwarz the
inner product of two segments is at most the product of their norms, so the sum of the squared
differences of norms bounds the squared distance from below: a product of two thin matrices, from
the compressed vectors and centroids alone. Only centroids whose bound does not exceed the best
distance so far get an exact integer distance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.session import table, written

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
SEGMENTS = 8
#: Components up to this keep squared distances of 64 components, and sums of a block in double precision, exact.
LARGEST = 1 << 27
#: Rows held at a time, however large the Arrow batch.
BLOCK = 4096
#: Of the bound's terms: far more than rounding can take from it.
SLACK = 1e-9


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.reshape(-1), kind))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def segment_norms(x: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """Euclidean norms of `segments` equal pieces of each row."""
    parts = x.astype(np.float64).reshape(len(x), segments, -1)
    return np.sqrt(np.einsum("nsd,nsd->ns", parts, parts))


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, exact distances taken) of integer rows; ties go to the smaller number."""
    own = segment_norms(centroids)
    squares, theirs = (norms * norms).sum(1)[:, None], (own * own).sum(1)[None]
    bound = squares + theirs - 2 * norms @ own.T - SLACK * (squares + theirs) - 1
    rows = np.arange(len(x))
    label = bound.argmin(1)  # the likeliest first: it turns most others away
    away = x - centroids[label]
    distance = np.einsum("nd,nd->n", away, away)
    first, taken = label.copy(), np.ones(len(x), np.int32)
    for j in range(len(centroids)):
        near = rows[(bound[:, j] <= distance) & (first != j)]
        away = x[near] - centroids[j]
        found = np.einsum("nd,nd->n", away, away)
        better = (found < distance[near]) | ((found == distance[near]) & (j < label[near]))
        taken[near] += 1
        label[near[better]], distance[near[better]] = j, found[better]
    return label, distance, taken


def compressed(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, norms): usable vectors as integers floor(scale * x), and the norms of their segments.

    Vectors that are null, of another length, or with a null or non-finite component are left out.
    A component beyond LARGEST is an error: squared distances would not fit a long.
    """

    def run(batches):
        for batch in batches:
            column = batch.column("embedding")
            fits = pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(column), dimensions), False)
            x = _rows(column.filter(fits), dimensions).astype(np.float64)  # a null component is NaN here
            good = np.isfinite(x).all(1)
            ids = batch.column("vec_id").filter(fits).filter(pa.array(good))
            x = np.floor(scale * x[good])
            if x.size and np.abs(x).max() > LARGEST:
                raise ArithmeticError(f"a component is beyond {LARGEST} after scaling")
            x = x.astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, _lists(x, pa.int32()), _lists(segment_norms(x), pa.float64())], names=["vec_id", "v", "norms"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, f"vec_id {kind}, v array<int>, norms array<double>")


def _blocks(batch: pa.RecordBatch, dimensions: int):
    for at in range(0, batch.num_rows, BLOCK):
        part = batch.slice(at, BLOCK)
        yield part, _rows(part.column("v"), dimensions).astype(np.int64), _rows(part.column("norms"), SEGMENTS)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the exact floor of each cluster's mean; those of empty clusters stay.

    A task sends one row of sums a centroid at most, and as many rows as there are centroids
    reach the driver.
    """
    k, dimensions = centroids.shape

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for batch in batches:
            for _, x, norms in _blocks(batch, dimensions):
                label = nearest(x, norms, centroids)[0]
                one = np.zeros((k, len(x)))
                one[label, np.arange(len(x))] = 1
                count += np.bincount(label, minlength=k)
                total += np.rint(one @ x.astype(np.float64)).astype(np.int64)  # exact: a block's sums are below 2**53
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), _lists(total[used], pa.int64())], names=["cluster", "n", "sums"])

    parts = vectors.select("v", "norms").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dimensions)]
    after = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():
        after[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(dimensions)]
    return after


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, n_exact): n_exact centroids were not screened out."""

    def run(batches):
        for batch in batches:
            for part, x, norms in _blocks(batch, centroids.shape[1]):
                label, distance, taken = nearest(x, norms, centroids)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(label.astype(np.int32)), pa.array(distance), pa.array(taken)], names=["vec_id", "cluster", "distance", "n_exact"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint, n_exact int")


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = "2", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, n_exact, cluster_inertia, inertia, centroid_sha256) of every usable vector of embeddings(vec_id, embedding).

    Seeds are the k vectors of the least sha256 of `<seed>:<vec_id>`; where ids repeat, the smaller
    vector is first, and vectors without an id are the last to be seeds (they are clustered as
    all others). With fewer than k vectors each is a seed. Equal vectors go to one cluster, ties of
    distance to the smaller number, and a cluster left empty keeps its centroid. Rows that repeat an
    id are clustered each on its own. Other columns are not used; a table without a usable vector
    gives an empty table.

    Vectors are compressed once into a written table, which rounds scan; centroids, k rows, are in
    the tasks' closures. `dimensions` is a multiple of SEGMENTS and at most 64.
    """
    vectors = written(compressed(embeddings, dimensions, scale), "vectors")
    ranked = vectors.select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"))
    seeds = ranked.orderBy(F.asc_nulls_last("hash"), "v").limit(k).collect()
    centroids = np.array([row["v"] for row in seeds], np.int64).reshape(-1, dimensions)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    spark = embeddings.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, n_exact int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    found = written(assigned(vectors, centroids), "assigned")
    inertia = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows
    total = sum(inertia.values())
    rows = [(j, inertia[j], total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist()) if j in inertia]
    of_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "n_exact", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings")).drop("n_exact")


def _oracle() -> str:
    text = f"""
WITH k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v, sha256('2:' || vec_id) AS h
  FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c FROM k QUALIFY j < {CENTROIDS})"""

    def assign(i: int) -> str:
        return f"""
a{i} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min({{'d': list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'j': j}}) AS best FROM k, c{i} GROUP BY vec_id)"""

    for i in range(ROUNDS):
        text += f""",{assign(i)},
m{i} AS (SELECT best.j AS j, p, sum(v[p]) AS s, count(*) AS n FROM a{i}, range(1, {DIMENSIONS + 1}) AS r(p) GROUP BY best.j, p),
c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(f.c, c.c) AS c FROM c{i} c LEFT JOIN (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS c FROM m{i} GROUP BY j) f USING (j))"""
    return (
        text
        + f""",{assign(ROUNDS)}
SELECT vec_id, CAST(best.j AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.j) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.j = a.best.j
"""
    )


QUERIES = {"op12_centroid_clustering": op12_centroid_clustering}
ORACLES = {"op12_centroid_clustering": _oracle()}
