"""Exact cosine search over vector columns."""

from __future__ import annotations

import math
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.session import forget, written

#: Vectors of the query side that one task holds; more queries are taken in blocks.
BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a missing vector or another dimension, 0 for a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norms <= 1e-12, 0.0).otherwise(dot(a, b) / norms))


def unit(v: Column) -> Column:
    """The vector at length 1 (a zero vector stays), so that dot() of two is their cosine."""
    scaled = lambda x: F.transform(x["v"], lambda y: F.when(x["n"] <= 1e-12, y.cast("double")).otherwise(y.cast("double") / x["n"]))
    return F.get(F.transform(F.array(F.struct(v.alias("v"), F.sqrt(dot(v, v)).alias("n"))), scaled), F.lit(0))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as unit vectors (zeros for null), and each row's dimension (-1 for null)."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), max(1, size.max(initial=1))))
    flat = pc.fill_null(column.flatten(), float("nan")) if column.flatten().null_count else column.flatten()
    out[np.arange(out.shape[1]) < size[:, None]] = flat.to_numpy(zero_copy_only=False)
    norm = np.sqrt((out * out).sum(1))
    return out / np.where(norm <= 1e-12, 1, norm)[:, None], size


def _about(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """`_same` in single precision."""
    width = min(a[0].shape[1], b[0].shape[1])
    scores = a[0][:, :width].astype(np.float32) @ b[0][:, :width].astype(np.float32).T
    if (a[1] != a[1][0]).any() or (b[1] != a[1][0]).any():
        scores[(a[1][:, None] != b[1]) | (a[1][:, None] < 0)] = -np.inf
    return scores


def _same(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Cosines of all rows of a with all of b; -inf where a side is missing or the dimensions differ."""
    width = min(a[0].shape[1], b[0].shape[1])
    scores = a[0][:, :width] @ b[0][:, :width].T
    return np.where((a[1][:, None] == b[1]) & (a[1][:, None] >= 0), scores, -np.inf)


#: Rows that hold blocks of vectors are given to Python this many at a time: by thousands they fill its memory.
BLOCKS_A_BATCH = 4


@contextmanager
def _few_a_batch(spark):
    """Small Arrow batches for the steps written inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BLOCKS_A_BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def top_k(queries: DataFrame, items: DataFrame, k: int, floor: float, skip_equal_ids: bool = False) -> DataFrame:
    """(query_id, item_id, score, rank): for each query the k best items over the floor; ties go by item_id.

    Both sides are (id, first, second) with two nullable vectors; the score is the greatest of the
    four cosines, 0 where all are null. Queries are a stated set: they are packed into blocks, the
    blocks meet every chunk of items as a matrix product, and each task passes on its k best for
    each query, so that the shuffle holds k rows for a query and task. Ids of the two sides
    are apart, unless `skip_equal_ids` says that both are one table and a row is no match of itself.
    """
    found = pa.schema([("query_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())])
    packed = queries.select("id", "first", "second").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-queries.count() // BLOCK)))))
    blocks = packed.groupBy("block").agg(F.collect_list(F.struct("id", "first", "second")).alias("queries"))
    chunk = items.select("id", "first", "second").groupBy(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-items.count() // BLOCK)))).alias("chunk")).agg(F.collect_list(F.struct("id", "first", "second")).alias("items"))

    def search(batches):
        best: dict[int, Nearest] = {}
        size, last, names, right = 0, None, None, None

        def done():
            for one in best.values():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in one.rows()], schema=found)

        for batch in batches:
            for block, number, asked, given in zip(*(batch.column(c) for c in ("block", "chunk", "queries", "items"))):
                asked, given = asked.values, given.values
                ids = asked.field("id").to_numpy()
                left = [_matrix(asked.field(c)) for c in ("first", "second")]
                if last != number.as_py():
                    last, names, right = number.as_py(), given.field("id").to_numpy(), [_matrix(given.field(c)) for c in ("first", "second")]
                one = best.get(block.as_py())
                if one is None:
                    if size > KEPT_BYTES:
                        yield from done()
                        best, size = {}, 0
                    one = best[block.as_py()] = Nearest(ids, k, floor)
                    size += 16 * k * len(ids)
                one.meet(left, names, right, skip_equal_ids)
        yield from done()

    met = chunk.crossJoin(blocks).select("block", "chunk", "queries", "items").mapInArrow(search, "query_id bigint, item_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    with _few_a_batch(queries.sparkSession):
        return written(met.withColumn("rank", rank).filter(F.col("rank") <= k), "nearest", small=True)


#: Bytes of best items that a task of `top_k` keeps before it passes them on, and numbers of vectors that it compares in double at a time.
KEPT_BYTES, SOME = 64 << 20, 1 << 20


class Nearest:
    """The k best items so far of each query of a block.

    Products in single precision tell which pairs can be among them; these alone are compared in double.
    """

    def __init__(self, ids: np.ndarray, k: int, floor: float):
        self.ids, self.k, self.floor = ids, k, floor
        self.scores = np.full((len(ids), k), -np.inf)
        self.items = np.zeros((len(ids), k), np.int64)

    def meet(self, left: list, names: np.ndarray, right: list, skip: bool) -> None:
        if not len(names) or not self.k:
            return
        sides = [(a, b) for a in left for b in right if (a[1] >= 0).any() and (b[1] >= 0).any()]
        about = None
        for a, b in sides:
            its = _about(a, b)
            about = its if about is None else np.maximum(about, its, out=about)
        if about is None:
            about = np.full((len(self.ids), len(names)), -np.inf, np.float32)
        if len(sides) != 1 or any((x[1] != a[1][0]).any() or not np.isfinite(x[0]).all() for a, b in sides for x in (a, b)):
            about[~np.isfinite(about)] = 0.0
        if skip:
            about[self.ids[:, None] == names] = -np.inf
        # What single precision can be off by, and half a unit of the sixth place, with something to spare.
        width = max((min(a[0].shape[1], b[0].shape[1]) for a, b in sides), default=1)
        off = (width + 16) * 2.0**-22
        least = np.maximum(self.scores[:, -1], self.floor)
        new = np.flatnonzero(np.isneginf(self.scores[:, -1]))
        if len(new) and len(names) > self.k:
            least[new] = np.maximum(np.partition(about[new], len(names) - self.k, axis=1)[:, len(names) - self.k] - off - 1e-6, self.floor)
        row, column = np.nonzero(about >= (least - off - 1e-6)[:, None].astype(np.float32))
        step = max(1, SOME // width)
        for low in range(0, len(row), step):
            self.add(row[low : low + step], column[low : low + step], sides, names)

    def add(self, row: np.ndarray, column: np.ndarray, sides: list, names: np.ndarray) -> None:
        exact = np.full(len(row), -np.inf)
        for a, b in sides:
            width = min(a[0].shape[1], b[0].shape[1])
            its = np.einsum("ij,ij->i", a[0][row, :width], b[0][column, :width])
            np.maximum(exact, np.where((a[1][row] == b[1][column]) & (a[1][row] >= 0), its, -np.inf), out=exact)
        exact = np.round(np.where(np.isfinite(exact), exact, 0.0), 6)
        good = (exact >= self.floor) & (exact >= self.scores[row, -1])
        row, exact, items = row[good], exact[good], names[column[good]]
        if not len(row):
            return
        rows = np.unique(row)
        every = np.concatenate([np.repeat(rows, self.k), row])
        score, item = np.concatenate([self.scores[rows].ravel(), exact]), np.concatenate([self.items[rows].ravel(), items])
        order = np.lexsort((item, -score, every))
        every, score, item = every[order], score[order], item[order]
        place = np.arange(len(every)) - np.searchsorted(every, every)
        first = place < self.k
        self.scores[every[first], place[first]], self.items[every[first], place[first]] = score[first], item[first]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, column = np.nonzero(~np.isneginf(self.scores))
        return self.ids[row], self.items[row, column], self.scores[row, column]


def top_k_per_source(queries: DataFrame, items: DataFrame, k: int, floor: float = -1.0) -> DataFrame:
    """(query_id, source, item_id, score): for each query the k best items of every source over the floor; ties go by item_id.

    queries: (id, vector), a stated set; items: (id, source, vector). Items meet the queries in chunks
    of one source as matrix products, and a task passes on its k best of each query and chunk, so no
    pair of a query and an item is a row. Items of another dimension than a query's are none of its.
    """
    found = pa.schema([("query_id", pa.int64()), ("source", pa.string()), ("item_id", pa.int64()), ("score", pa.float64())])
    blocks = queries.select("id", "vector").groupBy(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-queries.count() // BLOCK)))).alias("block")).agg(F.collect_list(F.struct("id", "vector")).alias("queries"))
    counts = items.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    chunks = items.select("id", "source", "vector").join(counts, "source").groupBy("source", F.pmod(F.xxhash64("id"), F.col("chunks")).alias("chunk")).agg(F.collect_list(F.struct("id", "vector")).alias("items"))

    def search(batches):
        for batch in batches:
            for source, asked, given in zip(batch.column("source"), batch.column("queries"), batch.column("items")):
                asked, given = asked.values, given.values
                ids, names = asked.field("id").to_numpy(), given.field("id").to_numpy()
                scores = np.round(_same(_matrix(asked.field("vector")), _matrix(given.field("vector"))), 6)
                order = np.lexsort((np.broadcast_to(names, scores.shape), -scores), axis=1)[:, :k]
                best = np.take_along_axis(scores, order, 1)
                row, column = np.nonzero(best >= floor)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.repeat(source, len(row)), pa.array(names[order[row, column]]), pa.array(best[row, column])], schema=found)

    met = chunks.crossJoin(blocks).select("source", "queries", "items").mapInArrow(search, "query_id bigint, source string, item_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "item_id"))
    with _few_a_batch(queries.sparkSession):
        return written(met.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank"), "nearest", small=True)


#: Rows of a block of vectors, and the bytes it may have at most.
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20
#: A tile compares this many blocks with as many others at a time.
TILE = 8
#: Added to an angle's bound: far above what rounding can take from it.
SLACK = 1e-6


def _unit_rows(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows at length 1; zero rows stay."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norm = np.sqrt((x * x).sum(1))
    return x / np.where(norm <= 1e-12, 1, norm)[:, None]


def _list_rows(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.reshape(-1), pa.float64()))


def _blocked(rows: DataFrame) -> DataFrame:
    """(key, block, ids, x, centre, radius): the vectors of rows(key, id, x) in blocks of near ones.

    A key with more rows than a block takes as many pivots, one from each class of a hash, and each row
    goes to the nearest; what comes to one pivot is cut into blocks by hash. x holds the rows one after
    another at length 1, the radius is the greatest angle between a row and the centre.
    """
    spark = rows.sparkSession
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("width")))))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.first(F.size("x")).alias("width"))
    sizes = sizes.withColumn("most", most).withColumn("blocks", F.ceil(F.col("n") / F.col("most"))).select("key", "most", "blocks")
    sized = written(rows.join(sizes, "key"), "sized", small=True)
    large = sized.filter("blocks > 1")
    drawn = large.groupBy("key", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("class")).agg(F.min_by("x", F.struct(F.xxhash64("id"), "id")).alias("x"))
    pivots = drawn.groupBy("key").agg(F.collect_list(F.struct("x")).alias("pivots"))
    # Rows meet the pivots of their key in chunks: a matrix product each, in place of a copy of all pivots for each row.
    chunk = F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks"))
    chunks = large.groupBy("key", "most", chunk.alias("chunk")).agg(F.collect_list(F.struct("id", "x")).alias("rows")).join(pivots, "key")
    key, number = rows.schema["key"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()

    def nearest(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                members, tops = batch.column("rows")[i].values, batch.column("pivots")[i].values
                x = _unit_rows(members.field("x"))
                to = (x @ _unit_rows(tops.field("x")).T).argmax(1).astype(np.int64)
                same = lambda c: pa.repeat(batch.column(c)[i], len(x))
                yield pa.RecordBatch.from_arrays([same("key"), same("most"), members.field("id"), members.field("x"), pa.array(to)], names=["key", "most", "id", "x", "pivot"])

    dealt = chunks.select("key", "most", "rows", "pivots").mapInArrow(nearest, f"key {key}, most bigint, id {number}, x array<double>, pivot bigint")
    dealt = written(sized.filter("blocks = 1").select("key", "most", "id", "x", F.lit(0).cast("bigint").alias("pivot")).unionByName(dealt), "dealt", small=True)
    parts = dealt.groupBy("key", "pivot").agg(F.ceil(F.count("*") / F.first("most")).alias("parts"))
    part = F.pmod(F.xxhash64("id", F.lit(2)), F.col("parts"))
    packed = dealt.join(parts, ["key", "pivot"]).groupBy("key", "pivot", part.alias("part")).agg(F.collect_list(F.struct("id", "x")).alias("rows"))

    def centred(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                members = batch.column("rows")[i].values
                x = _unit_rows(members.field("x"))
                centre = x.sum(0)
                centre /= max(np.sqrt((centre * centre).sum()), 1e-12)
                radius = float(np.arccos(np.clip((x @ centre).min(), -1, 1)))
                ids = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), members.field("id"))
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, 1), ids, _list_rows(x.reshape(1, -1)), _list_rows(centre[None]), pa.array([radius])], names=["key", "ids", "x", "centre", "radius"])

    made = packed.select("key", "rows").mapInArrow(centred, f"key {key}, ids array<{number}>, x array<double>, centre array<double>, radius double")
    numbered = written(made.withColumn("block", F.monotonically_increasing_id()), "blocks")
    forget(sized, dealt)
    return numbered


def _tiles(blocks: DataFrame, threshold: float) -> DataFrame:
    """(key, tile, block, pairs): the blocks that each tile compares, and the pairs of blocks whose bound reaches the threshold.

    Two rows are at least as far apart, as angles, as the centres of their blocks less both radii.
    """
    order = Window.partitionBy("key").orderBy("block")
    heads = blocks.select("key", "block", "centre", "radius").withColumn("place", F.floor((F.row_number().over(order) - 1) / TILE))
    other = heads.withColumnsRenamed({"block": "block2", "centre": "centre2", "radius": "radius2", "place": "place2"})
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("centre"), F.col("centre2")))))
    near = angle - F.col("radius") - F.col("radius2") <= math.acos(max(-1.0, min(1.0, threshold))) + SLACK
    pairs = heads.join(other, "key").filter((F.col("block") <= F.col("block2")) & near)
    tile = F.struct("place", "place2")
    listed = pairs.groupBy("key", tile.alias("tile")).agg(F.collect_list(F.struct("block", "block2")).alias("pairs"))
    ends = F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.array(p["block"], p["block2"]))))
    needed = listed.select("key", "tile", F.explode(ends).alias("block"))
    content = needed.join(blocks.select("block", "ids", "x"), "block").groupBy("key", "tile").agg(F.collect_list(F.struct("block", "ids", "x")).alias("blocks"))
    return content.join(listed, ["key", "tile"]).select("key", "blocks", "pairs")


def pairs_over(df: DataFrame, id_column: str, vector: str, threshold: float, group: list[str]) -> DataFrame:
    """(group, a, b, similarity) with a < b: pairs of one group whose cosine reaches the threshold.

    Missing and empty vectors and zero vectors are in no pair (but zero vectors are where the
    threshold is 0 or less); vectors of different dimensions are never compared. Groups may be of any
    size: vectors are gathered in blocks round pivots, pairs of blocks that cannot reach the
    threshold go, and the others are matrix products, TILE by TILE blocks in a task. So a group of n
    costs n * n / (2 * BLOCK_ROWS ** 2) rows of bounds, products of the blocks left, and each block is
    sent to n / (TILE * BLOCK_ROWS) tasks at most; only pairs over the threshold become rows.
    """
    key = F.struct(*group, F.size(vector).alias("__width"))
    rows = df.filter(F.size(vector) > 0).select(key.alias("key"), F.col(id_column).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("x"))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in group)
    number = df.schema[id_column].dataType.simpleString()

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                held = batch.column("blocks")[i].values
                at = {b: j for j, b in enumerate(held.field("block").to_pylist())}
                ids = [held.field("ids")[j].values for j in range(len(at))]
                x = [held.field("x")[j].values.to_numpy(zero_copy_only=False).reshape(len(ids[j]), -1) for j in range(len(at))]
                keys = batch.column("key")[i]
                for pair in batch.column("pairs")[i].as_py():
                    one, two = at[pair["block"]], at[pair["block2"]]
                    scores = np.round(x[one] @ x[two].T, 6)
                    row, column = np.nonzero(np.triu(scores >= threshold, 1) if one == two else scores >= threshold)
                    if len(row):
                        constants = [pa.repeat(keys[c], len(row)) for c in group]
                        yield pa.RecordBatch.from_arrays([*constants, ids[one].take(pa.array(row)), ids[two].take(pa.array(column)), pa.array(scores[row, column])], names=[*group, "a", "b", "similarity"])

    found = _tiles(_blocked(rows), threshold).mapInArrow(compare, f"{kinds}, a {number}, b {number}, similarity double")
    return found.filter("a <> b").select(*group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def links_over(df: DataFrame, id_column: str, vector: str, threshold: float, group: list[str]) -> DataFrame:
    """(a, b): links enough to join all rows of a group whose cosine reaches a threshold above 0.

    Equal vectors are linked to the least id among them, so that only different vectors are compared:
    a vector that many rows have costs a link each, not a pair each.
    """
    usable = df.filter(F.size(vector) > 0).select(*group, F.col(id_column).alias("id"), F.col(vector).alias("x"))
    own = written(usable.filter(F.exists("x", lambda x: x != 0)).withColumn("hash", F.xxhash64("x")), "hashed")
    first = own.groupBy(*group, "hash").agg(F.min("id").alias("first"))
    leaders = written(own.join(first, [*group, "hash"]).filter("id = first").select(*group, "hash", "first", F.col("x").alias("its")), "leaders", small=True)
    met = own.join(leaders, [*group, "hash"]).filter("id <> first")
    same = met.filter("x = its").select(F.col("first").alias("a"), F.col("id").alias("b"))
    # Other vectors of the same hash are compared like any.
    different = leaders.select(*group, F.col("first").alias("id"), F.col("its").alias("x")).unionByName(met.filter("x <> its").select(*group, "id", "x"))
    return same.unionByName(pairs_over(different, "id", "x", threshold, group).select("a", "b"))
