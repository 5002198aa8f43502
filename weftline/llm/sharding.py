"""Sharding by a hierarchical weighted hash tree.

Shards hang below racks and racks below regions. A row descends from the top: at each node every
child draws ln(u) / weight, with u from a hash of the row's key and the child's name, and the
greatest draw wins, so a child is taken with the probability of its weight among its siblings. A
child's draw depends on its own name and weight alone: when weights change below one child, a row
whose path avoids that child can only move onto it, and rows inside other subtrees stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from weftline.llm.sql import CRC32
from weftline.session import table, written

#: The laid-out plan: shards per rack, racks per region. Shards beyond PLANNED open a region each.
PER_RACK, PER_REGION, PLANNED = 4, 2, 16
#: A shard's slots are numbered in 2**BUCKET_BITS ranges of the order hash.
BUCKET_BITS, ORDER_BITS = 12, 60
#: Equal rows above this number are dealt out again before they are unfolded.
UNFOLD = 65_536

Tree = dict[str, list[tuple[str, float]]]


def tree_of(weights: dict[tuple[str, str, str], float]) -> Tree:
    """Children with their weights by node, from (region, rack, shard) -> weight; the top node is ''.

    A node weighs what its shards weigh. Shards without a positive weight are left out.
    """
    below: dict[str, dict[str, float]] = {}
    for (region, rack, shard), weight in sorted(weights.items()):
        if weight > 0:
            for parent, child in (("", region), (region, f"{region}/{rack}"), (f"{region}/{rack}", shard)):
                row = below.setdefault(parent, {})
                row[child] = row.get(child, 0.0) + float(weight)
    return {parent: list(children.items()) for parent, children in below.items()}


def equal_shards(n: int) -> Tree:
    """The tree of `n` shards of weight 1, named 0 to n - 1.

    The first PLANNED fill the racks of the plan; each later one is a region of its own, so that
    one more of these takes rows only into itself (were it put into a standing region, that region
    would gain rows and its old shards a part of them).
    """

    def path(i: int) -> tuple[str, str, str]:
        if i >= PLANNED:
            return f"x{i}", "0", str(i)
        rack = i // PER_RACK
        return f"r{rack // PER_REGION}", str(rack % PER_REGION), str(i)

    return tree_of({path(i): 1.0 for i in range(n)})


def shard_of(key: Column, tree: Tree) -> Column:
    """The name of the shard (a string) that the key's descent ends at.

    The tree is a literal of the plan, three levels deep however many shards there are. Equal draws
    go to the later name. Null keys are one key.
    """
    children = F.create_map(*[x for parent, row in tree.items() for x in (F.lit(parent), F.array(*[F.struct(F.lit(name).alias("name"), F.lit(weight).alias("weight")) for name, weight in row]))])
    text = F.coalesce(key.cast("string"), F.lit(""))

    def draw(child: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(child["name"], F.lit(":"), text)), 1, 13), 16, 10).cast("double")
        return F.struct((F.ln((bits + 1) / float(2**52)) / child["weight"]).alias("draw"), child["name"].alias("name"))

    node = F.lit("")
    for _ in range(3):
        node = F.array_max(F.transform(children[node], draw))["name"]
    return node


def place(docs: DataFrame, n_shards: int, grown: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row: the law is `key`.

    The id and the number of shards alone decide the shard, so rows that repeat an id go together
    wherever their texts differ, equal texts of different ids need not, and rows without an id are one
    shard's. A null text counts as empty (size 1, checksum 0); texts are read whole. `grown` is the
    number of shards of grown_shard, null for None. Slots are gapless from 0 in every shard, in the
    order of a hash of id, size and checksum (a shuffled order); rows equal in all three take
    consecutive slots. Other columns are not used; an empty table gives an empty table.

    Only ids, sizes and checksums are shuffled. A shard is numbered in ranges of the hash, so a
    task never holds a shard; equal rows are counted before the shuffle and unfolded after.
    """
    data = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    narrow = docs.select(F.col(id_column).alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    hashed = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32"))
    order = F.conv(F.substring(hashed, 1, ORDER_BITS // 4), 16, 10).cast("long")
    counted = narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")).withColumn("order", order)
    cells = written(
        counted.select(
            "*",
            F.shiftright("order", ORDER_BITS - BUCKET_BITS).cast("int").alias("bucket"),
            shard_of(F.col("doc_id"), equal_shards(n_shards)).cast("int").alias("shard"),
            (shard_of(F.col("doc_id"), equal_shards(grown)) if grown else F.lit(None)).cast("int").alias("grown_shard"),
        ),
        "cells",
    )
    # At most n_shards << BUCKET_BITS rows.
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.groupBy("shard", "bucket").agg(F.sum("n").alias("rows")).select("shard", "bucket", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("order", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    first = cells.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(starts), ["shard", "bucket"])
    runs = written(first.select("doc_id", "size", "text_crc32", "shard", "grown_shard", "n", (F.col("before") + F.col("start")).alias("slot")), "runs")

    few = runs.filter(F.col("n") <= UNFOLD)
    many = runs.filter(F.col("n") > UNFOLD).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / UNFOLD))))
    many = many.withColumns({"slot": F.col("slot") + F.col("part") * UNFOLD, "n": F.least(F.lit(UNFOLD), F.col("n") - F.col("part") * UNFOLD)}).drop("part").hint("rebalance")
    unfolded = few.unionByName(many).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return unfolded.select(F.col("doc_id").alias(id_column), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("slot") + F.col("i")).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, folder: str, n_shards: int, files_per_shard: int = 1, id_column: str = "doc_id") -> None:
    """Write the rows of `docs`, all columns, as Parquet below folder/shard=N.

    A shard is dealt to `files_per_shard` tasks by turns, so neither a hot shard nor a hot id is one task's.
    """
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(files_per_shard))
    dealt = docs.withColumn("shard", shard_of(F.col(id_column), equal_shards(n_shards)).cast("int")).repartition(n_shards * files_per_shard, "shard", turn)
    dealt.write.partitionBy("shard").parquet(folder)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents"), 16, 17)


def _oracle() -> str:
    def descend(name: str, n: int) -> str:
        nodes = ", ".join(f"('{parent}', '{child}', {weight})" for parent, row in equal_shards(n).items() for child, weight in row)
        found = f"{name}0 AS (SELECT doc_id, k, '' AS node FROM ids)"
        for level in range(3):
            found += f""",
{name}{level + 1} AS (SELECT doc_id, k, arg_max(c.child, {{'d': ln((CAST('0x' || substr(md5(c.child || ':' || k), 1, 13) AS BIGINT) + 1) / 4503599627370496.0) / c.weight, 'c': c.child}}) AS node
  FROM {name}{level} JOIN (VALUES {nodes}) AS c(parent, child, weight) ON c.parent = node GROUP BY doc_id, k)"""
        return found

    return f"""
WITH crc AS MATERIALIZED ({CRC32.TABLE}),
ids AS (SELECT DISTINCT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents),
{descend("now", 16)},
{descend("grown", 17)},
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, CAST(octet_length(encode(t)) + 1 AS BIGINT) AS size, {CRC32.of("t")} AS text_crc32 FROM d, crc),
h AS (SELECT m.*, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':' || text_crc32), 1, 15) AS BIGINT) AS o FROM m)
SELECT h.doc_id, size, text_crc32, 'key' AS law, CAST(n.node AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY n.node ORDER BY o, h.doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(g.node AS INTEGER) AS grown_shard
FROM h JOIN now3 n ON h.doc_id IS NOT DISTINCT FROM n.doc_id JOIN grown3 g ON h.doc_id IS NOT DISTINCT FROM g.doc_id
"""


QUERIES = {"op11_sharding": op11_sharding}
ORACLES = {"op11_sharding": _oracle()}
