"""Fuzzy line dedup across a corpus.

Lines are read and their shingles hashed with numpy inside tasks (a form with DataFrame functions
alone took 1,387 CPU seconds a GB); Spark does the grouping, the joins and the union-find.

Lines are compared in lower case with runs of white space as one space. Of each different line the
character shingles are hashed once; the least hash in each of BANDS * ROWS classes is its signature
(an empty class borrows from the next one that is not). Lines that agree in a band are held against
each other, by way of leaders, by exact Jaccard similarity of their shingle sets, and union-find
joins what is linked. The first line of each component, by (doc_id, text, place), stays; the
others go. At a similarity of 0.8 a pair shares a band with a probability of 0.995, and above that
more. A repeated line is sent once for each task's stretch of SEEN lines, however frequent it is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm import utf8
from weftline.llm.links import PARITY, bucket_pairs, leader_links, parities, sketch
from weftline.session import forget, table, written

SHINGLE = 5
BANDS, ROWS = 10, 4
SIMILARITY = 0.8
#: Different lines that a task remembers at a time.
SEEN = 100_000
#: Numbers that choose texts are broadcast up to this many (16 MB), else joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Characters of lines that are hashed together.
STRETCH = 1 << 16
#: Classes, of BANDS * ROWS, that a line fills if it has a sketch.
FILLED = 28


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def line_id(line: bytes) -> bytes:
    return hashlib.md5(line, usedforsecurity=False).digest()


def signatures(lines: list[str], size: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each line the key of each band, a sketch, whether it has a shingle at all, and whether it fills FILLED classes.

    Few shingles fill few classes, and their sketches would say little.
    """
    n, slots = len(lines), bands * rows
    least = np.full((n, slots), 2**64 - 1, np.uint64)
    first = 0
    while first < n:  # some lines at a time, so that arrays stay small
        last, total = first, 0
        while last < n and (last == first or total + len(lines[last]) <= STRETCH):
            total += len(lines[last])
            last += 1
        part = lines[first:last]
        codes = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
        line = np.repeat(np.arange(len(part)), [len(x) for x in part])
        if len(codes) >= size:
            hashes = utf8.grams(codes.astype(np.uint64), size)
            place = (hashes >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)
            place += line[: len(hashes)].astype(np.uint64) * np.uint64(slots)
            inside = line[: len(hashes)] == line[size - 1 :]
            np.minimum.at(least[first:last].reshape(-1), place[inside].astype(np.intp), hashes[inside])
        first = last
    filled = (least != 2**64 - 1).sum(1)
    for _ in range(2):  # an empty class takes from the next, the last from the first
        for k in range(slots - 1, -1, -1):
            least[:, k] = np.where(least[:, k] == 2**64 - 1, least[:, (k + 1) % slots], least[:, k])
    own = sketch(least)
    least = least.reshape(n, bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands))
    for j in range(rows):
        key = utf8.mix(key * np.uint64(utf8.BASE) + least[:, :, j])
    return key.view(np.int64), own, filled > 0, filled >= FILLED


def lines_of(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, row (md5 of the whole text), place, id (md5), keys, s0 and s1 for each line that is not blank.

    `keys` has the band keys; it is null for lines without a shingle, which can only be equal, not
    alike, and where the task has sent the line's keys before. s0 and s1 are its sketch, null for short lines.
    """

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for part in utf8.slices(batch.column("text")):
                of, places, ids, new, texts = [], [], [], [], []
                for i in range(len(part)):
                    for place, line in enumerate(part.raw(i).decode().split("\n")):
                        line = normal(line)
                        if not line:
                            continue
                        name = line_id(line.encode())
                        if name not in seen:
                            seen.add(name)
                            new.append(len(ids))
                            texts.append(line)
                        of.append(part.first + i)
                        places.append(place)
                        ids.append(name)
                    if len(seen) > SEEN:
                        seen.clear()
                keys, sketches, known, long = signatures(texts, size, bands, rows)
                new = np.asarray(new, np.int64)
                length = np.zeros(len(ids) + 1, np.int32)
                length[new[known] + 1] = bands
                none = np.ones(len(ids), bool)
                none[new[known]] = False
                found = pa.ListArray.from_arrays(pa.array(np.cumsum(length, dtype=np.int32)), pa.array(keys[known].ravel()), mask=pa.array(none))
                whole = np.zeros((2, len(ids)), np.int64)
                whole[:, new] = sketches.T
                without = np.ones(len(ids), bool)
                without[new[long]] = False
                halves = [pa.array(x, mask=without) for x in whole]
                own = pa.array(of, pa.int64())
                columns = [batch.column("doc_id").take(own), batch.column("row").take(own), pa.array(places, pa.int32()), pa.array(ids, pa.binary()), found, *halves]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "place", "id", "keys", "s0", "s1"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", _row().alias("row"), "text")
    return named.mapInArrow(run, f"doc_id {kind}, row binary, place int, id binary, keys array<bigint>, s0 bigint, s1 bigint")


def _row():
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def _number(of: str):
    """A short name of a line for the search: the first 8 bytes of its id (different lines may share it)."""
    return F.conv(F.hex(F.substring(of, 1, 8)), 16, -10).cast("bigint")


def line_texts(docs: DataFrame) -> DataFrame:
    """number, id and text of each line that is not blank, once for each task's stretch."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for part in utf8.slices(batch.column("text")):
                numbers, ids, texts = [], [], []
                for i in range(len(part)):
                    for line in part.raw(i).decode().split("\n"):
                        line = normal(line)
                        if line and (name := line_id(line.encode())) not in seen:
                            seen.add(name)
                            numbers.append(int.from_bytes(name[:8], "big", signed=True))
                            ids.append(name)
                            texts.append(line)
                    if len(seen) > SEEN:
                        seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["number", "id", "line"])

    return docs.select("text").mapInArrow(run, "number bigint, id binary, line string")


def bounds(lines: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different shingles each line has, and their parities."""
    whole, odd = np.zeros(len(lines), np.int64), np.zeros((len(lines), len(PARITY)), np.int64)
    first = 0
    while first < len(lines):
        last, total = first, 0
        while last < len(lines) and (last == first or total + len(lines[last]) <= STRETCH):
            total += len(lines[last])
            last += 1
        part = lines[first:last]
        codes = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
        if len(codes) >= size:
            line = np.repeat(np.arange(len(part)), [len(x) for x in part])
            inside = line[: len(codes) - size + 1] == line[size - 1 :]
            hashes, line = utf8.grams(codes.astype(np.uint64), size)[inside], line[: len(inside)][inside]
            order = np.lexsort((hashes, line))
            hashes, line = hashes[order], line[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])
            hashes, line = hashes[new], line[new]
            whole[first:last] = np.bincount(line, minlength=len(part))
            classes = (hashes >> np.uint64(32)) * np.uint64(64 * len(PARITY)) >> np.uint64(32)
            odd[first:last] = parities(classes.astype(np.int64), line, len(part))
        first = last
    return whole, odd


def bounded(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(node, id, line) with the size and the parities of the line's shingle set: whole and PARITY."""

    def run(batches):
        for batch in batches:
            whole, odd = bounds(batch.column("line").to_pylist(), size)
            columns = [*batch.columns, pa.array(whole), *(pa.array(np.ascontiguousarray(x)) for x in odd.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "id", "line", "whole", *PARITY])

    return texts.select("node", "id", "line").mapInArrow(run, f"node bigint, id binary, line string, whole bigint, {', '.join(f'{p} bigint' for p in PARITY)}")


def alike(lines: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY):
    """The check for leader_links: exact Jaccard similarity of two lines' shingle sets. `lines` has node and line."""

    def compare(batches):
        held: tuple[str, set] = ("", set())
        for batch in batches:
            same = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
                if held[0] != x:
                    held = x, {x[k : k + size] for k in range(len(x) - size + 1)}
                other = {y[k : k + size] for k in range(len(y) - size + 1)}
                shared = len(held[1] & other)
                same[i] = shared >= similarity * (len(held[1]) + len(other) - shared)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(same))

    def verify(pairs: DataFrame) -> DataFrame:
        left, right = (lines.select(F.col("node").alias(one), F.col("line").alias(x)) for one, x in (("a", "x"), ("b", "y")))
        return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint")

    return verify


def removed_lines(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, row, places) of the lines that go; documents that lose none are absent.

    Ids and keys are written; texts are read again from `docs` for lines that share a band.
    """
    lines = written(lines_of(docs, size), "lines")
    keyed = lines.filter("keys is not null").withColumn("number", _number("id"))
    # Dealt once for both sides of the join.
    dealt = keyed.select("number", F.explode("keys").alias("key")).repartition("key")
    shared = dealt.groupBy("key").agg(F.min("number").alias("least"), F.max("number").alias("most")).filter("least <> most").select("key")
    buckets = written(dealt.join(shared, "key", "left_semi").distinct(), "buckets")
    # Each line has a node of its own, also where two share the short number.
    nodes = keyed.select("id", "number", "s0", "s1").dropDuplicates(["id"])
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = written(buckets.join(nodes, "number").select("key", F.col("node").alias("id"), "s0", "s1"), "members")
    forget(buckets)
    pairs, large = bucket_pairs(members, similarity)
    forget(members)
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large.select("id")).distinct()
    named = written(nodes.select("node", "id", "number").join(asked, "node"), "named")
    forget(nodes)
    wanted = named.select("number").distinct()
    wanted = F.broadcast(wanted) if named.count() <= BROADCAST_IDS else wanted.hint("shuffle_hash")
    texts = line_texts(docs).join(wanted, "number", "left_semi").dropDuplicates(["number", "id"])
    texts = texts.join(named.select("id", "node"), "id").select("node", "id", "line")
    lines_found = written(bounded(texts, size), "candidates")
    forget(named)
    reach = lines_found.select(F.col("node").alias("id"), "whole", *PARITY)
    _, roots = leader_links(large, alike(lines_found, size, similarity), similarity, reach, pairs)
    names = lines_found.select("id", "node")
    joined = names.join(roots.withColumnRenamed("id", "node"), "node").select("id", "root")
    same = written(joined.join(names.select(F.col("node").alias("root"), F.col("id").alias("kind")), "root").select("id", "kind"), "same")
    forget(pairs, large, lines_found)
    kinds = lines.select("doc_id", "row", "place", "id").join(same, "id", "left").withColumn("kind", F.coalesce("kind", "id"))
    first = F.struct("doc_id", "row", "place")
    kept = kinds.groupBy("kind").agg(F.min(first).alias("first"), F.count("*").alias("n")).filter("n > 1").select("kind", "first")
    lost = kinds.join(kept, "kind").filter(~first.eqNullSafe(F.col("first")))
    found = written(lost.groupBy("doc_id", "row").agg(F.collect_set("place").alias("places")), "lost")
    forget(lines, same)
    return found


def _without(text: pd.Series, places: pd.Series) -> pd.Series:
    """The text less its lines at `places`."""
    out = []
    for whole, at in zip(text, places):
        if at is not None and whole is not None:
            gone = set(at.tolist())
            whole = "\n".join(x for i, x in enumerate(whole.split("\n")) if i not in gone)
        out.append(whole)
    return pd.Series(out, dtype=object)


def line_dedup(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with `text` less the lines that go, plus n_lines and n_removed (columns of these names are replaced).

    Blank lines stay and match nothing; lines of fewer characters than a shingle match only equal
    ones. A null text stays null with no lines; an empty one has one blank line. Rows that repeat a
    doc_id and text are one document and lose the same lines; rows of one doc_id and different texts
    are documents of their own, in the order of md5(text). Rows without a doc_id come first. All
    lines of a text are compared, however long. Other columns stay. An empty table gives an empty table.
    """
    lost = removed_lines(docs.select("doc_id", "text"), size, similarity).withColumnsRenamed({"doc_id": "__doc", "row": "__of", "places": "__places"})
    joined = docs.withColumn("__row", _row()).join(lost, (F.col("__row") == F.col("__of")) & F.col("doc_id").eqNullSafe(F.col("__doc")), "left")
    changed = F.when(F.col("__places").isNull(), F.col("text")).otherwise(F.pandas_udf(_without, "string")("text", "__places"))
    counts = {"n_lines": F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size("__places"), F.lit(0)).cast("long")}
    found = joined.withColumns({"__text": changed, **counts}).withColumn("text", F.col("__text"))
    names = [*docs.columns, *(c for c in ("n_lines", "n_removed") if c not in docs.columns)]
    return found.withColumns({c: F.greatest(c, F.lit(0).cast("long")) for c in counts}).select(names)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLES: dict[str, str] = {}
