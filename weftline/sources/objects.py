"""Texts as objects of a store: one object a row, listed and read back by Spark's binary source."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.functions import text as T

#: Objects above this size are listed, not read.
MOST_BYTES = 64 << 20
#: A task passes on its objects whenever they make up this much.
BATCH_BYTES = 8 << 20
# Kinds of file by extension, by MIME type (first match), by leading bytes; kinds of element that are text.
EXTENSIONS = ("pdf", "docx", "html", "htm", "txt")
MIME = {"pdf": "pdf", "word": "docx", "docx": "docx", "html": "html", "htm": "html", "text/plain": "txt"}
LEADING = {"25504446": "pdf", "504B0304": "docx", "3C21444F43545950452068746D6C": "html", "3C68746D6C": "html"}
KEPT_KINDS = ("Title", "NarrativeText", "ListItem", "Table", "TableChunk", "Text")


def put_texts(rows: DataFrame, folder: str, path_column: str = "path", text_column: str = "text") -> DataFrame:
    """Write each row's text as the object `path` below `folder`; (path, n_bytes, stored) of all rows.

    A null text or blank path stores nothing (stored is false). Of rows with one path the last
    writer's text stays. An object appears whole: it is written aside and renamed, so a task that is
    tried again, or lost, never leaves a cut one. `folder` is a local path or a URI that Arrow opens.
    """

    def run(batches):
        system, root = _store(folder)
        made: set[str] = set()
        for batch in batches:
            sizes, there = [], []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                there.append(bool(path and path.strip() and text is not None))
                data = (text or "").encode()
                sizes.append(len(data) if there[-1] else 0)
                if there[-1]:
                    target = f"{root}/{path.strip('/')}"
                    parent = target.rpartition("/")[0]
                    if parent not in made:
                        system.create_dir(parent, recursive=True)
                        made.add(parent)
                    aside = f"{parent}/.{uuid.uuid4().hex}"
                    with system.open_output_stream(aside) as out:
                        out.write(data)
                    system.move(aside, target)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64()), pa.array(there)], names=["path", "n_bytes", "stored"])

    return rows.select(F.col(path_column).alias("path"), F.col(text_column).alias("text")).mapInArrow(run, "path string, n_bytes bigint, stored boolean")


def _store(folder: str):
    """Arrow's file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder.removeprefix('file:'))}")


def _named(spark: SparkSession, folder: str, wanted: DataFrame, pattern: str, most_bytes: int | None, content: bool) -> DataFrame:
    """(path, n_bytes, content) of wanted objects, each looked up by its name in a task, so that no one lists the folder."""
    plain = ~F.col("path").rlike(r"^$|^/|/$|//|(^|/)[._]")  # what a listing gives: no empty, dotted or hidden name
    name = F.substring_index("path", "/", -1)
    matches = name.rlike(f"^(?:{spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()})$")
    paths = wanted.select("path").filter("path IS NOT NULL").filter(plain & matches).distinct()

    def run(batches):
        system, root = _store(folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                held, size = [], 0
                paths = batch.column("path").slice(at, 512).to_pylist()
                for path, info in zip(paths, system.get_file_info([f"{root}/{p}" for p in paths])):
                    if not info.is_file or (most_bytes is not None and info.size > most_bytes):
                        continue
                    data = None
                    if content:
                        with system.open_input_stream(info.path) as stream:
                            data = stream.read()
                    held.append((path, info.size, data))
                    size += len(data or b"")
                    if size > BATCH_BYTES:
                        yield _rows(held)
                        held, size = [], 0
                if held:
                    yield _rows(held)

    return paths.mapInArrow(run, "path string, n_bytes bigint, content binary")


def _rows(held: list[tuple]) -> pa.RecordBatch:
    path, size, data = zip(*held)
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(size, pa.int64()), pa.array(data, pa.binary())], names=["path", "n_bytes", "content"])


def listed(spark: SparkSession, folder: str, pattern: str = "*", wanted: DataFrame | None = None) -> DataFrame:
    """(path, n_bytes) of the objects below `folder` whose name matches, of those in `wanted` (path) alone if given; no content is read.

    Without `wanted` Spark's source lists the folder, whose names are then at the driver.
    """
    if wanted is not None:
        return _named(spark, folder, wanted, pattern, None, False).select("path", "n_bytes")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return found.select(_below(folder).alias("path"), F.col("length").alias("n_bytes"))


def _below(folder: str) -> Column:
    """A path below the folder, whatever scheme or slashes Spark gives it."""
    tail = folder.rstrip("/").rpartition("://")[2].removeprefix("file:").strip("/")
    return F.substring_index(F.col("path"), tail + "/", -1)


def get_texts(spark: SparkSession, folder: str, wanted: DataFrame | None = None, pattern: str = "*", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, text) of the objects below `folder`, of those whose path is in `wanted` (path) alone if given.

    Missing objects give no row. The pattern on names and the bound on sizes reach the source, so
    that other objects are not opened; bytes that are no UTF-8 become replacement characters. Wanted
    objects are opened by their names in the tasks; without `wanted` the driver lists the folder.
    """
    text = F.make_valid_utf8(F.col("content").cast("string")).alias("text")
    if wanted is not None:
        return _named(spark, folder, wanted, pattern, most_bytes, True).select("path", text)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).filter(F.col("length") <= most_bytes)
    return found.select(_below(folder).alias("path"), text)


def detected_type(path: Column, mime: Column, content: Column) -> Column:
    """Extension of the name, else the kind of the MIME type, else that of the leading bytes; `unknown` without any."""
    name = F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1)
    extension = F.nullif(F.lower(F.regexp_extract(name, r"[^.]\.([A-Za-z0-9]+)$", 1)), F.lit(""))
    kind = F.coalesce(*[F.when(F.lower(mime).contains(part), F.lit(kind)) for part, kind in MIME.items()])
    head = F.hex(F.substring(content, 1, 16))
    lead = F.coalesce(*[F.when(head.startswith(start.upper()), F.lit(kind)) for start, kind in LEADING.items()])
    return F.coalesce(extension, kind, lead, F.lit("unknown"))


def kept_elements(elements: DataFrame, owner: list[str]) -> DataFrame:
    """Elements (owner, place, kind, text) that are text and not noise, cleaned, each text of an owner once: its first.

    Texts that differ in case or spacing alone are one; they are known by md5, so that they are shuffled and sorted once, not twice.
    """
    good = elements.filter(F.col("kind").isin(*KEPT_KINDS)).withColumn("text", F.trim("text"))
    # What is not noisy has letters, so no cleaned text is empty.
    good = good.filter(~T.noisy(F.col("text"))).withColumn("text", T.clean_lines(F.col("text")))
    key = F.md5(F.lower(F.regexp_replace("text", r"\s+", " ")))
    first = good.groupBy(*owner, key.alias("key")).agg(F.min(F.struct("place", "kind", "text")).alias("x"))
    return first.select(*owner, "x.place", "x.kind", "x.text")
