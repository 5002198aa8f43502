"""Stored tables: changes of single partitions, and whole tables that are swapped once they are written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.session import forget, written


def store(df: DataFrame, path: str, by: list[str]) -> None:
    """df as a new table in partitions of the columns `by`, one file a partition and task."""
    df.repartition(*by).write.partitionBy(*by).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Put the partitions that df has rows of in place of the stored ones; the files of all others stay as they are."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def change(spark: SparkSession, path: str, by: list[str], changes: DataFrame, apply) -> DataFrame:
    """apply(stored rows, changes) on the partitions that `changes` has rows of, written back; the partitions touched.

    Other partitions are neither read nor written. The new rows are written aside before the first
    stored one goes, so a change that fails leaves the table as it was. A partition that apply
    empties is left with its old rows: use `drop_partitions`. The list of touched partitions is
    small: it prunes the scan.
    """
    touched = written(changes.select(*by).distinct(), "touched")
    stored = spark.read.parquet(path)
    kinds = {c: stored.schema[c].dataType for c in by}
    mine = stored.join(F.broadcast(touched.select(*(F.col(c).cast(kinds[c]).alias(c) for c in by))), by, "left_semi")
    after = written(apply(mine, changes).select(stored.columns), "after")
    replace_partitions(after, path, by)
    forget(after)
    return touched


def drop_partitions(spark: SparkSession, path: str, partitions: DataFrame) -> int:
    """Delete partitions (their columns in the order of the folders); the number deleted. One call of the file system each."""
    hadoop, conf, gone = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for row in partitions.distinct().toLocalIterator():
        folder = hadoop.Path("/".join([path, *(f"{c}={'__HIVE_DEFAULT_PARTITION__' if row[c] is None else row[c]}" for c in partitions.columns)]))
        gone += folder.getFileSystem(conf).delete(folder, True)
    return gone


def _versions(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Names of the versions below `path`, oldest first: those that were written to the end, and the others."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(x.getPath().getName() for x in system.listStatus(root)) if system.exists(root) else []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    whole = [n for n in found if n.startswith("version-") and system.exists(hadoop.Path(f"{path}/{n}/_SUCCESS"))]
    return whole, [n for n in found if n.startswith("version-") and n not in whole]


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last version that `swap` has written to the end."""
    whole, _ = _versions(spark, path)
    if not whole:
        raise ValueError(f"no version is stored at {path}")
    return spark.read.parquet(f"{path}/{whole[-1]}")


def swap(df: DataFrame, path: str, keep: int = 2) -> None:
    """Write df as the next version of the table at `path`; it takes the old one's place when it is whole.

    df may read the version in place. Spark marks a version when its job commits, and `current` takes
    marked ones alone: if the write fails, or its job is lost, the old version stays readable. `keep`
    whole versions stay, for readers that began before; older and cut ones are deleted. There is
    one writer at a time.
    """
    spark = df.sparkSession
    whole, cut = _versions(spark, path)
    number = max((int(n.split("-")[1]) for n in (*whole, *cut)), default=0) + 1
    df.write.parquet(f"{path}/version-{number:08d}-{uuid.uuid4().hex[:8]}")
    for stale in (*cut, *whole[: max(0, len(whole) + 1 - keep)]):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{stale}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
