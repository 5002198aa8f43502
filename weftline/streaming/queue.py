"""A queue of work as a stream: bounded batches, failures kept for a later call, no row doubled.

The queue is a folder of Parquet files of a bounded number of rows. Every batch is some of these
files; its results go to a folder named by the batch's id, which a repeated batch writes anew. So a
job that is lost between writing a batch and noting it as done leaves nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.session import shared_dir

#: Rows of one file of a queue, and so of a batch of one file.
BATCH_ROWS = 200
#: Longest error text kept.
ERROR_CHARS = 500


def enqueue(rows: DataFrame, folder: str, batch_rows: int = BATCH_ROWS) -> None:
    """Put rows at the end of the queue in `folder`, in files of at most `batch_rows` rows."""
    rows.write.mode("append").option("maxRecordsPerFile", batch_rows).parquet(folder)


def attempted(rows: DataFrame, work: Callable[[DataFrame], DataFrame], attempt: int) -> DataFrame:
    """work(rows with their number of attempt), which adds `error` (null: done), and the status that follows."""
    done = work(rows.withColumn("attempt", F.lit(attempt)))
    return done.withColumns({"attempt": F.lit(attempt), "error": F.left(F.nullif(F.trim("error"), F.lit("")), F.lit(ERROR_CHARS)), "status": F.when(F.coalesce(F.trim("error"), F.lit("")) == "", "success").otherwise("failed")})


def drain_queue(spark: SparkSession, folder: str, key: str, work: Callable[[DataFrame], DataFrame], run: str | None = None, files_per_batch: int = 1, attempts: int = 3, retry: bool = True) -> str:
    """Work off what has come into the queue since the last call with the same `run` folder, then what had failed before it; the run folder.

    work(rows) gives a row for each, with a column `error`; a row of a repeated key counts each time
    it is put in. A row is tried `attempts` times at most over all calls, once a call. Without `run`
    a new folder is taken. See `outcome`.
    """
    run = run or f"{shared_dir(spark)}/queue"
    failed_before = pending_again(spark, run, key, attempts) if retry else None
    schema = spark.read.parquet(folder).schema

    def one(batch: DataFrame, number: int) -> None:
        attempted(batch, work, 1).write.mode("overwrite").parquet(f"{run}/results/turn=first-{number:09d}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{run}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    for attempt, keys in failed_before or ():
        # The turn is named by its rows, so that a call repeated after a loss replaces it. Work gets the rows of the queue.
        rows = spark.read.schema(schema).parquet(folder).join(keys.select(key), key, "left_semi")
        attempted(rows, work, attempt).write.mode("overwrite").parquet(f"{run}/results/turn=again-{attempt:03d}-{_mark(keys, key)}")
    return run


def _mark(rows: DataFrame, key: str) -> str:
    """A name for a set of rows that does not depend on their order."""
    total = rows.agg(F.sum(F.xxhash64(key).cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
    return f"{total['n']}-{total['s']}"


def _results(spark: SparkSession, run: str) -> DataFrame | None:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{run}/results")
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return None
    return spark.read.parquet(f"{run}/results").drop("turn")


def pending_again(spark: SparkSession, run: str, key: str, attempts: int) -> list[tuple[int, DataFrame]]:
    """(next attempt, rows) of what has failed in earlier calls and may be tried again."""
    if _results(spark, run) is None:
        return []
    left = outcome(spark, run, key).filter((F.col("status") == "failed") & (F.col("attempt") < attempts))
    return [(r["attempt"] + 1, left.filter(F.col("attempt") == r["attempt"])) for r in left.select("attempt").distinct().collect()]


def outcome(spark: SparkSession, run: str, key: str) -> DataFrame:
    """One row for each key: that of its last attempt (of several, one that succeeded), with status, error and attempt."""
    found = _results(spark, run)
    if found is None:
        raise ValueError(f"nothing has been worked off in {run}")
    rest = [c for c in found.columns if c not in (key, "attempt")]
    last = found.groupBy(key).agg(F.max_by(F.struct("attempt", *rest), F.struct("attempt", "status")).alias("x"))
    return last.select(key, *(F.col(f"x.{c}").alias(c) for c in ("attempt", *rest)))


def tallies(rows: DataFrame) -> DataFrame:
    """(processed, done, failed) over the rows of an outcome."""
    return rows.agg(F.count("*").alias("processed"), F.count_if(F.col("status") == "success").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"))


def tried(f: Callable, into: str, kind: str) -> Callable[[DataFrame, str], DataFrame]:
    """A work function around f(value) of one column, which may raise: adds `into` or the error of the row.

    One bad row does not fail the others. f is called in Arrow batches in Python workers.
    """
    def run(column: pd.Series) -> pd.DataFrame:
        values, errors = [], []
        for x in column:
            try:
                values.append(f(x))
                errors.append(None)
            except Exception as e:  # the row's own failure is its result
                values.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        return pd.DataFrame({"value": pd.Series(values, dtype=object), "error": pd.Series(errors, dtype=object)})

    guarded = F.pandas_udf(run, f"value {kind}, error string")

    def work(rows: DataFrame, column: str) -> DataFrame:
        return rows.withColumn("__x", guarded(column)).withColumns({into: F.col("__x.value"), "error": F.col("__x.error")}).drop("__x")

    return work


def failed_if(condition: Column, error: Column | str) -> Column:
    """An `error` column for rules that SQL can say: a missing condition fails too."""
    return F.when(F.coalesce(condition, F.lit(True)), error if isinstance(error, Column) else F.lit(error))
