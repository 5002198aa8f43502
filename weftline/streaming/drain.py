"""Drain-the-queue streams: all that is there now, then stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.session import shared_dir


def drain(spark: SparkSession, path: str, transform, run: str | None = None, failed=None) -> DataFrame:
    """Reads what has arrived at `path` (a folder or a glob of Parquet) as a stream, appends transform(rows) and stops.

    `run` is a folder of the caller's choice for offsets and results: a later call with the same one
    goes on where the last ended. Without it every call starts anew. `failed`, a condition on the
    transformed rows, adds a column `status` (done or failed): such rows are kept, not retried.
    """
    base = run or shared_dir(spark)
    schema = spark.read.parquet(path).schema
    rows = transform(spark.readStream.schema(schema).parquet(path))
    if failed is not None:
        rows = rows.withColumn("status", F.when(F.coalesce(failed, F.lit(True)), "failed").otherwise("done"))
    query = rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out")
