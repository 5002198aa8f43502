"""Session helpers: input tables, shipping the package, and the shared work folder."""

from __future__ import annotations

import gc
import io
import os
import tempfile
import time
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; `sf_dir` may be any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the executors' Python workers once per session (as --py-files would)."""
    context = spark.sparkContext
    if any(str(x).startswith("weftline-package-") for x in context._python_includes):
        return spark
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, f"weftline/{path.relative_to(root)}")
    target = os.path.join(tempfile.mkdtemp(prefix="weftline"), f"weftline-package-{uuid.uuid4().hex[:8]}.zip")
    Path(target).write_bytes(data.getvalue())
    context.addPyFile(target)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent a folder of this machine is used, in local mode only: on a
    cluster it would be another folder for each executor, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="weftline-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/weftline/{uuid.uuid4().hex}"


#: Seconds between two releases.
RELEASE_S = 2.0
_released = [0.0]


def written(df: DataFrame, name: str = "step", small: bool = False) -> DataFrame:
    """Run `df` once into the shared folder and go on from the written table, which cuts the lineage.

    A lost executor costs at most the step in progress. Tables stay until `forget` or until the
    folder is cleared. The step's own shuffle files go as it ends; those of other actions before it
    are released, unless it is `small`. Its rows reach Python about ARROW_BYTES at a time.
    """
    spark = df.sparkSession
    if not small:
        release(spark)  # now that the caller has let go of the last step's plan
    path = f"{shared_dir(spark)}/{name}"
    with _settings(spark, {CLEANUP: "true", ARROW_LIMIT: str(ARROW_BYTES)}):
        df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._weftline_folder = path
    return back


#: Whether Spark deletes the shuffle files of an SQL execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch (64 MB by Spark's default, and each running task holds one in the JVM and one in Python).
ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_BYTES = 4 << 20


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    """These settings hold for the executions within; the session's own come back after."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps.

    It does so when the driver's JVM has collected their plans, which may otherwise be long after
    a job of many steps has filled the executors' disks.
    """
    if time.monotonic() - _released[0] > RELEASE_S:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _released[0] = time.monotonic()


def forget(*tables: DataFrame) -> None:
    """Delete tables that `written` made and that nothing reads any more."""
    for one in tables:
        spark = one.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(one._weftline_folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
