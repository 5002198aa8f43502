"""Connected components as joins in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.session import forget, written


def components(links: DataFrame) -> DataFrame:
    """(id, root): the least id of each linked item's component; links: (a, b).

    Each round takes the least root among the neighbours and then that root's root, so rounds grow
    with the logarithm of a component's width. Every round is a written table.
    """
    both = written(links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other"))).distinct(), "edges")
    roots = written(both.groupBy("id").agg(F.least("id", F.min("other")).alias("root"), F.lit(True).alias("moved")), "roots")
    while not roots.filter("moved").isEmpty():
        near = both.join(roots.select(F.col("id").alias("other"), F.col("root").alias("near")), "other").groupBy("id").agg(F.min("near").alias("near"))
        lower = roots.join(near, "id").select("id", F.least("root", "near").alias("next"), F.col("root").alias("was"))
        up = lower.select(F.col("id").alias("next"), F.col("next").alias("top"))
        after = written(lower.join(up, "next").select("id", F.col("top").alias("root"), (F.col("top") != F.col("was")).alias("moved")), "roots")
        forget(roots)
        roots = after
    forget(both)
    return roots.select("id", "root")
