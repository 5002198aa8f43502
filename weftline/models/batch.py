"""Batches of scored rows with a status each, tallied and checked in the pass that writes them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, functions as F

from weftline.session import written

STATUSES = ("processed", "skipped_existing", "missing", "failed")


def batch(targets: DataFrame, entities: DataFrame, existing: DataFrame, key: str, score: Callable[[DataFrame], DataFrame], force: bool = False, invariants: dict[str, Column] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(rows, tallies): each target once with its status, and how many there are of each status.

    score(entities of the targets) gives each a row with `error`, null where it succeeded. Targets
    that have a result are skipped unless `force`, those without an entity are missing. Results are
    columns of the row, null but for processed ones. `invariants` are conditions on processed
    rows; a row that breaks one (or for which it is null) fails with the invariant's name, and tallies
    count it under that name. Everything is counted while the rows are written: no second scan.
    """
    wanted = targets.select(key).filter(F.col(key).isNotNull()).distinct()
    known = existing.select(key).distinct().withColumn("__known", F.lit(True))
    todo = wanted if force else wanted.join(known, key, "left_anti")
    done = score(entities.join(todo, key, "left_semi"))
    broken = F.coalesce(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in (invariants or {}).items()], F.lit(None).cast("string"))
    done = done.withColumn("__broken", F.when(F.col("error").isNull(), broken)).withColumn("error", F.coalesce("error", F.concat(F.lit("breaks "), "__broken")))
    rest = [c for c in done.columns if c not in (key, "error", "__broken")]
    fine = F.col("error").isNull()
    done = done.select(key, *(F.when(fine, F.col(c)).alias(c) for c in rest), "error", "__broken", F.lit(True).alias("__tried"))
    rows = wanted.join(known, key, "left").join(done, key, "left")
    status = F.when(F.col("__tried") & fine, "processed").when(F.col("__tried"), "failed").when(F.col("__known") & F.lit(not force), "skipped_existing").otherwise("missing")
    seen = Observation("batch")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES] + [F.count_if(F.col("__broken") == name).alias(name) for name in invariants or {}]
    whole = written(rows.withColumn("status", status).observe(seen, *counts).drop("__known", "__tried", "__broken"), "batch")
    return whole.select(key, "status", "error", *rest), dict(seen.get)


def in_one_of(all_of: Column, covered: Column, missing: Column) -> Column:
    """Whether each index of all_of is in exactly one of covered and missing, and these hold no other and none twice."""
    both = F.concat(covered, missing)
    return (F.size(both) == F.size(F.array_distinct(all_of))) & (F.array_sort(both) == F.array_sort(F.array_distinct(all_of)))
