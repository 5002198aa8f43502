"""Row selection, merging, ordering and changes of tables. A change gives the new table; nothing is updated in place."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window, functions as F


# ---- reading

def with_related(df: DataFrame, key: str, **related: tuple[DataFrame, str, Sequence[str]]) -> DataFrame:
    """df plus, for each name, the sorted list of rows of another table: name=(table, its key, columns, first of them the order).

    Rows without related ones have an empty list.
    """
    for name, (other, other_key, columns) in related.items():
        lists = other.groupBy(F.col(other_key).alias(key)).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        df = df.join(lists, key, "left")
        df = df.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return df


def page(df: DataFrame, by: str, limit: int, offset: int) -> DataFrame:
    """One page in order of `by`: 1 to 200 rows."""
    return df.orderBy(by).offset(max(0, offset)).limit(min(200, max(1, limit)))


def page_after(df: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The first `limit` rows whose keys come after those of a page's last row, in order of the keys (null: from the start).

    The keys together are unique and not null. The condition on the first key reaches the
    scan, so that on sorted files (see `sorted_files`) row groups and files before it are not read;
    nothing is skipped by counting.
    """
    if after is not None:
        later = F.lit(False)
        for i in reversed(range(len(keys))):
            later = (F.col(keys[i]) > F.lit(after[i])) | ((F.col(keys[i]) == F.lit(after[i])) & later)
        df = df.filter((F.col(keys[0]) >= F.lit(after[0])) & later)
    return df.orderBy(*keys).limit(limit)


def pages(df: DataFrame, keys: list[str], limit: int, ahead: int = 32) -> Iterator[list[Row]]:
    """A cursor: all rows in pages of at most `limit`, `ahead` pages at the driver at a time; each fetch seeks after the last key.

    It is for a reader who may stop; each fetch is a job. For all pages at once see `numbered_pages`.
    """
    after = None
    while found := page_after(df, keys, after, limit * ahead).collect():
        yield from (found[i : i + limit] for i in range(0, len(found), limit))
        if len(found) < limit * ahead:
            return
        after = tuple(found[-1][k] for k in keys)


def numbered_pages(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """df with `page`, from 0: the page of at most `limit` rows, in order of the keys, that `pages` gives each row in.

    df is a table of `sorted_files`, its keys together are unique and not null. Files are ordered by
    their least keys and counted, and each file's rows are numbered after those before it: no row
    leaves Spark, and no task orders more than a file.
    """
    placed = df.withColumn("__file", F.col("_metadata.file_path"))
    sizes = placed.groupBy("__file").agg(F.min(F.struct(*keys)).alias("__least"), F.count("*").alias("__n"))
    earlier = Window.orderBy("__least").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    sizes = sizes.select("__file", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__file").orderBy(*keys)) - 1
    return placed.join(F.broadcast(sizes), "__file").withColumn("page", F.floor(place / limit)).drop("__file", "__before")


def sorted_files(df: DataFrame, keys: list[str], path: str, n_files: int) -> DataFrame:
    """df written in ranges of its keys, each file sorted, and read back: what `page_after` seeks in."""
    df.repartitionByRange(n_files, *keys).sortWithinPartitions(*keys).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(df: DataFrame, **values) -> DataFrame:
    """The row whose columns have these values, at most one: the least of several by all columns."""
    for name, value in values.items():
        df = df.filter(F.col(name).eqNullSafe(F.lit(value)))
    return df.orderBy(*df.columns).limit(1)


def fetch(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is among `wanted` (one column); an empty list gives no row."""
    return df.join(wanted.select(F.col(wanted.columns[0]).alias(key)), key, "left_semi")


def ordered_fetch(scored: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Entities of a scored list in its order (`ordinal`); those that are missing drop out."""
    return scored.join(entities, key)


def pending(df: DataFrame, status: Column, first: Column, by: str, limit: int) -> DataFrame:
    """The next rows to work on: status pending or null, first part of a series, in order, at most `limit`."""
    return df.filter((F.lower(status) == "pending") | status.isNull()).filter(first).orderBy(by).limit(limit)


def split_known(wanted: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Each wanted value once (trimmed, lower case) and whether the other table has it."""
    key = F.lower(F.trim(F.col(column)))
    asked = wanted.select(key.alias(column)).filter(F.col(column) != "").distinct()
    there = known.select(key.alias(column)).distinct().withColumn("known", F.lit(True))
    return asked.join(there, column, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def cached_or(cached: DataFrame, wanted: DataFrame, keys: list[str], compute) -> DataFrame:
    """Cached rows of the wanted keys, and compute(wanted keys that have none), with the same columns."""
    have = cached.join(wanted.select(*keys).distinct(), keys, "left_semi")
    rest = wanted.select(*keys).distinct().join(cached, keys, "left_anti")
    return have.unionByName(compute(rest).select(cached.columns))


# ---- choosing rows

def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank; k <= 0 keeps all."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k) if k > 0 else ranked


def first_seen(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row, by order, of each key that is not blank; one combining aggregate instead of a window."""
    rest = [c for c in df.columns if c not in order]
    keyed = df.withColumn("__key", key).filter(F.length("__key") > 0)
    best = keyed.groupBy("__key").agg(F.min(F.struct(*order, *rest)).alias("row"))
    return best.select(*(F.col(f"row.{c}").alias(c) for c in df.columns))


def union_once(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of the tables, each key once: that of the earliest table, in it the least row."""
    placed = [t.withColumn("__turn", F.lit(i)) for i, t in enumerate(tables)]
    together = placed[0]
    for more in placed[1:]:
        together = together.unionByName(more)
    rest = [c for c in tables[0].columns if c != key]
    best = together.groupBy(key).agg(F.min(F.struct("__turn", *rest)).alias("row"))
    return best.select(key, *(F.col(f"row.{c}").alias(c) for c in rest))


def running_cap(df: DataFrame, group: list[str], order: list[str], size: Column, cap: int, each: int | None = None) -> DataFrame:
    """Adds `taken`: what each row may still use of its group's cap, in order, and at most `each`; rows that get nothing go."""
    used = F.least(size, F.lit(each)) if each is not None else size
    before = F.coalesce(F.sum(used).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("taken", F.greatest(F.lit(0), F.least(used, F.lit(cap) - before))).filter("taken > 0")


def batches(df: DataFrame, group: list[str], order: list[str], size: Column, limit: int) -> DataFrame:
    """(group, batch, places): consecutive rows packed until the limit; a larger row is alone, in its turn.

    One fold per group over its sizes: a group is one owner's list of contents.
    """
    row = F.struct(*order, size.cast("bigint").alias("__size"))
    lists = df.groupBy(*group).agg(F.sort_array(F.collect_list(row)).alias("__rows"))
    state = F.struct(F.lit(0).cast("int").alias("batch"), F.lit(0).cast("bigint").alias("used"), F.lit(0).cast("int").alias("n"), F.array().cast("array<int>").alias("of"))

    def step(s: Column, x: Column) -> Column:
        big = x["__size"] > limit
        new = (s["n"] > 0) & (big | (s["used"] + x["__size"] > limit))
        batch = s["batch"] + new.cast("int")
        # What follows an oversized row starts anew.
        return F.struct((batch + big.cast("int")).alias("batch"), F.when(big, F.lit(0).cast("bigint")).when(new, x["__size"]).otherwise(s["used"] + x["__size"]).alias("used"), F.when(big, 0).when(new, 1).otherwise(s["n"] + 1).alias("n"), F.concat(s["of"], F.array(batch)).alias("of"))

    folded = lists.withColumn("__of", F.aggregate("__rows", state, step)["of"])
    rows = folded.select(*group, F.explode(F.arrays_zip("__rows", "__of")).alias("x"))
    return rows.select(*group, *(F.col(f"x.__rows.{c}").alias(c) for c in order), F.col("x.__of").alias("batch"))


def by_turns(df: DataFrame, group: list[str], source: str, order: list[str], text: str, limit: int) -> DataFrame:
    """(group, place, source, turn, text): contents taken from the sources of a group by turns, under one budget.

    Each source has its own cursor. A turn offers the next content of every source; blank ones and
    those that no longer fit are passed over, and a turn that adds nothing is the last. A content
    costs its length as a JSON string and one more. Every turn that adds something uses four
    of the budget at least, so later turns than that allows are left out before the fold: a
    group's list holds at most limit / 4 contents of a source.
    """
    turn = F.row_number().over(Window.partitionBy(*group, source).orderBy(*order)) - 1
    body = F.trim(F.coalesce(F.col(text), F.lit("")))
    cost = F.char_length(F.to_json(F.struct(body.alias("t")))) - 5
    rows = df.withColumn("__turn", turn).filter(F.col("__turn") <= limit // 4)
    item = F.struct(F.col("__turn").alias("turn"), F.col(source).alias("source"), body.alias("text"), cost.cast("bigint").alias("cost"))
    lists = rows.groupBy(*group).agg(F.sort_array(F.collect_list(item)).alias("__items"))
    state = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("turn"), F.lit(False).alias("grew"), F.lit(False).alias("over"), F.array().cast("array<int>").alias("taken"))

    def step(s: Column, x: Column) -> Column:
        new = x["turn"] != s["turn"]
        over = s["over"] | (new & ~s["grew"])
        fits = ~over & (x["text"] != "") & (s["used"] + x["cost"] <= limit)
        grew = fits | (s["grew"] & ~new)
        return F.struct((s["used"] + F.when(fits, x["cost"]).otherwise(0)).alias("used"), x["turn"].alias("turn"), grew.alias("grew"), over.alias("over"), F.concat(s["taken"], F.array(fits.cast("int"))).alias("taken"))

    folded = lists.withColumn("__taken", F.aggregate("__items", state, step)["taken"])
    kept = F.filter(F.arrays_zip("__items", "__taken"), lambda x: x["__taken"] == 1)
    out = folded.select(*group, F.posexplode(kept).alias("place", "x"))
    return out.select(*group, "place", F.col("x.__items.source").alias(source), F.col("x.__items.turn").alias("turn"), F.col("x.__items.text").alias(text))


def in_all(df: DataFrame, item: str, owner: str, order: str | None = None, first: Column | None = None) -> DataFrame:
    """The items that every owner has; with `order` and `first` (which rows are the first owner's) also that owner's order."""
    owners = df.agg(F.countDistinct(owner).alias("owners"))
    extra = [F.min(F.when(first, F.col(order))).alias(order)] if order is not None and first is not None else []
    return df.groupBy(item).agg(F.countDistinct(owner).alias("n"), *extra).join(F.broadcast(owners)).filter("n = owners").select(item, *([order] if extra else []))


def sample_by_hash(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows in an order that the seed alone decides; n <= 0 keeps all."""
    return df if n <= 0 else df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def split_by_hash(df: DataFrame, key: str, seed: int, share: float) -> DataFrame:
    """Adds `part`: 'val' for about `share` of the keys, else 'train'; a key is always in one part."""
    place = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 20))
    return df.withColumn("part", F.when(place < int(share * (1 << 20)), "val").otherwise("train"))


def ranking(ranked: Column, default: Column) -> Column:
    """A proposed order made whole: its valid entries once each, then the rest in default order."""
    return F.concat(F.array_distinct(F.filter(ranked, lambda x: F.array_contains(default, x))), F.array_except(default, ranked))


# ---- changes

def last_of(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of rows with equal keys the last by order (then by all columns)."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(order.alias("__order"), *rest)).alias("row"))
    return best.select(*(F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in df.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], nulled: Sequence[str] = (), order: Column | None = None) -> DataFrame:
    """Rows of new, and those of old whose keys new lacks; columns of old that new lacks are null in rows of new.

    `nulled` are cached columns that a new row makes invalid. Of rows of new with equal keys the
    last by `order` counts (the greatest, where no order is given).
    """
    last = last_of(new, keys, order if order is not None else F.lit(0))
    for name in {*nulled, *(c for c in old.columns if c not in new.columns)}:
        last = last.withColumn(name, F.lit(None).cast(old.schema[name].dataType))
    return old.join(new.select(*keys), keys, "left_anti").select(old.columns).unionByName(last.select(old.columns))


def set_fields(old: DataFrame, new: DataFrame, keys: list[str], given: str | None = None) -> DataFrame:
    """old with the columns that new has, row by row; other columns of old survive.

    Where `given` names a column of new that lists field names, only those are set (so that null can
    be set, and absent is not null); without it, only values that are not null. Keys that old lacks come in.
    """
    fields = [c for c in new.columns if c not in keys and c != given]
    renamed = new.select(*keys, F.lit(True).alias("__new"), *(F.col(c).alias(f"__{c}") for c in [*fields, *([given] if given else [])]))
    both = old.join(renamed, keys, "full_outer")

    def value(c: str) -> Column:
        if c not in fields:
            return F.col(c)
        is_set = F.array_contains(F.col(f"__{given}"), c) if given else F.col(f"__{c}").isNotNull()
        return F.when(F.coalesce(is_set, F.lit(False)), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)

    return both.select(*(F.col(c) if c in keys else value(c) for c in old.columns))


def upsert_children(old: DataFrame, new: DataFrame, keys: list[str], refreshed: Sequence[str]) -> DataFrame:
    """Child rows: known ones keep all but the `refreshed` columns; unknown ones come in with the rest null."""
    return set_fields(old, new.select(*keys, *refreshed).dropDuplicates(keys), keys)


def update_existing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new values where new has the key; unknown keys of new are ignored."""
    fields = [c for c in new.columns if c not in keys]
    found = old.join(new.select(*keys, F.lit(True).alias("__new"), *(F.col(c).alias(f"__{c}") for c in fields)), keys, "left")
    return found.select(*(F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in old.columns))


def insert_absent(old: DataFrame, new: DataFrame, key, order: list[str]) -> DataFrame:
    """old and those rows of new whose key (a function of a DataFrame's columns) neither old nor an earlier row of new has."""
    fresh = first_seen(new, key, order).withColumn("__key", key)
    return old.unionByName(fresh.join(old.select(key.alias("__key")), "__key", "left_anti").select(old.columns))


def match_two_ways(new: DataFrame, old: DataFrame, strong: str, weak: str, id_column: str) -> DataFrame:
    """new with the id of its row in old: by the strong key, else by the weak one, the newest (greatest) id of several."""
    by_strong = old.filter(F.col(strong).isNotNull()).groupBy(strong).agg(F.max(id_column).alias("__strong"))
    by_weak = old.filter(F.col(weak).isNotNull()).groupBy(weak).agg(F.max(id_column).alias("__weak"))
    found = new.join(by_strong, strong, "left").join(by_weak, weak, "left")
    return found.withColumn(id_column, F.coalesce("__strong", "__weak")).drop("__strong", "__weak")


def set_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in columns})


def keep_range(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Without the rows outside low..high; rows where the column is null stay."""
    keep = F.lit(True)
    if low is not None:
        keep = keep & (F.col(column) >= low)
    if high is not None:
        keep = keep & (F.col(column) <= high)
    return df.filter(F.col(column).isNull() | keep)


def replace_parts(old: DataFrame, new: DataFrame, parts: list[str], droppable: Column) -> DataFrame:
    """Rows of old that are not droppable or whose part new does not have, and all rows of new."""
    hit = new.select(*parts).distinct().withColumn("__hit", F.lit(True))
    kept = old.join(hit, parts, "left").filter(F.col("__hit").isNull() | ~F.coalesce(droppable, F.lit(False)))
    return kept.select(old.columns).unionByName(new.select(old.columns))


def apply_operations(old: DataFrame, operations: DataFrame, keys: list[str], kind: str = "operation") -> DataFrame:
    """Rows after operations add, update and delete (one for each key).

    An update of an unknown key or an add of a known one makes the query fail.
    """
    fields = [c for c in operations.columns if c not in keys and c != kind]
    found = old.withColumn("__old", F.lit(True)).join(operations.select(*keys, kind, *(F.col(c).alias(f"__{c}") for c in fields)), keys, "full_outer")
    wrong = ((F.col(kind) == "update") & F.col("__old").isNull()) | ((F.col(kind) == "add") & F.col("__old").isNotNull())
    found = found.filter(F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.concat(F.lit("no such row, or it is there: "), F.col(kind))).cast("boolean")).otherwise(F.col(kind).isNull() | (F.col(kind) != "delete")))
    return found.select(*(F.when(F.col(kind).isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in old.columns))


def changed_fields(old: DataFrame, new: DataFrame, keys: list[str], fields: Sequence[str]) -> DataFrame:
    """keys and `changed`: the names of text fields that differ after trimming, blank being null; rows without a change are absent."""
    other = new.select(*keys, *(F.col(c).alias(f"__{c}") for c in fields))
    clean = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    names = F.array_compact(F.array(*(F.when(~clean(c).eqNullSafe(clean(f"__{c}")), F.lit(c)) for c in fields)))
    return old.join(other, keys).select(*keys, names.alias("changed")).filter(F.size("changed") > 0)


def last_writer(base: DataFrame, writes: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """base with the value of the last write; keys without a write keep their own."""
    last = writes.groupBy(*keys).agg(F.max_by(value, order).alias("__value"))
    return base.join(last, keys, "left").withColumn(value, F.coalesce("__value", value)).drop("__value")


# ---- summaries

def frequencies(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """(kind, value, n): how often each value of each column occurs, in one pass."""
    pairs = F.array(*(F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value")) for kind, value in columns.items()))
    return df.select(F.explode(pairs).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def year_range(df: DataFrame, year: Column, now: Column, back: int = 25) -> DataFrame:
    """One row: the first year (`now` - back and 1900 at least, where there is none) and the options from the later of now and the last year down."""
    found = df.agg(F.min(year).alias("low"), F.max(year).alias("high"))
    first = F.coalesce("low", F.greatest(now - back, F.lit(1900)))
    return found.select(first.alias("first"), F.sequence(F.greatest(now, F.coalesce("high", now)), first, F.lit(-1)).alias("options"))


#: Ranks are sought between the approximate percentiles this far on either side; those err by a tenth of it at most.
RANK_MARGIN = 0.001


def latency(df: DataFrame, group: str, value: str) -> DataFrame:
    """mean, median, nearest-rank p95, min, max and population deviation per group, null values aside.

    A first pass combines sketches of each group's values, a second counts the values below two
    narrow ranges that hold the ranks sought, and only what lies in these ranges is sorted: some
    thousandths of a group's different values, equal ones being counted first.
    """
    rows = df.filter(F.col(value).isNotNull()).select(group, F.col(value).alias("__v"))
    at = [0.5 - RANK_MARGIN, 0.5 + RANK_MARGIN, 0.95 - RANK_MARGIN, 0.95 + RANK_MARGIN]
    edges = rows.groupBy(group).agg(F.percentile_approx("__v", at, int(10 / RANK_MARGIN)).alias("__e"), F.count("*").alias("__all"))
    met = rows.join(edges, group)
    v, e = F.col("__v"), F.col("__e")
    below = met.groupBy(group).agg(F.max("__all").alias("n"), F.count_if(v < e[0]).alias("__under0"), F.count_if(v < e[2]).alias("__under1"))
    inside = F.array_compact(F.array(F.when(v.between(e[0], e[1]), 0), F.when(v.between(e[2], e[3]), 1)))
    counted = met.select(group, "__v", F.explode(inside).alias("__range")).groupBy(group, "__range", "__v").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(group, "__range").orderBy("__v"))
    placed = counted.withColumn("__in", upto).join(below, group).withColumn("__upto", F.col("__in") + F.when(F.col("__range") == 0, F.col("__under0")).otherwise(F.col("__under1")))
    seek = lambda number, rank: F.min(F.when((F.col("__range") == number) & (F.col("__upto") >= rank), v))
    n = F.col("n")
    ranked = placed.groupBy(group, "n").agg(
        seek(0, F.floor((n + 1) / 2)).alias("__low"), seek(0, F.floor(n / 2) + 1).alias("__high"), seek(1, F.ceil(n * F.lit(0.95).cast("decimal(3,2)"))).alias("p95")
    )
    sums = df.groupBy(group).agg(F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.stddev_pop(value), 6).alias("deviation"))
    together = sums.join(ranked, group, "left")
    return together.select(group, F.coalesce("n", F.lit(0)).alias("n"), "mean", F.round((F.col("__low") + F.col("__high")) / 2, 6).alias("median"), "p95", "least", "most", "deviation")
