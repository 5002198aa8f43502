"""Links between items that share band keys, and the components that the links make.

Nothing is collected, and a bucket of like members is not expanded into pairs. First every member of
a bucket is held against one leader, the member that shares the most buckets with others: in a group
of variants that is mostly the text they stem from. Then about FIRST members of each component of a
bucket meet the members that are not in it. In the end all pairs of one bucket that are still in
different components are held against each other, so that no link between components is lost; pairs
inside a component would add nothing.

Sharing a bucket is a weak sign: most pairs there are unlike. So each item carries a sketch, 4 bits
of each of SLOTS samples, and a pair whose sketches agree in too few slots for the wanted
similarity goes no further; the join that makes the pairs counts this. Only the others are held
against each other by their whole texts, which alone decides. `threshold` bounds what the sketch
loses; items without a sketch (null) always pass.

Members may also carry their weight (`whole`) and the weight of what any other item has too
(`shared`). Two items overlap in at most the lesser of their shared weights, which bounds their
weighted Jaccard similarity from above. Nothing is lost by that bound, and it turns away the pairs
of variants that each have much of their own: those are alike enough for the sketch, but not linked.

Where items are plain sets, `bounds` gives their size and the parities of how many members fall into
each of 64 * len(PARITY) classes. Every class of unlike parity holds a member that only one of the two
sets has, so unlike parities bound the overlap, again without loss. They are wide, and so are joined
only to members of buckets in which components are still to be told apart.

Hot buckets only meet in joins (which adaptive execution splits) and in combining aggregates. A
bucket of many members that pass sketch and bound, but are not linked, costs their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from weftline.llm import utf8
from weftline.session import forget, written

#: Members of a bucket's component that meet the others of the bucket before all do.
FIRST = 16
#: Members of a bucket that all meet each other by their sketches, where bucket_pairs is used.
SMALL = 32
#: Samples of a sketch, 4 bits each, in two integers.
SLOTS = 32
#: Probability with which a pair of just the wanted similarity fails by its sketches.
LOSS = 1e-3
#: Columns of the parities of a set, 64 classes each.
PARITY = tuple(f"p{k}" for k in range(8))
#: What sums of weights, added up in different orders, may differ by.
ROUNDING = 1e-9


def sketch(samples: np.ndarray) -> np.ndarray:
    """Two integers for each row of samples (at least SLOTS of them)."""
    bits = utf8.mix(samples[:, :SLOTS]) & np.uint64(15)
    shift = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return np.stack([(bits[:, k : k + 16] << shift).sum(1, dtype=np.uint64) for k in (0, 16)], 1).view(np.int64)


def threshold(similarity: float, loss: float = LOSS) -> int:
    """The most slots that two sketches of this similarity agree in but for a probability of `loss`."""
    p, below = similarity + (1 - similarity) / 16, 0.0
    for slots in range(SLOTS + 1):
        below += math.comb(SLOTS, slots) * p**slots * (1 - p) ** (SLOTS - slots)
        if below > loss:
            return slots
    return SLOTS


def agreement(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Slots in which two sketches agree; all, where one is missing."""
    differs = F.lit(0)
    for x, y in zip(a, b):
        z = F.col(x).bitwiseXOR(F.col(y))
        for step in (1, 2):
            z = z.bitwiseOR(F.shiftrightunsigned(z, step))
        differs = differs + F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))
    return F.coalesce(F.lit(SLOTS) - differs, F.lit(SLOTS))


def within_reach(similarity: float) -> Column:
    """Whether the bound of (whole, shared) and (other_whole, other_shared) admits this similarity; sums may be rounded."""
    overlap = F.least("shared", "other_shared")
    return overlap >= (similarity - ROUNDING) * (F.col("whole") + F.col("other_whole") - overlap)


def parities(classes: np.ndarray, item: np.ndarray, n: int) -> np.ndarray:
    """The PARITY columns of n sets (n rows), from the class of each of their members, each member once."""
    bits = 64 * len(PARITY)
    odd = (np.bincount(item * bits + classes, minlength=n * bits) & 1).astype(np.uint64).reshape(n, len(PARITY), 64)
    return (odd << np.arange(64, dtype=np.uint64)).sum(2, dtype=np.uint64).view(np.int64)


def sets_within_reach(similarity: float) -> Column:
    """Whether sizes and parities of two sets (whole, PARITY and the same with other_) admit this Jaccard similarity."""
    differ = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"other_{p}"))) for p in PARITY), F.lit(0))
    overlap = F.least("whole", "other_whole", (F.col("whole") + F.col("other_whole") - differ) / 2)
    return overlap >= (similarity - ROUNDING) * (F.col("whole") + F.col("other_whole") - overlap)


def bucket_pairs(members: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(a, b) with a < b, the pairs of buckets of up to SMALL members whose sketches agree, and the members of the other buckets.

    By chance most items share a small bucket with some other that is unlike them. Here they meet
    once, by their sketches alone, and take no part in what follows.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    counted = written(members.join(sizes, "key"), "counted")
    few = counted.filter(F.col("n") <= SMALL).drop("n")
    other = few.select("key", F.col("id").alias("other"), F.col("s0").alias("t0"), F.col("s1").alias("t1"))
    met = few.join(other, "key").filter((F.col("id") < F.col("other")) & (agreement(("s0", "s1"), ("t0", "t1")) >= threshold(similarity)))
    pairs = written(_pairs(met), "pairs")
    large = written(counted.filter(F.col("n") > SMALL).drop("n"), "large")
    forget(counted)
    return pairs, large


def leader_links(members: DataFrame, verify: Callable[[DataFrame], DataFrame], similarity: float, bounds: DataFrame | None = None, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) with a < b, and the components (id, root), of the pairs of one bucket that are alike.

    members: (key, id, s0, s1), with whole and shared if these are known. `verify` takes pairs (a, b) and returns those that are alike.
    bounds: (id, whole, PARITY) of every item, for sets only. pairs: more pairs (a, b) that are to be looked at, as from bucket_pairs. The
    links join what all links of pairs in a bucket would join, but are not all of them.
    """
    wanted = threshold(similarity)
    alike = agreement(("s0", "s1"), ("t0", "t1")) >= wanted
    other = {"id": "other", "s0": "t0", "s1": "t1"}
    if "whole" in members.columns:
        alike = alike & within_reach(similarity)
        other |= {"whole": "other_whole", "shared": "other_shared"}
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    counted = written(members.join(sizes, "key"), "counted")
    degrees = counted.groupBy("id").agg(F.sum("n").alias("degree"))
    own = written(counted.drop("n").join(degrees, "id"), "members")
    forget(counted)
    leaders = own.groupBy("key").agg(F.min_by(F.struct(*other), F.struct(-F.col("degree"), "id")).alias("x"))
    leaders = leaders.select("key", *(F.col(f"x.{c}").alias(name) for c, name in other.items()))
    met = own.join(leaders, "key").filter((F.col("id") != F.col("other")) & alike)
    near = _pairs(met)
    if pairs is not None:
        near = near.unionByName(pairs).distinct()
    near = written(near if bounds is None else _possible(near, bounds, similarity), "pairs")
    links = written(verify(near), "links")
    forget(near)
    roots = components(links)
    for all_members in (False, True):
        full = own.join(roots.withColumnRenamed("root", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        everyone = written(full.select("key", *other, "comp"), "members")
        mixed = everyone.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key")
        full = everyone.join(mixed, "key", "left_semi")
        if bounds is not None:
            full = full.join(bounds, "id")
        full = written(full, "apart")
        forget(everyone)
        side = full
        if not all_members:
            shares = full.groupBy("key", "comp").agg(F.count("*").alias("n")).filter("n > 1")
            side = full.join(shares, ["key", "comp"]).filter(F.pmod(F.xxhash64("key", "id"), F.lit(1 << 20)) * F.col("n") < F.lit(FIRST << 20))
        names = other if bounds is None else other | {c: f"other_{c}" for c in ("whole", *PARITY)}
        side = side.select("key", *(F.col(c).alias(name) for c, name in names.items()), F.col("comp").alias("other_comp"))
        apart = (F.col("comp") != F.col("other_comp")) & ((F.col("id") < F.col("other")) | F.lit(not all_members))
        near = alike if bounds is None else alike & sets_within_reach(similarity)
        near = written(_pairs(full.join(side, "key").filter(apart & near)), "pairs")
        more = written(verify(near), "more")
        forget(near, full)
        if not more.isEmpty():
            before, links = links, written(links.unionByName(more).distinct(), "links")
            forget(before)
            roots = components(links)
        forget(more)
    forget(own)
    return links, roots


def _possible(pairs: DataFrame, bounds: DataFrame, similarity: float) -> DataFrame:
    """The pairs that the bounds of their two sets admit."""
    names = ("whole", *PARITY)
    one = bounds.select(F.col("id").alias("a"), *names)
    two = bounds.select(F.col("id").alias("b"), *(F.col(c).alias(f"other_{c}") for c in names))
    return pairs.join(one, "a").join(two, "b").filter(sets_within_reach(similarity)).select("a", "b")


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root): the least id of each linked item's component, by union-find in rounds.

    Every round takes the least root among the neighbours and then the root's root (pointer
    jumping), so rounds grow with the logarithm of a component's width, not with its size. Each
    round is a written table: a lost executor costs one round at most.
    """
    both = written(links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other"))).distinct(), "edges")
    roots = written(both.groupBy("id").agg(F.least("id", F.min("other")).alias("root"), F.lit(True).alias("moved")), "roots")
    while not roots.filter("moved").isEmpty():
        near = both.join(roots.select(F.col("id").alias("other"), F.col("root").alias("near")), "other").groupBy("id").agg(F.min("near").alias("near"))
        lower = roots.join(near, "id").select("id", F.least("root", "near").alias("next"), F.col("root").alias("was"))
        up = roots.select(F.col("id").alias("next"), F.col("root").alias("top"))
        after = written(lower.join(up, "next").select("id", F.col("top").alias("root"), (F.col("top") != F.col("was")).alias("moved")), "roots")
        forget(roots)
        roots = after
    forget(both)
    return roots.select("id", "root")
