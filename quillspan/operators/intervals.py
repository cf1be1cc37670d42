"""Containment of intervals of any length, by aligned blocks.

An outer interval is cut into aligned blocks of sizes 1, 2^BITS, 4^BITS, …: a few of each size, so O(log length) of
them.  An inner interval's start lies in one block of each size, and in at most one of an outer interval's, so a pair
meets once, by an equi-join on group, size and block; the inner end is compared after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 4


def levels_of(outer: DataFrame, start: str = "start", end: str = "end", bits: int = BITS) -> int:
    """Sizes needed so that the longest interval has few blocks of the largest size; one aggregate."""
    longest = outer.agg(F.max(F.col(end) - F.col(start))).first()[0]
    return max(1, -(-max(longest or 0, 0).bit_length() // bits))


def blocks(start: Column, end: Column, levels: int, bits: int = BITS) -> Column:
    """Array of (level, block): the aligned blocks that make up the whole numbers from ``start`` to ``end``, both included."""
    none = F.array().cast("array<bigint>")
    some = lambda a, z: F.when(a <= z, F.sequence(a, z)).otherwise(none)
    first = lambda level: F.shiftright(start + F.lit((1 << bits * level) - 1), bits * level)
    last = lambda level: F.shiftright(end + F.lit(1), bits * level) - 1
    named = lambda level: lambda b: F.struct(F.lit(level).alias("level"), b.alias("block"))
    out = []
    for level in range(levels):
        a, z = first(level), last(level)
        if level < levels - 1:
            above_a, above_z = F.shiftleft(first(level + 1), bits), F.shiftleft(last(level + 1) + 1, bits)
            own = F.when(above_a < above_z, F.concat(some(a, above_a - 1), some(above_z, z))).otherwise(some(a, z))
        else:
            own = some(a, z)
        out.append(F.transform(own, named(level)))
    return F.when(start <= end, F.concat(*out)).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))


def _keys(start: Column, levels: int, bits: int) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(start, bits * k).alias("block")) for k in range(levels)])


def contained(outer: DataFrame, inner: DataFrame, on: list[str], start: str = "start", end: str = "end", bits: int = BITS) -> DataFrame:
    """``on``, outer and inner (structs of the other columns): pairs of one group, inner within outer, ends included.

    ``start`` and ``end`` are bigints, null or reversed ones match nothing.  The rows are the pairs that there are.
    """
    n = levels_of(outer, start, end, bits)
    whole = lambda df: F.struct(*[c for c in df.columns if c not in on])
    a = outer.select(*on, whole(outer).alias("outer"), F.explode(blocks(F.col(start), F.col(end), n, bits)).alias("k")).select(*on, "outer", "k.*")
    b = inner.filter(F.col(start) <= F.col(end)).select(*on, whole(inner).alias("inner"), F.explode(_keys(F.col(start), n, bits)).alias("k")).select(*on, "inner", "k.*")
    # a short table of intervals may have many blocks, which Spark's estimate doesn't see: neither side is broadcast
    return a.hint("merge").join(b, [*on, "level", "block"]).filter(F.col(f"inner.{end}") <= F.col(f"outer.{end}")).select(*on, "outer", "inner")


def points_inside(outer: DataFrame, points: DataFrame, on: list[str], at: str = "at", start: str = "start", end: str = "end", bits: int = BITS) -> DataFrame:
    """``outer`` with n: how many ``points`` (``on``, ``at``) of its group lie within it.

    Points are counted by block before they meet intervals, so an interval over everything meets a few rows, not all
    points.  ``outer`` needs rows that differ; equal rows get the same n once each is made distinct.
    """
    n = levels_of(outer, start, end, bits)
    counts = points.filter(F.col(at).isNotNull()).select(*on, F.explode(_keys(F.col(at), n, bits)).alias("k")).groupBy(*on, F.col("k.level").alias("level"), F.col("k.block").alias("block")).agg(F.count(F.lit(1)).alias("c"))
    rows = outer.distinct()
    keyed = rows.select(*rows.columns, F.explode_outer(blocks(F.col(start), F.col(end), n, bits)).alias("k")).select(*rows.columns, "k.*")
    return keyed.join(counts, [*on, "level", "block"], "left").groupBy(*rows.columns).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
