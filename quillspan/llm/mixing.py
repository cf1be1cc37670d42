"""Mixing sources to target weights by systematic sampling.

A source's target is its share of all words by weight, held to ``most`` times its own size, the excess shared again by
weight.  Every document of a source expects target / size copies.  In a fixed order within the source (size, then a
hash of the id) these are summed up, one offset per source is added, and a document is taken once for each integer
boundary its stretch crosses.  Ordering by size keeps the taken words close to the target.

The order is by ranges over all sources at once, cut inside sources, so a source with a third of all rows is spread
evenly; ranks come from the sizes of the ranges, never from a window over a source.

Defined results: a null text has size 0; a null source is a source of its own, last; documents of size 0 are sampled
like others (they add no words); a source whose documents are all empty has target 0 and none is taken; repeated rows
are sampled one by one; an empty table gives an empty result; reruns agree.  Sources are summed up into one row each,
and those rows are ordered in one task: sources are names in a mixing table, not a key that grows with the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, words


def unit(key: Column, salt: str) -> Column:
    """A number in [0, 1) from a hash of ``key``."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit("\x00null")))), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``sizes`` (source, source_size) with target (double).

    Sources in order of code points, null last, have ``weights`` in turn.  With sources by size / weight ascending, the
    first k are held to ``most`` times their size and the others share the rest; k is the least that leaves none above.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % n + 1).cast("int")).cast("long")
    everything = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.withColumn("w", w).withColumn("ratio", F.col("source_size") / F.col("w"))
    out = out.withColumns({"all_size": F.sum("source_size").over(everything), "all_w": F.sum("w").over(everything)})
    out = out.withColumns({"size_before": F.coalesce(F.sum("source_size").over(before), F.lit(0)), "w_before": F.coalesce(F.sum("w").over(before), F.lit(0))})
    # what a unit of weight gets if this source and those after it are not held
    out = out.withColumn("level", (F.col("all_size") - most * F.col("size_before")) / (F.col("all_w") - F.col("w_before")))
    first_free = F.min(F.when(F.col("level") <= most * F.col("ratio"), F.struct("ratio", "source", "level")))
    out = out.withColumn("free", first_free.over(everything))
    free = F.col("free")
    held = (F.col("ratio") < free["ratio"]) & (F.col("level") > most * F.col("ratio"))
    return out.select("source", "source_size", F.when(free.isNull() | held, (most * F.col("source_size")).cast("double")).otherwise(free["level"] * F.col("w")).alias("target"))


def plan(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source", also: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and the columns ``also``, one row for each row of ``docs``.

    The order of the ids' hashes decides among equal sizes, then that of the columns ``also``; rows equal in all of
    these are interchangeable.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size"), *also)
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = sized.withColumn("key", key)
    sized = durable(sized, "sizes")  # the range partitioner reads its input twice; texts are read once
    ranged = sized.repartitionByRange(parts, "source", "size", "key", "id", *also).withColumn("part", F.spark_partition_id())
    rows = durable(ranged, "mix")  # fixes which range a row is in
    counts = rows.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    sizes = counts.groupBy("source").agg(F.sum("source_size").alias("source_size"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", F.col("source").alias("s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    wanted = targets(sizes, weights, most).withColumnRenamed("source", "s")
    firsts = firsts.join(wanted, firsts["s"].eqNullSafe(wanted["s"])).select("part", firsts["s"], "first", "source_size", "target")
    within = Window.partitionBy("part", "source").orderBy("size", "key", "id", *also)
    ranked = rows.withColumn("k", F.row_number().over(within).cast("long"))
    firsts = firsts.withColumnRenamed("part", "p")
    joined = ranked.join(firsts, (ranked["part"] == firsts["p"]) & ranked["source"].eqNullSafe(firsts["s"]))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place, start = F.col("first") + F.col("k"), unit(F.col("source"), seed)
    copies = F.floor(place * each + start) - F.floor((place - 1) * each + start)
    return joined.select(F.col("id").alias(doc_id), F.col("source").alias(source), "size", "source_size", "target", copies.cast("long").alias("copies"), *also)


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken, one row for each row of ``docs``."""
    doc_id = options.get("doc_id", "doc_id")
    return plan(docs, **options).select(doc_id, "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _row_keys(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a whole row, of any types (maps are hashed as JSON)."""
    values = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    return F.xxhash64(*values).alias("__mix_1"), F.hash(*reversed(values)).alias("__mix_2")


def sample(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with its columns.

    Equal rows are one, summed up before the shuffle, and come as often as all of them together are taken; so neither
    null nor repeated ids are gathered.
    """
    keys = ["__mix_1", "__mix_2"]
    rows = docs.select("*", *_row_keys(docs))
    copies = plan(rows, also=tuple(keys), **options).groupBy(*keys).agg(F.sum("copies").alias("__mix_n")).filter("__mix_n > 0")
    out = rows.dropDuplicates(keys).join(copies, keys).withColumn("__mix_each", F.explode(F.array_repeat(F.lit(0), F.col("__mix_n").cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
