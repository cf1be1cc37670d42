"""How filters interact: what every order of five filters removes at every step, from one CUBE of failure flags.

Each document has five flags (it fails filter A, …, E).  Rows are summed up by part and flags, so that at most 32 rows a
part are left, and a CUBE over the five flags and the part gives all grouping sets: in the set that selects the flags S,
the row whose flags are all false counts the documents that pass all of S.  A step of an order is a pair of such
subsets, before and after its filter; pairs are joined, and orders are joined to the pairs of their steps.

E fails where a smaller id has the same text.  Equal texts meet by their SHA-256 after rows of a text have been summed
up within tasks, so a text that a third of all rows have is a few rows when it is shuffled.

Defined results: a null text counts as empty; a null part and an empty one are one part, the empty string; a null id is
neither smaller nor larger than any other, so E never fails for it, and it has no labels; of repeated rows each counts, and E fails
for none of those that share a text's smallest id; labels of a repeated id count if any row has them; an empty table has
no parts and gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, words

FILTERS = "ABCDE"
_FLAGS = [f.lower() for f in FILTERS]
_ALL = 2 ** len(FILTERS) - 1
_COUNTS = ["n", "good", "toxic"]


def _bit(letter: str) -> int:
    """Of a filter in a mask: as CUBE numbers them, the first has the highest."""
    return 1 << len(FILTERS) - 1 - FILTERS.index(letter)


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """doc_id, part, t (SHA-256 of the text) and a to d: fails on few words, few different words, many capitals, symbols."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("w", words(F.col("text")))
    n, different = F.size("w").cast("long"), F.size(F.array_distinct("w")).cast("long")
    capitals, points = F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long"), F.length("text").cast("long")
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("t"), (n < 100).alias("a"), (100 * different < 80 * n).alias("b"), (100 * capitals > 10 * points).alias("c"), F.col("text").rlike(r"[#$%&*|]").alias("d"))


def flag_counts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, a to e, n, good and toxic: documents by part and failures, and those of them with labels of 1."""
    own = ["part", "a", "b", "c", "d"]
    rows = failures(docs, doc_id, text, part).groupBy("t", "doc_id", *own).agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy(F.col("doc_id").cast("string").alias("key")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # null ids have keys of their own, so that they don't meet in one task
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.hex("t")))).join(marks.filter("key is not null"), "key", "left")
    rows = rows.select("t", "doc_id", "n", *own, F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    known = F.col("doc_id").isNotNull()
    texts = rows.groupBy("t", *own, "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("unnamed"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"))
    texts = texts.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("t")))  # a few rows a text: one a part and labels
    passed = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.lit(False).alias("e"), passed.alias("n")), F.struct(F.lit(True).alias("e"), (F.col("n") - passed).alias("n")))).alias("x")
    rows = texts.select(*own, "good", "toxic", split).select(*own, "x.e", "good", "toxic", "x.n").filter("n > 0")
    return rows.groupBy(*own, "e").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def survivors(counts: DataFrame) -> DataFrame:
    """part (null: all parts together), mask and the counts of documents that pass all filters of the mask; none for zero."""
    cube = counts.cube("part", *_FLAGS).agg(F.grouping_id().alias("g"), *[F.sum(c).alias(c) for c in _COUNTS])
    passing = " AND ".join(f"NOT coalesce({f}, false)" for f in _FLAGS)
    return cube.filter(passing).select("part", F.col("g").bitwiseAND(_ALL + 1).alias("whole"), (_ALL - F.col("g").bitwiseAND(_ALL)).cast("int").alias("mask"), *_COUNTS)


def steps(spark) -> DataFrame:
    """filter_order, step, filter and before (the mask of the filters before it), for each order of the filters."""
    rows = [("".join(order), k + 1, f, sum(map(_bit, order[:k]))) for order in itertools.permutations(FILTERS) for k, f in enumerate(order)]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int")


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each
    part, order and step, zeros included."""
    counts = durable(flag_counts(docs, labels, doc_id, text, part), "flags")
    of_parts = survivors(counts).filter("whole = 0")
    grid = of_parts.filter("mask = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(_ALL))).alias("mask"))
    every = durable(grid.join(of_parts, ["part", "mask"], "left").select("part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS]), "survivors")
    which = F.explode(F.filter(F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(_bit(f)).alias("bit")) for f in FILTERS]), lambda x: F.col("mask").bitwiseAND(x["bit"]) == 0))
    before = every.withColumn("x", which).select("part", F.col("mask").alias("before"), "x.*", *[F.col(c).alias(f"{c}_before") for c in _COUNTS])
    pairs = before.join(every, (before["part"] == every["part"]) & (before["before"] + before["bit"] == every["mask"]))
    pairs = pairs.select(before["part"], "before", "filter", "bit", F.col("n").alias("kept"), *[(F.col(f"{c}_before") - F.col(c)).alias(x) for c, x in zip(_COUNTS, ("removed", "good_lost", "toxic_lost"), strict=True)])
    rows = pairs.join(F.broadcast(steps(docs.sparkSession)), ["before", "filter"])  # 600 rows, whatever the input
    own = Window.partitionBy("part", "filter")
    fails, alone = F.max(F.when(F.col("before") == 0, F.col("removed"))).over(own), F.max(F.when(F.col("before") + F.col("bit") == _ALL, F.col("removed"))).over(own)
    return rows.select("part", "filter_order", "step", "kept", "removed", (fails - F.col("removed")).alias("redundant"), alone.alias("unique_fails"), "good_lost", "toxic_lost", F.sum("removed").over(own).alias("shapley"))
