"""Document fingerprints: bottom-k sketches of shingle hashes, in built-in functions only.

A sketch is the sorted array of the ``k`` smallest distinct 64-bit hashes of a text's shingles (``width`` words; a text
with fewer words is one shingle; without words it has none).  Sketches of parts merge into the sketch of the whole,
and two sketches estimate resemblance, containment and the number of distinct shingles; where both hold every hash
(fewer than k) these are exact.

Defined results: a null text counts as empty; two sketches without hashes resemble each other fully, one without and
one with not at all; repeated rows are sketched each; ids are of any type with an order; documents with the same or a
null id (null last) stand next to each other in the order of their texts' first characters, then of the texts' hashes;
a table of one document is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .common import durable, words

K = 64
WIDTH = 5


def shingles(w: Column, width: int = WIDTH) -> Column:
    """64-bit hashes of all shingles of an array of words."""
    n = F.size(w)
    several = F.transform(F.slice(w, F.lit(1), F.greatest(n - (width - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, width)]))
    return F.when(n >= width, several).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))


def bottom(hashes: Column, k: int = K) -> Column:
    """The ``k`` smallest distinct hashes, sorted."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return bottom(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard index of two texts' shingles."""
    both = merge(a, b, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the share of the hash space below the k-th."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63) + 1) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    union = distinct_shingles(merge(a, b, k), k)
    shared = resemblance(a, b, k) * union
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def written(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def sketches(df: DataFrame, text: str = "text", out: str = "sketch", k: int = K, width: int = WIDTH) -> DataFrame:
    """``df`` with the sketch of ``text``."""
    w = out + "__words"
    return df.withColumn(w, words(F.col(text))).withColumn(out, bottom(shingles(F.col(w), width), k)).drop(w)


def merged(df: DataFrame, key: str, sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each key.  Hashes are ranked away before they meet: first within salted parts of a key, whose
    sketches (k hashes each) are then merged, so a hot key costs no task more than a part."""
    salted = df.select(key, F.explode(sketch).alias("h")).distinct()
    part = Window.partitionBy(key, "salt").orderBy("h")
    small = salted.withColumn("salt", F.pmod("h", F.lit(64))).withColumn("r", F.row_number().over(part)).filter(F.col("r") <= k)
    return small.groupBy(key).agg(F.slice(F.sort_array(F.collect_list("h")), 1, k).alias(sketch))


_KEY = ("none", "id", "begin", "hash")  # null ids last, ids descending, then the text


def _before(a: Column, b: Column) -> Column:
    """Whether key ``a`` comes before key ``b``."""
    less = a["hash"] < b["hash"]
    less = (a["begin"] < b["begin"]) | ((a["begin"] == b["begin"]) & less)
    less = (a["id"] > b["id"]) | (a["id"].eqNullSafe(b["id"]) & less)
    return (a["none"] < b["none"]) | ((a["none"] == b["none"]) & F.coalesce(less, F.lit(False)))


def _order(key: str = "key") -> list[Column]:
    return [F.col(f"{key}.none"), F.col(f"{key}.id").desc(), F.col(f"{key}.begin"), F.col(f"{key}.hash")]


def _range(key: Column, edges: Column, n: int) -> Column:
    """Number of the last of the ``n`` sorted edges that doesn't come after ``key``, by binary search."""
    steps = [1 << k for k in reversed(range(n.bit_length()))]
    further = lambda at, s: (at + s < n) & F.coalesce(~_before(key, F.get(edges, at + s)), F.lit(False))
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(further(at, s), at + s).otherwise(at))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = 512, k: int = K, width: int = WIDTH) -> DataFrame:
    """doc_id, text, sketch, next_text and next_sketch; next in descending order of id, after the last the first.

    Ranges of documents are dealt out, one shuffle of the texts; each begins with a document that is known, an edge, and
    that one also goes, as a ghost, to the end of the range before, so the next one is always at hand.  Ranges have about
    ``rows`` documents, or follow the number of shuffle partitions where that makes more than 16 for each; their edges
    are all that the driver gets.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.substring("text", 1, 32).alias("begin"), F.xxhash64("text").alias("hash"))
    ids = ids.withColumn("key", key)
    keys = durable(ids.select("key"), "keys")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    wanted = min(keys.count() // rows + 1, max(parts, min(16 * parts, 20_000)))
    each = -(-wanted // parts)  # edges of a partition, evenly spaced along it
    placed = durable(keys.repartitionByRange(min(parts, wanted), *_order()).withColumn("part", F.spark_partition_id()), "placed")
    along = Window.partitionBy("part")
    spaced = placed.withColumns({"r": F.row_number().over(along.orderBy(*_order())) - 1, "n": F.count(F.lit(1)).over(along)})
    inner = spaced.filter(F.floor(F.col("r") * each / F.col("n")) != F.floor((F.col("r") - 1) * each / F.col("n"))).select("key")
    times = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    said = inner.union(keys.orderBy(*_order()).limit(1)).distinct().orderBy(*_order()).select(F.to_json("key", times))
    found = [r[0] for r in said.collect()] or ['{"none":true,"begin":"","hash":0}']
    # one literal, however many edges: the plan is built and sent as fast for thousands of them
    n, edges = len(found), F.from_json(F.lit(f"[{','.join(found)}]"), ArrayType(keys.schema["key"].dataType), times)
    placed = ids.withColumn("range", _range(F.col("key"), edges, n))
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.pmod(F.col("range") - 1, F.lit(n)).alias("range"), F.lit(True).alias("ghost"))
    is_head = ~(_before(F.get(edges, F.col("range")), F.col("key")) | _before(F.col("key"), F.get(edges, F.col("range"))))
    dealt = placed.withColumn("place", F.explode(F.when(is_head, F.array(own, ghost)).otherwise(F.array(own))))
    dealt = dealt.select("key", "text", "place.range", "place.ghost")
    dealt = sketches(dealt.repartition(parts, "range"), "text", "sketch", k, width)
    order = Window.partitionBy("range").orderBy("ghost", *_order())
    both = dealt.withColumns({"next_text": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)})
    return both.filter(~F.col("ghost")).select(F.col("key.id").alias(doc_id), "text", "sketch", "next_text", "next_sketch")


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    both = with_next(docs, doc_id, text, k=k, width=width)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = sketches(both.withColumn("edited", edited), "edited", "edited_sketch", k, width)
    return both.select(
        doc_id,
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("distinct_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("contained_in_edited"),
    )
