"""The nearest definition of a name by the folders of both, without pairs of references and definitions.

All folders of a name's definitions are a trie, held as one row a prefix: of what lies below it the first definition,
and the least deep one.  A reference asks for the prefixes of its own folder, so it meets as many rows as its folder has
parts, however many definitions share the name.  References with the same name and folder ask once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx


def _prefixes(parts: Column) -> Column:
    """Array of (depth, prefix) of a path's parts, from none of them to all."""
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("prefix")))


def trie(definitions: DataFrame) -> DataFrame:
    """name, depth, prefix, first (ord, file) and below (depth of its folder, ord, file) from definitions (name, file, ord)."""
    rows = definitions.select("name", "file", "ord", F.split(fx.dirname(F.col("file")), "/").alias("parts"))
    rows = rows.select("name", "file", "ord", F.size("parts").alias("deep"), F.explode(_prefixes(F.col("parts"))).alias("p"))
    return rows.groupBy("name", "p.depth", "p.prefix").agg(F.min(F.struct("ord", "file")).alias("first"), F.min(F.struct("deep", "ord", "file")).alias("below"))


def nearest(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """``references`` (with name and folder) with file and distance of the nearest of ``definitions`` (name, file, ord).

    The distance is ``text.proximity``: 100 for each folder to go up, or else 1 for each to go down; of equally near
    ones the least ord, then file, wins.  References whose name has no definition are left out; definitions more than
    99 folders below a reference count as farther than any.
    """
    asked = references.select("name", "folder").distinct().withColumn("parts", F.split("folder", "/"))
    asked = asked.select("name", "folder", F.size("parts").alias("size"), F.explode(_prefixes(F.col("parts"))).alias("p")).select("name", "folder", "size", "p.*")
    met = asked.join(trie(definitions), ["name", "depth", "prefix"])
    down = F.struct((F.col("below.deep") - F.col("size")).alias("distance"), F.col("below.ord").alias("ord"), F.col("below.file").alias("file"))
    up = F.struct((100 * (F.col("size") - F.col("depth"))).alias("distance"), F.col("first.ord").alias("ord"), F.col("first.file").alias("file"))
    best = met.groupBy("name", "folder").agg(F.min(F.when(F.col("depth") == F.col("size"), down).otherwise(up)).alias("best"))
    return references.join(best, ["name", "folder"]).select(*references.columns, "best.file", "best.distance")
