"""Imports to files: ranked candidate paths, an equi-join, the first match wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx

#: Fixed: endings tried in order, by tool.  ``absolute``: specifiers with a leading slash count too.
RULES = {
    "graph": ((".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js", ""), False),
    "context": ((".ts", ".tsx", ".js", ".jsx", ""), False),
    "impact": ((".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js", ""), False),
    "trace": ((".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js", ""), True),
    "dead_code": (("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"), True),
}


def resolve(imports: DataFrame, existing: DataFrame, rule: str = "graph", mode: str = "reference") -> DataFrame:
    """src, ord, source and dst of each relative import that resolves against ``existing`` (path).

    ``corrected`` mode also takes ``./x.js`` to ``x.ts`` and ``./x.jsx`` to ``x.tsx``.  Candidates meet the listing in
    one equi-join, whose rows are a fixed multiple of the imports; the least rank per import is one aggregate.
    """
    endings, absolute = RULES[rule]
    base = fx.join_path(fx.dirname(F.col("path")), F.col("source"))
    tried = [F.concat(F.col("base"), F.lit(e)) for e in endings]
    if mode == "corrected":
        tried += [F.regexp_replace("base", r"\.js(x?)$", ".ts$1")]
    wanted = imports.filter(fx.is_relative(F.col("source"), absolute)).withColumn("base", base)
    ranked = wanted.select(F.col("path").alias("src"), "ord", "source", F.posexplode(F.array(*tried)).alias("rank", "dst"))
    met = ranked.join(existing.select(F.col("path").alias("dst")).distinct(), "dst")
    return met.groupBy("src", "ord", "source").agg(F.min_by("dst", "rank").alias("dst"))


def with_folders(files: DataFrame) -> DataFrame:
    """The listing with all folders, for rules that look at the disk."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.select("path").union(files.select(F.explode(above))).filter("path != ''").distinct()


def edges(resolved: DataFrame) -> DataFrame:
    """Distinct (src, dst); a file that imports itself keeps its edge."""
    return resolved.select("src", "dst").distinct()
