"""Coverage of files: totals, filters, lowest first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores


def overall(files: DataFrame, threshold: float | None = None) -> DataFrame:
    """One row: mean of the files' percentages (branches and functions are the same), covered lines over all lines,
    and whether the threshold is met (null without one)."""
    mean = F.coalesce(F.avg("pct"), F.lit(0.0))
    one = files.agg(mean.alias("overall"), scores.percentage(F.sum("covered"), F.sum("total")).alias("lines"), F.count(F.lit(1)).alias("n_files"))
    out = one.withColumns({"branches": F.col("overall"), "functions": F.col("overall")})
    return out.withColumn("meets", scores.meets(F.col("overall"), threshold))


def below(files: DataFrame, prefix: str) -> DataFrame:
    return files.filter(F.col("path").startswith(prefix))


def lowest(files: DataFrame, most: int = 15) -> DataFrame:
    return files.orderBy("pct", "path").limit(most)


def recommendations(files: DataFrame, threshold: float | None = None) -> DataFrame:
    """One row with an array of texts.  Of low files three paths of each kind leave the search for them, not all."""
    low, zero = F.col("pct") < 50, F.col("pct") == 0
    some = lambda kind, which: files.filter(which).select("path").orderBy("path").limit(3).select(F.lit(kind).alias("kind"), "path")
    facts = files.agg(F.coalesce(F.avg("pct"), F.lit(0.0)).alias("mean"), F.count_if(low).alias("n_low"), F.count_if(zero).alias("n_zero"))
    none = F.lit(None).cast("string")
    rows = facts.select("*", none.alias("kind"), none.alias("path")).unionByName(some("low", low).unionByName(some("zero", zero)), allowMissingColumns=True)
    few = lambda kind: F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("path")))), ", ").alias(kind)
    one = rows.agg(*[F.max(c).alias(c) for c in facts.columns], few("low"), few("zero"))  # seven rows at most
    said = F.array_compact(
        F.array(
            F.when(F.col("mean") < F.lit(float(threshold or 0)), F.concat(F.lit("Coverage of "), scores.shown(F.col("mean")), F.lit(f"% is under the threshold of {threshold}%."))),
            F.when(F.col("n_low") > 0, F.concat("n_low", F.lit(" files are covered by less than half, such as "), "low")),
            F.when(F.col("n_zero") > 0, F.concat("n_zero", F.lit(" files are not covered, such as "), "zero")),
        )
    )
    return one.select(said.alias("said")).select(F.when(F.size("said") > 0, F.col("said")).otherwise(F.array(F.lit("Coverage is good; look at edge cases and error paths."))).alias("said"))
