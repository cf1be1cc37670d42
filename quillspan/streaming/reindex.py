"""Extension: a corpus that is indexed as it grows, with Structured Streaming.

``metrics`` works on a stream of (path, content, modified) rows; ``latest`` keeps each file's last version and
``event_windows`` counts events in windows with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..sources import corpus as source


def watch(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """Files as they come, from a folder of one level; contents are decoded as UTF-8."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).load(folder)
    return stream.select(F.regexp_replace("path", r"^file:/*", "/").alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"))


def metrics(stream: DataFrame) -> DataFrame:
    """Each version's language, lines, complexity and imports, without state."""
    out = stream.withColumn("language", fx.language(F.col("path"))).filter(F.col("language").isin(*source.LANGUAGES))
    return out.select("path", "modified", "language", fx.n_lines(F.col("content")).alias("n_lines"), fx.file_complexity(F.col("content")).alias("complexity"), fx.imports(F.col("content"), F.col("language")).alias("dependencies"))


def latest(stream: DataFrame) -> DataFrame:
    """The last version of each file; state is one row a file."""
    return stream.groupBy("path").agg(F.max_by(F.struct(*[c for c in stream.columns if c != "path"]), "modified").alias("v")).select("path", "v.*")


def event_windows(stream: DataFrame, size: str = "1 hour", late: str = "10 minutes", ts: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums by window and kind; rows later than the watermark are left out, as state must end."""
    grouped = stream.withWatermark(ts, late).groupBy(F.window(ts, size), kind)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")
