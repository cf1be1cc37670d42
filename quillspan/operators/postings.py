"""A reference index: for each token the texts that have it and where, in buckets of tokens.

The index is a Parquet table partitioned by a bucket of the token's CRC-32 and sorted by token within, so a look-up
reads the files of its tokens' buckets alone, and of these the row groups that may hold the token.  Rows are dealt out
in ranges of (bucket, token, key), so a token that every text has is spread over tasks by its texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import durable, fresh_path

#: An identifier or a word.
TOKEN = r"[\p{L}_$][\p{L}\p{N}_$]*"
BUCKETS = 64


def postings(docs: DataFrame, key: str, text: str, token: str = TOKEN) -> DataFrame:
    """token, key and positions: the places of the token among its text's tokens, from 0.  Null texts have none; rows
    of one key are one text's."""
    every = docs.select(F.col(key).alias("key"), F.posexplode(F.regexp_extract_all(text, F.lit(token), F.lit(0))).alias("at", "token"))
    return gathered(every)


def gathered(places: DataFrame) -> DataFrame:
    """token, key and positions, sorted, from one row (token, key, at) a place."""
    return places.groupBy("token", "key").agg(F.array_sort(F.collect_list("at")).alias("positions"))


@dataclass(frozen=True)
class Postings:
    """A written index; ``buckets`` is fixed when it is built."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    @classmethod
    def build(cls, rows: DataFrame, path: str | None = None, buckets: int = BUCKETS) -> Postings:
        """Write an index of ``rows`` (token, key, positions), as ``postings`` makes them."""
        spark = rows.sparkSession
        path = path or fresh_path(spark, "postings")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        placed = durable(rows.withColumn("bucket", (F.crc32(F.col("token").cast("binary")) % buckets).cast("int")), "postings")  # the range partitioner reads its input twice
        placed.repartitionByRange(parts, "bucket", "token", "key").sortWithinPartitions("bucket", "token", "key").write.partitionBy("bucket").parquet(path)
        return cls(spark, path, buckets)

    def bucket(self, token: str) -> int:
        return crc32(token.encode()) % self.buckets

    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def lookup(self, *tokens: str) -> DataFrame:
        """token, key and positions of a few tokens; other buckets are not read."""
        where = F.col("bucket").isin(*sorted({self.bucket(t) for t in tokens})) & F.col("token").isin(*tokens)
        return self.table().filter(where).select("token", "key", "positions")

    def counts(self, *tokens: str) -> DataFrame:
        """token, key and n, from the positions."""
        return self.lookup(*tokens).select("token", "key", F.size("positions").alias("n"))

    def having(self, names: DataFrame) -> DataFrame:
        """token, key and positions of all tokens in ``names`` (token), by a join on bucket and token."""
        wanted = names.select("token").distinct().withColumn("bucket", (F.crc32(F.col("token").cast("binary")) % self.buckets).cast("int"))
        return self.table().join(wanted, ["bucket", "token"]).select("token", "key", "positions")
