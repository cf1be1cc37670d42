"""Shared parts: reading the input, small batches, word splitting, crc32 folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import durable, fresh_path

__all__ = ["WHITE", "WORD", "documents", "durable", "fold", "fresh_path", "labels", "sampled", "small", "words"]

#: The six ASCII white-space characters that separate words.
WHITE = " \t\n\x0b\f\r"
#: A word, for Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` a few at a time, so that a worker never holds many texts and their results at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    pa.default_memory_pool().release_unused()


def words(text: Column) -> Column:
    """Array of the words of ``text`` (null: none)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def fold(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def sampled(rows: DataFrame, most: int, text: str = "text", group: str | None = None, salt: str = "") -> DataFrame:
    """group, hash and text: the ``most`` distinct texts with the smallest hashes of each group (null ones are none).

    Repeated rows change nothing, however many: hashes are made distinct before they are counted.  Tasks hold the
    smallest hashes alone, ``most`` a group; of texts only those chosen are shuffled, one of equal ones from each task.
    The driver gets one number a group.
    """
    named = rows.select((F.lit("") if group is None else F.col(f"`{group}`")).alias("group"), F.xxhash64(F.col(f"`{text}`"), F.lit(salt)).alias("hash"), F.col(f"`{text}`").alias("text"))
    named = named.filter(F.col("group").isNotNull() & F.col("text").isNotNull())
    kind = named.schema["group"].dataType.simpleString()

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            names, hashes = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            at = names.indices.to_numpy()
            for k, name in enumerate(names.dictionary):
                own = np.unique(np.concatenate([held.get(name, hashes[:0]), hashes[at == k]]))
                held[name] = own[:most]
        for name, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(own), name.type), pa.array(own)], ["group", "hash"])

    schema = f"`group` {kind}, `hash` bigint"
    hashes = named.select("group", "hash").mapInArrow(least, schema).distinct().mapInArrow(least, schema)  # of each task, then of each part
    order = Window.partitionBy("group").orderBy("hash")
    ends = hashes.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).groupBy("group").agg(F.max("hash").alias("last")).collect()
    if not ends:
        return named.limit(0)
    last = F.element_at(F.create_map(*[F.lit(x) for r in ends for x in (r["group"], r["last"])]), F.col("group"))
    return named.filter(F.col("hash") <= last).groupBy("group", "hash").agg(F.first("text").alias("text"))
