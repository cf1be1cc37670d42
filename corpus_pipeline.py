"""A pipeline over ``documents``: rules, near-duplicates, secrets, mixture, tokens.

Each stage takes what the one before kept, in full; all but the last return the columns of ``documents``.

Defined results: a null text counts as empty, and the rules reject it, as any text without words; of rows equal in id and
text one stays, null ids included; null sources are a source of their own; null languages and other columns are passed on
as they are; ``n_chars`` follows the redacted text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import bpe_automaton, mixing, quality_rules, secret_scan, simhash
from quillspan.llm.common import durable
from quillspan.llm.queries import vocabulary
from quillspan.session import ship


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted rules keep."""
    ship(spark)
    return quality_rules.keep(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship(spark)
    return simhash.representatives(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced."""
    ship(spark)
    return secret_scan.redact(docs, n_chars="n_chars" if "n_chars" in docs.columns else None)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    ship(spark)
    return mixing.sample(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded text."""
    ship(spark)
    return bpe_automaton.encode(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", rules_stage),
    ("near duplicates", near_duplicates_stage),
    ("secret scans", secrets_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs, name.replace(" ", "-"))
    return docs


#: Votes, fingerprints, formats and the automaton are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
