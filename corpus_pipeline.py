"""A training-corpus pipeline over ``documents``: every stage takes what the one before kept.

language -> near-duplicates -> benchmark passages -> source mix -> shards
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontam, langid, mixing, neardup, sharding
from palimpsest.llm.common import checkpointed, fresh, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: A document whose language scores less is rejected: a text of its words could as well be of several languages.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language. Those without a letter go, and those that are as likely in several; a null ``lang`` is filled in."""
    found = fresh(docs, "language")
    known = langid.with_language(docs, langid.fit(docs), out=found).where((F.col(f"{found}.lang_pred") != langid.UNKNOWN) & (F.col(f"{found}.score") >= LEAST_SCORE))
    return known.withColumn("lang", F.coalesce("lang", f"{found}.lang_pred")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and place in it."""
    return sharding.sharded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("sharding", shards),
]
#: The language model is beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        # Stages read their input several times: keep it where executors that are lost cannot take it along.
        docs = stage(spark, checkpointed(docs) if k else docs, sf_dir)
    return docs
