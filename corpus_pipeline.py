"""The corpus pipeline: documents that are not toxic, one of each group of near copies, free of benchmark passages, mixed
to the sources' weights and dealt to shards.  Each stage reads what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm import decontamination, jaccard_join, mixing, sharding, toxicity
from residua.llm.queries import table
from residua.llm.scratch import settle

#: Near copies share at least this part of their shingles of five words.
SHINGLE, NEAR = 5, (80, 100)
WINDOW = 10
SHARDS = 24


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; learned from all labels."""
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.without_toxic(docs, machine)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays."""
    found = jaccard_join.jaccard_components(docs, SHINGLE, *NEAR)
    return jaccard_join.one_of_each(docs, found)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"), WINDOW)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands as often as the mix takes it; the one where a source's budget ends is cut after its last word."""
    return mixing.mixed(docs, mixing.mix(docs))


def deal_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns with virtual_slot and shard, balanced by bytes."""
    _, _, versions, newest = sharding.balanced_map(sharding.measured(docs), SHARDS)
    return sharding.with_shards(docs, versions, newest)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_to_shards),
]
#: A learned classifier decides first, which SQL can't express; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
