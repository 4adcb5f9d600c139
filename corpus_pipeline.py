"""Quality rules, near-duplicates, decontamination, mixing and sharding over the documents, one stage after another.

A stage's result is lazy; it is written before the next stage begins, which deletes what the one before it has written on
its way.

In every stage a null or empty text fails the base rules and goes; null keys and sources, repeated rows and further
columns pass through as the operators' docstrings say; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetops.llm.common import cut, noted, release, table
from fleetops.llm.decontaminate import contamination
from fleetops.llm.mixing import mix
from fleetops.llm.near_copies import near_copies
from fleetops.llm.quality_rules import quality_rules
from fleetops.llm.sharding import shard


#: By thread, the working tables of the last stage that was called.
WORKING: ContextVar[list[str]] = ContextVar("working")


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Note the working tables of a stage and delete those of the one before it."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, WORKING.get([]))
        with noted([]) as names:
            out = f(spark, docs, sf_dir)
        WORKING.set(names)
        return out

    return run_stage


@stage
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: those that fail the base test or are likelier bad than good."""
    return quality_rules(docs).filter("kept").select(*docs.columns)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id (null ids last; of equal ids one row):
    texts linked at a Jaccard similarity of 0.8 of their five-word shingles or more, among those that meet in the
    byte-position index of their SimHash fingerprints."""
    return near_copies(docs, shingle=5, similarity=0.8).filter("is_first").select(*docs.columns)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go: 0.8 of its shingles, half the words of question and answer."""
    return contamination(docs, table(spark, sf_dir, "benchmark")).filter(F.size("matches") == 0).select(*docs.columns)


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson replication: sources in proportion to the square root of their rows, as many rows as came in on average.
    Equal rows get equal counts; a null source is one of its own."""
    return mix(docs, alpha=0.5, seed=42).select(*docs.columns)


@stage
def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A global shuffle into 24 shards whose row counts differ by one at most; adds `shard` and `slot`."""
    return shard(docs, n_shards=24, seed=42)


STAGES = [
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The hashes of near-dedup need XXH64, which DuckDB lacks; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. Each but the last is written in the shared folder and read again by the next; a
    stage's working tables and its input are deleted once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            with noted([]) as own:
                docs = cut(docs, name.replace(" ", "-"))
            release(spark, before)
            before = own
    return docs
