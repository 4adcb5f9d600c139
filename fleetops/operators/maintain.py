"""Table maintenance: every operator yields the new version of a table, none changes one in place. `commit_*` put such a
version into effect (see `sources.versions`), whole and once, however many writers there are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetops.operators.windows import keep_last_ttl, latest
from fleetops.sources.versions import Version, change


def upsert_latest(target: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key of both; an update wins a tie with the target."""
    both = target.withColumn("_side", F.lit(0)).unionByName(updates.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [*order, "_side"]).drop("_side")


def insert_missing(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The target and those rows whose key it lacks; of repeated new keys the first in order."""
    fresh = rows.join(target.select(*keys).distinct(), list(keys), "left_anti")
    first = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")
    return target.unionByName(fresh.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(first).select("_row.*"))


def receipt_append(target: DataFrame, rows: DataFrame, key: str, binding: str) -> DataFrame:
    """Adds `outcome` to rows: new, replay (the key is there with this binding) or conflict (with another one, in the
    target or among the rows themselves). Only new rows are to be appended."""
    old = target.select(key, F.col(binding).alias("_old"))
    among = rows.groupBy(key).agg((F.min(binding) != F.max(binding)).alias("_split"))
    out = rows.join(old, key, "left").join(among, key)
    outcome = F.when(F.col("_old").isNotNull(), F.when(F.col("_old") == F.col(binding), "replay").otherwise("conflict")).when(F.col("_split"), "conflict").otherwise("new")
    return out.withColumn("outcome", outcome).drop("_old", "_split")


def commit_upsert(path: str, schema: str, updates: DataFrame, keys: Sequence[str], order: Sequence[str], writer: str | None = None, batch: int = 0) -> Version:
    """Commit `upsert_latest`. A writer's batch that is in already changes nothing."""
    return change(updates.sparkSession, path, schema, lambda now: upsert_latest(now, updates, keys, order), True, writer, batch)


def commit_missing(path: str, schema: str, rows: DataFrame, keys: Sequence[str], order: Sequence[str], writer: str | None = None, batch: int = 0) -> Version:
    """Commit the rows that `insert_missing` adds; what is there isn't written again."""

    def fresh(now: DataFrame) -> DataFrame:
        return insert_missing(now.filter("false"), rows.join(now.select(*keys).distinct(), list(keys), "left_anti"), keys, order)

    return change(rows.sparkSession, path, schema, fresh, False, writer, batch)


def commit_receipts(path: str, schema: str, rows: DataFrame, key: str, binding: str, writer: str | None = None, batch: int = 0) -> Version:
    """Commit the rows that `receipt_append` calls new, each key once."""
    new = lambda now: receipt_append(now, rows, key, binding).filter("outcome = 'new'").drop("outcome").dropDuplicates([key])
    return change(rows.sparkSession, path, schema, new, False, writer, batch)


def compact_outputs(df: DataFrame, large: Sequence[str], done: Column, ts: str, order: Sequence[str], n: int, oldest: int, group: Sequence[str]) -> DataFrame:
    """Null the large columns of done rows that retention wouldn't keep; keys and all other rows stay."""
    flagged = keep_last_ttl(df, ts, order, n, oldest, group=group)
    old = F.coalesce(done, F.lit(False)) & ~F.col("keep")
    return flagged.select(*[F.when(~old, F.col(c)).alias(c) if c in large else F.col(c) for c in df.columns], old.alias("compacted"))


def prune(df: DataFrame, ts: str, order: Sequence[str], n: int, oldest: int, exempt: DataFrame, key: str, group: Sequence[str] = ()) -> DataFrame:
    """The rows that retention keeps."""
    return keep_last_ttl(df, ts, order, n, oldest, exempt, key, group).filter("keep").drop("keep")


def migrate_rows(df: DataFrame, defaults: dict[str, object], renamed: dict[str, str], column: str) -> DataFrame:
    """Fill missing columns and nulls with defaults, and map old values of a column to new ones."""
    out = df
    for c, v in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v))
    mapped = F.col(column)
    for old, new in renamed.items():
        mapped = F.when(F.col(column) == old, F.lit(new)).otherwise(mapped)
    return out.withColumn(column, mapped)


def quality_report(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """A row per required column: whether it is there, of the wanted type, how many rows and how many nulls."""
    have = dict(df.dtypes)
    there = [c for c in required if c in have]
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in there])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(c in have).alias("present"), F.lit(have.get(c) == t).alias("typed"), F.col("_n").alias("rows"), (F.col(f"_{c}") if c in have else F.col("_n")).alias("nulls")) for c, t in required.items()]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
