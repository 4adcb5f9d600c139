"""Set operations on tables, on their columns and on arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetops.operators.aggregates import multiset_digest


def union_latest(a: DataFrame, b: DataFrame, owner: str, seq: str) -> DataFrame:
    """The newest seq of each owner in each of two logs, without repeats."""
    side = lambda df: df.groupBy(owner).agg(F.max(seq).alias(seq))
    return side(a).unionByName(side(b)).distinct()


def table_set_diff(before: DataFrame, after: DataFrame, allowed: DataFrame) -> DataFrame:
    """Catalog rows that went (removed) or came without being allowed (unapproved); all with the same columns."""
    gone = before.distinct().exceptAll(after.distinct()).withColumn("change", F.lit("removed"))
    new = after.distinct().exceptAll(before.distinct()).exceptAll(allowed.distinct()).withColumn("change", F.lit("unapproved"))
    return gone.unionByName(new)


def facts_unchanged(before: DataFrame, after: DataFrame, columns: Sequence[str], added: dict[str, object] | None = None) -> DataFrame:
    """One row: rows_before, rows_after, unchanged. The digests over `columns` must be equal, and columns that are new
    (added) must hold their default in every row."""
    a = multiset_digest(before, columns).select(F.col("rows").alias("rows_before"), F.col("digest").alias("_a"))
    b = multiset_digest(after, columns).select(F.col("rows").alias("rows_after"), F.col("digest").alias("_b"))
    odd = F.lit(False)
    for c, default in (added or {}).items():
        odd = odd | ~F.col(c).eqNullSafe(F.lit(default))
    fresh = after.agg(F.coalesce(F.bool_or(odd), F.lit(False)).alias("_odd"))
    out = a.crossJoin(b).crossJoin(fresh)  # one row each
    return out.select("rows_before", "rows_after", (F.col("_a").eqNullSafe(F.col("_b")) & ~F.col("_odd")).alias("unchanged"))


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows, counting repeats, that are in only one of two versions, with `side`."""
    return before.exceptAll(after).withColumn("side", F.lit("before")).unionByName(after.exceptAll(before).withColumn("side", F.lit("after")))


def owned_external(pids: Column, active: Column, known: Column) -> tuple[Column, Column, Column]:
    """Of the processes seen: ours that run, ours that should have ended, and those of others."""
    return F.array_intersect(pids, active), F.array_except(F.array_intersect(pids, known), active), F.array_except(pids, F.array_union(active, known))


def affinity_order(affinity: Column, pool: Column, hard: Column) -> Column:
    """Cards in order of preference: those of the pool that are preferred, then the rest unless hard; no repeats."""
    first = F.array_intersect(F.coalesce(affinity, F.array().cast("array<bigint>")), pool)
    return F.when(F.coalesce(hard, F.lit(False)), first).otherwise(F.concat(first, F.array_except(pool, first)))


def manifest_diff(before: DataFrame, after: DataFrame, path: str, fields: Sequence[str]) -> DataFrame:
    """Files added, removed or changed in a field (nulls equal); paths are unique in a manifest."""
    a = before.select(path, F.struct(*fields).alias("_a"))
    b = after.select(path, F.struct(*fields).alias("_b"))
    out = a.join(b, path, "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return out.withColumn("change", change).filter("change is not null").select(path, "change")
