"""Newest rows, chains, runs, retention and ranks: window functions over append-only records.

All take column names. Orders must end in a unique column, or ties are broken arbitrarily; each operator is one
shuffle by its keys unless it says otherwise. Null keys form a group of their own, as in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetops.operators.card_state import advance, reachable
from fleetops.operators.scans import running, stepped
from fleetops.session import saved


def _desc(order: Sequence[str]) -> list[Column]:
    return [F.desc(c) for c in order]


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key. Spark limits each group before the shuffle, so a hot key sends one row per task."""
    w = Window.partitionBy(*keys).orderBy(*_desc(order))
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def latest_by_name(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """The newest row of each name, as an aggregation that is combined before the shuffle (no sort)."""
    whole = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(F.col(name).alias("_name")).agg(whole).select("_row.*")


def latest_per_kind(df: DataFrame, owner: str, kind: str, order: Sequence[str]) -> DataFrame:
    """The newest event of each kind of each owner."""
    whole = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(F.col(owner).alias("_owner"), F.col(kind).alias("_kind")).agg(whole).select("_row.*")


def stale_running(df: DataFrame, keys: Sequence[str], version: str, status: str, running: str = "running") -> DataFrame:
    """Rows still running although their key has a newer version."""
    newest = F.max(version).over(Window.partitionBy(*keys))
    return df.withColumn("newest", newest).filter((F.col(status) == running) & (F.col(version) < F.col("newest")))


def dispatch_rank(df: DataFrame, order: Sequence[Column], within: str) -> DataFrame:
    """`rank_within` in each group and `rank_all` over all rows, both from 1, by the same order.

    Neither needs a single task, however large a group: rows are sorted by ranges (`numbered`) of the order, and then of
    group and order, where a group's ranks begin after its first number. The order must end in a unique column.
    `rank_within` less a free quota equals greedy admission only if nothing else refuses a candidate.
    """
    both = numbered(numbered(df, order, "rank_all"), [F.col(within), *order], "_nth")
    first = both.groupBy(F.col(within).alias("_of")).agg(F.min("_nth").alias("_least"))
    out = both.join(first, F.col(within).eqNullSafe(F.col("_of")))
    return out.withColumn("rank_within", (F.col("_nth") - F.col("_least") + 1).cast("int")).drop("_nth", "_of", "_least")


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds the rows' numbers in an order, from 1: rows are sorted by ranges and numbered inside their partition, and each
    partition starts after the rows of those before it."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = saved(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("_part", "_first", before.alias("_base"))  # a row per partition
    out = placed.join(F.broadcast(bases), "_part")
    return out.withColumn(name, F.col("_at") - F.col("_first") + F.col("_base") + 1).drop("_part", "_at", "_first", "_base")


def verify_chain(df: DataFrame, owner: str, seq: str, id_col: str, prev_col: str, content: Column) -> DataFrame:
    """One verdict per owner of a hash-linked log: `n_events`, `valid`, `first_break` (seq) and `reason` there.

    In order of seq (ties by id): it must count 1..n (gap), the previous id must be the previous row's (link; null for
    the first), and the id must be the SHA-256 of content (digest). The first failing row counts, and of its failures
    the first named above. A long log is verified in ranges that carry on from one another (`running`).
    """
    rows = df.select(owner, seq, F.col(id_col).alias("_id"), F.col(prev_col).alias("_prev"), content.alias("_content"))
    rows = running(rows, [owner], [seq, "_id"], sums={"_nth": F.lit(1)}, before={"_before": F.col("_id")})
    reason = (
        F.when(~F.col(seq).eqNullSafe(F.col("_nth")), "gap")
        .when(~F.col("_prev").eqNullSafe(F.col("_before")), "link")
        .when(~F.col("_id").eqNullSafe(F.sha2(F.col("_content"), 256)), "digest")
    )
    broken = F.min(F.when(F.col("_why").isNotNull(), F.struct("_nth", seq, "_why"))).alias("_first")
    out = rows.withColumn("_why", reason).groupBy(owner).agg(F.count("*").alias("n_events"), broken)
    return out.select(owner, "n_events", F.col("_first").isNull().alias("valid"), F.col("_first")[seq].alias("first_break"), F.col("_first._why").alias("reason"))


def legal_transitions(df: DataFrame, owner: str, seq: str, kind: str, edges: DataFrame, once: Sequence[str] = ()) -> DataFrame:
    """Illegal rows with a reason: `transition` (no edge from the previous kind; null before the first), or `repeated`
    (a kind of `once` that occurred before). edges: before, after - a small table, joined by Spark's choice."""
    rows = running(df, [owner], [seq], before={"before": F.col(kind)})
    firsts = df.filter(F.col(kind).isin(*once)).groupBy(F.col(owner).alias("_o"), F.col(kind).alias("_k")).agg(F.min(seq).alias("_first"))
    rows = rows.join(firsts, F.col(owner).eqNullSafe(F.col("_o")) & (F.col(kind) == F.col("_k")), "left")
    known = edges.select(F.col("before").alias("_b"), F.col("after").alias("_a")).distinct().withColumn("_ok", F.lit(True))
    rows = rows.join(known, F.col("before").eqNullSafe(F.col("_b")) & (F.col(kind) == F.col("_a")), "left")
    reason = F.when(F.col("_ok").isNull(), "transition").when(F.col(seq) > F.col("_first"), "repeated")
    return rows.withColumn("reason", reason).filter("reason is not null").drop("_b", "_a", "_ok", "_o", "_k", "_first")


def collapse_repeats(df: DataFrame, owner: str, order: Sequence[str], same: Sequence[str]) -> DataFrame:
    """Drop a row that equals its immediate predecessor in `same` (nulls equal); equal rows further apart stay."""
    rows = running(df, [owner], order, before={"_prior": F.struct(*same)})
    return rows.filter(F.col("_prior").isNull() | ~F.struct(*same).eqNullSafe(F.col("_prior"))).drop("_prior")


def streaks(df: DataFrame, key: str, order: Sequence[str], hit: Column, n: int) -> DataFrame:
    """Rows at which a run of hits reaches exactly n; a miss or null resets the run. Adds `run` (= n): the row's number less
    that of the last miss."""
    rows = running(df.withColumn("_hit", F.coalesce(hit, F.lit(False))), [key], order, sums={"_nth": F.lit(1)})
    rows = running(rows, [key], order, maxima={"_miss": F.when(~F.col("_hit"), F.col("_nth"))})
    rows = rows.withColumn("run", F.col("_nth") - F.coalesce("_miss", F.lit(0)))
    return rows.filter(F.col("_hit") & (F.col("run") == n)).drop("_hit", "_nth", "_miss")


def keep_last_ttl(df: DataFrame, ts: str, order: Sequence[str], n: int, oldest: int, exempt: DataFrame | None = None, key: str | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Retention: adds `keep`. Rows older than `oldest` go; of the rest only the newest n (of each group) stay, and rows
    whose key is in `exempt` stay in any case, though they count among the n. A null key is never exempt. With groups, rows
    that are equal in them and in the order stay or go together; a hot group is spread out (see `_among_first`)."""
    young = F.coalesce(F.col(ts) >= oldest, F.lit(False))
    if group:
        rows = _among_first(df.withColumn("_young", young), F.col("_young"), group, order, _desc(order), n)
        rows = rows.withColumn("_nth", F.when(F.col("_first"), n).otherwise(n + 1)).drop("_first")
    else:  # each task keeps n rows of its own, so not all rows are sorted in one
        at = [F.col(c).alias(f"_o{k}") for k, c in enumerate(order)]
        top = df.filter(young).orderBy(*_desc(order)).limit(n).select(*at, F.lit(0).alias("_nth"))
        rows = df.join(top, [F.col(c).eqNullSafe(F.col(f"_o{k}")) for k, c in enumerate(order)], "left")
        rows = rows.withColumn("_young", young).withColumn("_nth", F.coalesce("_nth", F.lit(n + 1)))
    keep = F.col("_young") & (F.col("_nth") <= n)
    if exempt is not None:
        ids = exempt.select(F.col(key).alias("_key")).distinct().withColumn("_safe", F.lit(True))
        rows = rows.join(ids, F.col(key) == F.col("_key"), "left").drop("_key")
        keep = keep | F.coalesce("_safe", F.lit(False))
    return rows.withColumn("keep", keep).drop("_nth", "_safe", "_young", *[f"_o{k}" for k in range(len(order))])


def _among_first(df: DataFrame, of: Column, group: Sequence[str], order: Sequence[str], by: Sequence[Column], n: int) -> DataFrame:
    """Adds `_first`: the row is among the first n of its group's rows for which `of` holds. Each task hands on n rows of a
    group at most (Spark's group limit, for n up to spark.sql.optimizer.windowGroupLimitThreshold), and rows find
    themselves among them by group and order together, so a hot group isn't one task."""
    names = [*group, *order]
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(*by))
    first = df.filter(of).select(*names).withColumn("_nth", nth).filter(F.col("_nth") <= n)
    first = first.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(names)]).distinct().withColumn("_in", F.lit(True))
    rows = df.join(first, [F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(names)], "left")
    return rows.select(*df.columns, (of & F.coalesce("_in", F.lit(False))).alias("_first"))


def snapshot_retention(df: DataFrame, closed: str, id_col: str, now: int, days: int, keep: int, group: Sequence[str]) -> DataFrame:
    """Which restore points may go: adds `eligible` and `reasons`. The newest `keep` of a group by (closed, id) stay; a
    point closed after now - days stays (strictly after); one that never closed stays. A hot group
    is spread out (see `_among_first`)."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col(closed).isNull(), "not_closed"),
            F.when(F.col(closed) > now - days * 86400, "retention_period_not_elapsed"),
            F.when(F.col(closed).isNotNull() & F.col("_first"), "retained_by_keep_last"),
        )
    )
    rows = _among_first(df, F.lit(True), group, [closed, id_col], [F.desc_nulls_last(closed), F.desc(id_col)], keep)
    return rows.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0).drop("_first")


def first_free(pool: DataFrame, claims: DataFrame, requests: DataFrame, group: str, unit: str, order: str, wanted: str) -> DataFrame:
    """For each request, the first `wanted` unclaimed units of its group in pool order, sorted; null if there are fewer.

    pool: group, unit, order; claims: group, unit; requests: group, wanted (one row per group)."""
    free = pool.join(claims.select(group, unit).distinct(), [group, unit], "left_anti")
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order, unit))
    some = free.withColumn("_nth", nth).join(requests, group).filter(F.col("_nth") <= F.col(wanted))
    picked = some.groupBy(group).agg(F.sort_array(F.collect_list(unit)).alias("_units"))
    out = requests.join(picked, group, "left")
    return out.select(*requests.columns, F.when(F.size("_units") == F.col(wanted), F.col("_units")).alias("units"))


def generation_gaps(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Keys whose versions aren't 1..n once each: `n`, `newest`, `gap_at` (the first version out of step)."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(version))
    rows = df.select(*keys, F.col(version).alias("_v"), nth.alias("_nth"))
    gap = F.min(F.when(F.col("_v") != F.col("_nth"), F.col("_v")))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("_v").alias("newest"), gap.alias("gap_at")).filter("gap_at is not null")


def last_points(df: DataFrame, key: str, order: Sequence[str], value: str, k: int) -> DataFrame:
    """The last k values of each key in order, oldest first, with their span (max - min)."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*_desc(order)))
    some = df.withColumn("_nth", nth).filter(F.col("_nth") <= k)
    points = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_nth")).alias("n"), F.col(value).alias("v")))), lambda x: x["v"])
    out = some.groupBy(key).agg(points.alias("points"), F.count("*").alias("n_points"))
    return out.withColumn("span", F.array_max("points") - F.array_min("points"))


def fifo_head(queue: DataFrame, busy: DataFrame, group: str, order: Sequence[str], ready: str, now: int) -> DataFrame:
    """The oldest waiting row of each group, if the group has no other work (`busy`) and the row's time has come."""
    return latest_first(queue, group, order).filter(F.col(ready) <= now).join(busy.select(group).distinct(), group, "left_anti")


def latest_first(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def revision_counter(df: DataFrame, key: str, order: Sequence[str], watched: Sequence[str]) -> DataFrame:
    """Adds `revision`: how many rows up to this one differ from the one before in a watched column (nulls equal)."""
    rows = running(df, [key], order, before={"_prior": F.struct(*watched)})
    changed = F.when(F.col("_prior").isNull() | F.struct(*watched).eqNullSafe(F.col("_prior")), 0).otherwise(1)
    return running(rows, [key], order, sums={"revision": changed}).drop("_prior")


def retry_lineage(df: DataFrame, root: str, order: Sequence[str], queued: str) -> DataFrame:
    """Adds `round` (from 0 at the root) and `first_queued` to retries that carry their root's id."""
    w = Window.partitionBy(root).orderBy(*order)
    return df.withColumn("round", F.row_number().over(w) - 1).withColumn("first_queued", F.first(queued).over(w))


def unresolved_owners(owners: DataFrame, events: DataFrame, owner: str, order: Sequence[str], kind: str, terminal: Sequence[str]) -> DataFrame:
    """Owners whose newest event isn't terminal; one without events is unknown and so unresolved."""
    last = events.groupBy(owner).agg(F.max_by(kind, F.struct(*order)).alias("last_kind"))
    out = owners.join(last, owner, "left").withColumn("last_kind", F.coalesce("last_kind", F.lit("unknown")))
    return out.filter(~F.col("last_kind").isin(*terminal))


def card_states(df: DataFrame, key: str, order: Sequence[str], sample: str) -> DataFrame:
    """Replay of each card's debounce state: adds `state` and `dispatchable` after each sample (see card_state).

    A card has a few dozen states at most, so a range of its samples is a map from states to states: a card with half of
    all samples is spread over tasks (see scans.stepped). A null key is a card of its own. The order must end in a unique
    column.
    """
    states = reachable()
    rows = stepped(df, key, order, sample, states, lambda card, s: advance(card, s)[0], "_card")
    name = F.element_at(F.array(*[F.lit(c.state) for c in states]), F.col("_card") + 1)
    return rows.select(*df.columns, name.alias("state"), (F.col("_card") == 0).alias("dispatchable"))
