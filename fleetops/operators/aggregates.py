"""Counts, verdicts, budgets and digests over job records. Each groups once; counts are combined before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Which statuses count as success, as a failure that settles a batch, as a failure to report, as an end.
SUCCESS = ("done", "skip")
SETTLING_FAILURES = ("failed", "blocked", "cancelled", "timed_out")
REPORTED_FAILURES = (*SETTLING_FAILURES, "interrupted")
ENDED_ATTEMPT = ("exited", "not_started")


def batch_progress(newest: DataFrame, batch: str, status: str) -> DataFrame:
    """total, finished (done or skip) and "finished/total" of each batch, from its tasks' newest versions."""
    out = newest.groupBy(batch).agg(F.count("*").alias("total"), F.count_if(F.col(status).isin(*SUCCESS)).alias("finished"))
    return out.withColumn("progress", F.concat_ws("/", F.col("finished").cast("string"), F.col("total").cast("string")))


def running_by(df: DataFrame, key: Column | str, status: str, only: Column | None = None, running: str = "running") -> DataFrame:
    """Running rows by key; key may be an expression such as coalesce(job project, batch project)."""
    some = df.filter(F.col(status) == running)
    some = some if only is None else some.filter(only)
    return some.groupBy((F.col(key) if isinstance(key, str) else key).alias("key")).agg(F.count("*").alias("running"))


def card_usage(cards: DataFrame, bridge: DataFrame, card: str, capacity: str, size: str) -> DataFrame:
    """used (0 for none), jobs, and over_cap for every card; an unknown capacity or size leaves over_cap null."""
    used = bridge.groupBy(card).agg(F.sum(size).alias("_used"), F.count("*").alias("_jobs"), F.bool_or(F.col(size).isNull()).alias("_unknown"))
    out = cards.join(used, card, "left")
    total = F.coalesce("_used", F.lit(0))
    over = F.when(F.coalesce("_unknown", F.lit(False)), F.lit(None).cast("boolean")).otherwise(total > F.col(capacity))
    return out.select(*cards.columns, total.alias("used"), F.coalesce("_jobs", F.lit(0)).alias("jobs"), over.alias("over_cap"))


def card_assignments(bridge: DataFrame, card: str, fields: Sequence[str]) -> DataFrame:
    """The jobs on each card as an array of structs, sorted by the fields in turn."""
    return bridge.groupBy(card).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("assignments"))


def project_usage(projects: DataFrame, jobs: DataFrame, project: str, status: str, quota: str, enabled: str) -> DataFrame:
    """used, quota and access of every project: disabled, unlimited (no quota or 0), full, or free."""
    used = running_by(jobs, project, status).withColumnRenamed("key", project)
    out = projects.join(used, project, "left").withColumn("used", F.coalesce("running", F.lit(0))).drop("running")
    limit = F.coalesce(F.col(quota), F.lit(0))
    access = F.when(~F.coalesce(F.col(enabled), F.lit(False)), "disabled").when(limit <= 0, "unlimited").when(F.col("used") >= limit, "full").otherwise("free")
    return out.withColumn("access", access)


def memory_reserved(jobs: DataFrame, request: Column, limit: Column, group: Sequence[str]) -> DataFrame:
    """reserved and unreadable of each group: a request that can't be read counts as the whole limit."""
    return jobs.groupBy(*group).agg(F.sum(F.coalesce(request, limit)).alias("reserved"), F.count_if(request.isNull()).alias("unreadable"))


def cpu_reserved(jobs: DataFrame, frozen: Column, declared: Column, default: Column, group: Sequence[str]) -> DataFrame:
    """A frozen reservation if there is one, else what is declared, else the default; null if one is unknown (all null)."""
    cpus = F.coalesce(frozen, declared, default)
    out = jobs.groupBy(*group).agg(F.sum(cpus).alias("_cpus"), F.bool_or(cpus.isNull()).alias("_unknown"))
    return out.select(*group, F.when(~F.col("_unknown"), F.col("_cpus")).alias("cpus"))


def storage_reserved(jobs: DataFrame, bindings: str, id_col: str) -> DataFrame:
    """bytes and inodes by filesystem from each job's bindings (array of structs filesystem, bytes, inodes). A job whose
    bindings are missing or don't name one has a row of its own for what it wants there: a null filesystem and its id as
    `unresolved`, which is null otherwise. So no group holds them all."""
    each = jobs.select(id_col, F.explode_outer(bindings).alias("_b")).select(id_col, "_b.*")
    lost = F.when(F.col("filesystem").isNull(), F.col(id_col)).alias("unresolved")
    return each.groupBy("filesystem", lost).agg(F.sum("bytes").alias("bytes"), F.sum("inodes").alias("inodes"))


def storage_check(paths: DataFrame, used: DataFrame, floor_control: int, floor_task: int) -> DataFrame:
    """By request and filesystem: needed bytes, the least available, reasons and unknowns, allowed.

    paths: request, filesystem, role (control or task), available, readonly, wanted. On one filesystem the larger of
    its roles' floors holds, and the request is charged once, if a task path lies there. used: filesystem, bytes.
    Allowed is null while something is unknown and nothing fails.
    """
    task = F.col("role") == "task"
    per = paths.groupBy("request", "filesystem").agg(
        F.min("available").alias("available"),
        F.bool_or("readonly").alias("readonly"),
        F.bool_or(F.col("available").isNull()).alias("_blank"),
        F.max(F.when(task, floor_task).otherwise(floor_control)).alias("_floor"),
        F.max(F.when(task, F.col("wanted")).otherwise(0)).alias("_wanted"),
    )
    per = per.join(used.select("filesystem", F.col("bytes").alias("_used")), "filesystem", "left")
    need = F.col("_floor") + F.col("_wanted") + F.coalesce("_used", F.lit(0))
    reasons = F.array_compact(F.array(F.when(F.col("available") < F.col("needed"), "disk_space"), F.when(F.col("readonly"), "read_only")))
    unknowns = F.array_compact(F.array(F.when(F.col("filesystem").isNull(), "filesystem"), F.when(F.col("_blank"), "available")))
    out = per.withColumn("needed", need).withColumn("reasons", reasons).withColumn("unknowns", unknowns)
    allowed = F.when(F.size("reasons") > 0, False).when(F.size("unknowns") > 0, F.lit(None).cast("boolean")).otherwise(True)
    return out.select("request", "filesystem", "needed", "available", "reasons", "unknowns", allowed.alias("allowed"))


def batch_event(jobs: DataFrame, batch: str, status: str, started: str, finished: str, rev: str, row_seq: str, id_col: str) -> DataFrame:
    """One notification row per batch: counts by status (map), the first revision by row order, first start, last end,
    minutes (rounded half to even) and the failed jobs as sorted structs."""
    counts = jobs.groupBy(batch, status).agg(F.count("*").alias("_n"))
    counts = counts.groupBy(batch).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(status), F.col("_n"))))).alias("counts"))
    failure = F.when(F.col(status).isin(*REPORTED_FAILURES), F.struct(F.col(id_col), F.col(status)))
    whole = jobs.groupBy(batch).agg(
        F.min_by(rev, F.when(F.col(rev).isNotNull(), F.col(row_seq))).alias("first_rev"),
        F.min(started).alias("started"),
        F.max(finished).alias("finished"),
        F.sort_array(F.collect_list(failure)).alias("failures"),
    )
    minutes = F.bround((F.col("finished") - F.col("started")) / 60).cast("long")
    return whole.withColumn("minutes", minutes).join(counts, batch)


def settle_batches(batches: DataFrame, newest: DataFrame, stale: DataFrame, unresolved: DataFrame, failed_checks: DataFrame, batch: str, status: str, policy: str) -> DataFrame:
    """Adds `verdict` (done, blocked or leave) to batches; the first rule that applies decides.

    newest: newest version of each task (batch, task status); stale, unresolved, failed_checks: batches with an older
    version running, an attempt that hasn't ended, an output that fails its check (column batch). A batch without
    jobs, or one neither active nor blocked, is left. Under continue_independent an active batch waits until every task
    has ended; under freeze the first failure blocks it.
    """
    s = F.col("_status")
    ended = s.isin(*SUCCESS, *SETTLING_FAILURES)
    sums = newest.select(F.col(batch).alias("_b"), F.col(status).alias("_status")).groupBy("_b").agg(
        F.count("*").alias("_n"), F.bool_and(s.isin(*SUCCESS)).alias("_ok"), F.bool_and(ended).alias("_ended"), F.bool_or(s.isin(*SETTLING_FAILURES)).alias("_bad")
    )
    out = batches.join(sums, F.col(batch) == F.col("_b"), "left").drop("_b")
    for name, df in (("_stale", stale), ("_open", unresolved), ("_unfit", failed_checks)):
        flags = df.select(F.col(batch).alias("_b")).distinct().withColumn(name, F.lit(True))
        out = out.join(flags, F.col(batch) == F.col("_b"), "left").drop("_b").withColumn(name, F.coalesce(name, F.lit(False)))
    active, wait = F.col("status") == "active", F.col("_stale") | F.col("_open")
    verdict = (
        F.when(~F.col("status").isin("active", "blocked") | (F.coalesce("_n", F.lit(0)) == 0), "leave")
        .when(active & (F.col(policy) == "continue_independent") & (~F.col("_ended") | wait), "leave")
        .when(F.col("_ok") & F.col("_unfit"), F.when(active, "blocked").otherwise("leave"))
        .when(F.col("_ok") & wait, "leave")
        .when(F.col("_ok"), "done")
        .when(F.col("_bad") & active, "blocked")
        .otherwise("leave")
    )
    return out.withColumn("verdict", verdict).select(*batches.columns, "verdict")


def batch_successful(newest_batches: DataFrame, newest: DataFrame, stale: DataFrame, batch: str, status: str) -> DataFrame:
    """For the newest batch of each name: successful if it has jobs, all newest ones are done or skip, none is stale."""
    sums = newest.groupBy(batch).agg(F.bool_and(F.col(status).isin(*SUCCESS)).alias("_ok"))
    old = stale.select(batch).distinct().withColumn("_stale", F.lit(True))
    out = newest_batches.join(sums, batch, "left").join(old, batch, "left")
    good = F.coalesce("_ok", F.lit(False)) & F.col("_stale").isNull()
    return out.select(*newest_batches.columns, good.alias("successful"))


#: Lanes of a digest, 64 bits each.
LANES = 8


def multiset_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows and digest (LANES times 16 hex digits) of a table: independent of order, counting duplicates, of one width at
    any size.

    Each row gives two SHA-256 hashes, whose eight parts are summed by lane modulo 2**64: each task hands on one row of
    sums. So the digest of two tables together is their digests' sum by lane, and rows that come or go are added or taken
    away (`digest_sum`). It finds rows that were lost, repeated or changed by accident; it isn't made for somebody who
    chooses rows in order to fool it. An empty table has the digest zero."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    rows = df.select(F.concat(*[F.sha2(F.concat(F.lit(f"{k}|"), text), 256) for k in range(LANES // 4)]).alias("h"))
    lane = lambda k: F.conv(F.substring("h", 16 * k + 1, 16), 16, 10).cast("decimal(20,0)")
    sums = rows.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(lane(k)), F.lit(0)).alias(f"l{k}") for k in range(LANES)])
    return sums.select("rows", F.concat(*[_lane_text(F.col(f"l{k}")) for k in range(LANES)]).alias("digest"))


def _wrap() -> Column:
    return F.lit(str(1 << 64)).cast("decimal(38,0)")


def _lane_text(total: Column) -> Column:
    rest = F.pmod(total.cast("decimal(38,0)"), _wrap()).cast("string")
    return F.lpad(F.lower(F.conv(rest, 10, 16)), 16, "0")


def digest_sum(a: Column, b: Column, take: bool = False) -> Column:
    """The digest of the rows of both tables, or (take) of the first without those of the second."""
    lane = lambda c, k: F.conv(F.substring(c, 16 * k + 1, 16), 16, 10).cast("decimal(38,0)")
    both = lambda k: lane(a, k) + (_wrap() - lane(b, k) if take else lane(b, k))
    return F.concat(*[_lane_text(both(k)) for k in range(LANES)])


def evidence_size(events: DataFrame, owner: str, payload: str, budget: int) -> DataFrame:
    """events, bytes and largest payload of each owner, and whether the bytes pass the budget."""
    size = F.coalesce(F.octet_length(payload), F.lit(0)).cast("long")
    out = events.groupBy(owner).agg(F.count("*").alias("events"), F.sum(size).alias("bytes"), F.max(size).alias("largest"))
    return out.withColumn("over_budget", F.col("bytes") > budget)


def cpu_claims(assignments: DataFrame, frozen: DataFrame, owner: str, unit: str, units: str) -> DataFrame:
    """Claimed units of each owner, sorted, against its frozen binding: match, missing, unclaimed or differs."""
    got = assignments.groupBy(owner).agg(F.sort_array(F.collect_list(unit)).alias("claimed"))
    out = frozen.select(owner, F.sort_array(units).alias("bound")).join(got, owner, "full")
    verdict = F.when(F.col("bound").isNull(), "missing").when(F.col("claimed").isNull(), "unclaimed").when(F.col("bound") == F.col("claimed"), "match").otherwise("differs")
    return out.withColumn("verdict", verdict)


def record_counts(tables: dict[str, DataFrame], keys: Sequence[str], refused_if_any: Sequence[str]) -> DataFrame:
    """Rows of each related table by key, one column per table, and the sorted names of tables that forbid removal."""
    tagged = None
    for name, df in tables.items():
        one = df.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_table", F.lit(name))
        tagged = one if tagged is None else tagged.unionByName(one)
    out = tagged.groupBy(*keys).pivot("_table", list(tables)).agg(F.sum("_n")).fillna(0, list(tables))
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(F.col(t) > 0, F.lit(t)) for t in refused_if_any])))
    return out.withColumn("reasons", reasons)


def distinct_ids(df: DataFrame, id_col: str, cond: Column) -> DataFrame:
    """The distinct ids of the rows that meet the condition (null and false don't)."""
    return df.filter(cond).select(id_col).distinct()


def capacity_min(sources: DataFrame, group: str, value: str, cap: int) -> DataFrame:
    """limit (the least of the known sources and the cap) and reasons: sources_disagree; unknown (a source without a
    value), which leaves no limit."""
    out = sources.groupBy(group).agg(F.min(value).alias("_least"), F.count_distinct(value).alias("_kinds"), F.bool_or(F.col(value).isNull()).alias("_unknown"))
    reasons = F.array_compact(F.array(F.when(F.col("_kinds") > 1, "sources_disagree"), F.when(F.col("_unknown"), "unknown")))
    return out.select(group, F.when(~F.col("_unknown"), F.least("_least", F.lit(cap))).alias("limit"), reasons.alias("reasons"))


def incident_verdicts(incidents: DataFrame, id_col: str, payload: str) -> DataFrame:
    """Adds `codes`, what an incident's nested payload shows, in this order: external_memory (1 GiB and more outside
    our jobs) or else degraded; under_declared (peak over 1.3 times what was declared); neighbour_over (a neighbour's
    peak over 1.5 times its own and by over 2 GiB); no_slack (nothing external, use within 20 % of what was packed);
    and from 4 points on fast_climb (they span over a quarter of the card) or else flat (under 5 %, peak under 90 %)."""
    p = F.col(payload)
    external = F.aggregate(F.coalesce(p["external_mib"], F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    points = p["timeline_gib"]
    span, peak = F.array_max(points) - F.array_min(points), F.array_max(points)
    over = F.exists(p["neighbours"], lambda n: (n["peak"] > 1.5 * n["declared"]) & (n["peak"] - n["declared"] > 2))
    many = F.size(points) >= 4
    codes = F.array(
        F.when(external >= 1024, "external_memory").when(p["degraded"], "degraded"),
        F.when(p["peak"] > 1.3 * p["declared"], "under_declared"),
        F.when(over, "neighbour_over"),
        F.when((external == 0) & (F.abs(p["used"] - p["packed"]) <= 0.2 * p["packed"]), "no_slack"),
        F.when(many & (span > 0.25 * p["capacity"]), "fast_climb").when(many & (span < 0.05 * p["capacity"]) & (peak < 0.9 * p["capacity"]), "flat"),
    )
    return incidents.withColumn("codes", F.array_compact(codes))


def budget_check(requests: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """Adds `reasons`, all failing budgets in the given order, and `allowed`. A gate is true where its budget fails; a
    gate that is null is unknown and never counts as capacity: it is listed in `unknown`, and allowed is null."""
    failed = F.array_compact(F.array(*[F.when(g, F.lit(n)) for n, g in gates.items()]))
    unknown = F.array_compact(F.array(*[F.when(g.isNull(), F.lit(n)) for n, g in gates.items()]))
    out = requests.withColumn("reasons", failed).withColumn("unknown", unknown)
    allowed = F.when(F.size("reasons") > 0, False).when(F.size("unknown") > 0, F.lit(None).cast("boolean")).otherwise(True)
    return out.withColumn("allowed", allowed)


def activity(tables: dict[str, DataFrame]) -> DataFrame:
    """What still keeps the fleet busy: a row per table (already filtered to its open rows) with its count, 0 included."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("open")).select(F.lit(name).alias("source"), "open")
        out = one if out is None else out.unionByName(one)
    return out
