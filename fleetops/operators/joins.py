"""Joins of job records with one another: details, producers, conflicts, receipts, timelines.

Small sides are left to Spark's own size check; no side is broadcast by hint. AQE splits skewed keys. A null key never
matches unless an operator says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetops.operators.scans import running
from fleetops.operators.windows import latest


def latest_join(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Rows at their key's greatest version, by an equi join to the aggregate (all of them if the version repeats)."""
    top = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(version).alias("_top"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col(version) == F.col("_top")]
    return df.join(top, on).select(*df.columns)


def job_detail(jobs: DataFrame, batches: DataFrame, tasks: DataFrame, batch: str, task_keys: Sequence[str]) -> DataFrame:
    """Each job with its batch (required) and its spec (if there is one)."""
    return jobs.join(batches, batch).join(tasks, list(task_keys), "left")


def execution_browse(jobs: DataFrame, key: str, facts: dict[str, DataFrame], phases: Sequence[str]) -> DataFrame:
    """Jobs with any number of optional one-to-one facts; `phase` is the first known of the given columns. A missing
    table is passed as an empty frame."""
    out = jobs
    for df in facts.values():
        out = out.join(df, key, "left")
    return out.withColumn("phase", F.coalesce(*phases))


def exists_filter(df: DataFrame, other: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    """Rows with a match in other; on may be a condition between columns of both."""
    return df.join(other, on if isinstance(on, Column) else list(on), "left_semi")


def not_exists_filter(df: DataFrame, other: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    """Rows without a match in other; a null key has none."""
    return df.join(other, on if isinstance(on, Column) else list(on), "left_anti")


def exempt_delete(df: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Rows that may be deleted: all but those whose key is in keep. Null keys may be deleted (NOT IN would lose them)."""
    return df.join(keep.select(key).distinct(), key, "left_anti")


def match_bindings(bindings: DataFrame, current: DataFrame, keys: Sequence[str], digest: str, fingerprint: str) -> DataFrame:
    """Adds `matches` (how many current rows have the keys) and `bound` (just one, of the same digest and, nulls equal,
    the same fingerprint). current: keys, digest, fingerprint."""
    now = current.select(*keys, F.struct(F.col(digest).alias("d"), F.col(fingerprint).alias("f")).alias("_now"))
    now = now.groupBy(*keys).agg(F.count("*").alias("_n"), F.first("_now").alias("_now"))
    out = bindings.join(now, list(keys), "left").withColumn("matches", F.coalesce("_n", F.lit(0)))
    same = (F.col("matches") == 1) & (F.col(digest) == F.col("_now.d")) & F.col(fingerprint).eqNullSafe(F.col("_now.f"))
    return out.withColumn("bound", F.coalesce(same, F.lit(False))).drop("_n", "_now")


def recorded_clear(bindings: DataFrame, jobs: DataFrame, attempts: DataFrame, sessions: DataFrame, keys: Sequence[str], job: str, status: str, phase: str) -> DataFrame:
    """Bindings whose task has no running or interrupted sibling, no attempt still open, no session on record."""
    out = bindings.join(jobs.filter(F.col(status).isin("running", "interrupted")).select(*keys).distinct(), list(keys), "left_anti")
    out = out.join(attempts.filter(~F.coalesce(F.col(phase) == "exited", F.lit(False))).select(job).distinct(), job, "left_anti")
    return out.join(sessions.select(job).distinct(), job, "left_anti")


def co_runners(bridge: DataFrame, peaks: DataFrame, card: str, job: str, size: str, profile: str, peak: str) -> DataFrame:
    """For each job on a card the other jobs there, with what they declared and their measured peak if one is known.

    A pair for each two jobs that share a card is the result asked for; a card runs few jobs at once."""
    left = bridge.select(card, F.col(job).alias("job"))
    right = bridge.join(peaks, profile, "left").select(card, F.col(job).alias("other"), F.col(size).alias("declared"), F.col(peak).alias("measured"))
    return left.join(right, card).filter("job <> other").withColumn("over", F.col("measured") > F.col("declared"))


def candidates(requests: DataFrame, cards: DataFrame, fits: Column, group: str, wants: Sequence[str]) -> DataFrame:
    """Every kind of request (its group and what it `wants`) against every card of the group, with `allowed` (null where
    unknown) and `requests` (how many are of that kind). Requests that want the same are judged alike, so the rows grow
    with the kinds, not with the requests; these find their verdicts by group and wants. An equi join on the group (a
    node, a pool): an unrestricted product of requests and cards isn't offered."""
    kinds = requests.groupBy(group, *wants).agg(F.count("*").alias("requests"))
    return kinds.join(cards, group).withColumn("allowed", fits)


def attribute_pids(samples: DataFrame, topology: DataFrame, owners: DataFrame, sample: str, uuid: str, pid: str) -> DataFrame:
    """Each process with its card and owning job; `indeterminate` marks all of a sample in which a uuid is unknown.

    topology: uuid, card; owners: pid, job. An unowned process has a null job."""
    out = samples.join(topology, uuid, "left").join(owners, pid, "left")
    unknown = out.groupBy(sample).agg(F.bool_or(F.col("card").isNull()).alias("indeterminate"))
    return out.join(unknown, sample)


def topology_stable(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """stable for each key of either capture: the same rows, counting repeats, in both."""
    side = lambda df, n: df.groupBy(key, *fields).agg(F.count("*").alias("_n")).withColumn("_n", F.col("_n") * n)
    both = side(before, 1).unionByName(side(after, -1)).groupBy(key, *fields).agg(F.sum("_n").alias("_n"))
    return both.groupBy(key).agg(F.bool_and(F.col("_n") == 0).alias("stable"))


def latest_producer(consumers: DataFrame, jobs: DataFrame, project: str, task: str, id_col: str, finished: str, row_seq: str, fingerprint: str, as_of: str | None = None) -> DataFrame:
    """For each consumer the newest successful job of the same project and task other than itself: `producer` and
    `producer_fingerprint`. A null project matches nothing. With as_of only jobs finished by that column's time count;
    a consumer must then not have finished itself by that time.

    Without as_of the two newest of each key are enough (one may be the consumer itself), so the join is with at most
    two rows a key. With it, consumers and producers are merged in time order and the last producer is carried along, over
    ranges of a hot key too (`running`)."""
    good = jobs.filter(F.col(project).isNotNull() & F.col(fingerprint).isNotNull())
    if as_of is None:
        w = Window.partitionBy(project, task).orderBy(F.desc_nulls_last(finished), F.desc(row_seq))
        two = good.withColumn("_nth", F.row_number().over(w)).filter("_nth <= 2")
        two = two.groupBy(project, task).agg(F.sort_array(F.collect_list(F.struct(F.col("_nth"), F.col(id_col).alias("id"), F.col(fingerprint).alias("f")))).alias("_two"))
        out = consumers.join(two, [project, task], "left")
        best = F.try_element_at(F.filter("_two", lambda x: x["id"] != F.col(id_col)), F.lit(1))
        return out.withColumn("producer", best["id"]).withColumn("producer_fingerprint", best["f"]).drop("_two")
    made = good.select(F.col(project).alias("_p"), F.col(task).alias("_t"), F.col(finished).alias("_at"), F.lit(0).alias("_side"), F.struct(F.col(id_col).alias("id"), F.col(fingerprint).alias("f")).alias("_made"), F.lit(None).cast(consumers.select(F.struct(*consumers.columns).alias("s")).schema["s"].dataType).alias("_row"), F.col(row_seq).alias("_seq"))
    asked = consumers.select(F.col(project).alias("_p"), F.col(task).alias("_t"), F.col(as_of).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(made.schema["_made"].dataType).alias("_made"), F.struct(*consumers.columns).alias("_row"), F.lit(None).cast("long").alias("_seq"))
    newest = F.when(F.col("_side") == 0, F.struct("_at", "_side", "_seq", "_made"))
    out = running(made.unionByName(asked), ["_p", "_t"], ["_at", "_side", "_seq"], maxima={"_last": newest}).filter("_side = 1")
    out = out.withColumn("_last", F.col("_last._made"))
    known = F.col("_p").isNotNull()
    return out.select("_row.*", F.when(known, F.col("_last.id")).alias("producer"), F.when(known, F.col("_last.f")).alias("producer_fingerprint"))


def same_name_conflict(batches: DataFrame, name: str, id_col: str, status: str, terminal: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds `conflict`: the newest other batch of the same name that hasn't ended. At most two rows a name are joined."""
    w = Window.partitionBy(name).orderBy(*[F.desc(c) for c in order])
    open_ = batches.filter(~F.col(status).isin(*terminal)).withColumn("_nth", F.row_number().over(w)).filter("_nth <= 2")
    two = open_.groupBy(name).agg(F.sort_array(F.collect_list(F.struct("_nth", F.col(id_col).alias("id")))).alias("_two"))
    out = batches.join(two, name, "left")
    return out.withColumn("conflict", F.try_element_at(F.filter("_two", lambda x: x["id"] != F.col(id_col)), F.lit(1))["id"]).drop("_two")


def precondition_check(requests: DataFrame, actual: DataFrame, key: str, expected: dict[str, str]) -> DataFrame:
    """Adds `reason`: not_found, or the first column of `expected` (request column to actual column) that differs, nulls
    equal; null if all hold. A null expectation isn't checked."""
    now = actual.select(F.col(key), F.struct(*[F.col(c).alias(f"_{c}") for c in dict.fromkeys(expected.values())]).alias("_now"))
    out = requests.join(now, key, "left")
    checks = [F.when(F.col(e).isNotNull() & ~F.col(e).eqNullSafe(F.col(f"_now._{a}")), f"{a}_changed") for e, a in expected.items()]
    return out.withColumn("reason", F.coalesce(F.when(F.col("_now").isNull(), "not_found"), *checks)).drop("_now")


def receipt_lookup(ids: DataFrame, operations: DataFrame, submissions: DataFrame, key: str, value: str) -> DataFrame:
    """Adds `found` (operation, submission, conflict if both, not_found) and `receipt`."""
    side = lambda df, c: df.groupBy(key).agg(F.min(value).alias(c))
    out = ids.join(side(operations, "_o"), key, "left").join(side(submissions, "_s"), key, "left")
    o, s = F.col("_o").isNotNull(), F.col("_s").isNotNull()
    found = F.when(o & s, "conflict").when(o, "operation").when(s, "submission").otherwise("not_found")
    return out.withColumn("found", found).withColumn("receipt", F.when(~(o & s), F.coalesce("_o", "_s"))).drop("_o", "_s")


def resolve_ref(refs: DataFrame, batches: DataFrame, ref: str, id_col: str, name: str, order: Sequence[str]) -> DataFrame:
    """Adds `resolved`: the batch with that id, else the newest of that name, else null. Ids are compared as text."""
    by_id = batches.select(F.col(id_col).cast("string").alias(ref), F.col(id_col).alias("_id"))
    by_name = latest(batches, [name], order).select(F.col(name).alias(ref), F.col(id_col).alias("_named"))
    return refs.join(by_id, ref, "left").join(by_name, ref, "left").withColumn("resolved", F.coalesce("_id", "_named")).drop("_id", "_named")


def reservation_select(cards: DataFrame, reservations: DataFrame, now: int, max_age: int, modes: Sequence[str]) -> DataFrame:
    """Reservations against the cards they name: `reasons` and `usable`.

    cards: card, uuid; reservations: reservation, card, uuid, mode, at. A reservation must name an existing card by
    index and uuid, be neither stale nor in the future, have an allowed mode, and be the only one for its card."""
    real = cards.select("card", F.col("uuid").alias("_uuid"))
    out = reservations.join(real, "card", "left").withColumn("_n", F.count("*").over(Window.partitionBy("card")))
    age = F.lit(now) - F.col("at")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_uuid").isNull(), "no_such_card"),
            F.when(F.col("_uuid") != F.col("uuid"), "uuid_differs"),
            F.when(age.isNull() | (age < 0) | (age > max_age), "not_fresh"),
            F.when(F.col("_n") > 1, "used_twice"),
            F.when(~F.coalesce(F.col("mode").isin(*modes), F.lit(False)), "mode"),
        )
    )
    return out.withColumn("reasons", reasons).withColumn("usable", F.size("reasons") == 0).drop("_uuid", "_n")


def rev_drift(jobs: DataFrame, current: DataFrame, project: str, rev: str, current_rev: str) -> DataFrame:
    """Jobs whose code revision differs from their project's current one; unknown on either side is no drift."""
    return jobs.join(current, project).filter(F.col(rev) != F.col(current_rev))


def smoke_gate(jobs: DataFrame, trials: DataFrame, receipts: DataFrame, trial: str, binding: str) -> DataFrame:
    """Adds `open`: the job's named trial is done with rc 0, has the same binding, and its receipt says ok.

    trials: trial, trial_status, trial_rc, trial_binding; receipts: trial, ok. Anything missing keeps the gate shut."""
    out = jobs.join(trials, trial, "left").join(receipts, trial, "left")
    gate = (F.col("trial_status") == "done") & (F.col("trial_rc") == 0) & (F.col("trial_binding") == F.col(binding)) & F.col("ok")
    return out.select(*jobs.columns, F.coalesce(gate, F.lit(False)).alias("open"))


#: Which statuses each way of running again takes up.
RETRY = ("blocked", "cancelled", "timed_out", "failed")
RESUBMIT = ("failed", "blocked", "timed_out", "interrupted")


def rerun_targets(jobs: DataFrame, attempts: DataFrame, keys: Sequence[str], version: str, status: str, job: str, phase: str, mode: str = "retry") -> DataFrame:
    """Newest jobs that qualify, with `reason` (active_sibling, attempt_open, or null) and `next_version`.

    mode: retry, resubmit, or all (any status but running and pending)."""
    w = Window.partitionBy(*keys)
    rows = jobs.withColumn("_top", F.max(version).over(w)).withColumn("_active", F.max((F.col(status) == "running").cast("int")).over(w))
    takes = F.col(status).isin(*RETRY) if mode == "retry" else F.col(status).isin(*RESUBMIT) if mode == "resubmit" else ~F.col(status).isin("running", "pending")
    rows = rows.filter((F.col(version) == F.col("_top")) & takes)
    open_ = attempts.filter(F.col(phase) != "exited").select(job).distinct().withColumn("_open", F.lit(True))
    out = rows.join(open_, job, "left").withColumn("reason", F.when(F.col("_active") == 1, "active_sibling").when(F.col("_open"), "attempt_open"))
    return out.withColumn("next_version", F.col("_top") + 1).select(*jobs.columns, "reason", "next_version")


def task_timeline(jobs: DataFrame, refs: DataFrame, batches: DataFrame, batch: str, name: str, order: Sequence[str], started: str, finished: str) -> DataFrame:
    """All versions of the tasks of the batches that refs (column ref) name, with seconds run (null while running)."""
    found = resolve_ref(refs, batches.withColumnRenamed(batch, "_batch"), "ref", "_batch", name, order).filter("resolved is not null")
    out = jobs.join(found.select("ref", F.col("resolved").alias(batch)), batch)
    return out.withColumn("seconds", F.col(finished) - F.col(started))


def diagnose(jobs: DataFrame, incidents: DataFrame, current: DataFrame, job: str, project: str, rev: str, current_rev: str, order: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Unhealthy jobs with their newest incident of the given kinds, if any, and whether the code has moved on."""
    last = incidents.filter(F.col("kind").isin(*kinds)).groupBy(job).agg(F.max_by(F.struct(F.col("kind"), *order), F.struct(*order)).alias("incident"))
    out = jobs.join(last, job, "left").join(current, project, "left")
    return out.withColumn("drifted", F.coalesce(F.col(rev) != F.col(current_rev), F.lit(False))).drop(current_rev)


def dependency_facts(names: DataFrame, exact: DataFrame, batches: DataFrame, bindings: DataFrame, id_col: str, name: str, order: Sequence[str]) -> DataFrame:
    """A row for each declared dependency: batch, kind (name or exact), source, resolved, satisfied.

    names: batch, source (a name; resolved to its newest batch, satisfied once that is done); exact: batch, source (an
    id; satisfied if its frozen binding still holds). batches: id, name, order, status; bindings: source, bound."""
    newest = latest(batches, [name], order).select(F.col(name).alias("source"), F.col(id_col).alias("resolved"), (F.col("status") == "done").alias("_ok"))
    by_name = names.join(newest, "source", "left").select("batch", F.lit("name").alias("kind"), "source", "resolved", F.coalesce("_ok", F.lit(False)).alias("satisfied"))
    known = batches.select(F.col(id_col).cast("string").alias("source"), F.col(id_col).alias("resolved"))
    by_id = exact.join(known, "source", "left").join(bindings, "source", "left")
    return by_name.unionByName(by_id.select("batch", F.lit("exact").alias("kind"), "source", "resolved", F.coalesce("bound", F.lit(False)).alias("satisfied")))
