"""Predicates, reasons and states of job records: projections without a shuffle, unless they join another table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reasons(**checks: Column) -> Column:
    """The names of the checks that are true, in order; a null check says nothing."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))


def valid_identifier(c: Column) -> Column:
    """1 to 128 of A-Z a-z 0-9 . _ -, beginning with a letter or digit. Null is not valid."""
    return F.coalesce(c.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,127}\z"), F.lit(False))


def validate_specs(tasks: DataFrame, projects: DataFrame, known: Sequence[str]) -> DataFrame:
    """Adds `reasons` and `valid` to task specs.

    tasks: batch, task, project, mode, gpu, gpu_share, vram, retries, keys (array of the keys given). A batch needs a
    known project and mode mix; its task ids are valid and unique; gpu is 0 or 1; a share needs vram, which is finite
    and positive; retries aren't negative; keys outside `known` are refused. projects: project.
    """
    found = projects.select("project").distinct().withColumn("_known", F.lit(True))
    rows = tasks.join(found, "project", "left").withColumn("_same", F.count("*").over(Window.partitionBy("batch", "task")))
    vram = F.col("vram")
    why = reasons(
        project_missing=F.col("project").isNull(),
        project_unknown=F.col("project").isNotNull() & F.col("_known").isNull(),
        mode=~F.coalesce(F.col("mode") == "mix", F.lit(False)),
        task_id=~valid_identifier(F.col("task")),
        task_repeated=F.col("_same") > 1,
        gpu=~F.coalesce(F.col("gpu").isin(0, 1), F.lit(True)),
        share_without_vram=F.coalesce(F.col("gpu_share"), F.lit(False)) & vram.isNull(),
        vram=(vram <= 0) | F.isnan(vram.cast("double")) | (vram == float("inf")),
        retries=F.col("retries") < 0,
        unknown_key=F.size(F.array_except("keys", F.array(*[F.lit(k) for k in known]))) > 0,
    )
    return rows.withColumn("reasons", why).withColumn("valid", F.size("reasons") == 0).drop("_known", "_same")


RULE_KEYS = ("path", "min_bytes", "check", "has_key", "json_equals", "regex")


def validate_rules(rules: DataFrame, group: str, most: int = 64) -> DataFrame:
    """Adds `reasons` to output rules: group, rule (map<string,string>). Keys are known; path is relative and stays
    inside (no ..); min_bytes is a number not below 0; check is json; at most `most` rules in a group."""
    r, path = F.col("rule"), F.col("rule")["path"]
    size = F.expr("try_cast(rule['min_bytes'] as bigint)")
    out = rules.withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    why = reasons(
        unknown_key=F.size(F.array_except(F.map_keys(r), F.array(*[F.lit(k) for k in RULE_KEYS]))) > 0,
        path=path.isNull() | (path == "") | path.startswith("/") | F.array_contains(F.split(path, "/"), ".."),
        min_bytes=r["min_bytes"].isNotNull() & (size.isNull() | (size < 0)),
        check=r["check"].isNotNull() & (r["check"] != "json"),
        too_many=F.col("_n") > most,
    )
    return out.withColumn("reasons", why).drop("_n")


#: Variables that a job may not set; the loader's (LD_, DYLD_) are refused by their prefix.
BANNED_ENV = ("BASH_ENV", "ENV")


def refused_env(env: Column, banned: Sequence[str] = BANNED_ENV) -> Column:
    """The entries of a map that are refused: a name that isn't one, a banned name or one of the loader's own, a value
    that is null or holds a NUL. A scheduler that hands its own context to jobs in a variable bans that name as well."""
    bad = lambda k, v: ~k.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z") | k.isin(*banned) | k.rlike("^(LD_|DYLD_)") | v.isNull() | v.contains("\0")
    return F.map_filter(env, bad)


def resolve_templates(df: DataFrame, text: str, variables: DataFrame, id_col: str) -> DataFrame:
    """Adds `resolved` and `unresolved` (names, sorted): each {NAME} of the text is replaced by its value, once: braces
    that a value brings along stay as they are. A name without a value stays, too; a null text stays null.

    variables: name, value. Names are looked up by a join on those that occur, so the table may be of any size."""
    marks = r"\{([A-Za-z0-9_:.-]+)\}"
    names = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(marks), F.lit(1)))
    used = df.select(F.col(id_col).alias("_id"), F.explode(names).alias("name")).distinct()
    looked = used.join(variables.select("name", "value"), "name", "left").groupBy("_id").agg(
        F.collect_list(F.when(F.col("value").isNotNull(), F.struct("name", "value"))).alias("_known"),
        F.sort_array(F.collect_list(F.when(F.col("value").isNull(), F.col("name")))).alias("unresolved"),
    )
    out = df.join(looked, F.col(id_col) == F.col("_id"), "left")
    known = F.map_from_entries(F.coalesce("_known", F.array().cast("array<struct<name:string,value:string>>")))
    between = F.split(F.col(text), marks, -1)
    asked = F.regexp_extract_all(F.col(text), F.lit(marks), F.lit(1))
    filled = F.zip_with(between, asked, lambda b, name: F.concat(b, F.when(name.isNull(), "").otherwise(F.coalesce(known[name], F.concat(F.lit("{"), name, F.lit("}"))))))
    return out.withColumn("resolved", F.array_join(filled, "")).withColumn("unresolved", F.coalesce("unresolved", F.array().cast("array<string>"))).drop("_id", "_known")


def wait_reason(status: Column, gpu: Column, quota: Column, running: Column, enabled: Column, batch: Column, draining: Column, cpu_over: Column, memory_over: Column, published: Column) -> Column:
    """Why a job that shows as pending waits. A disabled project decides at once; else later of dependency (queued
    batch), batch_blocked and draining overwrite quota and dependency; cpu, host_memory and the published reason count
    only if nothing else does. cpu_over null means unknown, which holds a job back as well."""
    first = F.when(status == "waiting_quota", "quota").when(status == "waiting_dep", "dependency").when((gpu > 0) & (quota > 0) & (running >= quota), "quota")
    late = F.when(draining, "draining").when(batch == "queued", "dependency").when(batch != "active", "batch_blocked").otherwise(first)
    last = F.when(F.coalesce(cpu_over, F.lit(True)), "cpu").when(memory_over, "host_memory").when(published.isin("cpu", "host_memory", "gpu", "parallel"), published)
    return F.when((gpu > 0) & ~F.coalesce(enabled, F.lit(False)), "project_gpu_disabled").otherwise(F.coalesce(late, last))


def state_rank(status: Column) -> Column:
    """1 for batches that are over, 0 for the others: sorts open ones first."""
    return F.when(status.isin("done", "discarded", "cancelled"), 1).otherwise(0)


HISTORY = ("done", "skip", "failed", "blocked", "cancelled", "timed_out", "interrupted")


def history_filter(df: DataFrame, status: str, statuses: Sequence[str] = (), **equals: object) -> DataFrame:
    """Ended jobs, of the given statuses if any, and with the given values in other columns (None: any)."""
    out = df.filter(F.col(status).isin(*(statuses or HISTORY)) & F.col(status).isin(*HISTORY))
    for c, v in equals.items():
        out = out if v is None else out.filter(F.col(c) == F.lit(v))
    return out


def incident_filter(df: DataFrame, id_col: str, limit: int, **equals: object) -> DataFrame:
    """The newest incidents that have all the given values (None: any)."""
    for c, v in equals.items():
        df = df if v is None else df.filter(F.col(c) == F.lit(v))
    return df.orderBy(F.desc(id_col)).limit(limit)


def freshness(at: Column, now: Column | int, most: int) -> Column:
    """valid, stale, future or missing: a sample from the future is as bad as an old one."""
    age = F.lit(now) - at
    return F.when(at.isNull(), "missing").when(age < 0, "future").when(age > most, "stale").otherwise("valid")


def spec_field(spec: Column, path: str, kind: str, default: object = None) -> Column:
    """A field of a JSON spec: its value if it has the kind (a boolean is never a number), else the default. Text that
    isn't JSON gives null, not the default: an unreadable request is not a request for the default."""
    doc = F.try_parse_json(spec)
    v = F.try_variant_get(doc, path, "variant")
    is_bool = F.schema_of_variant(v) == "BOOLEAN"
    fits = is_bool if kind == "boolean" else ~is_bool
    value = F.when(v.isNotNull() & fits, F.try_variant_get(v, "$", kind))
    return F.when(doc.isNotNull(), F.coalesce(value, F.lit(default).cast(kind)))


def privileged_tokens(command: Column) -> Column:
    """Whether an argument's last path part is sudo, su or runuser."""
    return F.exists(command, lambda x: x.rlike(r"(^|/)(sudo|su|runuser)\z"))


def expand_sweep(df: DataFrame, matrix: str, most: int = 10_000) -> DataFrame:
    """One row per combination of a map of value lists: `combo` (map), `combo_no` (from 0) and `suffix`, keys in sorted
    order with the last one varying fastest. A row whose product passes `most` gives no rows but `too_many` = true;
    an empty map gives one empty combination."""
    keys = F.array_sort(F.map_keys(matrix))
    product = F.aggregate(F.map_values(matrix), F.lit(1).cast("long"), lambda n, v: F.least(n * F.size(v), F.lit(most + 1)))
    one = F.array(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))

    def grow(done: Column, key: Column) -> Column:
        values = F.element_at(F.col(matrix), key)
        return F.flatten(F.transform(done, lambda m: F.transform(values, lambda v: F.map_concat(m, F.map_from_arrays(F.array(key), F.array(v))))))

    rows = df.withColumn("too_many", product > most)
    combos = F.when(~F.col("too_many"), F.aggregate(keys, one, grow))
    rows = rows.select("*", F.posexplode_outer(combos).alias("combo_no", "combo"))
    suffix = F.array_join(F.transform(F.array_sort(F.map_keys("combo")), lambda k: F.element_at(F.col("combo"), k)), "_")
    return rows.withColumn("suffix", suffix)


def normalize_selectors(df: DataFrame, batch: str, selectors: str) -> DataFrame:
    """A row per exact selector with `reasons`: malformed (a part missing, a version below 1) or duplicate.

    selectors: array of structs instance, batch_id, task_id, version."""
    rows = df.select(batch, F.posexplode(selectors).alias("place", "s")).select(batch, "place", "s.*")
    same = F.count("*").over(Window.partitionBy(batch, "instance", "batch_id", "task_id", "version"))
    whole = F.col("instance").isNotNull() & valid_identifier(F.col("batch_id").cast("string")) & valid_identifier(F.col("task_id")) & (F.col("version") >= 1)
    return rows.withColumn("_same", same).withColumn("reasons", reasons(malformed=~F.coalesce(whole, F.lit(False)), duplicate=F.col("_same") > 1)).drop("_same")


def execution_summary(facts: Column) -> Column:
    """kind, phase, cleanup (confirmed, pending or unknown), uncertain (why) and replay_blocked of an execution's JSON
    facts: phase, backend, cleanup, exit_known."""
    get = lambda f, k: F.try_variant_get(F.try_parse_json(facts), f"$.{f}", k)
    phase = F.coalesce(get("phase", "string"), F.lit("unknown"))
    cleanup = F.when(get("cleanup", "string").isin("confirmed", "pending"), get("cleanup", "string")).otherwise("unknown")
    why = F.when(F.try_parse_json(facts).isNull(), "unreadable").when(phase == "unknown", "no_phase").when((phase == "exited") & ~F.coalesce(get("exit_known", "boolean"), F.lit(False)), "exit_unknown").when(cleanup == "unknown", "cleanup_unknown")
    blocked = why.isNotNull() | (cleanup != "confirmed") | (phase != "exited")
    return F.struct(F.coalesce(get("backend", "string"), F.lit("native")).alias("kind"), phase.alias("phase"), cleanup.alias("cleanup"), why.alias("uncertain"), blocked.alias("replay_blocked"))


def gpu_access(gpu: Column, enabled: Column, hard: Column, affinity: Column, pool: Column) -> Column:
    """Whether a request may have a card at all: a reason, or null. The project must be enabled and, if its affinity is
    hard, share a card with the pool."""
    return F.when(F.coalesce(gpu, F.lit(1)) <= 0, None).when(~F.coalesce(enabled, F.lit(False)), "project_gpu_disabled").when(F.coalesce(hard, F.lit(False)) & ~F.coalesce(F.arrays_overlap(affinity, pool), F.lit(False)), "no_card_in_pool")


def cleanup_due(cleanups: DataFrame, jobs: DataFrame, job: str, now: int, limit: int, order: Sequence[str]) -> DataFrame:
    """The first pending cleanups whose time has come and whose job isn't running."""
    idle = jobs.filter(F.col("status") != "running").select(job)
    return cleanups.filter((F.col("cleanup") == "pending") & (F.col("retry_after") <= now)).join(idle, job).orderBy(*order).limit(limit)


#: What the end of a log tells, the first that occurs.
LOG_CLASSES = {
    "oom": r"CUDA out of memory|OutOfMemoryError",
    "gpu_fault": r"(?U)\bXid\b|\bECC\b",
    "perm": r"PermissionError|Operation not permitted|EACCES",
}


def end_of(text: Column, n: int) -> Column:
    """The last n bytes of a text."""
    return F.substring(text.cast("binary"), -n, n).cast("string")


def log_classify(text: Column, tail_bytes: int = 4 << 20) -> Column:
    """oom, gpu_fault, perm or error, by the last tail_bytes of a log: a failure shows at its end. Null and empty logs are
    errors too."""
    tail, out = end_of(text, tail_bytes), None
    for name, pattern in LOG_CLASSES.items():
        out = F.when(tail.rlike(pattern), name) if out is None else out.when(tail.rlike(pattern), name)
    return out.otherwise("error")


def recoverable(policy: Column, attempts: Column, limit: Column, state: Column, expected: Column, spec: Column, expected_spec: Column, checkpoint: Column) -> Column:
    """Why a failed job may not have another round, or null if it may: policy, attempt_limit, state_changed,
    spec_changed, no_checkpoint; the first that applies. Nulls are refused."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(no(policy), "policy")
        .when(no(attempts < limit), "attempt_limit")
        .when(no(state == expected), "state_changed")
        .when(no(spec == expected_spec), "spec_changed")
        .when(no(checkpoint), "no_checkpoint")
    )


def health_state(beat: Column, tick: Column, running: Column, now: Column | int) -> Column:
    """unknown (a beat more than 5 s ahead), stopped (the process is), stalled (last tick over 90 s ago), healthy (a beat
    within 60 s, and a tick), delayed (any beat, or a running process), else unknown; the first that applies."""
    age, idle = F.lit(now) - beat, F.lit(now) - tick
    return (
        F.when(age < -5, "unknown")
        .when(~running, "stopped")
        .when(idle > 90, "stalled")
        .when((age < 60) & tick.isNotNull(), "healthy")
        .when(beat.isNotNull() | running, "delayed")
        .otherwise("unknown")
    )


def restart_interrupted(jobs: DataFrame, boots: DataFrame, beats: DataFrame, attempts: DataFrame, node: str, job: str) -> DataFrame:
    """Running jobs on a node that was started (boots: node, booted) after its last beat (beats: node, at), but for jobs
    with an attempt on record. A node without a beat counts as never heard."""
    last = beats.groupBy(node).agg(F.max("at").alias("last_beat"))
    lost = boots.groupBy(node).agg(F.max("booted").alias("booted")).join(last, node, "left")
    lost = lost.filter(F.col("last_beat").isNull() | (F.col("booted") > F.col("last_beat")))
    return jobs.filter(F.col("status") == "running").join(lost, node).join(attempts.select(job).distinct(), job, "left_anti")
