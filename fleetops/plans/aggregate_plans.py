"""Aggregations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetops.operators import aggregates as A
from fleetops.operators import windows as W
from fleetops.operators.paging import keyset_page
from fleetops.plans.frames import duck, frame, table
from fleetops.plans.registry import query

NEWEST = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, task_id ORDER BY version DESC) AS n FROM jobs) WHERE n = 1)"
OK, BAD, REPORTED = ("'" + "','".join(x) + "'" for x in (A.SUCCESS, A.SETTLING_FAILURES, A.REPORTED_FAILURES))


def newest(spark: SparkSession, d: str) -> DataFrame:
    return W.latest(frame(spark, d, "jobs"), ["batch_id", "task_id"], ["version"])


@query(
    "agg1_batch_progress",
    f"""{duck("jobs")}, {NEWEST} SELECT batch_id, count(*) AS total, count(*) FILTER (status IN ({OK})) AS finished,
  concat(count(*) FILTER (status IN ({OK})), '/', count(*)) AS progress FROM newest GROUP BY batch_id""",
)
def agg1(spark: SparkSession, d: str) -> DataFrame:
    return A.batch_progress(newest(spark, d), "batch_id", "status")


@query(
    "status_overview",
    f"""{duck("jobs")}, {NEWEST}, p AS (SELECT batch_id, count(*) AS total, count(*) FILTER (status IN ({OK})) AS finished FROM newest GROUP BY batch_id),
r AS (SELECT *, row_number() OVER (ORDER BY total DESC, finished, batch_id) AS n FROM p) SELECT batch_id, total, finished, concat(finished, '/', total) AS progress, n = 51 AS extra FROM r WHERE n <= 51""",
)
def overview(spark: SparkSession, d: str) -> DataFrame:
    progress = A.batch_progress(newest(spark, d), "batch_id", "status")
    return keyset_page(progress, [("total", False), ("finished", True), ("batch_id", True)], 50)


@query("agg2_running_by", f"""{duck("jobs")} SELECT project AS key, count(*) AS running FROM jobs WHERE status = 'running' AND gpu > 0 GROUP BY project""")
def agg2(spark: SparkSession, d: str) -> DataFrame:
    return A.running_by(frame(spark, d, "jobs"), "project", "status", F.col("gpu") > 0)


BRIDGE = "bridge AS (SELECT l_suppkey AS card, l_orderkey AS job, l_linenumber AS line, CASE WHEN l_linenumber = 7 AND l_partkey % 50 = 0 THEN NULL ELSE cast(l_quantity AS bigint) END AS gib FROM lineitem WHERE l_returnflag = 'R')"


def bridge(spark: SparkSession, d: str) -> DataFrame:
    gib = F.when((F.col("l_linenumber") == 7) & (F.col("l_partkey") % 50 == 0), None).otherwise(F.col("l_quantity").cast("long"))
    return table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("card"), F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("line"), gib.alias("gib"))


@query(
    "agg3_card_usage",
    f"""{duck("cards")}, {BRIDGE}, u AS (SELECT card, sum(gib)::bigint AS used, count(*) AS jobs, bool_or(gib IS NULL) AS unknown FROM bridge GROUP BY card)
SELECT c.card, c.capacity, coalesce(used, 0) AS used, coalesce(jobs, 0) AS jobs, CASE WHEN coalesce(unknown, false) THEN NULL ELSE coalesce(used, 0) > capacity * 20 END AS over_cap
FROM cards c LEFT JOIN u ON u.card = c.card""",
)
def agg3(spark: SparkSession, d: str) -> DataFrame:
    cards = frame(spark, d, "cards").select("card", "capacity", (F.col("capacity") * 20).alias("cap"))
    return A.card_usage(cards, bridge(spark, d), "card", "cap", "gib").drop("cap")


@query(
    "agg4_card_assignments",
    f"""WITH {BRIDGE} SELECT card, string_agg(concat_ws(':', job::varchar, line::varchar, coalesce(gib::varchar, '-')), ',' ORDER BY job, line, gib NULLS FIRST) AS assignments FROM bridge GROUP BY card""",
)
def agg4(spark: SparkSession, d: str) -> DataFrame:
    out = A.card_assignments(bridge(spark, d), "card", ["job", "line", "gib"])
    text = F.transform("assignments", lambda x: F.concat_ws(":", x["job"].cast("string"), x["line"].cast("string"), F.coalesce(x["gib"].cast("string"), F.lit("-"))))
    return out.select("card", F.array_join(text, ",").alias("assignments"))


@query(
    "agg5_project_usage",
    f"""{duck("jobs", "projects")}, u AS (SELECT project, count(*) AS n FROM jobs WHERE status = 'running' GROUP BY project)
SELECT p.project, quota, coalesce(n, 0) AS used, CASE WHEN NOT enabled THEN 'disabled' WHEN quota <= 0 THEN 'unlimited' WHEN coalesce(n, 0) >= quota THEN 'full' ELSE 'free' END AS access
FROM projects p LEFT JOIN u ON u.project = p.project""",
)
def agg5(spark: SparkSession, d: str) -> DataFrame:
    return A.project_usage(frame(spark, d, "projects"), frame(spark, d, "jobs"), "project", "status", "quota", "enabled").select("project", "quota", "used", "access")


#: Requests as JSON text, one in seventeen broken.
SPEC_SQL = "CASE WHEN id % 17 = 0 THEN '{broken' ELSE concat('{\"resources\":{\"cpus\":', gpu::varchar, ',\"host_mem_gib\":', (request % 64)::varchar, '}}') END"


def specs(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit('{"resources":{"cpus":'), F.col("gpu").cast("string"), F.lit(',"host_mem_gib":'), (F.col("request") % 64).cast("string"), F.lit("}}"))
    return frame(spark, d, "jobs").withColumn("spec", F.when(F.col("id") % 17 == 0, "{broken").otherwise(text))


def asked(field: str) -> F.Column:
    return F.expr(f"try_variant_get(try_parse_json(spec), '$.resources.{field}', 'bigint')")


@query(
    "agg6_memory_reserved",
    f"""{duck("jobs")}, s AS (SELECT project, CASE WHEN id % 17 = 0 THEN NULL ELSE request % 64 END AS mem FROM jobs WHERE status = 'running')
SELECT project, sum(coalesce(mem, 64))::bigint AS reserved, count(*) FILTER (mem IS NULL) AS unreadable FROM s GROUP BY project""",
)
def agg6(spark: SparkSession, d: str) -> DataFrame:
    return A.memory_reserved(specs(spark, d).filter("status = 'running'"), asked("host_mem_gib"), F.lit(64), ["project"])


@query(
    "agg7_cpu_reserved",
    f"""{duck("jobs")}, s AS (SELECT batch_id, coalesce(CASE WHEN retries = 2 THEN 9 END, CASE WHEN id % 17 <> 0 THEN gpu END, CASE WHEN project <> 'p3' THEN 1 END) AS cpus FROM jobs WHERE status = 'running')
SELECT batch_id, CASE WHEN bool_or(cpus IS NULL) THEN NULL ELSE sum(cpus)::bigint END AS cpus FROM s GROUP BY batch_id""",
)
def agg7(spark: SparkSession, d: str) -> DataFrame:
    running = specs(spark, d).filter("status = 'running'")
    return A.cpu_reserved(running, F.when(F.col("retries") == 2, 9), asked("cpus"), F.when(F.col("project") != "p3", 1), ["batch_id"])


@query(
    "agg8_storage_reserved",
    """WITH b AS (SELECT l_orderkey AS id, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_returnflag END AS filesystem, l_quantity::bigint AS bytes, l_linenumber::bigint AS inodes FROM lineitem)
SELECT filesystem, CASE WHEN filesystem IS NULL THEN id END AS unresolved, sum(bytes)::bigint AS bytes, sum(inodes)::bigint AS inodes FROM b GROUP BY ALL""",
)
def agg8(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    fs = F.when(F.col("l_linenumber") == 6, None).otherwise(F.col("l_returnflag"))
    jobs = line.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(fs.alias("filesystem"), F.col("l_quantity").cast("long").alias("bytes"), F.col("l_linenumber").cast("long").alias("inodes"))).alias("bindings"))
    return A.storage_reserved(jobs, "bindings", "id").select("filesystem", "unresolved", "bytes", "inodes")


PATHS = """SELECT l_orderkey AS request, CASE WHEN l_partkey % 40 = 0 THEN NULL ELSE cast(l_suppkey % 6 AS bigint) END AS filesystem, CASE WHEN l_linenumber < 3 THEN 'control' ELSE 'task' END AS role,
  CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE cast(floor(l_extendedprice) AS bigint) END AS available, l_partkey % 31 = 0 AS readonly, cast(l_quantity AS bigint) AS wanted FROM lineitem"""


@query(
    "agg9_storage_check",
    f"""WITH paths AS ({PATHS}), used AS (SELECT (l_suppkey % 6)::bigint AS filesystem, sum(l_quantity)::bigint // 1000 AS bytes FROM lineitem GROUP BY 1),
p AS (SELECT request, filesystem, min(available) AS available, bool_or(readonly) AS ro, bool_or(available IS NULL) AS blank,
  max(CASE WHEN role = 'task' THEN 10000 ELSE 5000 END) AS floor, max(CASE WHEN role = 'task' THEN wanted ELSE 0 END) AS wanted FROM paths GROUP BY request, filesystem),
q AS (SELECT p.*, floor + wanted + coalesce(bytes, 0) AS needed FROM p LEFT JOIN used ON used.filesystem = p.filesystem),
r AS (SELECT *, concat_ws(',', CASE WHEN available < needed THEN 'disk_space' END, CASE WHEN ro THEN 'read_only' END) AS reasons,
  concat_ws(',', CASE WHEN filesystem IS NULL THEN 'filesystem' END, CASE WHEN blank THEN 'available' END) AS unknowns FROM q)
SELECT request, filesystem, needed, available, reasons, unknowns, CASE WHEN reasons <> '' THEN false WHEN unknowns <> '' THEN NULL ELSE true END AS allowed FROM r""",
)
def agg9(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    paths = spark.sql(PATHS.replace("FROM lineitem", "FROM {line}"), line=line)
    used = line.groupBy((F.col("l_suppkey") % 6).alias("filesystem")).agg(F.floor(F.sum("l_quantity") / 1000).cast("long").alias("bytes"))
    out = A.storage_check(paths, used, 5000, 10000)
    return out.withColumn("reasons", F.array_join("reasons", ",")).withColumn("unknowns", F.array_join("unknowns", ","))


@query(
    "agg10_batch_event",
    f"""{duck("jobs")}, c AS (SELECT batch_id, status, count(*) AS n FROM jobs GROUP BY ALL),
m AS (SELECT batch_id, string_agg(concat(status, '=', n), ',' ORDER BY status) AS counts FROM c GROUP BY batch_id),
w AS (SELECT batch_id, arg_min(gpu, row_seq) FILTER (retries > 0) AS first_rev, min(submitted) AS started, max(finished) AS finished,
  string_agg(concat(id, ':', status), ',' ORDER BY id) FILTER (status IN ({REPORTED})) AS failures FROM jobs GROUP BY batch_id)
SELECT w.batch_id, first_rev, started, finished, coalesce(failures, '') AS failures, round_even((finished - started) / 60.0, 0)::bigint AS minutes, counts FROM w JOIN m ON m.batch_id = w.batch_id""",
)
def agg10(spark: SparkSession, d: str) -> DataFrame:
    jobs = frame(spark, d, "jobs").withColumn("rev", F.when(F.col("retries") > 0, F.col("gpu")))
    out = A.batch_event(jobs, "batch_id", "status", "submitted", "finished", "rev", "row_seq", "id")
    counts = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    failures = F.array_join(F.transform("failures", lambda x: F.concat_ws(":", x["id"].cast("string"), x["status"])), ",")
    return out.withColumn("counts", counts).withColumn("failures", failures)


STALE = "stale AS (SELECT DISTINCT batch_id FROM (SELECT *, max(version) OVER (PARTITION BY batch_id, task_id) AS m FROM jobs) WHERE status = 'running' AND version < m)"


@query(
    "agg11_settle_batches",
    f"""{duck("jobs", "batches")}, {NEWEST}, {STALE}, open AS (SELECT DISTINCT batch_id FROM jobs WHERE status = 'done' AND id % 41 = 0), unfit AS (SELECT DISTINCT batch_id FROM jobs WHERE status = 'done' AND id % 23 = 0),
s AS (SELECT batch_id, count(*) AS n, bool_and(status IN ({OK})) AS ok, bool_and(status IN ({OK}, {BAD})) AS ended, bool_or(status IN ({BAD})) AS bad FROM newest GROUP BY batch_id),
j AS (SELECT b.*, s.*, b.id IN (SELECT batch_id FROM stale) OR b.id IN (SELECT batch_id FROM open) AS wait, b.id IN (SELECT batch_id FROM unfit) AS unfit FROM batches b LEFT JOIN s ON s.batch_id = b.id)
SELECT id, status, policy, CASE WHEN status NOT IN ('active', 'blocked') OR coalesce(n, 0) = 0 THEN 'leave'
 WHEN status = 'active' AND policy = 'continue_independent' AND (NOT ended OR wait) THEN 'leave' WHEN ok AND unfit THEN CASE WHEN status = 'active' THEN 'blocked' ELSE 'leave' END
 WHEN ok AND wait THEN 'leave' WHEN ok THEN 'done' WHEN bad AND status = 'active' THEN 'blocked' ELSE 'leave' END AS verdict FROM j""",
)
def agg11(spark: SparkSession, d: str) -> DataFrame:
    jobs = frame(spark, d, "jobs")
    stale = W.stale_running(jobs, ["batch_id", "task_id"], "version", "status")
    as_id = lambda df: df.select(F.col("batch_id").alias("id"), "status")
    out = A.settle_batches(
        frame(spark, d, "batches"), as_id(newest(spark, d)), as_id(stale), as_id(jobs.filter("status = 'done' and id % 41 = 0")), as_id(jobs.filter("status = 'done' and id % 23 = 0")), "id", "status", "policy"
    )
    return out.select("id", "status", "policy", "verdict")


@query(
    "agg12_batch_successful",
    f"""{duck("jobs", "batches")}, {NEWEST}, {STALE}, b AS (SELECT name, arg_max(id, struct_pack(a := created, b := row_seq)) AS id FROM batches GROUP BY name),
s AS (SELECT batch_id, bool_and(status IN ({OK})) AS ok FROM newest GROUP BY batch_id)
SELECT name, id, coalesce(ok, false) AND id NOT IN (SELECT batch_id FROM stale) AS successful FROM b LEFT JOIN s ON s.batch_id = b.id""",
)
def agg12(spark: SparkSession, d: str) -> DataFrame:
    batches = W.latest_by_name(frame(spark, d, "batches"), "name", ["created", "row_seq"]).select("name", F.col("id").alias("batch_id"))
    stale = W.stale_running(frame(spark, d, "jobs"), ["batch_id", "task_id"], "version", "status")
    return A.batch_successful(batches, newest(spark, d), stale, "batch_id", "status").withColumnRenamed("batch_id", "id")


@query(
    "agg13_multiset_digest",
    f"""WITH j AS (SELECT concat('{{"l_orderkey":', l_orderkey, ',"l_partkey":', l_partkey, ',"l_linenumber":', l_linenumber, '}}') AS j FROM lineitem), r AS (SELECT concat(sha256(concat('0|', j)), sha256(concat('1|', j))) AS h FROM j)
SELECT count(*) AS rows, concat({", ".join(f"lpad(lower(hex((sum(('0x' || substr(h, {16 * k + 1}, 16))::ubigint::hugeint) % 18446744073709551616)::ubigint)), 16, '0')" for k in range(8))}) AS digest FROM r""",
)
def agg13(spark: SparkSession, d: str) -> DataFrame:
    return A.multiset_digest(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_linenumber"])


@query("agg14_evidence_size", "SELECT user_id AS owner, count(*) AS events, sum(strlen(props))::bigint AS bytes, max(strlen(props))::bigint AS largest, sum(strlen(props)) > 600 AS over_budget FROM events GROUP BY user_id")
def agg14(spark: SparkSession, d: str) -> DataFrame:
    return A.evidence_size(table(spark, d, "events").withColumnRenamed("user_id", "owner"), "owner", "props", 600)


@query(
    "agg15_cpu_claims",
    f"""{duck("log")}, a AS (SELECT owner, string_agg(k::varchar, ',' ORDER BY k) AS claimed FROM (SELECT DISTINCT owner, k FROM log WHERE kind IN ('view', 'click') AND k < 20 AND owner % 7 <> 0) GROUP BY owner),
b AS (SELECT owner, string_agg(k::varchar, ',' ORDER BY k) AS bound FROM (SELECT DISTINCT owner, k FROM log WHERE kind IN ('view', 'click') AND k < CASE WHEN owner % 3 = 0 THEN 19 ELSE 20 END AND owner % 11 <> 0) GROUP BY owner)
SELECT coalesce(a.owner, b.owner) AS owner, claimed, bound, CASE WHEN bound IS NULL THEN 'missing' WHEN claimed IS NULL THEN 'unclaimed' WHEN bound = claimed THEN 'match' ELSE 'differs' END AS verdict
FROM a FULL JOIN b ON a.owner = b.owner""",
)
def agg15(spark: SparkSession, d: str) -> DataFrame:
    log = frame(spark, d, "log").filter("kind in ('view', 'click')").select("owner", "k").distinct()
    claims = log.filter("k < 20 and owner % 7 <> 0")
    frozen = log.filter("k < case when owner % 3 = 0 then 19 else 20 end and owner % 11 <> 0").groupBy("owner").agg(F.collect_list("k").alias("units"))
    out = A.cpu_claims(claims, frozen, "owner", "k", "units")
    text = lambda c: F.when(F.col(c).isNotNull(), F.array_join(c, ",")).alias(c)
    return out.select("owner", text("claimed"), text("bound"), "verdict")


@query(
    "agg16_record_counts",
    f"""{duck("jobs", "batches")}, t AS (SELECT batch_id AS id, 'jobs' AS t FROM jobs UNION ALL SELECT batch_id, 'running' FROM jobs WHERE status = 'running' UNION ALL SELECT id, 'batches' FROM batches)
SELECT id, count(*) FILTER (t = 'batches') AS batches, count(*) FILTER (t = 'jobs') AS jobs, count(*) FILTER (t = 'running') AS running,
  CASE WHEN count(*) FILTER (t = 'running') > 0 THEN 'running' ELSE '' END AS reasons FROM t GROUP BY id""",
)
def agg16(spark: SparkSession, d: str) -> DataFrame:
    jobs = frame(spark, d, "jobs").drop("id").withColumnRenamed("batch_id", "id")
    out = A.record_counts({"batches": frame(spark, d, "batches"), "jobs": jobs, "running": jobs.filter("status = 'running'")}, ["id"], ["running"])
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query("agg17_distinct_ids", f"""{duck("log")} SELECT DISTINCT k FROM log WHERE kind = 'error' AND moment % 86400 < 36000""")
def agg17(spark: SparkSession, d: str) -> DataFrame:
    return A.distinct_ids(frame(spark, d, "log"), "k", (F.col("kind") == "error") & (F.col("moment") % 86400 < 36000))


@query(
    "agg18_capacity_min",
    f"""{duck("cards")}, s AS (SELECT node, CASE WHEN card % 29 = 0 THEN NULL ELSE capacity END AS v FROM cards)
SELECT node, CASE WHEN bool_or(v IS NULL) THEN NULL ELSE least(min(v), 24) END AS "limit", concat_ws(',', CASE WHEN count(DISTINCT v) > 1 THEN 'sources_disagree' END, CASE WHEN bool_or(v IS NULL) THEN 'unknown' END) AS reasons FROM s GROUP BY node""",
)
def agg18(spark: SparkSession, d: str) -> DataFrame:
    cards = frame(spark, d, "cards").withColumn("v", F.when(F.col("card") % 29 == 0, None).otherwise(F.col("capacity")))
    return A.capacity_min(cards, "node", "v", 24).withColumn("reasons", F.array_join("reasons", ","))


@query(
    "agg19_incident_verdicts",
    f"""{duck("jobs")}, p AS (SELECT id, request % 1500 AS ext, id % 9 = 0 AS degraded, gpu + 2 AS declared, request % 11 AS peak, version + 1 AS nd, request % 9 AS np, request % 20 AS used, 16 AS packed,
  list_filter([request % 24, request % 7, id % 13, CASE WHEN id % 3 = 0 THEN NULL ELSE id % 24 END], lambda x: x IS NOT NULL) AS pts FROM jobs WHERE status IN ({REPORTED})),
q AS (SELECT *, CASE WHEN ext < 700 THEN 0 ELSE ext END AS e, list_max(pts) - list_min(pts) AS span, list_max(pts) AS top FROM p)
SELECT id, concat_ws(',', CASE WHEN e >= 1024 THEN 'external_memory' WHEN degraded THEN 'degraded' END, CASE WHEN peak > 1.3 * declared THEN 'under_declared' END, CASE WHEN np > 1.5 * nd AND np - nd > 2 THEN 'neighbour_over' END,
  CASE WHEN e = 0 AND abs(used - packed) <= 0.2 * packed THEN 'no_slack' END, CASE WHEN len(pts) >= 4 AND span > 6 THEN 'fast_climb' WHEN len(pts) >= 4 AND span < 1.2 AND top < 21.6 THEN 'flat' END) AS codes FROM q""",
)
def agg19(spark: SparkSession, d: str) -> DataFrame:
    jobs = frame(spark, d, "jobs").filter(F.col("status").isin(*A.REPORTED_FAILURES))
    r, i = F.col("request"), F.col("id")
    payload = F.struct(
        F.when(r % 1500 < 700, F.array(F.lit(None).cast("bigint"))).otherwise(F.array(r % 1500)).alias("external_mib"),
        (i % 9 == 0).alias("degraded"), (F.col("gpu") + 2).alias("declared"), (r % 11).alias("peak"),
        F.array(F.struct((F.col("version") + 1).alias("declared"), (r % 9).alias("peak"))).alias("neighbours"),
        (r % 20).alias("used"), F.lit(16).alias("packed"), F.lit(24).alias("capacity"),
        F.array_compact(F.array(r % 24, r % 7, i % 13, F.when(i % 3 == 0, None).otherwise(i % 24))).alias("timeline_gib"),
    )
    return A.incident_verdicts(jobs.select("id", payload.alias("payload")), "id", "payload").select("id", F.array_join("codes", ",").alias("codes"))


@query(
    "agg20_budget_check",
    f"""{duck("jobs", "projects", "batches")}, u AS (SELECT project, count(*) AS n FROM jobs WHERE status = 'running' GROUP BY project), b AS (SELECT batch_id, count(*) AS n FROM jobs WHERE status = 'running' GROUP BY batch_id),
r AS (SELECT j.id, gpu, request, p.project, quota, enabled, coalesce(u.n, 0) AS used, coalesce(b.n, 0) AS inbatch FROM jobs j LEFT JOIN projects p ON p.project = j.project LEFT JOIN u ON u.project = j.project LEFT JOIN b ON b.batch_id = j.batch_id WHERE j.status = 'pending'),
g AS (SELECT id, gpu > 0 AND NOT enabled AS a, gpu > 0 AND quota > 0 AND used >= quota AS q, inbatch >= 2 AS p, CASE WHEN request % 19 = 0 THEN NULL ELSE used + gpu > 520 END AS c, request % 64 > 48 AS m, gpu = 0 AND used >= 2 AS o FROM r)
SELECT id, concat_ws(',', CASE WHEN a THEN 'project_gpu_disabled' END, CASE WHEN q THEN 'quota' END, CASE WHEN p THEN 'parallel' END, CASE WHEN c THEN 'cpu' END, CASE WHEN m THEN 'host_memory' END, CASE WHEN o THEN 'cpu_only' END) AS reasons,
  CASE WHEN a OR q OR p OR coalesce(c, false) OR m OR o THEN false WHEN c IS NULL THEN NULL ELSE true END AS allowed FROM g""",
)
def agg20(spark: SparkSession, d: str) -> DataFrame:
    jobs = frame(spark, d, "jobs")
    by_project = A.running_by(jobs, "project", "status").select(F.col("key").alias("project"), F.col("running").alias("used"))
    by_batch = A.running_by(jobs, "batch_id", "status").select(F.col("key").alias("batch_id"), F.col("running").alias("in_batch"))
    asks = jobs.filter("status = 'pending'").join(frame(spark, d, "projects").select("project", "quota", "enabled"), "project", "left").join(by_project, "project", "left").join(by_batch, "batch_id", "left").fillna(0, ["used", "in_batch"])
    gpu = F.col("gpu") > 0
    gates = {
        "project_gpu_disabled": gpu & ~F.col("enabled"),
        "quota": gpu & (F.col("quota") > 0) & (F.col("used") >= F.col("quota")),
        "parallel": F.col("in_batch") >= 2,
        "cpu": F.when(F.col("request") % 19 == 0, None).otherwise(F.col("used") + F.col("gpu") > 520),
        "host_memory": F.col("request") % 64 > 48,
        "cpu_only": ~gpu & (F.col("used") >= 2),
    }
    return A.budget_check(asks, gates).select("id", F.array_join("reasons", ",").alias("reasons"), "allowed")


@query(
    "agg21_activity",
    f"""{duck("jobs", "batches", "cards")} SELECT 'running' AS source, count(*) AS open FROM jobs WHERE status = 'running' UNION ALL SELECT 'pending', count(*) FROM jobs WHERE status = 'pending'
UNION ALL SELECT 'batches', count(*) FROM batches WHERE status IN ('active', 'queued') UNION ALL SELECT 'frozen_cards', count(*) FROM cards WHERE frozen""",
)
def agg21(spark: SparkSession, d: str) -> DataFrame:
    jobs = frame(spark, d, "jobs")
    return A.activity({"running": jobs.filter("status = 'running'"), "pending": jobs.filter("status = 'pending'"), "batches": frame(spark, d, "batches").filter("status in ('active', 'queued')"), "frozen_cards": frame(spark, d, "cards").filter("frozen")})
