"""Joins, pages and set operations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetops.operators import joins as J
from fleetops.operators import paging as P
from fleetops.operators import sets as S
from fleetops.operators import windows as W
from fleetops.plans.frames import duck, frame, table
from fleetops.plans.registry import query

TERMINAL = ("done", "skip", "failed", "blocked", "cancelled", "timed_out")
TERMINAL_SQL = "'" + "','".join(TERMINAL) + "'"


@query("jn1_latest_join", f"""{duck("jobs")} SELECT j.batch_id, j.task_id, j.version, j.id FROM jobs j JOIN (SELECT batch_id, task_id, max(version) AS v FROM jobs GROUP BY ALL) m ON m.batch_id = j.batch_id AND m.task_id = j.task_id AND m.v = j.version""")
def jn1(spark: SparkSession, d: str) -> DataFrame:
    return J.latest_join(frame(spark, d, "jobs"), ["batch_id", "task_id"], "version").select("batch_id", "task_id", "version", "id")


SPEC_ROWS = "specs AS (SELECT batch_id, task_id, version, request AS asked FROM jobs WHERE id % 10 <> 0)"


def spec_rows(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "jobs").filter("id % 10 <> 0").select("batch_id", "task_id", "version", F.col("request").alias("asked"))


@query("jn2_job_detail", f"""{duck("jobs", "batches")}, {SPEC_ROWS} SELECT j.id, b.name, b.status AS batch_status, s.asked FROM jobs j JOIN batches b ON b.id = j.batch_id LEFT JOIN specs s ON s.batch_id = j.batch_id AND s.task_id = j.task_id AND s.version = j.version""")
def jn2(spark: SparkSession, d: str) -> DataFrame:
    batches = frame(spark, d, "batches").select(F.col("id").alias("batch_id"), "name", F.col("status").alias("batch_status"))
    return J.job_detail(frame(spark, d, "jobs"), batches, spec_rows(spark, d), "batch_id", ["batch_id", "task_id", "version"]).select("id", "name", "batch_status", "asked")


@query(
    "jn3_execution_browse",
    f"""{duck("jobs")}, a AS (SELECT id, 'running' AS phase_a FROM jobs WHERE id % 3 = 0), b AS (SELECT id, 'exited' AS phase_b, gpu AS slot FROM jobs WHERE id % 2 = 0)
SELECT j.id, b.slot, coalesce(phase_a, phase_b) AS phase FROM jobs j LEFT JOIN a ON a.id = j.id LEFT JOIN b ON b.id = j.id""",
)
def jn3(spark: SparkSession, d: str) -> DataFrame:
    jobs = frame(spark, d, "jobs")
    a = jobs.filter("id % 3 = 0").select("id", F.lit("running").alias("phase_a"))
    b = jobs.filter("id % 2 = 0").select("id", F.lit("exited").alias("phase_b"), F.col("gpu").alias("slot"))
    none = jobs.filter("false").select("id", F.lit("lost").alias("phase_c"))
    return J.execution_browse(jobs.select("id"), "id", {"attempts": a, "owners": b, "sessions": none}, ["phase_a", "phase_b", "phase_c"]).select("id", "slot", "phase")


@query("jn4_exists_filter", "SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity >= 45)")
def jn4(spark: SparkSession, d: str) -> DataFrame:
    orders, line = table(spark, d, "orders"), table(spark, d, "lineitem").filter("l_quantity >= 45")
    return J.exists_filter(orders, line, orders.o_orderkey == line.l_orderkey).select("o_orderkey", "o_custkey")


@query("jn4_not_exists_filter", "SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def jn4n(spark: SparkSession, d: str) -> DataFrame:
    orders, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    return J.not_exists_filter(orders, line, orders.o_orderkey == line.l_orderkey).select("o_orderkey", "o_custkey")


@query(
    "jn5_exempt_delete",
    f"""{duck("log")}, i AS (SELECT id, CASE WHEN k % 10 = 0 THEN NULL ELSE owner END AS job FROM log), keep AS (SELECT DISTINCT owner FROM log WHERE kind = 'purchase' AND cents > 20000)
SELECT id, job FROM i WHERE NOT EXISTS (SELECT 1 FROM keep WHERE keep.owner = i.job)""",
)
def jn5(spark: SparkSession, d: str) -> DataFrame:
    log = frame(spark, d, "log")
    incidents = log.select("id", F.when(F.col("k") % 10 != 0, F.col("owner")).alias("job"))
    return J.exempt_delete(incidents, log.filter("kind = 'purchase' and cents > 20000").select(F.col("owner").alias("job")), "job")


#: A second version of the jobs: every 11th has another digest, every 13th is gone, every 17th lost its fingerprint.
NOW_SQL = "now AS (SELECT batch_id, task_id, version, CASE WHEN id % 11 = 0 THEN request + 1 ELSE request END AS digest, CASE WHEN id % 17 = 0 THEN NULL ELSE gpu END AS fp FROM jobs WHERE id % 13 <> 0)"


@query(
    "jn6_match_bindings",
    f"""{duck("jobs")}, {NOW_SQL}, b AS (SELECT id, batch_id, task_id, version, request AS digest, CASE WHEN id % 34 = 0 THEN NULL ELSE gpu END AS fp FROM jobs),
n AS (SELECT batch_id, task_id, version, count(*) AS c, min(digest) AS digest, min(fp) AS fp FROM now GROUP BY ALL)
SELECT b.id, coalesce(c, 0) AS matches, coalesce(c = 1 AND b.digest = n.digest AND b.fp IS NOT DISTINCT FROM n.fp, false) AS bound FROM b LEFT JOIN n ON n.batch_id = b.batch_id AND n.task_id = b.task_id AND n.version = b.version""".replace("GROUP BY ALL", "GROUP BY batch_id, task_id, version"),
)
def jn6(spark: SparkSession, d: str) -> DataFrame:
    jobs = frame(spark, d, "jobs")
    bindings = jobs.select("id", "batch_id", "task_id", "version", F.col("request").alias("digest"), F.expr("if(id % 34 = 0, null, gpu)").alias("fp"))
    now = jobs.filter("id % 13 <> 0").select("batch_id", "task_id", "version", F.expr("if(id % 11 = 0, request + 1, request)").alias("digest"), F.expr("if(id % 17 = 0, null, gpu)").alias("fp"))
    return J.match_bindings(bindings, now, ["batch_id", "task_id", "version"], "digest", "fp").select("id", "matches", "bound")


@query(
    "jn7_recorded_clear",
    f"""{duck("jobs")}, b AS (SELECT batch_id, task_id, id AS job FROM jobs WHERE status IN ('done', 'skip'))
SELECT batch_id, task_id, job FROM b WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.batch_id = b.batch_id AND j.task_id = b.task_id AND j.status IN ('running', 'interrupted')) AND job % 19 <> 0 AND job % 23 <> 0""",
)
def jn7(spark: SparkSession, d: str) -> DataFrame:
    jobs = frame(spark, d, "jobs").withColumnRenamed("id", "job")
    attempts = jobs.select("job", F.expr("case when job % 19 = 0 then 'running' else 'exited' end").alias("phase"))
    bindings = jobs.filter("status in ('done', 'skip')").select("batch_id", "task_id", "job")
    return J.recorded_clear(bindings, jobs, attempts, jobs.filter("job % 23 = 0"), ["batch_id", "task_id"], "job", "status", "phase")


BRIDGE = "b AS (SELECT batch_id AS card, id AS job, gpu AS size, project FROM jobs WHERE status = 'running'), peaks AS (SELECT project, quota + 3 AS peak FROM projects WHERE enabled)"


@query(
    "jn8_co_runners",
    f"""{duck("jobs", "projects")}, {BRIDGE} SELECT x.card, x.job, y.job AS other, y.size AS declared, p.peak AS measured, p.peak > y.size AS over
FROM b x JOIN b y ON x.card = y.card AND x.job <> y.job LEFT JOIN peaks p ON p.project = y.project""",
)
def jn8(spark: SparkSession, d: str) -> DataFrame:
    bridge = frame(spark, d, "jobs").filter("status = 'running'").select(F.col("batch_id").alias("card"), F.col("id").alias("job"), F.col("gpu").alias("size"), "project")
    peaks = frame(spark, d, "projects").filter("enabled").select("project", (F.col("quota") + 3).alias("peak"))
    return J.co_runners(bridge, peaks, "card", "job", "size", "project", "peak").select("card", "job", "other", "declared", "measured", "over")


@query(
    "jn9_candidates",
    f"""{duck("cards")}, r AS (SELECT c_nationkey::bigint AS node, (c_custkey % 26)::bigint AS gib, count(*) AS requests FROM customer GROUP BY ALL)
SELECT r.node, gib, requests, card, CASE WHEN quarantined THEN false WHEN card % 17 = 0 THEN NULL ELSE gib * 100 <= capacity * 85 END AS allowed FROM r JOIN cards c ON c.node = r.node""",
)
def jn9(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "customer").select(F.col("c_custkey").alias("request"), F.col("c_nationkey").cast("long").alias("node"), (F.col("c_custkey") % 26).alias("gib"))
    fits = F.when(F.col("quarantined"), False).when(F.col("card") % 17 == 0, None).otherwise(F.col("gib") * 100 <= F.col("capacity") * 85)
    return J.candidates(requests, frame(spark, d, "cards"), fits, "node", ["gib"]).select("node", "gib", "requests", "card", "allowed")


@query(
    "jn10_attribute_pids",
    f"""{duck("log")}, t AS (SELECT k AS uuid, k % 8 AS card FROM (SELECT DISTINCT k FROM log) WHERE k % 50 <> 7), o AS (SELECT (id % 97)::bigint AS pid, min(owner) AS job FROM log WHERE kind = 'purchase' GROUP BY 1),
s AS (SELECT id, at_hour, k AS uuid, (id % 97)::bigint AS pid FROM (SELECT *, moment // 3600 AS at_hour FROM log)), j AS (SELECT s.*, card, job FROM s LEFT JOIN t ON t.uuid = s.uuid LEFT JOIN o ON o.pid = s.pid)
SELECT id, card, job, bool_or(card IS NULL) OVER (PARTITION BY at_hour) AS indeterminate FROM j""",
)
def jn10(spark: SparkSession, d: str) -> DataFrame:
    log = frame(spark, d, "log")
    topology = log.select(F.col("k").alias("uuid")).distinct().filter("uuid % 50 <> 7").withColumn("card", F.col("uuid") % 8)
    owners = log.filter("kind = 'purchase'").groupBy((F.col("id") % 97).alias("pid")).agg(F.min("owner").alias("job"))
    samples = log.select("id", F.expr("moment div 3600").alias("hour"), F.col("k").alias("uuid"), (F.col("id") % 97).alias("pid"))
    return J.attribute_pids(samples, topology, owners, "hour", "uuid", "pid").select("id", "card", "job", "indeterminate")


@query(
    "jn11_topology_stable",
    f"""{duck("log")}, a AS (SELECT owner, k, count(*) AS n FROM log GROUP BY ALL), b AS (SELECT owner, CASE WHEN id % 501 = 0 THEN k + 1 ELSE k END AS k, count(*) AS n FROM log GROUP BY ALL),
u AS (SELECT owner, k, n FROM a UNION ALL SELECT owner, k, -n FROM b), s AS (SELECT owner, k, sum(n) AS n FROM u GROUP BY ALL) SELECT owner, bool_and(n = 0) AS stable FROM s GROUP BY owner""",
)
def jn11(spark: SparkSession, d: str) -> DataFrame:
    log = frame(spark, d, "log")
    later = log.withColumn("k", F.when(F.col("id") % 501 == 0, F.col("k") + 1).otherwise(F.col("k")))
    return J.topology_stable(log, later, "owner", ["k"])


@query(
    "jn12_latest_producer",
    f"""{duck("jobs")}, p AS (SELECT *, request AS fp FROM jobs WHERE status = 'done')
SELECT id, producer, producer_fingerprint FROM (SELECT j.id, p.id AS producer, p.fp AS producer_fingerprint, row_number() OVER (PARTITION BY j.id ORDER BY p.finished DESC NULLS LAST, p.row_seq DESC) AS n
FROM jobs j LEFT JOIN p ON p.project = j.project AND p.task_id = j.task_id AND p.id <> j.id) WHERE n = 1""",
)
def jn12(spark: SparkSession, d: str) -> DataFrame:
    jobs = frame(spark, d, "jobs").withColumn("fp", F.col("request"))
    out = J.latest_producer(jobs.select("id", "project", "task_id"), jobs.filter("status = 'done'"), "project", "task_id", "id", "finished", "row_seq", "fp")
    return out.select("id", "producer", "producer_fingerprint")


@query(
    "jn12_producer_as_of",
    f"""{duck("jobs")}, p AS (SELECT *, request AS fp FROM jobs WHERE status = 'done')
SELECT id, producer, producer_fingerprint FROM (SELECT j.id, p.id AS producer, p.fp AS producer_fingerprint, row_number() OVER (PARTITION BY j.id ORDER BY p.finished DESC NULLS LAST, p.row_seq DESC) AS n
FROM jobs j LEFT JOIN p ON p.project = j.project AND p.task_id = j.task_id AND p.finished <= j.submitted - 1) WHERE n = 1""",
)
def jn12b(spark: SparkSession, d: str) -> DataFrame:
    jobs = frame(spark, d, "jobs").withColumn("fp", F.col("request"))
    asked = jobs.select("id", "project", "task_id", (F.col("submitted") - 1).alias("by"))
    out = J.latest_producer(asked, jobs.filter("status = 'done'"), "project", "task_id", "id", "finished", "row_seq", "fp", as_of="by")
    return out.select("id", "producer", "producer_fingerprint")


@query(
    "jn13_same_name_conflict",
    f"""{duck("batches")}, o AS (SELECT * FROM batches WHERE status <> 'blocked')
SELECT id, conflict FROM (SELECT b.id, o.id AS conflict, row_number() OVER (PARTITION BY b.id ORDER BY o.created DESC NULLS LAST, o.row_seq DESC) AS n FROM batches b LEFT JOIN o ON o.name = b.name AND o.id <> b.id) WHERE n = 1""",
)
def jn13(spark: SparkSession, d: str) -> DataFrame:
    return J.same_name_conflict(frame(spark, d, "batches"), "name", "id", "status", ["blocked"], ["created", "row_seq"]).select("id", "conflict")


@query(
    "jn14_precondition_check",
    f"""{duck("jobs")}, r AS (SELECT id, CASE WHEN id % 9 = 0 THEN NULL ELSE status END AS s, CASE WHEN id % 7 = 0 THEN version + 1 ELSE version END AS v, gpu AS g FROM jobs),
a AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'done' ELSE status END AS status, version, CASE WHEN id % 5 = 0 THEN NULL ELSE gpu END AS gpu FROM jobs WHERE id % 13 <> 0)
SELECT r.id, CASE WHEN a.id IS NULL THEN 'not_found' WHEN s IS NOT NULL AND s IS DISTINCT FROM a.status THEN 'status_changed' WHEN v IS DISTINCT FROM a.version THEN 'version_changed' WHEN g IS DISTINCT FROM a.gpu THEN 'gpu_changed' END AS reason
FROM r LEFT JOIN a ON a.id = r.id""",
)
def jn14(spark: SparkSession, d: str) -> DataFrame:
    jobs = frame(spark, d, "jobs")
    asked = jobs.select("id", F.expr("if(id % 9 = 0, null, status)").alias("s"), F.expr("if(id % 7 = 0, version + 1, version)").alias("v"), F.col("gpu").alias("g"))
    now = jobs.filter("id % 13 <> 0").select("id", F.expr("if(id % 11 = 0, 'done', status)").alias("status"), "version", F.expr("if(id % 5 = 0, null, gpu)").alias("gpu"))
    return J.precondition_check(asked, now, "id", {"s": "status", "v": "version", "g": "gpu"}).select("id", "reason")


@query(
    "jn15_receipt_lookup",
    f"""{duck("jobs")} SELECT id, CASE WHEN id % 6 = 0 THEN 'conflict' WHEN id % 2 = 0 THEN 'operation' WHEN id % 3 = 0 THEN 'submission' ELSE 'not_found' END AS found,
 CASE WHEN id % 6 = 0 THEN NULL WHEN id % 2 = 0 THEN gpu WHEN id % 3 = 0 THEN retries END AS receipt FROM jobs""",
)
def jn15(spark: SparkSession, d: str) -> DataFrame:
    jobs = frame(spark, d, "jobs")
    return J.receipt_lookup(jobs.select("id"), jobs.filter("id % 2 = 0").select("id", F.col("gpu").alias("v")), jobs.filter("id % 3 = 0").select("id", F.col("retries").alias("v")), "id", "v")


REFS = "refs AS (SELECT id AS job, CASE id % 3 WHEN 0 THEN batch_id::varchar WHEN 1 THEN concat('b', batch_id % 120) ELSE 'nowhere' END AS ref FROM jobs)"


@query(
    "jn16_resolve_ref",
    f"""{duck("jobs", "batches")}, {REFS}, l AS (SELECT name, arg_max(id, created * 1000000 + row_seq) AS id FROM batches GROUP BY name)
SELECT job, ref, coalesce(b.id, l.id) AS resolved FROM refs LEFT JOIN batches b ON b.id::varchar = ref LEFT JOIN l ON l.name = ref""",
)
def jn16(spark: SparkSession, d: str) -> DataFrame:
    ref = F.expr("case id % 3 when 0 then cast(batch_id as string) when 1 then concat('b', batch_id % 120) else 'nowhere' end")
    refs = frame(spark, d, "jobs").select(F.col("id").alias("job"), ref.alias("ref"))
    return J.resolve_ref(refs, frame(spark, d, "batches"), "ref", "id", "name", ["created", "row_seq"]).select("job", "ref", "resolved")


@query(
    "jn17_reservation_select",
    f"""{duck("cards", "log")}, v AS (SELECT id AS reservation, k AS card, CASE WHEN id % 9 = 0 THEN -1 ELSE k * 3 END AS uuid, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN 'mig' ELSE 'whole' END AS mode, moment AS seen FROM log WHERE kind = 'signup'),
m AS (SELECT max(moment) - 86400 AS t FROM log), j AS (SELECT v.*, c.card * 3 AS u, count(*) OVER (PARTITION BY v.card) AS n, m.t - seen AS age FROM v LEFT JOIN cards c ON c.card = v.card, m)
SELECT reservation, concat_ws(',', CASE WHEN u IS NULL THEN 'no_such_card' END, CASE WHEN u <> uuid THEN 'uuid_differs' END, CASE WHEN age < 0 OR age > 864000 THEN 'not_fresh' END, CASE WHEN n > 1 THEN 'used_twice' END,
 CASE WHEN coalesce(mode, '') <> 'whole' THEN 'mode' END) AS reasons FROM j""",
)
def jn17(spark: SparkSession, d: str) -> DataFrame:
    log = frame(spark, d, "log")
    now = (log.agg(F.max("moment")).first()[0] or 0) - 86400
    held = log.filter("kind = 'signup'").select(F.col("id").alias("reservation"), F.col("k").alias("card"), F.expr("if(id % 9 = 0, -1, k * 3)").alias("uuid"), F.expr("case when id % 7 = 0 then null when id % 5 = 0 then 'mig' else 'whole' end").alias("mode"), F.col("moment").alias("at"))
    cards = frame(spark, d, "cards").select("card", (F.col("card") * 3).alias("uuid"))
    return J.reservation_select(cards, held, now, 864000, ["whole"]).select("reservation", F.array_join("reasons", ",").alias("reasons"))


@query("jn18_rev_drift", f"""{duck("jobs", "projects")} SELECT j.id, j.project, j.gpu AS rev, p.priority AS current_rev FROM jobs j JOIN projects p ON p.project = j.project WHERE j.gpu <> p.priority""")
def jn18(spark: SparkSession, d: str) -> DataFrame:
    current = frame(spark, d, "projects").select("project", F.col("priority").alias("current_rev"))
    return J.rev_drift(frame(spark, d, "jobs").withColumn("rev", F.col("gpu")), current, "project", "rev", "current_rev").select("id", "project", "rev", "current_rev")


@query(
    "jn19_smoke_gate",
    f"""{duck("jobs")}, x AS (SELECT id AS job, id - id % 5 AS trial, project FROM jobs)
SELECT x.job, coalesce(t.status = 'done' AND t.retries = 0 AND t.project = x.project AND t.gpu <> 3, false) AS open FROM x LEFT JOIN jobs t ON t.id = x.trial AND t.id % 7 <> 0""",
)
def jn19(spark: SparkSession, d: str) -> DataFrame:
    jobs = frame(spark, d, "jobs")
    asked = jobs.select(F.col("id").alias("job"), (F.col("id") - F.col("id") % 5).alias("trial"), "project")
    trials = jobs.select(F.col("id").alias("trial"), F.col("status").alias("trial_status"), F.col("retries").alias("trial_rc"), F.col("project").alias("trial_binding"))
    receipts = jobs.filter("id % 7 <> 0").select(F.col("id").alias("trial"), (F.col("gpu") != 3).alias("ok"))
    return J.smoke_gate(asked, trials, receipts, "trial", "project").select("job", "open")


@query(
    "jn20_rerun_targets",
    f"""{duck("jobs")}, r AS (SELECT *, max(version) OVER w AS top, max((status = 'running')::int) OVER w AS act FROM jobs WINDOW w AS (PARTITION BY batch_id, task_id))
SELECT id, batch_id, task_id, CASE WHEN act = 1 THEN 'active_sibling' WHEN id % 8 = 0 THEN 'attempt_open' END AS reason, top + 1 AS next_version FROM r WHERE version = top AND status IN ('blocked', 'cancelled', 'timed_out', 'failed')""",
)
def jn20(spark: SparkSession, d: str) -> DataFrame:
    jobs = frame(spark, d, "jobs")
    attempts = jobs.select("id", F.expr("if(id % 8 = 0, 'running', 'exited')").alias("phase"))
    return J.rerun_targets(jobs, attempts, ["batch_id", "task_id"], "version", "status", "id", "phase").select("id", "batch_id", "task_id", "reason", "next_version")


@query(
    "jn21_task_timeline",
    f"""{duck("jobs", "batches")}, l AS (SELECT name, arg_max(id, created * 1000000 + row_seq) AS id FROM batches GROUP BY name), r AS (SELECT name AS ref, id FROM l)
SELECT ref, j.batch_id, task_id, version, finished - submitted AS seconds FROM r JOIN jobs j ON j.batch_id = r.id""",
)
def jn21(spark: SparkSession, d: str) -> DataFrame:
    batches = frame(spark, d, "batches").withColumnRenamed("id", "batch_id")
    refs = batches.select(F.col("name").alias("ref")).distinct()
    return J.task_timeline(frame(spark, d, "jobs"), refs, batches, "batch_id", "name", ["created", "row_seq"], "submitted", "finished").select("ref", "batch_id", "task_id", "version", "seconds")


@query(
    "jn22_diagnose",
    f"""{duck("jobs", "log", "projects")}, i AS (SELECT owner AS batch_id, max(seq) AS seq, arg_max(kind, seq) AS kind FROM log WHERE kind IN ('error', 'purchase') GROUP BY owner)
SELECT j.id, i.kind, i.seq, coalesce(j.gpu <> p.priority, false) AS drifted FROM jobs j LEFT JOIN i ON i.batch_id = j.batch_id LEFT JOIN projects p ON p.project = j.project WHERE j.status IN ('failed', 'blocked', 'timed_out')""",
)
def jn22(spark: SparkSession, d: str) -> DataFrame:
    log = frame(spark, d, "log").select(F.col("owner").alias("batch_id"), "kind", "seq")
    current = frame(spark, d, "projects").select("project", F.col("priority").alias("rev_now"))
    jobs = frame(spark, d, "jobs").filter("status in ('failed', 'blocked', 'timed_out')")
    out = J.diagnose(jobs, log, current, "batch_id", "project", "gpu", "rev_now", ["seq"], ["error", "purchase"])
    return out.select("id", "incident.kind", "incident.seq", "drifted")


@query(
    "jn23_dependency_facts",
    f"""{duck("batches")}, b AS (SELECT id, name, created, row_seq, CASE WHEN id % 4 = 0 THEN 'done' ELSE status END AS status FROM batches), l AS (SELECT name, id, status FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY created DESC, row_seq DESC) AS n FROM b) WHERE n = 1),
n AS (SELECT id AS batch, concat('b', (id + 1) % 130) AS source FROM b), e AS (SELECT id AS batch, (id * 2)::varchar AS source FROM b)
SELECT batch, 'name' AS kind, source, l.id AS resolved, coalesce(l.status = 'done', false) AS satisfied FROM n LEFT JOIN l ON l.name = n.source
UNION ALL SELECT batch, 'exact', source, b.id, coalesce(b.id % 3 <> 0, false) FROM e LEFT JOIN b ON b.id::varchar = e.source""",
)
def jn23(spark: SparkSession, d: str) -> DataFrame:
    b = frame(spark, d, "batches").withColumn("status", F.expr("if(id % 4 = 0, 'done', status)"))
    names = b.select(F.col("id").alias("batch"), F.concat(F.lit("b"), ((F.col("id") + 1) % 130).cast("string")).alias("source"))
    exact = b.select(F.col("id").alias("batch"), (F.col("id") * 2).cast("string").alias("source"))
    bindings = b.select(F.col("id").cast("string").alias("source"), (F.col("id") % 3 != 0).alias("bound"))
    return J.dependency_facts(names, exact, b, bindings, "id", "name", ["created", "row_seq"])


ORDER = [("o_orderstatus", True), ("o_totalprice", False), ("o_orderkey", False)]


@query(
    "top1_keyset_page",
    """WITH p AS (SELECT *, row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderstatus > 'F' OR (o_orderstatus = 'F' AND (o_totalprice < 400000 OR (o_totalprice = 400000 AND o_orderkey < 100))))
SELECT o_orderkey, o_orderstatus, n = 51 AS extra FROM p WHERE n <= 51""",
)
def top1(spark: SparkSession, d: str) -> DataFrame:
    return P.keyset_page(table(spark, d, "orders"), ORDER, 50, ["F", 400000.0, 100]).select("o_orderkey", "o_orderstatus", "extra")


@query(
    "top2_status_page",
    f"""{duck("jobs", "batches")}, b AS (SELECT id FROM batches ORDER BY created DESC, row_seq DESC LIMIT 20), p AS (SELECT j.*, row_number() OVER (ORDER BY submitted DESC, row_seq DESC) AS n FROM jobs j WHERE batch_id IN (SELECT id FROM b))
SELECT id, batch_id, n = 31 AS extra FROM p WHERE n <= 31""",
)
def top2(spark: SparkSession, d: str) -> DataFrame:
    batches = frame(spark, d, "batches").withColumnRenamed("id", "batch_id").select("batch_id", "created", F.col("row_seq").alias("batch_seq"))
    _, jobs = P.status_page(batches, frame(spark, d, "jobs"), "batch_id", [("created", False), ("batch_seq", False)], [("submitted", False), ("row_seq", False)], 20, 30)
    return jobs.select("id", "batch_id", "extra")


@query("top3_anchored_page", "SELECT event_id, user_id FROM events WHERE event_id > 100 AND event_id <= (SELECT max(event_id) FROM events) AND event_type = 'error' ORDER BY event_id LIMIT 40")
def top3(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    upper = events.agg(F.max("event_id")).first()[0] or 0
    return P.anchored_page(events, "event_id", 40, 100, upper, F.col("event_type") == "error").select("event_id", "user_id")


@query(
    "top4_tail_lines",
    """WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS a FROM documents) SELECT doc_id, array_to_string(a[greatest(1, len(a) - 2):], ' / ') AS tail FROM l""",
)
def top4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(P.tail_lines(F.col("text"), 3), " / ").alias("tail"))


@query(
    "top5_best_card",
    f"""{duck("cards")}, r AS (SELECT c_custkey AS request, c_nationkey::bigint AS node, (c_custkey % 26)::bigint AS gib FROM customer), x AS (SELECT request, card, NOT quarantined AND gib <= capacity AS ok, card % 4 = request % 4 AS pref, ((gib + 4) * 1000) // capacity AS load FROM r JOIN cards c ON c.node = r.node)
SELECT request, arg_min(card, (CASE WHEN pref THEN 0 ELSE 1 END) * 100000000 + load * 10000 + card) FILTER (ok) AS best, count(*) FILTER (ok) AS n_allowed FROM x GROUP BY request""",
)
def top5(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "customer").select(F.col("c_custkey").alias("request"), F.col("c_nationkey").cast("long").alias("node"), (F.col("c_custkey") % 26).alias("gib"))
    fits = ~F.col("quarantined") & (F.col("gib") <= F.col("capacity"))
    requests = requests.withColumn("likes", F.col("request") % 4)
    kind = ["node", "gib", "likes"]
    c = J.candidates(requests, frame(spark, d, "cards"), fits, "node", kind[1:]).withColumn("load", F.expr("((gib + 4) * 1000) div capacity")).withColumn("pref", F.col("card") % 4 == F.col("likes"))
    return requests.join(P.best_card(c, kind, "allowed", "pref", "load", "card", "card"), kind).select("request", "best", "n_allowed")


@query("set1_union_latest", f"""{duck("log")} SELECT owner, max(seq) AS seq FROM log WHERE kind = 'view' GROUP BY owner UNION SELECT owner, max(seq) FROM log WHERE kind IN ('view', 'click') GROUP BY owner""")
def set1(spark: SparkSession, d: str) -> DataFrame:
    log = frame(spark, d, "log")
    return S.union_latest(log.filter("kind = 'view'"), log.filter("kind in ('view', 'click')"), "owner", "seq")


@query(
    "set2_table_set_diff",
    """WITH b AS (SELECT DISTINCT p_brand AS t, p_size AS c FROM part WHERE p_size <= 40), a AS (SELECT DISTINCT p_brand AS t, p_size AS c FROM part WHERE p_size >= 3), w AS (SELECT DISTINCT p_brand AS t, p_size AS c FROM part WHERE p_type = 'ECONOMY')
SELECT t, c, 'removed' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT t, c, 'unapproved' FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) EXCEPT SELECT * FROM w)""",
)
def set2(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_brand").alias("t"), F.col("p_size").alias("c"), "p_type")
    return S.table_set_diff(part.filter("c <= 40").drop("p_type"), part.filter("c >= 3").drop("p_type"), part.filter("p_type = 'ECONOMY'").drop("p_type"))


@query("set3_facts_unchanged", "SELECT count(*) AS rows_before, count(*) AS rows_after, true AS unchanged FROM lineitem")
def set3(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return S.facts_unchanged(line, line.repartition("l_partkey").withColumn("audited", F.lit(0)), line.columns, {"audited": 0})


@query(
    "set3_changed_rows",
    """WITH a AS (SELECT o_orderkey, o_custkey FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM orders WHERE o_orderkey % 13 <> 0)
SELECT o_orderkey, o_custkey, 'before' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT o_orderkey, o_custkey, 'after' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
)
def set3b(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    b = a.filter("o_orderkey % 13 <> 0").withColumn("o_custkey", F.expr("if(o_orderkey % 11 = 0, o_custkey + 1, o_custkey)"))
    return S.changed_rows(a, b)


@query(
    "set4_owned_external",
    f"""{duck("log")}, p AS (SELECT owner, list_sort(list_distinct(list(k))) AS seen, list_sort(list_distinct(list(k) FILTER (kind = 'view'))) AS act, list_sort(list_distinct(list(k) FILTER (kind IN ('view', 'click')))) AS known FROM log GROUP BY owner)
SELECT owner, array_to_string(list_filter(seen, lambda x: list_contains(act, x)), ',') AS running, array_to_string(list_filter(seen, lambda x: list_contains(known, x) AND NOT list_contains(act, x)), ',') AS ended,
 array_to_string(list_filter(seen, lambda x: NOT list_contains(known, x) AND NOT list_contains(act, x)), ',') AS outside FROM p""",
)
def set4(spark: SparkSession, d: str) -> DataFrame:
    of = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("k"))))
    p = frame(spark, d, "log").groupBy("owner").agg(of(F.lit(True)).alias("seen"), of(F.col("kind") == "view").alias("act"), of(F.col("kind").isin("view", "click")).alias("known"))
    running, ended, outside = S.owned_external(F.col("seen"), F.col("act"), F.col("known"))
    return p.select("owner", F.array_join(running, ",").alias("running"), F.array_join(ended, ",").alias("ended"), F.array_join(outside, ",").alias("outside"))


@query(
    "set5_affinity_order",
    f"""{duck("jobs")}, r AS (SELECT id, list_distinct([gpu, retries + 5, 99]) AS a, [0, 1, 2, 3, 4, 5, 6, 7] AS pool, id % 2 = 0 AS hard FROM jobs),
s AS (SELECT id, hard, pool, list_filter([gpu, retries + 5, 99], lambda x: list_contains([0, 1, 2, 3, 4, 5, 6, 7], x)) AS f FROM jobs JOIN r USING (id)),
t AS (SELECT id, hard, pool, CASE WHEN len(f) = 2 AND f[1] = f[2] THEN f[1:1] ELSE f END AS f FROM s)
SELECT id, array_to_string(CASE WHEN hard THEN f ELSE list_concat(f, list_filter(pool, lambda x: NOT list_contains(f, x))) END, ',') AS cards FROM t""",
)
def set5(spark: SparkSession, d: str) -> DataFrame:
    pool = F.array(*[F.lit(x).cast("bigint") for x in range(8)])
    wish = F.array(F.col("gpu"), F.col("retries") + 5, F.lit(99).cast("bigint"))
    return frame(spark, d, "jobs").select("id", F.array_join(S.affinity_order(wish, pool, F.col("id") % 2 == 0), ",").alias("cards"))


@query(
    "set6_manifest_diff",
    """WITH b AS (SELECT url AS path, strlen(html) AS n FROM pages WHERE page_id % 7 <> 0), a AS (SELECT url AS path, CASE WHEN page_id % 5 = 0 THEN NULL ELSE strlen(html) END AS n FROM pages WHERE page_id % 11 <> 0),
b1 AS (SELECT path, max(n) AS n FROM b GROUP BY path), a1 AS (SELECT path, max(n) AS n FROM a GROUP BY path)
SELECT coalesce(b1.path, a1.path) AS path, CASE WHEN b1.path IS NULL THEN 'added' WHEN a1.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b1 FULL JOIN a1 ON a1.path = b1.path WHERE b1.path IS NULL OR a1.path IS NULL OR a1.n IS DISTINCT FROM b1.n""",
)
def set6(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.col("url").alias("path"), "page_id", F.octet_length("html").alias("n"))
    b = pages.filter("page_id % 7 <> 0").groupBy("path").agg(F.max("n").alias("n"))
    a = pages.filter("page_id % 11 <> 0").groupBy("path").agg(F.max(F.expr("if(page_id % 5 = 0, null, n)")).alias("n"))
    return S.manifest_diff(b, a, "path", ["n"])
