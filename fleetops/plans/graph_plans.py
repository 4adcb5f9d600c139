"""Graphs, file checks and table maintenance on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetops.operators import files as A
from fleetops.operators import graph as G
from fleetops.operators import maintain as M
from fleetops.plans.frames import duck, frame, table
from fleetops.plans.registry import query
from fleetops.session import scratch
from fleetops.sources import versions

EDGES = "e AS (SELECT lag(id) OVER (PARTITION BY batch_id ORDER BY submitted, row_seq) AS src, id AS dst, batch_id FROM jobs)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Each job of a batch needs the one before it."""
    w = Window.partitionBy("batch_id").orderBy("submitted", "row_seq")
    return frame(spark, d, "jobs").select(F.lag("id").over(w).alias("src"), F.col("id").alias("dst"), "batch_id").filter("src is not null")


@query(
    "gra1_build_edges",
    f"""{duck("jobs", "batches")}, l AS (SELECT name, id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY created DESC, row_seq DESC) AS n FROM batches) WHERE n = 1), t AS (SELECT DISTINCT batch_id, task_id FROM jobs)
SELECT concat('batch:', l.id) AS src, concat('gate:', b.id) AS dst, 'name' AS kind FROM batches b JOIN l ON l.name = concat('b', (b.id + 1) % 130) UNION ALL SELECT concat('task:', batch_id, '/', task_id), concat('gate:', batch_id + 1), 'exact' FROM t
UNION ALL SELECT concat('gate:', batch_id), concat('task:', batch_id, '/', task_id), 'gate' FROM t UNION ALL SELECT concat('task:', batch_id, '/', task_id), concat('batch:', batch_id), 'gate' FROM t""",
)
def gra1(spark: SparkSession, d: str) -> DataFrame:
    batches, tasks = frame(spark, d, "batches"), frame(spark, d, "jobs").select("batch_id", "task_id").distinct()
    names = batches.select(F.col("id").alias("batch"), F.concat(F.lit("b"), ((F.col("id") + 1) % 130).cast("string")).alias("source"))
    return G.build_edges(batches, tasks, names, tasks.withColumn("batch", F.col("batch_id") + 1))


@query(
    "gra2_cyclic_edges",
    f"""{duck("jobs")}, {EDGES}, c AS (SELECT batch_id, arg_min(id, submitted * 10000000 + row_seq) AS first, arg_max(id, submitted * 10000000 + row_seq) AS last, count(*) AS n FROM jobs GROUP BY batch_id HAVING batch_id % 10 = 0 AND n > 1)
SELECT src, dst FROM e WHERE src IS NOT NULL AND batch_id IN (SELECT batch_id FROM c) UNION SELECT last, first FROM c""",
)
def gra2(spark: SparkSession, d: str) -> DataFrame:
    return G.cyclic_edges(rings(spark, d))


def rings(spark: SparkSession, d: str) -> DataFrame:
    """The chains of jobs, of which one in ten goes round."""
    ends = F.struct("submitted", "row_seq")
    back = frame(spark, d, "jobs").groupBy("batch_id").agg(F.max_by("id", ends).alias("src"), F.min_by("id", ends).alias("dst")).filter("batch_id % 10 = 0 and src <> dst")
    return edges(spark, d).select("src", "dst").unionByName(back.select("src", "dst"))


RINGS = "n AS (SELECT id, batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY submitted, row_seq) AS i, count(*) OVER (PARTITION BY batch_id) AS n FROM jobs WHERE batch_id % 10 = 0), m AS (SELECT batch_id, min(id) AS component, arg_min(i, id) AS first FROM n GROUP BY batch_id)"


@query("gra2_components", f"""{duck("jobs")}, {RINGS} SELECT id AS node, component FROM n JOIN m USING (batch_id) WHERE n > 1""")
def gra2_components(spark: SparkSession, d: str) -> DataFrame:
    return G.components(rings(spark, d))


@query("gra2_cycles", f"""{duck("jobs")}, {RINGS} SELECT component, (i - first + n) % n AS place, id AS node FROM n JOIN m USING (batch_id) WHERE n > 1""")
def gra2_cycles(spark: SparkSession, d: str) -> DataFrame:
    return G.cycles(rings(spark, d))


@query(
    "gra3_blocking_paths",
    f"""{duck("jobs").replace("WITH", "WITH RECURSIVE", 1)}, {EDGES}, o AS (SELECT e.src, e.dst, j.status FROM e JOIN jobs j ON j.id = e.src WHERE j.status NOT IN ('done', 'skip')),
w(root, node, status, hops, path) AS (SELECT id, id, NULL::varchar, 0, id::varchar FROM jobs WHERE status = 'pending' UNION ALL SELECT root, o.src, o.status, hops + 1, concat(path, '/', o.src) FROM w JOIN o ON o.dst = w.node WHERE hops < 32)
SELECT root, node AS source, status, concat('source_', status) AS reason, hops, path, hops = 32 AND node IN (SELECT dst FROM o) AS truncated FROM w WHERE hops > 0""",
)
def gra3(spark: SparkSession, d: str) -> DataFrame:
    status = frame(spark, d, "jobs").select(F.col("id").alias("node"), "status")
    return G.blocking_paths(status.filter("status = 'pending'"), edges(spark, d), status, depth=32).withColumn("path", F.array_join("path", "/"))


@query(
    "gra4_lineage_root",
    f"""{duck("jobs")} SELECT id, first_value(id) OVER w AS root, row_number() OVER w - 1 AS hops FROM jobs WINDOW w AS (PARTITION BY batch_id ORDER BY submitted, row_seq)""",
)
def gra4(spark: SparkSession, d: str) -> DataFrame:
    parents = edges(spark, d).select(F.col("dst").alias("id"), F.col("src").alias("parent"))
    return G.lineage_root(frame(spark, d, "jobs").select("id").join(parents, "id", "left"), "id", "parent")


@query(
    "gra5_ready_nodes",
    f"""{duck("jobs")}, {EDGES}, s AS (SELECT dst, src, s.status FROM e LEFT JOIN jobs s ON s.id = e.src), n AS (SELECT dst, bool_and(src IS NULL OR status IN ('done', 'skip')) AS ready FROM s GROUP BY dst) SELECT dst AS node, ready FROM n""",
)
def gra5(spark: SparkSession, d: str) -> DataFrame:
    nodes = frame(spark, d, "jobs").select(F.col("id").alias("node"), "status")
    return G.ready_nodes(nodes, edges(spark, d)).select("node", "ready")


@query(
    "gra6_process_tree",
    f"""{duck("log").replace("WITH", "WITH RECURSIVE", 1)}, p AS (SELECT a.id AS pid, CASE WHEN a.id % 50 = 0 THEN a.id ELSE b.id END AS ppid FROM log a JOIN log b ON b.owner = a.owner AND b.seq = a.seq // 3), r AS (SELECT owner, id AS pid FROM log WHERE kind = 'signup'),
w(owner, pid) AS (SELECT owner, pid FROM r UNION SELECT w.owner, p.pid FROM w JOIN p ON p.ppid = w.pid) SELECT owner, pid FROM w""",
)
def gra6(spark: SparkSession, d: str) -> DataFrame:
    """Each event is the process that the one at a third of its place in its owner's log has started."""
    log = frame(spark, d, "log").select("owner", "seq", "id", "kind")
    started = log.select("owner", F.col("seq").alias("third"), F.col("id").alias("ppid"))
    parents = log.withColumn("third", F.expr("seq div 3")).join(started, ["owner", "third"])
    parents = parents.select(F.col("id").alias("pid"), F.expr("if(id % 50 = 0, id, ppid)").alias("ppid"))
    return G.process_tree(parents, log.filter("kind = 'signup'").select("owner", F.col("id").alias("pid"))).select("owner", "pid")


#: Events' JSON as output files: some torn, some without the key, some missing; sizes as rules ask.
RULES_SQL = """SELECT event_id AS job, concat('f', event_id) AS path, CASE WHEN event_id % 13 = 0 THEN 100000 END AS min_bytes, CASE WHEN event_id % 2 = 0 THEN 'json' END AS "check", CASE WHEN event_id % 3 = 0 THEN 'k' END AS has_key, event_id % 5 = 0 AS eq, CASE WHEN event_id % 77 = 1 THEN '(unclosed' WHEN event_id % 7 = 0 THEN '[5-9]' END AS regex FROM events"""


def file_rules(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, d, "events")
    equals = F.when(F.col("event_id") % 5 == 0, F.create_map(F.lit("k"), F.lit("7.0")))
    rules = events.selectExpr("event_id as job", "'out' as name", "concat('f', event_id) as path", "if(event_id % 13 = 0, 100000, null) as min_bytes", "if(event_id % 2 = 0, 'json', null) as check", "if(event_id % 3 = 0, 'k', null) as has_key", "case when event_id % 77 = 1 then '(unclosed' when event_id % 7 = 0 then '[5-9]' end as regex", "event_id").withColumn("json_equals", equals).drop("event_id")
    content = F.expr("case when event_id % 17 = 0 then '{torn' when event_id % 19 = 0 then '{\"k\":null}' when event_id % 23 = 0 then '{\"other\":1}' else props end")
    files = events.filter("event_id % 11 <> 0").select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), content.alias("content")).withColumn("length", F.octet_length("content").cast("long"))
    return rules, files


CODES = """r AS (SELECT *, event_id AS i, json_extract_string(props, '$.k')::int AS k FROM events),
s AS (SELECT i, event_id % 2 = 0 OR event_id % 3 = 0 OR event_id % 5 = 0 AS parse, CASE WHEN i % 17 = 0 THEN '{torn' WHEN i % 19 = 0 THEN '{"k":null}' WHEN i % 23 = 0 THEN '{"other":1}' ELSE props END AS content, k FROM r),
c AS (SELECT i AS job, CASE WHEN i % 11 = 0 THEN 'missing_file' WHEN i % 13 = 0 THEN 'too_small' WHEN parse AND i % 17 = 0 THEN 'invalid_json' WHEN i % 3 = 0 AND i % 23 = 0 AND i % 19 <> 0 THEN 'missing_json_key'
 WHEN i % 5 = 0 AND (i % 19 = 0 OR i % 23 = 0 OR k <> 7) THEN 'json_value_mismatch' WHEN i % 77 = 1 THEN 'invalid_regex' WHEN i % 7 = 0 AND NOT regexp_matches(content, '[5-9]') THEN 'regex_no_match' ELSE 'passed' END AS code FROM s)"""


@query("art1_check_files", f"WITH {CODES} SELECT job, code FROM c")
def art1(spark: SparkSession, d: str) -> DataFrame:
    return A.check_files(*file_rules(spark, d)).select("job", "code")


@query(
    "art2_validation_record",
    f"""WITH {CODES}, x AS (SELECT job, code = 'passed' AS passed, sha256(concat('[{{"name":"out","path":"f', job, '"}}]')) AS rules_digest, sha256(concat('[{{"name":"out","code":"', code, '"}}]')) AS codes_digest, sha256(concat('{{"job":', job, ',"user_id":', user_id, '}}')) AS context_digest
FROM c JOIN events e ON e.event_id = c.job WHERE job % 29 <> 0) SELECT *, sha256(concat_ws('|', rules_digest, codes_digest, context_digest, passed::varchar)) AS record_digest FROM x""",
)
def art2(spark: SparkSession, d: str) -> DataFrame:
    checks = A.check_files(*file_rules(spark, d))
    jobs = table(spark, d, "events").select(F.col("event_id").alias("job"), "user_id")
    return A.validation_record(checks, jobs, jobs.filter("job % 29 = 0"), "job", ["job", "user_id"]).drop("user_id")


@query("art3_verify_record", "SELECT event_id AS job, concat_ws(',', CASE WHEN event_id % 7 = 0 THEN 'context' END, CASE WHEN event_id % 5 = 0 THEN 'record' END) AS mismatches FROM events WHERE event_id % 29 <> 0")
def art3(spark: SparkSession, d: str) -> DataFrame:
    records = A.validation_record(A.check_files(*file_rules(spark, d)), table(spark, d, "events").select(F.col("event_id").alias("job"), "user_id"), table(spark, d, "events").select(F.col("event_id").alias("job")).filter("job % 29 = 0"), "job", ["job", "user_id"])
    edited = records.withColumn("user_id", F.expr("if(job % 7 = 0, user_id + 1, user_id)")).withColumn("codes_digest", F.expr("if(job % 5 = 0, 'x', codes_digest)"))
    return A.verify_record(edited, ["job", "user_id"]).select("job", F.array_join("mismatches", ",").alias("mismatches"))


SKIPS = f"""{CODES}, w AS (SELECT event_id AS job, user_id, CASE WHEN event_id % 31 = 0 THEN 'forced' WHEN event_id % 37 = 0 THEN 'no_outputs' WHEN event_id % 41 = 0 THEN 'no_fingerprint' WHEN event_id % 43 = 0 THEN 'no_producer' WHEN event_id % 47 = 0 THEN 'fingerprint_differs' WHEN event_id % 53 = 0 THEN 'dependency_changed'
 WHEN code <> 'passed' THEN 'output_failed' END AS why FROM events JOIN c ON c.job = event_id)"""


def skips(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "events").selectExpr("event_id as job", "user_id", "event_id % 31 = 0 as force", "if(event_id % 37 = 0, 0, 1) as n_outputs", "if(event_id % 41 = 0, null, 'a') as fingerprint", "event_id % 53 <> 0 as bound")
    producers = jobs.filter("job % 43 <> 0").select("job", F.expr("if(job % 47 = 0, 'b', 'a')").alias("producer_fingerprint"))
    return A.skip_decision(jobs, producers, A.check_files(*file_rules(spark, d)), "job")


@query("art4_skip_decision", f"WITH {SKIPS} SELECT job, why, why IS NULL AS skip FROM w")
def art4(spark: SparkSession, d: str) -> DataFrame:
    return skips(spark, d).select("job", "why", "skip")


@query(
    "art5_dry_run",
    f"""WITH {SKIPS}, n AS (SELECT user_id, why, count(*) AS n FROM w GROUP BY ALL)
SELECT user_id, sum(n)::bigint AS tasks, coalesce(sum(n) FILTER (why IS NULL), 0)::bigint AS skipped, coalesce(string_agg(concat(why, '=', n), ',' ORDER BY why) FILTER (why IS NOT NULL), '') AS run_because FROM n GROUP BY user_id""",
)
def art5(spark: SparkSession, d: str) -> DataFrame:
    out = A.dry_run(skips(spark, d), "user_id")
    return out.withColumn("run_because", F.array_join(F.transform(F.map_entries("run_because"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


@query("art6_stage_reuse", f"WITH {CODES} SELECT job, coalesce(job % 31 <> 0 AND job % 37 <> 0 AND job % 41 <> 0 AND code = 'passed', false) AS reuse FROM c")
def art6(spark: SparkSession, d: str) -> DataFrame:
    stages = table(spark, d, "events").selectExpr("event_id as job", "event_id % 31 = 0 as force", "cast(user_id as string) as fingerprint")
    sidecars = stages.filter("job % 37 <> 0").select("job", F.expr("if(job % 41 = 0, 2, 1)").alias("schema"), "fingerprint")
    return A.stage_reuse(stages, sidecars, A.check_files(*file_rules(spark, d)), ["job"]).select("job", "reuse")


@query(
    "mnt1_upsert_latest",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT o_orderkey + 10000000, 'N' FROM orders WHERE o_orderkey % 50 = 0",
)
def mnt1(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(1).alias("version"))
    updates = orders.filter("o_orderkey % 11 = 0").withColumn("o_orderstatus", F.lit("X")).unionByName(orders.filter("o_orderkey % 50 = 0").select(F.col("o_orderkey") + 10000000, F.lit("N"), F.lit(2)).toDF("o_orderkey", "o_orderstatus", "version"))
    at, schema = scratch(spark, "upsert"), ", ".join(f"{n} {t}" for n, t in orders.dtypes)
    versions.append(orders, at)
    M.commit_upsert(at, schema, updates, ["o_orderkey"], ["version"], writer="w", batch=1)
    M.commit_upsert(at, schema, orders.limit(0), ["o_orderkey"], ["version"], writer="w", batch=1)  # in already
    return versions.read_version(spark, at, schema).select("o_orderkey", "o_orderstatus")


@query("mnt2_insert_missing", "SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'N' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def mnt2(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    at, schema = scratch(spark, "insert"), ", ".join(f"{n} {t}" for n, t in orders.dtypes)
    versions.append(orders.filter("o_orderkey % 13 <> 0"), at)
    for _ in range(2):
        M.commit_missing(at, schema, orders.withColumn("o_orderstatus", F.lit("N")), ["o_orderkey"], ["o_orderkey"])
    return versions.read_version(spark, at, schema)


@query("mnt3_receipt_append", "SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'conflict' ELSE 'new' END WHEN o_orderkey % 11 = 0 THEN 'conflict' ELSE 'replay' END AS outcome, count(*) AS n FROM orders GROUP BY ALL")
def mnt3(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("binding"))
    rows = orders.withColumn("binding", F.expr("if(o_orderkey % 11 = 0 and o_orderkey % 13 <> 0, binding + 1, binding)"))
    twice = orders.filter("o_orderkey % 39 = 0").withColumn("binding", F.col("binding") + 5)
    out = M.receipt_append(orders.filter("o_orderkey % 13 <> 0"), rows.unionByName(twice), "o_orderkey", "binding")
    return out.groupBy("o_orderkey", "outcome").agg(F.lit(1).cast("long").alias("n"))


@query(
    "mnt4_compact_outputs",
    f"""{duck("jobs")}, m AS (SELECT max(submitted) - 86400 * 900 AS t FROM jobs), r AS (SELECT jobs.*, submitted >= t AS young FROM jobs, m), s AS (SELECT *, row_number() OVER (PARTITION BY batch_id, young ORDER BY submitted DESC, row_seq DESC) AS n FROM r),
k AS (SELECT *, status = 'done' AND NOT (young AND n <= 2) AS old FROM s) SELECT id, CASE WHEN NOT old THEN request END AS request, old AS compacted FROM k""",
)
def mnt4(spark: SparkSession, d: str) -> DataFrame:
    jobs = frame(spark, d, "jobs")
    oldest = (jobs.agg(F.max("submitted")).first()[0] or 0) - 86400 * 900
    return M.compact_outputs(jobs, ["request"], F.col("status") == "done", "submitted", ["submitted", "row_seq"], 2, oldest, ["batch_id"]).select("id", "request", "compacted")


@query(
    "mnt5_prune",
    f"""{duck("log")}, m AS (SELECT max(moment) - 86400 * 20 AS t FROM log), i AS (SELECT id, moment, CASE WHEN k % 10 = 0 THEN NULL ELSE owner END AS job FROM log), y AS (SELECT id FROM i, m WHERE moment >= t ORDER BY moment DESC, id DESC LIMIT 1000),
x AS (SELECT DISTINCT owner FROM log WHERE cents > 30000) SELECT id, job FROM i WHERE id IN (SELECT id FROM y) OR EXISTS (SELECT 1 FROM x WHERE x.owner = i.job)""",
)
def mnt5(spark: SparkSession, d: str) -> DataFrame:
    log = frame(spark, d, "log")
    oldest = (log.agg(F.max("moment")).first()[0] or 0) - 86400 * 20
    incidents = log.select("id", "moment", F.when(F.col("k") % 10 != 0, F.col("owner")).alias("job"))
    return M.prune(incidents, "moment", ["moment", "id"], 1000, oldest, log.filter("cents > 30000").select(F.col("owner").alias("job")), "job").select("id", "job")


@query("mnt6_migrate_rows", f"""{duck("jobs")} SELECT id, CASE status WHEN 'interrupted' THEN 'failed' WHEN 'pending' THEN 'queued' ELSE status END AS status, CASE WHEN retries = 0 THEN 9 ELSE retries END AS retries, 0 AS revision FROM jobs""")
def mnt6(spark: SparkSession, d: str) -> DataFrame:
    jobs = frame(spark, d, "jobs").withColumn("retries", F.when(F.col("retries") != 0, F.col("retries")))
    return M.migrate_rows(jobs, {"retries": 9, "revision": 0}, {"interrupted": "failed", "pending": "queued"}, "status").select("id", "status", "retries", "revision")


@query(
    "mnt7_quality_report",
    f"""{duck("jobs")} SELECT 'finished' AS "column", true AS present, true AS typed, count(*) AS rows, count(*) FILTER (finished IS NULL) AS nulls FROM jobs UNION ALL SELECT 'status', true, false, count(*), 0 FROM jobs UNION ALL SELECT 'pgid', false, false, count(*), count(*) FROM jobs""",
)
def mnt7(spark: SparkSession, d: str) -> DataFrame:
    return M.quality_report(frame(spark, d, "jobs"), {"finished": "bigint", "status": "int", "pgid": "bigint"})
