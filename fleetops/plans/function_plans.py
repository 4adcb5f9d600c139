"""Predicates, row validation and scalar functions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetops.functions import scalars as X
from fleetops.functions import validation as V
from fleetops.plans.frames import duck, frame, table
from fleetops.plans.registry import query


def joined(c: Column | str) -> Column:
    return F.array_join(c, ",")


def projects(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "projects")


@query(
    "prj1_validate_specs",
    f"""{duck("jobs")}, t AS (SELECT id, batch_id AS batch, CASE WHEN id % 50 = 0 THEN '../x' ELSE concat(task_id, '') END AS raw, CASE WHEN id % 31 = 0 THEN NULL WHEN id % 37 = 0 THEN 'nobody' ELSE project END AS project,
 CASE WHEN id % 41 = 0 THEN 'solo' ELSE 'mix' END AS mode, CASE WHEN id % 43 = 0 THEN 2 ELSE id % 2 END AS gpu, id % 3 = 0 AS share, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 47 = 0 THEN -1 ELSE gpu + 1 END AS vram, CASE WHEN id % 53 = 0 THEN -1 ELSE retries END AS retries, id % 59 = 0 AS odd FROM jobs),
u AS (SELECT *, replace(raw, ' ', '_') AS task FROM t), w AS (SELECT *, count(*) OVER (PARTITION BY batch, task) AS n FROM u)
SELECT id, concat_ws(',', CASE WHEN project IS NULL THEN 'project_missing' END, CASE WHEN project = 'nobody' THEN 'project_unknown' END, CASE WHEN mode <> 'mix' THEN 'mode' END, CASE WHEN task = '../x' THEN 'task_id' END,
 CASE WHEN n > 1 THEN 'task_repeated' END, CASE WHEN gpu = 2 THEN 'gpu' END, CASE WHEN share AND vram IS NULL THEN 'share_without_vram' END, CASE WHEN vram <= 0 THEN 'vram' END, CASE WHEN retries < 0 THEN 'retries' END, CASE WHEN odd THEN 'unknown_key' END) AS reasons FROM w""",
)
def prj1(spark: SparkSession, d: str) -> DataFrame:
    tasks = frame(spark, d, "jobs").selectExpr(
        "id", "batch_id as batch", "if(id % 50 = 0, '../x', replace(task_id, ' ', '_')) as task", "case when id % 31 = 0 then null when id % 37 = 0 then 'nobody' else project end as project", "if(id % 41 = 0, 'solo', 'mix') as mode",
        "if(id % 43 = 0, 2, id % 2) as gpu", "id % 3 = 0 as gpu_share", "cast(case when id % 4 = 0 then null when id % 47 = 0 then -1 else gpu + 1 end as double) as vram", "if(id % 53 = 0, -1, retries) as retries", "if(id % 59 = 0, array('gpu', 'colour'), array('gpu')) as keys",
    )
    return V.validate_specs(tasks, projects(spark, d), ["gpu", "vram"]).select("id", joined("reasons").alias("reasons"))


@query("prj2_valid_identifier", "SELECT page_id, regexp_matches(url, '^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$') AS url_valid, regexp_matches(replace(replace(url, '/', '-'), ':', '.'), '^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$') AS name_valid FROM pages")
def prj2(spark: SparkSession, d: str) -> DataFrame:
    name = F.replace(F.replace("url", F.lit("/"), F.lit("-")), F.lit(":"), F.lit("."))
    return table(spark, d, "pages").select("page_id", V.valid_identifier(F.col("url")).alias("url_valid"), V.valid_identifier(name).alias("name_valid"))


@query(
    "prj3_validate_rules",
    """WITH r AS (SELECT l_orderkey AS job, l_partkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT job, l_partkey, l_linenumber, concat_ws(',', CASE WHEN l_partkey % 29 = 0 THEN 'unknown_key' END, CASE WHEN l_partkey % 7 IN (0, 1) THEN 'path' END, CASE WHEN l_linenumber = 5 OR l_linenumber = 6 THEN 'min_bytes' END, CASE WHEN l_partkey % 11 = 0 THEN 'check' END, CASE WHEN n > 600 THEN 'too_many' END) AS reasons FROM r""",
)
def prj3(spark: SparkSession, d: str) -> DataFrame:
    entries = F.expr(
        "map_filter(map('path', case l_partkey % 7 when 0 then '/etc/x' when 1 then 'a/../b' else 'out/a.json' end, 'min_bytes', case l_linenumber when 5 then '-1' when 6 then 'ten' else '10' end, 'check', if(l_partkey % 11 = 0, 'xml', 'json'), if(l_partkey % 29 = 0, 'colour', 'regex'), 'x'), (k, v) -> v is not null)"
    )
    rules = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job"), "l_partkey", "l_linenumber", "l_suppkey", entries.alias("rule"))
    return V.validate_rules(rules, "l_suppkey", 600).select("job", "l_partkey", "l_linenumber", joined("reasons").alias("reasons"))


@query(
    "prj4_refused_env",
    f"""{duck("jobs")} SELECT id, concat_ws(',', CASE WHEN id % 3 = 0 THEN 'LD_PRELOAD' END, CASE WHEN id % 4 = 0 THEN 'BASH_ENV' END, CASE WHEN id % 5 = 0 THEN 'bad-name' END, CASE WHEN id % 7 = 0 THEN 'FLEET_CONTEXT' END) AS refused FROM jobs""",
)
def prj4(spark: SparkSession, d: str) -> DataFrame:
    env = F.expr("map('PATH', '1', if(id % 3 = 0, 'LD_PRELOAD', 'A1'), 'x', if(id % 4 = 0, 'BASH_ENV', 'A2'), 'x', if(id % 5 = 0, 'bad-name', '_A3'), 'x', if(id % 7 = 0, 'FLEET_CONTEXT', '_A4'), 'x')")
    refused = V.refused_env(env, [*V.BANNED_ENV, "FLEET_CONTEXT"])
    return frame(spark, d, "jobs").select("id", joined(F.map_keys(refused)).alias("refused"))


@query(
    "prj5_resolve_templates",
    f"""{duck("jobs")} SELECT id, concat('run ', CASE WHEN gpu < 5 THEN concat('/srv/{{ROOT}}', gpu) ELSE concat('{{G', gpu, '}}') END, '/', '/data', '/', '/data') AS resolved, CASE WHEN gpu < 5 THEN '' ELSE concat('G', gpu) END AS unresolved FROM jobs""",
)
def prj5(spark: SparkSession, d: str) -> DataFrame:
    jobs = frame(spark, d, "jobs")
    names = jobs.filter("gpu < 5").select(F.concat(F.lit("G"), F.col("gpu").cast("string")).alias("name"), F.concat(F.lit("/srv/{ROOT}"), F.col("gpu").cast("string")).alias("value")).distinct()
    names = names.unionByName(spark.createDataFrame([("ROOT", "/data")], "name string, value string"))
    jobs = jobs.select("id", F.concat(F.lit("run {G"), F.col("gpu").cast("string"), F.lit("}/{ROOT}/{ROOT}")).alias("command"))
    return V.resolve_templates(jobs, "command", names, "id").select("id", "resolved", joined("unresolved").alias("unresolved"))


@query(
    "prj6_wait_reason",
    f"""{duck("jobs", "batches", "projects")}, r AS (SELECT project, count(*) AS n FROM jobs WHERE status = 'running' GROUP BY project)
SELECT j.id, CASE WHEN gpu > 0 AND NOT coalesce(enabled, false) THEN 'project_gpu_disabled' WHEN j.id % 71 = 0 THEN 'draining' WHEN b.status = 'queued' THEN 'dependency' WHEN b.status <> 'active' THEN 'batch_blocked'
 WHEN j.id % 19 = 0 THEN 'quota' WHEN j.id % 23 = 0 THEN 'dependency' WHEN gpu > 0 AND quota > 0 AND r.n >= quota THEN 'quota' WHEN j.id % 6 = 0 OR j.id % 10 = 0 THEN 'cpu' WHEN j.id % 4 = 0 THEN 'host_memory' WHEN retries = 1 THEN 'parallel' END AS reason
FROM jobs j JOIN batches b ON b.id = j.batch_id LEFT JOIN projects p ON p.project = j.project LEFT JOIN r ON r.project = j.project WHERE j.status = 'pending'""",
)
def prj6(spark: SparkSession, d: str) -> DataFrame:
    jobs = frame(spark, d, "jobs")
    running = jobs.filter("status = 'running'").groupBy("project").agg(F.count("*").alias("n"))
    batches = frame(spark, d, "batches").select(F.col("id").alias("batch_id"), F.col("status").alias("batch"))
    rows = jobs.filter("status = 'pending'").join(batches, "batch_id").join(projects(spark, d).select("project", "quota", "enabled"), "project", "left").join(running, "project", "left")
    i = F.col("id")
    stored = F.when(i % 19 == 0, "waiting_quota").when(i % 23 == 0, "waiting_dep").otherwise("pending")
    cpu = F.when(i % 10 == 0, None).otherwise(i % 6 == 0)
    why = V.wait_reason(stored, F.col("gpu"), F.col("quota"), F.col("n"), F.col("enabled"), F.col("batch"), i % 71 == 0, cpu, i % 4 == 0, F.when(F.col("retries") == 1, "parallel").otherwise("weather"))
    return rows.select("id", why.alias("reason"))


@query("prj7_state_rank", f"""{duck("jobs")} SELECT id, CASE WHEN status IN ('done', 'discarded', 'cancelled') THEN 1 ELSE 0 END AS rank FROM jobs""")
def prj7(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "jobs").select("id", V.state_rank(F.col("status")).alias("rank"))


@query("prj8_history_filter", f"""{duck("jobs")} SELECT id, status, project FROM jobs WHERE status IN ('done', 'failed') AND project = 'p4'""")
def prj8(spark: SparkSession, d: str) -> DataFrame:
    return V.history_filter(frame(spark, d, "jobs"), "status", ["done", "failed", "running"], project="p4", batch_id=None).select("id", "status", "project")


@query("prj9_incident_filter", "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 100")
def prj9(spark: SparkSession, d: str) -> DataFrame:
    return V.incident_filter(table(spark, d, "events"), "event_id", 100, event_type="error", user_id=None).select("event_id", "user_id")


@query(
    "prj10_freshness",
    f"""{duck("log")}, m AS (SELECT max(moment) - 864000 AS t FROM log) SELECT id, CASE WHEN k % 10 = 0 THEN 'missing' WHEN moment > t THEN 'future' WHEN t - moment > 604800 THEN 'stale' ELSE 'valid' END AS fresh FROM log, m""",
)
def prj10(spark: SparkSession, d: str) -> DataFrame:
    log = frame(spark, d, "log")
    now = (log.agg(F.max("moment")).first()[0] or 0) - 864000
    return log.select("id", V.freshness(F.when(F.col("k") % 10 != 0, F.col("moment")), now, 604800).alias("fresh"))


@query("prj11_spec_field", "SELECT event_id, json_extract_string(props, '$.k')::bigint AS k, 7::bigint AS missing FROM events")
def prj11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", V.spec_field(F.col("props"), "$.k", "bigint", 5).alias("k"), V.spec_field(F.col("props"), "$.none", "bigint", 7).alias("missing"))


@query("prj12_privileged_tokens", f"""{duck("jobs")} SELECT id, id % 4 IN (0, 1) AS privileged FROM jobs""")
def prj12(spark: SparkSession, d: str) -> DataFrame:
    token = F.expr("case id % 4 when 0 then 'sudo' when 1 then '/bin/su' when 2 then 'visudo' else 'sudoku' end")
    return frame(spark, d, "jobs").select("id", V.privileged_tokens(F.array(F.lit("bash"), token, F.lit("x"))).alias("privileged"))


@query(
    "prj13_expand_sweep",
    """WITH m AS (SELECT p_brand, list_sort(list(DISTINCT p_size % 4)) AS s, list_sort(list(DISTINCT p_type)) AS t FROM part GROUP BY p_brand),
x AS (SELECT p_brand, (i - 1) * len(t) + (j - 1) AS combo_no, s[i] AS size, t[j] AS type FROM m, generate_series(1, len(s)) AS a(i), generate_series(1, len(t)) AS b(j))
SELECT p_brand, combo_no::int AS combo_no, concat(size, '_', type) AS suffix, false AS too_many FROM x""",
)
def prj13(spark: SparkSession, d: str) -> DataFrame:
    of = lambda c: F.array_sort(F.collect_set(c.cast("string")))
    matrix = table(spark, d, "part").groupBy("p_brand").agg(F.create_map(F.lit("a_size"), of(F.col("p_size") % 4), F.lit("b_type"), of(F.col("p_type"))).alias("matrix"))
    return V.expand_sweep(matrix, "matrix").select("p_brand", "combo_no", "suffix", "too_many")


@query(
    "prj14_normalize_selectors",
    f"""{duck("jobs")}, s AS (SELECT batch_id AS batch, 'i1' AS instance, batch_id % 9 AS b, CASE WHEN id % 29 = 0 THEN NULL ELSE task_id END AS t, CASE WHEN id % 31 = 0 THEN 0 ELSE version END AS v FROM jobs),
c AS (SELECT *, count(*) OVER (PARTITION BY batch, instance, b, t, v) AS n FROM s) SELECT batch, count(*) AS selectors, count(*) FILTER (t IS NULL OR t LIKE '% %' OR v < 1) AS malformed, count(*) FILTER (n > 1) AS duplicate FROM c GROUP BY batch""",
)
def prj14(spark: SparkSession, d: str) -> DataFrame:
    one = F.expr("struct('i1' as instance, cast(batch_id % 9 as string) as batch_id, if(id % 29 = 0, null, task_id) as task_id, if(id % 31 = 0, 0, version) as version)")
    asked = frame(spark, d, "jobs").groupBy(F.col("batch_id").alias("batch")).agg(F.collect_list(one).alias("selectors"))
    rows = V.normalize_selectors(asked, "batch", "selectors")
    has = lambda r: F.count_if(F.array_contains("reasons", r)).alias(r)
    return rows.groupBy("batch").agg(F.count("*").alias("selectors"), has("malformed"), has("duplicate"))


FACTS = "case when id % 13 = 0 then 'torn' else concat('{\"backend\":\"', project, '\",\"phase\":\"', case when id % 3 = 0 then 'running' else 'exited' end, '\",\"cleanup\":\"', case when id % 5 = 0 then 'pending' when id % 7 = 0 then 'lost' else 'confirmed' end, '\",\"exit_known\":', case when id % 11 = 0 then 'false' else 'true' end, '}') end"


@query(
    "prj15_execution_summary",
    f"""{duck("jobs")}, f AS (SELECT id, id % 13 = 0 AS torn, project, CASE WHEN id % 3 = 0 THEN 'running' ELSE 'exited' END AS phase, CASE WHEN id % 5 = 0 THEN 'pending' WHEN id % 7 = 0 THEN 'unknown' ELSE 'confirmed' END AS cleanup, id % 11 <> 0 AS known FROM jobs),
g AS (SELECT id, CASE WHEN torn THEN 'native' ELSE project END AS kind, CASE WHEN torn THEN 'unknown' ELSE phase END AS phase, CASE WHEN torn THEN 'unknown' ELSE cleanup END AS cleanup, CASE WHEN torn THEN 'unreadable' WHEN phase = 'exited' AND NOT known THEN 'exit_unknown' WHEN cleanup = 'unknown' THEN 'cleanup_unknown' END AS uncertain FROM f)
SELECT *, uncertain IS NOT NULL OR cleanup <> 'confirmed' OR phase <> 'exited' AS replay_blocked FROM g""",
)
def prj15(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "jobs").select("id", F.expr(FACTS).alias("facts")).select("id", V.execution_summary(F.col("facts")).alias("s")).select("id", "s.*")


@query(
    "prj16_gpu_access",
    f"""{duck("jobs", "projects")} SELECT j.id, CASE WHEN j.gpu = 0 THEN NULL WHEN NOT coalesce(enabled, false) THEN 'project_gpu_disabled' WHEN j.id % 2 = 0 AND j.gpu > 3 THEN 'no_card_in_pool' END AS reason FROM jobs j LEFT JOIN projects p ON p.project = j.project""",
)
def prj16(spark: SparkSession, d: str) -> DataFrame:
    rows = frame(spark, d, "jobs").join(projects(spark, d).select("project", "enabled"), "project", "left")
    pool = F.array(*[F.lit(x).cast("bigint") for x in range(4)])
    return rows.select("id", V.gpu_access(F.col("gpu"), F.col("enabled"), F.col("id") % 2 == 0, F.array("gpu"), pool).alias("reason"))


@query("prj17_cleanup_due", f"""{duck("jobs")}, m AS (SELECT max(submitted) - 31536000 AS t FROM jobs) SELECT id FROM jobs, m WHERE id % 3 = 0 AND submitted <= t AND status <> 'running' ORDER BY submitted, row_seq LIMIT 200""")
def prj17(spark: SparkSession, d: str) -> DataFrame:
    jobs = frame(spark, d, "jobs")
    now = (jobs.agg(F.max("submitted")).first()[0] or 0) - 31536000
    cleanups = jobs.select("id", F.expr("if(id % 3 = 0, 'pending', 'confirmed')").alias("cleanup"), F.col("submitted").alias("retry_after"), "row_seq")
    return V.cleanup_due(cleanups, jobs.select("id", "status"), "id", now, 200, ["retry_after", "row_seq"]).select("id")


LOG_SQL = "CASE doc_id % 5 WHEN 0 THEN 'torch.OutOfMemoryError: CUDA, Xid 79' WHEN 1 THEN 'an ECC error' WHEN 2 THEN 'open: EACCES' WHEN 3 THEN 'maXid, xid, out of memory' ELSE '' END"


def logs(spark: SparkSession, d: str) -> DataFrame:
    """Documents as task logs: a line that tells the failure, and one that tells progress, amid the text."""
    return table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\nepoch 3/9\n"), F.expr(LOG_SQL), F.lit("\nstep: "), (F.col("doc_id") % 100).cast("string"), F.when(F.col("doc_id") % 2 == 0, "/200").otherwise(""), F.lit(" epoch 9/9\nend")).alias("log"))


@query("prj18_log_classify", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'oom' WHEN 1 THEN 'gpu_fault' WHEN 2 THEN 'perm' ELSE 'error' END AS class FROM documents")
def prj18(spark: SparkSession, d: str) -> DataFrame:
    return logs(spark, d).select("doc_id", V.log_classify(F.col("log")).alias("class"))


@query(
    "prj19_recoverable",
    f"""{duck("jobs")} SELECT id, CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN 'policy' WHEN retries >= 2 THEN 'attempt_limit' WHEN id % 11 = 0 THEN 'state_changed' WHEN gpu = 7 THEN 'spec_changed' WHEN id % 4 = 0 THEN 'no_checkpoint' END AS reason FROM jobs WHERE status = 'failed' OR status = 'timed_out'""",
)
def prj19(spark: SparkSession, d: str) -> DataFrame:
    i, jobs = F.col("id"), frame(spark, d, "jobs").filter("status in ('failed', 'timed_out')")
    policy = F.when(i % 7 == 0, None).otherwise(i % 5 != 0)
    why = V.recoverable(policy, F.col("retries"), F.lit(2), F.col("status"), F.when(i % 11 == 0, "done").otherwise(F.col("status")), F.col("gpu"), F.when(F.col("gpu") != 7, F.col("gpu")), i % 4 != 0)
    return jobs.select("id", why.alias("reason"))


@query(
    "prj20_health_state",
    f"""{duck("log")}, m AS (SELECT max(moment) - 300 AS t FROM log), n AS (SELECT owner, max(moment) AS beat, max(moment) FILTER (kind = 'view') AS tick, owner % 10 <> 0 AS up FROM log GROUP BY owner),
a AS (SELECT owner, up, tick, (t - beat) // 400 AS age, (t - tick) // 4000 AS idle FROM n, m)
SELECT owner, CASE WHEN age < -5 THEN 'unknown' WHEN NOT up THEN 'stopped' WHEN idle > 90 THEN 'stalled' WHEN age < 60 AND tick IS NOT NULL THEN 'healthy' ELSE 'delayed' END AS state FROM a""",
)
def prj20(spark: SparkSession, d: str) -> DataFrame:
    log = frame(spark, d, "log")
    now = (log.agg(F.max("moment")).first()[0] or 0) - 300
    nodes = log.groupBy("owner").agg(F.max("moment").alias("beat"), F.max(F.when(F.col("kind") == "view", F.col("moment"))).alias("tick"))
    beat, tick = (-F.floor((F.lit(now) - F.col(c)) / n) for c, n in (("beat", 400), ("tick", 4000)))
    return nodes.select("owner", V.health_state(beat, tick, F.col("owner") % 10 != 0, 0).alias("state"))


@query(
    "prj21_restart_interrupted",
    f"""{duck("jobs", "log")}, b AS (SELECT owner, max(moment) FILTER (kind = 'signup') AS booted, max(moment) FILTER (kind = 'view') AS beat FROM log GROUP BY owner)
SELECT j.id, b.owner AS node FROM jobs j JOIN b ON b.owner = j.batch_id WHERE j.status = 'running' AND booted IS NOT NULL AND (beat IS NULL OR booted > beat) AND j.id % 6 <> 0""",
)
def prj21(spark: SparkSession, d: str) -> DataFrame:
    log = frame(spark, d, "log").withColumnRenamed("owner", "node")
    boots, beats = (log.filter(F.col("kind") == k).select("node", F.col("moment").alias(c)) for k, c in (("signup", "booted"), ("view", "at")))
    jobs = frame(spark, d, "jobs").withColumn("node", F.col("batch_id"))
    return V.restart_interrupted(jobs, boots, beats, jobs.filter("id % 6 = 0"), "node", "id").select("id", "node")


@query("sca1_canonical_json", f"""{duck("jobs")} SELECT id, concat('{{"gpu":', gpu, ',"id":', id, ',"zone":', CASE WHEN id % 2 = 0 THEN 'null' ELSE concat('"', project, '"') END, '}}') AS doc FROM jobs""")
def sca1(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "jobs").select("id", X.canonical_json({"zone": F.when(F.col("id") % 2 != 0, F.col("project")), "id": F.col("id"), "gpu": F.col("gpu")}).alias("doc"))


@query("sca1_canonical_text", "SELECT event_id, concat('{\"a\":[1,2],\"k\":', json_extract_string(props, '$.k'), '}') AS doc FROM events")
def sca1b(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.substring("props", 1, F.length("props") - 1), F.lit(', "a" : [1,  2]}'))
    return table(spark, d, "events").select("event_id", X.canonical_text()(text).alias("doc"))


@query("sca2_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def sca2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.digest(F.col("text")).alias("digest"))


@query(
    "sca3_cursor",
    f"""{duck("jobs")} SELECT id, rtrim(translate(to_base64(encode(concat('["', status, '","', id, '"]'))), '+/', '-_'), '=') AS cursor, status AS s, id AS i, true AS bad_is_null FROM jobs""",
)
def sca3(spark: SparkSession, d: str) -> DataFrame:
    rows = frame(spark, d, "jobs").select("id", X.encode_cursor([F.col("status"), F.col("id")]).alias("cursor"))
    bad = X.decode_cursor(F.concat("cursor", F.lit("!")), ["string", "bigint"]).isNull() & X.decode_cursor(F.col("cursor"), ["bigint", "bigint"]).isNull()
    rows = rows.withColumn("back", X.decode_cursor(F.col("cursor"), ["string", "bigint"]))
    return rows.select("id", "cursor", F.col("back._1").alias("s"), F.col("back._2").alias("i"), bad.alias("bad_is_null"))


@query(
    "sca4_json_equal",
    "SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN NULL ELSE json_extract_string(props, '$.k')::int = 7 END AS same FROM events",
)
def sca4(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    a = F.expr("case event_id % 6 when 0 then '1' when 1 then 'true' when 2 then '\"x\"' when 3 then '\"1\"' when 4 then '{torn' end")
    b = F.expr("case event_id % 6 when 0 then '1.0' when 1 then '1' when 2 then '\"x\"' when 3 then '1' when 4 then '1' else '7' end")
    return table(spark, d, "events").select("event_id", X.json_equal(F.coalesce(a, k), b).alias("same"))


@query("sca5_json_path", "SELECT event_id, event_id % 3 <> 2 AS found, CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') END AS value FROM events")
def sca5(spark: SparkSession, d: str) -> DataFrame:
    doc = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"a":'), "props", F.lit("}"))).when(F.col("event_id") % 3 == 1, '{"a":{"k":null}}').otherwise('{"a":{}}')
    return table(spark, d, "events").select("event_id", X.json_path(doc, "a.k").alias("p")).select("event_id", "p.found", "p.value")


@query("sca6_duration_seconds", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 3600 + 86400)::bigint END AS seconds FROM orders")
def sca6(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderkey") % 3600
    start = F.when(F.col("o_orderkey") % 5 == 0, "yesterday").otherwise(F.date_format(F.col("o_orderdate"), "yyyy-MM-dd HH:mm:ss"))
    end = F.concat(F.date_format(F.date_add(F.col("o_orderdate"), 1), "yyyy-MM-dd"), F.lit(" 00:"), F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    return table(spark, d, "orders").select("o_orderkey", X.duration_seconds(start, end).alias("seconds"))


@query("sca7_last_match", "SELECT doc_id, list_extract(regexp_extract_all(text, '[A-Za-z]{7,}'), -1) AS word FROM documents")
def sca7(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.last_match(F.col("text"), "[A-Za-z]{7,}", 1000).alias("word"))


@query("sca8_progress", "SELECT doc_id, concat(doc_id % 100, '/', CASE WHEN doc_id % 2 = 0 THEN '200' ELSE '?' END) AS progress FROM documents")
def sca8(spark: SparkSession, d: str) -> DataFrame:
    return logs(spark, d).select("doc_id", X.progress(F.col("log")).alias("progress"))


@query(
    "sca9_log_excerpt",
    f"""WITH l AS (SELECT doc_id, string_split(concat(text, chr(10), 'epoch 3/9', chr(10), {LOG_SQL}, chr(10), 'step: ', doc_id % 100, CASE WHEN doc_id % 2 = 0 THEN '/200' ELSE '' END, ' epoch 9/9', chr(10), 'end'), chr(10)) AS a FROM documents),
p AS (SELECT doc_id, a, list_position(list_transform(a, lambda x: regexp_matches(x, '^epoch|EACCES')), true) AS h FROM l) SELECT doc_id, right(array_to_string(a[greatest(1, h - 2):h + 2], chr(10)), 4096) AS excerpt FROM p""",
)
def sca9(spark: SparkSession, d: str) -> DataFrame:
    return logs(spark, d).select("doc_id", X.log_excerpt(F.col("log"), "^epoch|EACCES", 2).alias("excerpt"))


@query("sca10_sizes", f"""{duck("jobs")} SELECT id, round_even(request / 1024, 2) AS gib, (request * 1073741824)::bigint AS bytes FROM jobs""")
def sca10(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "jobs").select("id", X.mib_to_gib(F.col("request")).alias("gib"), X.gib_to_bytes(F.col("request")).alias("bytes"))


@query("sca11_profile_key", f"""{duck("jobs")} SELECT id, CASE WHEN id % 3 <> 0 THEN concat('["', project, '","', task_id, '"]') END AS key FROM jobs""")
def sca11(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "jobs").select("id", X.profile_key(F.col("project"), F.when(F.col("id") % 3 != 0, F.col("task_id"))).alias("key"))


@query("sca12_completion_key", f"""{duck("jobs")} SELECT id, sha256(concat('{{"id":', id, ',"retries":', retries, ',"version":', version, '}}')) AS key FROM jobs""")
def sca12(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "jobs").select("id", X.completion_key({c: F.col(c) for c in ("version", "id", "retries")}).alias("key"))


@query("sca13_fingerprint", f"""{duck("jobs")} SELECT id, CASE WHEN id % 6 <> 0 THEN sha256(concat('{{"cmd":"', task_id, '","env":', CASE WHEN id % 2 = 0 THEN 'null' ELSE gpu::varchar END, ',"rev":', request, '}}')) END AS fingerprint FROM jobs""")
def sca13(spark: SparkSession, d: str) -> DataFrame:
    need = {"cmd": F.col("task_id"), "rev": F.when(F.col("id") % 6 != 0, F.col("request"))}
    return frame(spark, d, "jobs").select("id", X.fingerprint(need, {"env": F.when(F.col("id") % 2 != 0, F.col("gpu"))}).alias("fingerprint"))


@query("sca14_load_after", f"""{duck("cards")} SELECT card, CASE WHEN card % 4 = 0 THEN 0.0 ELSE (card % 8 + 3) / capacity END AS load FROM cards""")
def sca14(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "cards").select("card", X.load_after(F.col("card") % 8, F.lit(3), F.when(F.col("card") % 4 != 0, F.col("capacity"))).alias("load"))


@query("sca15_state_filter_text", f"""{duck("jobs")} SELECT id, CASE WHEN status = 'pending' OR id % 9 = 0 THEN 'pending' ELSE status END AS shown FROM jobs""")
def sca15(spark: SparkSession, d: str) -> DataFrame:
    stored = F.when(F.col("id") % 9 == 0, "waiting_quota").otherwise(F.col("status"))
    return frame(spark, d, "jobs").select("id", X.state_filter_text(stored).alias("shown"))


@query("sca16_backoff_remaining", f"""{duck("log")}, m AS (SELECT max(moment) AS t FROM log) SELECT id, CASE WHEN k % 3 = 0 OR k % 10 = 1 THEN 0 ELSE greatest(0, 864000 - (t - moment)) END::bigint AS seconds_left FROM log, m""")
def sca16(spark: SparkSession, d: str) -> DataFrame:
    log = frame(spark, d, "log")
    now = log.agg(F.max("moment")).first()[0] or 0
    left = X.backoff_remaining(F.col("k") % 3, F.when(F.col("k") % 10 != 1, F.col("moment")), now, 864000)
    return log.select("id", left.cast("long").alias("seconds_left"))
