"""Window operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetops.operators import windows as W
from fleetops.plans.frames import CARD_STATES, duck, frame
from fleetops.plans.registry import query

TERMINAL = ("done", "skip", "failed", "blocked", "cancelled", "timed_out", "interrupted")


@query(
    "win1_latest",
    f"""{duck("jobs")}
SELECT batch_id, task_id, version, id, status FROM (
  SELECT *, row_number() OVER (PARTITION BY batch_id, task_id ORDER BY version DESC, row_seq DESC) AS n FROM jobs) WHERE n = 1""",
)
def win1(spark: SparkSession, d: str) -> DataFrame:
    return W.latest(frame(spark, d, "jobs"), ["batch_id", "task_id"], ["version", "row_seq"]).select("batch_id", "task_id", "version", "id", "status")


@query(
    "win2_latest_by_name",
    f"""{duck("batches")}
SELECT name, id, created, status FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY created DESC, row_seq DESC) AS n FROM batches) WHERE n = 1""",
)
def win2(spark: SparkSession, d: str) -> DataFrame:
    return W.latest_by_name(frame(spark, d, "batches"), "name", ["created", "row_seq"]).select("name", "id", "created", "status")


@query(
    "win3_stale_running",
    f"""{duck("jobs")}
SELECT batch_id, task_id, version, id, newest FROM (SELECT *, max(version) OVER (PARTITION BY batch_id, task_id) AS newest FROM jobs)
WHERE status = 'running' AND version < newest""",
)
def win3(spark: SparkSession, d: str) -> DataFrame:
    return W.stale_running(frame(spark, d, "jobs"), ["batch_id", "task_id"], "version", "status").select("batch_id", "task_id", "version", "id", "newest")


@query(
    "win4_dispatch_rank",
    f"""{duck("jobs", "batches", "projects")}
SELECT j.id, j.project, row_number() OVER (PARTITION BY j.project ORDER BY p.priority DESC, b.priority DESC, j.submitted, j.row_seq)::int AS rank_within,
  row_number() OVER (ORDER BY p.priority DESC, b.priority DESC, j.submitted, j.row_seq)::bigint AS rank_all
FROM jobs j JOIN batches b ON b.id = j.batch_id JOIN projects p ON p.project = j.project WHERE j.status = 'pending'""",
)
def win4(spark: SparkSession, d: str) -> DataFrame:
    jobs = frame(spark, d, "jobs").filter("status = 'pending'")
    batches = frame(spark, d, "batches").select(F.col("id").alias("batch_id"), F.col("priority").alias("batch_priority"))
    projects = frame(spark, d, "projects").select("project", F.col("priority").alias("project_priority"))
    ready = jobs.join(batches, "batch_id").join(projects, "project")
    order = [F.desc("project_priority"), F.desc("batch_priority"), F.col("submitted"), F.col("row_seq")]
    return W.dispatch_rank(ready, order, "project").select("id", "project", "rank_within", "rank_all")


#: A log whose ids are digests of owner, seq and payload and the id before; every 11th id is spoiled, every 13th lost.
CHAIN_ID = "sha256(concat_ws('|', owner::varchar, seq::varchar, k::varchar))"


@query(
    "win5_verify_chain",
    f"""{duck("log")},
c AS (SELECT owner, seq, id AS n, concat_ws('|', owner::varchar, seq::varchar, k::varchar) AS content FROM log),
e AS (SELECT owner, seq, n, content, CASE WHEN n % 211 = 0 THEN sha256('spoiled') ELSE sha256(content) END AS id FROM c),
f AS (SELECT *, lag(id) OVER (PARTITION BY owner ORDER BY seq) AS prev FROM e),
g AS (SELECT * FROM f WHERE n % 307 <> 0),
h AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY seq, id) AS nth, lag(id) OVER (PARTITION BY owner ORDER BY seq, id) AS before FROM g),
r AS (SELECT *, CASE WHEN seq <> nth THEN 'gap' WHEN prev IS DISTINCT FROM before THEN 'link' WHEN id <> sha256(content) THEN 'digest' END AS why FROM h)
SELECT owner, count(*) AS n_events, count(why) = 0 AS valid, min(seq) FILTER (why IS NOT NULL) AS first_break, arg_min(why, seq) FILTER (why IS NOT NULL) AS reason
FROM r GROUP BY owner""",
)
def win5(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws("|", F.col("owner").cast("string"), F.col("seq").cast("string"), F.col("k").cast("string"))
    log = frame(spark, d, "log").select("owner", "seq", F.col("id").alias("n"), text.alias("content"))
    log = log.withColumn("id", F.when(F.col("n") % 211 == 0, F.sha2(F.lit("spoiled"), 256)).otherwise(F.sha2("content", 256)))
    log = log.withColumn("prev", F.lag("id").over(Window.partitionBy("owner").orderBy("seq"))).filter("n % 307 <> 0")
    return W.verify_chain(log, "owner", "seq", "id", "prev", F.col("content"))


EDGES = [(None, "signup"), (None, "view"), ("signup", "view"), ("view", "click"), ("view", "view"), ("click", "purchase"), ("click", "view"), ("purchase", "view"), ("error", "view"), ("view", "error"), ("click", "error")]
EDGE_SQL = " UNION ALL ".join(f"SELECT {'NULL' if a is None else repr(a)} AS b, {b!r} AS a" for a, b in EDGES)


@query(
    "win6_legal_transitions",
    f"""{duck("log")}, edges AS ({EDGE_SQL}),
r AS (SELECT *, lag(kind) OVER (PARTITION BY owner ORDER BY seq) AS before, count(*) OVER (PARTITION BY owner, kind ORDER BY seq) AS times FROM log),
s AS (SELECT owner, seq, kind, before, CASE WHEN NOT EXISTS (SELECT 1 FROM edges WHERE edges.b IS NOT DISTINCT FROM r.before AND edges.a = r.kind) THEN 'transition'
  WHEN kind = 'signup' AND times > 1 THEN 'repeated' END AS reason FROM r)
SELECT * FROM s WHERE reason IS NOT NULL""",
)
def win6(spark: SparkSession, d: str) -> DataFrame:
    edges = spark.createDataFrame(EDGES, "before string, after string")
    return W.legal_transitions(frame(spark, d, "log"), "owner", "seq", "kind", edges, ["signup"]).select("owner", "seq", "kind", "before", "reason")


@query(
    "win7_collapse_repeats",
    f"""{duck("log")}
SELECT owner, seq, kind FROM (SELECT *, lag(kind) OVER (PARTITION BY owner ORDER BY seq) AS b FROM log) WHERE b IS DISTINCT FROM kind""",
)
def win7(spark: SparkSession, d: str) -> DataFrame:
    return W.collapse_repeats(frame(spark, d, "log"), "owner", ["seq"], ["kind"]).select("owner", "seq", "kind")


@query(
    "win8_streaks",
    f"""{duck("log")},
i AS (SELECT *, cents > 2500 AS hit, sum(CASE WHEN cents > 2500 THEN 0 ELSE 1 END) OVER (PARTITION BY owner ORDER BY seq) AS island FROM log),
r AS (SELECT owner, seq, hit, sum(hit::int) OVER (PARTITION BY owner, island ORDER BY seq)::bigint AS run FROM i)
SELECT owner, seq, run FROM r WHERE hit AND run = 3""",
)
def win8(spark: SparkSession, d: str) -> DataFrame:
    return W.streaks(frame(spark, d, "log"), "owner", ["seq"], F.col("cents") > 2500, 3).select("owner", "seq", "run")


SAMPLES = "s AS (SELECT owner, seq, id, CASE WHEN kind = 'error' THEN 'failed' WHEN k < 60 THEN 'clean' WHEN k < 90 THEN 'util' ELSE 'pid' END AS sample FROM log)"


@query(
    "win9_card_states",
    f"""{duck("log").replace("WITH", "WITH RECURSIVE", 1)}, {SAMPLES}, {CARD_STATES} SELECT w.owner, w.seq, s.id, s.sample, w.state, w.dispatchable FROM w JOIN s ON s.owner = w.owner AND s.seq = w.seq""",
)
def win9(spark: SparkSession, d: str) -> DataFrame:
    log = frame(spark, d, "log")
    sample = F.when(F.col("kind") == "error", "failed").when(F.col("k") < 60, "clean").when(F.col("k") < 90, "util").otherwise("pid")
    return W.card_states(log.select("owner", "seq", "id", sample.alias("sample")), "owner", ["seq"], "sample")


@query(
    "win10_keep_last_ttl",
    f"""{duck("jobs")}, m AS (SELECT max(submitted) AS t FROM jobs),
x AS (SELECT DISTINCT id FROM jobs WHERE status = 'blocked'),
r AS (SELECT jobs.*, submitted >= t - 86400 * 900 AS young FROM jobs, m),
s AS (SELECT *, row_number() OVER (PARTITION BY batch_id, young ORDER BY submitted DESC, row_seq DESC) AS n FROM r)
SELECT s.id, batch_id, (young AND n <= 3) OR x.id IS NOT NULL AS keep FROM s LEFT JOIN x ON x.id = s.id""",
)
def win10(spark: SparkSession, d: str) -> DataFrame:
    jobs = frame(spark, d, "jobs")
    oldest = (jobs.agg(F.max("submitted")).first()[0] or 0) - 86400 * 900
    out = W.keep_last_ttl(jobs, "submitted", ["submitted", "row_seq"], 3, oldest, jobs.filter("status = 'blocked'"), "id", ["batch_id"])
    return out.select("id", "batch_id", "keep")


@query(
    "win11_snapshot_retention",
    f"""{duck("jobs")}, m AS (SELECT max(finished) AS t FROM jobs),
r AS (SELECT id, project, finished, t, row_number() OVER (PARTITION BY project ORDER BY finished DESC NULLS LAST, id DESC) AS n FROM jobs, m)
SELECT id, project, concat_ws(',', CASE WHEN finished IS NULL THEN 'not_closed' END, CASE WHEN finished > t - 30 * 86400 THEN 'retention_period_not_elapsed' END,
  CASE WHEN finished IS NOT NULL AND n <= 5 THEN 'retained_by_keep_last' END) AS reasons,
  NOT (finished IS NULL OR finished > t - 30 * 86400 OR n <= 5) AS eligible FROM r""",
)
def win11(spark: SparkSession, d: str) -> DataFrame:
    jobs = frame(spark, d, "jobs")
    now = jobs.agg(F.max("finished")).first()[0] or 0
    out = W.snapshot_retention(jobs.select("id", "project", "finished"), "finished", "id", now, 30, 5, ["project"])
    return out.select("id", "project", F.concat_ws(",", "reasons").alias("reasons"), "eligible")


@query(
    "win12_first_free",
    f"""{duck("cards", "log")},
claims AS (SELECT DISTINCT k AS card FROM log WHERE kind = 'purchase' AND k % 4 = 0),
f AS (SELECT node, card, row_number() OVER (PARTITION BY node ORDER BY card) AS n FROM cards WHERE card NOT IN (SELECT card FROM claims)),
q AS (SELECT n_nationkey::bigint AS node, (1 + n_nationkey % 5)::bigint AS wanted FROM nation),
p AS (SELECT q.node, count(*) AS c, string_agg(card::varchar, ',' ORDER BY card) AS units FROM f JOIN q ON q.node = f.node AND f.n <= q.wanted GROUP BY q.node)
SELECT q.node, q.wanted, CASE WHEN c = wanted THEN units END AS units FROM q LEFT JOIN p ON p.node = q.node""",
)
def win12(spark: SparkSession, d: str) -> DataFrame:
    cards = frame(spark, d, "cards").select("node", "card", F.col("card").alias("place"))
    log = frame(spark, d, "log").filter("kind = 'purchase' and k % 4 = 0").select(F.col("k").alias("card")).distinct()
    claims = cards.join(log, "card", "left_semi")
    nation = spark.read.parquet(f"{d}/nation.parquet")
    requests = nation.select(F.col("n_nationkey").cast("long").alias("node"), (1 + F.col("n_nationkey") % 5).cast("long").alias("wanted"))
    out = W.first_free(cards, claims, requests, "node", "card", "place", "wanted")
    return out.select("node", "wanted", F.when(F.col("units").isNotNull(), F.array_join("units", ",")).alias("units"))


@query(
    "win13_latest_per_kind",
    f"""{duck("log")} SELECT owner, kind, max(seq) AS seq, arg_max(k, seq) AS k FROM log GROUP BY owner, kind""",
)
def win13(spark: SparkSession, d: str) -> DataFrame:
    return W.latest_per_kind(frame(spark, d, "log"), "owner", "kind", ["seq"]).select("owner", "kind", "seq", "k")


@query(
    "win14_generation_gaps",
    f"""{duck("log")}, v AS (SELECT owner, kind, k % 20 AS version FROM log WHERE kind <> 'error'), u AS (SELECT DISTINCT * FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY owner, kind ORDER BY version) AS n FROM u)
SELECT owner, kind, count(*) AS n, max(version) AS newest, min(version) FILTER (version <> n) AS gap_at FROM r GROUP BY owner, kind HAVING count(*) FILTER (version <> n) > 0""",
)
def win14(spark: SparkSession, d: str) -> DataFrame:
    versions = frame(spark, d, "log").filter("kind <> 'error'").select("owner", "kind", (F.col("k") % 20).alias("version")).distinct()
    return W.generation_gaps(versions, ["owner", "kind"], "version")


@query(
    "win15_last_points",
    f"""{duck("log")}, r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY seq DESC) AS n FROM log)
SELECT owner, string_agg(cents::varchar, ',' ORDER BY seq) AS points, count(*) AS n_points, max(cents) - min(cents) AS span FROM r WHERE n <= 20 GROUP BY owner""",
)
def win15(spark: SparkSession, d: str) -> DataFrame:
    out = W.last_points(frame(spark, d, "log"), "owner", ["seq"], "cents", 20)
    return out.withColumn("points", F.array_join("points", ","))


@query(
    "win16_fifo_head",
    f"""{duck("jobs")}, m AS (SELECT max(submitted) AS t FROM jobs),
q AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY submitted, row_seq) AS n FROM jobs WHERE status = 'pending'),
busy AS (SELECT DISTINCT batch_id FROM jobs WHERE status = 'running' AND id % 6 = 0)
SELECT batch_id, id, submitted FROM q, m WHERE n = 1 AND submitted <= t - 86400 AND batch_id NOT IN (SELECT batch_id FROM busy)""",
)
def win16(spark: SparkSession, d: str) -> DataFrame:
    jobs = frame(spark, d, "jobs")
    now = (jobs.agg(F.max("submitted")).first()[0] or 0) - 86400
    out = W.fifo_head(jobs.filter("status = 'pending'"), jobs.filter("status = 'running' and id % 6 = 0"), "batch_id", ["submitted", "row_seq"], "submitted", now)
    return out.select("batch_id", "id", "submitted")


@query(
    "win17_revision_counter",
    f"""{duck("jobs")}, r AS (SELECT *, lag(status) OVER w AS s, lag(gpu) OVER w AS g, row_number() OVER w AS n FROM jobs WINDOW w AS (PARTITION BY batch_id ORDER BY submitted, row_seq))
SELECT id, batch_id, sum(CASE WHEN n > 1 AND (s IS DISTINCT FROM status OR g IS DISTINCT FROM gpu) THEN 1 ELSE 0 END) OVER (PARTITION BY batch_id ORDER BY submitted, row_seq)::bigint AS revision FROM r""",
)
def win17(spark: SparkSession, d: str) -> DataFrame:
    return W.revision_counter(frame(spark, d, "jobs"), "batch_id", ["submitted", "row_seq"], ["status", "gpu"]).select("id", "batch_id", "revision")


@query(
    "win18_retry_lineage",
    f"""{duck("jobs")} SELECT id, batch_id, task_id, (row_number() OVER w - 1)::int AS round, first_value(submitted) OVER w AS first_queued
FROM jobs WINDOW w AS (PARTITION BY concat_ws('/', batch_id::varchar, task_id) ORDER BY version)""",
)
def win18(spark: SparkSession, d: str) -> DataFrame:
    jobs = frame(spark, d, "jobs").withColumn("root", F.concat_ws("/", F.col("batch_id").cast("string"), "task_id"))
    return W.retry_lineage(jobs, "root", ["version"], "submitted").select("id", "batch_id", "task_id", "round", "first_queued")


@query(
    "win19_unresolved_owners",
    f"""{duck("log", "batches")}, l AS (SELECT owner, arg_max(kind, seq) AS kind FROM log GROUP BY owner)
SELECT b.id, coalesce(l.kind, 'unknown') AS last_kind FROM batches b LEFT JOIN l ON l.owner = b.id WHERE coalesce(l.kind, 'unknown') NOT IN ('purchase', 'error')""",
)
def win19(spark: SparkSession, d: str) -> DataFrame:
    log = frame(spark, d, "log").withColumnRenamed("id", "event").withColumnRenamed("owner", "id")
    return W.unresolved_owners(frame(spark, d, "batches").select("id"), log, "id", ["seq"], "kind", ["purchase", "error"])
