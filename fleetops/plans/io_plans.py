"""Sources, sinks and streams on the driver's tables, or on files that Spark writes from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetops.operators import paging as P
from fleetops.plans.frames import CARD_STATES, SPARK_DAY, duck, frame, table
from fleetops.plans.join_plans import ORDER
from fleetops.plans.registry import ORACLE_SQL, query
from fleetops.plans.window_plans import SAMPLES
from fleetops.session import scratch
from fleetops.sources import tables as S
from fleetops.sources import ranges, tails, versions
from fleetops.streaming import folds, history, jobs, stateful


@query("src1_read_table", f"""{duck("jobs")} SELECT id::varchar AS id, batch_id::varchar AS batch_id, task_id, version, status, project, NULL::int AS rc, row_seq FROM jobs""")
def src1(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "tables")
    jobs = frame(spark, d, "jobs").select(F.col("id").cast("string"), F.col("batch_id").cast("string"), "task_id", "version", "status", "project", "row_seq", F.lit(1).alias("extra"))
    jobs.write.parquet(f"{at}/jobs")
    return S.read_table(spark, at, "jobs").select("id", "batch_id", "task_id", "version", "status", "project", "rc", "row_seq")


@query("src2_read_optional", f"""{duck("cards")} SELECT card::int AS idx, NULL::varchar AS job_id, capacity::double AS mem_total_gib, 0::bigint AS missing_rows FROM cards""")
def src2(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "tables")
    frame(spark, d, "cards").select(F.col("card").cast("int").alias("idx"), F.col("capacity").cast("double").alias("mem_total_gib")).write.parquet(f"{at}/gpus")
    none = S.read_optional(spark, at, "incidents").agg(F.count("*").alias("missing_rows"))
    return S.read_optional(spark, at, "gpus").select("idx", "job_id", "mem_total_gib").crossJoin(none)


def write_specs(docs: DataFrame, at: str, most: int = 1000) -> None:
    """An array of about `most` documents in each file, at project=*/lot=*; the number of lots follows that of the rows."""
    lot = F.pmod(F.xxhash64(*docs.columns), F.lit(-(-docs.count() // most) or 1)).alias("lot")
    lots = docs.select("*", lot).groupBy("project", "lot").agg(F.to_json(F.collect_list(F.struct(*docs.columns))).alias("text"))
    lots.write.partitionBy("project", "lot").text(at)


@query(
    "src3_read_batch_specs",
    f"""{duck("batches")} SELECT name, project, priority, CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END AS n_tasks, concat('t', id) AS first_task, count(*) AS n FROM batches GROUP BY ALL""",
)
def src3(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "specs")
    task = lambda n: F.struct(F.concat(F.lit(n), F.col("id").cast("string")).alias("id"), F.array(F.lit("run")).alias("cmd"))
    docs = frame(spark, d, "batches").select("name", "project", F.lit("mix").alias("mode"), "priority", F.when(F.col("id") % 2 == 0, F.array(task("t"))).otherwise(F.array(task("t"), task("u"))).alias("tasks"))
    write_specs(docs, at)
    rows = S.read_batch_specs(spark, f"{at}/*/*/*.txt").filter("_corrupt is null")
    return rows.groupBy("name", "project", "priority", F.size("tasks").alias("n_tasks"), F.col("tasks")[0]["id"].alias("first_task")).agg(F.count("*").alias("n"))


@query(
    "src4_stream_inbox",
    f"""{duck("batches")} SELECT concat('r', id) AS request_id, project AS binding, name AS batch FROM batches""",
)
def src4(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "inbox")
    sent = frame(spark, d, "batches").select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("request_id"), F.col("project").alias("binding"), F.col("name").alias("batch"))
    sent.write.json(at)
    return jobs.drain(S.stream_inbox(spark, at, names="part-*.json"), "inbox")


@query(
    "src5_read_logs",
    """WITH l AS (SELECT doc_id % 7 AS b, doc_id % 3 AS t, doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '\n$', ''), chr(10))) AS line FROM documents)
SELECT concat('b', b) AS batch, concat('t', t) AS task, 1::bigint AS version, count(*) AS n_lines, 1::bigint AS first_line, sum(strlen(line))::bigint AS bytes FROM l GROUP BY b, t""",
)
def src5(spark: SparkSession, d: str) -> DataFrame:
    """Documents as the logs of 21 tasks, a file for each writer."""
    at = scratch(spark, "logs")
    keys = F.concat(F.lit("b"), (F.col("doc_id") % 7).cast("string")).alias("batch"), F.concat(F.lit("t"), (F.col("doc_id") % 3).cast("string"), F.lit("-v1")).alias("task")
    lines = table(spark, d, "documents").select(*keys, F.regexp_replace(F.coalesce("text", F.lit("")), "\n\\z", "").alias("value"))
    lines.write.partitionBy("batch", "task").text(at)
    rows = S.read_logs(spark, at, names="part-*", keys=r"batch=([^/]+)/task=([^/]+)-v(\d+)/[^/]+$")
    return rows.groupBy("batch", "task", "version").agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"), F.sum(F.octet_length("text")).alias("bytes"))


def lots(spark: SparkSession, d: str) -> str:
    """Documents as logs, 500 ids in each, in order."""
    at = scratch(spark, "lots")
    rows = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 500).alias("lot"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    rows.repartition("lot").sortWithinPartitions("lot", "doc_id").select("lot", "value").write.partitionBy("lot").text(at)
    return at


LOT = r"cast(regexp_extract(path, 'lot=(\\d+)/', 1) as long) as lot"
LOTS = "WITH l AS (SELECT (doc_id // 500)::bigint AS lot, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS t, arg_min(strlen(coalesce(text, '')) + 1, doc_id) AS one, arg_min(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1, doc_id) AS ends FROM documents GROUP BY ALL)"


@query("src5_read_tails", f"{LOTS} SELECT lot, strlen(t)::bigint AS length, greatest(0, strlen(t) - 4096)::bigint AS start, right(t, 1000) AS tail FROM l")
def src5_tails(spark: SparkSession, d: str) -> DataFrame:
    return tails.read_tails(spark, lots(spark, d), 4096, "part-*").select(F.expr(LOT), "length", "start", F.right("text", F.lit(1000)).alias("tail"))


@query(
    "src5_read_growth",
    f"{LOTS} SELECT lot, one::bigint AS first, strlen(t)::bigint AS last, (strlen(t) - one)::bigint AS bytes, (length(t) - length(replace(t, chr(10), '')) - ends)::bigint AS n_lines FROM l WHERE strlen(t) > one",
)
def src5_growth(spark: SparkSession, d: str) -> DataFrame:
    """What follows each lot's first document, in pieces of 64 KiB."""
    at = lots(spark, d)
    one = table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 500).alias("lot")).agg((F.min_by(F.octet_length(F.coalesce("text", F.lit(""))), "doc_id") + 1).cast("long").alias("end"))
    known = tails.lengths(spark, at, "part-*").selectExpr("path", LOT).join(one, "lot").select("path", "end")
    grown = tails.read_growth(spark, at, known, 64 << 10, "part-*")
    size = lambda c: F.sum(F.octet_length(c)).cast("long")
    return grown.groupBy(F.expr(LOT)).agg(F.min("start").alias("first"), F.max("end").alias("last"), size(F.col("text")).alias("bytes"), size(F.regexp_replace("text", "[^\n]+", "")).alias("n_lines"))


@query("top1_ranged_page", ORACLE_SQL["top1_keyset_page"])
def top1_ranged(spark: SparkSession, d: str) -> DataFrame:
    """The page of top1 from a table in its order, which opens the files of that page."""
    at = scratch(spark, "ranges")
    ranges.write_ranges(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), at, ORDER)
    return ranges.read_page(spark, at, ORDER, 50, ["F", 400000.0, 100]).select("o_orderkey", "o_orderstatus", "extra")


@query("top3_ranged_page", ORACLE_SQL["top3_anchored_page"])
def top3_ranged(spark: SparkSession, d: str) -> DataFrame:
    at, order = scratch(spark, "ranges"), [("event_id", True)]
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    ranges.write_ranges(events, at, order)
    upper = events.agg(F.max("event_id")).first()[0] or 0
    page = ranges.read_page(spark, at, order, 40, [100], [upper], F.col("event_type") == "error")
    return page.filter("not extra").select("event_id", "user_id")


@query(
    "src6_read_files",
    """SELECT concat('p', page_id % 12) AS part, sum(strlen(coalesce(html, '')) + 1)::bigint AS bytes, sum(strlen(coalesce(html, '')) + 1)::bigint AS content_bytes FROM pages GROUP BY ALL""",
)
def src6(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "files")
    part = F.concat(F.lit("p"), (F.col("page_id") % 12).cast("string"))
    table(spark, d, "pages").select(part.alias("part"), F.coalesce("html", F.lit("")).alias("value")).write.partitionBy("part").text(at)
    files = S.read_files(spark, at, "part-*").select(F.regexp_extract("path", r"part=([^/]+)/[^/]+$", 1).alias("part"), "length", F.octet_length("content").alias("n"))
    return files.groupBy("part").agg(F.sum("length").alias("bytes"), F.sum("n").cast("long").alias("content_bytes"))


@query("src7_read_samples", f"""{duck("log")} SELECT concat('n', owner) AS node, (k % 8)::int AS idx, CASE WHEN k % 10 <> 0 THEN cents END AS used_mib, CASE WHEN kind <> 'error' THEN id END AS pid, ts IS NOT NULL AS timed FROM log JOIN events ON event_id = id""")
def src7(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "samples")
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    rows = frame(spark, d, "log").join(e, "id")
    empty = F.lit(None).cast("string")
    rows.select("ts", F.concat(F.lit("n"), F.col("owner").cast("string")), (F.col("k") % 8), F.lit(32000), F.when(F.col("k") % 10 != 0, F.col("cents")), empty, empty, F.when(F.col("kind") != "error", F.col("id")), empty).toDF(*"abcdefghi").write.csv(at)
    return S.read_samples(spark, at).select("node", "idx", "used_mib", "pid", F.col("ts").isNotNull().alias("timed"))


@query(
    "src8_read_inventory",
    f"""{duck("cards")}, c AS (SELECT card::int AS idx, concat('u', CASE WHEN card % 9 = 0 THEN 0 ELSE card END) AS uuid, CASE WHEN card % 11 <> 0 THEN concat('00000000:', lpad((card % 90)::varchar, 2, '0'), ':', lpad((card // 90 % 90)::varchar, 2, '0'), '.0') END AS pci FROM cards)
SELECT idx, pci, concat_ws(',', CASE WHEN pci IS NULL THEN 'bad_pci' END, CASE WHEN count(*) OVER (PARTITION BY uuid) > 1 THEN 'uuid_repeated' END, CASE WHEN pci IS NOT NULL AND count(*) OVER (PARTITION BY pci) > 1 THEN 'pci_repeated' END) AS reasons FROM c""",
)
def src8(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "inventory")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    pci = F.concat(F.when(F.col("card") % 2 == 0, F.lit("0000:")).otherwise(F.lit("")), two(F.col("card") % 90), F.lit(":"), two(F.floor(F.col("card") / 90) % 90), F.when(F.col("card") % 11 == 0, ".9").otherwise(".0"))
    uuid_ = F.concat(F.lit("u"), F.when(F.col("card") % 9 == 0, F.lit(0)).otherwise(F.col("card")).cast("string"))
    frame(spark, d, "cards").select("card", uuid_.alias("uuid"), pci.alias("pci"), F.lit("Default").alias("c"), F.lit("Disabled").alias("m")).write.csv(at)
    return S.read_inventory(spark, at).select("idx", "pci", F.array_join("reasons", ",").alias("reasons"))


@query("src9_read_notifications", f"""{duck("projects")} SELECT CASE WHEN quota <> 3 THEN project END AS project, CASE WHEN quota = 3 THEN 'unreadable' END AS error FROM projects""")
def src9(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "events")
    text = F.when(F.col("quota") == 3, "{torn").otherwise(F.to_json(F.struct("project", "quota")))
    frame(spark, d, "projects").select(text.alias("value"), F.col("project").alias("p")).write.partitionBy("p").text(at)
    return S.read_notifications(spark, at).select(F.expr("try_variant_get(event, '$.project', 'string')").alias("project"), "error")


@query("snk1_write_notifications", f"""{duck("jobs")} SELECT concat('b', batch_id) AS event_id, count(*) AS jobs FROM jobs GROUP BY batch_id""")
def snk1(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "out")
    events = frame(spark, d, "jobs").groupBy(F.concat(F.lit("b"), F.col("batch_id").cast("string")).alias("event_id")).agg(F.count("*").alias("jobs"))
    S.append_events(events.filter("jobs < 10"), at, writer="w", batch=0)
    S.append_events(events, at)
    S.append_events(events.withColumn("jobs", F.lit(0).cast("long")), at)  # delivered again: nothing new
    return versions.read_version(spark, at, "event_id string, jobs long")


@query("snk1_json_notifications", f"""{duck("jobs")} SELECT concat('b', batch_id) AS event_id, count(*) AS jobs FROM jobs GROUP BY batch_id""")
def snk1_json(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "out")
    events = frame(spark, d, "jobs").groupBy(F.concat(F.lit("b"), F.col("batch_id").cast("string")).alias("event_id")).agg(F.count("*").alias("jobs"))
    S.write_notifications(events.filter("jobs < 10"), at)
    S.write_notifications(events, at)
    S.write_notifications(events, at)
    return spark.read.schema("event_id string, jobs long").json(at)


@query(
    "snk2_write_page",
    """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) SELECT concat('{"rows":[', string_agg(concat('{"o_orderkey":', o_orderkey, '}'), ',' ORDER BY o_orderkey), '],"limit":25,"truncated":true,"next_cursor":"', max(o_orderkey), '"}') AS page FROM o WHERE n <= 25""",
)
def snk2(spark: SparkSession, d: str) -> DataFrame:
    page = P.keyset_page(table(spark, d, "orders").select("o_orderkey"), [("o_orderkey", True)], 25)
    at = scratch(spark, "page")
    S.write_page(page, ["o_orderkey"], 25, F.col("o_orderkey").cast("string"), at)
    return spark.read.text(at).withColumnRenamed("value", "page")


@query("snk3_write_partitioned", f"""{duck("jobs")} SELECT status, count(*) AS n, sum(request)::bigint AS request FROM jobs GROUP BY status""")
def snk3(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "facts")
    S.write_partitioned(frame(spark, d, "jobs").select("id", "status", "request"), at, "status", files=2)
    return spark.read.parquet(at).groupBy("status").agg(F.count("*").alias("n"), F.sum("request").alias("request"))


@query("snk3_compacted_versions", f"""{duck("jobs")} SELECT id, status, request FROM jobs""")
def snk3_compacted(spark: SparkSession, d: str) -> DataFrame:
    """Appended in eight commits, then compacted."""
    at, schema = scratch(spark, "table"), "id long, status string, request long"
    rows = frame(spark, d, "jobs").select("id", "status", "request")
    for k in range(8):
        versions.append(rows.filter(F.col("id") % 8 == k), at, writer="w", batch=k)
    versions.compact(spark, at, schema, sort_by=["id"])
    return versions.read_version(spark, at, schema)


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream of its files."""
    rows = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    moment = f"cast({SPARK_DAY.format(c='ts')} as bigint) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + cast(floor(second(ts)) as bigint) as moment"
    return rows.selectExpr("event_id as id", "user_id as owner", "event_type as kind", moment, "cast(get_json_object(props, '$.k') as bigint) as k", "cast(round(value * 100) as bigint) as cents")


def run(spark: SparkSession, d: str, name: str, rule: folds.Rule, key: str, **fields: F.Column) -> DataFrame:
    rows = event_stream(spark, d)
    rows = rows.select(F.col(key).alias("key"), "id", "moment", *[c.alias(n) for n, c in fields.items()])
    return jobs.drain(stateful.watch(rows, rule, "key", "moment", "id"), name).filter("not late").drop("late").withColumnRenamed("key", key).withColumnRenamed("at", "moment")


@query(
    "str1_stream_card_state",
    f"""{duck("log").replace("WITH", "WITH RECURSIVE", 1)}, {SAMPLES}, {CARD_STATES} SELECT w.owner, log.moment, w.state, w.dispatchable FROM w JOIN log ON log.owner = w.owner AND log.seq = w.seq""",
)
def str1(spark: SparkSession, d: str) -> DataFrame:
    kind, k = F.col("kind"), F.col("k")
    sample = F.when(kind == "error", "failed").when(k < 60, "clean").when(k < 90, "util").otherwise("pid")
    return run(spark, d, "cards", folds.card_state(), "owner", sample=sample)


LOG = "log AS (SELECT id, owner, kind, moment, k, cents FROM log0)"
BASE = duck("log").replace("log AS (", "log0 AS (", 1) + ", " + LOG


@query(
    "str2_stream_freeze",
    f"""{BASE}, f AS (SELECT *, cents > 25500 AS now, coalesce(lag(cents > 25500) OVER (PARTITION BY owner ORDER BY moment, id), false) AS was FROM log) SELECT owner, moment, CASE WHEN now THEN 'frozen' ELSE 'thawed' END AS change FROM f WHERE now <> was""",
)
def str2(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d, "freeze", folds.freeze(85), "owner", used=F.col("cents"), capacity=F.lit(30000))


#: Silence counts up to the newest row, which is where a stream's time stands when it has read all.
@query(
    "str3_stream_timeouts",
    f"""{BASE}, n AS (SELECT max(moment) AS now FROM log), g AS (SELECT owner, kind, moment, lead(moment) OVER (PARTITION BY owner ORDER BY moment, id) AS next FROM log WHERE kind IN ('view', 'purchase'))
SELECT owner, moment + 40000 AS moment, 40000::bigint AS ran FROM g, n WHERE kind = 'view' AND moment + 40000 < coalesce(next, now)""",
)
def str3(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("kind") == "view", "start").when(F.col("kind") == "purchase", "end").otherwise("alive")
    return run(spark, d, "timeouts", folds.timeouts(), "owner", kind=kind, limit=F.lit(40000))


@query(
    "str4_stream_heartbeat_gap",
    f"""{BASE}, n AS (SELECT max(moment) AS now FROM log), g AS (SELECT owner, moment AS beat, lead(moment) OVER (PARTITION BY owner ORDER BY moment, id) AS next FROM log) SELECT owner, beat + 20000 AS moment, 20000::bigint AS gap FROM g, n WHERE beat + 20000 < coalesce(next, now)""",
)
def str4(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d, "beats", folds.heartbeat_gap(20000, None), "owner")


@query("str4_resumed_heartbeat_gap", ORACLE_SQL["str4_stream_heartbeat_gap"])
def str4_resumed(spark: SparkSession, d: str) -> DataFrame:
    """The same, the first half of the time as a table and the rest as a stream that goes on from it."""
    rule, log, before = folds.heartbeat_gap(20000, None), frame(spark, d, "log"), spark.conf.get(history.PROVIDER[0])
    half = log.agg(F.floor((F.min("moment") + F.max("moment")) / 2)).first()[0] or 0
    past = log.filter(F.col("moment") < half).select("owner", "id", "moment")
    spark.conf.set(*history.PROVIDER)
    try:
        known = history.states(past, rule, "owner", "moment", "id")
        rest = event_stream(spark, d).filter(F.col("moment") >= half).select("owner", "id", "moment")
        told = jobs.drain(history.resume(rest, known, rule, "owner", "moment", "id"), "resumed").filter("not late").drop("late")
    finally:
        spark.conf.set(history.PROVIDER[0], before)
    return stateful.replay(past, rule, "owner", "moment", "id").unionByName(told).withColumnRenamed("at", "moment")


@query(
    "str5_stream_no_progress",
    f"""{BASE}, t AS (SELECT max(moment) AS now FROM log), s AS (SELECT owner, id, moment, CASE WHEN k < 70 THEN 'same' ELSE k::varchar END AS d FROM log),
f AS (SELECT owner, id, moment FROM (SELECT *, lag(d) OVER (PARTITION BY owner ORDER BY moment, id) AS was FROM s) WHERE d IS DISTINCT FROM was),
i AS (SELECT owner, moment AS since, lead(moment) OVER (PARTITION BY owner ORDER BY moment, id) AS next FROM f)
SELECT owner, since + n * 10000 AS moment, n * 10000 AS stalled, n::int AS notice FROM i, t, generate_series(1, 3) AS x(n) WHERE since + n * 10000 < coalesce(next, now)""",
)
def str5(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d, "progress", folds.no_progress(10000, 3), "owner", digest=F.when(F.col("k") < 70, "same").otherwise(F.col("k").cast("string")))


@query(
    "str6_stream_inbox_dedup",
    f"""{BASE}, f AS (SELECT *, first_value(kind) OVER w AS b, row_number() OVER w AS n FROM log WINDOW w AS (PARTITION BY k ORDER BY moment, id)) SELECT k, moment, CASE WHEN n = 1 THEN 'accepted' WHEN kind = b THEN 'replay' ELSE 'conflict' END AS outcome FROM f""",
)
def str6(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d, "inbox", folds.inbox(), "k", binding=F.col("kind"))


#: Each event writes its kind and a digit; two of the marks reach from one event's text into the next one's.
FAILED, READY = ("7err", "4purchase4"), ("5view8", "3cl")


@query(
    "str7_stream_log_probes",
    f"""{BASE}, t AS (SELECT owner, moment, id, string_agg(concat(kind, k % 10), '') OVER (PARTITION BY owner ORDER BY moment, id) AS text FROM log), f AS (SELECT *, {" OR ".join(f"contains(text, '{p}')" for p in FAILED)} AS failed, {" OR ".join(f"contains(text, '{p}')" for p in READY)} AS ready FROM t)
SELECT owner, moment, CASE WHEN failed THEN 'failed' ELSE 'ready' END AS verdict FROM f WHERE failed OR ready QUALIFY row_number() OVER (PARTITION BY owner ORDER BY moment, id) = 1""",
)
def str7(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("kind"), (F.col("k") % 10).cast("string"))
    return run(spark, d, "probes", folds.log_probes(FAILED, READY), "owner", text=text, start=F.lit(None).cast("long"))


@query(
    "str8_stream_latch",
    f"""{BASE}, f AS (SELECT *, min(CASE WHEN cents > 20000 THEN 0 ELSE 1 END) OVER (PARTITION BY owner ORDER BY moment, id) AS v, row_number() OVER (PARTITION BY owner ORDER BY moment, id) AS n FROM log), g AS (SELECT *, lag(v) OVER (PARTITION BY owner ORDER BY moment, id) AS p FROM f) SELECT owner, moment, v = 1 AS valid FROM g WHERE n = 1 OR v <> p""",
)
def str8(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d, "latch", folds.latch(1 << 40), "owner", valid=F.col("cents") <= 20000)


@query("str9_stream_freshness", f"""{BASE}, m AS (SELECT max(moment) - 864000 AS t FROM log) SELECT id, moment FROM log, m WHERE moment <= t AND t - moment <= 432000""")
def str9(spark: SparkSession, d: str) -> DataFrame:
    now = (frame(spark, d, "log").agg(F.max("moment")).first()[0] or 0) - 864000
    return jobs.drain(stateful.unexpired(event_stream(spark, d), "moment", now, 432000).select("id", "moment"), "fresh")


@query("str10_late_data", f"""{BASE} SELECT id, CASE WHEN k % 10 = 0 THEN 'future' WHEN k * 40 > 3000 THEN 'stale' ELSE 'valid' END AS freshness FROM log""")
def str10(spark: SparkSession, d: str) -> DataFrame:
    rows = event_stream(spark, d).withColumn("arrived", F.col("moment") + F.when(F.col("k") % 10 == 0, -5).otherwise(F.col("k") * 40))
    return jobs.drain(stateful.refuse_late(rows, "moment", "arrived", 3000).select("id", "freshness"), "late")


@query(
    "str11_stream_batch_events",
    f"""{duck("jobs")}, j AS (SELECT * FROM jobs WHERE status <> 'running'), e AS (SELECT batch_id FROM j GROUP BY batch_id HAVING bool_and(status <> 'pending')), t AS (SELECT DISTINCT user_id FROM events)
SELECT j.batch_id, max(finished) AS finished, count(*) FILTER (status IN ('failed', 'blocked', 'cancelled', 'timed_out', 'interrupted'))::int AS n_failures FROM j WHERE batch_id IN (SELECT batch_id FROM e) AND batch_id IN (SELECT user_id FROM t) GROUP BY j.batch_id""",
)
def str11(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "settled")
    jobs.write_jobs(frame(spark, d, "jobs").filter("status <> 'running'").withColumn("rev", F.col("gpu")), f"{at}/jobs", "batch_id", 16)
    changes = event_stream(spark, d).select(F.col("owner").alias("batch_id"))
    jobs.stream_batch_events(changes, f"{at}/jobs", f"{at}/out", f"{at}/state", ("done", "skip", "failed", "blocked", "cancelled", "timed_out", "interrupted"), 16).awaitTermination()
    return versions.read_version(spark, f"{at}/out", jobs.EVENTS).select(F.col("batch_id").cast("long"), "finished", "n_failures")
