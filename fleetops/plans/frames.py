"""Job-record frames made of the driver's tables, each with the same frame in DuckDB's SQL.

Orders play job attempts (a customer is a batch, a priority a task), customers play batches, nations projects,
suppliers cards, events the append-only logs. Times are whole seconds since 1970, so no time zone takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STATUS = (
    "case o_orderstatus when 'F' then case when o_orderkey % 5 = 0 then 'skip' else 'done' end "
    "when 'O' then case when o_orderkey % 2 = 0 then 'running' else 'pending' end "
    "else case o_orderkey % 5 when 0 then 'failed' when 1 then 'timed_out' when 2 then 'cancelled' when 3 then 'blocked' else 'interrupted' end end"
)
SPARK_DAY = "datediff({c}, date'1970-01-01')"
DUCK_DAY = "date_diff('day', date '1970-01-01', {c}::date)"


def _jobs(day: str) -> str:
    at = f"cast({day.format(c='o_orderdate')} as bigint) * 86400 + o_orderkey % 86400"
    return f"""
SELECT o_orderkey AS id, o_custkey AS batch_id, o_orderpriority AS task_id,
  cast(row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS bigint) AS version,
  {STATUS} AS status, concat('p', cast(o_custkey % 10 AS varchar(9))) AS project,
  cast(o_orderkey % 8 AS bigint) AS gpu, cast(o_orderkey % 3 AS bigint) AS retries,
  {at} AS submitted,
  CASE WHEN o_orderstatus = 'O' THEN NULL ELSE {at} + 60 * (o_orderkey % 700) END AS finished,
  cast(round(o_totalprice) AS bigint) AS request, o_orderkey AS row_seq
FROM orders"""


BATCHES = """
SELECT c_custkey AS id, concat('b', cast(c_custkey % 97 AS varchar(9))) AS name,
  1600000000 + (c_custkey % 50) * 86400 AS created, c_custkey AS row_seq,
  CASE c_custkey % 5 WHEN 3 THEN 'blocked' WHEN 4 THEN 'queued' ELSE 'active' END AS status,
  concat('p', cast(c_custkey % 10 AS varchar(9))) AS project, cast(c_custkey % 4 AS bigint) AS priority,
  CASE WHEN c_custkey % 2 = 0 THEN 'freeze' ELSE 'continue_independent' END AS policy
FROM customer"""

PROJECTS = """
SELECT concat('p', cast(n_nationkey AS varchar(9))) AS project, cast(n_nationkey % 4 AS bigint) AS quota,
  n_nationkey % 3 <> 0 AS enabled, cast(n_nationkey % 5 AS bigint) AS priority
FROM nation"""

CARDS = """
SELECT s_suppkey AS card, cast(16 + 8 * (s_suppkey % 3) AS bigint) AS capacity, s_suppkey % 7 = 0 AS quarantined,
  s_suppkey % 5 = 0 AS frozen, cast(s_nationkey AS bigint) AS node
FROM supplier"""


def _events(day: str, k: str) -> str:
    return f"""
SELECT event_id AS id, user_id AS owner, event_type AS kind,
  cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bigint) AS seq,
  cast({day.format(c='ts')} as bigint) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + cast(floor(second(ts)) AS bigint) AS moment,
  cast({k} AS bigint) AS k, cast(round(value * 100) AS bigint) AS cents
FROM events"""


DUCK = {
    "jobs": _jobs(DUCK_DAY),
    "batches": BATCHES,
    "projects": PROJECTS,
    "cards": CARDS,
    "log": _events(DUCK_DAY, "json_extract_string(props, '$.k')"),
}
#: The debounce rules for samples s(owner, seq, sample), seq counting from 1 without gaps, as a recursion over seq.
CARD_STATES = """
w(owner, seq, state, run, failures, dispatchable) AS (SELECT DISTINCT owner, 0::bigint, 'free', 0, 0, false FROM s UNION ALL
  SELECT owner, seq, CASE WHEN state = 'quarantined' OR f = 5 THEN 'quarantined' WHEN sample = 'failed' THEN state WHEN state = 'free' AND (sample = 'pid' OR (sample = 'util' AND run = 2)) THEN 'unmanaged'
      WHEN state = 'unmanaged' AND sample = 'clean' AND run = 1 THEN 'free' ELSE state END,
    CASE WHEN state = 'quarantined' OR f = 5 THEN 0 WHEN sample = 'failed' THEN run WHEN state = 'free' AND sample = 'util' AND run < 2 THEN run + 1 WHEN state = 'unmanaged' AND sample = 'clean' AND run < 1 THEN run + 1 ELSE 0 END,
    CASE WHEN f = 5 THEN 0 ELSE f END, sample = 'clean' AND (state = 'free' OR (state = 'unmanaged' AND run = 1))
  FROM (SELECT s.owner, s.seq, s.sample, w.state, w.run, CASE WHEN w.state <> 'quarantined' AND s.sample = 'failed' THEN w.failures + 1 ELSE 0 END AS f FROM w JOIN s ON s.owner = w.owner AND s.seq = w.seq + 1))"""

_SPARK = {"jobs": (_jobs(SPARK_DAY), "orders"), "batches": (BATCHES, "customer"), "projects": (PROJECTS, "nation"), "cards": (CARDS, "supplier"), "log": (_events(SPARK_DAY, "get_json_object(props, '$.k')"), "events")}


def duck(*names: str) -> str:
    """WITH these frames, for a twin's SQL to go on from."""
    return "WITH " + ",\n".join(f"{n} AS ({DUCK[n]})" for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, source = _SPARK[name]
    return spark.sql(sql.replace(f"FROM {source}", "FROM {source}"), source=table(spark, sf_dir, source))
