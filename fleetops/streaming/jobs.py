"""Streams run to their end or as they come, with their output in files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetops.operators.aggregates import batch_event
from fleetops.session import shared_dir
from fleetops.sources.tables import append_events

#: What `stream_batch_events` writes.
EVENTS = "event_id string, batch_id string, started long, finished long, minutes long, counts string, n_failures int"


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now and read back what it wrote. Output and checkpoint lie in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def write_jobs(jobs: DataFrame, path: str, batch: str, buckets: int) -> None:
    """The job table, parted by `bucket`, a hash of the batch: who asks for some batches reads their buckets only."""
    jobs.withColumn("bucket", bucket(batch, buckets)).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def bucket(batch: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(batch), F.lit(buckets)).cast("int")


def stream_batch_events(changes: DataFrame, jobs_path: str, out: str, checkpoint: str, terminal: tuple[str, ...], buckets: int):
    """Start a stream that writes one notification for each batch that a change has ended.

    changes: batch_id. jobs_path: by `write_jobs` with as many buckets; each micro-batch reads those of the batches that it
    touches. Events are keyed by batch and last end and go into a table under versions (`read_version`, EVENTS), together
    with the number of the micro-batch: one that runs twice, or beside another writer, writes nothing twice."""

    def settle(rows: DataFrame, number: int) -> None:
        spark: SparkSession = rows.sparkSession
        touched = rows.select("batch_id", bucket("batch_id", buckets).alias("bucket")).distinct()
        wanted = [r[0] for r in touched.select("bucket").distinct().collect()]  # as many as there are buckets at most
        jobs = spark.read.parquet(jobs_path).filter(F.col("bucket").isin(wanted)).join(touched.select("batch_id"), "batch_id", "left_semi")
        open_ = jobs.filter(~jobs.status.isin(*terminal)).select("batch_id").distinct()
        event = batch_event(jobs.join(open_, "batch_id", "left_anti"), "batch_id", "status", "submitted", "finished", "rev", "row_seq", "id")
        event = event.selectExpr("concat_ws('-', batch_id, coalesce(finished, 0)) as event_id", "cast(batch_id as string) as batch_id", "started", "finished", "minutes", "to_json(counts) as counts", "size(failures) as n_failures")
        append_events(event, out, writer=checkpoint, batch=number)

    return changes.writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
