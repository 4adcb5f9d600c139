"""Readers of tables, specs, logs, output files, telemetry and notifications; writers of notifications, pages, facts.

All paths are read by Spark's own readers, so they may lie in any store that Spark knows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetops.sources.schemas import BATCH_SPEC, INVENTORY, SAMPLE, SCHEMAS
from fleetops.sources.versions import Version, change


def read_table(spark: SparkSession, folder: str, name: str, form: str = "parquet", schema: str | None = None) -> DataFrame:
    """A table with its fixed schema; columns that a file lacks are null, others are not read."""
    return spark.read.schema(schema or SCHEMAS[name]).format(form).load(f"{folder}/{name}")


def read_optional(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """read_table, or no rows of the same schema if the table isn't there."""
    try:
        return read_table(spark, folder, name, schema=schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema or SCHEMAS[name])


def read_batch_specs(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file as typed rows with their file; a bad document is kept as text in _corrupt."""
    rows = spark.read.schema(BATCH_SPEC).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("file"))


def stream_inbox(spark: SparkSession, path: str, schema: str = "request_id string, binding string, batch string", names: str = "submit-*.json") -> DataFrame:
    """The requests in new files of these names, each file once (Spark's file source remembers those it has seen)."""
    return spark.readStream.schema(schema).option("pathGlobFilter", names).json(path)


LOG_PATH = r"logs/([^/]+)/([^/]+)-v(\d+)\.log$"


def read_logs(spark: SparkSession, path: str, names: str = "*.log", keys: str = LOG_PATH) -> DataFrame:
    """Lines of logs/<batch>/<task>-v<n>.log: batch, task, version, line_no (from 1) and text; a last line end opens no
    line, and an empty file has none. Files elsewhere have null keys. names and keys: other names of the files, and the
    pattern of their path with groups for batch, task and version.

    A file is read in as many parts as Spark splits it into: lines are numbered in their part, and each part goes on
    from those before it in the file."""
    lines = spark.read.text(path, lineSep="\n", recursiveFileLookup=True, pathGlobFilter=names)
    lines = lines.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_part"), F.col("value").alias("text"))
    lines = lines.withColumn("_at", F.monotonically_increasing_id())
    sizes = lines.groupBy("_file", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_file", "_part", F.coalesce(before, F.lit(0)).alias("_base"))
    lines = lines.withColumn("_nth", F.row_number().over(Window.partitionBy("_file", "_part").orderBy("_at"))).join(sizes, ["_file", "_part"])
    part = lambda i: F.nullif(F.regexp_extract("_file", keys, i), F.lit(""))
    return lines.select(part(1).alias("batch"), part(2).alias("task"), part(3).cast("long").alias("version"), (F.col("_base") + F.col("_nth")).alias("line_no"), "text")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length and content of files; what isn't selected later isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def read_samples(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Telemetry lines as CSV; ts becomes a timestamp, and a line that can't be read is null in all fields."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(SAMPLE).option("mode", "PERMISSIVE").csv(path).withColumn("ts", F.try_to_timestamp("ts"))


def normal_pci(pci: Column) -> Column:
    """domain:bus:device.function in lower case with an 8-digit domain; null if it isn't a PCI id."""
    form = r"(?i)^(?:([0-9a-f]{4,8}):)?([0-9a-f]{2}):([0-9a-f]{2})\.([0-7])$"
    part = lambda i: F.lower(F.regexp_extract(F.trim(pci), form, i))
    return F.when(F.trim(pci).rlike(form), F.concat(F.lpad(part(1), 8, "0"), F.lit(":"), part(2), F.lit(":"), part(3), F.lit("."), part(4)))


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Cards with normal PCI ids and `reasons`: bad_pci, and for each identity (idx, uuid, pci) that occurs twice its name."""
    cards = spark.read.schema(INVENTORY).csv(path).withColumn("pci", normal_pci(F.col("pci")))
    for c in ("idx", "uuid", "pci"):
        again = cards.groupBy(c).agg(F.count("*").alias(f"_{c}"))
        cards = cards.join(again, c, "left")
    twice = [F.when(F.col(f"_{c}") > 1, F.lit(f"{c}_repeated")) for c in ("idx", "uuid", "pci")]
    reasons = F.array_compact(F.array(F.when(F.col("pci").isNull(), "bad_pci"), *twice))
    return cards.withColumn("reasons", reasons).drop("_idx", "_uuid", "_pci")


def read_notifications(spark: SparkSession, path: str, acked: bool = False) -> DataFrame:
    """Event files, newest first: file, modified, event (variant, null if unreadable), error, acked. Files named .acked
    are left out unless asked for."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.col("_metadata.file_path")
    rows = rows.select(name.alias("file"), F.col("_metadata.file_modification_time").alias("modified"), "value")
    event = F.try_parse_json("value")
    rows = rows.select("file", "modified", event.alias("event"), F.when(event.isNull(), "unreadable").alias("error"), F.col("file").endswith(".acked").alias("acked"))
    return (rows if acked else rows.filter(~F.col("acked"))).orderBy(F.desc("modified"), "file")


#: Up to so many partitions of events are named to the reader; a batch that touches more looks at all of them.
MOST_PARTS = 1000


def write_notifications(df: DataFrame, path: str, key: str = "event_id", by: str | None = None) -> None:
    """Append events whose key isn't there yet, one JSON object a line: writing the same batch again adds nothing.

    by: a column, the same for the same event (its day), that parts the folder: only the parts that a batch touches are
    read again. One writer at a time: the look and the append aren't one step. `append_events` has no such limit."""
    if by is None:
        known = spark_optional(df.sparkSession, path, f"{key} string")
        df.dropDuplicates([key]).join(known.select(key), key, "left_anti").write.mode("append").json(path)
        return
    parts = [r[0] for r in df.select(by).distinct().limit(MOST_PARTS + 1).collect()]
    known = spark_optional(df.sparkSession, path, f"{key} string, {by} {df.schema[by].dataType.simpleString()}")
    if len(parts) <= MOST_PARTS:
        known = known.filter(F.col(by).isin([p for p in parts if p is not None]) | F.col(by).isNull())
    df.dropDuplicates([key]).join(known.select(key), key, "left_anti").write.mode("append").partitionBy(by).json(path)


def append_events(df: DataFrame, path: str, key: str = "event_id", writer: str | None = None, batch: int = 0) -> Version:
    """The same into a table under versions: look and append are one commit, so of writers that race, and of a micro-batch
    that runs twice, each event is there once. Null keys are left out."""
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    fresh = df.filter(F.col(key).isNotNull()).dropDuplicates([key])
    return change(df.sparkSession, path, schema, lambda now: fresh.join(now.select(key), key, "left_anti").select(*df.columns), False, writer, batch)


def spark_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def page_envelope(page: DataFrame, columns: Sequence[str], limit: int, cursor: Column) -> DataFrame:
    """One JSON row for a page with its `extra` mark: rows (in the given order of columns), limit, truncated and
    next_cursor (of the last row that belongs to the page, null on the last page)."""
    mine = ~F.col("extra")
    rows = F.sort_array(F.collect_list(F.when(mine, F.struct(*columns))))
    out = page.agg(rows.alias("rows"), F.coalesce(F.bool_or("extra"), F.lit(False)).alias("truncated"), F.max(F.when(mine, F.struct(*columns, cursor.alias("_c")))).alias("_last"))
    return out.select(F.to_json(F.struct("rows", F.lit(limit).alias("limit"), "truncated", F.when(F.col("truncated"), F.col("_last._c")).alias("next_cursor"))).alias("page"))


def write_page(page: DataFrame, columns: Sequence[str], limit: int, cursor: Column, path: str) -> None:
    page_envelope(page, columns, limit, cursor).write.mode("overwrite").text(path)


def write_partitioned(df: DataFrame, path: str, by: str, files: int = 1) -> None:
    """Append facts by partition: rows of one value meet in `files` files at most, however many tasks made them."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files))
    df.repartition(by, salt).write.mode("append").partitionBy(by).parquet(path)
