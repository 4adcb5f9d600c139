"""Helpers shared by the corpus operators: table access, lineage cuts, words, row packing, prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The ASCII white space that separates words: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local one in local mode (tests);
    on a cluster that is refused, as executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Where `cut` notes the tables that it writes: a list for each run, by thread.
NOTED: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def noted(names: list[str]) -> Iterator[list[str]]:
    """What `cut` writes meanwhile, in this thread, is added to names, for `release`."""
    token = NOTED.set(names)
    try:
        yield names
    finally:
        NOTED.reset(token)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fleetops-{tag}-{uuid.uuid4().hex}"
    if (names := NOTED.get()) is not None:
        names.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, names: list[str]) -> int:
    """Delete tables that `cut` has written, once the frames that read them are no longer needed; returns how many."""
    context, gone = spark.sparkContext, len(names)
    while names:
        path = context._jvm.org.apache.hadoop.fs.Path(names.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return gone


#: Groups of a sample, as many as may be broadcast: a count for each.
FEW = 10_000


def sample(df: DataFrame, group: str, order: str, per_group: int) -> DataFrame:
    """Up to per_group rows of each group, the least by the random long `order`, with their number `nth`; rows equal in
    both count once. What can't be among them is left out by a threshold before anything is sorted: few rows of a
    group meet in one task, however many it has. The counts of the groups are broadcast if they are FEW at most."""
    seen = saved(df.groupBy(F.col(group).alias("_group")).agg(F.approx_count_distinct(order, 0.02).alias("_seen")))
    seen = F.broadcast(seen) if seen.count() <= FEW else seen
    enough = 1.2 * per_group + 8 * per_group**0.5 + 32
    share = F.pmod(order, F.lit(1 << 40)) / F.lit(float(1 << 40))
    few = df.join(seen, F.col(group) == F.col("_group")).filter(share * F.col("_seen") < enough).select(*df.columns)
    window = Window.partitionBy(group).orderBy(F.pmod(order, F.lit(1 << 40)), order)
    return few.dropDuplicates([group, order]).withColumn("nth", F.row_number().over(window)).filter(F.col("nth") <= per_group)


def saved(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for frames that are small beside the input; Spark's cleaner removes it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; null gives none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))


def pack(df: DataFrame, name: str = "_row") -> DataFrame:
    """The whole row as one struct, so that no column of the input can clash with a working column."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def unpack(df: DataFrame, fields: Sequence[str], outs: Sequence[str], name: str = "_row") -> DataFrame:
    """The fields of the packed row, then outs; an input column with the name of an output gives way to it."""
    taken = {c.lower() for c in outs}
    return df.select(*[F.col(name)[c].alias(c) for c in fields if c.lower() not in taken], *outs)


def below(df: DataFrame, key: str, values: Sequence[str], block: int = 256) -> DataFrame:
    """Add for each value column `<value>_below`: its sum over all rows with a smaller key (keys unique, not negative).

    Two levels: sums by block of keys, a running sum over the blocks, then one within each block. The only window
    over all rows sees one row per block, so its input is 1/256 of the key range.
    """
    part = df.withColumn("_block", F.floor(F.col(key) / block).cast("long"))
    before = lambda w, v: F.coalesce(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = part.groupBy("_block").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    blocks = blocks.select("_block", *[before(Window.orderBy("_block"), f"_{v}").alias(f"_{v}_base") for v in values])
    inner = Window.partitionBy("_block").orderBy(key)
    part = part.select("*", *[before(inner, v).alias(f"{v}_below") for v in values]).join(blocks, "_block")
    return part.select(*df.columns, *[(F.col(f"{v}_below") + F.col(f"_{v}_base")).alias(f"{v}_below") for v in values])
