"""Mixing sources to target weights by Poisson replication (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetops.llm.common import pack, saved, unpack

#: A Poisson mean above this is drawn as a sum of draws with equal means below it: exp(-mean) stays far from underflow.
STEP = 32
#: Thresholds of a drawn count: a Poisson count of mean 32 passes 160 with a chance below 2**-160.
TOP = 160
#: Source tables of more rows than this are joined by a salted shuffle, not broadcast.
BROADCAST_SOURCES = 10_000
SALTS = 32


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 random bits: the MD5 of the parts, which any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(df: DataFrame, weights: dict[str, float] | None, alpha: float, total: int | None, source_col: str) -> DataFrame:
    """For each source its rows, target rows and mean repetition rate; one aggregation, combined before the shuffle."""
    seen = df.groupBy(F.col(source_col).alias("_source")).agg(F.count("*").alias("_n"))
    if weights is None:
        want = F.pow(F.col("_n").cast("double"), F.lit(float(alpha)))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.lit(None).cast("map<string,double>")
        want = F.coalesce(F.get(F.map_values(F.map_filter(given, lambda k, _: k == F.col("_source"))), F.lit(0)), F.lit(0.0))
    seen = seen.withColumn("_want", want.cast("double"))
    sums = seen.agg(F.sum("_want").alias("_all"), F.lit(total).cast("long").alias("_given"), F.sum("_n").alias("_rows"))
    seen = seen.crossJoin(F.broadcast(sums))  # one row
    goal = F.coalesce(F.col("_given"), F.col("_rows")) * F.try_divide(F.col("_want"), F.col("_all"))
    return seen.select("_source", "_n", F.coalesce(goal / F.col("_n"), F.lit(0.0)).alias("_rate"))


def thresholds(rate: Column) -> Column:
    """The Poisson distribution function of the mean at 0, 1, ... TOP, by the recurrence p(k) = p(k-1) * mean / k."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["all"], F.array(s["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TOP)), start, step, lambda s: s["all"])


def mix(
    df: DataFrame,
    weights: dict[str, float] | None = None,
    alpha: float = 0.5,
    total: int | None = None,
    seed: int = 42,
    source_col: str = "source",
    key_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Repeat each document a Poisson number of times so that sources meet target weights, in a global random order.

    weights: share of each source (others get none); without it a source's share is its row count to the power alpha.
    total: rows wanted, as many as come in by default. A source's rate is its target rows over its rows; a document's
    count is the inverse of the Poisson distribution function of that rate at a number hashed from seed, key and text,
    so it depends on no other row and a recomputed task draws it again. Adds `copies` (the count), `copy_no` (from 1)
    and `mix_key`, which replace input columns of these names. The order is by `mix_key`, a hash of document and copy,
    which deals rows over the partitions; each partition is sorted by it.

    A null source is a source of its own (weight 0 if weights are given); null keys and texts hash as empty. Rows equal
    in key and text get equal counts. An empty input gives an empty result. A hot source costs nothing: the table of
    rates has a row per source and is broadcast after a count of its rows, beyond BROADCAST_SOURCES it is joined
    with salts.
    """
    per = rates(df, weights, alpha, total, source_col)
    per = per.withColumn("_draws", F.greatest(F.lit(1), F.ceil(F.col("_rate") / STEP)).cast("int"))
    per = saved(per.select("_source", "_draws", thresholds(F.col("_rate") / F.col("_draws")).alias("_cdf")))
    bare = lambda c: F.coalesce(F.col("_row")[c].cast("string"), F.lit(""))
    rows = pack(df).withColumn("_source", F.col("_row")[source_col]).withColumn("_id", F.concat_ws("\x1f", F.lit(str(seed)), bare(key_col), F.md5(bare(text_col))))
    if per.count() <= BROADCAST_SOURCES:
        on, right = F.col("_source").eqNullSafe(F.col("_to")), F.broadcast(per.withColumnRenamed("_source", "_to"))
    else:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)))
        right = per.withColumnRenamed("_source", "_to").withColumn("_for", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = F.col("_source").eqNullSafe(F.col("_to")) & (F.col("_salt") == F.col("_for"))
    # As a variable of an outer lambda the number is hashed once, not once for each threshold.
    draws = F.transform(F.sequence(F.lit(1), F.col("_draws")), lambda d: unit("_id", F.lit("draw"), d.cast("string")))
    counts = F.transform(draws, lambda u: F.size(F.filter("_cdf", lambda c: c <= u)))
    rows = rows.join(right, on).withColumn("copies", F.aggregate(counts, F.lit(0), lambda s, n: s + n))
    rows = rows.filter("copies > 0").select("_row", "_id", "copies", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
    key = F.conv(F.substring(F.md5(F.concat_ws("\x1f", "_id", F.lit("order"), F.col("copy_no").cast("string"))), 1, 15), 16, 10)
    rows = rows.withColumn("mix_key", key.cast("long")).repartition("mix_key").sortWithinPartitions("mix_key")
    return unpack(rows, df.columns, ["copies", "copy_no", "mix_key"])
