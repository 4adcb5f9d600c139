"""Sharding by a two-pass external shuffle (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetops.llm.common import below, pack, saved, unpack


def identity(fields: list[Column], seed: int) -> Column:
    """MD5 of the seed and of the MD5 of each field's text, `n` for a null: any SQL engine can repeat it."""
    parts = [F.when(c.isNull(), F.lit("n")).otherwise(F.md5(c.cast("string"))) for c in fields]
    return F.md5(F.concat(F.lit(f"{seed}|"), *parts))


def fisher_yates(n: Column, draw: Callable[[Column], Column]) -> Column:
    """A random order of 0 .. n - 1 as an array: position i, from the last down to 1, changes places with draw(i), a
    position from 0 to i. Each step copies the array, so n should stay in the thousands."""

    def swap(a: Column, i: Column) -> Column:
        j = draw(i)
        low, high = F.slice(a, F.lit(1), j), F.slice(a, j + 2, i - j - 1)
        ends = [F.array(F.get(a, i)), high, F.array(F.get(a, j)), F.slice(a, i + 2, F.size(a))]
        return F.when(i == j, a).otherwise(F.concat(low, *ends))

    start = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    steps = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, swap)


def number(digits: Column) -> Column:
    """The first 60 bits of hexadecimal digits as a long."""
    return F.conv(F.substring(digits, 1, 15), 16, 10).cast("long")


def shard(df: DataFrame, n_shards: int = 24, seed: int = 42, bucket_mb: int = 16, bucket_rows: int = 2_000, text_col: str = "text") -> DataFrame:
    """All rows in a uniformly random order, cut into n_shards runs whose row counts differ by one at most.

    Rows that are equal in all columns are counted before the shuffle and get ordinals; they are interchangeable, so it
    doesn't matter which of them gets which. Pass one scatters rows over buckets by a seeded hash of all columns and of
    the ordinal. The number of buckets follows the rows and the bytes of the texts: some bucket_rows rows and bucket_mb at
    most on average, at any input size. Pass two brings each bucket into a random order by a Fisher-Yates shuffle of its
    row numbers, with draws hashed from seed, bucket and step; the rows themselves are numbered by a sort that may spill.
    The buckets in turn make up the global order; shard k takes the positions from ceil(k*N/n_shards).

    Adds `shard` int and `slot` long (gapless from 0 in each shard), which replace input columns of these names. The same
    rows get the same places however they are partitioned, and equal rows are spread like any others. A hot key, text or
    row doesn't fill a bucket. Nulls are hashed as such, columns of any type as their text; a null text has no bytes. A
    very long text makes its bucket larger by itself. An empty input gives an empty result.
    """
    packed = pack(df)
    size = (F.coalesce(F.octet_length(F.col("_row")[text_col]), F.lit(0)) + 64).cast("long")
    rows = packed.select("_row", identity([F.col("_row")[c] for c in df.columns], seed).alias("_h"), size.alias("_size"))
    same = rows.groupBy("_h").agg(F.count("*").alias("n"), F.sum("_size").alias("bytes"))
    total = same.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    n, buckets = total[0], max(-(-total[1] // (bucket_mb << 20)), -(-total[0] // bucket_rows), 1)
    rows = rows.select("_row", "_h", F.lit(0).cast("long").alias("_k")) if total[2] < 2 else ordinals(rows, total[2])
    digits = F.md5(F.concat("_h", F.lit("|"), F.col("_k").cast("string")))
    rows = rows.select("_row", digits.alias("_h"), F.pmod(number(digits), F.lit(buckets)).alias("_bucket"))
    first = below(saved(rows.groupBy("_bucket").agg(F.count("*").alias("n"))), "_bucket", ["n"])
    draw = lambda i: F.pmod(number(F.md5(F.concat(F.lit(f"{seed}|"), F.col("_bucket").cast("string"), F.lit("|"), i.cast("string")))), i + 1).cast("int")
    first = first.repartition("_bucket").select("_bucket", "n_below", fisher_yates(F.col("n").cast("int"), draw).alias("_places"))
    dealt = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_bucket").orderBy("_h")) - 1)
    dealt = dealt.join(first.hint("merge"), "_bucket")  # each task shuffles the numbers of the buckets that it holds
    dealt = dealt.select("_row", (F.col("n_below") + F.get("_places", F.col("_i"))).cast("long").alias("_at"))
    dealt = dealt.withColumn("shard", F.expr(f"cast(_at * {n_shards} div {max(n, 1)} as int)"))
    slot = F.expr(f"_at - (shard * {n}L + {n_shards - 1}) div {n_shards}")
    return unpack(dealt.withColumn("slot", slot), df.columns, ["shard", "slot"])


#: So many equal rows are written out by one task from their counted row.
LOT = 4_096


def ordinals(rows: DataFrame, most: int) -> DataFrame:
    """_row, _h, _size to _row, _h, _k: equal rows, of which there are `most` at most, are combined before the shuffle,
    counted, and written out again with _k from 0. More than LOT of them are dealt over tasks by lots."""
    counted = rows.groupBy("_h").agg(F.first("_row").alias("_row"), F.count("*").alias("_n"))
    lots = F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {LOT}"))
    lots = counted.select("_row", "_h", "_n", F.explode(lots).alias("_lot"))
    if most > LOT:
        lots = lots.repartition("_h", "_lot")
    inside = F.sequence(F.col("_lot") * LOT, F.least(F.col("_n"), (F.col("_lot") + 1) * LOT) - 1)
    return lots.select("_row", "_h", F.explode(inside).alias("_k"))


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Write `shard(df, ...)` as one folder per shard. A file holds rows with neighbouring slots, in order of `slot`."""
    placed = shard(df, **options).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    placed.write.partitionBy("shard").parquet(path)
