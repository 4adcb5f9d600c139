"""Running values along each owner's rows, for owners of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fleetops.session import saved


def running(df: DataFrame, owner: Sequence[str], order: Sequence[str], sums: Mapping[str, Column] | None = None, maxima: Mapping[str, Column] | None = None, before: Mapping[str, Column] | None = None) -> DataFrame:
    """Adds for each owner, in order: the sums and maxima of the given columns up to and with this row (nulls left out; null
    where there are none, a sum is 0), and what the row before had (null for the first).

    A hot owner isn't one task: rows are put in ranges of (owner, order), each range is gone through by itself, and what
    an owner's ranges hold together is carried into the next one. Only an owner that goes on from one range into another
    needs that, so there are fewer such carried rows than ranges, and these are broadcast. The order must end in a unique
    column, but for sums and maxima ties do no harm beyond their own order."""
    sums, maxima, before = sums or {}, maxima or {}, before or {}
    held = F.struct(*[c.alias(n) for n, c in before.items()]) if before else F.lit(0)
    parts = {f"_s_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()} | {f"_m_{n}": c for n, c in maxima.items()} | {"_held": held}
    placed = df.select("*", *[c.alias(n) for n, c in parts.items()])
    placed = saved(placed.repartitionByRange(*owner, *order).withColumn("_range", F.spark_partition_id()))

    whole = [F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums] + [F.max(f"_m_{n}").alias(f"_m_{n}") for n in maxima] + [F.max_by("_held", F.struct(*order)).alias("_held")]
    ranges = placed.groupBy(*owner, "_range").agg(*whole)
    along = Window.partitionBy(*owner).orderBy("_range")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.sum(f"_s_{n}").over(earlier).alias(f"_cs_{n}") for n in sums] + [F.max(f"_m_{n}").over(earlier).alias(f"_cm_{n}") for n in maxima] + [F.lag("_held").over(along).alias("_ch")]
    carried = ranges.select(*[F.col(c).alias(f"_o{k}") for k, c in enumerate(owner)], F.col("_range").alias("_r"), *carry, F.row_number().over(along).alias("_nth")).filter("_nth > 1").drop("_nth")

    inside = Window.partitionBy(*owner, "_range").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = [F.sum(f"_s_{n}").over(upto).alias(f"_ls_{n}") for n in sums] + [F.max(f"_m_{n}").over(upto).alias(f"_lm_{n}") for n in maxima] + [F.lag("_held").over(inside).alias("_lh")]
    same = [F.col(c).eqNullSafe(F.col(f"_o{k}")) for k, c in enumerate(owner)]
    rows = placed.select("*", *local).join(F.broadcast(carried), [F.col("_range") == F.col("_r"), *same], "left")
    out = [(F.col(f"_ls_{n}") + F.coalesce(f"_cs_{n}", F.lit(0))).alias(n) for n in sums] + [F.greatest(f"_lm_{n}", f"_cm_{n}").alias(n) for n in maxima]
    last = F.coalesce("_lh", "_ch")
    return rows.select(*df.columns, *out, *[last[n].alias(n) for n in before])


def stepped(df: DataFrame, owner: str, order: Sequence[str], symbol: str, states: Sequence, step: Callable[[object, object], object], out: str = "state") -> DataFrame:
    """Adds `out`: the number in `states` of the state after each row, for each owner from the first state on, in order. The
    states are all there are: a step from one of them gives one of them again.

    A hot owner isn't one task here either. What a range of rows does to an owner is a map from states to states; a range
    gives one for its first and one for its last owner, as only these go on beyond it. Maps of ranges are put one behind
    the other, and each range is gone through once more from the state it starts with. Rows pass in batches, sorted; a step
    is a look into a table of those seen before. A null owner is one of its own. The order must end in a unique column."""
    number = {s: i for i, s in enumerate(states)}
    schema = T.StructType(list(df.schema.fields))
    placed = df.withColumn("_owner", F.col(owner).cast("string")).repartitionByRange(owner, *order).sortWithinPartitions(owner, *order)
    placed = saved(placed.withColumn("_range", F.spark_partition_id()))

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, found, part, same = {}, [], None, tuple(range(len(states)))
        for batch in batches:
            for k, s, part in zip(batch["_owner"].tolist(), batch["_symbol"].tolist(), batch["_range"].tolist(), strict=True):
                if not found or found[-1][0] != k:
                    found = [*found[:1], (k, same)]  # the first one and the one at hand
                now = found[-1][1]
                if (now, s) not in known:
                    known[now, s] = tuple(number[step(states[i], s)] for i in now)
                found[-1] = (k, known[now, s])
        yield pd.DataFrame([(k, part, list(m)) for k, m in found], columns=["_of", "_r", "map"])

    def carry(parts: pd.DataFrame) -> pd.DataFrame:
        rows, now = [], 0
        for k, r, m in parts.sort_values("_r").itertuples(index=False):
            rows.append((k, r, now))
            now = int(m[now])
        return pd.DataFrame(rows, columns=["_of", "_r", "_start"])

    ends = placed.select("_owner", F.col(symbol).alias("_symbol"), "_range").mapInPandas(maps, "_of string, _r int, map array<int>")
    starts = ends.groupBy("_of").applyInPandas(carry, "_of string, _r int, _start int").filter("_start > 0")
    rows = placed.join(F.broadcast(starts), (F.col("_range") == F.col("_r")) & F.col("_owner").eqNullSafe(F.col("_of")), "left")
    rows = rows.select(*df.columns, "_owner", F.coalesce("_start", F.lit(0)).alias("_start"))

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, last, now = {}, None, 0
        for batch in batches:
            found = []
            for k, s, start in zip(batch["_owner"].tolist(), batch[symbol].tolist(), batch["_start"].tolist(), strict=True):
                if (k,) != last:
                    last, now = (k,), start
                if (now, s) not in known:
                    known[now, s] = number[step(states[now], s)]
                now = known[now, s]
                found.append(now)
            yield batch.drop(columns=["_owner", "_start"]).assign(**{out: pd.Series(found, index=batch.index, dtype="int32")})

    return rows.mapInPandas(follow, schema.add(out, T.IntegerType()))
