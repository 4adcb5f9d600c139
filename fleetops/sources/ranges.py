"""Tables in order, with the least and the greatest key of each file: a page opens only the files that it comes from.

A folder holds `data` (Parquet, each file a range of the order) and `keys` (a row for each file). What is written goes to
`data` first; `keys` names it afterwards, and readers open nothing that isn't named there. Later writes bring ranges of
their own, which may overlap earlier ones; pages stay right, and open a file more for each range that covers them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetops.operators.paging import after, keyset_page

MOST_FILES = 256  # names of files that are looked at in one go


def write_ranges(df: DataFrame, path: str, order: Sequence[tuple[str, bool]], files: int | None = None) -> None:
    """Add rows, sorted by ranges of the order: (column, ascending) pairs without nulls that end in a unique column.
    files: how many ranges; null: as Spark sees fit."""
    spark, by = df.sparkSession, [F.asc(c) if up else F.desc(c) for c, up in order]
    placed = df.repartitionByRange(*([files] if files else []), *by).sortWithinPartitions(*by)
    data = f"{path}/data/{uuid.uuid4().hex}"
    placed.write.parquet(data)
    # rows of a file are in order, so the first and the last one hold its bounds, whichever way the order goes
    row, at = F.struct(*[c for c, _ in order]), F.col("_metadata.row_index")
    name = F.concat(F.lit(data.rsplit("/", 1)[1] + "/"), F.col("_metadata.file_name")).alias("file")
    keys = spark.read.parquet(data).select(name, row.alias("key"), at.alias("at")).groupBy("file")
    keys = keys.agg(F.min_by("key", "at").alias("first"), F.max_by("key", "at").alias("last"), F.count("*").alias("rows"))
    keys.withColumn("by", F.lit(_text(order))).coalesce(1).write.mode("append").parquet(f"{path}/keys")


def read_page(spark: SparkSession, path: str, order: Sequence[tuple[str, bool]], limit: int, cursor: Sequence | None = None, upper: Sequence | None = None, where: Column | None = None) -> DataFrame:
    """keyset_page of the rows after the cursor, up to and with `upper`, for which `where` holds; it reads the files that
    the page's rows lie in and no others. To find them, files are looked at in order, a few and then more at a time, until
    the next one begins behind the page; with a rare `where` that can be many. The driver holds the keys of one page.

    Raises ValueError if the table is in another order."""
    names = _page_files(spark, path, order, limit, cursor, upper, where)
    if not names:
        some = spark.read.parquet(f"{path}/keys").select("file").limit(1).collect()
        return keyset_page(spark.read.parquet(f"{path}/data/{some[0].file}" if some else f"{path}/data/*").limit(0), order, limit)
    return keyset_page(_rows(spark, path, names, order, cursor, upper, where), order, limit)


def _page_files(spark: SparkSession, path: str, order: Sequence[tuple[str, bool]], limit: int, cursor: Sequence | None, upper: Sequence | None, where: Column | None) -> list[str]:
    keys = spark.read.parquet(f"{path}/keys")
    odd = keys.filter(F.col("by") != _text(order)).limit(1).collect()
    if odd:
        raise ValueError(f"the table at {path} is in the order {odd[0].by}")
    bound = lambda end: [(f"{end}.{c}", up) for c, up in order]
    if cursor is not None:
        keys = keys.filter(after(bound("last"), cursor))
    in_order, many = [*bound("first"), ("file", True)], 4
    by = [F.asc(c) if up else F.desc(c) for c, up in in_order]
    names, edge, last = [], upper, None
    while True:
        more = keys if last is None else keys.filter(after(in_order, last))
        if edge is not None:
            more = more.filter(~after(bound("first"), edge))
        block = more.orderBy(*by).limit(many).select("first", "file").collect()
        if not block:
            return names
        rows = _rows(spark, path, [*names, *[b.file for b in block]], order, cursor, upper, where)
        # the file's own folder and name, as in `keys`
        file = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1).alias("_file")
        top = rows.select(*[c for c, _ in order], file).orderBy(*[F.asc(c) if up else F.desc(c) for c, up in order]).limit(limit + 1).collect()
        names = sorted({t[-1] for t in top})
        if len(top) > limit:
            edge = list(top[-1][:-1])
        last, many = [*block[-1].first, block[-1].file], min(2 * many, MOST_FILES)


def _rows(spark: SparkSession, path: str, names: Sequence[str], order: Sequence[tuple[str, bool]], cursor: Sequence | None, upper: Sequence | None, where: Column | None) -> DataFrame:
    rows = spark.read.parquet(*[f"{path}/data/{n}" for n in names])
    for test in (None if cursor is None else after(order, cursor), None if upper is None else ~after(order, upper), where):
        rows = rows if test is None else rows.filter(test)
    return rows


def _text(order: Sequence[tuple[str, bool]]) -> str:
    return json.dumps([[c, bool(up)] for c, up in order])
