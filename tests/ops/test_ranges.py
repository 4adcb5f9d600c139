"""Pages of tables in ranges: the same as pages of the table itself, from few files."""

import random

import pytest
from pyspark.sql import functions as F

from fleetops.operators.paging import keyset_page
from fleetops.sources import ranges as R

ORDER = [("day", False), ("name", True), ("id", True)]


def rows_of(page):
    return sorted(tuple(r) for r in page.collect())


def table(spark, n, seed, start=0):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.randrange(30), rng.choice(["a", "B", "é", "\U0001f600", ""]), rng.random()) for i in range(start, start + n)], "id long, day int, name string, v double").cache()


@pytest.mark.parametrize("later", [False, True])
def test_pages_are_those_of_the_table(spark, tmp_path, later):
    at, df = str(tmp_path / "t"), table(spark, 2000, 1)
    R.write_ranges(df, at, ORDER, files=20)
    if later:  # ranges that overlap the others
        more = table(spark, 600, 2, 5000)
        R.write_ranges(more, at, ORDER, files=3)
        df = df.union(more)
    cursors = [None, *[list(r) for r in df.select("day", "name", "id").orderBy(F.rand(3)).limit(4).collect()], [-1, "", 0]]
    for cursor in cursors:
        page = R.read_page(spark, at, ORDER, 40, cursor)
        assert rows_of(page) == rows_of(keyset_page(df, ORDER, 40, cursor))
        assert len(page.inputFiles()) <= (6 if later else 2)
    rare = F.col("v") < 0.01
    assert rows_of(R.read_page(spark, at, ORDER, 5, cursors[1], where=rare)) == rows_of(keyset_page(df.filter(rare), ORDER, 5, cursors[1]))
    upper = cursors[2]
    upto = df.filter(~R.after(ORDER, upper))
    assert rows_of(R.read_page(spark, at, ORDER, 3000, None, upper)) == rows_of(keyset_page(upto, ORDER, 3000))


def test_files_of_a_page_do_not_grow_with_the_table(spark, tmp_path):
    for n, files in ((1000, 5), (8000, 40)):
        at = str(tmp_path / f"t{n}")
        R.write_ranges(spark.range(n), at, [("id", True)], files=files)
        page = R.read_page(spark, at, [("id", True)], 50, [n // 2])
        assert len(page.inputFiles()) <= 2 and [r.id for r in page.orderBy("id").collect()] == list(range(n // 2 + 1, n // 2 + 52))


def test_other_orders_empty_tables_and_unnamed_files(spark, tmp_path):
    at = str(tmp_path / "t")
    R.write_ranges(table(spark, 0, 1), at, ORDER)
    assert R.read_page(spark, at, ORDER, 5).collect() == [] and R.read_page(spark, at, ORDER, 5).columns == ["id", "day", "name", "v", "extra"]
    R.write_ranges(table(spark, 10, 1), at, ORDER)
    table(spark, 10, 1, 100).write.parquet(f"{at}/data/unnamed")  # a writer that stopped before it named its files
    assert {r.id for r in R.read_page(spark, at, ORDER, 50).collect()} == set(range(10))
    with pytest.raises(ValueError):
        R.read_page(spark, at, [("day", True), ("name", True), ("id", True)], 5)
