import hashlib
import math
from collections import Counter

from fleetops.llm import mixing
from fleetops.llm.mixing import mix, thresholds
from fleetops.llm.sharding import shard, write_shards
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, shard int, copies int"


def rows(n):
    return [(i, f"text {i}", "hot" if i % 3 else f"s{i % 5}", 99, 99) for i in range(n)]


def test_poisson_thresholds(spark):
    for rate in (0.0, 0.3, 5.0, 32.0):
        got = spark.range(1).select(thresholds(F.lit(rate)).alias("t")).first().t
        p = want = math.exp(-rate)
        for k, g in enumerate(got):
            if k:
                p *= rate / k
                want += p
            assert abs(g - want) < 1e-12


def test_mix_meets_target_weights(spark):
    df = spark.createDataFrame(rows(6000), SCHEMA)
    out = mix(df, {"hot": 1.0, "s0": 1.0}, total=8000).collect()
    n = Counter(r.source for r in out)
    assert set(n) == {"hot", "s0"}
    assert all(abs(v - 4000) < 400 for v in n.values())
    per = Counter((r.doc_id, r.copies) for r in out)
    assert all(c == copies for (_, copies), c in per.items())
    assert all(sorted(r.copy_no for r in out if r.doc_id == d) == list(range(1, c + 1)) for (d, c) in list(per)[:20])
    again = mix(df.repartition(7), {"hot": 1.0, "s0": 1.0}, total=8000)
    assert Counter((r.doc_id, r.copy_no, r.mix_key) for r in again.collect()) == Counter((r.doc_id, r.copy_no, r.mix_key) for r in out)


def test_mix_large_rates_and_edges(spark):
    df = spark.createDataFrame([(None, None, None, 1, 1), (1, "", "a", 1, 1), (1, "", "a", 1, 1), (2, "x", "a", 1, 1)], SCHEMA)
    n = Counter(r.source for r in mix(df, total=2000).collect())
    assert set(n) == {None, "a"} and all(v > 500 for v in n.values())
    assert mix(df, {}).count() == 0
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_sources_are_joined_with_salts(spark, monkeypatch):
    df = spark.createDataFrame([*rows(900), (None, None, None, 1, 1)], SCHEMA)
    tell = lambda: sorted(((r.doc_id or -1, r.copies, r.copy_no, r.mix_key) for r in mix(df, total=2500).collect()))
    want = tell()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert tell() == want and len(want) > 2000


def test_shard_deals_rows_evenly(spark):
    df = spark.createDataFrame([*rows(1001), (None, None, None, 0, 0), (5, "text 5", "hot", 99, 99), (7, "long " * 9000, "x", 0, 0)], SCHEMA)
    out = shard(df, 24, bucket_mb=1)
    assert out.columns == ["doc_id", "text", "source", "copies", "shard", "slot"]
    got = out.collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 1004 and set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k in sizes:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k]))
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in df.collect())
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert abs(sum(a < b for a, b in zip(order, order[1:])) / len(order) - 0.5) < 0.08


def places(df, **options):
    return {(r.doc_id, r.text, r.shard, r.slot) for r in shard(df, **options).collect()}


def test_shard_is_a_function_of_rows_and_seed(spark):
    df = spark.createDataFrame([*rows(3000), (5, "long " * 300_000, "x", 0, 0), (6, "Long " * 300_000, "x", 0, 0)], SCHEMA)
    want = places(df, bucket_mb=1)
    assert len(want) == 3002 and places(df, bucket_mb=1, seed=7) != want
    try:
        for partitions, shuffle, aqe in ((9, 9, "false"), (40, 3, "true")):
            spark.conf.set("spark.sql.adaptive.enabled", aqe)
            spark.conf.set("spark.sql.shuffle.partitions", shuffle)
            assert places(df.repartition(partitions), bucket_mb=1) == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def plain_places(rows, columns, n_shards, limit, seed=42, bucket_rows=2000):
    """The same places by loops: ordinals of equal rows, buckets, a Fisher-Yates shuffle in each."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    seen, dealt, out, at, n = Counter(), {}, [], 0, len(rows)
    buckets = max(-(-sum(len((r["text"] or "").encode()) + 64 for r in rows) // limit), -(-n // bucket_rows), 1)
    for r in rows:
        same = md5(f"{seed}|" + "".join("n" if r[c] is None else md5(str(r[c])) for c in columns))
        h = md5(f"{same}|{seen[same]}")
        seen[same] += 1
        dealt.setdefault(int(h[:15], 16) % buckets, []).append((h, r))
    for b in sorted(dealt):
        own, order = sorted(dealt[b], key=lambda x: x[0]), list(range(len(dealt[b])))
        for i in range(len(order) - 1, 0, -1):
            j = int(md5(f"{seed}|{b}|{i}")[:15], 16) % (i + 1)
            order[i], order[j] = order[j], order[i]
        for place, (_, r) in zip(order, own):
            k = (at + place) * n_shards // n
            out.append((r["doc_id"], k, at + place - -(-k * n // n_shards)))
        at += len(own)
    return sorted(out, key=str)


def test_shard_against_a_loop(spark):
    df = spark.createDataFrame([*rows(500), *rows(90), *rows(90), (None, None, None, None, 3), (None, "", "", None, 3), (7, "é" * 90_000, "x", 0, 0)], SCHEMA)
    for options in ({}, {"bucket_rows": 100}):
        got = shard(df, 7, bucket_mb=1, **options).select("doc_id", "shard", "slot").collect()
        assert sorted((tuple(r) for r in got), key=str) == plain_places([r.asDict() for r in df.collect()], df.columns, 7, 1 << 20, **options)


def runs(got):
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    return 1 + sum(a != b for a, b in zip(order, order[1:]))


def test_copies_are_spread_like_other_rows(spark):
    df = spark.range(2000).selectExpr("id % 50 as doc_id", "concat('text ', id % 50) as text")  # 50 rows, 40 times each
    got = shard(df, 24).select("doc_id", "shard", "slot").collect()
    assert runs(got) > 1_900  # some 1,960 in a random order
    assert runs(shard(df, 24, bucket_rows=90).select("doc_id", "shard", "slot").collect()) > 1_900
    mixed = mix(df.selectExpr("doc_id", "text", "cast(doc_id % 2 as string) as source"), alpha=0.5, seed=42).select("doc_id", "text", "source")
    after = shard(mixed, 24).collect()
    by = Counter(r.doc_id for r in after)
    assert runs(after) > 0.93 * len(after) and all(len({r.shard for r in after if r.doc_id == d}) > 8 for d, n in by.items() if n > 30)


def test_many_equal_rows_go_by_lots(spark):
    df = spark.range(10_000).selectExpr("1L as doc_id", "'same' as text").unionByName(spark.range(500).selectExpr("id as doc_id", "'other' as text"))
    got = shard(df, 24).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 10_500 and max(sizes.values()) - min(sizes.values()) <= 1 and sum(r.text == "same" for r in got) == 10_000
    assert all({r.slot for r in got if r.shard == k} == set(range(n)) for k, n in sizes.items())


def test_shard_takes_columns_of_any_type(spark):
    df = spark.range(300).selectExpr("id as doc_id", "'t' as text", "map('a', id) as m", "array(id) as a", "named_struct('b', id) as s", "cast('x' as binary) as b")
    got = shard(df, 5).collect()
    assert len(got) == 300 and Counter(r.shard for r in got) == dict.fromkeys(range(5), 60) and all(r.m["a"] == r.doc_id for r in got)


def test_shard_edges(spark, tmp_path):
    assert shard(spark.createDataFrame([], SCHEMA)).count() == 0
    few = shard(spark.createDataFrame(rows(3), SCHEMA), 24).collect()
    assert len(few) == 3 and {r.slot for r in few} == {0}
    write_shards(spark.createDataFrame(rows(50), SCHEMA), str(tmp_path / "out"), n_shards=4)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 4
    for part in (tmp_path / "out").glob("*/*.parquet"):
        slots = [r.slot for r in spark.read.parquet(str(part)).collect()]
        assert slots == sorted(slots)


def test_copies_of_a_row_leave_its_bucket(spark):
    schema = "doc_id long, text string, extra int"
    copies = spark.range(6000).selectExpr("-1L as doc_id", "repeat('long text ', 100) as text", "7 as extra")  # 6 MB
    nulls = spark.range(30000).selectExpr("null as doc_id", "null as text", "cast(id as int) as extra")  # 2 MB, all different
    df = copies.unionByName(nulls).unionByName(spark.createDataFrame([(i, f"text {i}", 0) for i in range(2000)], schema))
    got = shard(df, 24, bucket_mb=1).select("doc_id", "extra", "shard", "slot").collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 38000 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all({r.slot for r in got if r.shard == k} == set(range(n)) for k, n in sizes.items())
    assert Counter(r.doc_id for r in got)[-1] == 6000 and sorted(r.extra for r in got if r.doc_id is None) == list(range(30000))
    in_shards = lambda want: len({r.shard for r in got if want(r)})
    assert in_shards(lambda r: r.doc_id is None) == 24 and in_shards(lambda r: r.doc_id == -1) == 24
    again = shard(df.repartition(7), 24, bucket_mb=1).select("doc_id", "extra", "shard", "slot").collect()
    assert Counter(again) == Counter(got)
