"""The rules that a careless version gets wrong, on hand-made rows."""

import hashlib
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetops.functions import scalars as X
from fleetops.functions import validation as V
from fleetops.functions.patterns import pattern_result
from fleetops.operators import aggregates as A
from fleetops.operators import files as C
from fleetops.operators import graph as G
from fleetops.operators import joins as J
from fleetops.operators import maintain as M
from fleetops.operators import paging as P
from fleetops.operators import windows as W
from fleetops.operators.scans import running


def col(df, name):
    return [r[name] for r in df.collect()]


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_name_ties_go_to_the_later_row(spark):
    df = spark.createDataFrame([("a", "b", "2024-01-01 00:00:00", 1), ("c", "b", "2024-01-01 00:00:00", 2)], "id string, name string, created string, row_seq long")
    assert col(W.latest_by_name(df, "name", ["created", "row_seq"]), "id") == ["c"]
    assert col(W.latest(df, ["name"], ["created", "row_seq"]), "id") == ["c"]


def test_empty_and_interrupted_batches_never_settle(spark):
    batches = spark.createDataFrame([("none", "active", "freeze"), ("cut", "active", "freeze"), ("ok", "blocked", "freeze"), ("bad", "active", "continue_independent")], "id string, status string, policy string")
    jobs = spark.createDataFrame([("cut", "done"), ("cut", "interrupted"), ("ok", "done"), ("ok", "skip"), ("bad", "failed"), ("bad", "running")], "id string, status string")
    nobody = jobs.filter("false")
    out = {r.id: r.verdict for r in A.settle_batches(batches, jobs, nobody, nobody, nobody, "id", "status", "policy").collect()}
    assert out == {"none": "leave", "cut": "leave", "ok": "done", "bad": "leave"}
    out = {r.id: r.verdict for r in A.settle_batches(batches, jobs.filter("status <> 'running'"), nobody, nobody, jobs.filter("id = 'ok'"), "id", "status", "policy").collect()}
    assert out == {"none": "leave", "cut": "leave", "ok": "leave", "bad": "blocked"}
    jobs2 = jobs.selectExpr("id", "status", "0 as s", "150 as e", "cast(null as string) as rev", "monotonically_increasing_id() as n", "status as job")
    event = {r.id: r for r in A.batch_event(jobs2, "id", "status", "s", "e", "rev", "n", "job").collect()}
    assert len(event["cut"].failures) == 1 and event["cut"].minutes == 2  # 2.5 rounds to the even side


def test_null_keys_can_be_deleted(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id long, job string")
    assert sorted(col(J.exempt_delete(df, spark.createDataFrame([("a",), (None,)], "job string"), "job"), "id")) == [2, 3]
    log = spark.createDataFrame([(1, 10, "a"), (2, 20, None), (3, 30, "b"), (4, 40, "a"), (5, 1, None)], "id long, ts long, job string")
    kept = M.prune(log, "ts", ["ts", "id"], 1, 15, spark.createDataFrame([("a",)], "job string"), "job")
    assert sorted(col(kept, "id")) == [1, 4]  # 1 is exempt though too old; the newest one is exempt as well and still takes the place


def test_only_immediate_repeats_collapse(spark):
    df = spark.createDataFrame([("o", i, k) for i, k in enumerate(["a", "a", "b", "a", None, None])], "owner string, seq long, kind string")
    assert sorted(col(W.collapse_repeats(df, "owner", ["seq"], ["kind"]), "seq")) == [0, 2, 3, 4]


def test_json_true_is_not_one(spark):
    for a, b, want in [("1", "1.0", True), ("true", "1", False), ('"1"', "1", False), ("null", "null", True), ("{", "1", None), ('{"a":1}', '{"a":1}', True)]:
        assert one(spark, X.json_equal(F.lit(a), F.lit(b))) is want


def test_freshness_is_two_sided(spark):
    assert [one(spark, V.freshness(F.lit(t), 100, 10)) for t in (95, 101, 80, None)] == ["valid", "future", "stale", "missing"]


def test_sweep_order_and_limit(spark):
    df = spark.createDataFrame([(1, {"seed": ["42", "43"], "lr": ["a"]}), (2, {}), (3, {"x": [str(i) for i in range(200)], "y": [str(i) for i in range(51)]})], "id long, m map<string,array<string>>")
    rows = V.expand_sweep(df, "m").orderBy("id", "combo_no").collect()
    assert [(r.id, r.suffix) for r in rows if r.id == 1] == [(1, "a_42"), (1, "a_43")]
    assert [r.combo for r in rows if r.id == 2] == [{}]
    assert [(r.too_many, r.combo) for r in rows if r.id == 3] == [(True, None)]


def test_producer_never_matches_null_projects_or_itself(spark):
    jobs = spark.createDataFrame([("a", "p", "t", 1, 1, "f1"), ("b", "p", "t", 2, 2, "f2"), ("c", None, "t", 9, 3, "f3")], "id string, project string, task string, finished long, row_seq long, fp string")
    out = {r.id: r.producer for r in J.latest_producer(jobs.select("id", "project", "task"), jobs, "project", "task", "id", "finished", "row_seq", "fp").collect()}
    assert out == {"a": "b", "b": "a", "c": None}


def test_classes_and_excerpts(spark):
    classes = {"Xid 79\nCUDA out of memory": "oom", "torch.OutOfMemoryError: x": "oom", "out of memory": "error", "NVRM: Xid (PCI): 79": "gpu_fault", "an ECC error": "gpu_fault", "xid 1, maXid": "error", "Xidé": "error"}
    classes |= {"PermissionError: x": "perm", "mount: Operation not permitted": "perm", "errno EACCES": "perm", "Permission denied": "error", "": "error", None: "error", "EACCES, ECC": "gpu_fault"}
    rows = spark.createDataFrame(list(classes.items()), "log string, want string").select(V.log_classify(F.col("log")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows)
    assert one(spark, V.log_classify(F.lit("EACCES" + "é" * 10), 20)) == "error" and one(spark, V.log_classify(F.lit("EACCES" + "é" * 10), 26)) == "perm"
    text = F.lit("\n".join(f"line {i}" for i in range(1, 31)))
    assert one(spark, X.log_excerpt(text, "line 10$")).split("\n") == [f"line {i}" for i in range(7, 14)]
    assert one(spark, X.log_excerpt(text, "line 2$")).split("\n") == [f"line {i}" for i in range(1, 6)]
    assert one(spark, X.log_excerpt(text, "none")) is None
    marks = {"Epoch 5/30\nstep 7": "7/?", "epoch 1/5 step 30/100": "1/5", "epoch: 5, loss: 0.12": "5/?", "trial 3/20\nno mark": "3/20", "iteration 4": None, "iter = 4 of 9\r\n": "4/9", "epoch5": None, "STEP#12 / 40\n\n": "12/40", "": None, None: None, "epoch 1/2\n" + "x\n" * 200: None}
    rows = spark.createDataFrame(list(marks.items()), "log string, want string").select(X.progress(F.col("log")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows), [tuple(r) for r in rows]
    env = F.create_map(*[F.lit(x) for x in ("PATH", "a", "ENV", "a", "DYLD_X", "a", "OK", "a\0b", "1x", "a", "_y", "a", "MINE", "a")])
    assert one(spark, F.map_keys(V.refused_env(env))) == ["ENV", "DYLD_X", "OK", "1x"]
    assert one(spark, F.map_keys(V.refused_env(env, [*V.BANNED_ENV, "MINE"]))) == ["ENV", "DYLD_X", "OK", "1x", "MINE"]
    assert one(spark, P.tail_lines(F.lit("a\nb\nc\n"), 2)) == ["b", "c"]


def test_file_codes(spark):
    content = {"small": "1234567890", "bad": "{bad", "deep": '{"a":{}}', "true": '{"a":true}', "num": '{"a":1.0}', "null": '{"a":{"b":null}}', "big": '{"a":1}'}
    files = spark.createDataFrame([(p, (2 << 20) if p == "big" else len(c), c) for p, c in content.items()], "path string, length long, content string")
    rules = [("none", 0, "json", None, None, None, "missing_file"), ("small", 11, None, None, None, None, "too_small"), ("big", 0, "json", None, None, None, "content_too_large"), ("big", 0, None, None, None, None, "passed"), ("bad", 0, "json", None, None, None, "invalid_json"),
             ("deep", 0, None, "a.b", None, None, "missing_json_key"), ("null", 0, None, "a.b", None, None, "passed"), ("true", 0, None, None, {"a": "1"}, None, "json_value_mismatch"), ("num", 0, None, None, {"a": "1"}, None, "passed"), ("small", 0, None, None, None, "[a-z]", "regex_no_match")]
    df = spark.createDataFrame(rules, "path string, min_bytes long, check string, has_key string, json_equals map<string,string>, regex string, want string")
    assert all(r.code == r.want for r in C.check_files(df, files).collect())


def test_chain_breaks(spark):
    import hashlib

    def log(owner, n, spoil=None):
        prev, out = None, []
        for i in range(1, n + 1):
            body = f"{owner}{i}"
            me = hashlib.sha256(body.encode()).hexdigest()
            out.append((owner, i, me, prev, body))
            prev = me
        if spoil == "gap":
            del out[2]
        if spoil == "digest":
            out[2] = (*out[2][:4], "edited")
        if spoil == "link":
            out[2] = (*out[2][:3], "x", out[2][4])
        return out

    rows = log("ok", 4) + log("gap", 4, "gap") + log("digest", 4, "digest") + log("link", 4, "link")
    df = spark.createDataFrame(rows, "owner string, seq long, id string, prev string, body string")
    got = {r.owner: (r.valid, r.first_break, r.reason) for r in W.verify_chain(df, "owner", "seq", "id", "prev", F.col("body")).collect()}
    assert got == {"ok": (True, None, None), "gap": (False, 4, "gap"), "digest": (False, 3, "digest"), "link": (False, 3, "link")}


@pytest.mark.parametrize("seed", range(3))
def test_streaks_against_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(k, i, rng.random() < 0.6) for k in range(5) for i in range(60)]
    want = []
    for k in range(5):
        run = 0
        for _, i, hit in sorted(r for r in rows if r[0] == k):
            run = run + 1 if hit else 0
            want += [(k, i)] * (run == 3)
    rng.shuffle(rows)
    got = W.streaks(spark.createDataFrame(rows, "k int, i int, hit boolean"), "k", ["i"], F.col("hit"), 3)
    assert sorted((r.k, r.i) for r in got.collect()) == want


def test_cycles(spark):
    chain = [(i, i + 1) for i in range(120)]
    edges = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    assert not G.has_cycle(edges(chain))
    assert sorted((r.src, r.dst) for r in G.cyclic_edges(edges([*chain[:20], (500, 501), (501, 502), (502, 500), (502, 7)])).collect()) == [(500, 501), (501, 502), (502, 500)]
    assert not G.has_cycle(edges([(1, 2)]).filter("false"))


def test_blocking_paths_stop_at_met_nodes(spark):
    edges = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "d"), ("z", "a"), ("y", "b")], "src string, dst string")
    status = spark.createDataFrame([("a", "done"), ("b", "failed"), ("c", "pending"), ("y", "running")], "node string, status string")
    rows = G.blocking_paths(spark.createDataFrame([("d",)], "node string"), edges, status).collect()
    assert sorted((r.source, r.hops, "/".join(r.path)) for r in rows) == [("b", 2, "d/c/b"), ("c", 1, "d/c"), ("y", 3, "d/c/b/y")]
    cut = G.blocking_paths(spark.createDataFrame([("d",)], "node string"), edges, status, depth=1).collect()
    assert [(r.source, r.truncated) for r in cut] == [("c", True)]


def test_lineage_with_long_chains_and_cycles(spark):
    rows = [(i, i - 1 if i else None) for i in range(150)] + [(900, 901), (901, 900), (950, 7777)]
    got = {r.n: (r.root, r.hops) for r in G.lineage_root(spark.createDataFrame(rows, "n long, p long"), "n", "p").collect()}
    assert all(got[i] == (0, i) for i in range(150)) and got[900] == got[901] == (None, None) and got[950] == (950, 0)


def test_cursor_round_trip(spark):
    for parts in (["a/b+c?", 7], ["é" * 5, -1], ["", 0]):
        c = X.encode_cursor([F.lit(p) for p in parts])
        back = one(spark, X.decode_cursor(c, ["string", "bigint"]))
        assert tuple(back) == tuple(parts)
    for bad in ("%%%", "", "a" * 5000, "bm90anNvbg"):
        assert one(spark, X.decode_cursor(F.lit(bad), ["string"])) is None


def test_pages_do_not_overlap(spark):
    df = spark.createDataFrame([(i, i // 3) for i in range(20)], "id long, day long")
    order, seen, cursor = [("day", False), ("id", True)], [], None
    while True:
        page = P.keyset_page(df, order, 6, cursor).orderBy(F.desc("day"), "id").collect()
        mine = [r for r in page if not r.extra]
        seen += [r.id for r in mine]
        if len(page) == len(mine):
            break
        cursor = [mine[-1].day, mine[-1].id]
    assert seen == [r.id for r in df.orderBy(F.desc("day"), "id").collect()]
    with pytest.raises(LookupError):
        P.anchored_page(df, "id", 5, 99, 100)


def test_storage_floors(spark):
    paths = spark.createDataFrame([("r", "f", "control", 100, False, 20), ("r", "f", "task", 100, False, 20), ("r", "g", "control", 4, False, 20), ("s", None, "task", None, False, 1), ("t", "f", "task", 500, True, 1)], "request string, filesystem string, role string, available long, readonly boolean, wanted long")
    used = spark.createDataFrame([("f", 30)], "filesystem string, bytes long")
    got = {(r.request, r.filesystem): (r.needed, r.reasons, r.unknowns, r.allowed) for r in A.storage_check(paths, used, 5, 10).collect()}
    assert got["r", "f"] == (60, [], [], True) and got["r", "g"] == (5, ["disk_space"], [], False)
    assert got["s", None][3] is None and got["t", "f"][1] == ["read_only"]


def test_digest_counts_duplicates_not_order(spark):
    rows = [(i % 7, str(i % 3)) for i in range(50)]
    d = lambda r: A.multiset_digest(spark.createDataFrame(r, "a long, b string"), ["a", "b"]).first()
    assert d(rows) == d(rows[::-1]) and d(rows) != d(rows[1:]) and d(rows) != d([(9, "9"), *rows[1:]])

    def plain(rows):
        lanes = [0] * 8
        for a, b in rows:
            h = "".join(hashlib.sha256(f'{k}|{{"a":{a},"b":"{b}"}}'.encode()).hexdigest() for k in range(2))
            lanes = [(x + int(h[16 * k : 16 * k + 16], 16)) % (1 << 64) for k, x in enumerate(lanes)]
        return "".join(f"{x:016x}" for x in lanes)

    assert tuple(d(rows)) == (50, plain(rows)) and tuple(d(rows[:0])) == (0, "0" * 128)
    more = [(5, "x"), (5, "x")]
    both = spark.createDataFrame([(d(rows).digest, d(more).digest)], "a string, b string")
    assert both.select(A.digest_sum(F.col("a"), F.col("b"))).first()[0] == d(rows + more).digest
    assert both.select(A.digest_sum(A.digest_sum(F.col("a"), F.col("b")), F.col("b"), take=True)).first()[0] == d(rows).digest


def test_specs_of_a_hot_project_go_to_many_files(spark, tmp_path):
    from fleetops.plans.io_plans import write_specs

    write_specs(spark.range(5000).selectExpr("'hot' as project", "cast(id as string) as name"), str(tmp_path / "specs"), 100)
    sizes = [r.n for r in spark.read.text(str(tmp_path / "specs"), wholetext=True).selectExpr("json_array_length(value) as n").collect()]
    assert len(sizes) == 50 and sum(sizes) == 5000 and max(sizes) < 200


def test_values_of_templates_are_not_resolved_again(spark):
    names = spark.createDataFrame([("A", "[{B}]"), ("B", "[{A}]"), ("E", ""), ("N", None)], "name string, value string")
    texts = [(1, "{B} {A}", "[{A}] [{B}]", []), (2, "{B}{B}x{{A}}{none}", "[{A}][{A}]x{[{B}]}{none}", ["none"]), (3, None, None, []), (4, "", "", []), (5, "{E}{N}{}", "{N}{}", ["N"]), (6, "a{E}", "a", []), (7, "$1 \\ {A}", "$1 \\ [{B}]", [])]
    df = spark.createDataFrame(texts, "id int, text string, want string, names array<string>")
    for r in V.resolve_templates(df, "text", names, "id").collect():
        assert (r.resolved, r.unresolved) == (r.want, r.names)


def test_patterns_are_refused_or_stopped(spark):
    slow = "a" * 31
    cases = [("(unclosed", "x", "invalid_regex", None), ("", "x", "invalid_regex", None), ("a\0", "a", "invalid_regex", None), ("a" * 4097, "a", "invalid_regex", None), ("(a+)+$", "a" * 4095 + "!", "regex_timeout", None),
             (r"\d+", "1 22 333 x", "passed", "333"), ("x", "y", "regex_no_match", None), ("x", None, "regex_no_match", None), ("(", None, "invalid_regex", None), (None, "x", None, None), ("b*", "ab", "passed", ""), ("(?s).+", "z" * 500, "passed", "z" * 120)]
    df = spark.createDataFrame(cases, "pattern string, text string, reason string, match string").coalesce(1)
    began = time.monotonic()
    for r in df.withColumn("got", pattern_result(F.col("text"), F.col("pattern"))).collect():
        assert (r.got and r.got.reason, r.got and r.got.match) == (r.reason, r.match), r.pattern
    assert time.monotonic() - began < 20
    rules = df.select(F.lit("f").alias("path"), F.lit(0).alias("min_bytes"), F.lit(None).cast("string").alias("check"), F.lit(None).cast("string").alias("has_key"), F.lit(None).cast("map<string,string>").alias("json_equals"), F.col("pattern").alias("regex"))
    files = spark.createDataFrame([("f", 32, slow + "!")], "path string, length long, content string")
    codes = Counter(r.code for r in C.check_files(rules, files).collect())
    assert codes["invalid_regex"] == 5 and codes["passed"] == 3 and codes.total() == 12


def test_running_values_of_a_hot_owner(spark):
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), i, rng.choice([None, 1, 2, 5])) for i in range(3000)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "owner string, i int, v int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running(df, ["owner"], ["i"], sums={"s": F.col("v"), "n": F.lit(1)}, maxima={"m": F.col("v"), "first": F.struct((-F.col("i")).alias("x"))}, before={"was": F.col("v"), "at": F.col("i")})
        placed = df.repartitionByRange("owner", "i").groupBy(F.spark_partition_id()).count().collect()
        found = got.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(placed) == 4 and max(r["count"] for r in placed) < 3000 / 4 * 1.3  # half of the rows are the hot owner's
    want = {}
    for owner in {r[0] for r in rows}:
        s, m, was, at, n = 0, None, None, None, 0
        for _, i, v in (r for r in rows if r[0] == owner):
            s, m, n = s + (v or 0), m if v is None else v if m is None else max(m, v), n + 1
            first = i if n == 1 else first
            want[i] = (owner, v, s, n, m, -first, was, at)
            was, at = v, i
    assert {r.i: (r.owner, r.v, r.s, r.n, r.m, r["first"].x, r.was, r.at) for r in found} == want


def strongly_connected(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    for _ in nodes:
        reach = {n: r | {y for x in r for y in reach[x]} for n, r in reach.items()}
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if n in reach[n]}


def test_components_and_cycles(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(36)] + [(100 + i, 100 + (i + 1) % 20) for i in range(20)] + [(119, 150), (150, 151), (151, 152), (152, 151), (160, 160), (160, 161)]
    df = spark.createDataFrame([*edges, (None, 3), (3, None), edges[0]], "src long, dst long")
    want = strongly_connected(set(edges))
    assert {r.node: r.component for r in G.components(df).collect()} == want
    shown = {}
    for r in G.cycles(df).collect():
        shown.setdefault(r.component, {})[r.place] = r.node
    assert set(shown) == set(want.values())
    for component, places in shown.items():
        way = [places[k] for k in range(len(places))]
        assert way[0] == min(way) and len(set(way)) == len(way) and all(want[x] == component for x in way)
        assert all(e in edges for e in zip(way, way[1:] + way[:1]))


def test_no_cycles(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src long, dst long")
    assert G.components(df).count() == 0 and G.cycles(df).count() == 0


def test_retention_of_a_hot_group(spark):
    rng = random.Random(12)
    rows = [(i, "hot" if rng.random() < 0.5 else rng.choice(["a", None]), rng.choice([None, *range(100)])) for i in range(1500)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "id int, g string, at int")
    kept = W.keep_last_ttl(df, "at", ["at", "id"], 7, 60, df.filter("id % 100 = 3"), "id", ["g"])
    points = W.snapshot_retention(df, "at", "id", 90 * 86400, 90, 4, ["g"])
    want, newest = set(), {}
    for g in ("hot", "a", None):
        young = sorted(((t, i) for i, h, t in rows if h == g and t is not None and t >= 60), reverse=True)
        want |= {i for _, i in young[:7]}
        newest[g] = {i for _, i in sorted(((-1 if t is None else t, i) for i, h, t in rows if h == g), reverse=True)[:4]}
    want |= {i for i, _, _ in rows if i % 100 == 3}
    assert {r.id for r in kept.filter("keep").collect()} == want and kept.count() == points.count() == 1500
    for r in points.collect():
        reasons = ["not_closed"] if r["at"] is None else (["retention_period_not_elapsed"] if r["at"] > 0 else []) + (["retained_by_keep_last"] if r.id in newest[r.g] else [])
        assert (r.reasons, r.eligible) == (reasons, not reasons)
    for out in (kept, points):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "WindowGroupLimit" in plan and plan.count("Window [") == 1
