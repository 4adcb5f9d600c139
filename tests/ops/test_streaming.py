import json
import random

import pytest
from pyspark.sql import functions as F

from fleetops.operators import windows as W
from fleetops.operators.card_state import CardState, advance
from fleetops.sources import tables as S
from fleetops.streaming import folds, jobs, stateful
from fleetops.streaming.automaton import Marks

RULES = {
    "cards": (folds.card_state(), lambda r: {"sample": r.choice(["clean", "clean", "util", "pid", "failed"])}, "sample string"),
    "freeze": (folds.freeze(), lambda r: {"used": r.choice([1, 85, 86, 99, None]), "capacity": 100}, "used long, capacity long"),
    "timeouts": (folds.timeouts(), lambda r: {"kind": r.choice(["start", "end", "alive", "alive"]), "limit": 40}, "kind string, limit long"),
    "beats": (folds.heartbeat_gap(20, 60), lambda r: {}, ""),
    "progress": (folds.no_progress(30, 2), lambda r: {"digest": r.choice(["a", "a", "a", "b", None])}, "digest string"),
    "inbox": (folds.inbox(), lambda r: {"binding": r.choice("ab")}, "binding string"),
    "probes": (folds.log_probes(["abba", "b\nb"], ["aab\nc"]), lambda r: {"text": "".join(r.choice("abc\n\r") for _ in range(2)), "start": None}, "text string, start long"),
    "latch": (folds.latch(50), lambda r: {"valid": r.random() < 0.9}, "valid boolean"),
}


def late_ends(rows, now):
    for k, r in enumerate(rows):
        if r["kind"] == "start":
            end = next((x["at"] for x in rows[k + 1 :] if x["kind"] != "alive"), now)
            if end > r["at"] + 40:
                yield r["at"] + 40, 40


def gaps(rows, now):
    told = -1000
    for r, x in zip(rows, [*rows[1:], {"at": now}]):
        for second in range(r["at"] + 20, x["at"]):
            if second - told >= 60:
                told = second
                yield second, second - r["at"]


def stalls(rows, now):
    was = None
    for k, r in enumerate(rows):
        if (r["digest"] or "") == was:
            continue
        was = r["digest"] or ""
        end = next((x["at"] for x in rows[k:] if (x["digest"] or "") != was), now)
        yield from ((r["at"] + 30 * n, 30 * n, n) for n in (1, 2) if r["at"] + 30 * n < end)


BY_DEFINITION = {"timeouts": late_ends, "beats": gaps, "progress": stalls}


@pytest.mark.parametrize("name", RULES)
def test_stream_equals_replay_equals_loop(spark, tmp_path, name):
    rule, make, fields = RULES[name]
    rng = random.Random(4)
    rows, at = [], 0
    for i in range(240):
        at += rng.randrange(0, 25)
        rows.append({"key": rng.choice("abc"), "at": at, "seq": i, **make(rng)})
    want = []
    rows += [{"key": k, "at": a, "seq": 300 + a, **make(rng)} for k, a in (("dead", 5), ("d", at), ("a", at + 30))]
    rows = sorted(rows, key=lambda r: r["at"])
    now = rows[-1]["at"]
    for key in ("a", "b", "c", "d", "dead"):
        own = [r for r in rows if r["key"] == key]
        if rule.due:
            want += [(key, *o) for o in BY_DEFINITION[name](own, now)]
            continue
        state = None
        for r in own:
            state, out = rule.step(state, r["at"], tuple(r[f] for f in rule.fields))
            want += [(key, *o) for o in out]
    schema = "key string, at long, seq long" + (", " + fields if fields else "")
    tell = lambda df: sorted(tuple(r) for r in df.collect())
    shuffled = rng.sample(rows, len(rows))
    assert tell(stateful.replay(spark.createDataFrame(shuffled, schema), rule, "key", "at", "seq", now=now)) == sorted(want)
    if rule.due:  # without a time to look back from, silence after the last row tells nothing
        assert len(tell(stateful.replay(spark.createDataFrame(shuffled, schema), rule, "key", "at", "seq"))) < len(want)

    inbox, base = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    got = []
    for n in range(3):  # three arrivals, each by a new run of the same stream: it goes on from its checkpoint
        part = rows[n * 81 : (n + 1) * 81]
        (inbox / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rng.sample(part, len(part))))
        watched = stateful.watch(spark.readStream.schema(schema).json(str(inbox)), rule, "key", "at", "seq")
        watched.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{base}/rows")
    assert got.filter("late").count() == 0 and tell(got.drop("late")) == sorted(want)


def test_late_rows_are_told_and_change_nothing(spark, tmp_path):
    rule, schema = folds.latch(1 << 40), "key string, at long, seq long, valid boolean"
    inbox, base = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    for n, part in enumerate([[("a", 100, 1, True)], [("a", 50, 0, False), ("a", 150, 2, True)]]):
        (inbox / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("key", "at", "seq", "valid"), r))) for r in part))
        stateful.watch(spark.readStream.schema(schema).json(str(inbox)), rule, "key", "at", "seq").writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    rows = sorted((r.at, r.valid, r.late) for r in spark.read.parquet(f"{base}/rows").collect())
    assert [(a, late) for a, _, late in rows] == [(50, True), (100, False)]


def test_state_expires(spark, tmp_path):
    """A key that is silent for 100 s is forgotten once the watermark has passed; one that goes on isn't."""
    rule, schema = folds.inbox(), "key string, at long, seq long, binding string"
    inbox, base = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    parts = [[("a", 1000, 1, "x"), ("b", 1000, 2, "x")], [("b", 1090, 3, "x")], [("c", 1150, 4, "x")], [("c", 1160, 5, "x")], [("a", 1170, 6, "y"), ("b", 1170, 7, "y")]]
    for n, part in enumerate(parts):
        (inbox / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("key", "at", "seq", "binding"), r))) for r in part))
        stream = stateful.watch(spark.readStream.schema(schema).json(str(inbox)), rule, "key", "at", "seq", expire=100, delay=10)
        stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    got = {(r.key, r.at): r.outcome for r in spark.read.parquet(f"{base}/rows").collect()}
    assert got == {("a", 1000): "accepted", ("b", 1000): "accepted", ("b", 1090): "replay", ("c", 1150): "accepted", ("c", 1160): "replay", ("a", 1170): "accepted", ("b", 1170): "conflict"}


def test_notifications_by_day(spark, tmp_path):
    at = str(tmp_path / "notes")
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", None)], "event_id string, day int")
    for some in (rows.filter("day = 1"), rows, rows):
        S.write_notifications(some, at, by="day")
    assert sorted(r.event_id for r in S.spark_optional(spark, at, "event_id string").collect()) == ["a", "b", "c", "d"]


def test_lines_of_a_split_log(spark, tmp_path):
    (tmp_path / "logs" / "b").mkdir(parents=True)
    (tmp_path / "logs" / "b" / "t-v2.log").write_text("".join(f"line {i}\n" for i in range(1, 20001)))
    (tmp_path / "logs" / "b" / "u-v1.log").write_text("")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        rows = S.read_logs(spark, str(tmp_path / "logs"))
        got = sorted((r.line_no, r.text) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i, f"line {i}") for i in range(1, 20001)]


def test_card_state_table():
    def walk(samples):
        card, out = CardState(), []
        for s in samples:
            card, usable = advance(card, s)
            out.append((card.state, usable))
        return out

    assert walk(["util", "clean", "util", "util", "util"]) == [("free", False), ("free", True), ("free", False), ("free", False), ("unmanaged", False)]
    assert walk(["pid", "clean", "clean"]) == [("unmanaged", False), ("unmanaged", False), ("free", True)]
    assert walk(["failed"] * 5 + ["clean"] * 3)[4:] == [("quarantined", False)] * 4
    assert walk(["failed"] * 4 + ["clean"] + ["failed"] * 4)[-1][0] == "free"
    assert walk([None])[0] == ("unmanaged", False)


def test_replayed_cards(spark):
    rng = random.Random(9)
    rows = [(c, i, rng.choice(["clean", "util", "pid", "failed"])) for c in range(6) for i in range(80)]
    got = {(r.c, r.i): (r.state, r.dispatchable) for r in W.card_states(spark.createDataFrame(rng.sample(rows, len(rows)), "c int, i int, s string"), "c", ["i"], "s").collect()}
    for c in range(6):
        card = CardState()
        for _, i, s in (r for r in rows if r[0] == c):
            card, usable = advance(card, s)
            assert got[c, i] == (card.state, usable)


def test_inbox_logs_and_notifications(spark, tmp_path):
    (tmp_path / "submit-1.json").write_text('{"request_id":"1","binding":"x"}')
    (tmp_path / "other.json").write_text('{"request_id":"2"}')
    assert [r.request_id for r in jobs.drain(S.stream_inbox(spark, str(tmp_path)), "t").collect()] == ["1"]
    logs = tmp_path / "logs" / "b1"
    logs.mkdir(parents=True)
    (logs / "train-v3.log").write_text("one\ntwo\n")
    rows = S.read_logs(spark, str(tmp_path / "logs")).orderBy("line_no").collect()
    assert [(r.batch, r.task, r.version, r.line_no, r.text) for r in rows] == [("b1", "train", 3, 1, "one"), ("b1", "train", 3, 2, "two")]
    notes = tmp_path / "notes"
    notes.mkdir()
    for name, text in (("a.json", '{"a":1}'), ("b.json", "{torn"), ("c.json.acked", '{"a":2}')):
        (notes / name).write_text(text)
    assert sorted((r.error or "", r.acked) for r in S.read_notifications(spark, str(notes)).collect()) == [("", False), ("unreadable", False)]
    assert S.read_notifications(spark, str(notes), acked=True).count() == 3


def test_corrupt_specs_and_optional_tables(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name":"n","tasks":[{"id":"t"}]}')
    (tmp_path / "b.json").write_text("{torn")
    rows = S.read_batch_specs(spark, str(tmp_path)).collect()
    assert sorted((r.name or "", r._corrupt is None) for r in rows) == [("", False), ("n", True)]
    assert S.read_optional(spark, str(tmp_path / "no"), "jobs").count() == 0
    assert spark.range(1).select(S.normal_pci(F.lit("0000:3B:00.0")).alias("x")).first().x == "00000000:3b:00.0"


@pytest.mark.parametrize("expire", [None, 500])
def test_a_silent_key_tells(spark, tmp_path, expire):
    """An owner that falls silent tells when the watermark passes its limit, over restarts, though it has no new rows."""
    rule, schema = folds.heartbeat_gap(90, 600), "key string, at long, seq long"
    inbox, base = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    seen = []
    for n, part in enumerate([[("dead", 30, 0), ("live", 30, 1)], [("live", 100, 2)], [("live", 125, 3)], [("live", 214, 4)], [("live", 300, 5), ("live", 380, 6)], [("live", 800, 7)]]):
        (inbox / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("key", "at", "seq"), r))) for r in part))
        stateful.watch(spark.readStream.schema(schema).json(str(inbox)), rule, "key", "at", "seq", expire=expire, delay=1).writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
        seen.append(sorted((r.key, r.at, r.gap) for r in spark.read.parquet(f"{base}/rows").collect()))
    # at 125 less a second the limit of the dead one, 120, has passed
    assert seen[:3] == [[], [], [("dead", 120, 90)]] and seen[4] == seen[3] == seen[2]
    told_again = [("dead", 720, 690)] if expire is None else []  # an expired key tells no more
    assert seen[5] == sorted([("dead", 120, 90), ("live", 470, 90), *told_again])


@pytest.mark.parametrize("seed", range(40))
def test_marks_in_pieces_of_a_log(seed):
    """Against a look at the whole log, or what is left of it, after each piece."""
    rng = random.Random(seed)
    failed, ready = ["abab", "b\nb", "ccc"], ["ab\na", "bca", "a\n\nb"]
    rule = folds.log_probes(failed, ready)
    state, log, end, got, want = None, "", 0, [], []
    for at in range(60):
        piece = "".join(rng.choice(["a", "b", "c", "\r", "\n", "é"]) for _ in range(rng.randint(0, 3)))
        start = rng.choice([None] * 12 + [end, 0, end + 5])
        if start is not None and start != end:
            log, end = "", start
        log, end = log + piece, end + len(piece.encode())
        state, out = rule.step(state, at, (piece, start))
        got += out
        lines = log.replace("\r\n", "\n").replace("\r", "\n")
        hit = "failed" if any(p in lines for p in failed) else "ready" if any(p in lines for p in ready) else None
        if hit and not want:
            want = [(at, hit)]
    assert got == want


def test_patterns_inside_patterns():
    marks = Marks({"he": "1", "she": "2", "hers": "3", "his": "4"})
    assert marks.feed(0, "ushers")[1] == {"1", "2", "3"} and marks.feed(0, "shis")[1] == {"4"}
    node, found = marks.feed(0, "xsh")
    assert not found and marks.feed(node, "e")[1] == {"1", "2"}
    with pytest.raises(ValueError, match="empty"):
        Marks({"": "x"})


def test_a_hot_card_is_gone_through_by_ranges(spark):
    rng = random.Random(10)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", "", None]), i, rng.choice(["clean", "util", "pid", "failed", "failed", None] if i > 2000 else ["clean", "util", "failed"])) for i in range(4000)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "c string, i int, s string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        states = W.card_states(df, "c", ["i"], "s")
        parts = [r["count"] for r in states.groupBy(F.spark_partition_id()).count().collect()]
        got = {r.i: (r.c, r.state, r.dispatchable) for r in states.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and max(parts) < 4000 / 4 * 1.3  # half of the rows are the hot card's
    want, cards = {}, {}
    for c, i, s in rows:
        cards[c], usable = advance(cards.get(c, CardState()), s)
        want[i] = (c, cards[c].state, usable)
    assert got == want and len({w[1] for w in want.values()}) == 3
    assert W.card_states(df.limit(0), "c", ["i"], "s").collect() == []
