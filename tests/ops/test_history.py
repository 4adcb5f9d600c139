"""A stream from a past: the replay of the past and the stream of the rest tell what one replay tells."""

import json
import random

import pytest

from fleetops.streaming import folds, stateful
from fleetops.streaming.history import PROVIDER, resume, states, states_of
from tests.ops.test_streaming import RULES


@pytest.fixture
def rocks(spark):
    spark.conf.set(*PROVIDER)
    yield spark
    spark.conf.unset(PROVIDER[0])


def put(inbox, n, rows):
    inbox.mkdir(exist_ok=True)
    (inbox / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))


def run(spark, inbox, base, schema, history, rule):
    stream = resume(spark.readStream.schema(schema).json(str(inbox)), history, rule, "key", "at", "seq")
    stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def tell(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["cards", "timeouts", "beats", "progress", "probes"])
def test_past_and_stream_are_one_replay(rocks, tmp_path, name):
    spark, (rule, make, fields) = rocks, RULES[name]
    rng, rows, at = random.Random(6), [], 0
    for i in range(200):
        at += rng.randrange(1, 20)
        key = rng.choice("abc") if i else "silent"  # a key that has no row but one, in the past
        rows.append({"key": key, "at": at, "seq": i, **make(rng), **({"kind": "start"} if name == "timeouts" and not i else {})})
    rows.append({"key": "new", "at": at, "seq": 999, **make(rng)})
    schema = "key string, at long, seq long" + (", " + fields if fields else "")
    df = lambda some: spark.createDataFrame(rng.sample(some, len(some)), schema)
    past, rest = rows[:100], rows[100:]
    whole = tell(stateful.replay(df(rows), rule, "key", "at", "seq", now=at if rule.due else None))
    before = tell(stateful.replay(df(past), rule, "key", "at", "seq"))
    history = states(df(past), rule, "key", "at", "seq")
    assert {r.key: (r.newest_at, r.newest_seq) for r in history.collect()} == {r["key"]: (r["at"], r["seq"]) for r in past}
    for n, part in enumerate((rest[:50], rest[50:])):  # the second time from the checkpoint
        put(tmp_path / "in", n, part)
        got = run(spark, tmp_path / "in", str(tmp_path / "out"), schema, history, rule)
    assert got.filter("late").count() == 0
    assert sorted(before + tell(got.drop("late")), key=str) == whole
    if rule.due:
        assert any(r[0] == "silent" for r in whole)
    elif name == "cards":  # what the stream knows now is what a replay of all ends with, and may start another one
        assert tell(states_of(spark, f"{tmp_path}/out/state", "key")) == tell(states(df(rows), rule, "key", "at", "seq"))


def test_rows_older_than_the_past_are_late(rocks, tmp_path):
    rule, schema = folds.latch(1 << 40), "key string, at long, seq long, valid boolean"
    past = rocks.createDataFrame([("a", 100, 1, True)], schema)
    put(tmp_path / "in", 0, [{"key": "a", "at": 50, "seq": 0, "valid": False}, {"key": "a", "at": 150, "seq": 2, "valid": False}])
    got = run(rocks, tmp_path / "in", str(tmp_path / "out"), schema, states(past, rule, "key", "at", "seq"), rule)
    assert sorted((r.at, r.valid, r.late) for r in got.collect()) == [(50, None, True), (150, False, False)]
    assert states(past.limit(0), rule, "key", "at", "seq").collect() == []
