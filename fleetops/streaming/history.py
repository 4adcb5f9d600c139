"""Streams that go on from a past: the states that a replay of a table ends with are what the stream's keys begin with.

Needs Spark's RocksDB state store (`PROVIDER`) and, for its Python workers, protobuf.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetops.streaming.folds import Rule, passed
from fleetops.streaming.stateful import _narrow, _plain, _rows

#: The setting that `resume` needs, and its value.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def states(df: DataFrame, rule: Rule, key: str, at: str, seq: str) -> DataFrame:
    """Each key's state after its last row: key, the state's columns, newest_at, newest_seq. As in `replay`, rows are dealt by
    key, sorted and gone through in batches. What falls due after the last row is left to the stream."""
    narrow = _narrow(df, key, at, seq, rule)
    kind = narrow.schema["_key"].dataType.simpleString()
    names = ["_key", "_at", "_seq", *[f"_f{i}" for i in range(len(rule.fields))]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, newest = None, None, ()
        for batch in batches:
            done = []
            for k, when, nth, *row in _rows(batch, names):
                if last != (k,):
                    done += [(*last, *state, *newest)] if last else []
                    last, state = (k,), None
                state = rule.step(passed(rule, state, when)[0], when, tuple(row))[0]
                newest = (when, nth)
            yield pd.DataFrame(done, columns=columns)
        yield pd.DataFrame([(*last, *state, *newest)] if last else [], columns=columns)

    fields = [f.strip() for f in _held(rule).split(",")]
    columns = ["_key", *[f.split()[0] for f in fields]]
    dealt = narrow.repartition("_key").sortWithinPartitions("_key", "_at", "_seq")
    return dealt.mapInPandas(run, f"_key {kind}, {', '.join(fields)}").withColumnRenamed("_key", key)


def states_of(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """The same of a stream by `resume`, from its checkpoint: what another stream may begin with."""
    read = spark.read.format("statestore").option("stateVarName", "state").load(checkpoint)
    return read.select(F.col("key._key").alias(key), "value.*").drop("timer")


def resume(stream: DataFrame, history: DataFrame, rule: Rule, key: str, at: str, seq: str, delay: int = 0) -> DataFrame:
    """`watch` with keys that begin with the states of `history` (by `states` or `states_of`): the past's replay and this
    stream together tell what one replay of all rows tells. A key of the past that stays silent tells, too, once the
    watermark has passed its time. Rows older than the newest of their key's past are told as late. History is read when
    the stream first starts; a restart goes on from the checkpoint."""
    narrow = _narrow(stream, key, at, seq, rule)
    timed = rule.due is not None
    if timed:
        narrow = narrow.withColumn("_time", F.timestamp_seconds("_at")).withWatermark("_time", f"{delay} seconds")
    kind = narrow.schema["_key"].dataType.simpleString()
    begin = history.select(F.col(key).alias("_key"), *[f.split()[0] for f in _held(rule).split(", ")]).groupBy("_key")
    out = f"_key {kind}, {rule.out}, late boolean"
    return narrow.groupBy("_key").transformWithStateInPandas(Follow(rule), out, "Append", "EventTime" if timed else "None", begin).withColumnRenamed("_key", key)


def _held(rule: Rule) -> str:
    return f"{rule.state}, newest_at long, newest_seq long"


class Follow(StatefulProcessor):
    """A key's state, when its newest row came, and the one timer that it waits for."""

    def __init__(self, rule: Rule):
        self.rule = rule
        self.names = ["_at", "_seq", *[f"_f{i}" for i in range(len(rule.fields))]]
        self.columns = [c.split()[0] for c in rule.out.split(", ")]
        self.state_columns = [f.split()[0] for f in _held(rule).split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", f"{_held(self.rule)}, timer long")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        for row in self.named(initialState, self.state_columns):
            self.keep(row[:-2], row[-2:], None, -1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        state, newest, timer = self.known()
        blank, told = (None,) * (len(self.columns) - 1), []
        for when, nth, *row in sorted((r for p in rows if len(p) for r in self.named(p, self.names)), key=lambda r: r[:2]):
            if (when, nth) < newest:
                told.append((key[0], *((when, *blank) if self.columns[0] == "at" else (None, *blank)), True))
                continue
            newest = (when, nth)
            state, due = passed(self.rule, state, when)
            state, out = self.rule.step(state, when, tuple(row))
            told += [(key[0], *o, False) for o in due + out]
        watermark = timerValues.getCurrentWatermarkInMs() if self.rule.due else -1
        yield self.end(key, state, newest, timer, watermark, told)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        state, newest, _ = self.known()
        yield self.end(key, state, newest, None, timerValues.getCurrentWatermarkInMs(), [])

    @staticmethod
    def named(frame: pd.DataFrame, names: list[str]) -> Iterator[tuple]:
        """Its rows; columns go by their places, the key's first, as Spark gives other names beside an initial state."""
        return _rows(frame.iloc[:, 1 : 1 + len(names)].set_axis(names, axis=1), names)

    def known(self) -> tuple:
        if not self.value.exists():
            return None, (-(1 << 62), 0), None
        *state, when, nth, timer = (_plain(v) for v in self.value.get())
        return tuple(state), (int(when), int(nth)), timer

    def end(self, key: tuple, state: tuple | None, newest: tuple, timer: int | None, watermark: int, told: list[tuple]) -> pd.DataFrame:
        if state is not None:
            state, due = passed(self.rule, state, -(-watermark // 1000))  # whole seconds before it have passed
            self.keep(state, newest, timer, watermark)
            told = told + [(key[0], *o, False) for o in due]
        return pd.DataFrame(told, columns=["_key", *self.columns, "late"])

    def keep(self, state: tuple, newest: tuple, timer: int | None, watermark: int) -> None:
        at = self.rule.due(state) if self.rule.due else None
        at = None if at is None else max(at * 1000, watermark + 1, 0)
        if timer is not None and timer != at:
            self.handle.deleteTimer(int(timer))
        if at is not None and timer != at:
            self.handle.registerTimer(at)
        self.value.update((*state, *newest, at))
