"""Rules of `folds` over tables (replay) and over streams (watch); both give the same rows for rows in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetops.functions.validation import freshness
from fleetops.streaming.folds import Rule, passed


def _plain(v: object) -> object:
    return None if v is None or v != v else v.item() if hasattr(v, "item") else v


def _rows(pdf: pd.DataFrame, names: list[str]) -> Iterator[tuple]:
    return (tuple(_plain(v) for v in row) for row in zip(*(pdf[c].tolist() for c in names), strict=True))


def _narrow(df: DataFrame, key: str, at: str, seq: str, rule: Rule) -> DataFrame:
    return df.select(F.col(key).alias("_key"), F.col(at).cast("long").alias("_at"), F.col(seq).cast("long").alias("_seq"), *[F.col(c).alias(f"_f{i}") for i, c in enumerate(rule.fields)])


def replay(df: DataFrame, rule: Rule, key: str, at: str, seq: str, now: int | None = None) -> DataFrame:
    """Fold each key's rows in order of (at, seq). Rows are dealt by key and sorted, and the state is carried from batch
    to batch, so no key's rows are held together. Output: key, then the rule's columns.

    now: the time up to which a key's silence after its last row counts; null: not at all."""
    narrow = _narrow(df, key, at, seq, rule)
    kind = narrow.schema["_key"].dataType.simpleString()
    names = ["_key", "_at", "_seq", *[f"_f{i}" for i in range(len(rule.fields))]]
    columns = ["_key", *[c.split()[0] for c in rule.out.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for batch in batches:
            told = []
            for k, when, _, *row in _rows(batch, names):
                if last != (k,):
                    told += ended(last, state)
                    last, state = (k,), None
                state, due = passed(rule, state, when)
                state, out = rule.step(state, when, tuple(row))
                told += [(k, *o) for o in due + out]
            yield pd.DataFrame(told, columns=columns)
        yield pd.DataFrame(ended(last, state), columns=columns)

    def ended(last: tuple | None, state: tuple | None) -> list[tuple]:
        return [] if now is None or last is None else [(last[0], *o) for o in passed(rule, state, now)[1]]

    dealt = narrow.repartition("_key").sortWithinPartitions("_key", "_at", "_seq")
    return dealt.mapInPandas(run, f"_key {kind}, {rule.out}").withColumnRenamed("_key", key)


def watch(stream: DataFrame, rule: Rule, key: str, at: str, seq: str, expire: int | None = None, delay: int = 0) -> DataFrame:
    """The same over a stream. A micro-batch's rows of a key are put in order; one older than a row that an earlier
    micro-batch has dealt with comes too late, changes nothing and is told as such (late = true, other columns null).

    Time is the newest `at` less `delay` seconds. A rule about silence sets a timer for each key, which tells once that
    time has passed, whether the key has new rows or not; rows older than that time are left out by Spark. That, too, is
    what `expire` needs: seconds after which the state of a key without new rows goes, so that it doesn't grow with all
    keys ever seen; a key that comes back begins anew. Without it state stays for good. Other rules see all rows."""
    narrow = _narrow(stream, key, at, seq, rule)
    timed = expire is not None or rule.due is not None
    if timed:
        narrow = narrow.withColumn("_time", F.timestamp_seconds("_at")).withWatermark("_time", f"{delay} seconds")
    kind = narrow.schema["_key"].dataType.simpleString()
    names = ["_at", "_seq", *[f"_f{i}" for i in range(len(rule.fields))]]
    columns = [c.split()[0] for c in rule.out.split(", ")]
    blank = (None,) * (len(columns) - 1)

    def run(keys: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, newest, told = None, (-(1 << 62), 0), []
        if held.exists:
            *state, a, s = held.get
            state, newest = tuple(_plain(v) for v in state), (int(a), int(s))
        if not held.hasTimedOut:
            for when, nth, *row in sorted((r for p in parts for r in _rows(p, names)), key=lambda r: r[:2]):
                if (when, nth) < newest:
                    told.append((keys[0], *((when, *blank) if columns[0] == "at" else blank), True))
                    continue
                newest = (when, nth)
                state, due = passed(rule, state, when)
                state, out = rule.step(state, when, tuple(row))
                told += [(keys[0], *o, False) for o in due + out]
        if state is not None:
            ends = []
            if timed:
                watermark = held.getCurrentWatermarkMs()
                gone = -(-watermark // 1000)  # whole seconds before it have passed
                state, due = passed(rule, state, gone if expire is None else min(gone, newest[0] + expire))
                told += [(keys[0], *o, False) for o in due]
                ends = [t for t in (rule.due and rule.due(state), None if expire is None else newest[0] + expire) if t is not None]
            if expire is not None and held.hasTimedOut and (newest[0] + expire) * 1000 < watermark:
                held.remove()
            else:
                held.update((*state, *newest))
                if ends:
                    held.setTimeoutTimestamp(max(min(ends) * 1000, watermark + 1))
        yield pd.DataFrame(told, columns=["_key", *columns, "late"])

    grouped = narrow.groupBy("_key").applyInPandasWithState(run, f"_key {kind}, {rule.out}, late boolean", f"{rule.state}, newest_at long, newest_seq long", "append", GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout)
    return grouped.withColumnRenamed("_key", key)


def refuse_late(df: DataFrame, at: str, arrived: str, most: int) -> DataFrame:
    """Adds `freshness` (valid, stale, future, missing) of each row on arrival. Refused rows stay, for a side output; the
    stream's own watermark may then be as short as `most`."""
    return df.withColumn("freshness", freshness(F.col(at), F.col(arrived), most))


def unexpired(df: DataFrame, at: str, now: int, most: int) -> DataFrame:
    """The observations still in force at trigger time: neither older than `most` nor from the future."""
    return df.filter(freshness(F.col(at), now, most) == "valid")
