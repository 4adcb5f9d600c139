"""Exact removal of repeated byte strings by prefix-free parsing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fleetops.llm.common import cut, pack, saved, unpack

#: Bytes of the rolling hash that sets triggers.
GRAM = 32
#: Windows worked on at once; longer texts are parsed in runs of so many, which costs a phrase cut in two each time.
RUN = 1 << 20
#: Bits of a place in a lot. The same number always, so that the same hashes are compared wherever a window lies.
PLACE = 21
#: A trigger with more phrases than this is resolved by rows in a shuffle, not in one task's memory. The result is the same.
CROWD = 5_000
#: Triggers with a share of the phrases of more than 1/LISTED (so there are no more of them) are found in one text of
#: SAMPLE, where they must occur HOT_LEAST times, and dealt by phrase from the start. The result is the same.
SAMPLE, LISTED, HOT_LEAST = 64, 5000, 8

BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolling(data: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """A 64-bit hash of the `width` bytes that start at each place, from one running sum of bytes times powers."""
    up = powers(base, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    back = powers(np.uint64(pow(int(base), -1, 1 << 64)), len(data) - width + 1)
    return mixed((sums[width:] - sums[: len(sums) - width]) * back)


def phrases(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The parse of the texts that lie in data one after another.

    A window is a place with `length` bytes of its text from there on. Its trigger is the place in it with the least
    rolling hash of GRAM bytes, the first if several: equal windows have it at equal distance, so the trigger cuts
    texts at the same places wherever they repeat. A phrase is all windows in a row with one trigger; it spans their
    bytes. Result by phrase: text (index), lo (first window), n (windows), d (places from lo to the trigger), trigger
    (hash), name (128 bits of hash of the bytes and the trigger's place in them).
    """
    n = len(data)
    least = rolling(data, GRAM, BASES[0]) if n >= length else np.zeros(0, np.uint64)
    bits = np.uint64(PLACE)
    place = np.arange(len(least), dtype=np.uint64)
    gram = least
    least = (least >> bits << bits) | place
    span, done = length - GRAM + 1, 1
    while done < span:  # least of the first `done` places from each place on, done doubling
        step = min(done, span - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    fits = np.zeros(n + 1, np.int32)
    has = sizes >= length
    np.add.at(fits, starts[has], 1)
    np.add.at(fits, (starts + sizes - length + 1)[has], -1)
    at = np.flatnonzero(np.cumsum(fits[:n]))
    if not len(at):
        none = np.zeros(0, np.int64)
        return {"text": none, "lo": none, "n": none, "d": none, "trigger": none, "name": none.reshape(0, 2)}
    trigger = (least[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (at[1:] != at[:-1] + 1)]))
    lo, count = at[new], np.diff(np.append(new, len(at)))
    text = np.searchsorted(starts, lo, "right") - 1
    raw, digest = data.tobytes(), xxhash.xxh3_128_digest
    ends = lo + count + length - 1
    d = trigger[new] - lo
    name = b"".join([digest(raw[a:b], s) for a, b, s in zip(lo.tolist(), ends.tolist(), d.tolist(), strict=True)])
    return {"text": text, "lo": lo - starts[text], "n": count, "d": d, "trigger": gram[trigger[new]].view(np.int64), "name": np.frombuffer(name, np.int64).reshape(-1, 2)}


def columns_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where each value begins and the last one ends."""
    column = batch.column(name)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def runs(at: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """(text, first byte in it, bytes) in lots of about RUN windows; a longer text comes in pieces that overlap."""
    lot, total = [], 0
    for t, size in enumerate(np.diff(at).tolist()):
        for lo in range(0, max(0, size - length + 1), RUN):
            part = min(RUN + length - 1, size - lo)
            if total and total + part > RUN + length:
                yield lot
                lot, total = [], 0
            lot.append((t, lo, part))
            total += part
    if lot:
        yield lot


PARSED = pa.schema(
    [("t", pa.int64()), ("u", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("d", pa.int32()), ("g", pa.int64()), ("e", pa.int64()), ("f", pa.int64()), ("c", pa.int32()), ("hot", pa.bool_()), ("x", pa.int64())]
)


def parser(length: int, hot: Broadcast | None = None):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per phrase: text, first window, number of windows, distance of the trigger, trigger, name. Of equal
        phrases in a lot one counts for two (c), the others are settled (c = 0); these and the phrases of hot triggers
        (x) go on under a trigger of their own, so that neither a text in many copies nor a common passage meets in one
        task."""
        known = hot.value if hot is not None else np.zeros(0, np.int64)
        for batch in batches:
            data, at = columns_of(batch, "bytes")
            t, u = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "u"))
            for lot in runs(at, length):
                which, low, sizes = (np.array(x, np.int64) for x in zip(*lot, strict=True))
                joined = np.concatenate([data[at[k] + a : at[k] + a + s] for k, a, s in lot])
                p = phrases(joined, np.cumsum(sizes) - sizes, sizes, length)
                _, first, counts = np.unique(p["name"], axis=0, return_index=True, return_counts=True) if len(p["lo"]) else (None, np.zeros(0, np.int64), 0)
                c = np.zeros(len(p["lo"]), np.int32)
                c[first] = np.minimum(counts, 2)
                own = mixed(p["name"][:, 0].view(np.uint64) + mixed(t[which[p["text"]]].view(np.uint64)) + p["lo"].astype(np.uint64) * BASES[1])
                is_hot = np.isin(p["trigger"], known) & (c > 0)
                g = np.where((c > 0) & ~is_hot, p["trigger"], own.view(np.int64))
                k = which[p["text"]]
                columns = (t[k], u[k], p["lo"] + low[p["text"]], p["n"].astype(np.int32), p["d"].astype(np.int32), g, p["name"][:, 0], p["name"][:, 1], c, is_hot, np.where(is_hot, p["trigger"], 0))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=PARSED)

    return parse


CONTEXT = pa.schema([("g", pa.int64()), ("t", pa.int64()), ("u", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("d", pa.int32()), ("open", pa.bool_()), ("crowd", pa.bool_()), ("context", pa.binary())])


def contexts(length: int):
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the phrases asked for: the phrase to the end of its trigger, and what its windows need beyond."""
        for batch in batches:
            data, at = columns_of(batch, "bytes")
            rows: list[tuple] = []
            for k, (t, u, wanted) in enumerate(zip(batch.column("t").to_pylist(), batch.column("u").to_pylist(), batch.column("wanted").to_pylist(), strict=True)):
                rows += [(w["g"], t, u, w["lo"], w["n"], w["d"], w["open"], w["crowd"], data[at[k] + w["lo"] : at[k] + w["lo"] + w["n"] + length - 1].tobytes()) for w in wanted]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), CONTEXT, strict=True)], schema=CONTEXT)

    return fetch


def suffix_ranks(words: list[bytes], most: int) -> np.ndarray:
    """The dictionary's suffix array as ranks: for each byte of the words, joined, the place of the word's suffix from it
    on among all such suffixes; equal ones have equal ranks. By prefix doubling on the bytes, no suffix over `most`."""
    sizes = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
    n = len(data) - 8
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # bytes to the end of the word
    first = np.zeros(n, np.uint64)
    for k in range(7):  # seven bytes and how many of them are there
        first = first * np.uint64(256) + np.where(left > k, data[k : n + k], 0).astype(np.uint64)
    rank = np.unique(first * np.uint64(256) + np.minimum(left, 7).astype(np.uint64), return_inverse=True)[1]
    done = 7
    while done < most:
        after = np.zeros(n, np.int64)
        after[: n - done] = np.where(left[: n - done] > done, rank[done:] + 1, 0) if n > done else 0
        rank = np.unique(rank * np.int64(n + 1) + after, return_inverse=True)[1]
        done *= 2
    return rank


def common(follows: list[bytes]) -> np.ndarray:
    """How many bytes each has in common with the next one."""
    if len(follows) < 2:
        return np.zeros(0, np.int64)
    sizes = np.array([len(x) for x in follows], np.int64)
    width = int(sizes.max()) + 1
    table = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in follows), np.uint8).reshape(-1, width)
    differ = table[1:] != table[:-1]
    differ[:, -1] = True
    return np.minimum(differ.argmax(axis=1), np.minimum(sizes[1:], sizes[:-1]))


def least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low:high] for each pair, low < high, from minima over runs of powers of two."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        step = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    level = np.frexp(high - low)[1] - 1
    out = np.zeros(len(low), np.int64)
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(levels[k][low[at]], levels[k][high[at] - (1 << k)])
    return out


def repeated(parts: list[bytes], counts: np.ndarray, reach: np.ndarray, length: int) -> np.ndarray:
    """For each window of the phrases, whether another of them is equal, by the order of their suffixes.

    A phrase's bytes are its word, `reach` bytes up to the end of its trigger, and what follows it in the parse. A
    suffix is a suffix of the word and all that follows: so the dictionary's suffix array puts them in order, and where
    the words' suffixes are equal, the order of what follows does. Equal windows have their trigger at equal distance,
    so their words' suffixes are equal; then neighbours in this order have those bytes in common and the least of the
    common bytes between what follows them. Windows are equal to a neighbour if that makes `length`.
    """
    words, follows = [p[:r] for p, r in zip(parts, reach.tolist(), strict=True)], [p[r:] for p, r in zip(parts, reach.tolist(), strict=True)]
    parse = sorted(set(follows))
    place = {x: i for i, x in enumerate(parse)}
    follow = np.array([place[x] for x in follows], np.int64)
    owner = np.repeat(np.arange(len(parts)), counts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    head = suffix_ranks(words, length)[(np.cumsum(reach) - reach)[owner] + inner]
    order = np.argsort(head * np.int64(len(parse)) + follow[owner], kind="stable")
    one, two = order[:-1], order[1:]
    same = np.flatnonzero(head[one] == head[two])
    one, two = one[same], two[same]
    low, high = follow[owner[one]], follow[owner[two]]
    shared = (reach[owner] - inner)[one]
    apart = np.flatnonzero(low < high)
    equal = np.ones(len(one), bool)
    equal[apart] = shared[apart] + least_between(common(parse), low[apart], high[apart]) >= length
    again = np.zeros(len(owner), bool)
    again[one[equal]] = True
    again[two[equal]] = True
    return again


REPEATS = pa.schema([("t", pa.int64()), ("u", pa.int64()), ("lo", pa.int64()), ("n", pa.int32())])


def sorter(length: int, lot: int = 1 << 20):
    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which windows of open phrases occur again. Rows come in order of their trigger, and equal windows have equal
        triggers: so the corpus is put in order (`repeated`) lot by lot, cut between triggers."""
        held: list[dict] = []
        total = 0

        def flush() -> pa.RecordBatch:
            counts = np.array([r["n"] for r in held], np.int64)
            again = repeated([r["context"] for r in held], counts, np.array([r["d"] for r in held], np.int64) + GRAM, length)
            owner = np.repeat(np.arange(len(held)), counts)
            again &= np.array([r["open"] for r in held])[owner]
            where = np.flatnonzero(again)
            new = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1] + 1) | (owner[where[1:]] != owner[where[:-1]])])) if len(where) else where
            first = where[new]
            who, base = owner[first].tolist(), np.cumsum(counts) - counts
            lo = np.array([held[k]["lo"] for k in who], np.int64) + first - base[owner[first]]
            n = np.diff(np.append(new, len(where))).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.array([held[k]["t"] for k in who], np.int64), np.array([held[k]["u"] for k in who], np.int64), lo, n)], schema=REPEATS)

        for batch in batches:
            for row in batch.to_pylist():
                if total > lot and row["g"] != held[-1]["g"]:
                    yield flush()
                    held.clear()
                    total = 0
                held.append(row)
                total += len(row["context"])
        if held:
            yield flush()

    return resolve


HASHED = pa.schema([("h", pa.int64()), ("i", pa.int64()), ("t", pa.int64()), ("u", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("open", pa.bool_()), ("known", pa.bool_())])


def alike(one: bytes, d: int, other: bytes, e: int) -> tuple[int, int]:
    """The run of bytes of one that equals other, laid so that the places d and e meet, around d: begin and end."""
    shift = min(d, e)
    a, b = np.frombuffer(one, np.uint8)[d - shift :], np.frombuffer(other, np.uint8)[e - shift :]
    size = min(len(a), len(b))
    differ = np.flatnonzero(a[:size] != b[:size])
    before, after = differ[differ < shift], differ[differ >= shift]
    return d - shift + (int(before[-1]) + 1 if len(before) else 0), d - shift + (int(after[0]) if len(after) else size)


def hasher(length: int, centres: Broadcast):
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For phrases of triggers that no one task can put in order: which windows equal the trigger's commonest phrase,
        as runs (known), and a row with 128 bits of hash for each other window. Whoever shares a window with that phrase
        finds it here, so these windows needn't be hashed."""
        common = centres.value
        for rows in (b.slice(at, 1000).to_pylist() for b in batches for at in range(0, b.num_rows, 1000)):
            pieces = []  # row, first window and number of windows to hash
            runs = []
            for k, r in enumerate(rows):
                n, found = r["n"], None
                if r["g"] in common:
                    e, context = common[r["g"]]
                    lo, hi = alike(r["context"], r["d"], context, e)
                    lo, hi = max(lo, 0), min(n, hi - length + 1)
                    found = (lo, hi) if lo < hi and hi + length - 1 >= r["d"] + GRAM else None
                if found:
                    if r["open"]:
                        runs.append((None, None, r["t"], r["u"], r["lo"] + found[0], found[1] - found[0], True, True))
                    pieces += [(k, a, b) for a, b in ((0, found[0]), (found[1], n)) if a < b]
                else:
                    pieces.append((k, 0, n))
            if runs:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*runs, strict=True), HASHED, strict=True)], schema=HASHED)
            if pieces:
                counts = np.array([b - a for _, a, b in pieces], np.int64)
                data = np.frombuffer(b"".join(rows[k]["context"][a : b + length - 1] for k, a, b in pieces), np.uint8)
                sizes = counts + length - 1
                inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                at = np.repeat(np.cumsum(sizes) - sizes, counts) + inner
                h, i = (rolling(data, length, base)[at].view(np.int64) for base in BASES)
                t, u, lo = (np.repeat(np.array([rows[k][c] for k, _, _ in pieces], np.int64), counts) for c in ("t", "u", "lo"))
                lo += inner + np.repeat(np.array([a for _, a, _ in pieces], np.int64), counts)
                is_open = np.repeat([rows[k]["open"] for k, _, _ in pieces], counts)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, i, t, u, lo, np.ones(len(h), np.int32), is_open, np.zeros(len(h), bool))], schema=HASHED)

    return spell


def ddl(schema: pa.Schema) -> str:
    kinds = {"int64": "long", "int32": "int", "bool": "boolean", "binary": "binary"}
    return ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in schema)


def spans_of(starts: list, length: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, n in sorted((s["lo"], s["n"]) for s in starts):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], lo + n + length - 1)
        else:
            out.append([lo, lo + n + length - 1])
    return [(a, b) for a, b in out]


def remover(length: int):
    kind = T.StructType([T.StructField("spans", T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType()))), T.StructField("kept", T.BinaryType())])

    def remove(data: pd.Series, starts: pd.Series) -> pd.DataFrame:
        spans, kept = [], []
        for raw, s in zip(data, starts, strict=True):
            found = spans_of(s, length) if s is not None else []
            at, parts = 0, []
            for a, b in found:
                parts.append(raw[at:a])
                at = b
            spans.append([{"start": a, "end": b} for a, b in found])
            kept.append(b"".join([*parts, raw[at:]]))
        return pd.DataFrame({"spans": spans, "kept": kept})

    return F.pandas_udf(remove, kind)


def hot_triggers(texts: DataFrame, length: int) -> np.ndarray:
    """The triggers that a large share of all phrases has, as one text of SAMPLE shows: LISTED of them at most."""
    some = texts.filter(F.pmod("t", F.lit(SAMPLE)) == 0).mapInArrow(parser(length), ddl(PARSED)).filter("c > 0").groupBy("g").count()
    some = saved(some.groupBy("g").agg(F.sum("count").alias("n")))
    total = some.agg(F.sum("n")).first()[0] or 0
    return np.array([r.g for r in some.filter(F.col("n") >= max(HOT_LEAST, total / LISTED)).select("g").collect()], np.int64)


def suffix_dedup(df: DataFrame, length: int = 200, text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """Adds `spans` (the maximal runs of removed bytes, as structs of start and end) and `kept` (the other bytes).

    Removed is each byte under a string of `length` bytes that also starts somewhere else, in the same text or
    another; strings don't cross texts and are judged on the input.

    The corpus is parsed into phrases (`phrases`), which are named by 128 bits of hash of their bytes. Two windows are
    equal only if their phrases have equal triggers, so the dictionary is dealt by trigger. A phrase that occurs twice
    settles all its windows by its name; a phrase alone under its trigger repeats nothing. Only where a trigger has
    phrases of several names (around the edges of a repeat) their bytes are fetched, one copy for each name, and their
    windows put in corpus order by suffix arrays of the dictionary and of the parse (`repeated`). So what is shuffled is
    a row per phrase (about 70 bytes of text), the texts for two joins, and the phrases in doubt.

    Texts are known by 128 bits of hash: equal texts share their rows. The phrases of a trigger with much of the corpus
    (a passage in many texts) are counted by name before they are shuffled; those in doubt are laid beside the
    commonest, and their other windows go by 128 bits of hash through a shuffle of their own. So do the windows of a
    trigger with more than `crowd` phrases.

    Null texts are empty; texts under `length` bytes keep all. Outputs replace input columns of the same names. An
    empty input gives an empty result.
    """
    raw = F.coalesce(F.col("_row")[text_col].cast("string"), F.lit("")).cast("binary")
    rows = pack(df).withColumn("t", F.xxhash64(raw)).withColumn("u", F.xxhash64(F.lit(length), raw))
    texts = rows.select("t", "u", raw.alias("bytes")).filter(F.octet_length("bytes") >= length)
    hot = df.sparkSession.sparkContext.broadcast(hot_triggers(texts, length))
    parsed = texts.mapInArrow(parser(length, hot), ddl(PARSED))
    near, equal = Window.partitionBy("g"), Window.partitionBy("g", "e", "f")
    parsed = parsed.select("*", ((F.min("e").over(near) != F.max("e").over(near)) | (F.min("f").over(near) != F.max("f").over(near))).alias("mixed"), F.count("*").over(near).alias("members"))
    parsed = parsed.select("*", F.sum("c").over(equal).alias("total"), F.row_number().over(equal.orderBy("t", "u", "lo")).alias("nth"))
    settled = (F.col("c") == 0) | (F.col("total") > 1)
    wanted = (F.col("c") > 0) & F.col("mixed") & (F.col("nth") == 1)
    flagged = parsed.withColumn("settled", settled).withColumn("wanted", wanted).filter("settled or wanted or hot")
    keep = ["t", "u", "lo", "n", "d", "settled", "wanted", "hot", *[F.when(F.col("hot"), F.col(c)).alias(c) for c in ("e", "f", "c", "x")]]
    flagged = cut(flagged.select(*keep, F.when(F.col("wanted"), F.col("g")).alias("g"), (F.col("members") > crowd).alias("crowd")), "phrases")

    ask = flagged.filter("wanted").select("t", "u", F.struct("g", "lo", "n", "d", (~F.col("settled")).alias("open"), "crowd").alias("w"))
    starts = flagged.filter("settled").select("t", "u", "lo", "n")
    if len(hot.value):
        mine = flagged.filter("hot")
        names = mine.groupBy("e", "f", "x").agg(F.sum("c").alias("total"), F.min(F.struct("t", "u", "lo", "n", "d")).alias("one"))
        names = cut(names, "names")
        again = F.struct(F.col("x").alias("g"), "one.lo", "one.n", "one.d", (F.col("total") == 1).alias("open"), F.lit(True).alias("crowd"))
        ask = ask.unionByName(names.select("one.t", "one.u", again.alias("w")))
        starts = starts.unionByName(mine.join(names.filter("total > 1").select("e", "f"), ["e", "f"]).select("t", "u", "lo", "n"))
    ask = ask.groupBy("t", "u").agg(F.collect_set("w").alias("wanted"))
    once = texts.groupBy("t", "u").agg(F.first("bytes").alias("bytes"))
    found = once.join(ask, ["t", "u"]).select("t", "u", "bytes", "wanted").mapInArrow(contexts(length), ddl(CONTEXT))
    crowded = len(hot.value) > 0 or flagged.filter("wanted and crowd").limit(1).count() > 0
    if crowded:
        found = cut(found, "contexts")
        centres = {}
        if len(hot.value):  # a phrase for each hot trigger at most
            most = names.filter("total > 1").groupBy("x").agg(F.max_by("one", F.struct("total", "e", "f")).alias("one"))
            most = most.select(F.col("x").alias("g"), "one.t", "one.u", "one.lo")
            centres = {r.g: (r.d, bytes(r.context)) for r in found.join(most, ["g", "t", "u", "lo"]).select("g", "d", "context").collect()}
        shared = df.sparkSession.sparkContext.broadcast(centres)
        spelled = cut(found.filter("crowd").repartition("t", "u", "lo").mapInArrow(hasher(length, shared), ddl(HASHED)), "windows")
        twice = spelled.filter("not known").groupBy("h", "i").agg(F.count("*").alias("times")).filter("times > 1").select("h", "i")
        starts = starts.unionByName(spelled.filter("known").select("t", "u", "lo", "n"))
        starts = starts.unionByName(spelled.filter("open and not known").join(twice, ["h", "i"]).select("t", "u", "lo", "n"))
    ordered = found.filter("not crowd").repartition("g").sortWithinPartitions("g").mapInArrow(sorter(length), ddl(REPEATS))
    starts = starts.unionByName(ordered).groupBy("t", "u").agg(F.collect_set(F.struct("lo", "n")).alias("starts"))
    out = rows.join(cut(starts, "starts"), ["t", "u"], "left").withColumn("_out", remover(length)(raw, "starts"))
    return unpack(out.select("_row", "_out.spans", "_out.kept"), df.columns, ["spans", "kept"])
