"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each at a node that the bits before it name. For every node there is a tree of contexts:
the bytes before, up to a depth. Each context estimates the next bit from its own counts (Krichevsky-Trofimov) and is
mixed with its longer contexts, half and half before any byte was seen; the counts of the corpus turn the halves into
weights. Learning is a count of byte strings and a weighting from the deepest contexts up, scoring a sum over a text's
bytes of what the mixture gives them.
"""

from __future__ import annotations

import ctypes
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetops.llm.common import cut, saved

#: Bytes of context.
DEPTH = 5
#: Texts of a slice, in bytes: the strings that they hold are asked for together, and kept while the slice is scored.
SLICE = 32 << 20
#: Bytes that are gone through at once.
CHUNK = 1 << 19
#: Strings of a slice that are held, repeats among them, before they are first summed up; and rows of a batch that is sent.
HELD, PIECE = 3_000_000, 1 << 16
#: Strings whose weights are worked out at once, in whole contexts of three bytes.
LOT = 200_000
#: Before a text's first byte, and after its last one; no UTF-8 text holds it.
END = 0xFF


#: Log probabilities are whole numbers of these parts of one, so that their sums don't depend on the order.
GRAIN = 1 << 24


def hand_back() -> None:
    """What was freed goes back to the system: a worker that waits for its next task would keep it beside those at work."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def strings(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings of depth + 1 bytes that end at each byte of each text and at its END, as numbers, and where each text's
    strings begin. The last byte is the lowest, above it stands the byte before and so on, from the top down: contexts that
    agree in their latest bytes are neighbours."""
    gap = bytes([END]) * depth
    whole = gap + gap.join(texts) + gap
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + depth)  # of the first END after each text
    asked = np.ones(len(whole) - depth, bool)
    asked[(ends[:, None] + np.arange(1, depth)).ravel() - depth] = False
    before = np.ndarray(len(whole) - depth, "<u8", whole + bytes(8), strides=(1,)) & np.uint64((1 << 8 * depth) - 1)
    out = before.view(np.int64) << 8 | np.frombuffer(whole, np.uint8)[depth:]
    return out[asked], np.cumsum(sizes + 1) - sizes - 1


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, sorted, and how often it occurs."""
    keys = np.sort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    return keys[first], np.diff(np.append(first, len(keys)))


class Lookup:
    """Whole numbers by key, for keys that are all in it. Keys stand in the order of their hashes, with the place where each
    of about as many ranges of hashes begins. A key that comes twice has the same value."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(1, len(keys).bit_length())
        by = np.argsort(self.hashed(keys))
        self.keys, self.values = keys[by], values[by]
        del by
        self.begin = np.zeros(1 << self.bits, np.int32)
        np.cumsum(np.bincount(self.range(self.keys), minlength=1 << self.bits)[:-1], out=self.begin[1:])

    def hashed(self, keys: np.ndarray) -> np.ndarray:
        return keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def range(self, keys: np.ndarray) -> np.ndarray:
        return (self.hashed(keys) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self.begin[self.range(keys)]
        left = np.flatnonzero(self.keys[at] != keys)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] != keys[left]]
        return self.values[at]


def tallied(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with its sum."""
    by = np.argsort(keys)
    keys = keys[by]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[by], first) if len(keys) else n


class Counts:
    """The counts of a slice's tokens by their XXH64, without an object for each; tokens that share theirs are kept apart."""

    def __init__(self, parts: list[tuple[pa.Array, np.ndarray]]):
        hashes = np.concatenate([hashed(t.to_pylist()) for t, _ in parts])
        n = np.concatenate([c for _, c in parts])
        by = np.argsort(hashes)
        again = by[1:][np.diff(hashes[by]) == 0]
        clashing = set(hashes[again[n[again] != n[by[:-1][np.diff(hashes[by]) == 0]]]].tolist())
        starts = np.cumsum([0] + [len(t) for t, _ in parts])
        self.odd = {}
        for i in np.flatnonzero(np.isin(hashes, list(clashing))).tolist() if clashing else ():
            part = int(np.searchsorted(starts, i, "right")) - 1
            self.odd[parts[part][0][i - int(starts[part])].as_py()] = int(n[i])
        self.found = Lookup(hashes, n)

    def find(self, asked: list[bytes]) -> np.ndarray:
        out = self.found.find(hashed(asked))
        if self.odd:
            out = np.array([self.odd.get(w, c) for w, c in zip(asked, out.tolist())], np.int64)
        return out


def merged(runs: list[tuple[np.ndarray, np.ndarray]], some: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted runs of keys and numbers as one, each key once with its sum, in pieces of some rows: beside the runs only a
    piece is held."""
    if not sum(len(k) for k, _ in runs):
        return
    step = max(1, some // (4 * len(runs)))
    bounds = np.sort(np.concatenate([k[::step] for k, _ in runs]))[some // step :: max(1, some // step)]
    bounds = np.unique(bounds)
    ends = [[0, *np.searchsorted(k, bounds).tolist(), len(k)] for k, _ in runs]
    for i in range(len(bounds) + 1):
        keys = np.concatenate([k[e[i] : e[i + 1]] for (k, _), e in zip(runs, ends)])
        if len(keys):
            yield tallied(keys, np.concatenate([n[e[i] : e[i + 1]] for (_, n), e in zip(runs, ends)]))


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, then one end, an empty token."""
    return [*text.split(), b""]


def hashed(tokens: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, tokens)), ">i8").astype(np.int64)


def log_gamma_table(shift: float, size: int = 4096) -> np.ndarray:
    """log of (shift)(shift + 1)...(shift + n - 1) for n below size."""
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(size - 1) + shift))])


HALVES, WHOLES = log_gamma_table(0.5), log_gamma_table(1.0)


def rising(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    """log of the gamma function at n + shift over that at shift; Stirling's series beyond the table."""
    out = table[np.minimum(n, len(table) - 1)]
    far = n >= len(table)
    if far.any():
        x = n[far] + shift
        out[far] = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) - (0.5 * np.log(np.pi) if shift == 0.5 else 0.0)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return rising(zeros, HALVES, 0.5) + rising(ones, HALVES, 0.5) - rising(zeros + ones, WHOLES, 1.0)


HALF = np.log(0.5)


class Level:
    """The nodes of one depth for the decision number `bit`, of the strings that are left when older bytes are cut off."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, bit: int):
        self.names = keys >> (8 - bit)
        new = np.diff(self.names, prepend=self.names[0] - 1) != 0
        self.of, self.first = np.cumsum(new) - 1, np.flatnonzero(new)
        self.names = self.names[self.first]
        self.total = np.add.reduceat(n, self.first)
        self.ones = np.add.reduceat(n * (keys >> (7 - bit) & 1), self.first)
        self.estimate = (self.ones + 0.5) / (self.total + 1.0)
        self.own = self.log_weighted = log_kt(self.total - self.ones, self.ones)

    def mix(self, deeper: np.ndarray) -> None:
        """deeper: the sum of the longer contexts' log_weighted, by node."""
        self.log_weighted = np.logaddexp(HALF + self.own, HALF + deeper)
        self.weight = np.exp(HALF + self.own - self.log_weighted)


def climb(keys: np.ndarray, n: np.ndarray, depth: int) -> Iterator[tuple[int, list[Level], list[np.ndarray]]]:
    """For each of the eight decisions the levels from the deepest up to three bytes of context, mixed, and for each level
    the numbers of its strings by the number of the key. Keys are sorted and hold whole contexts of three bytes."""
    cuts, at = [(keys, n)], [np.arange(len(keys))]
    links = []
    for _ in range(depth, 3, -1):
        k, c = cuts[-1]
        shorter, link = np.unique((k >> 16) << 8 | k & 255, return_inverse=True)
        cuts.append((shorter, np.bincount(link, weights=c, minlength=len(shorter)).astype(np.int64)))
        links.append(link)
        at.append(link[at[-1]])
    for bit in range(8):
        levels = [Level(k, c, bit) for k, c in cuts]
        for deep, level, link in zip(levels, levels[1:], links):
            level.mix(np.bincount(level.of[link[deep.first]], weights=deep.log_weighted, minlength=len(level.names)))
        yield bit, levels, at


def lots(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[list[np.ndarray]]:
    """Sorted rows (first column `key`) in lots that end with a context of three bytes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(h[0]) for h in held) >= LOT:
            rows = [np.concatenate(c) for c in zip(*held)]
            context = rows[0] >> (8 * (depth - 2))
            end = int(np.searchsorted(context, context[-1]))
            if end:
                yield [c[:end] for c in rows]
            held = [[c[end:] for c in rows]]
    if held and sum(len(h[0]) for h in held):
        yield [np.concatenate(c) for c in zip(*held)]


def placed(docs: DataFrame, size: int) -> DataFrame:
    """row, text, learn and `slice`: rows that stand together in a file, so many that their texts hold about `size` bytes. Each read of the
    files deals them alike. A frame that isn't read from files is written first."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("nth")]
    try:
        named = docs.select("*", *place)
    except AnalysisException:
        named = cut(docs, "documents").select("*", *place)
    mean = docs.agg(F.avg(F.octet_length("text") + 1)).first()[0] or 1
    return named.withColumn("slice", F.xxhash64("file", F.floor(F.col("nth") / max(1, int(size / mean))))).drop("file", "nth")


def contents(docs: DataFrame, depth: int) -> DataFrame:
    """What each slice holds: its different strings (`key`) and its different tokens (`token`); `n` counts those of texts to
    learn from and is 0 for what only others hold. A slice that several tasks read has rows from each of them."""

    def told(slice_no: int, held: list[tuple[np.ndarray, np.ndarray]], words: Counter[bytes]) -> Iterator[pa.RecordBatch]:
        names = ["slice", "key", "token", "n"]
        for keys, n in merged(held, PIECE):
            m = len(keys)
            yield pa.record_batch([pa.array(np.full(m, slice_no)), pa.array(keys), pa.nulls(m, pa.binary()), pa.array(n)], names)
        left = iter(words.items())
        while some := list(islice(left, PIECE)):
            m = len(some)
            yield pa.record_batch([pa.array(np.full(m, slice_no)), pa.nulls(m, pa.int64()), pa.array([w for w, _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, words, most = None, [], Counter(), HELD
        for batch in batches:
            slices, a = batch.column(0).to_numpy(), 0
            while a < len(batch):
                if slices[a] != now:
                    if now is not None:
                        yield from told(now, held, words)
                    now, held, words, most = slices[a], [], Counter(), HELD
                    hand_back()
                texts, b, some = [], a, 0
                while b < len(batch) and slices[b] == now and (b == a or some < CHUNK):
                    texts.append(batch.column(1)[b].as_py().lower())  # of bytes, so A-Z only
                    some += len(texts[-1]) + 1
                    b += 1
                learn = batch.column(2)[a:b].to_pylist()
                for known in (True, False):
                    own = [t for t, x in zip(texts, learn) if x == known]
                    for c in range(0, len(own), 4096):
                        keys, n = counted(strings(own[c : c + 4096], depth)[0])
                        held.append((keys, n * int(known)))
                    for t in own:
                        if known:
                            words.update(tokens(t))
                        else:
                            words.update(dict.fromkeys(tokens(t), 0))
                if sum(len(k) for k, _ in held) > most:
                    held = list(merged(held, PIECE))
                    most = max(HELD, sum(len(k) for k, _ in held) * 3 // 2)
                a = b
        if now is not None:
            yield from told(now, held, words)
        held, words, batch, texts, own = [], Counter(), None, [], []
        hand_back()

    return cut(docs.select("slice", "text", "learn").mapInArrow(run, "slice long, key long, token binary, n long"), "slices")


def nodes(strings: DataFrame, depth: int) -> DataFrame:
    """key, n to a row for each decision (`node`: the bits before it, after a one) under each context of three bytes:
    zeros, ones and log_weighted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in lots(batches, depth):
            for bit, levels, _ in climb(keys, n, depth):
                top = levels[-1]
                node = (1 << bit) | (top.names & ((1 << bit) - 1))
                yield pa.record_batch([pa.array(top.names >> bit), pa.array(node), pa.array(top.total - top.ones), pa.array(top.ones), pa.array(top.log_weighted)], ["context", "node", "zeros", "ones", "log_weighted"])

    return strings.mapInArrow(run, "context long, node long, zeros long, ones long, log_weighted double")


def weighed(deeper: DataFrame) -> DataFrame:
    """Nodes of a depth to those of contexts one byte shorter, with weight and estimate. Sums are decimal, so that they
    don't depend on the order of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zeros, ones, deep = (batch.column(c).to_numpy() for c in ("zeros", "ones", "deep"))
            own = log_kt(zeros, ones)
            all_of = np.logaddexp(HALF + own, HALF + deep)
            more = [pa.array(all_of), pa.array(np.exp(HALF + own - all_of)), pa.array((ones + 0.5) / (zeros + ones + 1.0))]
            yield pa.record_batch([*batch.columns[:4], *more], [*batch.schema.names[:4], "log_weighted", "weight", "estimate"])

    shorter = deeper.groupBy(F.shiftright("context", 8).alias("context"), "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum(F.col("log_weighted").cast("decimal(38,9)")).cast("double").alias("deep"))
    return saved(shorter.mapInArrow(run, "context long, node long, zeros long, ones long, log_weighted double, weight double, estimate double"))


def mixtures(strings: DataFrame, depth: int) -> DataFrame:
    """For each context of two bytes and each decision what the contexts of 0 to 2 bytes give: `base` and `rest`, so that
    a one has the probability base + rest * (that of the longer contexts), and `stop`, the estimate that stands for those
    where there are none. A context that was never seen leaves its weight to the next shorter one."""
    two = weighed(nodes(strings, depth))
    one = weighed(two)
    none = weighed(one)
    seen = F.col("zeros") + F.col("ones") > 0
    part = lambda df, k: df.select(F.col("context").alias(f"context{k}"), F.col("node"), seen.alias(f"seen{k}"), F.col("weight").alias(f"w{k}"), F.col("estimate").alias(f"p{k}"))
    rows = part(two, 2).withColumn("context1", F.shiftright("context2", 8)).join(part(one, 1), ["context1", "node"]).join(part(none, 0).drop("context0"), "node")
    first = F.col("w0") * F.col("p0")
    go0, go1 = 1 - F.col("w0"), (1 - F.col("w0")) * (1 - F.col("w1"))
    second = first + go0 * F.col("w1") * F.col("p1")
    base = F.when(~F.col("seen1"), F.col("p0")).when(~F.col("seen2"), first + go0 * F.col("p1")).otherwise(second + go1 * F.col("w2") * F.col("p2"))
    rest = F.when(F.col("seen1") & F.col("seen2"), go1 * (1 - F.col("w2"))).otherwise(0.0)
    return rows.select("context2", "node", base.alias("base"), rest.alias("rest"), F.col("p2").alias("stop"))


def log_probabilities(strings: DataFrame, depth: int) -> DataFrame:
    """key, n (each key once) to key, `parts`: the logarithm of the last byte's probability after the bytes before it, in
    parts of one over GRAIN.

    Strings are dealt by their two latest bytes of context and sorted, so a subtree's strings come one after another and
    only those of one context of three bytes are held together. What lies above is a table of fixed size."""
    up = 8 * (depth - 1)
    dealt = saved(strings.repartition(F.shiftright("key", up)).sortWithinPartitions("key"))
    above = mixtures(dealt, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, table = np.zeros(0, np.int64), np.zeros((3, 0))
        for keys, n, node, *found in lots(batches, depth):
            top = node > 0
            code = np.concatenate([code, (keys[top] >> up) << 8 | node[top]])
            table = np.concatenate([table, np.array([c[top] for c in found])], axis=1)
            keys, n = keys[~top], n[~top]
            if not len(keys):
                continue
            by = np.argsort(code)
            code, table = code[by], table[:, by]
            out = np.zeros(len(keys))
            for bit, levels, at in climb(keys, n, depth):
                here = [level.of[a] for level, a in zip(levels, at)]
                ones = levels[0].estimate[here[0]]
                for k in range(1, len(levels)):
                    w, p = levels[k].weight[here[k]], levels[k].estimate[here[k]]
                    ones = np.where(levels[k - 1].total[here[k - 1]] > 0, w * p + (1 - w) * ones, p)
                prefix = (keys & 255) >> (8 - bit)
                base, rest, stop = table[:, np.searchsorted(code, (keys >> up) << 8 | 1 << bit | prefix)]
                ones = base + rest * np.where(levels[-1].total[here[-1]] > 0, ones, stop)
                out += np.log10(np.where(keys >> (7 - bit) & 1, ones, 1 - ones))
            yield pa.record_batch([pa.array(keys), pa.array(np.rint(out * GRAIN).astype(np.int32))], ["key", "parts"])
            still = code >> 8 >= keys[-1] >> up
            code, table = code[still], table[:, still]
        hand_back()

    zero = F.lit(0).cast("long")
    none = F.lit(0.0)
    rows = above.select(F.shiftleft("context2", up).alias("key"), zero.alias("n"), "node", "base", "rest", "stop")
    rows = rows.unionByName(dealt.select("key", "n", zero.alias("node"), none.alias("base"), none.alias("rest"), none.alias("stop")))
    rows = rows.repartition(F.shiftright("key", up)).sortWithinPartitions(F.shiftright("key", up), F.col("node") == 0, "key")
    return rows.mapInArrow(run, "key long, parts int")


def score(docs: DataFrame, trained: Column, columns: list[str], text_col: str = "text", depth: int = DEPTH, size: int = SLICE) -> DataFrame:
    """The given columns and `_trained`, then `n_bytes`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score` and
    `bits_per_byte` of every text, by a model of the texts for which `trained` holds. A-Z are lower-cased first.

    score: log10 of the probability of the whole text and its end, all of its bytes after their contexts of `depth` (3 to
    6) bytes; bits_per_byte: the code length for each byte, the end included. base_score: that of its tokens, white space
    aside, by add-one counts: (c + 1) / (N + V + 1), with one end for each text. n_known: tokens with c > 0.

    Texts are taken in slices of about `size` bytes, as they stand in their files. The different strings and tokens of a
    slice are counted, meet the model in a shuffle by string, and come back to their slice, where the texts are scored; so
    what travels beside the texts follows the different strings, and nothing of the model is broadcast or held whole.

    Null and empty texts are scored as empty: their end alone. A very long text makes its slice larger. Repeated rows count
    and are scored as often as they occur; `trained` null counts as false. With nothing to learn from each bit has the
    probability one half and every token 1 / (0 + 0 + 1). An empty table gives no rows. Further columns aren't looked at."""
    if not 3 <= depth <= 6:
        raise ValueError("depth: 3 to 6")
    row = F.struct(*columns, trained.alias("_trained")).alias("row")
    rows = placed(docs.select(row, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), F.coalesce(trained, F.lit(False)).alias("learn")), size)
    held = contents(rows, depth)
    asked = held.filter("key is not null")
    model = log_probabilities(asked.groupBy("key").agg(F.sum("n").alias("n")), depth)
    found = asked.select("slice", "key").join(model, "key")
    alike = Window.partitionBy("token")
    words = held.filter("token is not null").select("slice", "token", F.sum("n").over(alike).alias("n"), F.row_number().over(alike.orderBy("slice")).alias("nth"))
    row_kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, parts, told, count, lookup, kinds = None, [], [], [], None, None, 0
        for batch in batches:
            of, kind = batch.column("slice").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((of[1:] != of[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(of)]):
                if a == b:
                    continue
                if of[a] != now:
                    now, keys, parts, told, count, lookup, kinds = of[a], [], [], [], None, None, 0
                    hand_back()
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    keys.append(part.column("key").to_numpy().copy())  # else the whole batch stays
                    parts.append(part.column("value").to_numpy().astype(np.int32))
                elif kind[a] < 3:
                    n = part.column("value").to_numpy().copy()
                    kinds += int((n > 0).sum()) * (kind[a] == 2)
                    told.append((pa.concat_arrays([part.column("bytes"), pa.array([], part.column("bytes").type)]), n))
                else:
                    if lookup is None:
                        lookup, keys, parts = Lookup(np.concatenate(keys), np.concatenate(parts)), [], []
                        count, told = Counts(told), []
                    yield from scored(part, lookup, count, kinds)
                    kinds = 0
        count = lookup = batch = part = None
        hand_back()

    def scored(part: pa.RecordBatch, lookup: Lookup, count: Counts, kinds: int) -> Iterator[pa.RecordBatch]:
        a, text = 0, part.column("bytes")
        while a < len(part):
            texts, b, some = [], a, 0
            while b < len(part) and (b == a or some < CHUNK) and b - a < 4096:
                texts.append(text[b].as_py().lower())
                some += len(texts[-1])
                b += 1
            at, first = strings(texts, depth)
            sums = np.add.reduceat(lookup.find(at).astype(np.int64), first)
            words = [count.find(tokens(t)) for t in texts]
            sizes = np.array([len(t) for t in texts])
            told = [sizes, np.array([len(c) for c in words]), np.array([(c > 0).sum() for c in words]), np.array([np.log10(c + 1).sum() for c in words]), sums / GRAIN, np.array([kinds if a + k == 0 else 0 for k in range(b - a)])]
            yield pa.record_batch([part.column("row").slice(a, b - a), *map(pa.array, told)], ["row", "n_bytes", "n_tokens", "n_known", "counts", "score", "kinds"])
            a = b

    # kinds of rows: strings, tokens that another slice has shown, tokens, texts
    kind = F.when(F.col("nth") == 1, 2).otherwise(1)
    dealt = [
        found.select("slice", F.lit(0).alias("kind"), "key", F.col("parts").cast("long").alias("value")),
        words.select("slice", kind.alias("kind"), F.col("n").alias("value"), F.col("token").alias("bytes")),
        rows.select("slice", F.lit(3).alias("kind"), F.col("text").alias("bytes"), "row"),
    ]
    dealt = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dealt).select("slice", "kind", "key", "value", "bytes", "row")
    dealt = dealt.repartition("slice").sortWithinPartitions("slice", "kind")
    done = saved(dealt.mapInArrow(run, f"row {row_kind}, n_bytes long, n_tokens long, n_known long, counts double, score double, kinds long"))
    total = held.filter("token is not null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kinds = done.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    base = F.col("counts") - F.col("n_tokens") * F.lit(float(np.log10(total + kinds + 1)))
    bits = -F.col("score") * F.lit(float(np.log2(10))) / (F.col("n_bytes") + 1)
    return done.select("row.*", "n_bytes", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))
