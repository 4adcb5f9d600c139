"""SimHash near-dedup over a byte-position inverted index."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetops.llm.common import cut, pack, unpack
from fleetops.llm.components import components

SEED = 42
SHINGLE = 3
BYTES = 8
#: Postings of up to this many fingerprints are paired off; longer ones are linked through shared neighbours.
SHORT = 32


def digests(text: str | None, shingle: int) -> bytes:
    """The XXH64 of each run of `shingle` words, eight bytes each; of all words where there are fewer."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return b""
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    k = min(shingle, len(words))
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a : e - 1], SEED) for a, e in zip(starts, ends[k - 1 :], strict=False)])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash, as a signed integer: a bit is 1 if set in over half the shingles' XXH64."""
    raw = digests(text, shingle)
    if not raw:
        return 0
    n, ones = len(raw) // 8, np.zeros(64, np.int64)
    for at in range(0, len(raw), 8 << 16):  # 64 bytes a shingle stay in the cache
        bits = np.unpackbits(np.frombuffer(raw[at : at + (8 << 16)], np.uint8)).reshape(-1, 64)
        whole = len(bits) // 128 * 128
        ones += np.add.reduce(bits[:whole].reshape(-1, 128, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def masks(differ: int, keep: int = 5) -> list[int]:
    """Byte positions to index together: for any `differ` bytes, one set of `keep` positions avoids them all.

    Fingerprints with up to `differ` differing bits have as many differing bytes at most, so one of the sets holds
    bytes that they share. A greedy cover; for 2 of 8 bytes and keep = 5 it has a dozen sets of 40 bits.
    """
    keep = min(keep, BYTES - differ)
    left, found = set(combinations(range(BYTES), differ)), []
    while left:
        best = max(combinations(range(BYTES), keep), key=lambda s: (sum(not set(s) & set(x) for x in left), s))
        left = {x for x in left if set(best) & set(x)}
        found.append(sum(0xFF << (8 * p) for p in best))
    return found


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, bits: int = 2, short: int = SHORT) -> DataFrame:
    """Links a, b between distinct fingerprints at up to `bits` differing bits; enough of them to join all that do.

    The inverted index has a posting list for each value of five byte positions and one more (48 bits): a list for one
    byte would hold 1/256 of all fingerprints. A pair meets in the lists of one set of five once for each further byte
    that it shares, so counting its meetings tallies its shared positional bytes; it is kept if the tally reaches the
    guaranteed minimum (8 less `bits`), then verified bit by bit. Pairs come from lists of five bytes with up to
    `short` fingerprints. Members of longer ones (groups of near copies) would give pairs by the square; they post
    themselves under all values that differ by half of `bits` in the bytes not shared, and link to the smallest member
    found at the same value: exact as well, with no pairs. The result's components don't depend on `short`. It needs
    two differing bits.
    """
    assert bits == 2, "neighbour values are made for two differing bits"
    index = masks(bits)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("value")) for i, m in enumerate(index)]))
    posted = fps.select("fp", keys.alias("k")).select("fp", "k.at", "k.value")
    sizes = posted.groupBy("at", "value").agg(F.count("*").alias("n")).filter("n > 1")
    posted = cut(posted.join(sizes, ["at", "value"]), "postings")
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)).cast("int")
    others = [[p for p in range(BYTES) if not m >> (8 * p) & 1] for m in index]
    further = F.element_at(F.array(*[F.array(*[F.struct(F.lit(p).alias("p"), byte(p).alias("v")) for p in o]) for o in others]), F.col("at") + 1)
    few = posted.filter(F.col("n") <= short).select("fp", "at", "value", F.explode(further).alias("f"))
    left, right = (few.select("at", "value", F.col("f.p").alias("p"), F.col("f.v").alias("v"), F.col("fp").alias(c)) for c in ("a", "b"))
    pairs = left.join(right, ["at", "value", "p", "v"]).filter("a < b").groupBy("at", "a", "b").agg((F.count("*") + BYTES - len(others[0])).alias("tally"))
    pairs = pairs.filter((F.col("tally") >= BYTES - bits) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).select("a", "b")
    free = F.element_at(F.array(*[F.array(F.lit(0), *[F.lit(signed(1 << b)) for b in range(64) if not m >> b & 1]) for m in index]), F.col("at") + 1)
    near = posted.filter(F.col("n") > short).select("fp", F.explode(F.transform(free, lambda b: F.col("fp").bitwiseXOR(b))).alias("value")).distinct()
    least = near.groupBy("value").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").select("value", "b")
    stars = near.join(least, "value").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def settled(rows: DataFrame, node: str, fps: DataFrame, edges: DataFrame) -> DataFrame:
    """rows with the `component_id` and `is_first` of their node; fps: each node as `fp`, and the `first` of its rows."""
    joined = components(edges)
    roots = fps.join(joined, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    firsts = roots.groupBy("root").agg(F.min("first").alias("first"))
    known = roots.select("fp", "root").join(firsts, "root").select("fp", "first.key", "first.rid")
    narrow = rows.select("_rid", node)
    known = narrow.join(known, F.col(node) == F.col("fp")).select(F.col("_rid").alias("_id"), F.col("key").alias("component_id"), (F.col("rid") == F.col("_rid")).alias("is_first"))
    return rows.join(known, F.col("_rid") == F.col("_id"))


def near_dedup(df: DataFrame, bits: int = 2, key_col: str = "doc_id", text_col: str = "text", columns: Sequence[str] | None = None) -> DataFrame:
    """Adds `fingerprint` (16 hex digits), `component_id` (the smallest key reachable) and `is_first` (one row of each
    component: smallest key, then first as read).

    Fingerprints are computed once, where the texts are read, and cut from their lineage; everything after works on
    distinct fingerprints, so exact copies cost one row. columns: the input columns to carry (all by default). A null
    text is as an empty one: fingerprint zero, linked like any other. Null keys sort last; a component of null keys
    only has a null id. Outputs replace input columns of the same names. An empty input gives an empty result.
    """
    fields = list(df.columns if columns is None else columns)
    rows = pack(df).withColumn("_fp", fingerprints(F.col("_row")[text_col])).withColumn("_key", F.col("_row")[key_col])
    if columns is not None:
        rows = rows.withColumn("_row", F.struct(*[F.col("_row")[c].alias(c) for c in fields]))
    rows = cut(rows.withColumn("_rid", F.monotonically_increasing_id()), "fingerprints")
    narrow = rows.select("_rid", "_fp", "_key")
    first = F.min(F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("_rid").alias("rid")))
    fps = cut(narrow.groupBy(F.col("_fp").alias("fp")).agg(first.alias("first")), "distinct")
    out = settled(rows, "_fp", fps, links(fps.select("fp"), bits)).withColumn("fingerprint", F.lower(F.lpad(F.hex("_fp"), 16, "0")))
    return unpack(out, fields, ["fingerprint", "component_id", "is_first"])
