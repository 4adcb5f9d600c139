"""Near copies: a byte-position inverted index of SimHash fingerprints, then the exact Jaccard similarity of word shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetops.llm.common import cut, pack, unpack
from fleetops.llm.components import components
from fleetops.llm.simhash import SEED, SHORT, digests, settled

SHINGLE = 5
SIMILARITY = 0.8
#: A fingerprint has so many groups of 24 bytes, each held in three longs.
GROUPS = 3
WIDTH = 24
#: Two texts meet in a group by a tally of two shared bytes at least, and up to LIMIT of its 192 bits may differ. At a
#: similarity of 0.8 a bit differs with a chance of 0.15; the chance that none of the groups holds is 1.6e-7 (1e-4 for
#: four shingles within five, whose ties make it 0.19).
TALLY = 2
LIMIT = 49
#: So many postings are compared at once in a task; a longer list is held whole, 36 bytes a posting.
CHUNK = 1 << 17
#: A list of more than SHORT members is compared in blocks of about so many shingles.
BLOCK = 1 << 20
#: Up to so many candidates meet their texts by a broadcast; more do so by a shuffle of all texts.
BROADCAST_NODES = 1 << 20

_draw = np.random.default_rng(SEED)
FLIPS = _draw.integers(0, 1 << 64, 3 * GROUPS, np.uint64)
FACTORS = _draw.integers(0, 1 << 64, 3 * GROUPS, np.uint64) | np.uint64(1)
MIX = np.uint64(0xFF51AFD7ED558CCD)

SKETCH = "node long, n int, print array<long>"


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' XXH64 in ascending order, signed."""
    return np.unique(np.frombuffer(digests(text, shingle), ">i8").astype(np.int64))


def bits(found: np.ndarray) -> np.ndarray:
    """A row for each shingle: its hash, drawn out to the bits of a fingerprint by one mixing function a long."""
    x = (found.view(np.uint64)[:, None] ^ FLIPS) * FACTORS
    x = (x ^ (x >> np.uint64(32))) * MIX
    x ^= x >> np.uint64(29)
    return np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")


def fingerprint(found: np.ndarray) -> list[int]:
    """The SimHash of a set in GROUPS times three longs: a bit is 1 if set in over half the shingles; in half of them,
    as the first shingle has it, so that short texts don't share their ties. An empty set has none."""
    if not len(found):
        return []
    ones = np.zeros(8 * GROUPS * WIDTH, np.int64)
    for at in range(0, len(found), 255):  # as many as one byte counts
        ones += np.add.reduce(bits(found[at : at + 255]), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones + bits(found[:1])[0] > len(found), bitorder="little").view("<i8").tolist()


def sketches(shingle: int):
    """A text's node (a hash of its set of shingles), the set's size and its fingerprint."""

    @F.pandas_udf(SKETCH)
    def sketch(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, shingle) for t in texts]
        nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        return pd.DataFrame({"node": nodes, "n": [len(s) for s in sets], "print": [fingerprint(s) for s in sets]})

    return sketch


def postings(nodes: DataFrame) -> DataFrame:
    """The inverted index: a list `value` for each byte position and byte, with the group's three longs of each node.
    The last position of a group has no list, as a tally of two begins before it."""
    at = nodes.filter(F.size("print") > 0).select("node", "print", F.explode(F.sequence(F.lit(0), F.lit(GROUPS * (WIDTH - 1) - 1))).alias("at"))
    at = at.withColumn("g", F.expr(f"at div {WIDTH - 1}")).withColumn("p", F.expr(f"at % {WIDTH - 1}"))
    byte = F.expr("shiftrightunsigned(print[int(3 * g + p div 8)], int(8 * (p % 8))) & 255")
    return at.select((F.col("at") * 256 + byte).cast("int").alias("value"), *[F.expr(f"print[int(3 * g + {k})]").alias(f"w{k}") for k in range(3)], "node")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    count = np.bitwise_count(a ^ b)
    return count[..., 0] + count[..., 1] + count[..., 2]


def forest(words: np.ndarray, members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Trees over all links of up to LIMIT bits among members: rows of a tree and the rows that join them."""
    left = members
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            now, front = np.split(front, [max(1, (1 << 18) // len(left))])
            near = differing(words[now][:, None], words[left][None]) <= LIMIT
            hit = near.any(axis=0)
            yield now[near.argmax(axis=0)[hit]], left[hit]
            front, left = np.concatenate([front, left[hit]]), left[~hit]


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels (each component's smallest row) once a and b are linked, too."""
    while (open_ := label[a] != label[b]).any():
        a, b = label[a[open_]], label[b[open_]]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while ((deeper := label[label]) != label).any():
            label = deeper
    return label


def tallied(value: np.ndarray, words: np.ndarray, short: int) -> np.ndarray:
    """Labels of the rows of whole lists (sorted by value): rows have one label if the pairs that their list brings to
    the tally join them.

    In each list the rows are parted by each later byte of their group: rows of one part share two bytes. Pairs of a
    part are compared bit by bit, each where its first two shared bytes are; a part of more than `short` rows gives a
    forest in place of its pairs, unless it is joined by then.
    """
    found, at, label = words.view(np.uint8).reshape(len(value), WIDTH), (value >> 8) % (WIDTH - 1), np.arange(len(value))
    for q in range(1, WIDTH):
        rows = np.flatnonzero(at < q)
        packed = (value[rows].astype(np.int64) << 8 | found[rows, q]) << 32 | rows
        packed.sort()
        part, rows = packed >> 32, packed & 0xFFFFFFFF
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        sizes = np.diff(starts, append=len(part))
        for start, size in zip(starts[sizes > short], sizes[sizes > short]):
            members = rows[start : start + size]
            if (label[members] != label[members[0]]).any():
                for a, b in forest(words, members):
                    label = united(label, a, b)
        few = np.repeat(sizes <= short, sizes)
        part, rows, step = part[few], rows[few], 1
        i = np.flatnonzero(part[1:] == part[:-1])
        while len(i):
            a, b = rows[i], rows[i + step]
            near = differing(words[a], words[b]) <= LIMIT
            a, b = a[near], b[near]
            first = (found[a, :q] == found[b, :q]).sum(axis=1) == TALLY - 1
            label = united(label, a[first], b[first])
            step += 1
            i = i[i + step < len(part)]
            i = i[part[i] == part[i + step]]
    return label


def meeting(short: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From postings that are sorted by value to links a, b between nodes, list by list: what a list joins is linked to
    the smallest node of it, so that each posting gives one link at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(value: np.ndarray, words: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
            label = tallied(value, words, short)
            least = np.full(len(node), np.iinfo(np.int64).max)
            np.minimum.at(least, label, node)
            a, b = node, least[label]
            pairs = np.unique(np.stack([a[a != b], b[a != b]]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        held, n, enough = [], 0, CHUNK
        for batch in batches:
            value, *words, node = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            held.append((value, np.stack(words, axis=1).view(np.uint64), node))
            n += len(value)
            if n >= enough:
                value, words, node = (np.concatenate(x) for x in zip(*held))
                end = int(np.searchsorted(value, value[-1]))  # the last list may go on
                yield linked(value[:end], words[:end], node[:end])
                held, n = [(value[end:], words[end:], node[end:])], n - end
                enough = max(CHUNK, 2 * n)
        if held:
            yield linked(*(np.concatenate(x) for x in zip(*held)))

    return run


def families(nodes: DataFrame, short: int = SHORT) -> DataFrame:
    """Nodes whose fingerprints are linked, with the `root` of all that they reach; the others are left out.

    nodes: SKETCH, node unique. Two bytes are shared by chance, too, by one pair of 65,536 at each two positions; lists
    are parted into runs of nodes / 65,536 on average, so what is compared grows with the square of the nodes (at 200,000
    some 1,200 comparisons a node). Parts of up to `short` or eight times that average are paired off.
    """
    often = max(short, nodes.count() // (1 << 13))
    dealt = postings(nodes).repartition("value").sortWithinPartitions("value")
    return components(dealt.mapInArrow(meeting(often), "a long, b long"))


def joined(sets: Sequence[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Links between sets at `similarity` or more, enough of them to join all that are.

    One set after another is counted against all others through the postings of its shingles, and linked to one member
    of each component that it is near to. Sets of the largest component are passed over: what they are near to outside
    has its own turn, or is in it by then.
    """
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    posted = np.repeat(np.arange(len(sets)), sizes)[np.argsort(ids, kind="stable")]
    ends = np.cumsum(np.bincount(ids))
    label, upto = np.arange(len(sets)), np.cumsum(sizes)
    turn = left = np.ones(len(sets), bool)
    while turn.any():
        i = int(turn.argmax())
        left[i] = False
        shared = np.bincount(np.concatenate([posted[ends[k - 1] if k else 0 : ends[k]] for k in ids[upto[i] - sizes[i] : upto[i]]]), minlength=len(sets))
        near = shared * (1 + similarity) >= similarity * (sizes + sizes[i]) - 1e-9
        near &= label != label[i]
        while near.any():
            j = int(near.argmax())
            yield i, j
            label[label == label[j]] = label[i]
            near &= label != label[i]
        turn = left & (label != np.bincount(label).argmax())


def links(nodes: DataFrame, sets_of, similarity: float = SIMILARITY, short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """Links a, b between nodes whose sets have the Jaccard similarity or more; enough of them to join all that do.

    nodes: SKETCH, node unique. sets_of: from a table of nodes to their `node` and `set`, the shingles. Candidates are
    the members of a family (see `families`). Families of up to `short` members are paired off, pairs whose sizes rule
    the similarity out dropped, and the others verified by the intersection of their sets. Larger ones are compared in
    memory, block by block, and give fewer links than they have members and blocks: near copies of one text make no
    pairs.
    """
    posted = families(nodes, short).join(nodes.select("node", "n"), "node").select(F.col("root").alias("value"), "node", "n")
    lists = posted.groupBy("value").agg(F.count("*").alias("listed"), F.sum("n").alias("total"))
    posted = cut(posted.join(lists, "value"), "families")
    sets = cut(sets_of(posted.select("node").distinct()), "sets")

    few = posted.filter(F.col("listed") <= short)
    left, right = few.select("value", F.col("node").alias("a"), F.col("n").alias("n_a")), few.select("value", F.col("node").alias("b"), F.col("n").alias("n_b"))
    fits = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9
    pairs = left.join(right, "value").filter((F.col("a") < F.col("b")) & fits).select("a", "b", "n_a", "n_b").distinct()
    pairs = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    pairs = pairs.filter(shared * (1 + similarity) >= similarity * (F.col("n_a") + F.col("n_b")) - 1e-9).select("a", "b")

    many = posted.filter(F.col("listed") > short).withColumn("blocks", F.ceil(F.col("total") / block).cast("long"))
    many = many.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node").join(sets, "node")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node")
        node = part["node"].to_numpy()
        found = list(joined([np.asarray(s, np.int64) for s in part["set"]], similarity))
        return pd.DataFrame({"a": node[[i for i, _ in found]], "b": node[[j for _, j in found]]}, dtype="int64")

    stars = many.groupBy("value", "low", "high").applyInPandas(compare, "a long, b long")
    return pairs.unionByName(stars).distinct()


def near_copies(
    df: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, key_col: str = "doc_id", text_col: str = "text", short: int = SHORT, block: int = BLOCK
) -> DataFrame:
    """Adds `component_id` (the smallest key reachable over links between texts whose sets of `shingle`-word shingles
    have a Jaccard similarity of at least `similarity`) and `is_first` (one row of each component: smallest key, then
    first as read), which replace input columns of these names.

    Words are parted by ASCII white space, in ASCII lower case. Texts are sketched once, where they are read; equal
    sets are one node. Candidates come from the byte-position inverted index of their SimHash fingerprints (set for a
    similarity of 0.8: a pair at it is missed with a chance of 1.6e-7, see LIMIT), and links are verified exactly. A text of fewer words is one shingle; a null text
    is as an empty one, and all empty texts are copies. Null keys sort last. An empty input gives an empty result.
    """
    rows = pack(df).withColumn("_s", sketches(shingle)(F.col("_row")[text_col]))
    rows = rows.select("_row", F.col("_s.node").alias("_node"), F.col("_s.n").alias("_n"), F.col("_s.print").alias("_print"), F.monotonically_increasing_id().alias("_rid"))
    rows = cut(rows, "sketches")
    key = F.col("_row")[key_col]
    first = F.min(F.struct(key.isNull().alias("none"), key.alias("key"), F.col("_rid").alias("rid")))
    nodes = rows.groupBy(F.col("_node").alias("fp")).agg(first.alias("first"), F.first("_n").alias("n"), F.first("_print").alias("print"))
    nodes = cut(nodes, "nodes")

    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle) for t in texts], dtype=object)

    def sets_of(wanted: DataFrame) -> DataFrame:
        at = cut(nodes.select(F.col("fp").alias("node"), F.col("first.rid").alias("rid")).join(wanted, "node"), "candidates")
        at = F.broadcast(at) if at.count() <= BROADCAST_NODES else at
        texts = rows.select(F.col("_rid").alias("rid"), F.col("_row")[text_col].alias("text")).join(at, "rid")
        return texts.select("node", sets("text").alias("set"))

    found = links(nodes.select(F.col("fp").alias("node"), "n", "print"), sets_of, similarity, short, block)
    return unpack(settled(rows, "_node", nodes.select("fp", "first"), found), df.columns, ["component_id", "is_first"])
