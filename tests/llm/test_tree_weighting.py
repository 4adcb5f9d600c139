"""Context-tree weighting against a recursion over all contexts, and against plain counts of tokens."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fleetops.llm import tree_weighting
from fleetops.llm.langid import remainder
from fleetops.llm.tree_weighting import END, GRAIN, HALVES, WHOLES, Counts, Lookup, counted, hand_back, log_kt, merged, rising, score, strings
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, learn boolean, key long, n int, row string"


def lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def kt(zeros, ones):
    return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(zeros + ones + 1)


def plain(docs, depth):
    """Scores by the definition, bit by bit."""
    counts = Counter()

    def bits(text):
        data = bytes([END]) * depth + lower(text) + bytes([END])
        for at in range(depth, len(data)):
            for k in range(8):
                yield data[at - depth : at], (1 << k) | (data[at] >> (8 - k)), data[at] >> (7 - k) & 1

    for _, text, learn, *_ in docs:
        for context, node, bit in bits(text) if learn else ():
            for d in range(depth + 1):
                counts[context[depth - d :], node, bit] += 1
    children = {}
    for context, node, _ in counts:
        if context:
            children.setdefault((context[1:], node), set()).add(context)
    known = {}

    def weighted(context, node):
        if (context, node) not in known:
            own = kt(counts[context, node, 0], counts[context, node, 1])
            if len(context) < depth:
                deeper = sum(weighted(c, node) for c in sorted(children.get((context, node), ())))
                a, b = math.log(0.5) + own, math.log(0.5) + deeper
                known[context, node] = max(a, b) + math.log1p(math.exp(-abs(a - b)))
            else:
                known[context, node] = own
        return known[context, node]

    def one(context, node, d):
        here = context[depth - d :]
        zeros, ones = counts[here, node, 0], counts[here, node, 1]
        p = (ones + 0.5) / (zeros + ones + 1)
        if d == depth or not any(counts[context[depth - d - 1 :], node, b] for b in (0, 1)):
            return p
        w = math.exp(math.log(0.5) + kt(zeros, ones) - weighted(here, node))
        return w * p + (1 - w) * one(context, node, d + 1)

    out = []
    for _, text, *_ in docs:
        total = 0.0
        for context, node, bit in bits(text):
            p = one(context, node, 0)
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def plain_tokens(docs):
    c = Counter(w for _, text, learn, *_ in docs if learn for w in [*lower(text).split(), b""])
    n, v, out = sum(c.values()), len(c), []
    for _, text, *_ in docs:
        words = [*lower(text).split(), b""]
        out.append((len(lower(text)), len(words), sum(c[w] > 0 for w in words), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words)))
    return out


def documents(n, seed):
    rng = random.Random(seed)
    stock = ["The ", "the cat ", "sat\t", "on  ", "a mat.\n", "été ", "日本", "x" * 9, "\x00", ""]
    return [(i, "".join(rng.choice(stock[: rng.choice([4, 10])]) for _ in range(rng.randint(0, 25))), rng.random() < 0.7, 5, 5, "clash") for i in range(n)]


@pytest.mark.parametrize("depth, size", [(3, 1 << 20), (4, 400), (5, 100), (6, 1 << 20)])
def test_against_the_definition(spark, depth, size):
    docs = [*documents(40, depth), (50, None, True, 1, 1, ""), (51, "", False, 1, 1, ""), (None, "The cat", None, 1, 1, ""), (52, "unseen QUIRK ÿ", False, 1, 1, "")]
    docs += docs[:4]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = score(df.select("doc_id", "text", "learn", "key", "n", "row"), F.col("learn"), ["doc_id", "text", "key"], depth=depth, size=size).collect()
    want = {}
    for d, s, t in zip(docs, plain(docs, depth), plain_tokens(docs)):
        want[d[0], d[1]] = (s, *t)
    assert Counter((r.doc_id, r.text) for r in got) == Counter(d[:2] for d in docs)
    for r in got:
        s, n_bytes, n_tokens, n_known, n, base = want[r.doc_id, r.text]
        assert (r.n_bytes, r.n_tokens, r.n_known, r.train_tokens, r.key) == (n_bytes, n_tokens, n_known, n, r.key)
        assert abs(r.score - s) < 1e-6 + (n_bytes + 1) / GRAIN and abs(r.base_score - base) < 1e-9
        assert abs(r.bits_per_byte + s / math.log10(2) / (n_bytes + 1)) < 1e-5


def test_same_scores_however_dealt(spark):
    df = spark.createDataFrame(documents(60, 9), SCHEMA)
    run = lambda parts, size: {r.doc_id: r.score for r in score(df.repartition(parts), F.col("learn"), ["doc_id"], size=size).collect()}
    assert run(1, 1 << 20) == run(7, 150)


def test_probabilities_of_all_bytes_add_up(spark):
    docs = [(i, "ab" * i + "b", True, 0, 0, "") for i in range(6)]
    last = [(100 + b, chr(b), False, 0, 0, "") for b in range(128)]
    got = score(spark.createDataFrame(docs + last, SCHEMA), F.col("learn"), ["doc_id"], depth=3)
    # the first byte's probability: a text of one byte less its end, which is asked for after that byte alone
    first = {r.doc_id: r.score for r in got.collect() if r.doc_id >= 100}
    assert sum(10**s for s in first.values()) < 1 and first[100 + ord("b")] == max(first.values())


def test_better_than_tokens_on_unseen_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learn = remainder(F.col("doc_id"), 7) != 2
    got = score(docs, learn, ["doc_id"], depth=5).filter("not _trained").agg(F.sum("bits_per_byte") / F.count("*")).first()[0]
    assert got < 2.6  # eight before anything is learned


def test_edges(spark):
    none = score(spark.createDataFrame([], SCHEMA), F.col("learn"), ["doc_id"])
    assert none.count() == 0 and none.columns[-1] == "bits_per_byte"
    blank = score(spark.createDataFrame([(1, "ab", False, 0, 0, "")], SCHEMA), F.col("learn"), ["doc_id"]).first()
    assert abs(blank.score - 24 * math.log10(0.5)) < 3 / GRAIN and blank.train_tokens == 0 and blank.base_score == 0
    long = score(spark.createDataFrame([(1, "long text " * 400_000, True, 0, 0, ""), (2, "long", False, 0, 0, "")], SCHEMA), F.col("learn"), ["doc_id"], size=1 << 20).collect()
    assert {r.doc_id: r.n_tokens for r in long} == {1: 800_001, 2: 2}
    with pytest.raises(ValueError, match="depth"):
        score(none, F.lit(True), [], depth=7)


def test_strings_and_log_gamma():
    keys, first = strings([b"ab", b"", b"c"], 3)
    number = lambda *b: sum(x << (8 * i) for i, x in enumerate(b))
    a, b, c, e = *b"abc", END
    assert keys.tolist() == [number(a, e, e, e), number(b, e, e, a), number(e, e, a, b), number(e, e, e, e), number(c, e, e, e), number(e, e, e, c)]
    assert first.tolist() == [0, 3, 4]
    n = np.array([0, 1, 5, 4095, 4096, 100_000, 10**9])
    assert np.allclose(rising(n, HALVES, 0.5), [math.lgamma(x + 0.5) - math.lgamma(0.5) for x in n.tolist()], rtol=1e-12)
    assert np.allclose(rising(n, WHOLES, 1.0), [math.lgamma(x + 1) for x in n.tolist()], rtol=1e-12)
    assert np.allclose(log_kt(n, n[::-1].copy()), [kt(x, y) for x, y in zip(n.tolist(), n[::-1].tolist())], rtol=1e-6)


def test_lookup():
    rng = np.random.default_rng(3)
    keys, n = counted(rng.integers(0, 1 << 47, 20_000) // 1000 * 1000 % 99_991_000)
    found = Lookup(np.concatenate([keys, keys[:50]]), np.concatenate([n, n[:50]]))
    asked = rng.permutation(np.repeat(np.arange(len(keys)), 2))
    assert (found.find(keys[asked]) == n[asked]).all() and n.sum() == 20_000
    assert Lookup(keys[:1], n[:1]).find(keys[[0, 0]]).tolist() == [n[0]] * 2


def test_lookup_takes_little_beside_its_keys():
    """A slice's keys are its task's largest table: some 80 bytes a key on the way took an executor over its memory."""
    keys = np.random.default_rng(5).permutation(np.arange(400_000) * 7919)
    tracemalloc.start()
    found = Lookup(keys, keys.astype(np.int32))
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 50 * len(keys) and held < 25 * len(keys)
    assert (found.find(keys[::3]) == keys[::3].astype(np.int32)).all()


def test_runs_are_merged_piece_by_piece():
    rng = np.random.default_rng(6)
    for n, some in [(0, 9), (1, 9), (4, 9), (7, 2000), (60, 100)]:
        runs = [counted(rng.integers(0, 1 << rng.integers(1, 40), rng.integers(0, 5000))) for _ in range(n)]
        got = list(merged(runs, some))
        assert all(len(k) <= 2 * some + n for k, _ in got)
        want = Counter()
        for k, c in runs:
            want.update(dict(zip(k.tolist(), c.tolist())))
        assert [(k, c) for ks, cs in got for k, c in zip(ks.tolist(), cs.tolist())] == sorted(want.items())


def test_counts_of_tokens_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(tree_weighting, "hashed", lambda tokens: np.array([len(t) for t in tokens], np.int64))
    count = Counts([(pa.array([b"a", b"bb"], pa.binary()), np.array([3, 5])), (pa.array([b"", b"cc", b"a"], pa.binary()), np.array([0, 7, 3]))])
    assert count.find([b"cc", b"bb", b"a", b"", b"bb"]).tolist() == [7, 5, 3, 0, 5]
    assert sorted(count.odd) == [b"bb", b"cc"]


def test_freed_memory_is_handed_back():
    """A worker between two tasks kept over 100 MB, which were missing to the executor's next stage."""

    def held():
        return int(next(line for line in open("/proc/self/status") if line.startswith("VmRSS")).split()[1]) >> 10

    before = held()
    many = [np.ones(8_000) for _ in range(4_000)]  # 256 MB in pieces that malloc doesn't map one by one
    last = np.ones(8_000)
    assert held() - before > 200
    del many
    hand_back()
    assert held() - before < 60 and last.sum() == 8_000
