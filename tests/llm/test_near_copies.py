import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from fleetops.llm import near_copies as index
from fleetops.llm.common import table
from fleetops.llm.near_copies import joined, near_copies
from tests.llm.test_simhash import roots

SCHEMA = "doc_id long, text string, component_id string"


def shingles(text, k=5):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return frozenset(" ".join(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([" ".join(words)] * bool(words))


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b) > 0


def components(texts):
    """The smallest document that each reaches, by comparing all pairs."""
    by = {}
    for d in sorted(texts):
        by.setdefault(shingles(texts[d]), d)
    sets = {d: s for s, d in by.items()}
    root = roots(sorted(sets), lambda a, b: near(sets[a], sets[b]))
    return {d: root[by[shingles(t)]] for d, t in texts.items()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("options", [{}, {"short": 2, "block": 1 << 20}, {"short": 2, "block": 900}])
def test_components_are_those_of_all_pairs(spark, options):
    rng, texts = random.Random(3), {}
    for family in range(5):  # from near copies to texts below the similarity, and chains
        words = [f"f{family}w{rng.randrange(10**6)}" for _ in range(120)]
        for n in range(30):
            texts[len(texts)] = edited(rng, words, n % 6)
            if n % 3 == 0:
                words = texts[len(texts) - 1].split()
    texts |= {200: None, 201: " \n", 202: "One two", 203: "one  TWO", 204: "one three"}
    want = components(texts)
    assert 10 < len(set(want.values())) < 150
    out = near_copies(spark.createDataFrame([(d, t, "x") for d, t in texts.items()], SCHEMA), **options)
    assert out.columns == ["doc_id", "text", "component_id", "is_first"]
    got = out.collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id for r in got if r.is_first} == set(want.values())


def test_joined_needs_no_pairs():
    sets = [np.arange(100) + (k % 3 == 0) for k in range(50)]
    assert len(list(joined(sets, 0.8))) == 49
    assert list(joined([np.arange(8), np.arange(10), np.arange(7)], 0.8)) == [(0, 1), (0, 2)]
    assert list(joined([np.arange(10), np.arange(7), np.arange(20, 25)], 0.8)) == []


def test_stage_finds_near_copies_of_the_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = components({r.doc_id: r.text for r in docs.collect()})
    out = corpus_pipeline.near_duplicates(spark, docs, "/root/testdata/sf0.01")
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert sorted(ids) == sorted(set(want.values()))


def test_edges(spark):
    assert near_copies(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e f", "x"), (4, "a b c d e f", "x"), (4, "a b c d e f", "x"), (None, "g h", "x")]
    out = near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.is_first) for r in out) == [(0, 0, True), (0, 4, False), (4, 4, False), (4, 4, True)]


def test_fingerprint_is_the_majority_of_the_shingles_bits():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 254, 255, 256, 1000):
        found = np.unique(rng.integers(-(1 << 63), 1 << 63, n))
        rows = index.bits(found).astype(int)
        want = [int(2 * rows[:, b].sum() + rows[0, b] > n) for b in range(576)]
        assert want == [w >> b & 1 for w in index.fingerprint(found) for b in range(64)]
    assert index.fingerprint(np.array([], np.int64)) == []
    pool = rng.integers(-(1 << 63), 1 << 63, (200, 1000))
    prints = np.array([[index.fingerprint(np.sort(x)) for x in (p[:900], p[100:], p[:450])] for p in pool]).view(np.uint64)
    differ = lambda a, b: np.bitwise_count(prints[:, a] ^ prints[:, b]).sum() / (200 * 576)
    assert abs(differ(0, 1) - 0.1515) < 0.005  # at a similarity of 0.8
    assert abs(np.bitwise_count(prints[1:, 0] ^ prints[:-1, 0]).mean() / 64 - 0.5) < 0.01


def prints(rng):
    """Clouds of near fingerprints, chains, and strangers."""
    found = set()
    for cloud in range(6):
        x = [rng.getrandbits(64) for _ in range(9)]
        for n in range(40):
            y = list(x)
            for _ in range(rng.choice([5, 40, 90, 130])):
                y[rng.randrange(9)] ^= 1 << rng.randrange(64)
            found.add(tuple(y))
            x = y if cloud > 2 and n % 4 == 0 else x
    found |= {tuple(rng.getrandbits(64) for _ in range(9)) for _ in range(60)}
    return [[w - (1 << 64) if w >> 63 else w for w in p] for p in sorted(found)]


def meets(a, b):
    """A group in which two bytes at least are shared and up to LIMIT bits differ."""
    x = np.array(a).view(np.uint8).reshape(3, 24) ^ np.array(b).view(np.uint8).reshape(3, 24)
    return bool((((x == 0).sum(axis=1) >= 2) & (np.bitwise_count(x).sum(axis=1) <= index.LIMIT)).any())


@pytest.mark.parametrize("short", [1, 3, 32])
def test_families_are_those_of_all_pairs_of_fingerprints(spark, short):
    found = prints(random.Random(5))
    nodes = spark.createDataFrame([(k, 9, p) for k, p in enumerate(found)] + [(1000, 0, [])], index.SKETCH)
    got = {r.node: r.root for r in index.families(nodes, short).collect()}
    want = roots(range(len(found)), lambda a, b: meets(found[a], found[b]))
    assert 20 < len(set(want.values())) < 200
    assert {k: got.get(k, k) for k in want} == want and 1000 not in got


@pytest.mark.parametrize("chunk", [1, 50, 1 << 17])
def test_lists_are_whole_wherever_batches_end(monkeypatch, chunk):
    monkeypatch.setattr(index, "CHUNK", chunk)
    rng = random.Random(6)
    found = prints(rng)[:60]
    words = np.array(found).reshape(-1, 3, 3)
    rows = sorted((256 * (23 * g + p) + int(words[k, g].view(np.uint8)[p]), *words[k, g].tolist(), k) for k in range(len(found)) for g in range(3) for p in range(23))
    batches = [pa.RecordBatch.from_pylist([dict(zip(["value", "w0", "w1", "w2", "node"], r)) for r in rows[i : i + 7]]) for i in range(0, len(rows), 7)]
    pairs = {(a, b) for out in index.meeting(32)(iter(batches)) for a, b in zip(*(c.to_pylist() for c in out.columns))}
    near = lambda a, b: (a, b) in pairs or (b, a) in pairs
    assert roots(range(60), near) == roots(range(60), lambda a, b: meets(found[a], found[b]))


def test_joined_passes_over_the_largest_component():
    rng = np.random.default_rng(2)
    for _ in range(30):
        sets = [np.unique(rng.choice(24, 20)) if k % 4 else np.unique(rng.choice(40, 14)) for k in range(40)]
        near = lambda a, b: 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))
        found = list(joined(sets, 0.8))
        assert all(near(a, b) for a, b in found) and len(found) < 40
        assert roots(range(40), lambda a, b: (a, b) in found or (b, a) in found) == roots(range(40), near)
