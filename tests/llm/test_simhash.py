import random
import re

import numpy as np
import pytest
import xxhash

from fleetops.llm.components import components
from fleetops.llm.simhash import fingerprint, links, masks, near_dedup

SCHEMA = "doc_id long, text string, fingerprint string"


def plain(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One two", "a b c", "a  b\tc\nd É é", "x y z " * 700, "  nbsp is no space"])
def test_fingerprint(text):
    assert fingerprint(text) == int(np.uint64(plain(text)).astype(np.int64))


def test_masks_cover_every_pair_of_bytes():
    for a in range(64):
        for b in range(64):
            assert any(not m >> a & 1 and not m >> b & 1 for m in masks(2))


@pytest.mark.parametrize("short", [1, 4, 32])
def test_links_join_what_is_near(spark, short):
    rng = random.Random(7)
    nodes = set()
    for _ in range(6):  # chains and clouds of near fingerprints
        x = rng.getrandbits(64)
        for _ in range(25):
            nodes.add(x)
            x ^= 1 << rng.randrange(64)
            x ^= (1 << rng.randrange(64)) if rng.random() < 0.5 else 0
            x ^= (7 << rng.randrange(60)) if rng.random() < 0.1 else 0
    nodes = [int(np.uint64(n).astype(np.int64)) for n in nodes]
    distance = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    found = links(spark.createDataFrame([(n,) for n in nodes], "fp long"), short=short)
    assert all(distance(r.a, r.b) <= 2 for r in found.collect())
    got = {r.node: r.root for r in components(found).collect()}
    want = roots(nodes, lambda a, b: distance(a, b) <= 2)
    assert {n: got.get(n, n) for n in nodes} == want


def test_near_dedup_edges(spark):
    rows = [(3, "same text here", "x"), (1, "Same  text here", "x"), (None, "same text here", "x"), (3, "same text here", "x"), (9, None, None), (8, "", None), (7, "other words entirely", None)]
    out = near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id or 0, r.component_id, r.is_first) for r in out)) == [(0, 1, False), (1, 1, True), (3, 1, False), (3, 1, False), (7, 7, True), (8, 8, True), (9, 8, False)]
    assert {r.fingerprint for r in out if not r.text} == {"0" * 16}


def test_a_very_long_text(spark):
    text = " ".join(f"word{i % 9973}" for i in range(400_000))
    out = near_dedup(spark.createDataFrame([(2, text, ""), (1, text.upper(), ""), (3, "another text", "")], SCHEMA)).collect()
    assert {r.doc_id: (r.component_id, r.fingerprint == format(plain(text), "016x")) for r in out} == {1: (1, True), 2: (1, True), 3: (3, False)}


def test_empty(spark):
    assert near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_long_chain(spark):
    n = 300
    got = components(spark.createDataFrame([(i + 1, i) for i in range(n)] + [(5, 5), (None, 3)], "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in got) == [(i, 0) for i in range(n + 1)]
