import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from fleetops.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, kept string"


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        spans, at = [], 0
        while (a := covered.find(1, at)) >= 0:
            at = covered.find(0, a)
            at = len(b) if at < 0 else at
            spans.append((a, at))
        out.append((spans, bytes(x for x, c in zip(b, covered, strict=True) if not c)))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé ", k=rng.randrange(1, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(rng.randrange(20, 120)) for _ in range(6)]
    out = [None, "", "short", "ab" * 400, "a" * 700, "a" * 200, "xyz" * 90]
    for _ in range(n):
        parts = [text(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            piece = rng.choice(shared)
            a = rng.randrange(len(piece) // 3)
            parts += [piece[a : len(piece) - rng.randrange(len(piece) // 3)], text(rng.randrange(30))]
        out.append("".join(parts))
    for _ in range(n // 2):  # copies, some with a change
        t = list(rng.choice(out[7:]))
        for _ in range(rng.randrange(3)):
            if t:
                t[rng.randrange(len(t))] = "#"
        out.append("".join(t))
    return out


def check(spark, texts, length, **options):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    out = {r.doc_id: r for r in S.suffix_dedup(df, length, **options).collect()}
    assert len(out) == len(texts)
    for i, (spans, kept) in enumerate(brute(texts, length)):
        assert [(s.start, s.end) for s in out[i].spans] == spans
        assert bytes(out[i].kept) == kept
        assert hashlib.sha256(out[i].kept).hexdigest() == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize(("seed", "length", "crowd", "run"), [(1, 200, 10**6, 1 << 20), (2, 200, 3, 1 << 20), (3, 64, 10**6, 300), (4, 40, 1, 1 << 20)])
def test_brute_force(spark, monkeypatch, seed, length, crowd, run):
    monkeypatch.setattr(S, "RUN", run)
    check(spark, corpus(seed), length, crowd=crowd)


@pytest.mark.parametrize("least", [2, 12])
def test_hot_triggers_change_nothing(spark, monkeypatch, least):
    monkeypatch.setattr(S, "SAMPLE", 1)
    monkeypatch.setattr(S, "HOT_LEAST", least)
    passage = " ".join(f"passage{i}" for i in range(60))
    texts = [f"before {i} {passage} after {i} and some more words {i * 7}" for i in range(30)]
    for i in range(30):  # near copies, some with the same change
        at = (i * 37 % 400) // 3 * 3
        texts.append(f"x{i % 7} " + passage[:at] + "#" * (i % 3) + passage[at + i % 3 :] + " the end")
    check(spark, [*corpus(5, 20), *texts, *texts[::5]], 200)


def test_runs_alike():
    assert S.alike(b"xxabcdyy", 3, b"abcdz", 1) == (2, 6)
    assert S.alike(b"abcd", 1, b"abcd", 1) == (0, 4)
    assert S.alike(b"abcd", 2, b"cd", 0) == (2, 4)
    assert S.alike(b"abxd", 2, b"abcd", 2) == (0, 2)


def test_order_of_suffixes():
    rng = random.Random(3)
    words = [bytes(rng.choices(b"ab\0", k=rng.randrange(1, 40))) for _ in range(60)]
    got = S.suffix_ranks(words, 40)
    suffixes = [w[i:] for w in words for i in range(len(w))]
    order = sorted(set(suffixes))
    assert got.tolist() == [order.index(x) for x in suffixes]
    follows = sorted({bytes(rng.choices(b"a\0", k=rng.randrange(9))) for _ in range(200)})
    plain = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(follows, follows[1:])]
    lcp = S.common(follows)
    assert lcp.tolist() == plain
    pairs = [(a, b) for a in range(len(lcp)) for b in range(a + 1, len(lcp) + 1)]
    assert S.least_between(lcp, *(np.array(x) for x in zip(*pairs))).tolist() == [min(plain[a:b]) for a, b in pairs]


def test_empty(spark):
    assert S.suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
