import math
import random
from collections import Counter

import pytest

from fleetops.llm.decontaminate import build, contamination, matches, retrieve, shingles, words

LINES = ["what is the tallest mountain on the far side of the moon as seen by probes", "it is the one named after the old clock maker"]
ITEM = "\n".join(LINES)


def test_edges(spark):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "only four words here"), (5, ITEM)], "item_id long, text string")
    docs = [
        (1, "Before. " + ITEM.upper().replace(" ", "  ") + " after", 7),
        (2, None, 7),
        (3, "", 7),
        (4, "we have only four words here and more", 7),
        (5, "nothing of the kind " * 50, 7),
        (6, LINES[0], 7),
        (6, LINES[0], 7),
        (7, "filler words " * 5000 + ITEM, 7),
    ]
    out = contamination(spark.createDataFrame(docs, "doc_id long, text string, matches int"), items)
    assert out.columns == ["doc_id", "text", "matches"]
    got = {(r.doc_id, m.item_id) for r in out.collect() for m in r.matches}
    assert got == {(1, 1), (1, 5), (4, 4), (7, 1), (7, 5)}
    parts = contamination(spark.createDataFrame(docs, "doc_id long, text string, matches int"), items, index_bytes=40)
    assert sorted(map(tuple, parts.select("doc_id", "matches").collect())) == sorted(map(tuple, out.select("doc_id", "matches").collect()))


def test_parts_change_no_score(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.filter("doc_id < 300")  # the test's own fixture
    whole, parts = (sorted(tuple(m) for r in contamination(docs, items, index_bytes=n).collect() for m in r.matches) for n in (1 << 22, 20_000))
    assert len(whole) > 3 and len(parts) == len(whole)
    for a, b in zip(whole, parts):
        assert a[:2] == b[:2] and all(abs(x - y) < 1e-9 for x, y in zip(a[2:], b[2:]))


def plain_scores(items, passage):
    """BM25 of all items for one passage, divided by nothing."""
    tokens = {i: words(t) for i, t in items}
    n, mean, df_of = len(items), sum(map(len, tokens.values())) / len(items), Counter(t for w in tokens.values() for t in set(w))
    out = {}
    for i, w in tokens.items():
        s = 0.0
        for t in set(w) & set(passage):
            df, f = df_of[t], w.count(t)
            s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean))
        out[i] = s
    return out


@pytest.mark.parametrize("seed", range(2))
def test_wand_against_all_scores(seed):
    """Everything above any threshold, with its score; the higher the threshold, the fewer postings are looked at."""
    rng = random.Random(seed)
    vocab = [f"w{int(rng.paretovariate(0.5))}" for _ in range(5000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(5, 40)))) for i in range(300)]
    index = build(items)
    texts = [[*rng.choices(vocab, k=rng.randrange(150)), *items[rng.randrange(300)][1].split(), *rng.choices(vocab, k=rng.randrange(150))] for _ in range(12)]
    looked = {}
    for least in (0.3, 0.6, 1.0):
        count = []
        got = {(t, at, i): s for t, at, i, s in retrieve(index, texts, least, count)}
        looked[least] = sum(count)
        want = {}
        for t, text in enumerate(texts):
            for at in range(0, len(text), index.span):
                for i, s in plain_scores(items, text[at : at + 2 * index.span]).items():
                    if s >= least * index.need[i]:
                        want[t, at, i] = s
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    listed = sum(index.begin[(index.terms[w] + 1) * index.top.shape[1]] - index.begin[index.terms[w] * index.top.shape[1]] for text in texts for at in range(0, len(text), index.span) for w in set(text[at : at + 2 * index.span]) & set(index.terms))
    assert looked[1.0] < looked[0.6] < looked[0.3] and looked[1.0] < 0.8 * listed


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), none).first().matches == []
    assert contamination(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_all_that_reach_the_similarity_are_retrieved(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(5, 40)))) for i in range(40)]
    texts = []
    for _ in range(120):
        item = rng.choice(items)[1].split()
        for _ in range(rng.randrange(3)):
            item[rng.randrange(len(item))] = "changed"
        item = item[rng.randrange(4) : len(item) - rng.randrange(4)]
        pad = lambda: rng.choices(vocab, k=rng.randrange(120))
        texts.append(" ".join([*pad(), *item, *pad()]))
    got = {(t, m["item_id"]) for t, ms in enumerate(matches(build(items), texts)) for m in ms}
    whole = {(t, i) for t, x in enumerate(texts) for i, y in items if len(shingles(words(y)) & shingles(words(x))) >= 0.8 * len(shingles(words(y))) - 1e-9}
    assert got == whole
