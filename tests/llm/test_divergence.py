"""Pointers, counts and divergences against plain loops."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fleetops.llm.divergence import divergence, pieces, sort_pointers, term_counts, term_starts

SCHEMA = "text string, lang string, source string, term string, n int, rank string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def documents(n, seed):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcÄé日x") for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 30]))) for _ in range(50)]
    out = []
    for i in range(n):
        text = rng.choice([" ", "-", ".1"]).join(rng.choice(stock[: rng.choice([5, 20, 50])]) for _ in range(rng.randint(0, 40)))
        out.append((rng.choice([text, text.upper(), "\x00" + text]), rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", "", None])))
    return [*out, (None, "en", "only null"), ("", "fr", "x"), ("word word", "fr", "y"), ("12 []", "xx", "alone"), (None, None, None)]


def plain_counts(docs):
    n, held = Counter(), Counter()
    for text, lang, source in docs:
        found = Counter(terms(text))
        for t, k in found.items():
            n[lang or "", source or "", t] += k
            held[lang or "", source or "", t] += 1
    return {k: (n[k], held[k]) for k in n}


def plain(docs, min_docs, top):
    counts, in_docs = plain_counts(docs), Counter()
    for (lang, _, t), (_, d) in counts.items():
        in_docs[lang, t] += d
    kept = defaultdict(list)
    for (lang, t), d in in_docs.items():
        if d >= min_docs:
            kept[lang].append(t)
    groups, out = {(g or "", s or "") for _, g, s in docs}, set()
    n = lambda g, t: counts.get((*g, t), (0,))[0]
    for lang in {g for g, _ in groups}:
        own, v = [g for g in groups if g[0] == lang], len(kept[lang])
        share = lambda c, total: 1 + 1_000_000_000 * (c + 2) // (total + 2 * v)  # noqa: E731, B023
        total = {g: sum(n(g, t) for t in kept[lang]) for g in own}
        p = {g: {t: share(n(g, t), total[g]) for t in kept[lang]} for g in own}
        q = {t: share(sum(n(g, t) for g in own), sum(total.values())) for t in kept[lang]}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for g in own:
            pairs = [(-sum(f(p[g][t], p[o][t]) for t in kept[lang]), o[1].encode(), o[1]) for o in own if o != g]
            marks = [(-f(p[g][t], q[t]), t.encode(), t) for t in kept[lang] if n(g, t) and p[g][t] > q[t]]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(marks)[:top])):
                out |= {(*g, part, item, -value, k + 1) for k, (value, _, item) in enumerate(rows)}
    return out


@pytest.mark.parametrize("size, block", [(8 << 20, 4096), (300, 7)])
def test_against_loops(spark, size, block):
    docs = documents(150, 4)
    docs += docs[:20]  # repeated rows
    df = spark.createDataFrame([(*d, "clash", 7, "r") for d in docs], SCHEMA).repartition(6)
    counts = term_counts(df, size=size).collect()
    assert {(r.lang, r.source, r.term): (r.n, r.docs) for r in counts} == plain_counts(docs)
    for min_docs, top in ((10, 10), (1, 3), (10_000, 10)):
        got = divergence(df, min_docs, top, size=size, block=block).collect()
        want = plain(docs, min_docs, top)
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_pointers_are_in_order_of_their_terms():
    rng = random.Random(1)
    words = ["a" * rng.randint(1, 40) + rng.choice(["", "b", "ba"]) for _ in range(400)]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, lengths = term_starts(raw, np.zeros(1, np.int64))
    order, run = sort_pointers(raw, starts, lengths)
    found = [words[i] for i in order]
    assert found == sorted(words) and run.tolist() == [sorted(set(words)).index(w) for w in found]
    starts, lengths = term_starts(np.frombuffer(b"abab", np.uint8), np.array([0, 0, 2, 2]))  # empty documents between
    assert starts.tolist() == [0, 2] and lengths.tolist() == [2, 2]


def test_pieces_cut_no_term():
    for text in ("aa bbb c dddd " * 9, "x" * 50, " ", "x" * 20 + " " + "y" * 20, ""):
        raw = np.frombuffer(text.encode(), np.uint8)
        found = [bytes(p).decode() for p in pieces(raw, 7)]
        assert "".join(found) == text and [t for p in found for t in terms(p)] == terms(text)


def test_very_long_text_and_no_rows(spark):
    long = "word other " * 200_000
    df = spark.createDataFrame([(long, "en", "a", "", 1, ""), ("word", "en", "a", "", 1, "")], SCHEMA)
    got = {r.term: (r.n, r.docs) for r in term_counts(df, size=1 << 16).collect()}
    assert got == {"word": (200_001, 2), "other": (200_000, 1)}
    none = divergence(df.limit(0))
    assert none.count() == 0 and none.columns == ["lang", "source", "part", "item", "value", "rank"]
