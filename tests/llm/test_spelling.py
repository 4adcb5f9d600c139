"""Near words, forms and roots against all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fleetops.llm.spelling import keys, near_words, neighbourhood, reduced, spelling_variants, vocabulary
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, word string, n int"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_vocabulary(docs, least, times, every):
    found = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += len(run) >= least
    return {w: n for w, n in found.items() if n >= times and len(w) >= least}


def plain_variants(words, factor=2):
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {w: min(near[w], key=lambda o: (-words[o], o), default=None) for w in words}
    form = {w: o if o and words[o] >= factor * words[w] else None for w, o in form.items()}
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def texts(n, seed, letters="abcdeéÉÄZ"):
    rng = random.Random(seed)
    stock = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(120)]
    return [(i % (n - 3), " ".join(rng.choice(stock) for _ in range(60)) + rng.choice([".", "1x", "\nşabcde"])) for i in range(n)]


@pytest.mark.parametrize("every", [None, 5])
def test_against_all_pairs(spark, every):
    docs = [*texts(40, 3), (None, "abcde abcde Abcde ABCDé"), (7, None), (8, ""), (9, "abcde×÷ abcdf")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    want = plain_vocabulary(docs, 3, 2, every)
    found = vocabulary(df.repartition(5), least=3, times=2, every=every)
    assert {r.word: r.n for r in found.collect()} == want
    got = spelling_variants(found).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == plain_variants(want)


def test_roots_of_long_ways(spark):
    words = {"a" * (9 - i) + "b" * i: 2**i for i in range(10)} | {"aaaaaaaab" + "c" * k: 1 for k in range(1, 4)}
    got = spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {tuple(r) for r in got} == plain_variants(words) and {r.word: r.root for r in got}["aaaaaaaaa"] == "bbbbbbbbb"


@pytest.mark.parametrize("symbols", [2, 3, 8])
def test_every_near_pair_meets(spark, symbols):
    rng = random.Random(symbols)
    words = {"".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))): rng.randint(1, 9) for _ in range(300)}
    words |= {"日本語": 3, "日本": 7, "x" * 3000: 1, "x" * 3001: 2, "x" * 1500 + "y" + "x" * 1500: 5}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [(r.word, r.other) for r in near_words(df, symbols).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_neighbourhood_is_the_lesser_half(spark):
    word = "abacus"
    digits = reduced(np.frombuffer(word.encode("utf-32-le"), np.uint32), 4).reshape(1, -1)
    itself, without, other = neighbourhood(digits, 4)
    key = lambda d: neighbourhood(np.array([d], np.uint64), 4)[0][0]
    d = digits[0].tolist()
    assert itself[0] == key(d)
    assert without[0].tolist() == [key(d[:i] + d[i + 1 :]) for i in range(6)]
    assert {x for x in other.ravel().tolist() if x} == {key(d[:i] + [s] + d[i + 1 :]) for i in range(6) for s in range(d[i] + 1, 5)}


def test_edges(spark):
    none = spelling_variants(vocabulary(spark.createDataFrame([], SCHEMA)))
    assert none.count() == 0 and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    alone = spelling_variants(spark.createDataFrame([("alone", 3)], "word string, n long")).collect()
    assert [tuple(r) for r in alone] == [("alone", None, "alone", 3, 0, None)]
    long = spark.createDataFrame([(1, "a" * 200_000 + " " + "word " * 100_000, "w", 1)] * 3, SCHEMA)
    got = {len(r.word): r.n for r in vocabulary(long, least=4).collect()}
    assert got == {200_000: 3, 4: 300_000}
    once = keys(spark.createDataFrame([(1, "aaaa")], "_id long, word string")).groupBy("_key").count()
    assert once.agg(F.max("count")).first()[0] == 1
