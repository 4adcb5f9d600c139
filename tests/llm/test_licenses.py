import random
import re
import time

import pytest

from fleetops.llm.licenses import TEMPLATES, license_scan

SCHEMA = "doc_id long, text string, template string"


def grams(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def corpus():
    rng = random.Random(5)
    noise = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 7))) for _ in range(n))
    out = [None, "", "MIT License", "license " * 4000, "Released under the MIT License.", "Released under the MIT License."]
    for text in TEMPLATES.values():
        words = text.split()
        for change in range(4):
            w = list(words)
            for _ in range(change if len(w) > 30 else 0):
                w[rng.randrange(len(w))] = "changed"
            out.append(f"{noise(rng.randrange(300))}\n{' '.join(w).upper() if change == 1 else ' '.join(w)}\n{noise(rng.randrange(300))}")
    out.append(noise(20000) + " " + TEMPLATES["MIT"] + " " + noise(5000))
    return out


@pytest.mark.parametrize("literals", [10_000, 0])
def test_brute_force(spark, literals):
    """By MinHash bands of all windows (no literals), and with the windows left out that can't meet a template."""
    texts = corpus()
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)
    got = {(r.doc_id, r.template): r.containment for r in license_scan(df, literals=literals).collect()}
    want = {}
    for i, t in enumerate(texts):
        have = set(grams(t))
        for name, text in TEMPLATES.items():
            share = len(set(grams(text)) & have) / len(set(grams(text)))
            if share >= 0.8:
                want[i, name] = share
    assert got == want


def test_own_templates_and_empty(spark):
    df = spark.createDataFrame([(1, "x all rights reserved by the owner y", ""), (1, "x all rights reserved by the owner y", ""), (None, "all rights reserved by the owner", "")], SCHEMA)
    rows = license_scan(df, {"own": "All rights reserved by the owner", "short": "too few words"}).collect()
    assert sorted((r.doc_id or 0, r.template, r.containment) for r in rows) == [(0, "own", 1.0), (1, "own", 1.0), (1, "own", 1.0)]
    assert license_scan(df, {}).count() == 0
    assert license_scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_inserted_words(spark):
    """A clause of up to a quarter of the template in its middle, at every alignment of the windows."""
    words = TEMPLATES["MIT"].split()
    extra = [f"inserted{i}" for i in range(len(words) // 5)]
    texts = [" ".join([*(f"before{i}" for i in range(at)), *words[:30], *extra, *words[30:]]) for at in range(0, 130, 3)]
    got = {r.doc_id for r in license_scan(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)).filter("template = 'MIT'").collect()}
    assert got == set(range(len(texts)))


def test_a_long_text_full_of_notices(spark):
    began = time.monotonic()
    text = " ".join([TEMPLATES["MIT-notice"]] * 60_000)
    (r,) = license_scan(spark.createDataFrame([(1, text, "")], SCHEMA)).collect()
    assert r.template == "MIT-notice" and r.containment == 1.0 and time.monotonic() - began < 100
