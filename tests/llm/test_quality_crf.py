import zlib
from itertools import product

import numpy as np
import pytest

from fleetops.llm import quality_crf as Q
from fleetops.llm.queries import op1_line_crf

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("long", [0, 400])
def test_marginals_against_all_labellings(monkeypatch, long):
    monkeypatch.setattr(Q, "LONG", long)
    rng = np.random.default_rng(3)
    counts = np.array([1, 4, 2, 7])
    u, t = rng.normal(size=counts.sum()) * 2, rng.normal(size=(2, 2))
    a, b = Q.messages(u, counts, t)
    at = 0
    for n in counts:
        total = np.zeros((n, 2))
        for y in product((0, 1), repeat=int(n)):
            e = np.exp(sum(u[at + i] * y[i] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1)))
            for i in range(n):
                total[i, y[i]] += e
        assert np.allclose((a + b)[at : at + n], np.log(total[:, 1] / total[:, 0]))
        at += n


def test_held_out(spark):
    rows = {r.doc_id: r for r in op1_line_crf(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for k, r in rows.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.predicted, labels[k]) for k, r in rows.items() if r.held_out and k in labels]
    for y in (0, 1):
        assert np.mean([p == y for p, q in held if q == y]) > 0.9


def test_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = Q.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), per_label=100)
    schema = "doc_id long, text string, score string"
    texts = [None, "", " \n\n ", "A line.\n" * 3000, "$$$ ### !!! " * 50, "$$$ ### !!! " * 50, "One good line of plain prose."]
    out = Q.classify(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], schema), model, lines=True).orderBy("doc_id")
    assert out.columns == ["doc_id", "text", "score", "predicted", "line_scores"]
    rows = out.collect()
    assert rows[0].score == rows[1].score == rows[2].score
    assert rows[4].score == rows[5].score < 0.5 and len(rows[3].line_scores) == 3000 and len(rows[0].line_scores) == 1
    assert Q.classify(spark.createDataFrame([], schema), model).count() == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = Q.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in Q.classify(docs, model).collect()] == [0.5]


def test_repeated_keys_crowd_out_no_label(spark):
    docs = [(k, f"good line {k} of prose.") for k in (1, 2) for _ in range(3000)] + [(9, "$$$ ### !!!\n" * 4000), (9, "other text"), (None, "x")]
    labels = [(1, 1)] * 3000 + [(2, 1), (9, 0), (9, 0), (None, 1), (4, 7)]
    model = Q.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), per_label=2)
    assert np.any(model.weights)


def plain_score(model, text):
    """Features, chain and aggregation by loops over lines and labellings in log space."""
    lines = [x for x in (text or "").encode().split(b"\n") if x.strip()] or [b""]
    own, seen = [], set()
    for x in lines:
        kinds = [sum(int(Q.KIND[b]) == k for b in x) / max(1, len(x)) for k in range(8)]
        w = x.split()
        same = len(set(w)) / max(1, len(w))
        own.append([*kinds, len(w) ** 0.5 / 8, same, same < 0.5, min(20, len(x) / max(1, len(w))) / 10, x in seen, len(x) > 0 and x[-1:] in b".?!\"')", x[:1].isupper(), len(lines) == 1])
        seen.add(x)
    zero = [0.0] * Q.OWN
    u = []
    for i in range(len(lines)):
        f = [*own[i], *(own[i - 1] if i else zero), *(own[i + 1] if i + 1 < len(lines) else zero), 1.0]
        u.append(sum((float(a) - m) / s * w for a, m, s, w in zip(f, model.mean, model.scale, model.weights)))
    fore = [(0.0, u[0])]
    for x in u[1:]:
        fore.append(tuple(np.logaddexp(fore[-1][0] + model.transition[0, y], fore[-1][1] + model.transition[1, y]) + (x if y else 0) for y in (0, 1)))
    back = [(0.0, 0.0)]
    for x in reversed(u[1:]):
        back.append(tuple(np.logaddexp(back[-1][0] + model.transition[y, 0], back[-1][1] + x + model.transition[y, 1]) for y in (0, 1)))
    back.reverse()
    p = [1 / (1 + np.exp(f[0] + b[0] - f[1] - b[1])) for f, b in zip(fore, back)]
    q = sum(a * (len(x) + 1) for a, x in zip(p, lines)) / sum(len(x) + 1 for x in lines)
    q = min(max(q, 1e-6), 1 - 1e-6)
    return 1 / (1 + np.exp(-(model.link[0] * np.log(q / (1 - q)) + model.link[1])))


def test_scores_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = Q.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), per_label=60)
    texts = [None, "", "One line", "A line.\nA line.\n\n  \n$$$ ### !!!", *[r.text for r in docs.limit(60).collect()]]
    got = Q.classify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3), model).collect()
    for r in got:
        assert abs(r.score - plain_score(model, texts[r.doc_id])) < 1e-4
