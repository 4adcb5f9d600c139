import zlib

import numpy as np
from pyspark.sql import functions as F

from fleetops.llm import langid
from fleetops.llm.queries import op6_byte_cnn

SF = "/root/testdata/sf0.001"


def test_pair_tables_give_the_same_responses():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    one = x.astype(np.intp)
    two = one[:, :-1] * 256 + one[:, 1:]
    for width in (1, 2, 3, 4, 5):
        table = rng.normal(size=(width, 256, langid.FILTERS)).astype(np.float32)
        got = langid.pooled(one, two, width, langid.paired(table)) if width > 1 else langid.responses(x, table).max(axis=1)
        assert np.allclose(got, langid.responses(x, table).max(axis=1), atol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op6_byte_cnn(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_edges(spark):
    net = langid.train([("the cat and the dog " * 9, "en"), ("der hund und die katze " * 9, "de")] * 8)
    schema = "doc_id long, text string, score string"
    texts = [None, "", "123 $% ²½_", "the dog and the cat", "the dog and the cat", "und der hund " * 20000, "é"]
    out = langid.identify(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], schema), net)
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    got = [r.lang_pred for r in out.orderBy("doc_id").collect()]
    assert got[:6] == ["und", "und", "und", "en", "en", "de"] and got[6] in ("en", "de")
    assert langid.identify(spark.createDataFrame([], schema), net).count() == 0
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "words", "")], schema), None).collect()} == {"und"}


def plain_predict(net, text):
    """The forward pass by loops: every window, place and filter."""
    raw = (text or "").lower().encode()
    total = np.zeros(len(net.langs))
    for at in range(0, len(raw), langid.WINDOW):
        w = raw[at : at + langid.WINDOW]
        x = w.ljust(langid.WINDOW, b"\0")
        feat = []
        for table in net.tables:
            r = [sum(table[k][x[i + k]] for k in range(len(table))) for i in range(len(x) - len(table) + 1)]
            feat += np.max(r, axis=0).tolist()
        z = np.maximum(np.array(feat) + net.bias, 0) @ net.dense + net.dense_bias
        e = np.exp(z - z.max())
        total += e / e.sum() * sum(b != 0 for b in w)
    return total / total.sum()


def test_predictions_against_a_plain_forward_pass():
    net = langid.train([("the cat and the dog " * 9, "en"), ("der hund und die katze " * 9, "de"), ("le chat et le chien " * 9, "fr")] * 8)
    texts = ["the cat", "É der hund " * 60, "x" * 256, "y" * 257, "le " * 300 + "the " * 100]
    for text, (lang, score) in zip(texts, langid.predict(net, texts)):
        p = plain_predict(net, text)
        assert lang == net.langs[int(p.argmax())] and abs(score - p.max()) < 1e-4


def test_whole_texts_are_learned_from(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "train", lambda samples: seen.extend(samples))
    rows = [(i % 40, f"{i % 40} " + "some words " * 500, "en") for i in range(400)] + [(1, "kurz", "de"), (2, None, "de"), (3, "x", None)]
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5), per_lang=30)
    assert sorted(len(t) for t, lang in seen if lang == "en")[0] > 5000 and sum(lang == "en" for _, lang in seen) == len({t for t, lang in seen if lang == "en"}) == 30
    assert [t for t, lang in seen if lang == "de"] == ["kurz"]
    seen.clear()
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), lang_bytes=12_000)
    assert sum(lang == "en" for _, lang in seen) == 3


def test_nothing_labelled(spark):
    assert langid.fit(spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string").filter(F.col("doc_id") > 0)) is None


def test_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(5)
    tables = [rng.normal(size=(w, 256, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS]
    n = langid.FILTERS * len(tables)
    net = langid.Net(["a", "b", "c"], tables, rng.normal(size=n).astype(np.float32), rng.normal(size=(n, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32))
    texts = ["".join(map(chr, rng.integers(97, 123, rng.integers(1, 900)))) for _ in range(120)]
    assert langid.predict(net, texts) == [langid.predict(net, [t])[0] for t in texts]
