"""Language identification by a byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fleetops.llm.common import sample

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: The sample to learn from: up to this many texts of each language, whole, in a hashed order, until they have so many bytes.
PER_LANG = 250
LANG_BYTES = 1 << 20

UND = "und"


class Net(NamedTuple):
    """Filters over one-hot bytes, so a filter's response is a sum of one table entry per byte."""

    langs: list[str]
    tables: list[np.ndarray]  # by width: (width, 256, FILTERS)
    bias: np.ndarray
    dense: np.ndarray  # (features, langs)
    dense_bias: np.ndarray


def windows(raw: bytes) -> np.ndarray:
    """The text in windows of fixed length, filled up with zero bytes."""
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def responses(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(windows, places, filters) of the filters of one width."""
    width = len(table)
    places = x.shape[1] - width + 1
    out = table[0][x[:, :places]]
    for k in range(1, width):
        out += table[k][x[:, k : k + places]]
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def paired(table: np.ndarray) -> list[np.ndarray]:
    """The filters of one width by two bytes at once: a table of 65,536 rows for each pair of places, and the last
    place's own table if the width is odd."""
    twos = [(table[k][:, None] + table[k + 1][None]).reshape(65536, -1) for k in range(0, len(table) - 1, 2)]
    return twos + ([table[-1]] if len(table) % 2 else [])


def pooled(x: np.ndarray, pairs: np.ndarray, width: int, tables: list[np.ndarray]) -> np.ndarray:
    """(windows, filters): the largest response of each filter of one width, as in `responses`."""
    places = x.shape[1] - width + 1
    out = np.take(tables[0], pairs[:, :places], axis=0)
    for k in range(1, len(tables)):
        at = pairs if len(tables[k]) == 65536 else x
        out += np.take(tables[k], at[:, 2 * k : 2 * k + places], axis=0)
    return out.max(axis=1)


def probabilities(net: Net, x: np.ndarray, lot: int = 32) -> np.ndarray:
    """(windows, langs): max pooling over the places, ReLU, softmax."""
    tables = [paired(t) for t in net.tables]
    parts = []
    for a in range(0, len(x), lot):
        one = x[a : a + lot].astype(np.intp)
        two = one[:, :-1] * 256 + one[:, 1:]
        parts.append(np.concatenate([pooled(one, two, len(t), ts) for t, ts in zip(net.tables, tables, strict=True)], axis=1))
    # summed window by window: a matrix product's last bits depend on how many windows it has
    return softmax(np.einsum("wf,fl->wl", np.maximum(np.concatenate(parts) + net.bias, 0), net.dense) + net.dense_bias)


def train(samples: list[tuple[str, str]], epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 42) -> Net | None:
    """Adam on the cross-entropy of single windows. Only the place that wins the pooling passes a gradient on."""
    langs = sorted({lang for _, lang in samples})
    if not langs:
        return None
    rows = [(w, langs.index(lang)) for text, lang in samples for w in windows(text.lower().encode("utf-8", "replace")) if np.count_nonzero(w) >= 8]
    x, y = np.array([w for w, _ in rows], np.uint8).reshape(-1, WINDOW), np.array([k for _, k in rows], np.int64)
    rng, n_feat = np.random.default_rng(seed), FILTERS * len(WIDTHS)
    p = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    p += [np.zeros(n_feat, np.float32), rng.normal(0, 0.1, (n_feat, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    weight = len(y) / (len(langs) * np.maximum(1, np.bincount(y, minlength=len(langs))))
    for _ in range(epochs if len(x) else 0):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            xb, yb = x[order[a : a + batch]], y[order[a : a + batch]]
            best, pooled = [], []
            for table in p[: len(WIDTHS)]:
                r = responses(xb, table)
                at = r.argmax(axis=1)
                best.append(at)
                pooled.append(np.take_along_axis(r, at[:, None], axis=1)[:, 0])
            feat = np.concatenate(pooled, axis=1) + p[-3]
            live = np.maximum(feat, 0)
            d = softmax(live @ p[-2] + p[-1])
            d[np.arange(len(yb)), yb] -= 1
            d *= weight[yb][:, None] / len(yb)
            back = (d @ p[-2].T) * (feat > 0)
            grads = []
            for k, (table, at) in enumerate(zip(p[: len(WIDTHS)], best, strict=True)):
                g, part = np.zeros_like(table), back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(len(table)):
                    np.add.at(g[j], (np.take_along_axis(xb, at + j, axis=1), np.arange(FILTERS)[None, :]), part)
                grads.append(g)
            grads += [back.sum(axis=0), live.T @ d, d.sum(axis=0)]
            step += 1
            for k, g in enumerate(grads):
                g = g.astype(np.float32)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Net(langs, [t.astype(np.float32) for t in p[: len(WIDTHS)]], p[-3].astype(np.float32), p[-2].astype(np.float32), p[-1].astype(np.float32))


def predict(net: Net | None, texts: list[str | None], lot_bytes: int = 1 << 20) -> list[tuple[str, float]]:
    """(language, score): the class of the windows' probabilities, averaged by the bytes in each window."""
    out: list[tuple[str, float]] = []
    held: list[bytes | None] = []
    size = 0

    def flush() -> None:
        nonlocal size
        parts = [windows(r) for r in held if r is not None]
        if parts:
            x = np.concatenate(parts)
            p = probabilities(net, x) * np.count_nonzero(x, axis=1)[:, None]
            at = np.cumsum([0, *(len(w) for w in parts)])[:-1]
            p = np.add.reduceat(p, at, axis=0)
            p = (p / p.sum(axis=1, keepdims=True)).astype(float)
            found = iter(zip(p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True))
        for r in held:
            if r is None:
                out.append((UND, 0.0))
            else:
                k, s = next(found)
                out.append((net.langs[k], s))
        held.clear()
        size = 0

    for text in texts:
        known = net is not None and any(map(str.isalpha, text or ""))
        held.append(text.lower().encode("utf-8", "replace") if known else None)
        size += len(held[-1] or b"")
        if size >= lot_bytes:
            flush()
    flush()
    return out


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo `by`; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % by


def fit(
    df: DataFrame, per_lang: int = PER_LANG, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id", lang_bytes: int = LANG_BYTES
) -> Net | None:
    """Learn from a bounded sample of labelled rows: up to per_lang texts of each non-null language in a hashed order, cut
    off after the text in which a language's bytes pass lang_bytes. Texts are taken whole; rows equal in key and text
    count once. The driver gets no more than the sample. None if nothing is labelled."""
    labelled = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(7), F.col(order_col), F.col(text_col)).alias("h"))
    some = sample(labelled, "lang", "h", per_lang)
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    some = some.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < lang_bytes)
    return train([(r.text, r.lang) for r in some.orderBy("lang", "nth").select("text", "lang").collect()])


def predictor(net: Broadcast):
    kind = T.StructType().add("lang_pred", T.StringType()).add("score", T.DoubleType())

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(predict(Net(*net.value) if net.value else None, list(texts)), columns=["lang_pred", "score"])

    return F.pandas_udf(run, kind)


def identify(df: DataFrame, net: Net | None, text_col: str = "text") -> DataFrame:
    """Adds `lang_pred` (a learned language, or `und` for a null text or one without a letter) and `score` (0 to 1;
    0 for `und`). Every byte of a text is in a window. Input columns of these names give way; an empty input gives an
    empty result; without a network (nothing learned) all are `und`. Of languages that tie the first in order is taken;
    repeated rows get the same answer, as does a row in any batch; a very long text is read window by window."""
    shared = df.sparkSession.sparkContext.broadcast(net and tuple(net))
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("lang_pred", "score")]
    found = df.select(*keep, predictor(shared)(F.col(text_col)).alias("_found"))
    return found.select(*keep, "_found.lang_pred", "_found.score")
