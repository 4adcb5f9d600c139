"""Quality classifier: a linear-chain conditional random field over the lines of a text."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fleetops.llm.common import sample

#: The sample to learn from: up to this many texts of each label, whole, in a hashed order, until they have so many lines.
PER_LABEL = 1500
LABEL_LINES = 200_000
#: Texts of more lines are gone through one by one, the others together.
LONG = 400

#: What a byte is: 0 other letters, 1 lower, 2 upper, 3 digit, 4 space, 5 punctuation of prose, 6 exclamation mark, 7 symbol.
KIND = np.zeros(256, np.uint8)
KIND[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
KIND[list(b"0123456789")] = 3
KIND[list(b" \t\r\x0b\x0c")] = 4
KIND[list(b".,;:?'\"()-")] = 5
KIND[list(b"!")] = 6
KIND[list(b"#*$%&|<>@^~_=+/\\[]{}`")] = 7

OWN = 16


class Crf(NamedTuple):
    weights: np.ndarray  # log odds of good by feature: own line's, the line's before and after
    transition: np.ndarray  # [before][after], 0 bad and 1 good
    mean: np.ndarray
    scale: np.ndarray
    link: tuple[float, float]  # the document's score from the log odds of its aggregated marginal


def lines_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, bytes of each line, lines of each text). A text has a line at least, if an empty one."""
    raw = [(t or "").encode("utf-8", "replace").split(b"\n") for t in texts]
    raw = [[x for x in r if x.strip()] or [b""] for r in raw]
    counts = np.array([len(r) for r in raw], np.int64)
    flat = [x for r in raw for x in r]
    sizes = np.array([len(x) for x in flat], np.int64)
    data = np.frombuffer(b"".join(flat), np.uint8)
    kinds = np.bincount(np.repeat(np.arange(len(flat)) * 8, sizes) + KIND[data], minlength=8 * len(flat)).reshape(-1, 8).astype(np.float32)
    share = kinds / np.maximum(1, sizes)[:, None]
    extra = np.zeros((len(flat), OWN - 8), np.float32)
    at = 0
    for r in raw:
        seen = set()
        for x in r:
            words = x.split()
            n = max(1, len(words))
            same = len(set(words)) / n
            extra[at] = (len(words) ** 0.5 / 8, same, float(same < 0.5), min(20.0, len(x) / n) / 10, float(x in seen), float(x[-1:] in b".?!\"')" and len(x) > 0), float(x[:1].isupper()), float(len(r) == 1))
            seen.add(x)
            at += 1
    return np.concatenate([share, extra], axis=1), sizes, counts


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the lines before and after in the same text (zero at its ends), and a one."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    ends = np.cumsum(counts)
    before[ends - counts] = 0
    after[ends - 1] = 0
    return np.concatenate([own, before, after, np.ones((len(own), 1), own.dtype)], axis=1)


def forward(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The log odds that reach the next line from log odds x."""
    return np.logaddexp(t[1, 1] + x, t[0, 1]) - np.logaddexp(t[1, 0] + x, t[0, 0])


def messages(unary: np.ndarray, counts: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of good from the lines before and with each line, and from the lines after it (forward-backward)."""
    a, b = unary.astype(np.float64), np.zeros(len(unary))
    start = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    start, n = start[order], counts[order]
    long = int((n > LONG).sum())
    for s, k in zip(start[:long].tolist(), n[:long].tolist(), strict=True):
        chain(a, b, s, k, t)
    start, n = start[long:], n[long:]
    for i in range(1, int(n[0]) if len(n) else 0):
        at = start[: np.searchsorted(-n, -i, "left")] + i
        a[at] += forward(a[at - 1], t)
    for i in range(int(n[0]) - 2 if len(n) else -1, -1, -1):
        at = start[: np.searchsorted(-n, -(i + 1), "left")] + i
        b[at] = forward(unary[at + 1] + b[at + 1], t.T)
    return a, b


def chain(a: np.ndarray, b: np.ndarray, s: int, k: int, t: np.ndarray) -> None:
    """`messages` for one long text, in plain numbers."""
    from math import exp, log1p

    def add(x: float, y: float) -> float:
        return max(x, y) + log1p(exp(-abs(x - y)))

    u = a[s : s + k].tolist()
    (p, q), (r, w) = t.tolist()
    now, fore, back = u[0], [u[0]], [0.0]
    for x in u[1:]:
        now = x + add(w + now, q) - add(r + now, p)
        fore.append(now)
    now = 0.0
    for x in reversed(u[1:]):
        now += x
        now = add(w + now, r) - add(q + now, p)
        back.append(now)
    a[s : s + k], b[s : s + k] = fore, back[::-1]


def marginals(model: Crf, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log odds that each line is good."""
    x = (with_neighbours(own, counts) - model.mean) / model.scale
    a, b = messages(np.einsum("ij,j->i", x, model.weights), counts, model.transition)  # the same bits in any batch
    return a + b


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def aggregated(odds: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """By text, the log odds of its lines' mean probability of good, weighed by their bytes (and one)."""
    at, weight = np.cumsum(counts) - counts, sizes + 1.0
    q = np.add.reduceat(sigmoid(odds) * weight, at) / np.add.reduceat(weight, at)
    q = np.clip(q, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: list[int], rounds: int = 150, rate: float = 0.1, ridge: float = 0.01) -> Crf:
    """Likelihood of the lines' labels, which are their text's, by Adam; each text counts alike and so does each label.

    The transitions are held to ridge times as well, so that one bad passage can't be outvoted by the chain. A
    logistic link from the aggregated marginal to the label is fitted last. Without texts of both labels nothing is
    learned and all scores are a half.
    """
    y = np.array(labels, np.int64)
    width = 3 * OWN + 1
    blank = Crf(np.zeros(width), np.zeros((2, 2)), np.zeros(width), np.ones(width), (0.0, 0.0))
    if len(set(labels)) < 2:
        return blank
    own, sizes = np.concatenate([f for f, _ in texts]), np.concatenate([s for _, s in texts])
    counts = np.array([len(s) for _, s in texts], np.int64)
    x = with_neighbours(own, counts).astype(np.float64)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    mean[-1], scale[-1] = 0, 1
    x = (x - mean) / scale
    which = np.repeat(np.arange(len(y)), counts)
    line_y = y[which].astype(np.float64)
    per_text = len(y) / (2 * np.bincount(y, minlength=2))[y] / len(y)
    length = (sizes + 1.0) / np.bincount(which, sizes + 1.0)[which]
    weight = per_text[which] * length  # of a line: its share of the text
    inner = np.flatnonzero(which[1:] == which[:-1]) + 1
    pair_weight = (weight[inner] + weight[inner - 1]) / 2
    w, t = np.zeros(width), np.zeros((2, 2))
    m = [np.zeros_like(w), np.zeros_like(t)]
    v = [np.zeros_like(w), np.zeros_like(t)]
    for step in range(1, rounds + 1):
        u = x @ w
        a, b = messages(u, counts, t)
        p = sigmoid(a + b)
        gw = x.T @ ((p - line_y) * weight) + ridge * w
        before, after = a[inner - 1], u[inner] + b[inner]
        joint = np.stack([t[0, 0] + 0 * before, t[0, 1] + after, t[1, 0] + before, t[1, 1] + before + after])
        joint = np.exp(joint - joint.max(axis=0))
        joint /= joint.sum(axis=0)
        seen = np.zeros((4, len(inner)))
        seen[(3 * line_y[inner]).astype(np.int64), np.arange(len(inner))] = 1
        gt = ((joint - seen) @ pair_weight).reshape(2, 2) + 10 * ridge * t
        for k, (g, var) in enumerate(((gw, w), (gt, t))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            var -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    a, b = messages(x @ w, counts, t)
    z, slope, bias = aggregated(a + b, sizes, counts), 1.0, 0.0
    for _ in range(50):  # Newton's method for the link
        p = sigmoid(slope * z + bias)
        g = np.array([((p - y) * z).sum() + 1e-2 * slope, (p - y).sum()])
        s = p * (1 - p) + 1e-6
        h = np.array([[(s * z * z).sum() + 1e-2, (s * z).sum()], [(s * z).sum(), s.sum()]])
        slope, bias = np.array([slope, bias]) - np.linalg.solve(h, g)
    return Crf(w, t, mean, scale, (float(slope), float(bias)))


def score(model: Crf, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Scores of the texts, and for each text the probability of good and the bytes of each of its lines."""
    own, sizes, counts = lines_of(texts)
    odds = marginals(model, own, counts)
    z = aggregated(odds, sizes, counts)
    cuts = np.cumsum(counts)[:-1]
    return sigmoid(model.link[0] * z + model.link[1]), np.split(sigmoid(odds), cuts), np.split(sizes, cuts)


def lots(texts: list[str | None], chars: int = 2 << 20):
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


SAMPLE = T.StructType().add("n", T.IntegerType()).add("features", T.BinaryType()).add("sizes", T.BinaryType())


def sampler(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        own, sizes, _ = lines_of([t])
        rows.append((len(sizes), own.astype(np.float32).tobytes(), sizes.tobytes()))
    return pd.DataFrame(rows, columns=["n", "features", "sizes"])


sampler.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}


def fit(
    docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, key_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_lines: int = LABEL_LINES
) -> Crf:
    """Learn from a bounded sample of labelled rows: up to per_label keys of each label in a hashed order, cut off after
    the text in which a label's lines pass label_lines. Texts are taken whole.

    Repeated labels count once; of the rows of a repeated key one text is taken, whichever has the least hash, so no
    label is crowded out. Labels other than 0 and 1 and null keys are passed over. Features are computed by the
    executors; the driver gets the features of the sample's lines. The chosen keys are joined by broadcast: there are
    2 * per_label at most.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(key_col).isNotNull()).select(F.col(key_col).alias("_key"), F.col(label_col).cast("int").alias("_y"))
    chosen = sample(known.withColumn("_h", F.xxhash64(F.lit(11), "_key")), "_y", "_h", per_label)
    texts = docs.select(F.col(key_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("_key"))
    one = texts.groupBy("_key", "_y", "nth").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("text"))).alias("_one"))
    got = one.select("_key", "_y", "nth", F.pandas_udf(sampler, SAMPLE)("_one.text").alias("s"))
    before = F.sum("s.n").over(Window.partitionBy("_y").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    got = got.select("_key", "_y", "s.features", "s.sizes", F.coalesce(before, F.lit(0)).alias("before")).filter(F.col("before") < label_lines)
    rows = sorted(got.collect(), key=lambda r: (r[0], r[1]))
    return train([(np.frombuffer(r.features, np.float32).reshape(-1, OWN), np.frombuffer(r.sizes, np.int64)) for r in rows], [r._y for r in rows])


def scorer(model: Broadcast, lines: bool):
    kind = T.StructType().add("score", T.DoubleType())
    kind = kind.add("lines", T.ArrayType(T.DoubleType())) if lines else kind

    def run(texts: pd.Series) -> pd.DataFrame:
        crf = Crf(*model.value)
        parts = [score(crf, t) for t in lots(list(texts))]
        out = {"score": np.concatenate([p[0] for p in parts]) if parts else np.zeros(0)}
        if lines:
            out["lines"] = [x.tolist() for p in parts for x in p[1]]
        return pd.DataFrame(out)

    return F.pandas_udf(run, kind)


def classify(df: DataFrame, model: Crf, text_col: str = "text", lines: bool = False) -> DataFrame:
    """Adds `score` (0 to 1, higher: better) and `predicted` (1 if score >= 0.5), and with lines=True `line_scores`, the
    marginal probability of good for each line with a word.

    A null, empty or blank text counts as one empty line and gets a score like any other. A very long text is read whole,
    its lines at once; repeated rows get the same score. Input columns of these names give way; an empty input gives an
    empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(tuple(model))
    outs = ["score", "predicted", *(["line_scores"] if lines else [])]
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in outs]
    found = df.select(*keep, scorer(shared, lines)(F.col(text_col)).alias("_found"))
    extra = [F.col("_found.lines").alias("line_scores")] if lines else []
    return found.select(*keep, "_found.score", (F.col("_found.score") >= 0.5).cast("int").alias("predicted"), *extra)
