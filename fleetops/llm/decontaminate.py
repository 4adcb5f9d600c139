"""Benchmark decontamination: a BM25 index of test items, queried by every passage of the corpus with block-max WAND."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable
from math import log
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetops.llm.common import cut, pack, unpack

SHINGLE = 5
SIMILARITY = 0.8
PART_OVERLAP = 0.5
K1, B = 1.2, 0.75
#: Items stand in up to this many blocks; each term has its largest impact for each block.
BLOCKS = 64
#: An index is sent to the executors only up to this size of its items' texts (some forty times that in memory, for its
#: sets of shingles and a number for each term and block); larger benchmarks go in parts.
INDEX_BYTES = 4 << 20
#: What sums of block maxima may lack for rounding.
SLACK = 1e-4
#: Characters of text worked on at once.
BATCH_CHARS = 1 << 20

WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(of: list[str]) -> set[tuple[str, ...]]:
    """Five words each; fewer words make one shingle of them all."""
    return {tuple(of[i : i + SHINGLE]) for i in range(max(1, len(of) - SHINGLE + 1))} if of else set()


class Index(NamedTuple):
    ids: list
    shingles: list[set]
    question: list[set]
    answer: list[set]
    need: np.ndarray  # the least score of a passage that holds SIMILARITY of an item's shingles
    terms: dict[str, int]
    begin: np.ndarray  # where each term's postings of each block begin
    item: np.ndarray  # postings by term, items in ascending order
    impact: np.ndarray
    top: np.ndarray  # by term and block: the largest impact
    span: int  # words in a segment; a passage is two segments


class Statistics(NamedTuple):
    """Of all items, whatever part of them an index holds: their number, mean and most words, and items by term."""

    n: int
    mean: float
    most: int
    df: dict[str, int]


def build(rows: Iterable[tuple], statistics: Statistics | None = None) -> Index:
    """Postings with BM25 impacts, each divided by the least score its item needs: a passage is retrieved at 1.

    A passage with at least SIMILARITY of an item's shingles lacks at most the other shingles, and each of them can
    take one word along at most; so the item's score less that many of its largest impacts is always reached.
    The question is an item's text up to its last line, which is the answer; one line is a question alone.
    """
    kept = [(i, text, w) for i, text in rows if (w := words(text))]
    if statistics is None:
        lengths = [len(w) for _, _, w in kept]
        statistics = Statistics(len(kept), sum(lengths) / max(1, len(kept)), max(lengths, default=0), Counter(t for _, _, w in kept for t in set(w)))
    n, mean, most, df = statistics
    terms = {t: k for k, t in enumerate(sorted({t for _, _, w in kept for t in w}))}
    sets, question, answer, need, posts = [], [], [], [], []
    for k, (_, text, w) in enumerate(kept):
        head, _, tail = text.strip().rpartition("\n")
        sets.append(shingles(w))
        question.append(set(words(head or tail)))
        answer.append(set(words(tail)) if head else set())
        score = {t: log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean)) for t, f in Counter(w).items()}
        spare = int((1 - SIMILARITY) * len(sets[-1]) + 1e-9)
        need.append(max(sum(sorted(score.values())[: len(score) - spare]) * (1 - 1e-9), 1e-9))
        posts += [(terms[t], k, s / need[-1]) for t, s in score.items()]
    posts.sort()
    term, item = (np.array([p[j] for p in posts], np.int64) for j in (0, 1))
    impact = np.array([p[2] for p in posts])
    block = -(-len(kept) // BLOCKS) or 1
    blocks = -(-len(kept) // block)
    top = np.zeros((len(terms), blocks), np.float32)
    np.maximum.at(top, (term, item // block), np.nextafter(impact.astype(np.float32), np.float32(np.inf)))
    begin = np.searchsorted(term * blocks + item // block, np.arange(len(terms) * blocks + 1))
    span = max(SHINGLE, most + most // 4)
    return Index([i for i, _, _ in kept], sets, question, answer, np.array(need), terms, begin, item, impact, top, span)


def wand(lists: list[tuple[list[int], list[float], float]], least: float) -> tuple[list[tuple[int, float]], int]:
    """Items whose impacts add up to `least`, with that sum, and how many postings were looked at.

    lists: for each term its items in ascending order, their impacts and an upper bound of these. The lists go along
    together, in the order of the item that each has reached. The pivot is the first item at which the bounds of the
    lists so far could add up to `least`: lists before it skip to it by bisection, and only where all have reached it
    its impacts are summed.
    """
    at, live, found, looked = [0] * len(lists), list(range(len(lists))), [], 0
    while live:
        live.sort(key=lambda k: lists[k][0][at[k]])
        bound, pivot = 0.0, None
        for k in live:
            bound += lists[k][2]
            if bound >= least - SLACK:
                pivot = lists[k][0][at[k]]
                break
        if pivot is None:
            break
        if lists[live[0]][0][at[live[0]]] == pivot:
            score = 0.0
            for k in live:
                if lists[k][0][at[k]] != pivot:
                    break
                score += lists[k][1][at[k]]
                at[k] += 1
                looked += 1
            if score >= least:
                found.append((pivot, score))
        else:
            for k in live:
                if lists[k][0][at[k]] >= pivot:
                    break
                at[k] = bisect_left(lists[k][0], pivot, at[k])
                looked += 1
        live = [k for k in live if at[k] < len(lists[k][0])]
    return found, looked


def retrieve(index: Index, texts: list[list[str]], least: float = 1.0, count: list[int] | None = None) -> list[tuple[int, int, int, float]]:
    """(text, first word, item, score) of every passage and item at or above `least` times the item's need.

    For all passages of a batch at once, the sum of a passage's block maxima bounds the score of any item of a block.
    Blocks whose bound falls short are skipped with all their postings; the others are gone through by `wand`, with
    the block's maxima as bounds. Passages are runs of two segments, one starting at each segment, so what is no
    longer than a segment lies whole in one. count: receives how many postings each block took.
    """
    get, span = index.terms.get, index.span
    sizes = np.array([len(w) for w in texts], np.int64)
    segments = np.maximum(1, -(-sizes // span))
    first = np.cumsum(segments) - segments
    term = np.array([get(w, -1) for ws in texts for w in ws], np.int64)
    known = np.flatnonzero(term >= 0)
    if not len(known):
        return []
    place = np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    seg = np.repeat(first, sizes) + place // span
    n_terms, n_seg = len(index.terms), int(segments.sum())
    once = np.unique(seg[known] * n_terms + term[known])
    seg, term = once // n_terms, once % n_terms
    filled, start = np.unique(seg, return_index=True)
    blocks = index.top.shape[1]
    bound = np.zeros((n_seg + 1, blocks), np.float32)
    bound[filled] = np.add.reduceat(index.top[term], start, axis=0)
    last = np.zeros(n_seg, bool)
    last[first + segments - 1] = True
    bound = bound[:-1] + np.where(last[:, None], 0, bound[1:])
    begin = np.searchsorted(seg, np.arange(n_seg + 1))
    out, now, mine = [], -1, np.zeros(0, np.int64)
    for p, b in zip(*(x.tolist() for x in np.nonzero(bound >= least - SLACK)), strict=True):
        if p != now:  # the passage's terms: those of its segment and of the next one in the same text
            now, mine = p, np.unique(term[begin[p] : begin[p + (1 if last[p] else 2)]])
        tops = index.top[mine, b]
        if tops.sum() < least - SLACK:
            continue
        has = mine[tops > 0] * blocks + b
        spans = zip(index.begin[has].tolist(), index.begin[has + 1].tolist(), tops[tops > 0].tolist(), strict=True)
        found, looked = wand([(index.item[x:y].tolist(), index.impact[x:y].tolist(), t) for x, y, t in spans], least)
        if count is not None:
            count.append(looked)
        if found:
            t = int(np.searchsorted(first, p, "right")) - 1
            out += [(t, (p - int(first[t])) * span, i, s * float(index.need[i])) for i, s in found]
    return out


def matches(index: Index, texts: list[str | None]) -> list[list[dict]]:
    """For each text its verified items, each with the best passage, the first of equal ones."""
    out: list[list[dict]] = []
    batch: list[list[str]] = []
    chars = 0

    def flush() -> None:
        nonlocal chars
        found: dict[tuple[int, int], dict] = {}
        for t, at, i, score in retrieve(index, batch):
            passage = batch[t][at : at + 2 * index.span]
            whole, seen = len(index.shingles[i] & shingles_of(passage, index.shingles[i])) / len(index.shingles[i]), set(passage)
            q, a = (len(x & seen) / len(x) if x else 1.0 for x in (index.question[i], index.answer[i]))
            if whole >= SIMILARITY - 1e-9 and q >= PART_OVERLAP and a >= PART_OVERLAP:
                new = {"item_id": index.ids[i], "at_word": at, "score": score, "containment": whole, "question_overlap": q, "answer_overlap": a}
                rank = lambda m: (m["containment"], round(m["score"], 9))  # noqa: E731  the order of summing decides no tie
                if (t, i) not in found or rank(new) > rank(found[t, i]):
                    found[t, i] = new
        mine: list[list[dict]] = [[] for _ in batch]
        for (t, _), m in sorted(found.items()):
            mine[t].append(m)
        out.extend(mine)
        batch.clear()
        chars = 0

    for text in texts:
        batch.append(words(text))
        chars += len(text or "")
        if chars >= BATCH_CHARS:
            flush()
    flush()
    return out


def shingles_of(passage: list[str], wanted: set[tuple[str, ...]]) -> set[tuple[str, ...]]:
    """The passage's runs of words that are as long as the wanted shingles."""
    k = len(next(iter(wanted)))
    return {tuple(passage[i : i + k]) for i in range(len(passage) - k + 1)}


def finder(index: Broadcast, one: T.StructType):
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series(matches(Index(*index.value), list(texts)), dtype=object)

    return F.pandas_udf(find, T.ArrayType(one))


@F.pandas_udf(T.ArrayType(T.StringType()))
def all_words(texts: pd.Series) -> pd.Series:
    return pd.Series([words(t) for t in texts], dtype=object)


def statistics_of(items: DataFrame, text_col: str) -> tuple[int, float, int, DataFrame]:
    """Number, mean and most words, and a table of items by term, over all items with a word."""
    listed = items.select(all_words(text_col).alias("w")).filter(F.size("w") > 0)
    total = listed.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("mean"), F.max(F.size("w")).alias("most")).first()
    return total["n"], total["mean"] or 0.0, total["most"] or 0, cut(listed.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").count(), "terms")


def contamination(
    df: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "item_id", item_text_col: str = "text", index_bytes: int = INDEX_BYTES
) -> DataFrame:
    """Adds `matches`: for each row the items that it holds, as structs of item_id, at_word (where the passage begins),
    score (BM25), containment, question_overlap and answer_overlap.

    An item matches if a passage holds at least 0.8 of its five-word shingles, and at least half of the words of
    both its question and its answer. The index finds all of these, see `build`. Words are runs of letters, digits
    and _ in lower case. Items reach the executors as an index whose size is checked: rows are not shuffled. Beyond
    index_bytes of texts they are dealt by hash into as many parts, each one pass over the rows that writes the rows
    with a match; the parts' matches are joined at the end. Scores and passages rest on the statistics of all items, so
    the parts change no result.

    Null and empty texts match nothing, items without a word are never matched; repeated items match each. A very long
    text is gone through passage by passage to its end; of passages that tie the first counts. An input column named `matches` gives way. An empty table of items gives empty arrays.
    """
    size = items.agg(F.coalesce(F.sum(F.octet_length(item_text_col)), F.lit(0))).first()[0]
    parts = -(-size // index_bytes) or 1
    one = T.StructType([T.StructField("item_id", items.schema[id_col].dataType), T.StructField("at_word", T.LongType())])
    for name in ("score", "containment", "question_overlap", "answer_overlap"):
        one = one.add(name, T.DoubleType())
    rows, text = pack(df), F.col("_row")[text_col]

    def search(part: DataFrame, statistics: Statistics | None = None):
        index = build((tuple(r) for r in part.sort(id_col, item_text_col).collect()), statistics)
        return finder(df.sparkSession.sparkContext.broadcast(tuple(index)), one)

    if parts == 1:
        found = search(items.select(id_col, item_text_col))
        return unpack(rows.withColumn("matches", found(text)), df.columns, ["matches"])
    n, mean, most, terms = statistics_of(items, item_text_col)
    rows = cut(rows.withColumn("_rid", F.monotonically_increasing_id()), "passages")
    every = None
    for p in range(parts):
        part = items.select(id_col, item_text_col).filter(F.pmod(F.xxhash64(id_col, item_text_col), F.lit(parts)) == p)
        mine = part.select(F.explode(all_words(item_text_col)).alias("term")).distinct()
        find = search(part, Statistics(n, mean, most, dict(map(tuple, terms.join(mine, "term").collect()))))
        found = cut(rows.select("_rid", find(text).alias("m")).filter(F.size("m") > 0), "matches")
        every = found if every is None else every.unionByName(found)
    every = every.groupBy(F.col("_rid").alias("_of")).agg(F.sort_array(F.flatten(F.collect_list("m"))).alias("_m"))
    joined = rows.join(every, F.col("_rid") == F.col("_of"), "left")
    return unpack(joined.withColumn("matches", F.coalesce("_m", F.array().cast(T.ArrayType(one)))), df.columns, ["matches"])
