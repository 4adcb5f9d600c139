"""Spelling variants: words one edit apart, found in neighbourhoods over a reduced alphabet."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetops.llm.common import saved

#: Maximal runs of these are words.
LETTERS = "A-Za-zÀ-ÿ"
#: Letters are hashed to so many symbols. Fewer make smaller neighbourhoods but more words that look alike.
SYMBOLS = 8
#: Words of a task are counted together until there are so many different ones; then their counts are handed on.
HELD = 200_000
#: Symbols of words of equal length that are spelled out at once.
CELLS = 200_000


def vocabulary(docs: DataFrame, least: int = 5, times: int = 3, every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`word`, `n`: the runs of LETTERS of all texts, A-Z lower-cased, of `least` code points or more, with how often they
    occur, if that is `times` or more.

    every: where it divides the CRC-32 of `<id>:<run>`, the run counts without its code point number CRC-32 % length, so
    that a known share of misspellings is planted. Equal runs of a document share their fate.

    A null text has no words, a null id is read as ''. Texts of any length are read whole, one at a time. Repeated rows
    count as often as they occur. An empty table gives no rows; further columns aren't looked at.
    """
    runs = re.compile(f"[{LETTERS}]{{{least},}}")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                start = zlib.crc32(f"{key.as_py()}:".encode())
                own = Counter(runs.findall(text.as_py().encode().lower().decode()))  # bytes.lower: A-Z only
                if every:
                    for run in [r for r in own if zlib.crc32(r.encode(), start) % every == 0]:
                        n, at = own.pop(run), zlib.crc32(run.encode(), start) % len(run)
                        if len(run) > least:
                            held[run[:at] + run[at + 1 :]] += n
                held.update(own)
                if len(held) >= HELD:
                    yield told()
                    held.clear()
        yield told()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).filter(F.col(text_col).isNotNull())
    return rows.mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def reduced(points: np.ndarray, symbols: int) -> np.ndarray:
    """Code points to symbols from 1: the remainder, so that letters that stand together in the alphabet differ."""
    return points.astype(np.uint64) % np.uint64(symbols) + np.uint64(1)


def neighbourhood(digits: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words of equal length, a row of symbols each: the keys of the reduced words themselves (words), of those without
    one symbol (words, places), and with a larger symbol in one place (words, places, symbols), 0 where there is none.
    The key of a reduced word is its value as a number with a large base, modulo 2**64."""
    base = np.uint64(0x5851F42D4C957F2D)
    n, length = digits.shape
    power = np.ones(length + 1, np.uint64)
    np.multiply.accumulate(np.full(length, base), out=power[1:])
    head, tail = np.zeros((length + 1, n), np.uint64), np.zeros((length + 1, n), np.uint64)
    for i in range(length):
        head[i + 1] = head[i] * base + digits[:, i]
    for i in range(length - 1, -1, -1):
        tail[i] = tail[i + 1] + digits[:, i] * power[length - 1 - i]
    without = head[:-1] * power[length - 1 :: -1][:length, None] + tail[1:]
    more = np.arange(1, symbols, dtype=np.uint64)
    room = digits[:, :, None] + more <= np.uint64(symbols)
    other = np.where(room, head[-1][:, None, None] + more * power[length - 1 :: -1][:length][:, None], np.uint64(0))
    return head[-1], without.T, other


def keys(words: DataFrame, symbols: int = SYMBOLS, around: bool = True) -> DataFrame:
    """_id, word to _id, _key, _own: the keys of each reduced word (_own) and, if around, of its neighbourhood, each once.

    A reduced word one edit away is longer by a symbol, shorter, or differs in one place. Of two neighbours each lies in
    the neighbourhood of the other, so it is enough to spell out the half of it that is shorter or holds the larger
    symbol: every pair meets, and does so once."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_length: dict[int, list[tuple[int, str]]] = {}
            for i, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_length.setdefault(len(w), []).append((i, w))
            for length, own in by_length.items():
                lot = max(1, CELLS // (length * symbols))
                for a in range(0, len(own), lot):
                    ids = np.array([i for i, _ in own[a : a + lot]], np.int64)
                    points = np.frombuffer("".join(w for _, w in own[a : a + lot]).encode("utf-32-le"), np.uint32)
                    itself, without, other = neighbourhood(reduced(points, symbols).reshape(len(ids), length), symbols)
                    near = np.sort(np.concatenate([without, other.reshape(len(ids), -1)], axis=1)[:, : None if around else 0], axis=1)
                    first = np.ones(near.shape, bool)
                    first[:, 1:] = near[:, 1:] != near[:, :-1]
                    first &= near != 0
                    at = np.concatenate([ids, np.repeat(ids, first.sum(axis=1))])
                    key = np.concatenate([itself, near[first]]).view(np.int64)
                    mine = np.arange(len(at)) < len(ids)
                    yield pa.record_batch([pa.array(at), pa.array(key), pa.array(mine)], ["_id", "_key", "_own"])

    return words.select("_id", "word").mapInArrow(spell, "_id long, _key long, _own boolean")


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """word, n to word, n, other, other_n: both directions of every pair of words that differ by exactly one inserted,
    deleted or replaced code point. words: each word once, as from a checkpoint or a table.

    Reduced words that are equal or one edit apart meet by their keys, two numbers a row; then the words themselves are
    fetched and compared, so neither the symbols nor chance in the keys decides anything. Words of any length go along,
    as keys are computed from prefix and suffix sums and not spelled out. A key's words are joined, never gathered."""
    named = saved(words.select(F.monotonically_increasing_id().alias("_id"), "word", "n"))
    own = keys(named, symbols, around=False).select("_key", F.col("_id").alias("_other"))
    met = keys(named, symbols).join(own, "_key").filter("_id <> _other and (not _own or _id < _other)").select("_id", "_other")
    met = met.join(named, "_id").select("_other", "word", "n")
    met = met.join(named.select(F.col("_id").alias("_other"), F.col("word").alias("other"), F.col("n").alias("other_n")), "_other")
    met = met.filter(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")
    back = F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    both = met.select(F.explode(F.array(F.struct("word", "n", "other", "other_n"), back)).alias("p"))
    return both.select("p.*").distinct()  # two may have met by chance as well


def spelling_variants(words: DataFrame, factor: int = 2, symbols: int = SYMBOLS) -> DataFrame:
    """word, n to `word`, `form`, `root`, `n`, `n_near`, `form_n`.

    A word's form is its near word of largest n (ties: the smallest in code-point order), if that n is `factor` times its
    own or more, else null; root is the last word that is reached over forms, the word itself if it has none. n grows
    from word to form, so roots are found by pointer doubling, in as many rounds as the logarithm of the longest way has
    bits. An empty vocabulary gives no rows."""
    words = saved(words.select("word", "n"))
    near = near_words(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("best"))
    near = near.select("word", "n_near", F.col("best.w").alias("_form"), (-F.col("best.m")).alias("_form_n"))
    found = words.join(near, "word", "left")
    is_form = F.col("_form_n") >= factor * F.col("n")
    found = found.select("word", F.when(is_form, F.col("_form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("_form_n")).alias("form_n"))
    found = saved(found)
    up = saved(found.filter("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not up.filter("moved").isEmpty():
        further = up.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        up = saved(up.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
    out = found.join(up.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
