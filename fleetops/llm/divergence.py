"""How far the sources of a language stand apart: word frequencies from sorted pointers to word starts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetops.llm.common import FEW, saved

#: Bytes of whole documents whose pointers are sorted together; longer documents are taken in pieces of this size.
SLICE = 8 << 20
#: Terms of a block in which all sources of a language are compared.
BLOCK = 4_096
#: Shares are counted in so many parts of one.
PARTS = 1_000_000_000

#: Bytes that belong to terms: letters and all of what isn't ASCII; and bytes with only A-Z lower-cased.
IN_TERM = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Of eight bytes as one number, the first k.
FIRST = np.array([(1 << 64) - (1 << 8 * (8 - k)) for k in range(9)], np.uint64)


def term_starts(raw: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers to the terms' first bytes and the terms' lengths; heads: where documents begin."""
    inside = IN_TERM[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = heads[(heads > 0) & (heads < len(raw))]
    first[heads] |= inside[heads]
    last[heads - 1] |= inside[heads - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts


def sort_pointers(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the terms that pointers lead to, with eight bytes as one digit: pointers are quicksorted by
    their first digit, and each run of equal ones that goes on is sorted by its next digit. Returns the pointers' order
    and the run of equal terms, from 0, that each of them (in that order) belongs to. Terms hold no zero byte."""
    digits = np.ndarray(len(raw) + 1, ">u8", np.concatenate([raw, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    key = digits[starts].astype(np.uint64) & FIRST[np.minimum(lengths, 8)]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    run, depth = np.cumsum(new) - 1, 8
    while True:
        longer = np.zeros(run[-1] + 1 if len(run) else 0, bool)
        longer[run[lengths[order] > depth]] = True
        at = np.flatnonzero(longer[run])
        if not len(at):
            return order, run
        own = order[at]
        left = np.clip(lengths[own] - depth, 0, 8)
        key = digits[np.minimum(starts[own] + depth, len(raw))].astype(np.uint64) & FIRST[left]
        by = np.lexsort((key, run[at]))
        order[at], key = own[by], key[by]
        new = np.ones(len(order), bool)
        new[1:] = run[1:] != run[:-1]
        new[at[1:]] |= (key[1:] != key[:-1]) & (run[at[1:]] == run[at[:-1]])
        run, depth = np.cumsum(new) - 1, depth + 8


def tally(raw: np.ndarray, heads: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents that begin at heads and belong to groups in ascending order of their numbers: the different terms, and
    for each that occurs in a group its number among the terms, the group, occurrences and documents."""
    raw = LOWER[raw]
    starts, lengths = term_starts(raw, heads)
    order, run = sort_pointers(raw, starts, lengths)
    n_runs = int(run[-1]) + 1 if len(run) else 0
    doc = np.searchsorted(heads, starts[order], "right") - 1
    both = np.sort(run * len(heads) + doc)
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    at = np.flatnonzero(new)  # a row for each term and document
    run_of, group_of = both[at] // len(heads), group[both[at] % len(heads)]
    first = np.ones(len(at), bool)
    first[1:] = (run_of[1:] != run_of[:-1]) | (group_of[1:] != group_of[:-1])
    cut = np.flatnonzero(first)  # a row for each term and group
    n = np.diff(np.append(at[cut], len(both)))
    docs = np.diff(np.append(cut, len(at)))
    one = order[np.searchsorted(run, np.arange(n_runs))]
    ends = np.cumsum(lengths[one])
    places = np.arange(ends[-1] if n_runs else 0) + np.repeat(starts[one] - (ends - lengths[one]), lengths[one])
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    terms = pa.StringArray.from_buffers(n_runs, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[places].tobytes()))
    return terms, run_of[cut], group_of[cut], n, docs


def pieces(raw: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """A long text in pieces of about `size` bytes, cut where no term is."""
    at = 0
    while at < len(raw):
        end = min(at + size, len(raw))
        inside = IN_TERM[raw[at:end]]
        if end < len(raw) and inside[-1]:
            gap = np.flatnonzero(~inside)
            end = at + gap[-1] + 1 if len(gap) else end
            while not len(gap) and end < len(raw) and IN_TERM[raw[end]]:  # one term longer than a piece
                end += 1
        yield raw[at:end]
        at = end


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", size: int = SLICE) -> DataFrame:
    """lang, source, term, `n` (occurrences), `docs` (documents that hold it). Null text, lang and source are read as ''.

    Word starts are found and sorted in the Arrow buffers of each batch, in slices of whole documents; equal runs give
    a row for each term and source, which are summed before and after the shuffle by language, source and term. A text
    longer than a slice goes in pieces and counts once among the documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "term", "n", "docs"]
        for batch in batches:
            lang, source, text = (c.cast(pa.string()) for c in batch.columns)
            key = pa.array([f"{a}\0{len(a)}\0{b}" for a, b in zip(lang.to_pylist(), source.to_pylist(), strict=True)]).dictionary_encode()
            group = key.indices.to_numpy()
            one = np.zeros(len(key.dictionary), np.int64)
            one[group] = np.arange(len(group))  # a document of each group
            offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            sizes, a = np.diff(offsets), 0
            while a < len(text):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
                if sizes[a] > size:
                    held: Counter[str] = Counter()
                    for piece in pieces(data[offsets[a] : offsets[a + 1]], size):
                        terms, _, _, n, _ = tally(piece, np.zeros(1, np.int64), np.zeros(1, np.int64))
                        held.update(dict(zip(terms.to_pylist(), n.tolist(), strict=True)))
                    m = len(held)
                    yield pa.record_batch([pa.array([lang[a].as_py()] * m, pa.string()), pa.array([source[a].as_py()] * m, pa.string()), pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64()), pa.array([1] * m, pa.int64())], names)
                    a += 1
                    continue
                by = np.argsort(group[a:b], kind="stable") + a
                raw = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in by])
                heads = np.concatenate([[0], np.cumsum(sizes[by])[:-1]])
                terms, term, of, n, n_docs = tally(raw, heads, group[by])
                row = pa.array(one[of])
                yield pa.record_batch([lang.take(row), source.take(row), terms.take(pa.array(term)), pa.array(n), pa.array(n_docs)], names)
                a = b

    told = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    told = told.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return told.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(PARTS * (count + 2) / (total + 2 * kinds)), exact for counts of any size; null where total and kinds are 0."""
    whole = lambda c: c.cast("decimal(38,0)")
    both = whole(total + 2 * kinds)
    return F.lit(1).cast("long") + F.call_function("div", whole(F.lit(PARTS)) * whole(count + 2).cast("decimal(20,0)"), F.nullif(both, whole(F.lit(0))))


def compare(key: tuple, table: pa.Table) -> pa.Table:
    """Of one block of a language's terms: for each two sources the sum of (p-q)^2 / (p+q), each rounded down."""
    source, term = (table.column(c).combine_chunks().dictionary_encode() for c in ("source", "term"))
    source, p = source.indices.to_numpy(), table.column("p").to_numpy()
    names = table.column("source").combine_chunks().dictionary_encode().dictionary
    rest = pa.compute.is_null(table.column("term")).to_numpy()
    shares = np.empty((len(names), len(term.dictionary)), np.int64)
    shares[source[rest]] = p[rest][:, None]
    shares[source[~rest], term.indices.drop_null().to_numpy()] = p[~rest]
    value = np.empty((len(names), len(names)), np.int64)
    for k, own in enumerate(shares):
        value[k] = ((own - shares) ** 2 // (own + shares)).sum(axis=1)
    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    return pa.table([pa.array([key[0].as_py()] * len(a), pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(value[a, b])], ["lang", "source", "item", "value"])


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", size: int = SLICE, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language stands from each other one (part `pair`),
    and the `top` terms that it uses more than the language as a whole does (part `term`).

    A language keeps the terms in min_docs of its documents or more. Of `count` occurrences among N of kept terms, V of
    them different, the share is p = 1 + floor(PARTS * (count + 2) / (N + 2 * V)); the value of a term is
    floor((p - q)^2 / (p + q)) of two shares, that of a pair their sum over all kept terms, those that neither uses too.
    Ranks go from the largest value, ties by item in UTF-8 order.

    Sources are compared in blocks of `block` terms, each with a row of shares for each source: memory follows the number
    of sources, not of terms. A table with a row for each source is broadcast if it has FEW rows at most.

    Null texts, languages and sources are read as ''; a source without terms, and a language without kept ones, has
    pairs too, with value 0 in the latter case. Repeated rows count as often as they occur, long texts are read whole.
    An empty table gives no rows; further columns aren't looked at."""
    counts = term_counts(docs, text_col, lang_col, source_col, size)
    alike = Window.partitionBy("lang", "term")
    kept = counts.select("*", F.sum("docs").over(alike).alias("all_docs"), F.sum("n").over(alike).alias("all_n"), F.row_number().over(alike.orderBy("source")).alias("nth"))
    kept = saved(kept.filter(F.col("all_docs") >= min_docs).select("lang", "source", "term", "n", "all_n", "nth"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum((F.col("nth") == 1).cast("long")).alias("kinds"))
    groups = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    groups = groups.join(sums, ["lang", "source"], "left").na.fill(0, ["total", "kinds"])
    whole = Window.partitionBy("lang")
    groups = saved(groups.select("lang", "source", "total", F.sum("kinds").over(whole).alias("kinds"), F.sum("total").over(whole).alias("lang_total")))
    small = F.broadcast(groups) if groups.count() <= FEW else groups
    p, q = share(F.col("n"), F.col("total"), F.col("kinds")), share(F.col("all_n"), F.col("lang_total"), F.col("kinds"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("kinds") / block)).cast("int")
    shares = kept.join(small, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q"), blocks.alias("blocks"))

    rest = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.coalesce(share(F.lit(0).cast("long"), F.col("total"), F.col("kinds")), F.lit(1)).alias("p"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    cells = shares.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")).unionByName(rest)
    pairs = cells.groupBy("lang", "block").applyInArrow(compare, "lang string, source string, item string, value long")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    apart = F.col("p") - F.col("q")
    terms = shares.filter(apart > 0).select("lang", "source", F.col("term").alias("item"), F.call_function("div", apart * apart, F.col("p") + F.col("q")).alias("value"))
    ranks = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = lambda part, df: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", ranks.alias("rank"))
    return out("pair", pairs).unionByName(out("term", terms).filter(F.col("rank") <= top))
