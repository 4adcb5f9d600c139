"""Token counts by an exact length histogram."""

from __future__ import annotations

import base64
import re
from collections.abc import Sequence

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetops.llm.common import below, saved

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that splits a text before this vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Fixed value: what the pattern's \\s is, the characters with the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space of this many characters in a row is cut out by hand: the pattern's lookahead runs out of stack on millions.
LONG_WHITE = re.compile(f"[{WHITE}]{{4096,}}")


class Encoder:
    """A byte-level BPE vocabulary. The driver reads the file; `plain` is what travels to the executors."""

    def __init__(self, path: str = RANKS, pattern: str = PATTERN) -> None:
        with open(path, "rb") as f:
            self.plain = {"ranks": f.read(), "pattern": pattern}

    def length(self, text: str | None) -> int:
        return length(self.plain, text)


def length(plain: dict, text: str | None) -> int:
    """Tokens of a whole text. The tokenizer is built once and kept beside what it is made of, so a worker that keeps the
    broadcast keeps it too."""
    if "built" not in plain:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, plain["ranks"].splitlines())}
        plain["built"] = tiktoken.Encoding("own", pat_str=plain["pattern"], mergeable_ranks=ranks, special_tokens={})
    built, n, at = plain["built"], 0, 0
    if not text:
        return 0
    for run in LONG_WHITE.finditer(text) if plain["pattern"] == PATTERN else ():
        # Where it begins, a piece ends; all but its last character are one piece, and that one too at the text's end.
        end = run.end() - (run.end() < len(text))
        n += len(built.encode_ordinary(text[at : run.start()])) + len(built._encode_single_piece(text[run.start() : end]))
        at = end
    return n + len(built.encode_ordinary(text[at:] if at else text))


def counter(encoder: Broadcast):
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([length(encoder.value, t) for t in texts], dtype="int64")

    return F.pandas_udf(count, T.LongType())


def token_lengths(df: DataFrame, encoder: Encoder | None = None, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of each whole text; null and empty texts have none, and long runs of white space are
    counted as any others. An input column of that name gives way."""
    shared = df.sparkSession.sparkContext.broadcast({k: v for k, v in (encoder or Encoder()).plain.items() if k != "built"})
    return df.withColumn(out, counter(shared)(F.col(text_col)))


def length_histogram(df: DataFrame, encoder: Encoder | None = None, text_col: str = "text") -> DataFrame:
    """n_tokens and docs: how many texts have each length. Counts are combined before the shuffle, so no length is
    hot, and a text itself is never moved. An empty input gives an empty histogram."""
    return token_lengths(df.select(text_col), encoder, text_col).groupBy("n_tokens").agg(F.count("*").alias("docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with what its suffix sums answer at each length that occurs, taken as a context limit:
    docs_at_most, docs_at_least, tokens (of texts of that length), tokens_at_least, truncated_total (tokens left when
    every text is cut at that length), share_at_most (the quantile of that length)."""
    held = saved(histogram.withColumn("tokens", F.col("n_tokens") * F.col("docs")))
    total = held.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("d"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()
    sums = below(held, "n_tokens", ["docs", "tokens"])
    return sums.select(
        "n_tokens",
        "docs",
        (F.col("docs_below") + F.col("docs")).alias("docs_at_most"),
        (F.lit(total["d"]) - F.col("docs_below")).alias("docs_at_least"),
        "tokens",
        (F.lit(total["t"]) - F.col("tokens_below")).alias("tokens_at_least"),
        (F.col("tokens_below") + F.col("n_tokens") * (F.lit(total["d"]) - F.col("docs_below"))).alias("truncated_total"),
        ((F.col("docs_below") + F.col("docs")) / F.lit(max(1, total["d"]))).alias("share_at_most"),
    )


def truncated_totals(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """limit, truncated_total and docs_cut for any limits, from the suffix sums alone."""
    asked = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    joined = asked.join(sums, F.col("n_tokens") > F.col("limit"), "left")
    over = lambda c: F.coalesce(F.sum(c), F.lit(0))
    whole = sums.agg(over("tokens").alias("all"))
    cut_ = joined.groupBy("limit").agg(over("docs").alias("docs_cut"), over(F.col("tokens") - F.col("docs") * F.col("limit")).alias("lost"))
    return cut_.crossJoin(F.broadcast(whole)).select("limit", (F.col("all") - F.col("lost")).alias("truncated_total"), "docs_cut")


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """share and n_tokens: the least length that at least this share of the texts does not pass."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return asked.join(sums, F.col("share_at_most") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
