"""Quality rules by weak supervision (DataFrame functions only)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetops.llm.common import cut, pack, unpack, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: The columns that the rules read, all long.
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_shouted", "n_bangs", "n_distinct", "n_odd")


class Rule(NamedTuple):
    """Votes good (1) or bad (-1) where its condition holds, else abstains (0). Rules of a family see the same failing."""

    name: str
    family: str
    good: str
    bad: str


RULES = (
    Rule("symbols", "symbols", "50 * n_symbols <= n_words", "10 * n_symbols >= n_words"),
    Rule("odd_runs", "symbols", "25 * n_odd <= n_words", "5 * n_odd >= n_words"),
    Rule("shouting", "shouting", "20 * n_shouted <= n_words", "5 * n_shouted >= n_words"),
    Rule("bangs", "shouting", "50 * n_bangs <= n_words", "10 * n_bangs >= n_words"),
    Rule("line_ends", "form", "n_lines > 0 and 2 * n_ended >= n_lines", "n_lines >= 3 and 10 * n_ended <= n_lines"),
    Rule("dup_lines", "repetition", "10 * n_dup_lines <= n_lines", "10 * n_dup_lines >= 3 * n_lines and n_lines >= 3"),
    Rule("repeats", "repetition", "10 * n_repeat_words <= n_words", "10 * n_repeat_words >= 3 * n_words"),
    Rule("vocabulary", "repetition", "n_words >= 20 and 4 * n_distinct >= n_words", "n_words >= 20 and 10 * n_distinct <= n_words"),
    Rule("word_length", "form", "word_chars between 3 * n_words and 12 * n_words", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
)
FAMILIES = tuple(dict.fromkeys(r.family for r in RULES))


def measured(df: DataFrame, text_col: str = "text", row: str = "_row") -> DataFrame:
    """The packed rows with FEATURES; nothing is shuffled, each text is worked on where it was read.

    Windows of 8 words are compared by a 64-bit hash of their words' 64-bit hashes. Only a text in which two hashes
    are equal sorts them with their places; the words covered follow from the distances between the places found.
    """
    text = F.coalesce(F.col(row)[text_col], F.lit(""))
    a = df.select("*", text.alias("_text")).withColumn("_words", words(F.col("_text")))
    a = a.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("n_words", F.size("_words").cast("long"))
    ahead = lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)])
    places = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), F.size("_hashes") - WINDOW)).otherwise(F.array().cast("array<int>"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")
    a = a.select(
        row,
        "n_words",
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.regexp_count("_text", F.lit("[.!?\"':;)\\]»”][ \\t]*(?:\\n|$)")).cast("long").alias("n_ended"),
        F.regexp_count("_text", F.lit("\\p{Lu}{3,}")).cast("long").alias("n_shouted"),
        F.regexp_count("_text", F.lit("!!")).cast("long").alias("n_bangs"),
        F.size(F.array_distinct("_hashes")).cast("long").alias("n_distinct"),
        F.regexp_count("_text", F.lit("[^\\p{L}\\s.,;:!?'\"()-]+")).cast("long").alias("n_odd"),
        F.transform(places, ahead).alias("_windows"),
    )
    a = a.withColumn("_same", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    ranked = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    a = a.withColumn("_ranked", F.when(F.col("_same"), ranked))
    near = lambda e, k: (F.get("_ranked", k - 1)["h"] == e["h"]) | (F.get("_ranked", k + 1)["h"] == e["h"])
    twice = F.transform(F.filter("_ranked", lambda e, k: F.coalesce(near(e, k), F.lit(False))), lambda e: e["i"])
    a = a.withColumn("_at", F.sort_array(twice))
    gaps = F.transform("_at", lambda x, k: F.coalesce(F.least(F.get("_at", k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(0), lambda s, x: s + x)
    return a.select(
        row,
        *[F.col(c) for c in ("n_words", "word_chars", "n_symbols")],
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        *[F.col(c) for c in ("n_ended", "n_shouted", "n_bangs", "n_distinct", "n_odd")],
    )


#: Where the estimation starts: the share of good texts; the chance of a bad vote on a good text, and on a bad one for a
#: rule of the family it fails and for another. It stays in as so many votes, whatever the size of the corpus.
SHARE, MISS, OWN, OTHER, VOTES = 0.85, 0.02, 0.7, 0.05, 20.0


def vote(rule: Rule) -> Column:
    """-1, 0 or 1; no rule votes on a text without words."""
    return F.expr(f"case when n_words = 0 then 0 when {rule.bad} then -1 when {rule.good} then 1 else 0 end")


class Model(NamedTuple):
    """Classes are good and, by family, the ways to be bad: their shares, and each rule's chance to vote bad if it votes."""

    share: list[float]
    miss: list[list[float]]

    def odds(self, way: int, rule: int, vote: int) -> float:
        """What a rule's vote adds to the log odds of the way to be bad against good; abstention says nothing."""
        bad, good = self.miss[way][rule], self.miss[0][rule]
        return math.log(bad / good) if vote < 0 else math.log((1 - bad) / (1 - good)) if vote else 0.0

    def chances(self, pattern: Sequence[int]) -> list[float]:
        """Of each class given the votes; the first is the posterior quality."""
        return next(self.all_chances([pattern]))

    def all_chances(self, patterns: Sequence[Sequence[int]]) -> Iterator[list[float]]:
        table = [[[self.odds(c, j, v) for v in (0, 1, -1)] for j in range(len(RULES))] for c in range(len(self.share))]
        shares = [math.log(s / self.share[0]) for s in self.share]
        for pattern in patterns:
            z = [s + sum([row[v] for row, v in zip(rows, pattern, strict=True)]) for s, rows in zip(shares, table, strict=True)]
            top = max(z)
            e = [math.exp(x - top) for x in z]
            whole = sum(e)
            yield [x / whole for x in e]

    def accuracy(self, rule: int) -> tuple[float, float]:
        """The estimated chance that a rule, where it votes, votes good on a good text, and bad on a bad one."""
        bad = sum(self.share[1:])
        return 1 - self.miss[0][rule], sum(s * m[rule] for s, m in zip(self.share[1:], self.miss[1:], strict=True)) / bad


def start() -> Model:
    ways = [[OWN if r.family == f else OTHER for r in RULES] for f in FAMILIES]
    return Model([SHARE, *[(1 - SHARE) / len(ways)] * len(ways)], [[MISS] * len(RULES), *ways])


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 300, votes: float = VOTES) -> Model:
    """Expectation-maximisation over the counts of vote patterns: at most 3**len(RULES) rows, however large the corpus.

    A text is good or bad in one of as many ways as there are families of rules: rules that see the same failing depend
    on each other, and bad texts of one kind say nothing about rules for another. Given that hidden class, the rules
    that vote do so independently, each with a chance of its own to vote bad. Abstention is taken as independent of the
    class: rules abstain on short texts, and were that evidence, the likeliest two classes would be short and long.
    Begins at `start`, which also stays in as `votes` texts and votes, a fixed number that the corpus outweighs.
    """
    first = now = start()
    n = sum(c for _, c in patterns)
    for _ in range(rounds if n else 0):
        total = [votes * s for s in first.share]
        voted = [[votes] * len(RULES) for _ in total]
        bad = [[votes * m for m in row] for row in first.miss]
        for (pattern, count), chances in zip(patterns, now.all_chances([p for p, _ in patterns]), strict=True):
            for c, p in enumerate(chances):
                p *= count
                total[c] += p
                for j, v in enumerate(pattern):
                    if v:
                        voted[c][j] += p
                        if v < 0:
                            bad[c][j] += p
        before, now = now, Model([t / (n + votes) for t in total], [[b / v for b, v in zip(*x, strict=True)] for x in zip(bad, voted, strict=True)])
        if max(abs(a - b) for a, b in zip(before.share, now.share, strict=True)) < 1e-9:
            break
    return now


def quality_rules(df: DataFrame, text_col: str = "text", columns: Sequence[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """FEATURES, `base_failed`, `quality_posterior` and `kept` for every row, by votes of RULES weighed by their accuracy.

    The features are computed once and cut from their lineage; a count of each vote pattern (3**9 rows at most) then
    goes to the driver, where `fit` estimates the rules' accuracies, and the posterior is an expression over the votes.
    `base_failed`: under 20 words, or over 30 % of the words in repeated windows of 8. `kept`: not base_failed, and a
    posterior of at least threshold. columns: the input columns to carry through (all by default; without the text
    the intermediate table is small). Outputs replace input columns of the same names.

    A null text is as an empty one: no words, base_failed. A very long text is counted whole, in one row's arrays. Repeated
    rows count as often as they occur and get the same verdict; a posterior of just threshold is kept. An empty input gives
    an empty result.
    """
    fields = list(df.columns if columns is None else columns)
    rows = measured(pack(df), text_col)
    if columns is not None:
        rows = rows.withColumn("_row", F.struct(*[F.col("_row")[c].alias(c) for c in fields]))
    rows = cut(rows, "rules")
    votes = [vote(r).alias(f"_v{j}") for j, r in enumerate(RULES)]
    counted = rows.select(*votes).groupBy(*[f"_v{j}" for j in range(len(RULES))]).count().collect()
    model = fit(sorted((tuple(r[:-1]), r[-1]) for r in counted))
    against = F.lit(0.0)
    for c in range(1, len(model.share)):
        odds = F.lit(math.log(model.share[c] / model.share[0]))
        for j in range(len(RULES)):
            odds = odds + F.element_at(F.array(*[F.lit(model.odds(c, j, v)) for v in (-1, 0, 1)]), F.col(f"_v{j}") + 2)
        against = against + F.exp(F.least(odds, F.lit(500.0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).select("*", *votes).withColumn("quality_posterior", 1 / (1 + against))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality_posterior") >= threshold))
    return unpack(rows, fields, [*FEATURES, "base_failed", "quality_posterior", "kept"])
