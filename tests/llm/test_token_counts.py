from bisect import bisect_left

from fleetops.llm.token_counts import Encoder, length_histogram, quantiles, suffix_sums, truncated_totals

TEXTS = [None, "", "a", "The cat sat on the mat.", "The cat sat on the mat.", "x " * 3000, "é" * 50, "<|endoftext|>", "one two three", "tail\n\n"]


def test_sums_quantiles_and_limits(spark):
    encoder = Encoder()
    lengths = sorted(encoder.length(t) for t in TEXTS)
    df = spark.createDataFrame([(t, 1) for t in TEXTS], "text string, n_tokens int")
    rows = suffix_sums(length_histogram(df, encoder)).orderBy("n_tokens").collect()
    assert [(r.n_tokens, r.docs) for r in rows] == [(x, lengths.count(x)) for x in sorted(set(lengths))]
    for r in rows:
        assert r.docs_at_least == len(lengths) - bisect_left(lengths, r.n_tokens)
        assert r.docs_at_most == sum(x <= r.n_tokens for x in lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= r.n_tokens)
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in lengths)
    sums = suffix_sums(length_histogram(df, encoder))
    limits = [0, 1, 2, 7, 100, 10**6]
    assert {(r.limit, r.truncated_total, r.docs_cut) for r in truncated_totals(sums, limits).collect()} == {
        (x, sum(min(y, x) for y in lengths), sum(y > x for y in lengths)) for x in limits
    }
    got = {r.share: r.n_tokens for r in quantiles(sums, [0.1, 0.5, 1.0]).collect()}
    assert got == {q: next(x for x in lengths if sum(y <= x for y in lengths) >= q * len(lengths)) for q in got} and len(got) == 3


def test_long_white_space():
    encoder = Encoder()
    whole = lambda t: len(encoder.plain["built"].encode_ordinary(t))
    encoder.length("a")
    for run in (" " * 20_000, "\n" * 20_000, " \n\t\u2003\xa0" * 4000, "\x1c" * 9000):
        for text in (run, "a" + run, run + "b", "one" + run + "two" + run, run + "\n's" + run + " x"):
            assert encoder.length(text) == whole(text)
    assert encoder.length(" " * 1_500_000 + "x") > 1 and encoder.length("\n" * 2_000_000) > 1


def test_special_tokens_are_text():
    assert Encoder().length("<|endoftext|>") > 1


def test_empty(spark):
    assert suffix_sums(length_histogram(spark.createDataFrame([], "text string"))).count() == 0
