import math
import random
import re
from collections import Counter

from fleetops.llm.quality_rules import FAMILIES, FEATURES, RULES, VOTES, fit, quality_rules, start

SCHEMA = "doc_id long, text string, kept string, n_words string"


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghié", k=rng.randrange(1, 9)))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(n))
    few = ["x", "y"]
    out = [None, "", " \t\n", "one", "\n\n\n", "a " * 7, "a " * 8, "same line here\n" * 9, " nbsp is a word\x0b\x0cok", "x y " * 9000, "$ # | <>" * 40, prose(4000)]
    out += [prose(rng.randrange(1, 30)) for _ in range(60)]
    out += [" ".join(rng.choice(few) for _ in range(rng.randrange(60))) for _ in range(40)]
    out += [" ".join(w + rng.choice(["$$$", "###", "&&&"]) for w in prose(8).split()) for _ in range(12)]
    out += [" ".join(w.upper() + "!!" for w in prose(8).split()) for _ in range(12)]
    return [*out, *out[-3:]]


def test_counts_against_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    rows = {r.doc_id: r for r in quality_rules(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert not (r.base_failed and r.kept)
    prose = [r for i, r in rows.items() if 12 <= i < 72 and not r.base_failed]
    junk = [r for i, r in rows.items() if 112 <= i < 136]
    assert prose and all(r.kept for r in prose) and not any(r.kept for r in junk)


def test_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y"), (1, "a b", "x", "y"), (None, None, None, None)], SCHEMA)
    assert quality_rules(df, columns=["doc_id"]).count() == 3
    assert "text" not in quality_rules(df, columns=["doc_id"]).columns
    assert quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_votes(row):
    """The rules, applied by Python to one row of counts."""
    names = {c: getattr(row, c) for c in FEATURES}
    if row.n_words == 0:
        return (0,) * len(RULES)
    holds = lambda rule: eval(re.sub(r"(\w+) between (.*) and (.*)", r"(\2) <= \1 <= (\3)", rule), {}, names)  # noqa: E731, S307
    return tuple(-1 if holds(r.bad) else 1 if holds(r.good) else 0 for r in RULES)


def plain_fit(votes, rounds=400):
    """EM text by text, probabilities multiplied out."""
    share, miss = [list(x) if i == 0 else [list(y) for y in x] for i, x in enumerate(start())]
    share0, miss0 = list(share), [list(m) for m in miss]

    def chances(pattern):
        p = [s * math.prod(1 if v == 0 else m[j] if v < 0 else 1 - m[j] for j, v in enumerate(pattern)) for s, m in zip(share, miss)]
        return [x / sum(p) for x in p]

    for _ in range(rounds):
        post = [chances(v) for v in votes]
        miss = [
            [
                (VOTES * miss0[c][j] + sum(p[c] for p, v in zip(post, votes) if v[j] < 0)) / (VOTES + sum(p[c] for p, v in zip(post, votes) if v[j]))
                for j in range(len(RULES))
            ]
            for c in range(len(share))
        ]
        share = [(VOTES * s + sum(p[c] for p in post)) / (len(votes) + VOTES) for c, s in enumerate(share0)]
    return [chances(v)[0] for v in votes]


def test_posterior_and_verdict_against_a_plain_version(spark):
    df = spark.createDataFrame([(i, t, "x", "x") for i, t in enumerate(corpus())], SCHEMA).repartition(3)
    rows = quality_rules(df).collect()
    for r, p in zip(rows, plain_fit([plain_votes(r) for r in rows])):
        assert abs(r.quality_posterior - p) < 1e-5
        assert r.kept == (not r.base_failed and p >= 0.5)


def test_planted_accuracies_are_recovered():
    """Texts bad in one of four ways; each rule has an accuracy of its own on good and on bad texts."""
    rng = random.Random(11)
    share = [0.8, 0.07, 0.03, 0.06, 0.04]
    planted = [[rng.uniform(0.005, 0.08) for _ in RULES]]
    planted += [[rng.uniform(0.6, 0.95) if r.family == f else rng.uniform(0.02, 0.2) for r in RULES] for f in FAMILIES]
    abstain = [rng.uniform(0, 0.2) for _ in RULES]
    counts = Counter()
    for _ in range(20_000):
        c = rng.choices(range(5), share)[0]
        counts[tuple(0 if rng.random() < abstain[j] else -1 if rng.random() < planted[c][j] else 1 for j in range(len(RULES)))] += 1
    model, larger = fit(sorted(counts.items())), fit([(p, 10 * n) for p, n in sorted(counts.items())])
    assert abs(model.share[0] - 0.8) < 0.03
    for j in range(len(RULES)):
        want = 1 - planted[0][j], sum(s * m[j] for s, m in zip(share[1:], planted[1:])) / 0.2
        for x, y, z in zip(want, model.accuracy(j), larger.accuracy(j)):
            assert abs(x - y) < 0.05 and abs(y - z) < 0.03


def test_abstention_is_no_evidence():
    """Short texts on which rules abstain don't become a bad class."""
    full, short = (1,) * len(RULES), (1, 1, *(0,) * (len(RULES) - 2))
    bad = (-1, -1, *(1,) * (len(RULES) - 2))
    model = fit([(full, 600), (short, 300), (bad, 100)])
    assert model.chances(short)[0] > 0.8 and model.chances(bad)[0] < 0.1 and abs(model.share[0] - 0.9) < 0.03
    assert fit([]) == start()
