"""Ends of files and growing files, against Python's own reads; how much is read is counted."""

import random

from fleetops.session import written
from fleetops.sources import tails as T
from fleetops.streaming import folds, stateful
from pyspark.sql import functions as F


def name(path):
    return path.rsplit("/", 1)[1]


def test_only_the_end_is_read(spark, tmp_path):
    logs, seen = tmp_path / "a b%20é", tmp_path / "seen"
    logs.mkdir(), seen.mkdir()
    for n in range(6):
        (logs / f"t{n}.log").write_bytes(b"\xff\xe4" + ("é%d\n" % n).encode() * 10 ** n)
    (logs / "other.txt").write_text("x")

    def counted(path):
        file = T.open_file(path)

        class Counting:
            __enter__, __exit__ = (lambda self: self), (lambda self, *a: file.close())
            seek = staticmethod(file.seek)

            def read(self, n):
                data = file.read(n)
                (seen / name(path)).write_text(str(len(data)))
                return data

        return Counting()

    rows = {name(r.path): r for r in T.read_tails(spark, str(logs), 1001, opened=counted).collect()}
    assert sorted(rows) == [f"t{n}.log" for n in range(6)]
    for n in range(6):
        data = (logs / f"t{n}.log").read_bytes()
        r = rows[f"t{n}.log"]
        assert (r.length, r.start, r.end, r.text) == (len(data), max(0, len(data) - 1001), len(data), data[-1001:].decode("utf-8", "replace"))
        assert int((seen / f"t{n}.log").read_text()) == min(len(data), 1001)
    plan = T.lengths(spark, str(logs))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_growth_gives_each_byte_once(spark, tmp_path):
    rng, logs, known = random.Random(4), tmp_path / "logs", None
    logs.mkdir()
    whole = {f"t{n}.log": b"" for n in range(4)}
    told = dict.fromkeys(whole, b"")
    letters = ["a", "é", "€", "\U0001f600", "\n", "\r\n"]
    for turn in range(4):
        for n, k in enumerate(whole):
            more = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 60]))).encode()
            cut = rng.randrange(len(more) + 1) if turn < 3 else len(more)
            if turn == 2 and n == 1:
                (logs / k).write_bytes(b"")  # cut short: it begins anew
                whole[k] = told[k] = b""
            else:
                data = more if turn == 3 or n == 0 else more[:cut]
                whole[k] += data
                with open(logs / k, "ab") as f:
                    f.write(data)
        if turn == 1:
            for k in whole:
                whole[k] += b"\x80\xff\x80\x80\x80\x80x"
                (logs / k).write_bytes(whole[k])
        got = written(T.read_growth(spark, str(logs), known, piece=7))
        known = written(T.ends(got, known))
        rows = got.collect()
        assert (turn == 2) == any(r.length == 0 for r in rows)
        for r in sorted(rows, key=lambda r: r.start):
            k = name(r.path)
            assert r.start == len(told[k]) and r.end - r.start == len(r.text.encode())
            told[k] += r.text.encode()
        for k, data in whole.items():
            clean = "".join("?" if "\udc80" <= c <= "\udcff" else c for c in data.decode("utf-8", "surrogateescape")).encode()
            assert len(data) - len(told[k]) < 4 and told[k] == clean[: len(told[k])]
    assert T.read_growth(spark, str(logs), known).count() == 0 and told["t0.log"]


def test_probes_of_growing_files(spark, tmp_path):
    logs, known, parts = tmp_path / "logs", None, []
    logs.mkdir()
    steps = [{"a": "warm up, serv", "b": "xx"}, {"a": "er ready\n", "b": "CUDA err"}, {"b": "or", "c": "server ready and CUDA error"}]
    for at, step in enumerate(steps):
        for k, text in step.items():
            with open(logs / f"{k}.log", "a") as f:
                f.write(text)
        got = written(T.read_growth(spark, str(logs), known, piece=5))
        known = written(T.ends(got, known))
        parts.append(got.withColumn("at", F.lit(at)))
    rows = parts[0].union(parts[1]).union(parts[2])
    out = stateful.replay(rows, folds.log_probes(["CUDA error"], ["server ready"]), "path", "at", "start").collect()
    assert {name(r.path): (r.at, r.verdict) for r in out} == {"a.log": (1, "ready"), "b.log": (2, "failed"), "c.log": (2, "ready")}
