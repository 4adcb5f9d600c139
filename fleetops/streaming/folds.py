"""The alarm rules, each a step from a state and a row to the next state and what it tells. Times are whole seconds.

A state is a tuple as in its schema; None before the first row of a key. A row is a tuple of the fields that the rule
names. Batch replay and streams run the same steps.

A rule about silence has a time at which it falls `due` if no row comes until then, and what happens then (`fire`). It is
fired before a later row is taken, and without one when the time has passed: in a replay up to its `now`, in a stream when
the watermark has gone by. A row at the very time is still in time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from fleetops.operators.card_state import CardState, advance
from fleetops.streaming.automaton import Marks


class Rule(NamedTuple):
    fields: tuple[str, ...]  # what a row holds, beside the key and the time
    state: str
    out: str
    step: Callable[[tuple | None, int, tuple], tuple[tuple, list[tuple]]]
    due: Callable[[tuple], int | None] | None = None
    fire: Callable[[tuple, int], tuple[tuple, list[tuple]]] | None = None


def passed(rule: Rule, state: tuple | None, until: int) -> tuple[tuple | None, list[tuple]]:
    """Fire what has fallen due before `until`, one after another."""
    told: list[tuple] = []
    while rule.due and state is not None and (at := rule.due(state)) is not None and at < until:
        state, out = rule.fire(state, at)
        told += out
    return state, told


def card_state() -> Rule:
    """After each sample the state of the card, and whether it may be used."""

    def step(state: tuple | None, at: int, row: tuple) -> tuple[tuple, list[tuple]]:
        card, usable = advance(CardState(*state) if state else CardState(), row[0])
        return tuple(card), [(at, card.state, usable)]

    return Rule(("sample",), "state string, run int, failures int", "at long, state string, dispatchable boolean", step)


def freeze(percent: int = 85) -> Rule:
    """A row when use passes percent of the capacity, and one when it no longer does."""

    def step(state: tuple | None, at: int, row: tuple) -> tuple[tuple, list[tuple]]:
        used, capacity = row
        now = used is not None and bool(capacity) and 100 * used > percent * capacity
        was = bool(state and state[0])
        return (now,), ([(at, "frozen" if now else "thawed")] if now != was else [])

    return Rule(("used", "capacity"), "frozen boolean", "at long, change string", step)


def timeouts() -> Rule:
    """A row when a job that has started hasn't ended when its limit has passed; once for a start, which may be repeated. A
    limit that is null or not above zero is none."""

    def step(state: tuple | None, at: int, row: tuple) -> tuple[tuple, list[tuple]]:
        kind, limit = row
        if kind == "start":
            return (at, int(limit) if limit and limit > 0 else 0, False), []
        return (-1, 0, True) if kind == "end" or state is None else state, []

    def due(state: tuple) -> int | None:
        start, most, told = state
        return None if told or most <= 0 else start + most

    def fire(state: tuple, at: int) -> tuple[tuple, list[tuple]]:
        return (*state[:2], True), [(at, at - state[0])]

    return Rule(("kind", "limit"), "start long, most long, told boolean", "at long, ran long", step, due, fire)


def heartbeat_gap(most: int = 90, every: int | None = 600) -> Rule:
    """A row when no beat has come for `most` seconds, and again each `every` seconds as long as none comes; two rows lie so
    far apart over several gaps, too. every None: one row for each gap."""

    def step(state: tuple | None, at: int, row: tuple) -> tuple[tuple, list[tuple]]:
        return (at, state[1] if state else -(1 << 60), False), []

    def due(state: tuple) -> int | None:
        beat, told, again = state
        return beat + most if every is None and not again else None if every is None else max(beat + most, told + every)

    def fire(state: tuple, at: int) -> tuple[tuple, list[tuple]]:
        return (state[0], at, True), [(at, at - state[0])]

    return Rule((), "beat long, told long, again boolean", "at long, gap long", step, due, fire)


def no_progress(after: int = 600, most: int = 3) -> Rule:
    """A row when a checkpoint's digest hasn't changed for `after` seconds, again each so many, `most` times in a row; rows
    that bring the same digest are no progress, nor is a null one after another."""

    def step(state: tuple | None, at: int, row: tuple) -> tuple[tuple, list[tuple]]:
        digest = row[0] or ""
        return (digest, at, at, 0) if state is None or state[0] != digest else state, []

    def due(state: tuple) -> int | None:
        return state[2] + after if state[3] < most else None

    def fire(state: tuple, at: int) -> tuple[tuple, list[tuple]]:
        digest, since, _, n = state
        return (digest, since, at, n + 1), [(at, at - since, n + 1)]

    return Rule(("digest",), "digest string, since long, told long, n int", "at long, stalled long, notice int", step, due, fire)


def inbox() -> Rule:
    """For each request of an id: accepted (the first), replay (the same binding again) or conflict (another one)."""

    def step(state: tuple | None, at: int, row: tuple) -> tuple[tuple, list[tuple]]:
        binding = row[0] or ""
        if state is None:
            return (binding,), [(at, "accepted")]
        return state, [(at, "replay" if binding == state[0] else "conflict")]

    return Rule(("binding",), "binding string", "at long, outcome string", step)


def log_probes(failed: Sequence[str], ready: Sequence[str]) -> Rule:
    """The first verdict of a job's log, which comes in pieces: failed or ready, by the patterns that it holds; of two in
    one piece failed wins.

    A row has a piece's text and the byte at which it starts (null: where the last one ended). A pattern may begin in one
    piece and end in a later one. A piece that starts elsewhere, as the log was cut short or a part of it was left out, is
    looked at by itself. Line ends count as \\n, however they are written."""
    marks = Marks({p: "ready" for p in ready} | {p: "failed" for p in failed})

    def step(state: tuple | None, at: int, row: tuple) -> tuple[tuple, list[tuple]]:
        text, start = row[0] or "", row[1]
        verdict, node, cr, end = state or ("", 0, False, 0)
        if verdict:
            return state, []
        if start is not None and start != end:
            node, cr, end = 0, False, int(start)
        lines = (text[1:] if cr and text[:1] == "\n" else text).replace("\r\n", "\n").replace("\r", "\n")
        node, found = marks.feed(node, lines)
        verdict = "failed" if "failed" in found else "ready" if found else ""
        state = (verdict, node, text.endswith("\r") if text else cr, end + len(text.encode()))
        return state, ([(at, verdict)] if verdict else [])

    return Rule(("text", "start"), "verdict string, node int, cr boolean, end long", "at long, verdict string", step)


def latch(every: int = 3600) -> Rule:
    """Once invalid always invalid; a row on a change, and else when the last one is `every` seconds old."""

    def step(state: tuple | None, at: int, row: tuple) -> tuple[tuple, list[tuple]]:
        valid = bool(row[0]) and (state is None or state[0])
        if state is None or state[0] != valid or at - state[1] >= every:
            return (valid, at), [(at, valid)]
        return state, []

    return Rule(("valid",), "valid boolean, told long", "at long, valid boolean", step)
