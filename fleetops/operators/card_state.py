"""The debounce state of a card: which samples take it out of use and bring it back."""

from __future__ import annotations

from typing import NamedTuple

FREE, UNMANAGED, QUARANTINED = "free", "unmanaged", "quarantined"
UTIL_RUN, CLEAN_RUN, FAILURES = 3, 2, 5


class CardState(NamedTuple):
    state: str = FREE
    run: int = 0
    failures: int = 0


def advance(card: CardState, sample: str) -> tuple[CardState, bool]:
    """The state after a sample, and whether work may start on the card.

    sample: clean; util (use seen, no process); pid (a process, or a probe that can't tell); failed (no probe). A null
    or unknown sample counts as pid: what isn't known is never capacity.
    """
    if card.state == QUARANTINED:
        return card, False
    if sample == "failed":
        n = card.failures + 1
        return (CardState(QUARANTINED) if n >= FAILURES else card._replace(failures=n)), False
    if card.state == FREE:
        if sample == "clean":
            return CardState(), True
        if sample == "util" and card.run + 1 < UTIL_RUN:
            return CardState(FREE, card.run + 1), False
        return CardState(UNMANAGED), False
    if sample == "clean":
        return (CardState() if card.run + 1 >= CLEAN_RUN else CardState(UNMANAGED, card.run + 1)), card.run + 1 >= CLEAN_RUN
    return CardState(UNMANAGED), False


def reachable() -> list[CardState]:
    """All states that samples lead to, the first one first."""
    found = [CardState()]
    for card in found:
        found += [c for c in dict.fromkeys(advance(card, s)[0] for s in ("clean", "util", "pid", "failed")) if c not in found]
    return found
