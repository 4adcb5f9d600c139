"""Many patterns at once in a text that comes in pieces: the automaton of Aho and Corasick, whose node is all that has to be
kept between two pieces."""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping


class Marks:
    """Patterns, each with a verdict. Nodes are numbered in the order of the patterns, so equal patterns give equal nodes."""

    def __init__(self, patterns: Mapping[str, str]):
        self.next: list[dict[str, int]] = [{}]
        self.told: list[frozenset[str]] = [frozenset()]
        for text, verdict in patterns.items():
            if not text:
                raise ValueError("an empty pattern is found everywhere")
            node = 0
            for c in text:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.told.append(frozenset())
                node = self.next[node][c]
            self.told[node] |= {verdict}
        self.back = [0] * len(self.next)
        todo = deque(self.next[0].values())
        while todo:
            node = todo.popleft()
            for c, child in self.next[node].items():
                self.back[child] = self.step(self.back[node], c)
                self.told[child] |= self.told[self.back[child]]
                todo.append(child)

    def step(self, node: int, c: str) -> int:
        while node and c not in self.next[node]:
            node = self.back[node]
        return self.next[node].get(c, 0)

    def feed(self, node: int, text: str) -> tuple[int, frozenset[str]]:
        """The node after the text, and the verdicts of all patterns that end in it."""
        found: frozenset[str] = frozenset()
        for c in text:
            node = self.step(node, c)
            if self.told[node]:
                found |= self.told[node]
        return node, found
