"""A generalised suffix automaton."""

from __future__ import annotations


class SuffixAutomaton:
    """All runs of symbols of several sequences, each run in the state that ends wherever the run ends.

    State 0 is the empty run. ``link`` leads to the longest suffix that ends in more places, ``length`` is that of a
    state's longest run.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list[int]) -> list[int]:
        """Adds a sequence; the states of its prefixes."""
        states, last = [], 0
        for symbol in sequence:
            last = self._extend(last, symbol)
            states.append(last)
        return states

    def state(self, sequence: list[int]) -> int:
        """State of a run that is known to occur."""
        state = 0
        for symbol in sequence:
            state = self.next[state][symbol]
        return state

    def longest_first(self) -> list[int]:
        return sorted(range(1, len(self.length)), key=lambda state: -self.length[state])

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _extend(self, last: int, symbol: int) -> int:
        known = self.next[last].get(symbol)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, symbol)
        state, at = self._new(self.length[last] + 1, 0, {}), last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = state
            at = self.link[at]
        if at >= 0:
            target = self.next[at][symbol]
            fits = self.length[target] == self.length[at] + 1
            self.link[state] = target if fits else self._split(at, target, symbol)
        return state

    def _split(self, at: int, target: int, symbol: int) -> int:
        part = self._new(self.length[at] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = part
        while at >= 0 and self.next[at].get(symbol) == target:
            self.next[at][symbol] = part
            at = self.link[at]
        return part
