"""Generalised suffix automaton over integer tokens."""

from __future__ import annotations

from collections.abc import Iterable


class SuffixAutomaton:
    """Every factor of the added sequences; of each state, the mark of the first sequence that has it.

    Sequences are added one after the other, and matching may go on between additions.
    """

    __slots__ = ("link", "longest", "mark", "next")

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.longest: list[int] = [0]
        self.mark: list = [None]

    def _split(self, p: int, q: int, token: int) -> int:
        """q's state for factors no longer than p's and one token."""
        nxt, link, longest = self.next, self.link, self.longest
        if longest[q] == longest[p] + 1:
            return q
        clone = len(nxt)
        nxt.append(nxt[q].copy())
        longest.append(longest[p] + 1)
        link.append(link[q])
        self.mark.append(self.mark[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(token) == q:
            nxt[p][token] = clone
            p = link[p]
        return clone

    def add(self, tokens: Iterable[int], mark=None) -> None:
        nxt, link, longest = self.next, self.link, self.longest
        last = 0
        for token in tokens:
            q = nxt[last].get(token)
            if q is not None:
                last = self._split(last, q, token)
                continue
            new = len(nxt)
            nxt.append({})
            longest.append(longest[last] + 1)
            link.append(0)
            self.mark.append(mark)
            p = last
            while p >= 0 and token not in nxt[p]:
                nxt[p][token] = new
                p = link[p]
            if p >= 0:
                link[new] = self._split(p, nxt[p][token], token)
            last = new

    def matches(self, tokens: Iterable[int]) -> Iterable[tuple[int, int]]:
        """After each token: the length of the longest factor that ends there, and its state."""
        nxt, link, longest = self.next, self.link, self.longest
        state = length = 0
        for token in tokens:
            to = nxt[state].get(token)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = nxt[state].get(token)
                if to is None:
                    state = length = 0
                    yield 0, 0
                    continue
                # state's own factors all go on with token
                length = longest[state]
            state = to
            length += 1
            yield length, state

    def least_over_occurrences(self, of_sequence: dict, sequences: Iterable[tuple[object, Iterable[int]]]) -> list:
        """Of each state, the least of_sequence value among all sequences that hold its factors."""
        least: list = [None] * len(self.next)
        for mark, tokens in sequences:
            value, state = of_sequence[mark], 0
            for token in tokens:
                state = self.next[state][token]
                if least[state] is None or value < least[state]:
                    least[state] = value
        for state in sorted(range(1, len(self.next)), key=self.longest.__getitem__, reverse=True):
            up, value = self.link[state], least[state]
            if up > 0 and value is not None and (least[up] is None or value < least[up]):
                least[up] = value
        return least
