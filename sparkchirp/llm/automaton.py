"""Suffix automata over sequences of integers."""

from __future__ import annotations


class SuffixAutomaton:
    """All substrings of several sequences; ``count`` holds how often each state's strings end in them (after ``finish``)."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.count: list[int] = [0]

    def add(self, sequence, times: int = 1) -> None:
        """Add one sequence that occurs ``times`` times; substrings do not reach over sequences."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, c, q)
                count[last] += times
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            count.append(times)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link = self.next, self.link
        twin = len(nxt)
        nxt.append(nxt[q].copy())
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        self.count.append(0)
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = twin
            p = link[p]
        link[q] = twin
        return twin

    def finish(self) -> None:
        """Carry end counts up the suffix links, longest strings first."""
        link, count = self.link, self.count
        size = max(self.length) + 1
        by_length: list[list[int]] = [[] for _ in range(size)]
        for s, n in enumerate(self.length):
            by_length[n].append(s)
        for states in reversed(by_length[1:]):
            for s in states:
                count[link[s]] += count[s]

    def shared(self, sequence, times: int = 2):
        """Matching statistics: for every position, the length of the longest string that ends there and occurs at
        least ``times`` times in the automaton (after ``finish``)."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        s = n = 0
        for c in sequence:
            t = nxt[s].get(c)
            while s and (t is None or count[t] < times):
                s = link[s]
                n = length[s]
                t = nxt[s].get(c)
            if t is None or count[t] < times:
                n = 0
            else:
                s = t
                n += 1
            yield n


def spans(statistics, threshold: int) -> list[tuple[int, int]]:
    """Maximal spans [begin, end) covered by matches of ``threshold`` or more, from the matching statistics."""
    out: list[tuple[int, int]] = []
    for end, n in enumerate(statistics, 1):
        if n >= threshold:
            if out and end - n <= out[-1][1]:
                out[-1] = min(out[-1][0], end - n), end
            else:
                out.append((end - n, end))
    return out
