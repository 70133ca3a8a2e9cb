"""A trie searched with a Levenshtein automaton.

The automaton of a word is simulated as the row of a banded edit-distance table: one row per trie node on the way, cut
off as soon as the whole row exceeds the bound. An exchange of neighbouring characters counts as one edit.

Search is exact: every entry within the bound of the query comes back, an empty query meets the entries no longer than
the bound, and an empty trie gives nothing.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable


class Trie:
    """Entries with values; one entry may carry several values (an alias path per value)."""

    def __init__(self, entries: Iterable[tuple[str, Hashable]] = ()):
        self.next: list[dict[str, int]] = [{}]
        self.values: list[list[Hashable]] = [[]]
        self._longest: list[int] = []
        for word, value in entries:
            self.add(word, value)

    def add(self, word: str, value: Hashable) -> None:
        """One entry; equal ones count once."""
        node = 0
        for c in word:
            step = self.next[node].get(c)
            if step is None:
                step = len(self.next)
                self.next[node][c] = step
                self.next.append({})
                self.values.append([])
            node = step
        if value not in self.values[node]:
            self.values[node].append(value)
            self._longest = []

    def exact(self, word: str) -> list[Hashable]:
        """Values of the entry that equals `word`."""
        node = 0
        for c in word:
            step = self.next[node].get(c)
            if step is None:
                return []
            node = step
        return self.values[node]

    def within(self, word: str, bound: int) -> list[tuple[str, Hashable, int]]:
        """(entry, value, distance) of all entries at most `bound` edits from `word`."""
        found: list[tuple[str, Hashable, int]] = []
        n = len(word)
        first = list(range(n + 1))
        if first[n] <= bound:
            found += [("", v, n) for v in self.values[0]]
        stack = [(step, c, c, first, None, "") for c, step in self.next[0].items()]
        while stack:
            node, c, path, above, above2, before = stack.pop()
            depth = len(path)
            row = [depth] + [bound + 1] * n
            lo, hi = max(1, depth - bound), min(n, depth + bound)
            for j in range(lo, hi + 1):
                d = above[j - 1] + (word[j - 1] != c)
                if above[j] + 1 < d:
                    d = above[j] + 1
                if row[j - 1] + 1 < d:
                    d = row[j - 1] + 1
                if above2 is not None and j > 1 and word[j - 1] == before and word[j - 2] == c and above2[j - 2] + 1 < d:
                    d = above2[j - 2] + 1
                row[j] = d
            if min(row[max(0, lo - 1) : hi + 1], default=bound + 1) > bound:
                continue
            if row[n] <= bound:
                found += [(path, v, row[n]) for v in self.values[node]]
            stack += [(step, x, path + x, row, above, c) for x, step in self.next[node].items()]
        return found

    def longest(self) -> list[int]:
        """For each node the length of the longest entry through it; kept until the trie grows."""
        if len(self._longest) != len(self.next):
            out, order = [0] * len(self.next), [(0, 0)]
            for node, depth in order:
                order += [(step, depth + 1) for step in self.next[node].values()]
            for node, depth in reversed(order):
                out[node] = max([depth if self.values[node] else 0, *(out[step] for step in self.next[node].values())])
            self._longest = out
        return self._longest

    def scan(self, text: str, bound_of, starts: Iterable[int] | None = None, first_stands: bool = False) -> list[tuple[int, int, Hashable, int]]:
        """(start, end, value, edits) of every entry met inside `text` within bound_of(entry length) edits, 0 or 1.

        From every start, or each of `starts`, the automaton's states (trie node, place in the text, edits) walk the
        trie along the text; an edit is tried only where an entry long enough for one lies ahead (bounds never fall
        with length). With `first_stands` an entry's first letter is never the one edited.
        """
        out = []
        longest = self.longest()
        edit = [bound_of(n) > 0 for n in range(max(longest) + 1)]
        for at in range(len(text)) if starts is None else starts:
            stack, seen = [(0, at, 0, 0)], set()
            while stack:
                node, pos, edits, depth = stack.pop()
                if (node, pos, edits) in seen:
                    continue
                seen.add((node, pos, edits))
                if self.values[node] and edits <= bound_of(depth):
                    out += [(at, pos, v, edits) for v in self.values[node]]
                here = text[pos] if pos < len(text) else None
                step = self.next[node].get(here) if here is not None else None
                if step is not None and (not edits or edit[longest[step]]):
                    stack.append((step, pos + 1, edits, depth + 1))
                if edits == 0 and (node or (depth == 0 and not first_stands)) and edit[longest[node]]:
                    for x, other in self.next[node].items():
                        if x != here and edit[longest[other]]:
                            if node or here is not None:
                                stack.append((other, pos, 1, depth + 1))  # left out
                            if here is not None:
                                stack.append((other, pos + 1, 1, depth + 1))  # changed
                    if here is not None and node:
                        stack.append((node, pos + 1, 1, depth))  # put in
        return out
