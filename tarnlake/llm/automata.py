"""Suffix automata of reference words, and what streamed words match in them."""

from __future__ import annotations


class SuffixAutomaton:
    """Of several runs of words; for each state the least end of its strings, in the order in which runs were added."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        self.size = 0

    def _clone(self, p: int, q: int, word: int) -> int:
        """A state for the shorter strings of q, those that go on from p."""
        follow, link = self.next, self.link
        made = len(follow)
        follow.append(follow[q].copy())
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        self.first.append(self.first[q])
        link[q] = made
        while p != -1 and follow[p].get(word) == q:
            follow[p][word] = made
            p = link[p]
        return made

    def add(self, words: list[int]) -> None:
        follow, link, length, first = self.next, self.link, self.length, self.first
        last, at = 0, self.size
        for word in words:
            q = follow[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, q, word)
            else:
                made = len(follow)
                follow.append({})
                link.append(0)
                length.append(length[last] + 1)
                first.append(at)
                p = last
                while p != -1 and word not in follow[p]:
                    follow[p][word] = made
                    p = link[p]
                if p != -1:
                    q = follow[p][word]
                    link[made] = q if length[q] == length[p] + 1 else self._clone(p, q, word)
                last = made
            at += 1
        self.size = at

    def starts(self, words: list[int], least: int, origin: list[int], own: int, step: int = 0) -> list[int]:
        """Where strings of ``least`` words start that also start in the reference at an origin below ``own``, which grows by step a word.

        Along the words runs the longest match that ends there (matching statistics). Where that of the whole match is too late,
        the state of its last ``least`` words is asked, which may have stood earlier.
        """
        follow, link, length, first = self.next, self.link, self.length, self.first
        state = size = 0
        found = []
        for i, word in enumerate(words):
            to = follow[state].get(word)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = follow[state].get(word)
            if to is None:
                size = 0
                continue
            state, size = to, size + 1
            if size >= least:
                x, bound = state, own + step * (i - least + 1)
                while origin[first[x] - least + 1] >= bound:
                    x = link[x]
                    if length[x] < least:
                        break
                else:
                    found.append(i - least + 1)
        return found
