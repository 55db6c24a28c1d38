"""A suffix array by linear grouping.

First the suffixes are grouped by their first symbols, and the groups are gone through in descending order. For each suffix
of a group its previous smaller pointer leads to the nearest suffix on its left of a lower group; groups above are skipped by
the pointers found before. The suffixes pointed to, those with the most pointers from this group last, leave their groups
and make new ones right above them: their prefixes, up to the next smaller suffix, have grown by what points to them. At the
end a group holds the suffixes of the same longest Lyndon prefix, and the groups are in order. Then one ascending pass
over the array being filled puts, for each suffix placed, the one on its left and those its pointers lead to at the next free
places of their groups. No names are made and nothing recurs.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """The order of the suffixes of a sequence of integers; a suffix that starts another comes before it."""
    # a symbol below all others ends the text
    low = min(text, default=0) - 1
    text = [*text, low]
    n = len(text)
    places: dict[int, list[int]] = {c: [] for c in sorted(set(text))}
    for i, c in enumerate(text):
        places[c].append(i)
    order = [i for c in places for i in places[c]]
    at = [0] * n  # where a suffix stands in order
    group = [0] * n  # the first place of its group
    size = [0] * n  # by first place
    start = 0
    for place, i in enumerate(order):
        if text[i] != text[order[start]]:
            start = place
        at[i] = place
        group[i] = start
        size[start] += 1
    before = [-2] * n  # the previous smaller pointers; -2: not known yet
    top = n - 1
    while top >= 0:
        start = group[order[top]]
        if start == top:
            i = order[top]
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                # the only pointer: j moves to the end of its group and becomes one of its own
                own = group[j]
                left = size[own] - 1
                if left:
                    last = own + left
                    other = order[last]
                    place = at[j]
                    order[place], order[last] = other, j
                    at[other], at[j] = place, last
                    size[own] = left
                    group[j] = last
                    size[last] = 1
        else:
            pointed: dict[int, int] = {}
            for i in order[start : top + 1]:
                if before[i] != -2:
                    continue
                # members of this group that are passed on the way lead to the same suffix
                passed, j = [i], i - 1
                while j >= 0 and group[j] >= start:
                    if before[j] == -2:
                        passed.append(j)
                        j -= 1
                    else:
                        j = before[j]
                for k in passed:
                    before[k] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + len(passed)
            if pointed:
                by_count: dict[int, list[int]] = {}
                for j, k in pointed.items():
                    if k in by_count:
                        by_count[k].append(j)
                    else:
                        by_count[k] = [j]
                for k in sorted(by_count, reverse=True) if len(by_count) > 1 else by_count:
                    moved: dict[int, int] = {}
                    for j in by_count[k]:
                        own = group[j]
                        gone = moved.get(own, 0) + 1
                        moved[own] = gone
                        last = own + size[own] - gone
                        other = order[last]
                        place = at[j]
                        order[place], order[last] = other, j
                        at[other], at[j] = place, last
                    for own, gone in moved.items():
                        left = size[own] - gone
                        if left:
                            size[own] = left
                            new = own + left
                            size[new] = gone
                            for place in range(new, new + gone):
                                group[order[place]] = new
        top = start - 1
    # each group is put in order
    free = group.copy()  # by suffix: its group's first place; the next free place is counted at that place
    fill = list(range(n))
    out = [-1] * n
    out[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for place in range(n):
        j = out[place] - 1
        while j >= 0 and not placed[j]:
            own = free[j]
            out[fill[own]] = j
            fill[own] += 1
            placed[j] = 1
            j = before[j]
    return out[1:]


def repeated(strings: Sequence[bytes], owners: Sequence[int], length: int) -> list[list[tuple[int, int]]]:
    """For each string, the runs (first, last) of starts whose `length` bytes also start in a string of a lesser owner.

    All strings are laid end to end with separators; in their suffix array equal starts are neighbours.
    """
    text: list[int] = []
    starts = []
    for s in strings:
        starts.append(len(text))
        text.extend(s)
        text.append(-1)
    whole = bytes(c if c >= 0 else 0 for c in text)
    which, limit = [0] * len(text), bytearray(len(text))
    for k, (s, a) in enumerate(zip(strings, starts, strict=True)):
        for i in range(a, a + len(s) - length + 1):
            which[i] = k
            limit[i] = 1
    hits: list[list[int]] = [[] for _ in strings]
    run: list[int] = []
    last = None

    def close() -> None:
        least = min([owners[which[i]] for i in run])
        for i in run:
            k = which[i]
            if owners[k] > least:
                hits[k].append(i - starts[k])

    for i in suffix_array(text):
        if not limit[i]:
            continue
        own = whole[i : i + length]
        if own == last:
            run.append(i)
            continue
        if len(run) > 1:
            close()
        run, last = [i], own
    if len(run) > 1:
        close()
    out: list[list[tuple[int, int]]] = []
    for own in hits:
        own.sort()
        spans: list[tuple[int, int]] = []
        for i in own:
            if spans and i == spans[-1][1] + 1:
                spans[-1] = (spans[-1][0], i)
            else:
                spans.append((i, i))
        out.append(spans)
    return out
