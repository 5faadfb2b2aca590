"""Linear grouping construction of a suffix array.

Phase one groups suffixes by their longest Lyndon prefix.  Groups start as first symbols and are
processed in descending order; each member finds, along previous-smaller pointers, the last suffix
before it that lies in a lower group.  That suffix's prefix grows by the group's, so it moves into a
new group right above its old one, those that meet the group more often going higher.  Phase two walks
the suffix array upwards and puts, along the same pointers, each suffix next in its group: a group's
order follows from the order of what comes after its Lyndon prefix.  Nothing is renamed or recursed.
"""

from __future__ import annotations

from collections import Counter


def lyndon_groups(text: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix the place where its final group starts in suffix order, and the pointer to the
    previous suffix in a lower group (-1: none).  ``text`` must end in its only smallest symbol."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, start, size = [0] * n, [0] * n, [0] * (n + 1)
    begin = 0
    for k, s in enumerate(order):
        if k and text[s] != text[order[k - 1]]:
            begin = k
        place[s], start[s] = k, begin
        size[begin] += 1
    before = [-1] * n
    end = n
    while end > 0:
        low = start[order[end - 1]]
        if end - low == 1:  # one member moves one suffix at most
            end = low
            s = order[low]
            p = s - 1
            while p >= 0 and start[p] >= low:
                p = before[p]
            before[s] = p
            if p >= 0:
                g = start[p]
                size[g] -= 1
                to = g + size[g]
                at, other = place[p], order[to]
                order[at], order[to] = other, p
                place[other], place[p] = at, to
                start[p] = to
                size[to] += 1
            continue
        group = order[low:end]
        end = low
        group.sort()
        found = []
        for s in group:
            p = s - 1
            while p >= 0 and start[p] >= low:
                p = before[p]
            before[s] = p
            if p >= 0:
                found.append(p)
        if not found:
            continue
        if len(set(found)) == len(found):
            batches = [found]
        else:
            times = Counter(found)
            by_times: dict[int, list[int]] = {}
            for p, t in times.items():
                by_times.setdefault(t, []).append(p)
            batches = [by_times[t] for t in sorted(by_times, reverse=True)]
        for batch in batches:
            for p in batch:
                g = start[p]
                size[g] -= 1
                to = g + size[g]
                at, other = place[p], order[to]
                order[at], order[to] = other, p
                place[other], place[p] = at, to
            moved = [start[p] + size[start[p]] for p in batch]  # a group may have moved as a whole
            for p, g in zip(batch, moved):
                start[p] = g
                size[g] += 1
    return start, before


def suffix_array(text: list[int]) -> list[int]:
    """Suffixes of ``text`` in ascending order; its last symbol must be its only smallest one."""
    start, before = lyndon_groups(text)
    n = len(text)
    out = [0] * n
    following = list(range(n))
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    following[0] = 1
    for k in range(n):
        s = out[k] - 1
        while s >= 0 and not placed[s]:
            g = start[s]
            out[following[g]] = s
            following[g] += 1
            placed[s] = 1
            s = before[s]
    return out
