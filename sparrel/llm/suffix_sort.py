"""Linear suffix sorting by grouping.

Suffixes are grouped by their longest Lyndon prefix. Groups start as first symbols and are processed
from the highest down: each suffix of a group looks up, through the pointers of suffixes already
processed, the closest suffix before it that lies in a lower group, and that suffix's prefix grows by
the group's. Suffixes that grow alike split off as a group above the rest of theirs. In the end each
group is a run of the result, and one pass over the result in order fills the runs: the suffixes
whose next smaller suffix is the current one follow each other along the same pointers. Nothing is
renamed and nothing recurses.
"""

from __future__ import annotations

from collections.abc import Sequence

_OPEN = -2


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of a sequence of integers from 0, not much larger than its length, in ascending order; a prefix comes before what it begins."""
    n = len(text)
    by_symbol: list[list[int]] = [[] for _ in range(max(text) + 1)] if n else []
    for s, symbol in enumerate(text):
        by_symbol[symbol].append(s)
    order = [s for group in by_symbol for s in group]
    place, start, size = [0] * n, [0] * n, [0] * n  # of each suffix; its group's first place; by first place
    at = 0
    while at < n:
        first, symbol = at, text[order[at]]
        while at < n and text[order[at]] == symbol:
            place[order[at]], start[order[at]] = at, first
            at += 1
        size[first] = at - first
    before = [_OPEN] * n

    end = n
    while end:
        group = start[order[end - 1]]
        times: dict[int, int] = {}
        for s in order[group:end]:
            # Members that stand before this one in the text get their pointers first, so no order is needed.
            waiting = [s] if before[s] == _OPEN else []
            while waiting:
                p = waiting[-1] - 1
                while p >= 0 and start[p] >= group and before[p] != _OPEN:
                    p = before[p]
                if p >= 0 and start[p] >= group:
                    waiting.append(p)
                    continue
                before[waiting.pop()] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
        if times:
            by_times: dict[int, list[int]] = {}
            for p, k in times.items():
                by_times.setdefault(k, []).append(p)
            # k different numbers of times need k * k / 2 members, so sorting them stays below linear.
            for k in sorted(by_times, reverse=True):
                moved: dict[int, int] = {}
                for p in by_times[k]:
                    old = start[p]
                    count = moved[old] = moved.get(old, 0) + 1
                    to = old + size[old] - count
                    other, here = order[to], place[p]
                    order[here], order[to] = other, p
                    place[other], place[p] = here, to
                for old, count in moved.items():
                    left = size[old] - count
                    if left:
                        size[old], size[old + left] = left, count
                        for to in range(old + left, old + left + count):
                            start[order[to]] = old + left
        end = group

    result, done, rank, s = [0] * n, [False] * n, 0, n
    room = list(range(n))  # by group: the next free place
    while True:
        p = s - 1
        while p >= 0 and not done[p]:
            result[room[start[p]]] = p
            room[start[p]] += 1
            done[p] = True
            p = before[p]
        if rank == n:
            return result
        s = result[rank]
        rank += 1


def common_prefixes(text: Sequence[int], suffixes: Sequence[int]) -> list[int]:
    """For each place of the suffix array the common prefix length with the place before it."""
    n = len(text)
    rank, out, run = [0] * n, [0] * n, 0
    for r, s in enumerate(suffixes):
        rank[s] = r
    for s in range(n):
        if not rank[s]:
            run = 0
            continue
        other = suffixes[rank[s] - 1]
        while s + run < n and other + run < n and text[s + run] == text[other + run]:
            run += 1
        out[rank[s]] = run
        if run:
            run -= 1
    return out
