"""Suffix sorting by Lyndon groups, many texts in step.

Phase 1 puts every suffix into the group of its Lyndon prefix: groups are taken in
descending order; each member finds, over previous-smaller pointers, the suffix
before it in a lower group; those suffixes grow by the group's prefix, once for
every member that points to them, and move to groups of their own at the upper end
of their old group.  Phase 2 goes through the suffixes in ascending order and lets
each emit the suffixes whose Lyndon prefix ends at its start, each to the next place
of its group.  No ranks are renamed and nothing recurs.

Texts lie one after the other in one array; a step takes the highest open group (or
the next suffix) of every text at once, so the work is a number of array operations
per step, and the number of steps follows the longest text.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions of all suffixes, sorted inside each text.

    Text t is ``symbols[offsets[t]:offsets[t + 1]]``; its last symbol must be 0 and
    occur nowhere else in it.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    slots, place, group, end = _first_groups(symbols, text)
    previous, length = _grow_groups(slots, place, group, end, offsets, text)
    return _emit(group, previous, length, offsets)


def _first_groups(symbols: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """Suffixes by text and first symbol: (slot -> suffix, suffix -> slot, suffix ->
    first slot of its group, first slot -> end of the group)."""
    n = len(symbols)
    key = text * (int(symbols.max()) + 1) + symbols
    slots = np.argsort(key, kind="stable")
    place = np.empty(n, np.int64)
    place[slots] = np.arange(n)
    begins = np.flatnonzero(np.diff(key[slots], prepend=-1))
    sizes = np.diff(np.append(begins, n))
    group = np.empty(n, np.int64)
    group[slots] = np.repeat(begins, sizes)
    end = np.zeros(n, np.int64)
    end[begins] = begins + sizes
    return slots, place, group, end


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _grow_groups(slots: np.ndarray, place: np.ndarray, group: np.ndarray, end: np.ndarray,
                 offsets: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1 on the arrays in place; returns previous-smaller pointers and prefix lengths."""
    n = len(slots)
    previous = np.arange(n) - 1
    length = np.ones(n, np.int64)
    moves = np.zeros(n, bool)
    low = offsets[:-1]
    top = offsets[1:].copy()  # slots from here on are done
    active = np.flatnonzero(top > low)
    while len(active):
        begin = group[slots[top[active] - 1]]
        size = top[active] - begin
        members = slots[_ranges(begin, size)]
        own = np.repeat(begin, size)
        first = np.repeat(low[active], size)
        # Nearest position to the left in a lower group.
        back = members - 1
        open_ = np.flatnonzero(back >= first)
        open_ = open_[group[back[open_]] >= own[open_]]
        while len(open_):
            previous[members[open_]] = back[open_]
            back[open_] = previous[back[open_]]
            open_ = open_[back[open_] >= first[open_]]
            open_ = open_[group[back[open_]] >= own[open_]]
        previous[members] = back
        grown = length[members[np.cumsum(size) - 1]]
        top[active] = begin
        valid = back >= first
        if valid.any():
            heads, times = np.unique(back[valid], return_counts=True)
            word = np.zeros(len(low), np.int64)
            word[active] = grown
            length[heads] += times * word[text[heads]]
            _split(slots, place, group, end, moves, heads, times)
        active = active[top[active] > low[active]]
    return previous, length


def _split(slots: np.ndarray, place: np.ndarray, group: np.ndarray, end: np.ndarray, moves: np.ndarray,
           heads: np.ndarray, times: np.ndarray) -> None:
    """Move ``heads`` to the upper ends of their groups, in new groups by ``times``."""
    order = np.lexsort((times, group[heads]))
    heads, times = heads[order], times[order]
    old = group[heads]
    starts = np.flatnonzero(np.diff(old, prepend=-1))
    counts = np.diff(np.append(starts, len(heads)))
    which = old[starts]
    upper = end[which]
    target = _ranges(upper - counts, counts)
    # Whoever lies in the upper end and stays takes a slot that a head leaves.
    moves[heads] = True
    holders = slots[target]
    displaced = holders[~moves[holders]]
    moves[heads] = False
    left = place[heads]
    left = left[left < np.repeat(upper - counts, counts)]
    slots[left] = displaced
    place[displaced] = left
    slots[target] = heads
    place[heads] = target
    end[which] = upper - counts
    sub = np.flatnonzero((np.diff(old, prepend=-1) != 0) | (np.diff(times, prepend=-1) != 0))
    sizes = np.diff(np.append(sub, len(heads)))
    begins = target[sub]
    group[heads] = np.repeat(begins, sizes)
    end[begins] = begins + sizes


def _emit(group: np.ndarray, previous: np.ndarray, length: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Phase 2: every suffix, in ascending order, places those that end at its start."""
    n = len(group)
    out = np.empty(n, np.int64)
    free = np.arange(n)  # next place of each group, by its first slot
    low, size = offsets[:-1], np.diff(offsets)
    some = np.flatnonzero(size > 0)
    out[low[some]] = offsets[1:][some] - 1
    order = some[np.argsort(-size[some], kind="stable")]
    sizes = -size[order]
    for step in range(int(size.max(initial=0))):
        now = order[:np.searchsorted(sizes, -step, side="left")]
        at = out[low[now] + step]
        first = low[now]
        head, goal = at - 1, at
        while True:
            live = head >= first
            head, goal, first = head[live], goal[live], first[live]
            live = head + length[head] == goal
            head, goal, first = head[live], goal[live], first[live]
            if not len(head):
                break
            to = free[group[head]]
            out[to] = head
            free[group[head]] = to + 1
            head = previous[head]
    return out
