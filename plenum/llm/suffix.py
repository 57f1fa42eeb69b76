"""Suffix arrays by linear grouping (after Baier's two-phase construction), of many texts in step.

Phase 1 puts suffixes with the same Lyndon prefix into one group and keeps the groups in the order of these
prefixes.  At first a group is a first byte.  Groups are processed in descending order: each of its
suffixes points to the nearest earlier suffix of a smaller group; that one's Lyndon prefix is then
followed by as many copies of this group's prefix as there are suffixes that point to it, so it moves up
behind the rest of its own group.  Phase 2 reads the array from its smallest suffix on and puts, at the
front of its group, the suffix before it and those that its pointers lead to.  Nothing is renamed, and no
string is sorted again.

Texts don't touch each other, so their highest unprocessed groups, and in phase 2 their smallest unread
suffixes, are taken in one NumPy step for all of them.
"""

from __future__ import annotations

import numpy as np


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then those of first[1], and so on."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


class Groups:
    """Phase 1 over texts that lie one after another in ``buf``; text k is ``bounds[k]:bounds[k + 1]``."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray):
        n, sizes = len(buf), np.diff(bounds)
        key = (np.repeat(np.arange(len(sizes), dtype=np.int64) << 8, sizes) | buf) << 32 | np.arange(n)
        key.sort()
        self.bounds = bounds
        self.order = key & 0xFFFFFFFF
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        key >>= 32
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(first, n))
        self.group = np.empty(n, np.int64)  # the first place of each suffix's group
        self.group[self.order] = np.repeat(first, size)
        self.size = np.zeros(n, np.int64)  # by first place
        self.size[first] = size
        self.pointer = np.full(n, -1, np.int64)
        self._count, self._seen, self._moves = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        low, last = bounds[:-1], bounds[1:] - 1
        while True:
            some = np.flatnonzero(last >= low)
            if not len(some):
                return
            low, last = low[some], last[some]
            first = self.group[self.order[last]]
            self._process(first, last - first + 1, low)
            last = first - 1

    def _process(self, first: np.ndarray, count: np.ndarray, low: np.ndarray) -> None:
        """The group at ``first`` of each text that has one left."""
        own, floor, least = self.order[_spread(first, count)], np.repeat(first, count), np.repeat(low, count)
        back = own - 1
        self.pointer[own] = back  # until it is found, a step towards it
        todo = np.arange(len(own))
        while len(todo):
            at = back[todo]
            todo = todo[at >= least[todo]]
            todo = todo[self.group[back[todo]] >= floor[todo]]
            back[todo] = self.pointer[back[todo]]
            self.pointer[own[todo]] = back[todo]
        inside = back >= least
        self.pointer[own] = np.where(inside, back, -1)
        self._move_up(back[inside])

    def _move_up(self, pointed: np.ndarray) -> None:
        """Suffixes that were pointed to go behind the rest of their groups, by how often they were."""
        if not len(pointed):
            return
        turn = np.arange(len(pointed))
        np.add.at(self._count, pointed, 1)
        self._seen[pointed] = turn
        moved = pointed[self._seen[pointed] == turn]
        copies = self._count[moved]
        self._count[moved] = 0
        old = self.group[moved]
        key = old * (len(self.order) + 1) + copies
        turn = np.argsort(key)
        moved, key = moved[turn], key[turn]
        old = key // (len(self.order) + 1)
        starts = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        number, of = np.diff(np.append(starts, len(old))), old[starts]
        tail = of + self.size[of] - number
        self.size[of] -= number
        to = _spread(tail, number)
        held = self.order[to]
        self._moves[moved] = True
        stays = held[~self._moves[held]]
        self._moves[moved] = False
        left = self.place[moved]
        left = left[left < np.repeat(tail, number)]
        self.order[left], self.place[stays] = stays, left
        self.order[to], self.place[moved] = moved, to
        runs = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(runs, len(old)))
        self.size[to[runs]] = length
        self.group[moved] = np.repeat(to[runs], length)


#: A text of so many bytes is read alone in phase 2: its suffixes come one after another anyway.
LONG = 8 << 10


def _read_alone(g: Groups, out: np.ndarray, low: int, high: int) -> None:
    """Phase 2 of one text."""
    group, pointer = (g.group[low:high] - low).tolist(), (g.pointer[low:high] - low).tolist()
    n = high - low
    own, free, placed = [-1] * n, list(range(n)), bytearray(n)
    at = n  # the empty suffix comes first of all
    for k in range(n + 1):
        p = at - 1
        while p >= 0 and not placed[p]:
            placed[p] = 1
            of = group[p]
            own[free[of]] = p
            free[of] += 1
            p = pointer[p]
        if k < n:
            at = own[k]
    out[low:high] = np.array(own, np.int64) + low


def suffix_arrays(buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text ``bounds[k]:bounds[k + 1]`` of the bytes ``buf``, in its own places: the starts (in
    ``buf``) of its suffixes in ascending order."""
    bounds = np.asarray(bounds, np.int64)
    g = Groups(buf, bounds)
    n = len(buf)
    out, free, placed = np.full(n, -1, np.int64), np.arange(n), np.zeros(n, bool)
    low, high = bounds[:-1], bounds[1:]
    alone = high - low >= LONG
    for a, z in zip(low[alone].tolist(), high[alone].tolist(), strict=True):
        _read_alone(g, out, a, z)
    low, high = low[~alone], high[~alone]
    longest = np.argsort(low - high, kind="stable")
    low, high = low[longest], high[longest]
    sizes = high - low
    at = high  # the empty suffix comes first of all
    for k in range(int(sizes[0]) + 1 if len(sizes) else 0):
        back, least = at - 1, low
        while True:
            inside = back >= least
            back, least = back[inside], least[inside]
            new = ~placed[back]
            back, least = back[new], least[new]
            if not len(back):
                break
            placed[back] = True
            of = g.group[back]
            out[free[of]] = back
            free[of] += 1
            back = g.pointer[back]
        low = low[: int(np.searchsorted(-sizes, -k, side="left"))]  # texts with more than k suffixes
        at = out[low + k]
    return out


def suffix_array(text: bytes) -> list[int]:
    """The starts of the suffixes of ``text`` in ascending order."""
    return suffix_arrays(np.frombuffer(text, np.uint8), np.array([0, len(text)])).tolist()
