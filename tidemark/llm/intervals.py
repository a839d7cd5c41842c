"""Enhanced suffix array of a batch of byte strings and its tree of common-prefix intervals.

All strings of a batch are sorted together by prefix doubling; the common prefix of neighbours follows from the ranks of the doublings; a stack scan over it
walks the intervals of suffixes with a common prefix, and those whose suffixes are preceded by different bytes are the maximal repeats.
"""

from __future__ import annotations

import numpy as np

#: Bytes of the first sort: nine bits each, zero for what lies beyond a string's end.
WORD = 7


def ranks(value: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """Dense ranks (from 1) of all positions by their first ``WORD``, 2 ``WORD``, 4 ``WORD`` ... bytes, until nothing changes.

    ``value`` has bytes plus one, and zeros between strings; ``stop`` the end of each position's string.
    """

    def dense(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        ordered = key[order]
        new = np.ones(len(key), np.int64)
        new[1:] = ordered[1:] != ordered[:-1]
        out = np.empty(len(key), np.int64)
        out[order] = np.cumsum(new)
        return out

    n = len(value)
    padded = np.r_[value.astype(np.int64), np.zeros(WORD, np.int64)]
    word = np.zeros(n, np.int64)
    open_ = np.ones(n, bool)
    for k in range(WORD):
        open_ &= padded[k : k + n] > 0
        word = word << 9 | np.where(open_, padded[k : k + n], 0)
    out, step = [dense(word)], WORD
    longest = int((stop - np.arange(n)).max(initial=0))
    while step < longest and (most := int(out[-1].max())) < n:
        ahead = np.zeros(n, np.int64)
        inside = np.flatnonzero(np.arange(n) + step < stop)
        ahead[inside] = out[-1][inside + step]
        out.append(dense(out[-1] * (most + 1) + ahead))
        step *= 2
    return out


def common_prefix(a: np.ndarray, b: np.ndarray, value: np.ndarray, stop: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, pair by pair."""
    length = np.zeros(len(a), np.int64)
    room = np.minimum(stop[a] - a, stop[b] - b)
    last = len(value) - 1
    # The top level is asked as often as it holds: strings may be longer than it reaches.
    for depth in range(len(levels) - 1, -1, -1):
        rank, size = levels[depth], WORD << depth
        while True:
            same = (length < room) & (rank[np.minimum(a + length, last)] == rank[np.minimum(b + length, last)])
            length[same] += size
            if depth < len(levels) - 1 or not same.any():
                break
    for _ in range(WORD):
        same = (length < room) & (value[np.minimum(a + length, last)] == value[np.minimum(b + length, last)])
        length[same] += 1
        if not same.any():
            break
    return np.minimum(length, room)


def scan(lcp: list[int], place: list[int], before: list[int]) -> list[tuple[int, int, int]]:
    """Stack scan of a run of suffixes: ``lcp[k]`` is the common prefix of suffixes k and k + 1, ``place`` their order in the corpus, ``before`` the byte before
    each, or a number of its own below zero where nothing stands before.

    Yields ``(k, length, first)``: for each suffix that is not the first occurrence of some maximal repeat, the longest such and that one's first occurrence. A
    suffix joins the losers of the one interval in which an earlier one comes in; intervals with one byte before all their suffixes are no maximal repeats, and
    what they repeat belongs to a repeat that starts one byte before.
    """
    out: list[tuple[int, int, int]] = []
    mixed = -(1 << 62)
    # Each open interval: its length, its first suffix, the byte before, those that lost inside it.
    stack: list[tuple[int, int, int, list[int]]] = []

    def close(node: tuple[int, int, int, list[int]]) -> tuple[int, int]:
        length, first, left, lost = node
        if left == mixed:
            out.extend((k, length, first) for k in lost)
        return first, left

    def join(node: tuple[int, int, int, list[int]], first: int, left: int) -> tuple[int, int, int, list[int]]:
        length, mine, byte, lost = node
        lost.append(max(mine, first, key=place.__getitem__))
        return length, min(mine, first, key=place.__getitem__), byte if byte == left else mixed, lost

    for k in range(len(place)):
        depth = lcp[k] if k < len(lcp) else -1
        first, left = k, before[k] if before[k] >= 0 else -1 - k
        while stack and stack[-1][0] > depth:
            first, left = close(join(stack.pop(), first, left))
        if depth < 0:
            break
        if stack and stack[-1][0] == depth:
            stack.append(join(stack.pop(), first, left))
        else:
            stack.append((depth, first, left, []))
    return out


def repeats(data: np.ndarray, start: np.ndarray, windows: np.ndarray, place: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats among strings: positions in ``data``, lengths, and positions of the first occurrences.

    String i is ``data[start[i] : start[i] + windows[i] + min_bytes - 1]``, the strings lie one after the other; suffixes at its first ``windows[i]`` positions are
    compared. ``place`` orders these positions in the corpus (a number for each position of ``data``). A suffix at the start of its string counts as preceded by
    nothing known, which keeps the repeat that it starts.
    """
    size = windows + min_bytes - 1
    n_strings, total = len(start), int(size.sum())
    none = np.zeros(0, np.int64)
    if not total:
        return none, none, none
    # One zero after each string.
    shift = np.repeat(np.arange(n_strings), size)
    spot = np.arange(total) + shift
    value = np.zeros(total + n_strings, np.int64)
    value[spot] = data[:total].astype(np.int64) + 1
    begin = start + np.arange(n_strings)
    stop = np.repeat(begin + size, size + 1)
    levels = ranks(value, stop)
    at = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(begin, windows)
    owner = np.repeat(np.arange(n_strings), windows)
    order = np.argsort(levels[-1][at], kind="stable")
    suffix, owner = at[order], owner[order]
    lcp = common_prefix(suffix[:-1], suffix[1:], value, stop, levels)
    long = lcp >= min_bytes
    if not long.any():
        return none, none, none
    # Runs of suffixes whose neighbours share min_bytes: the tops of the tree. One with one known byte before all its suffixes has no maximal repeat.
    edge = np.flatnonzero(np.diff(np.r_[False, long, False].astype(np.int8)))
    lo, hi = edge[::2], edge[1::2] + 1  # suffixes lo to hi - 1
    where = suffix - owner  # back to positions of data
    left = np.where(suffix == begin[owner], -1, value[np.maximum(suffix - 1, 0)])
    cuts = np.c_[lo, hi].ravel()
    cuts = cuts[cuts < len(left)]
    least, most = np.minimum.reduceat(left, cuts)[::2], np.maximum.reduceat(left, cuts)[::2]
    keep = (least != most) | (least < 0)
    lo, hi = lo[keep], hi[keep]
    pair = lo[hi - lo == 2]
    first = place[where[pair]] <= place[where[pair + 1]]
    out = [(where[np.where(first, pair + 1, pair)], lcp[pair], where[np.where(first, pair, pair + 1)])]
    more: list[tuple[int, int, int]] = []
    for a, b in zip(lo[hi - lo > 2].tolist(), hi[hi - lo > 2].tolist(), strict=True):
        got = scan(lcp[a : b - 1].tolist(), place[where[a:b]].tolist(), left[a:b].tolist())
        more += [(a + k, length, a + f) for k, length, f in got]
    if more:
        k, length, f = (np.array(x, np.int64) for x in zip(*more, strict=True))
        out.append((where[k], length, where[f]))
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3))
