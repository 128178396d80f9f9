"""Maximal repetitions ("runs") of a sequence in O(n log n), with numpy.

A run is a stretch with period p that is at least 2 p long and cannot be extended.  Each run
holds a Lyndon word of length p that is the longest Lyndon word at its position under the order of the letters or
under the reverse order, so the 2 n longest Lyndon words are the only candidates; a longest common
extension to both sides confirms them.  Extensions are answered for all candidates at once from the
ranks of prefix doubling.
"""

import numpy as np


def doubled_ranks(codes: np.ndarray) -> list[np.ndarray]:
    """Ranks of the substrings of length 1, 2, 4, ... at every position, until all differ; the end is smallest."""
    n, span, levels = len(codes), 1, []
    key = codes.astype(np.int64)
    while True:
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([False], key[order[1:]] != key[order[:-1]]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        levels.append(rank)
        if int(rank.max()) == n - 1 or span >= n:
            return levels
        after = np.zeros(n, np.int64)
        after[: n - span] = rank[span:] + 1
        key = rank * (n + 1) + after
        span *= 2


def common_prefix(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at each pair of different positions."""
    n = len(levels[0])
    left, right = left.copy(), right.copy()
    start = left.copy()
    for level in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((left < n) & (right < n))
        rank = levels[level]
        same = inside[rank[left[inside]] == rank[right[inside]]]
        left[same] += 1 << level
        right[same] += 1 << level
    return left - start


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """The next position with a smaller rank, or the length."""
    values, stack = rank.tolist(), []
    found = [len(values)] * len(values)
    for i, value in enumerate(values):
        while stack and values[stack[-1]] > value:
            found[stack.pop()] = i
        stack.append(i)
    return np.array(found, np.int64)


def maximal_runs(codes: np.ndarray) -> np.ndarray:
    """(begin, end, period) of every run, once each; the period is the smallest one."""
    n = len(codes)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    codes = np.unique(codes, return_inverse=True)[1]
    forward, mirrored = doubled_ranks(codes), doubled_ranks(codes[::-1])
    starts = np.arange(n)
    found = []
    for ranks in (forward[-1], doubled_ranks(codes.max() - codes)[-1]):
        after = next_smaller(ranks)
        period = after - starts
        ahead = np.zeros(n, np.int64)
        some = after < n
        ahead[some] = common_prefix(forward, starts[some], after[some])
        behind = np.zeros(n, np.int64)
        some = starts > 0
        behind[some] = common_prefix(mirrored, n - starts[some], n - after[some])
        begin, end = starts - behind, after + ahead
        whole = end - begin >= 2 * period
        found.append(np.stack([begin, end, period], 1)[whole])
    return np.unique(np.concatenate(found), axis=0)


def periodic_stretches(codes: np.ndarray, smallest: int, copies: int, slack: int) -> np.ndarray:
    """(first, last + 1, period) of every maximal stretch of positions k with ``codes[k] == codes[k + period]``.

    Kept are periods of at least ``smallest`` whose stretch has at least ``copies * period - slack`` positions;
    that must be at least the period, so that the stretch lies in one run.  Multiples of a run's own period
    are periods as well.
    """
    runs = maximal_runs(codes)
    if not len(runs):
        return runs
    begin, end, period = runs.T
    most = (end - begin + slack) // ((copies + 1) * period)  # multiples that fit
    number = np.repeat(np.arange(len(runs)), most)
    factor = np.arange(len(number)) - np.repeat(np.cumsum(most) - most, most) + 1
    wide = period[number] * factor
    found = np.stack([begin[number], end[number] - wide, wide], 1)
    return found[wide >= smallest]
