"""Matching blocks of two sequences: the longest common block, then what is left and right of it, and so on.

Many pairs are worked on together: each round finds the longest block of every open window of
every pair, one row of the windows at a time, so memory is linear in the sequences. The block
taken is the longest; of equally long ones that which begins first in the left sequence, then
in the right one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Cells of a row that are worked on at once.
CELLS = 1 << 20
Block = tuple[int, int, int]


def codes(sequences: Sequence[Sequence]) -> list[np.ndarray]:
    """Whole numbers for the members of sequences of anything hashable; characters are their own."""
    known: dict = {}
    return [
        np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.int32) if isinstance(s, str) else np.array([known.setdefault(x, len(known)) for x in s], np.int32)
        for s in sequences
    ]


def seeds(right: np.ndarray) -> np.ndarray:
    """A long sequence without its commonest members (of 200 or more, those in over 1 %), which begin no block."""
    if len(right) < 200:
        return right
    _, place, n = np.unique(right, return_inverse=True, return_counts=True)
    return np.where(n[place] > len(right) // 100 + 1, -2, right)


def _longest(windows: list[tuple], left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[Block]:
    a = np.full((len(windows), max(w[2] - w[1] for w in windows)), -1, np.int32)
    b = np.full((len(windows), max(w[4] - w[3] for w in windows)), -2, np.int32)
    for k, (p, i0, i1, j0, j1) in enumerate(windows):
        a[k, : i1 - i0], b[k, : j1 - j0] = left[p][i0:i1], right[p][j0:j1]
    every = np.arange(len(windows))
    run = np.zeros((len(windows), b.shape[1] + 1), np.int32)
    best, at_i, at_j = (np.zeros(len(windows), np.int32) for _ in range(3))
    for r in range(a.shape[1]):
        run[:, 1:] = (run[:, :-1] + 1) * (b == a[:, r : r + 1])
        top = run.argmax(1)
        size = run[every, top]
        won = np.flatnonzero(size > best)
        best[won], at_i[won], at_j[won] = size[won], r + 1 - size[won], top[won] - size[won]
    for (_, i0, _, j0, _), i, j, n in zip(windows, at_i.tolist(), at_j.tolist(), best.tolist()):
        yield i0 + i, j0 + j, n


def _groups(windows: list[tuple]) -> Iterator[list[tuple]]:
    """Windows of like sizes, as many as ``CELLS`` allow."""
    windows.sort(key=lambda w: (w[4] - w[3], w[2] - w[1]))
    first = 0
    for k, w in enumerate(windows):
        if k > first and (k + 1 - first) * (w[4] - w[3]) > CELLS:
            yield windows[first:k]
            first = k
    if windows:
        yield windows[first:]


def matching_blocks(lefts: Sequence[Sequence], rights: Sequence[Sequence], skip_common: bool = False) -> list[list[Block]]:
    """Per pair: (place left, place right, length) of its blocks, in order. ``skip_common``: see ``seeds``."""
    both = codes([*lefts, *rights])
    left, right = both[: len(lefts)], both[len(lefts) :]
    sown = [seeds(x) for x in right] if skip_common else right
    found: list[list[Block]] = [[] for _ in left]
    windows = [(p, 0, len(x), 0, len(y)) for p, (x, y) in enumerate(zip(left, right)) if len(x) and len(y)]
    while windows:
        later = []
        for group in _groups(windows):
            for (p, i0, i1, j0, j1), (i, j, n) in zip(group, _longest(group, left, sown)):
                if skip_common:  # a block goes on over common members, or begins with the window if there is none
                    x, y = left[p], right[p]
                    i, j = (i, j) if n else (i0, j0)
                    while n and i > i0 and j > j0 and x[i - 1] == y[j - 1]:
                        i, j, n = i - 1, j - 1, n + 1
                    while i + n < i1 and j + n < j1 and x[i + n] == y[j + n]:
                        n += 1
                if n:
                    found[p].append((i, j, n))
                    later += [w for w in ((p, i0, i, j0, j), (p, i + n, i1, j + n, j1)) if w[1] < w[2] and w[3] < w[4]]
        windows = later
    out = []
    for blocks in found:
        joined: list[Block] = []
        for i, j, n in sorted(blocks):
            if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
                i, j, n = joined[-1][0], joined[-1][1], joined.pop()[2] + n
            joined.append((i, j, n))
        out.append(joined)
    return out


def ratios(lefts: Sequence[Sequence], rights: Sequence[Sequence], skip_common: bool = True) -> list[float]:
    """Twice the matched length over both lengths; 1 for two empty sequences."""
    blocks = matching_blocks(lefts, rights, skip_common)
    return [2.0 * sum(n for _, _, n in m) / (len(x) + len(y)) if len(x) + len(y) else 1.0 for x, y, m in zip(lefts, rights, blocks)]


def edit_script(blocks: list[Block], n_left: int, n_right: int) -> list[tuple[str, int, int, int, int]]:
    """(tag, i1, i2, j1, j2) that turn the left sequence into the right one: equal, replace, delete, insert."""
    out, i, j = [], 0, 0
    for x, y, n in [*blocks, (n_left, n_right, 0)]:
        if i < x or j < y:
            out.append(("insert" if i == x else "delete" if j == y else "replace", i, x, j, y))
        if n:
            out.append(("equal", x, x + n, y, y + n))
        i, j = x + n, y + n
    return out
