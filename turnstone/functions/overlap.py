"""The longest run that two sequences of hashes have in common, in time near to linear."""

from __future__ import annotations

import numpy as np


def _names(both: np.ndarray, width: int, levels: list[np.ndarray]) -> np.ndarray:
    """A number for each run of width positions; equal runs have equal numbers. levels[k] has those of 2^k positions."""
    k = width.bit_length() - 1
    a = levels[k]
    if width == 1 << k:
        return a
    n = len(both) - width + 1
    shift = width - (1 << k)
    return np.unique(a[:n] * (a.max() + 1) + a[shift : shift + n], return_inverse=True)[1]


#: Pairs of positions up to which the runs are counted one by one.
SMALL = 20_000


def _by_pairs(a: list, b: list, by_shift: bool) -> tuple[int, int, int] | None:
    at: dict = {}
    for i, h in enumerate(a):
        at.setdefault(h, []).append(i)
    best, before = None, {}
    for j, h in enumerate(b):
        now = {i: before.get(i - 1, 0) + 1 for i in at.get(h, ())}
        for i, n in now.items():
            start, other = j - n + 1, i - n + 1
            key = (-n, start - other, start) if by_shift else (-n, start, other)
            if best is None or key < best[0]:
                best = key, (other, start, n)
        before = now
    return None if best is None else best[1]


def longest_run(a: list | np.ndarray, b: list | np.ndarray, least: int = 1, by_shift: bool = False) -> tuple[int, int, int] | None:
    """(start in a, start in b, length) of the longest run that both have, of ``least`` positions or more, else None.

    Of equally long ones that with the smallest start in b counts, then in a; by_shift: with the smallest b - a, then in b. Runs of 1, 2, 4, ... positions get numbers
    from pairs of those half as long, so the length is found by doubling and halving; a value that repeats often costs
    nothing more.
    """
    n, m = len(a), len(b)
    if min(n, m) < max(1, least):
        return None
    if n * m <= SMALL:
        run = _by_pairs(list(a), list(b), by_shift)
        return run if run is not None and run[2] >= least else None
    # one position between the two sequences that equals no other
    both = np.unique(np.concatenate([np.asarray(a, object), np.asarray(b, object)]), return_inverse=True)[1].astype(np.int64)
    both = np.concatenate([both[:n], [both.max() + 1], both[n:]])
    levels = [both]

    def common(width: int) -> tuple[int, int] | None:
        names = _names(both, width, levels)
        left, right = names[: n - width + 1], names[n + 1 :]
        hit = np.flatnonzero(np.isin(right, left))
        if not len(hit):
            return None
        if by_shift:
            last = np.full(int(names.max()) + 1, -1)
            last[left] = np.arange(len(left))  # the last of equal ones stays
            k = hit[np.argmin(hit - last[right[hit]])]
            return int(last[right[k]]), int(k)
        return int(np.flatnonzero(left == right[hit[0]])[0]), int(hit[0])

    best, width = None, 1
    while width <= min(n, m):
        if width > 1:
            levels.append(np.unique(levels[-1][: -(width // 2)] * (levels[-1].max() + 1) + levels[-1][width // 2 :], return_inverse=True)[1])
        found = common(width)
        if found is None:
            break
        best, longest = found, width
        width *= 2
    if best is None:
        return None
    low, high = longest, min(n, m, 2 * longest - 1)
    while low < high:
        middle = (low + high + 1) // 2
        found = common(middle)
        if found is None:
            high = middle - 1
        else:
            best, low = found, middle
    return (*best, low) if low >= least else None
