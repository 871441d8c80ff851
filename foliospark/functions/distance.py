"""Levenshtein distance of long texts by furthest-reaching diagonals: time in length plus distance squared, memory in the distance.

On a diagonal, places of both texts that lie as far apart, the furthest place that some number of edits reaches is all that
counts. With one more edit a diagonal is reached from itself or a neighbour, and then runs on as long as the texts agree.
All diagonals of a number of edits take each step together.
"""

from __future__ import annotations

import numpy as np

_BLOCKS = (1, 1, 1, 1, 16, 256, 4096)  # symbols compared at once, on the diagonals that have run on so far
_MATRIX = 1 << 22  # symbols in such a comparison


def _run_on(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Moves the places (i, j) on while x and y agree there, in place. Both texts end in different paddings."""
    live = np.arange(len(i))
    step = 0
    while len(live):
        w = _BLOCKS[min(step, len(_BLOCKS) - 1)]
        step += 1
        if w == 1:
            agree = (x[i[live]] == y[j[live]]).astype(np.int64)
        else:
            a, b = (np.lib.stride_tricks.sliding_window_view(v, w) for v in (x, y))
            agree = np.empty(len(live), np.int64)
            most = max(1, _MATRIX // w)
            for k in range(0, len(live), most):
                part = live[k : k + most]
                differs = a[i[part]] != b[j[part]]
                agree[k : k + most] = np.where(differs.any(1), differs.argmax(1), w)
        i[live] += agree
        j[live] += agree
        live = live[agree == w]


def diagonals(x: np.ndarray, y: np.ndarray, most: int | None = None) -> int | None:
    """The distance of two arrays of symbols, or None where it is more than ``most``."""
    n, m = len(x), len(y)
    if most is None:
        most = max(n, m)
    if abs(n - m) > most:
        return None
    pad = _BLOCKS[-1]
    x = np.concatenate([x.astype(np.int32), np.full(pad, -1, np.int32)])
    y = np.concatenate([y.astype(np.int32), np.full(pad, -2, np.int32)])
    low = high = 0
    far = np.zeros(1, np.int64)  # by diagonal from low to high: the furthest place in x, the one in y lies the diagonal further
    _run_on(x, y, far, far.copy())
    for edits in range(most + 1):
        if edits:
            first, last = max(low - 1, -n), min(high + 1, m)
            wide = np.full(last - first + 3, -2, np.int64)  # a place on either side; -2: not reached
            wide[low - first + 1 : high - first + 2] = far
            diagonal = np.arange(first, last + 1)
            far = np.maximum(np.maximum(wide[1:-1] + 1, wide[:-2]), wide[2:] + 1)  # a change, one of y's more, one of x's
            far = np.minimum(np.minimum(far, n), m - diagonal)
            low, high = first, last
            # what cannot come to the last diagonal with the edits that are left
            near = np.flatnonzero(np.abs(diagonal - (m - n)) <= most - edits)
            if not len(near):
                return None
            far, low, high = far[near[0] : near[-1] + 1].copy(), int(diagonal[near[0]]), int(diagonal[near[-1]])
            _run_on(x, y, far, far + np.arange(low, high + 1))
        if low <= m - n <= high and far[m - n - low] >= n:
            return edits
    return None
