"""What a run of first-come requests does to an unknown stock.

A request of quantity q turns a stock r into r - q if r >= q and leaves it
otherwise.  A run of requests therefore cuts the stocks 0, 1, 2, .. into
stretches: within a stretch every stock meets the same fate, and each stretch
is mapped onto 0, 1, 2, ..: a request cuts every stretch longer than q after
its first q stocks, and what lies behind the cut starts again from 0.  So a
transfer is a sorted table of stretches (lo, hi, start): a stock r in [lo, hi)
becomes r - start.

Their number follows the requests, not the quantities, but may grow with both;
a transfer of more than ``limit`` stretches is kept only in part: for the
stocks below ``limit``, and for the stocks between the sum of all smaller
quantities and the next larger quantity, which lose just that sum.  Applied to
a stock outside its table, a transfer says None.
"""

from __future__ import annotations

import numpy as np

Transfer = tuple[np.ndarray, np.ndarray, np.ndarray]


def _longs(*values) -> np.ndarray:
    return np.array(values, np.int64)


IDENTITY: Transfer = (_longs(0), _longs(np.iinfo(np.int64).max), _longs(0))
NOTHING: Transfer = (_longs(), _longs(), _longs())


def _starts(q: np.ndarray, size: int, limit: int) -> np.ndarray | None:
    """Starts of the stretches of the stocks below ``size``, sorted; None if
    there are more than ``limit``."""
    least = np.minimum.accumulate(q[::-1])[::-1]         # of the requests to come
    start, length, closed, held = _longs(0), _longs(size), [], 1
    at, n = 0, len(q)
    while at < n and len(length):
        longest = int(length.max())
        fit = at + np.flatnonzero(q[at:] < longest)      # others cut nothing
        at, misses = n, 0
        for i in fit.tolist():
            x = q[i]
            cut = length > x
            if not cut.any():
                misses += 1
                if misses > 256:
                    at = i + 1
                    break
                continue
            misses = 0
            behind, rest = start[cut] + x, length[cut] - x
            held += len(behind)
            if held > limit:
                return None
            length[cut] = x
            start, length = np.concatenate([start, behind]), np.concatenate([length, rest])
            # Stretches that no later request cuts are set aside.
            done = length <= least[i + 1] if i + 1 < n else np.ones(len(length), bool)
            if done.any():
                closed.append(start[done])
                start, length = start[~done], length[~done]
            if not len(length):
                break
    return np.sort(np.concatenate([start, *closed]))


def _table(starts: np.ndarray, size: int) -> Transfer:
    return starts, np.r_[starts[1:], size].astype(np.int64), starts


def transfer(q: np.ndarray, most: int, limit: int) -> Transfer:
    """Transfer of the requests ``q`` (in order, all positive) for stocks 0 to
    ``most``, whole or in part."""
    q = q[q <= most].astype(np.int64)
    size = most + 1
    starts = _starts(q, size, limit)
    if starts is not None:
        return _table(starts, size)
    below = _table(_starts(q, limit, limit), limit)
    # All quantities under c are met by a stock from their sum up to c.
    c = np.r_[np.unique(q), size]
    amounts = np.sort(q)
    sums = np.r_[0, np.cumsum(amounts)][np.searchsorted(amounts, c)]
    lo = np.maximum(sums, limit)
    wide = lo < c
    return tuple(np.concatenate([a, b[wide]]) for a, b in zip(below, (lo, c, sums)))


def apply(f: Transfer, stock: int) -> int | None:
    """The stock after ``f``; None where its table leaves it open."""
    lo, hi, start = f
    i = int(np.searchsorted(lo, stock, "right")) - 1
    return int(stock - start[i]) if i >= 0 and stock < hi[i] else None


def compose(f: Transfer, g: Transfer, limit: int) -> Transfer:
    """First ``f``, then ``g``; of more than ``limit`` stretches the lowest and
    the highest are kept."""
    lo, hi = f[0] - f[2], f[1] - f[2]
    first = np.searchsorted(g[1], lo, "right")
    n = np.maximum(np.searchsorted(g[0], hi, "left") - first, 0)
    if n.sum() > limit:                                  # before anything that long is made
        upto = np.cumsum(n)
        keep = (upto <= limit // 2) | (upto[-1] - upto + n <= limit // 2)
        f = tuple(x[keep] for x in f)
        lo, hi, first, n = lo[keep], hi[keep], first[keep], n[keep]
    mine = np.repeat(np.arange(len(n)), n)
    its = np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n) + first[mine]
    base = f[2][mine]
    out = (np.maximum(lo[mine], g[0][its]) + base, np.minimum(hi[mine], g[1][its]) + base, g[2][its] + base)
    # Neighbours that lose the same are one stretch.
    if len(mine):
        new = np.r_[True, (out[0][1:] != out[1][:-1]) | (out[2][1:] != out[2][:-1])]
        last = np.r_[np.flatnonzero(new)[1:] - 1, len(mine) - 1]
        out = (out[0][new], out[1][last], out[2][new])
    return out
