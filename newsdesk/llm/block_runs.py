"""Periodic runs of a sequence of numbers by block convolution.

A run of period q and at least four of them holds, at the dyadic scale B with B <= q < 2 B, a whole block of B
numbers that starts at a multiple of B and stands again q places on. The sum of squared differences of a block to each
place of the window behind it is a convolution, taken exactly with integers modulo a prime by a number-theoretic
transform; where it is zero the block occurs again, and the distance seeds an extension to both sides.

A block can only stand again d places on if each of its numbers does, so blocks that hold a number without another one
in reach are left out before the transform, and so are blocks and distances that lie within a run found at a smaller
scale: there, distances that match are multiples of that run's period. Neither loses a run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

# A prime of the form k * 2**27 + 1 below 2**31, and a primitive root of it.
PRIME, ROOT, MOST_POINTS = 2_013_265_921, 31, 1 << 27
P = np.uint64(PRIME)
PASS_POINTS = 1 << 19
"""Numbers of one pass of transforms (some MB an array)."""


@cache
def _twiddles(half: int, inverse: bool) -> np.ndarray:
    """Powers 0..half-1 of a root of unity of order ``2 * half``."""
    base = pow(ROOT, (PRIME - 1) // (2 * half), PRIME)
    if inverse:
        base = pow(base, -1, PRIME)
    out, n = np.ones(half, np.uint64), 1
    while n < half:
        out[n : 2 * n] = out[:n] * np.uint64(pow(base, n, PRIME)) % P
        n *= 2
    return out


def transform(rows: np.ndarray) -> np.ndarray:
    """Each row (a power of two long, values below the prime) in place, in bit-reversed order."""
    half = rows.shape[1] // 2
    while half:
        pairs = rows.reshape(len(rows), -1, 2, half)
        a, b = pairs[:, :, 0].copy(), pairs[:, :, 1]
        pairs[:, :, 0] += b
        pairs[:, :, 0] %= P
        pairs[:, :, 1] = (a + (P - b)) * _twiddles(half, False) % P if half > 1 else (a + (P - b)) % P
        half //= 2
    return rows


def back(rows: np.ndarray) -> np.ndarray:
    """The inverse of ``transform``, in place."""
    n, half = rows.shape[1], 1
    while half < n:
        pairs = rows.reshape(len(rows), -1, 2, half)
        b = pairs[:, :, 1] * _twiddles(half, True) % P
        pairs[:, :, 1] = (pairs[:, :, 0] + (P - b)) % P
        pairs[:, :, 0] += b
        pairs[:, :, 0] %= P
        half *= 2
    rows *= np.uint64(pow(n, -1, PRIME))
    rows %= P
    return rows


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Row by row, the sum of squared differences of a block of B to places 0..B-1 of its window of 2 B, modulo the prime."""
    n, size = blocks.shape
    backwards = np.zeros((n, 2 * size), np.uint64)
    backwards[:, 0], backwards[:, size + 1 :] = blocks[:, 0], blocks[:, :0:-1]
    both = transform(backwards)
    both *= transform(windows.copy())
    both %= P
    products = back(both)[:, :size]
    squares = np.zeros((n, 2 * size + 1), np.uint64)
    np.cumsum(windows * windows % P, axis=1, out=squares[:, 1:])
    of_window = squares[:, size : 2 * size] - squares[:, :size]
    of_block = (blocks * blocks % P).sum(1, dtype=np.uint64)
    return (of_window + of_block[:, None] + np.uint64(2) * (P - products)) % P


def _reach(numbers: np.ndarray) -> np.ndarray:
    """Places to the next equal number; far beyond the end where there is none."""
    order = np.argsort(numbers, kind="stable")
    out = np.full(len(numbers), 4 * len(numbers) + 4, np.int64)
    same = numbers[order[1:]] == numbers[order[:-1]]
    out[order[:-1][same]] = np.diff(order)[same]
    return out


class Found:
    """The least period found for each stretch."""

    def __init__(self):
        self.runs: dict[tuple[int, int], int] = {}

    def add(self, start: int, end: int, period: int) -> None:
        self.runs[start, end] = min(period, self.runs.get((start, end), period))

    def upto(self, n: int) -> np.ndarray:
        """For each place, the furthest end of a run that starts there or before."""
        out = np.zeros(n + 1, np.int64)
        for start, end in self.runs:
            out[start] = max(out[start], end)
        return np.maximum.accumulate(out)


def _same_upto(numbers: np.ndarray, i: int, j: int) -> int:
    """How many numbers from ``i`` on equal those from ``j > i`` on."""
    done, step, n = 0, 32, len(numbers) - j
    while done < n:
        a, b = numbers[i + done : i + done + step], numbers[j + done : j + done + step]
        differs = np.flatnonzero(a[: len(b)] != b)
        if len(differs):
            return done + int(differs[0])
        done += len(b)
        step *= 2
    return n


def _same_before(numbers: np.ndarray, i: int, j: int) -> int:
    """How many numbers before ``i`` equal those before ``j > i``."""
    done, step = 0, 32
    while done < i:
        step = min(step, i - done)
        a, b = numbers[i - done - step : i - done], numbers[j - done - step : j - done]
        differs = np.flatnonzero(a != b)
        if len(differs):
            return done + step - 1 - int(differs[-1])
        done += step
        step *= 2
    return done


def _seeds(numbers: np.ndarray, size: int, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts of the wanted blocks and distances at which they occur again in their windows, by ascending start."""
    padded = np.concatenate([numbers, np.zeros(3 * size, np.uint64)])
    step = max(1, PASS_POINTS // (2 * size))
    for at in range(0, len(wanted), step):
        starts = wanted[at : at + step] * size
        blocks = padded[starts[:, None] + np.arange(size)]
        windows = padded[starts[:, None] + np.arange(size, 3 * size)]
        row, place = np.nonzero(squared_differences(blocks, windows) == 0)
        yield starts[row], place + size


def runs(numbers: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """``start, length, period`` of all runs of ``numbers`` (whole, 1 up to the prime), by start, then period.

    A run has at least ``max(least, times * period)`` numbers, its period is the smallest one, and no
    neighbour extends it. ``times`` must be 4 or more.
    """
    if times < 4:
        raise ValueError("blocks are only sure to be met by runs of four periods")
    n, found = len(numbers), Found()
    numbers = np.asarray(numbers, np.uint64)
    far, size = _reach(numbers), 1
    while times * size <= n:
        if 2 * size > MOST_POINTS:
            raise ValueError(f"a sequence of {n} numbers is longer than the transform")
        if size > 1:
            far = np.maximum(far[0 : len(far) // 2 * 2 : 2], far[1 : len(far) // 2 * 2 : 2])
        blocks = len(far)
        wanted = np.flatnonzero(far < 2 * size)
        wanted = wanted[(wanted + 2) * size <= n]
        ends = found.upto(n) if len(wanted) else np.zeros(1, np.int64)
        wanted = wanted[ends[wanted * size] < np.minimum((wanted + 3) * size, n)]
        covered = np.zeros(2 * size, np.int64)  # for each distance, where the last stretch of equal numbers ends
        for starts, distances in _seeds(numbers, size, wanted):
            new = ends[starts] < starts + distances + size
            starts, distances = starts[new], distances[new]
            order = np.lexsort((starts, distances))
            starts, distances = starts[order], distances[order]
            # Neighbouring blocks that match at one distance are one stretch, unless a zero was only one modulo the prime.
            heads = np.ones(len(starts) + 1, bool)
            heads[1:-1] = (distances[1:] != distances[:-1]) | (starts[1:] - starts[:-1] != size)
            heads = np.flatnonzero(heads).tolist()
            for at, stop in zip(heads, heads[1:], strict=False):
                d = int(distances[at])
                while (at := at + int(np.searchsorted(starts[at:stop], covered[d] - size, side="right"))) < stop:
                    i = int(starts[at])
                    right = _same_upto(numbers, i, i + d)
                    covered[d] = i + max(right, size)
                    if right >= size:
                        start, end = i - _same_before(numbers, i, i + d), i + d + right
                        if end - start >= max(least, times * d):
                            found.add(start, end, d)
        size *= 2
        if blocks < 2:
            break
    out = sorted((start, end - start, period) for (start, end), period in found.runs.items())
    return np.array(out, np.int64).reshape(-1, 3)
