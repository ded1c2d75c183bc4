"""Suffix arrays of byte shards by induced sorting, in passes over whole buckets."""

from __future__ import annotations

import numpy as np

from newsdesk.llm import arrays

SYMBOLS = 256


def kinds(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the empty suffix at the end is the least."""
    n = len(s)
    differ = np.flatnonzero(s[:-1] != s[1:])
    at = np.searchsorted(differ, np.arange(n))
    out = np.zeros(n, bool)
    inside = at < len(differ)
    place = differ[at[inside]]
    out[inside] = s[place] < s[place + 1]
    return out


def _deal(lists: list[list[np.ndarray]], items: np.ndarray, symbols: np.ndarray) -> None:
    """Append items to the lists of their symbols, in order."""
    if len(items) < 2:
        if len(items):
            lists[symbols[0]].append(items)
        return
    order = np.argsort(symbols, kind="stable")
    counts = np.bincount(symbols, minlength=SYMBOLS)
    items, end = items[order], np.cumsum(counts)
    for c in np.flatnonzero(counts).tolist():
        lists[c].append(items[end[c] - counts[c] : end[c]])


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from the leftmost smaller ones: larger ones left to right, smaller ones back."""
    large: list[list[np.ndarray]] = [[] for _ in range(SYMBOLS)]
    seeds: list[list[np.ndarray]] = [[] for _ in range(SYMBOLS)]
    _deal(seeds, lms, s[lms])
    last = len(s) - 1
    large[s[last]].append(np.array([last]))
    for c in range(SYMBOLS):
        now = large[c]
        while now:
            cur = np.concatenate(now) if len(now) > 1 else now[0]
            before = cur[cur > 0] - 1
            before = before[~small[before]]
            symbols = s[before]
            same = symbols == c
            now = [before[same]] if same.any() else []
            _deal(large, before[~same], symbols[~same])
            large[c] += now
        if seeds[c]:
            before = np.concatenate(seeds[c])
            before = before[before > 0] - 1
            _deal(large, before, s[before])
    reverse: list[list[np.ndarray]] = [[] for _ in range(SYMBOLS)]
    for c in range(SYMBOLS - 1, -1, -1):
        now = reverse[c]
        while now:
            cur = np.concatenate(now) if len(now) > 1 else now[0]
            before = cur[cur > 0] - 1
            before = before[small[before]]
            symbols = s[before]
            same = symbols == c
            now = [before[same]] if same.any() else []
            _deal(reverse, before[~same], symbols[~same])
            reverse[c] += now
        if large[c]:
            before = np.concatenate(large[c])[::-1]
            before = before[before > 0] - 1
            before = before[small[before]]
            _deal(reverse, before, s[before])
    parts = []
    for c in range(SYMBOLS):
        parts += large[c]
        if reverse[c]:
            parts.append(np.concatenate(reverse[c])[::-1])
    return np.concatenate(parts)


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string over a large alphabet; only ties are sorted again."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    sorted_names = names[order]
    head = np.concatenate([[True], sorted_names[1:] != sorted_names[:-1]])
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + 1
    step = 1
    while True:
        size = np.diff(np.append(np.flatnonzero(head), n))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            return order
        items = order[tied]
        own, ahead = rank[items], rank[np.minimum(items + step, n)]
        again = np.lexsort((ahead, own))
        items, own, ahead = items[again], own[again], ahead[again]
        order[tied] = items
        new = np.ones(len(items), bool)
        new[1:] = (own[1:] != own[:-1]) | (ahead[1:] != ahead[:-1])
        head[tied] = new
        rank[items] = np.maximum.accumulate(np.where(new, tied, 0)) + 1
        step *= 2


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of the bytes ``s`` in order.

    Leftmost smaller suffixes ("LMS") are sorted by their substrings up to the next one, which are named; where
    names repeat, the string of names is sorted in turn: by induction again while it has few symbols, and
    by doubling beyond, because a pass per symbol would then be a pass per suffix.
    """
    if len(s) < 2:
        return np.arange(len(s))
    small = kinds(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        induced = _induce(s, small, lms)
        is_lms = np.zeros(len(s), bool)
        is_lms[lms] = True
        order = induced[is_lms[induced]]
        prefix = arrays.prefix_hash(s, arrays.BYTE_POWERS)
        ends = np.append(lms[1:] + 1, len(s))
        substring = arrays.range_hash(prefix, lms, ends, arrays.BYTE_POWERS)
        number = np.zeros(len(s), np.int64)
        number[lms] = np.arange(len(lms))
        text_order = number[order]
        # The last one runs to the end of the string and equals no other.
        same = (substring[text_order][1:] == substring[text_order][:-1]) & (text_order[1:] != len(lms) - 1) & (text_order[:-1] != len(lms) - 1)
        names = np.zeros(len(lms), np.int64)
        names[text_order] = np.cumsum(np.concatenate([[0], ~same]))
        if same.any():
            names_order = suffix_array(names.astype(np.uint8)) if names.max() < SYMBOLS else _by_doubling(names)
            order = lms[names_order]
        lms = order
    return _induce(s, small, lms)


def repeats(s: np.ndarray, length: int, inside: np.ndarray) -> np.ndarray:
    """Starts (among those ``inside``) of strings of ``length`` that start elsewhere too.

    The common prefix of each suffix with the one before it in order is judged in text order (permuted):
    by equal hashes of their first ``length`` bytes, as no more needs to be known of it.
    """
    sa = suffix_array(s)
    phi = np.full(len(s), -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    prefix = arrays.prefix_hash(s, arrays.BYTE_POWERS)
    at = np.flatnonzero(inside & (phi >= 0))
    at = at[inside[phi[at]]]
    other = phi[at]
    same = arrays.range_hash(prefix, at, at + length, arrays.BYTE_POWERS) == arrays.range_hash(prefix, other, other + length, arrays.BYTE_POWERS)
    out = np.zeros(len(s), bool)
    out[at[same]] = out[other[same]] = True
    return out
