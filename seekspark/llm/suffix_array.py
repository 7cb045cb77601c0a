"""Suffix arrays by two-stage sorting, on integer symbols, with numpy."""

from __future__ import annotations

import numpy as np

#: Symbols to a sort key of 63 bits; a symbol takes 9 bits.
PER_KEY = 7


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than the one that begins a place later. The last is not."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1].astype(np.int32))
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n - 1)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def sort_keys(text: np.ndarray) -> np.ndarray:
    """For each place, and one behind the last, the next symbols as one number; zeros stand behind a separator."""
    n = len(text)
    wide = np.zeros(n + PER_KEY, np.uint64)
    wide[:n] = text
    key, live = np.zeros(n + 1, np.uint64), np.ones(n, np.uint64)
    for j in range(PER_KEY):
        live &= wide[j : j + n] != 0
        key[:n] = (key[:n] << np.uint64(9)) | (wide[j : j + n] * live)
    return key


def _sort_directly(key: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The chosen suffixes in order, by keys of some symbols, further along for those that are still equal. A separator ends a comparison; place decides then."""
    n = len(key) - 1
    order = chosen[np.argsort(key[chosen], kind="stable")]
    places = np.arange(len(order))
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    # A group of suffixes that are equal so far is named by the place of its first member.
    group = np.maximum.accumulate(np.where(new, places, 0))
    active, depth = places, PER_KEY
    while True:
        g = group[active]
        alone = np.ones(len(active) + 1, bool)
        alone[1:-1] = g[1:] != g[:-1]
        active = active[~(alone[:-1] & alone[1:]) & ((key[order[active] + depth - PER_KEY] & np.uint64(0x1FF)) != 0)]
        if not len(active):
            return order
        at, g = order[active], group[active]
        k = key[np.minimum(at + depth, n)]
        by = np.lexsort((k, g))
        order[active] = at[by]
        k, g = k[by], g[by]
        new = np.ones(len(active), bool)
        new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
        group[active] = active[np.maximum.accumulate(np.where(new, places[: len(active)], 0))]
        depth += PER_KEY


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The places of all suffixes in ascending order.

    Symbols lie in 0..511. Symbol 0 is a separator: less than all others, and of two separators the earlier is the less, so a
    comparison never passes one. Stage one sorts the suffixes that are smaller than their successors, and the separators;
    stage two finds the others in one scan over the buckets of first symbols, from the least: the suffix one place before an
    ordered one, if it is the larger of the two, comes next in the bucket of its own first symbol. A text that ends without a
    separator is taken as if one followed.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    if text[-1]:
        out = suffix_array(np.append(text, 0))
        return out[out != n]
    text = text.astype(np.int64)
    direct = smaller_than_successor(text)
    # A separator sorts by its place, before all others.
    separator = text == 0
    direct |= separator
    sizes = np.bincount(text, minlength=int(text.max()) + 1)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    out = np.full(n, -1, np.int64)
    out[: sizes[0]] = np.flatnonzero(separator)
    chosen = np.flatnonzero(direct & ~separator)
    ordered = _sort_directly(sort_keys(text), chosen)
    first = text[ordered]
    counts = np.bincount(first, minlength=len(sizes))
    starts = np.cumsum(counts) - counts
    out[ends[first] - counts[first] + np.arange(len(ordered)) - starts[first]] = ordered
    free = heads.copy()
    free[0] = sizes[0]

    def induce(places: np.ndarray) -> None:
        """Put the predecessors that are larger into their buckets, in order."""
        before = places[places > 0] - 1
        before = before[~direct[before]]
        if not len(before):
            return
        symbol = text[before]
        by = np.argsort(symbol, kind="stable")
        before, symbol = before[by], symbol[by]
        count = np.bincount(symbol, minlength=len(sizes))
        start = np.cumsum(count) - count
        out[free[symbol] + np.arange(len(before)) - start[symbol]] = before
        free[:] += count

    for symbol in np.flatnonzero(sizes):
        a = int(heads[symbol])
        done = a
        while symbol and done < free[symbol]:
            to = int(free[symbol])
            part = out[done:to]
            induce(part[(part > 0) & (text[part - 1] == symbol)])
            done = to
        whole = out[a : int(ends[symbol])]
        induce(whole[(whole > 0) & (text[whole - 1] != symbol)])
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place but the first in ``order``, how many symbols its suffix shares with the one before it: ``most`` at most, and none past a separator."""
    key, n = sort_keys(text), len(text)
    shared = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for depth in range(0, most, PER_KEY):
        a, b = key[np.minimum(order[live] + depth, n)], key[np.minimum(order[live - 1] + depth, n)]
        # The leading symbols that are equal, and no separators.
        equal, apart = np.zeros(len(live), np.int64), a ^ b
        for j in range(PER_KEY - 1, -1, -1):
            equal += ((apart >> np.uint64(9 * j)) == 0) & ((a >> np.uint64(9 * j)) & np.uint64(0x1FF) != 0)
        shared[live] += equal
        live = live[equal == PER_KEY]
    return np.minimum(shared, most)
