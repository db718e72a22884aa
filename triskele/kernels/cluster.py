"""Greedy density clustering of midpoints: one group, or many small ones at once."""

from __future__ import annotations

import numpy as np


def density_clusters(midpoints: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, center) of each midpoint, in the given order of hits."""
    n = len(midpoints)
    cls, center = np.zeros(n, dtype=np.int64), midpoints.astype(np.int64).copy()
    base = int(midpoints.min()) - reach
    dens = np.zeros(int(midpoints.max()) + reach - base + 1, dtype=np.int64)
    offsets = np.array([i for i in range(-reach, reach + 1) if i])
    add = reach - np.abs(offsets)
    best, first = 0, int(midpoints[0])
    for m in midpoints:
        at = m + offsets - base
        dens[at] += add
        values = dens[at]
        k = int(values.argmax())  # the first of the largest, as positions are added in ascending order
        if values[k] > best:
            best, first = int(values[k]), int(at[k] + base)
    occupied = np.zeros(len(dens), dtype=bool)
    occupied[midpoints - base] = True
    live = np.ones(len(dens), dtype=bool)
    k, c = 1, first
    while True:
        near = (np.abs(midpoints - c) <= reach) & (cls == 0)
        cls[near], center[near] = k, c
        live[max(0, c - reach - base) : c + reach - base + 1] = False
        if (cls > 0).all():
            return cls, center
        left = np.flatnonzero(occupied & live)
        if not len(left):
            return cls, center
        values = dens[left]
        c = int(left[np.flatnonzero(values == values.max())[-1]] + base)
        k += 1


#: Hits of a group from which it is clustered on its own.
LARGE = 2000


def density_clusters_of(midpoints: np.ndarray, group: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """``density_clusters`` of many groups: hits of a group stand together, in their order; ``group`` numbers the groups from 0 without gaps.

    All groups lie on one axis, further apart than ``reach`` can bridge; wide gaps within a group are
    shortened to that. The n-th hits of all groups are added together, and the n-th centers chosen together.
    """
    midpoints = midpoints.astype(np.int64)
    cls, center = np.zeros(len(midpoints), dtype=np.int64), midpoints.copy()
    sizes = np.bincount(group)
    large = sizes >= LARGE
    for g in np.flatnonzero(large):
        lo = int(np.searchsorted(group, g))
        own = slice(lo, lo + int(sizes[g]))
        cls[own], center[own] = density_clusters(midpoints[own], reach)
    some = np.flatnonzero(~large[group])
    if not len(some):
        return cls, center
    m, own = midpoints[some], np.unique(group[some], return_inverse=True)[1]
    n, count, apart = len(m), int(own[-1]) + 1, 2 * reach + 1
    by = np.lexsort((m, own))
    steps = np.where(np.diff(own[by]) > 0, apart, np.minimum(np.diff(m[by]), apart))
    at = np.empty(n, dtype=np.int64)
    at[by] = np.concatenate(([reach], reach + np.cumsum(steps)))
    dens = np.zeros(int(at.max()) + reach + 1, dtype=np.int64)
    offsets = np.array([i for i in range(-reach, reach + 1) if i])
    add = reach - np.abs(offsets)
    begin = np.flatnonzero(np.concatenate(([True], np.diff(own) > 0)))
    best, c_at, c = np.zeros(count, dtype=np.int64), at[begin], m[begin]
    turn = np.arange(n) - begin[own]
    for k in np.split(np.argsort(turn, kind="stable"), np.cumsum(np.bincount(turn))[:-1]):
        near = at[k][:, None] + offsets
        values = dens[near] + add  # no two of these hits are of one group, so no position is met twice
        dens[near] = values
        top = values.argmax(axis=1)  # the first of the largest, as positions are added in ascending order
        value, g = values[np.arange(len(k)), top], own[k]
        up = value > best[g]
        g, k, top = g[up], k[up], top[up]
        best[g], c_at[g], c[g] = value[up], at[k] + offsets[top], m[k] + offsets[top]
    kept, name = by, 1
    while True:
        g = own[kept]
        near = np.abs(at[kept] - c_at[g]) <= reach
        done = some[kept[near]]
        cls[done], center[done] = name, c[g[near]]
        kept = kept[~near]
        if not len(kept):
            return cls, center
        g = own[kept]
        first = np.flatnonzero(np.concatenate(([True], np.diff(g) > 0)))
        rank = dens[at[kept]] * len(dens) + at[kept]  # the densest, ties to the larger position
        last = np.repeat(np.maximum.reduceat(rank, first), np.diff(np.append(first, len(kept))))
        chosen = kept[rank == last]
        c_at[own[chosen]], c[own[chosen]] = at[chosen], m[chosen]
        name += 1
