"""The kernel of a tile with flats: directions, edges, components and gradients from one look at the cells."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .components import _merge
from .directions import D8, Direction

#: Tiles have 2**TILE_BITS rows and columns, and a rim of HALO cells: edges need the directions of the cells beside them.
TILE_BITS, HALO = 8, 2
NULL = -(2**31)


def ordered(z: pa.ChunkedArray) -> np.ndarray:
    """32-bit floats as integers of the same order, as SQL has it: -0 is 0, NaN comes last and null first."""
    x = pc.fill_null(z, 0.0).to_numpy() + np.float32(0)
    bits = np.where(np.isnan(x), np.float32(np.nan), x).view(np.int32).astype(np.int64)
    return np.where(z.is_null().to_numpy(), NULL, np.where(bits < 0, bits ^ 0x7FFFFFFF, bits))


def grown(seeds: np.ndarray, near: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Breadth-first layers from the seeds, which have 1, over the neighbours ``near`` that are ``joined``; 0 where none leads."""
    depth, front, n = np.zeros(len(seeds), np.int64), np.flatnonzero(seeds), 0
    while len(front):
        n += 1
        depth[front] = n
        front = np.unique(near[:, front][joined[:, front]])
        front = front[depth[front] == 0]
    return depth


def regrown(depth: np.ndarray, near: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """The layers that follow from those that cells already have; a lower one replaces a higher one."""
    none = np.iinfo(np.int64).max
    depth = np.where(depth > 0, depth, none)
    n = depth.min(initial=none)
    while n < none:
        front = np.flatnonzero(depth == n)
        to = np.unique(near[:, front][joined[:, front]])
        depth[to[depth[to] > n + 1]] = n + 1
        n = depth[depth > n].min(initial=none)
    return np.where(depth < none, depth, 0)


def placed(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the cells column by column, as ids go, and in it the places of each cell's neighbours, -1 for missing ones."""
    tall = int(i.max() - i.min()) + 3
    at = (j - j.min() + 1) * tall + i - i.min() + 1  # with a rim
    order = np.argsort(at)
    at = at[order]
    slot = np.full((int(j.max() - j.min()) + 3) * tall, -1)
    slot[at] = np.arange(len(at))
    return order, np.stack([slot[at + d.dj * tall + d.di] for d in D8.neighbours()])


def flat_tile(t: pa.Table, own: np.ndarray, dirs: Sequence[Direction], no_flow: int, keep: Sequence[str]) -> pa.Table:
    """The columns ``keep`` of the tile's own cells, and ``open``: what joins a component that leaves the tile, null for others.

    For those ``first``, ``rise`` and ``pull`` aren't known yet. ``dirs`` are the directions in order of preference.
    """
    order, near = placed(*(t.column(c).to_numpy().astype(np.int64) for c in ("i", "j")))
    own, n = own[order], len(order)
    cid, z = t.column("cid").to_numpy()[order], ordered(t.column("_z"))[order]
    ok = pc.fill_null(t.column("valid"), False).to_numpy()[order]
    there = ok & (near >= 0) & ok[near]
    beside = z[near]

    place = {(d.di, d.dj): k for k, d in enumerate(D8.neighbours())}
    low, code, ds, out = z.copy(), np.full(n, no_flow, np.int16), np.zeros(n, np.int64), np.zeros(n, bool)
    for d in dirs:
        k = place[d.di, d.dj]
        lower = there[k] & (beside[k] < low)
        low[lower], code[lower], ds[lower] = beside[k][lower], d.code, cid[near[k][lower]]
        out |= lower
    equal = there & (beside == z) & (z != NULL)
    low_edge = out & (equal & ~out[near]).any(axis=0)
    high_edge = ok & ~out & (there & (beside > z) & (z != NULL)).any(axis=0)

    mine = ok & own
    inside, away = equal & mine & mine[near], equal & mine & ~mine[near]
    half = [k for k, d in enumerate(D8.neighbours()) if (d.di, d.dj) > (0, 0)]  # each pair once
    ends = [np.flatnonzero(inside[k]) for k in half]
    root = _merge(n, np.concatenate(ends), np.concatenate([near[k][u] for k, u in zip(half, ends)]))
    leaves = np.zeros(n, bool)
    leaves[root[away.any(axis=0)]] = True
    opened = mine & leaves[root]
    shut = mine & ~opened

    seed = mine & (low_edge | ~out)
    first = np.full(n, n)
    np.minimum.at(first, root[seed], np.flatnonzero(seed))
    first = first[root]
    push, pull = (grown(shut & edge, near, inside) for edge in (high_edge, low_edge))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, root, push)
    flat = shut & (first < n)
    rows = np.flatnonzero(own)
    made = {
        "code": lambda: pa.array(code[rows]),
        "ds": lambda: pa.array(ds[rows], mask=~out[rows]),
        "is_flat": lambda: pa.array((ok & ~out)[rows]),
        "low_edge": lambda: pa.array(low_edge[rows]),
        "high_edge": lambda: pa.array(high_edge[rows]),
        "first": lambda: pa.array(cid[np.minimum(first, n - 1)][rows], mask=~flat[rows]),
        "rise": lambda: pa.array(np.where(flat, top[root] - push + 1, 0)[rows]),
        "pull": lambda: pa.array(pull[rows]),
    }
    plain = [c for c in keep if c not in made]
    kept = t.select(plain).take(pa.array(order[rows])) if plain else None
    columns = {c: made[c]() if c in made else kept.column(c) for c in keep}

    far = np.concatenate([np.stack([u, cid[near[k][u]]]) for k in half for u in [np.flatnonzero(away[k])]], axis=1)
    far = far[:, np.argsort(far[0], kind="stable")]
    bounds = np.r_[0, np.cumsum(np.bincount(far[0], minlength=n)[rows])].astype(np.int32)
    parts = [pa.array(x[rows]) for x in (cid, cid[root], seed, low_edge, high_edge)]
    lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(far[1]))
    columns["open"] = pa.StructArray.from_arrays([*parts, lists], ["cid", "root", "seed", "low_edge", "high_edge", "away"], mask=pa.array(~opened[rows]))
    return pa.table(columns)
