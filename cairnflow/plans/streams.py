"""Strahler orders and ways from the farthest source over flow forests, tile by tile.

Both go over the tiles twice: first each tile tells how what enters it changes on its way to where it leaves; these ways
form a small forest, solved by one task per grid; then each tile is solved with what enters it known.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import iterate
from .iterate import _np, _side, _ways, durable

TOP = 40  # no order of a forest of fewer than 2**39 cells reaches it


def _depths(hops: np.ndarray) -> list[np.ndarray]:
    """The nodes by depth, the deepest first, without those of depth 0."""
    order = np.argsort(-hops, kind="stable")
    ends = np.cumsum(np.bincount(hops)[::-1])
    return [order[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends)][:-1]


def _at(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions in sorted ids, -1 for others."""
    at = np.minimum(np.searchsorted(ids, wanted), max(len(ids) - 1, 0))
    return np.where(ids[at] == wanted, at, -1) if len(ids) else np.full(len(wanted), -1)


def _tile(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    t = t.sort_by("cid")
    cid, has = t.column("cid").to_numpy(), t.column("ds").is_valid().to_numpy()
    step, end, hops, dist, _ = _ways(cid, _np(t, "ds"), has, np.ones(len(cid), np.int64), _np(t, "step") if "step" in t.column_names else np.zeros(len(cid)))
    return cid, has, step, end, hops, dist, t


def _leaving(tree: DataFrame) -> DataFrame:
    """grid_id, ti, tj, cid: the cells that ways of other tiles enter."""
    apart = F.lit(False)
    for a, b in zip(_side("cid"), _side("ds")):
        apart = apart | (a != b)
    return tree.where(F.col("ds").isNotNull() & apart).select("grid_id", *_tiles("ds"), F.col("ds").alias("cid")).distinct()


def _tiles(c: str) -> list:
    return [x.alias(n) for x, n in zip(_side(c), ("ti", "tj"))]


def _beside(tree: DataFrame, other: DataFrame):
    """Tiles of ``tree`` with those of ``other``, which may have none for some."""
    k = ["grid_id", "ti", "tj"]
    other = other.select(*(F.col(c).alias(c) for c in other.columns))  # it may come from the same table, and columns of one name would clash
    return tree.select("*", *_tiles("cid")).groupBy(*k).cogroup(other.groupBy(*k))


def _meet(m: np.ndarray, n: np.ndarray, to: np.ndarray, order: np.ndarray) -> None:
    """Add tributaries of ``order`` to the greatest order ``m`` at ``to`` and the number ``n`` of them that have it."""
    old = m[to]
    np.maximum.at(m, to, order)
    n[to[m[to] > old]] = 0
    np.add.at(n, to[order == m[to]], 1)


def _order(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(m > 0, m + (n > 1), 1)


def _through(t: pa.Table, entering: pa.Table) -> pa.Table:
    """How orders pass a tile: a row for each cell that is entered, where ways from such cells meet, and where ways leave.

    m and n tell of the tributaries that nothing enters, ``to`` is the next such cell and ``table`` the order with which a
    way of order 1, 2 ... arrives there; ``ord`` is the order of an exit that nothing enters, ``last`` the way's last cell.
    """
    grid_id = t.column("grid_id")[0].as_py() if len(t) else None
    cid, has, step, end, hops, _, _ = _tile(t)
    hops = np.where(end < 0, 0, hops)
    count, self_ = len(cid), np.arange(len(cid))
    into = np.zeros(count, bool)
    at = _at(cid, entering.column("cid").to_numpy())
    into[at[at >= 0]] = True
    leaves = has & (end == self_)
    m, n = np.zeros(count, np.int64), np.zeros(count, np.int64)
    wet, wets, child = into.copy(), np.zeros(count, np.int64), np.full(count, -1)
    parts = _depths(hops) if count else []
    for p in parts:
        w = p[wet[p]]
        wet[step[w]] = True
        np.add.at(wets, step[w], 1)
        child[step[w]] = w
    node = wet & (into | (wets > 1) | leaves)
    slot = np.cumsum(wet) - 1
    head, table = np.full(count, -1), np.zeros((int(wet.sum()), TOP), np.int8)
    orders, to, way = np.zeros(count, np.int64), np.full(count, -1), np.zeros(count, np.int64)
    for p in [*parts, np.flatnonzero(hops == 0)]:
        dry = p[~wet[p]]
        orders[dry] = _order(m[dry], n[dry])
        starts, passes = p[node[p]], p[wet[p] & ~node[p]]
        head[starts], table[slot[starts]] = starts, np.arange(TOP)
        if len(passes):
            x, high = table[slot[child[passes]]], m[passes][:, None]
            table[slot[passes]] = np.where(x > high, x, np.where(x == high, high + 1, _order(m[passes], n[passes])[:, None]))
            head[passes] = head[child[passes]]
        moving = hops[p] > 0
        u = p[moving & ~wet[p]]
        _meet(m, n, step[u], orders[u])
        u = p[moving & wet[p]]
        u = u[node[step[u]]]
        to[head[u]], way[head[u]] = step[u], slot[u]
    rows = np.flatnonzero(node | leaves)
    ids = np.r_[cid, 0]
    known = leaves & ~wet & (end >= 0)
    return pa.table({
        "grid_id": pa.array([grid_id] * len(rows), pa.string()), "cid": pa.array(cid[rows]), "m": pa.array(m[rows]), "n": pa.array(np.minimum(n[rows], 2)),
        "to": pa.array(ids[to[rows]], mask=to[rows] < 0), "table": pa.array([table[way[r]].tobytes() if to[r] >= 0 else None for r in rows], pa.binary()),
        "ds": pa.array(_np(t.sort_by("cid"), "ds")[rows], mask=~leaves[rows]), "ord": pa.array(orders[rows], mask=~known[rows]), "last": pa.array(ids[end[rows]], mask=end[rows] < 0),
    })


def _between(t: pa.Table) -> pa.Table:
    """Over the rows of ``_through``: m and n of the ways that enter a cell, and the exits whose ways never end."""
    t = t.sort_by("cid")
    grid_id = t.column("grid_id")[0].as_py()
    cid, exits = t.column("cid").to_numpy(), t.column("ds").is_valid().to_numpy(zero_copy_only=False)
    inside, known, ends = (t.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("to", "ord", "last"))
    entry = np.where(exits, _at(cid, _np(t, "ds")), -1)  # where an exit's way enters the next tile
    last = np.where(ends, _at(cid, _np(t, "last")), -1)  # the exit that a cell's way leads to
    one = np.ones(len(cid), np.int64)
    far = np.where(entry >= 0, last[entry], -1)
    _, end, _, _, _ = _ways(cid, np.where(far >= 0, cid[far], 0), far >= 0, one, one)
    stuck = exits & ((entry < 0) | ((entry >= 0) & ~ends[entry]))  # no such cell, or a cycle in the next tile
    lost = exits & ((end < 0) | stuck[end])
    up = np.where(inside, _at(cid, _np(t, "to")), entry)
    up[(last >= 0) & lost[last]] = -1
    step, _, hops, _, _ = _ways(cid, np.where(up >= 0, cid[up], 0), up >= 0, one, one)
    table = np.zeros((len(cid), TOP), np.int64)
    table[inside] = np.array([np.frombuffer(b, np.int8) for b in t.column("table").to_pylist() if b is not None]).reshape(-1, TOP)
    m, n = _np(t, "m").copy(), _np(t, "n").copy()
    em, en, fixed = np.zeros(len(cid), np.int64), np.zeros(len(cid), np.int64), _np(t, "ord")
    for p in _depths(hops):
        x = np.where(known[p], fixed[p], _order(m[p], n[p]))
        x = np.where(inside[p], table[p, x], x)
        _meet(m, n, step[p], x)
        out = ~inside[p]
        _meet(em, en, step[p][out], x[out])
    rows = np.flatnonzero(lost | (em > 0))
    return pa.table({"grid_id": pa.array([grid_id] * len(rows), pa.string()), "cid": pa.array(cid[rows]), "m": pa.array(em[rows]), "n": pa.array(en[rows]), "lost": pa.array(lost[rows])})


def _ordered(t: pa.Table, known: pa.Table) -> pa.Table:
    """cid and ord of a tile's cells; 0 on invalid ones and those whose ways never end."""
    dry = t.filter(pc.invert(t.column("valid"))).select(["grid_id", "cid"])
    cid, _, step, end, hops, _, t = _tile(t.filter(t.column("valid")))
    at = _at(cid, known.column("cid").to_numpy())
    here = at >= 0
    m, n, lost = np.zeros(len(cid), np.int64), np.zeros(len(cid), np.int64), np.zeros(len(cid) + 1, bool)
    m[at[here]], n[at[here]], lost[at[here]] = known.column("m").to_numpy()[here], known.column("n").to_numpy()[here], known.column("lost").to_numpy(zero_copy_only=False)[here]
    lost[-1] = True  # cycles have no end
    for p in _depths(np.where(end < 0, 0, hops)) if len(cid) else []:
        _meet(m, n, step[p], _order(m[p], n[p]))
    out = t.select(["grid_id", "cid"]).append_column("ord", pa.array(np.where(lost[end], 0, _order(m, n)).astype(np.int32)))
    return pa.concat_tables([out, dry.append_column("ord", pa.array(np.zeros(len(dry), np.int32)))])


def orders(flow: DataFrame) -> DataFrame | None:
    """grid_id, cid, ord of the cells of ``flow`` (grid_id, cid, ds, valid); None if there is too much between tiles for a task."""
    cells = flow.select("grid_id", "cid", "ds", "valid")
    tree = cells.where("valid").select("grid_id", "cid", "ds")
    ways = durable(_beside(tree, _leaving(tree)).applyInArrow(_through, "grid_id string, cid long, m long, n long, to long, table binary, ds long, ord long, last long"))
    if ways.count() > 4 * iterate.ALONE:
        return None
    known = durable(ways.groupBy("grid_id").applyInArrow(_between, "grid_id string, cid long, m long, n long, lost boolean")).select("*", *_tiles("cid"))
    return _beside(cells, known).applyInArrow(_ordered, "grid_id string, cid long, ord int")


def _farthest(h: np.ndarray, src: np.ndarray, d: np.ndarray, to: np.ndarray, new_h: np.ndarray, new_src: np.ndarray, new_d: np.ndarray) -> None:
    """Put the ways given in place of those at ``to`` where they have more steps, or as many from a larger source."""
    order = np.lexsort((new_src, new_h, to))
    order = order[np.r_[to[order][1:] != to[order][:-1], True]] if len(order) else order
    to, new_h, new_src, new_d = to[order], new_h[order], new_src[order], new_d[order]
    more = (new_h > h[to]) | ((new_h == h[to]) & (new_src > src[to]))
    h[to[more]], src[to[more]], d[to[more]] = new_h[more], new_src[more], new_d[more]


def _down(cid, step, end, hops, length, into, h, src, d) -> None:
    """Fill in the farthest source of every cell of a tile, given those of the ways that enter it (h is -1 where none is known)."""
    if (end < 0).any():
        raise ValueError("the flow field has a cycle")
    inner = step != np.arange(len(cid))
    source = ~into & (np.bincount(step[inner], minlength=len(cid)) == 0)
    h[source], src[source], d[source] = 0, cid[source], 0.0
    for p in _depths(hops) if len(cid) else []:
        p = p[h[p] >= 0]
        _farthest(h, src, d, step[p], h[p] + 1, src[p], d[p] + length[p])


def _no_way(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.full(n, -1), np.full(n, -1), np.zeros(n)


def _carried(t: pa.Table, entering: pa.Table) -> pa.Table:
    """Of a tile: exits (ds is set) with their farthest source inside and the length of their step, entered cells with the way to their last cell."""
    grid_id = t.column("grid_id")[0].as_py() if len(t) else None
    cid, has, step, end, hops, dist, t = _tile(t)
    into = np.zeros(len(cid), bool)
    at = _at(cid, entering.column("cid").to_numpy())
    into[at[at >= 0]] = True
    h, src, d = _no_way(len(cid))
    _down(cid, step, end, hops, _np(t, "step"), into, h, src, d)
    x, e = np.flatnonzero(has & (end == np.arange(len(cid)))), np.flatnonzero(into)
    none = np.full(len(e), -1)
    both = np.r_[x, e]
    return pa.table({
        "grid_id": pa.array([grid_id] * len(both), pa.string()), "cid": pa.array(cid[both]), "ds": pa.array(np.r_[_np(t, "ds")[x], none], mask=np.r_[np.zeros(len(x), bool), np.ones(len(e), bool)]),
        "h": pa.array(np.r_[h[x], none]), "src": pa.array(np.r_[src[x], none]), "d": pa.array(np.r_[d[x], np.zeros(len(e))]),
        "last": pa.array(cid[end[both]]), "hops": pa.array(np.r_[np.ones(len(x), np.int64), hops[e]]), "dist": pa.array(np.r_[_np(t, "step")[x], dist[e]]),
    })


def _carried_on(t: pa.Table) -> pa.Table:
    """Over the rows of ``_carried``: the farthest source of the ways that enter a cell."""
    grid_id = t.column("grid_id")[0].as_py()
    exits = t.column("ds").is_valid().to_numpy(zero_copy_only=False)
    t = pa.concat_tables([t.filter(pa.array(exits)).sort_by("cid"), t.filter(pa.array(~exits)).sort_by("cid")])
    x = int(exits.sum())
    cid = t.column("cid").to_numpy()
    to = np.r_[_at(cid[x:], _np(t, "ds")[:x]), _at(cid[:x], t.column("last").to_numpy()[x:])]
    to[:x] = np.where(to[:x] >= 0, to[:x] + x, -1)
    one = np.ones(len(cid), np.int64)
    step, end, depth, _, _ = _ways(np.arange(len(cid)), np.maximum(to, 0), to >= 0, one, one)
    if (end < 0).any():
        raise ValueError("the flow field has a cycle")
    h, src, d = (t.column(c).to_numpy().copy() for c in ("h", "src", "d"))
    hops, dist = t.column("hops").to_numpy(), t.column("dist").to_numpy()
    for p in _depths(depth):
        p = p[h[p] >= 0]
        _farthest(h, src, d, step[p], h[p] + hops[p], src[p], d[p] + dist[p])
    return pa.table({"grid_id": pa.array([grid_id] * (len(cid) - x), pa.string()), "cid": pa.array(cid[x:]), "h": pa.array(h[x:]), "src": pa.array(src[x:]), "d": pa.array(d[x:])})


def _sourced(t: pa.Table, known: pa.Table) -> pa.Table:
    """cid and dist of a tile's cells, null on invalid ones."""
    dry = t.filter(pc.invert(t.column("valid"))).select(["grid_id", "cid"])
    cid, _, step, end, hops, _, t = _tile(t.filter(t.column("valid")))
    h, src, d = _no_way(len(cid))
    at = _at(cid, known.column("cid").to_numpy())
    here = at >= 0
    for mine, name in ((h, "h"), (src, "src"), (d, "d")):
        mine[at[here]] = known.column(name).to_numpy()[here]
    _down(cid, step, end, hops, _np(t, "step"), h >= 0, h, src, d)
    out = t.select(["grid_id", "cid"]).append_column("dist", pa.array(d))
    return pa.concat_tables([out, dry.append_column("dist", pa.nulls(len(dry), pa.float64()))])


def source_ways(flow: DataFrame) -> DataFrame | None:
    """grid_id, cid, dist of the cells of ``flow`` (grid_id, cid, ds, valid, step); None if there is too much between tiles for a task."""
    cells = flow.select("grid_id", "cid", "ds", "valid", F.coalesce(F.col("step").cast("double"), F.lit(0.0)).alias("step"))
    tree = cells.where("valid").drop("valid")
    ways = durable(_beside(tree, _leaving(tree)).applyInArrow(_carried, "grid_id string, cid long, ds long, h long, src long, d double, last long, hops long, dist double"))
    if ways.count() > 4 * iterate.ALONE:
        return None
    known = durable(ways.groupBy("grid_id").applyInArrow(_carried_on, "grid_id string, cid long, h long, src long, d double")).select("*", *_tiles("cid"))
    return _beside(cells, known).applyInArrow(_sourced, "grid_id string, cid long, dist double")
