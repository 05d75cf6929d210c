"""Prominence and the divide tree, tile by tile.

A sweep goes down over the flats (adjacent equal cells, in 32 bits), from the highest, equal ones by
their first cell, and joins the domains that meet at each. Each tile sweeps its own cells and a
rim that it shares with the next tiles. What a domain holds is settled there until it touches a flat that other tiles
have too; it settles as well if it ends at a higher domain. Left are the shared flats, the domains that were
highest when they met one, and the flats where domains meet that may be one elsewhere: a small graph with a task per grid.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import iterate
from ..plans.iterate import connected_components, durable, ranked
from .components import _merge
from .directions import D8, D8Directions

#: Rows by kind: a cell, a settled feature, and the graph: a shared flat, a meeting of domains at ``flat``, a top of a
#: domain, the lower end of one that is no top.
CELL, DONE, SHARED, MEETING, TOP, LOWER = range(6)
ROWS = "grid_id string, t int, i int, j int, flat long, z double, kind int, key long, parent long, node long, cur long"
_TYPES = {"t": np.int32, "i": np.int32, "j": np.int32, "flat": np.int64, "z": np.float64, "kind": np.int32, "key": np.int64, "parent": np.int64, "node": np.int64, "cur": np.int64}


def _rows(grid_id: str, n: int, **columns: np.ndarray | int) -> pa.Table:
    """n rows of ``ROWS``; negative ids, NaN elevations and columns that aren't given are null."""
    made = {"grid_id": pa.array([grid_id] * n, pa.string())}
    for name, kind in _TYPES.items():
        value = columns.get(name)
        if value is None:
            made[name] = pa.nulls(n, pa.from_numpy_dtype(kind))
        else:
            value = np.broadcast_to(np.asarray(value, kind), n)
            made[name] = pa.array(value, mask=np.isnan(value) if kind is np.float64 else value < 0)
    return pa.table(made)


class _Tile:
    """Cells of a tile in a box, column by column, so that positions go by cell id; pieces of equal adjacent cells."""

    def __init__(self, t: pa.Table, offsets: list[tuple[int, int]], reach: int, bits: int):
        i, j = t.column("i").to_numpy().astype(np.int64), t.column("j").to_numpy().astype(np.int64)
        self.i0, self.j0 = int(i.min()), int(j.min())
        self.ni, self.nj = int(i.max()) - self.i0 + 1, int(j.max()) - self.j0 + 1
        at = (j - self.j0) * self.ni + i - self.i0
        z = t.column("z").to_numpy(zero_copy_only=False).astype(np.float32).astype(float) + 0.0
        self.z = np.full(self.ni * self.nj, np.nan)
        self.here = np.zeros(len(self.z), bool)
        self.here[at] = True
        self.z[at] = np.where(t.column("valid").to_numpy(zero_copy_only=False).astype(bool), z, np.nan)
        self.ok = ~np.isnan(self.z)
        self.j, self.i = (x + d for x, d in zip(np.divmod(np.arange(len(self.z)), self.ni), (self.j0, self.i0)))
        self.cid = (self.j << 31) + self.i
        self.many = ((np.maximum(self.i - reach, 0) >> bits) != (self.i >> bits)) | ((np.maximum(self.j - reach, 0) >> bits) != (self.j >> bits))
        index = np.arange(len(self.z)).reshape(self.nj, self.ni)
        pairs = []
        for di, dj in offsets:
            a = index[max(0, -dj) : max(0, self.nj - max(0, dj)), max(0, -di) : max(0, self.ni - max(0, di))].ravel()
            b = index[max(0, dj) : max(0, self.nj - max(0, -dj)), max(0, di) : max(0, self.ni - max(0, -di))].ravel()
            both = self.ok[a] & self.ok[b]
            pairs.append((a[both], b[both]))
        self.u, self.v = (np.concatenate(x) for x in zip(*pairs))
        same = self.z[self.u] == self.z[self.v]
        self.piece = _merge(len(self.z), self.u[same], self.v[same])
        self.u, self.v = self.u[~same], self.v[~same]


def _swept_tile(tile: _Tile, names: pa.Table, home: np.ndarray, grid_id: str, features: bool) -> pa.Table:
    """``ROWS`` of one tile; ``names`` holds the ids of flats that begin elsewhere, by their pieces' ids."""
    cells = np.flatnonzero(tile.ok)
    first = tile.cid[tile.piece]
    old, new = names.column("root").to_numpy(), names.column("comp").to_numpy()
    if len(old):
        order = np.argsort(old)
        old, new = old[order], new[order]
        at = np.minimum(np.searchsorted(old, first), len(old) - 1)
        first = np.where(old[at] == first, new[at], first)
    ids, flat = np.unique(first[cells], return_inverse=True)
    m = len(ids)
    level = np.zeros(m)
    level[flat] = tile.z[cells]
    order = np.lexsort((ids, -level))  # flats are numbered in the order of the sweep
    ids, level = ids[order], level[order]
    number = np.empty(m, np.int64)
    number[order] = np.arange(m)
    flat = number[flat]
    of = np.full(len(tile.z), -1)
    of[cells] = flat
    shared = np.zeros(m, bool)
    shared[flat[tile.many[cells]]] = True
    a, b = of[tile.u], of[tile.v]
    links = np.unique(np.maximum(a, b) * max(m, 1) + np.minimum(a, b))
    low, high = links // max(m, 1), links % max(m, 1)
    starts = np.searchsorted(low, np.arange(m + 1)).tolist()
    near_of, common, z = high.tolist(), shared.tolist(), level.tolist()

    root = list(range(m))
    kind, key, parent, prom = np.zeros(m, np.int32), np.full(m, -1), np.full(m, -1), np.zeros(m)
    open_ = np.zeros(m, bool)
    tops: dict[int, list[int]] = {}  # only of domains that no other tile can touch
    current: dict[int, int] = {}
    height: dict[int, float] = {}
    handle: dict[int, int] = {}  # only of the others: a flat by which the graph knows the domain
    meetings: list[tuple[int, int]] = []  # (flat, node of a domain, or -1 for one that ended there)
    leaves: list[tuple[int, int, int]] = []  # (node, top, lower end)
    for f in range(m):
        near = set()
        for d in near_of[starts[f] : starts[f + 1]]:
            while root[d] != d:
                root[d] = d = root[root[d]]
            near.add(d)
        if not common[f]:
            if not near:
                kind[f], prom[f], tops[f], current[f], height[f] = 1, -1, [f], f, z[f]
                continue
            if len(near) == 1:
                root[f] = near.pop()
                continue
        best = max((height[d] for d in near), default=z[f])
        if not common[f] and not any(d in handle for d in near):
            winner = next(d for d in near if height[d] == best)
            kind[f] = 2
            for d in near:
                parent[current[d]] = f
                if height[d] < best:
                    for t in tops.pop(d):
                        key[t], prom[t] = f, height[d] - z[f]
                elif d != winner:
                    tops[winner] += tops.pop(d)
                root[d] = winner
            root[f], current[winner] = winner, f
            continue
        nodes, ended = [], False
        for d in near:
            if d in handle:
                nodes.append(handle[d])
            elif height[d] < best:
                parent[current[d]], ended = f, True
                for t in tops.pop(d):
                    key[t], prom[t] = f, height[d] - z[f]
            else:
                found = tops.pop(d)
                leaves += [(found[0], t, current[d]) for t in found]
                open_[current[d]] = open_[found] = True
                nodes.append(found[0])
        if features or len(nodes) + common[f] > 1:
            meetings += [(f, n) for n in nodes]
            if ended and features:
                meetings.append((f, -1))
        winner = f if common[f] else next(d for d in near if d in handle)
        for d in near:
            root[d] = winner
        root[f], height[winner] = winner, best
        handle[winner] = f if common[f] else handle[winner]

    idn = np.r_[ids, -1]  # position -1 is no flat
    n = np.bincount(flat, minlength=m)
    away = tile.i[cells] - (np.bincount(flat, tile.i[cells], m) / np.maximum(n, 1))[flat], tile.j[cells] - (np.bincount(flat, tile.j[cells], m) / np.maximum(n, 1))[flat]
    by = np.lexsort((tile.cid[cells], away[0] ** 2 + away[1] ** 2, flat))
    middle = cells[by[np.searchsorted(flat[by], np.arange(m))]]
    ri, rj = np.where(shared, -1, tile.i[middle]), np.where(shared, -1, tile.j[middle])  # those of shared flats are found later
    out = []
    if features:
        done = np.flatnonzero((kind > 0) & ~open_)
        out.append(_rows(grid_id, len(done), t=DONE, i=ri[done], j=rj[done], flat=ids[done], z=level[done], kind=kind[done], key=idn[key[done]], parent=idn[parent[done]]))
        own = np.flatnonzero(home & tile.ok)
        own = own[shared[of[own]]]
        out.append(_rows(grid_id, len(own), t=CELL, i=tile.i[own], j=tile.j[own], flat=ids[of[own]]))
    else:
        own = np.flatnonzero(home)
        f = of[own]
        unknown = (f >= 0) & np.r_[shared | (open_ & (kind == 1)), False][f]
        out.append(_rows(grid_id, len(own), t=CELL, i=tile.i[own], j=tile.j[own], flat=np.where(unknown, idn[f], -1), z=np.where(unknown, np.nan, np.where(f < 0, -1.0, np.r_[prom, 0.0][f]))))
    s = np.flatnonzero(shared)
    out.append(_rows(grid_id, len(s), t=SHARED, flat=ids[s], z=level[s]))
    at, node = np.array(meetings, np.int64).reshape(-1, 2).T
    out.append(_rows(grid_id, len(at), t=MEETING, i=ri[at], j=rj[at], flat=ids[at], z=level[at], node=idn[node]))
    node, top, cur = np.array(leaves, np.int64).reshape(-1, 3).T
    out.append(_rows(grid_id, len(top), t=TOP, i=ri[top], j=rj[top], flat=ids[top], z=level[top], kind=1, parent=idn[parent[top]], node=ids[node], cur=ids[cur]))
    cur = np.unique(cur[kind[cur] == 2])
    out.append(_rows(grid_id, len(cur), t=LOWER, i=ri[cur], j=rj[cur], flat=ids[cur], z=level[cur], kind=2))
    return pa.concat_tables(out)


def _solved_graph(t: pa.Table) -> pa.Table:
    """The features among a grid's graph as ``DONE`` rows, with the prominence of peaks."""
    grid_id = t.column("grid_id")[0].as_py()
    column = {c: t.column(c).combine_chunks() for c in ("t", "i", "j", "flat", "z", "kind", "parent", "node", "cur")}
    number = {c: iterate._np(t, c) for c in column}
    some = lambda c: column[c].is_valid().to_numpy(zero_copy_only=False)
    ids = np.unique(np.concatenate([number["flat"], *(number[c][some(c)] for c in ("parent", "node", "cur"))]))
    at = {c: np.where(some(c), np.searchsorted(ids, number[c]), -1) for c in ("flat", "parent", "node", "cur")}
    m, kinds = len(ids), number["t"]
    z, kind, key, parent, prom = np.zeros(m), np.zeros(m, np.int32), np.full(m, -1), np.full(m, -1), np.zeros(m)
    place = {c: np.full(m, -1) for c in "ij"}
    z[at["flat"]] = number["z"]
    for c in "ij":
        has = some(c)
        place[c][at["flat"][has]] = number[c][has]
    common = np.zeros(m, bool)
    common[at["flat"][kinds == SHARED]] = True
    kind[at["flat"][kinds == LOWER]] = 2
    root, tops, current = [-1] * m, {}, {}
    is_top = kinds == TOP
    for node, top, cur, up in zip(*(at[c][is_top].tolist() for c in ("node", "flat", "cur", "parent"))):
        root[node], current[node], kind[top], parent[top], prom[top] = node, cur, 1, up, -1
        tops.setdefault(node, []).append(top)
    height = {d: float(z[x[0]]) for d, x in tops.items()}

    meet = kinds == MEETING
    by = np.argsort(at["flat"][meet], kind="stable")
    where, nodes = at["flat"][meet][by], at["node"][meet][by].tolist()
    keys = np.union1d(where, np.flatnonzero(common))
    keys = keys[np.lexsort((keys, -z[keys]))]
    begin, end = np.searchsorted(where, keys).tolist(), np.searchsorted(where, keys, "right").tolist()
    for f, lo, hi, level, both in zip(keys.tolist(), begin, end, z[keys].tolist(), common[keys].tolist()):
        near, ended = set(), False
        for d in nodes[lo:hi]:
            if d < 0:
                ended = True
                continue
            while root[d] != d:
                root[d] = d = root[root[d]]
            near.add(d)
        if not near:
            root[f], tops[f], current[f], height[f], kind[f], prom[f] = f, [f], f, level, 1, -1
            continue
        if len(near) == 1 and not ended:
            if both:
                root[f] = near.pop()
            continue
        best = max(height[d] for d in near)
        winner = next(d for d in near if height[d] == best)
        kind[f] = 2
        for d in near:
            parent[current[d]] = f
            if height[d] < best:
                for x in tops.pop(d):
                    key[x], prom[x] = f, height[d] - level
            elif d != winner:
                tops[winner] += tops.pop(d)
            root[d] = winner
        root[f], current[winner] = winner, f
    idn, some = np.r_[ids, -1], np.flatnonzero(kind)
    out = _rows(grid_id, len(some), t=DONE, i=place["i"][some], j=place["j"][some], flat=ids[some], z=z[some], kind=kind[some], key=idn[key[some]], parent=idn[parent[some]])
    return out.append_column("prom", pa.array(prom[some]))


def swept(cells: DataFrame, scheme: D8Directions, features: bool) -> tuple[DataFrame, DataFrame]:
    """(``ROWS`` of all tiles, the solved features of the graph between them)."""
    bits, reach = iterate.TILE_BITS, scheme.window // 2
    offsets = [(d.di, d.dj) for d in scheme.neighbours() if (d.di, d.dj) > (0, 0)]
    tiles = lambda c: F.explode(F.sequence(F.shiftright(F.greatest(F.col(c) - reach, F.lit(0)), bits), F.shiftright(c, bits)))
    k = ["grid_id", "ti", "tj"]
    spread = cells.select("grid_id", "i", "j", F.col("z").cast("double").alias("z"), "valid").select("*", tiles("i").alias("ti")).select("*", tiles("j").alias("tj"))

    def ends(t: pa.Table) -> pa.Table:
        tile = _Tile(t, offsets, reach, bits)
        at = np.flatnonzero(tile.many & tile.ok)
        out = t.select(k).slice(0, 1).take(pa.array(np.zeros(len(at), np.int64)))
        return out.append_column("cid", pa.array(tile.cid[at])).append_column("root", pa.array(tile.cid[tile.piece[at]]))

    # a flat is known by its first cell, which may lie in another tile
    pieces = durable(spread.groupBy(*k).applyInArrow(ends, "grid_id string, ti int, tj int, cid long, root long"))
    lows = pieces.groupBy("grid_id", "cid").agg(F.min("root").alias("low"), F.max("root").alias("top")).where("low <> top").drop("top")
    links = durable(pieces.join(lows, ["grid_id", "cid"]).where("root <> low").select("grid_id", "root", "low").distinct())
    if links.count() <= iterate.ALONE:

        def merge(t: pa.Table) -> pa.Table:
            u, v = t.column("root").to_numpy(), t.column("low").to_numpy()
            ids = np.unique(np.r_[u, v])
            comp = ids[_merge(len(ids), np.searchsorted(ids, u), np.searchsorted(ids, v))]
            grid_id = t.select(["grid_id"]).slice(0, 1).take(pa.array(np.zeros(len(ids), np.int64)))
            return grid_id.append_column("root", pa.array(ids)).append_column("comp", pa.array(comp))

        found = links.groupBy("grid_id").applyInArrow(merge, "grid_id string, root long, comp long")
    else:
        node = lambda c: F.struct("grid_id", F.col(c).alias("cid"))
        found = connected_components(links.select(node("root").alias("u"), node("low").alias("v")))
        found = found.select(F.col("node.grid_id").alias("grid_id"), F.col("node.cid").alias("root"), F.col("component.cid").alias("comp"))
    names = durable(pieces.select(*k, "root").distinct().join(found.where("root <> comp"), ["grid_id", "root"]).select(*k, "root", "comp"))

    def sweep(t: pa.Table, names: pa.Table) -> pa.Table:
        tile = _Tile(t, offsets, reach, bits)
        home = tile.here & (tile.i >> bits == t.column("ti")[0].as_py()) & (tile.j >> bits == t.column("tj")[0].as_py())
        return _swept_tile(tile, names, home, t.column("grid_id")[0].as_py(), features)

    rows = durable(spread.groupBy(*k).cogroup(names.groupBy(*k)).applyInArrow(sweep, ROWS))
    graph = rows.where(F.col("t") >= SHARED).groupBy("grid_id").applyInArrow(_solved_graph, ROWS + ", prom double")
    return rows, durable(graph)


def prominence(cells: DataFrame, scheme: D8Directions = D8) -> DataFrame:
    """grid_id, i, j, prom: -1 invalid or highest of its region, 0 no summit."""
    rows, graph = swept(cells, scheme, False)
    own = rows.where(F.col("t") == CELL)
    known = own.where("flat is null").select("grid_id", "i", "j", F.col("z").alias("prom"))
    left = own.where("flat is not null").select("grid_id", "i", "j", "flat").join(graph.where("kind = 1").select("grid_id", "flat", "prom"), ["grid_id", "flat"], "left")
    return known.unionByName(left.select("grid_id", "i", "j", F.coalesce("prom", F.lit(0.0)).alias("prom")))


def prominence_features(cells: DataFrame, scheme: D8Directions = D8) -> DataFrame:
    """grid_id, fid, kind (1 peak, 2 saddle), i, j, key_saddle, parent: the divide tree, in the order of the sweep.

    A feature lies at the cell of its flat that is nearest to the flat's middle, the first of equal ones.
    """
    rows, graph = swept(cells, scheme, True)
    shown = ["grid_id", "flat", "z", "kind", "key", "parent", "i", "j"]
    over = graph.where("i is null").select("grid_id", "flat")
    members = rows.where(F.col("t") == CELL).select("grid_id", "flat", "i", "j").join(over, ["grid_id", "flat"], "left_semi")
    middle = members.groupBy("grid_id", "flat").agg(F.avg("i").alias("mi"), F.avg("j").alias("mj"))
    away = (F.col("i") - F.col("mi")) * (F.col("i") - F.col("mi")) + (F.col("j") - F.col("mj")) * (F.col("j") - F.col("mj"))
    at = members.join(middle, ["grid_id", "flat"]).groupBy("grid_id", "flat").agg(F.min(F.struct(away.alias("d2"), "j", "i")).alias("at"))
    wide = graph.where("i is null").drop("i", "j").join(at, ["grid_id", "flat"]).select("*", "at.i", "at.j")
    found = rows.where(F.col("t") == DONE).select(shown).unionByName(graph.where("i is not null").select(shown)).unionByName(wide.select(shown))
    placed = durable(ranked(found.withColumn("down", 0.0 - F.col("z")), ["grid_id"], ["down", "flat"], "n").withColumn("fid", F.col("n") - 1))
    of = lambda c, name: placed.select("grid_id", F.col("flat").alias(c), F.col("fid").alias(name))
    out = placed.join(of("key", "key_saddle"), ["grid_id", "key"], "left").join(of("parent", "up"), ["grid_id", "parent"], "left")
    none = lambda c: F.coalesce(c, F.lit(-1))
    return out.select("grid_id", "fid", "kind", "i", "j", none("key_saddle").alias("key_saddle"), none("up").alias("parent"))
