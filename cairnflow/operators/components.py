"""Connected components of cells, ocean basins, and labels by first cell."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import iterate
from ..plans.iterate import connected_components, durable, ranked
from .directions import D8
from .grid import shapes
from .stencil import neighbour, neighbourhood


def _merge(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of 0 ... n - 1 over the links (u, v): hooking and pointer jumping."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def joined_roots(links: DataFrame) -> DataFrame:
    """(grid_id, root, comp) for every end of a link (grid_id, root, far): its component by the smallest root.

    One task per grid solves up to ``iterate.ALONE`` links, rounds solve more.
    """
    links = durable(links.select("grid_id", F.least("root", "far").alias("root"), F.greatest("root", "far").alias("far")).distinct())
    if links.count() > iterate.ALONE:
        node = lambda c: F.struct("grid_id", F.col(c).alias("cid"))
        found = connected_components(links.select(node("root").alias("u"), node("far").alias("v")))
        return found.select(F.col("node.grid_id").alias("grid_id"), F.col("node.cid").alias("root"), F.col("component.cid").alias("comp"))

    def solve(t: pa.Table) -> pa.Table:
        ends = [t.column(c).to_numpy() for c in ("root", "far")]
        roots, at = np.unique(np.concatenate(ends), return_inverse=True)
        comp = roots[_merge(len(roots), *np.split(at, 2))]
        return pa.table({"grid_id": pa.chunked_array([t.column("grid_id").combine_chunks().take(pa.array(np.zeros(len(roots), np.int64)))]), "root": pa.array(roots), "comp": pa.array(comp)})

    return links.groupBy("grid_id").applyInArrow(solve, "grid_id string, root long, comp long")


def component_of(cells: DataFrame, member: Column, joined=None, values: tuple[str, ...] = (), tile: int = 256) -> DataFrame:
    """grid_id, i, j, cid, comp of the cells where ``member`` holds: 8-connected components by their smallest cid.

    ``joined(n)`` may restrict which neighbour structs (with ``values``) count as connected.
    Components are merged inside each tile first; only links between tiles, whose number goes
    with the tiles' borders, take part in the distributed rounds.
    """
    marked = cells.withColumn("_in", F.coalesce(member, F.lit(False)))
    near = neighbourhood(marked, ["_in", *values]).where("_in")
    half = [d for d in D8.neighbours() if (d.di, d.dj) > (0, 0)]  # each pair once
    links = []
    for d in half:
        n = neighbour(d)
        ok = n["_in"] if joined is None else n["_in"] & joined(n)
        links.append(F.when(ok, n["cid"]))
    base = near.select("grid_id", "i", "j", "cid", F.array_compact(F.array(*links)).alias("to"))

    def merge(t: pa.Table) -> pa.Table:
        t = t.select(["grid_id", "i", "j", "cid", "to"]).sort_by("cid")
        cid, to = t.column("cid").to_numpy(), t.column("to").combine_chunks()
        ends = to.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.diff(to.offsets.to_numpy())
        u = np.repeat(np.arange(len(cid)), counts)
        at = np.minimum(np.searchsorted(cid, ends), max(len(cid) - 1, 0))
        inside = cid[at] == ends
        root = cid[_merge(len(cid), u[inside], at[inside])]
        bounds = np.r_[0, np.cumsum(np.bincount(u[~inside], minlength=len(cid)))].astype(np.int32)
        away = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ends[~inside], pa.int64()))
        return t.drop_columns(["to"]).append_column("root", pa.array(root, pa.int64())).append_column("away", away)

    tiles = base.groupBy("grid_id", F.floor(F.col("i") / tile), F.floor(F.col("j") / tile))
    kept = durable(tiles.applyInArrow(merge, "grid_id string, i int, j int, cid long, root long, away array<long>"))
    node = lambda c: F.struct("grid_id", F.col(c).alias("cid"))
    away = kept.where(F.size("away") > 0).select("grid_id", "root", F.explode("away").alias("t"))
    there = kept.select("grid_id", F.col("cid").alias("t"), F.col("root").alias("far"))
    found = joined_roots(away.join(there, ["grid_id", "t"]))
    out = kept.join(found, ["grid_id", "root"], "left")
    return out.select("grid_id", "i", "j", "cid", F.coalesce("comp", "root").alias("comp"))


def mask_areas(cells: DataFrame, mask: Column) -> DataFrame:
    """grid_id, i, j, label: components of the mask, numbered by their first cell column by column; 0 outside."""
    comps = component_of(cells, mask)
    ranks = comps.groupBy("grid_id", "comp").agg(F.min("cid").alias("first"))
    ranks = ranked(ranks, ["grid_id"], ["first"], "label")
    labelled = comps.join(ranks, ["grid_id", "comp"]).select("grid_id", "cid", "label")
    return cells.join(labelled, ["grid_id", "cid"], "left").select("grid_id", "i", "j", F.coalesce("label", F.lit(0)).alias("label"))


def ocean_basins(cells: DataFrame, level: float = 0, flood_below: bool = True) -> DataFrame:
    """grid_id, i, j, label: components at (or, flooding, at or below) the level that touch the raster's edge.

    Numbered by the first cell met along the edge: first row, last row, first column, last column.
    """
    z = F.col("z")
    member = F.col("valid") & (z <= level if flood_below else z == level)
    comps = component_of(cells, member).join(F.broadcast(shapes(cells)), "grid_id")
    i, j, nr, nc = (F.col(c) for c in ("i", "j", "nrows", "ncols"))
    place = F.when(i == 0, j).when(i == nr - 1, nc + j).when(j == 0, 2 * nc + i).when(j == nc - 1, 2 * nc + nr + i)
    first = comps.groupBy("grid_id", "comp").agg(F.min(place).alias("place")).where("place is not null")
    ranks = ranked(first, ["grid_id"], ["place"], "label")
    labelled = comps.join(ranks, ["grid_id", "comp"]).select("grid_id", "cid", "label")
    return cells.join(labelled, ["grid_id", "cid"], "left").select("grid_id", "i", "j", F.coalesce("label", F.lit(0)).alias("label"))


def invalidate_ocean_basins(cells: DataFrame, level: float = 0, flood_below: bool = True, min_size: int = 1) -> DataFrame:
    """The cells with ``valid`` false in every ocean basin of at least ``min_size`` cells."""
    basins = ocean_basins(cells, level, flood_below).where("label > 0")
    large = basins.groupBy("grid_id", "label").count().where(F.col("count") >= min_size).select("grid_id", "label")
    wet = basins.join(large, ["grid_id", "label"], "left_semi").select("grid_id", "i", "j", F.lit(True).alias("wet"))
    return cells.join(wet, ["grid_id", "i", "j"], "left").withColumn("valid", F.col("valid") & F.col("wet").isNull()).select(*cells.columns)
