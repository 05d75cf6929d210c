"""D8 flow directions, flat resolution and depression filling."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, ShortType, StructField, StructType

from ..plans.iterate import durable, on_cycles, ranked
from . import flats as tiled
from .components import component_of, joined_roots
from .directions import D8, D8Directions
from .grid import shapes, with_ids
from .stencil import any_neighbour, neighbourhood, with_lowest


def simple_d8(cells: DataFrame, scheme: D8Directions = D8) -> DataFrame:
    """The cells with ``code`` (of the strictly lowest valid neighbour), ``ds`` (its cid) and ``is_flat``.

    Elevations are compared in 32 bits. Invalid cells have the no-flow code and no ``ds``.
    """
    work = cells.withColumn("_z", F.col("z").cast("float"))
    best = with_lowest(work, "_z", F.col("valid"), scheme)
    code = F.coalesce("_b.code", F.lit(scheme.no_flow_code).cast("smallint"))
    return best.select(*cells.columns, code.alias("code"), F.col("_b.cid").alias("ds"), (F.col("valid") & F.col("_b.cid").isNull()).alias("is_flat"))


def flat_edges(flow: DataFrame) -> DataFrame:
    """Add low_edge (flows, beside an equal cell that doesn't) and high_edge (doesn't flow, beside a higher cell)."""
    work = flow.withColumn("_z", F.col("z").cast("float")).withColumn("_out", F.col("ds").isNotNull())
    near = neighbourhood(work, ["_z", "valid", "_out"])
    low = F.col("valid") & F.col("_out") & any_neighbour(lambda n: n["valid"] & ~n["_out"] & (n["_z"] == F.col("_z")))
    high = F.col("valid") & ~F.col("_out") & any_neighbour(lambda n: n["valid"] & (n["_z"] > F.col("_z")))
    return near.select(*flow.columns, low.alias("low_edge"), high.alias("high_edge"))


def flat_labels(edged: DataFrame) -> DataFrame:
    """Add ``label``: equal-elevation components with a low edge or no-flow cell, by their first such cell; 0 elsewhere."""
    work = edged.withColumn("_z", F.col("z").cast("float"))
    comps = component_of(work, F.col("valid"), lambda n: n["_z"] == F.col("_z"), ("_z",))
    seed = F.col("valid") & (F.col("low_edge") | F.col("ds").isNull())
    joined = edged.join(comps.select("grid_id", "cid", "comp"), ["grid_id", "cid"], "left")
    first = joined.where(seed).groupBy("grid_id", "comp").agg(F.min("cid").alias("first"))
    ranks = ranked(first, ["grid_id"], ["first"], "label").select("grid_id", "comp", "label")
    return joined.join(ranks, ["grid_id", "comp"], "left").select(*edged.columns, F.coalesce("label", F.lit(0)).alias("label"))


def _blocks(c: str, bits: int, halo: int) -> Column:
    """The tiles, by row or column, of 2**bits rows or columns and a rim of ``halo`` that hold a cell: a row for each."""
    return F.explode(F.sequence(F.shiftright(F.greatest(F.col(c) - halo, F.lit(0)), bits), F.shiftright(F.col(c) + halo, bits)))


def _own(key: tuple, t: pa.Table, bits: int) -> np.ndarray:
    """Which cells lie in the tile and not in its rim."""
    return (t.column("i").to_numpy() >> bits == key[1].as_py()) & (t.column("j").to_numpy() >> bits == key[2].as_py())


def layers(labelled: DataFrame, seeds: Column, name: str, max_rounds: int = 100_000) -> DataFrame:
    """Add ``name``: 1 on the seeds, then one more per step within the same label; 0 if not reached.

    Each round grows the tiles apart, from the layers that their cells and those on their rims have; it ends when none changes.
    """
    flats = durable(labelled.where("label > 0").select("grid_id", "i", "j", "cid", "label", F.when(seeds, 1).otherwise(0).cast("long").alias("_d")))
    bits = tiled.TILE_BITS

    def run(key: tuple, t: pa.Table) -> pa.Table:
        order, near = tiled.placed(*(t.column(c).to_numpy().astype(np.int64) for c in ("i", "j")))
        label, before = (t.column(c).to_numpy()[order] for c in ("label", "_d"))
        depth = tiled.regrown(before, near, (near >= 0) & (label[near] == label))
        own = np.flatnonzero(_own(key, t, bits)[order])
        out = t.select(["grid_id", "i", "j", "cid", "label"]).take(pa.array(order[own]))
        return out.append_column("_d", pa.array(depth[own])).append_column("_new", pa.array((depth != before)[own]))

    kinds = StructType([*flats.schema.fields, StructField("_new", BooleanType())])
    for _ in range(max_rounds):
        work = flats.select("*", _blocks("i", bits, 1).alias("_bi")).select("*", _blocks("j", bits, 1).alias("_bj"))
        flats = durable(work.groupBy("grid_id", "_bi", "_bj").applyInArrow(run, kinds))
        settled = flats.where("_new").isEmpty()
        flats = flats.drop("_new")
        if settled:
            break
    else:
        raise RuntimeError(f"a flat needs more than {max_rounds} rounds")
    reached = flats.select("grid_id", "cid", F.col("_d").cast("int").alias(name))
    return labelled.join(reached, ["grid_id", "cid"], "left").withColumn(name, F.coalesce(name, F.lit(0))).select(*labelled.columns, name)


def _layers_by_flat(labelled: DataFrame, cells: int, alone: int = 4096, share: int = 65_536) -> DataFrame:
    """Add push_d and pull_d: breadth-first layers from high and low edges.

    A flat of more than ``alone`` cells has a kernel call of its own, smaller ones share one of about ``share``
    of the ``cells``. ``labelled`` has the flats' sizes as ``n``.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, flat = (pdf[c].to_numpy(np.int64) for c in ("i", "j", "label"))
        order = np.lexsort((j, i))
        i, j, flat = i[order], j[order], flat[order]
        wide = int(j.max()) + 3
        key = (i + 1) * wide + j + 1
        slots = np.full((8, len(key)), -1)
        for k, d in enumerate(D8.neighbours()):
            to = key + d.di * wide + d.dj
            at = np.minimum(np.searchsorted(key, to), len(key) - 1)
            slots[k] = np.where((key[at] == to) & (flat[at] == flat), at, -1)
        out = {"grid_id": pdf.grid_id.to_numpy(), "cid": pdf.cid.to_numpy()[order]}
        for name, seed in (("push_d", "high_edge"), ("pull_d", "low_edge")):
            out[name] = tiled.grown(pdf[seed].to_numpy(bool)[order], slots, slots >= 0)
        return pd.DataFrame(out)

    key = F.when(F.col("n") > alone, F.col("label")).otherwise(-F.pmod(F.xxhash64("label"), F.lit(cells // share + 1)) - 1)
    return labelled.groupBy("grid_id", key).applyInPandas(run, "grid_id string, cid long, push_d long, pull_d long")


def _depths(flats: DataFrame, kernel_cells: int) -> DataFrame:
    """(grid_id, cid, push_d, pull_d) of the cells of ``flats``: layers from high and low edges."""
    sizes = flats.groupBy("grid_id", "label").agg(F.count("*").alias("n"))
    small = flats.join(sizes.where(F.col("n") <= kernel_cells), ["grid_id", "label"])
    done = _layers_by_flat(small, flats.count())
    large = flats.join(sizes.where(F.col("n") > kernel_cells).select("grid_id", "label"), ["grid_id", "label"], "left_semi")
    if not large.isEmpty():
        grown = layers(layers(large, F.col("high_edge"), "push_d"), F.col("low_edge"), "pull_d")
        done = done.unionByName(grown.select("grid_id", "cid", F.col("push_d").cast("long"), F.col("pull_d").cast("long")))
    return durable(done)


def flat_gradients(labelled: DataFrame, kernel_cells: int = 1_000_000) -> DataFrame:
    """Add ``push`` (falling from higher terrain) and ``pull`` (falling to lower terrain) on labelled cells.

    push = greatest layer of the flat - layer + 1, with layer 0 where no high edge reaches;
    push is 0 everywhere if the raster has no high edge at all. Flats of at most
    ``kernel_cells`` go to a task each; larger ones are grown by rounds over the whole table.
    """
    flats = durable(labelled.where("label > 0").select("grid_id", "i", "j", "cid", "label", "high_edge", "low_edge"))
    done = _depths(flats, kernel_cells)
    out = labelled.join(done, ["grid_id", "cid"], "left")
    any_high = done.groupBy("grid_id").agg(F.max("push_d").alias("_any"))
    out = out.join(F.broadcast(any_high), "grid_id", "left")
    tops = flats.join(done, ["grid_id", "cid"]).groupBy("grid_id", "label").agg(F.max("push_d").alias("_top"))
    out = out.join(tops, ["grid_id", "label"], "left")
    push = F.when((F.col("label") > 0) & (F.col("_any") > 0), F.col("_top") - F.col("push_d") + 1).otherwise(0)
    return out.select(*labelled.columns, push.alias("push"), F.coalesce("pull_d", F.lit(0)).alias("pull"))


#: What ``tiled_flats`` adds, besides ``push``.
MADE = {"code": ShortType(), "ds": LongType(), "is_flat": BooleanType(), "low_edge": BooleanType(), "high_edge": BooleanType(), "first": LongType(), "rise": LongType(), "pull": LongType()}


def tiled_flats(cells: DataFrame, keep: Sequence[str], scheme: D8Directions = D8, kernel_cells: int = 1_000_000) -> DataFrame:
    """The columns ``keep`` of the cells, and of code, ds, is_flat, low_edge, high_edge, push, pull and first (the first cell
    with a low edge or no flow of the cell's flat; null where there is none), as the operators above give them.

    One kernel call per tile gives all that can be seen in it. The cells of components that leave their tile, whose
    number goes with the tiles' borders and the size of such flats, are joined and grown afterwards. For 3 x 3 windows.
    """
    dirs, no_flow = scheme.neighbours(), scheme.no_flow_code  # in order of preference
    held = list(dict.fromkeys(["grid_id", *(c for c in keep if c != "push"), *(["rise", "high_edge"] if "push" in keep else [])]))
    bits, halo = tiled.TILE_BITS, tiled.HALO

    def run(key: tuple, t: pa.Table) -> pa.Table:
        return tiled.flat_tile(t, _own(key, t, bits), dirs, no_flow, held)

    sent = list(dict.fromkeys(["grid_id", "i", "j", "cid", "valid", *(c for c in held if c not in MADE)]))
    work = cells.select(*sent, F.col("z").cast("float").alias("_z"), _blocks("i", bits, halo).alias("_bi")).select("*", _blocks("j", bits, halo).alias("_bj"))
    edge = StructType([StructField(n, k) for n, k in (("cid", LongType()), ("root", LongType()), ("seed", BooleanType()), ("low_edge", BooleanType()), ("high_edge", BooleanType()), ("away", ArrayType(LongType())))])
    kinds = StructType([StructField(c, MADE.get(c) or cells.schema[c].dataType) for c in held] + [StructField("open", edge)])
    part = durable(work.groupBy("grid_id", "_bi", "_bj").applyInArrow(run, kinds))

    later = [c for c in ("first", "rise", "pull") if c in held]
    opened = part.where("open is not null")
    out = part.where("open is null").drop("open")
    if later and not opened.isEmpty():
        whole = durable(_across(opened.select("grid_id", "open.*"), kernel_cells)).select("grid_id", F.col("cid").alias("_c"), *later)
        found = opened.drop(*later).withColumn("_c", F.col("open.cid")).join(whole, ["grid_id", "_c"])
        out = out.unionByName(found.select(*held))
    if "push" in keep:
        high = part.where("high_edge").select("grid_id", F.lit(True).alias("_high")).distinct()
        out = out.join(F.broadcast(high), "grid_id", "left").withColumn("push", F.when(F.col("_high"), F.col("rise")).otherwise(0))
    return out.select(*keep)


def _across(cells: DataFrame, kernel_cells: int) -> DataFrame:
    """(grid_id, cid, first, rise, pull) of the cells of components that leave their tile."""
    away = cells.where(F.size("away") > 0).select("grid_id", "root", F.explode("away").alias("t"))
    roots = joined_roots(away.join(cells.select("grid_id", F.col("cid").alias("t"), F.col("root").alias("far")), ["grid_id", "t"]))
    label, i = F.col("comp") + 1, F.col("cid").bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    flats = durable(cells.join(roots, ["grid_id", "root"]).select("grid_id", i.alias("i"), F.shiftright("cid", 31).cast("int").alias("j"), "cid", label.alias("label"), "seed", "high_edge", "low_edge"))
    done = flats.join(_depths(flats.drop("seed"), kernel_cells), ["grid_id", "cid"])
    whole = done.groupBy("grid_id", "label").agg(F.min(F.when(F.col("seed"), F.col("cid"))).alias("first"), F.max("push_d").alias("_top"))
    rise = F.when(F.col("first").isNotNull(), F.col("_top") - F.col("push_d") + 1).otherwise(0)
    return done.join(whole, ["grid_id", "label"]).select("grid_id", "cid", "first", rise.alias("rise"), F.col("pull_d").alias("pull"))


def numbered(flats: DataFrame) -> DataFrame:
    """Put ``label``, as ``flat_labels`` gives it, in the place of ``first``."""
    ranks = ranked(flats.where("first = cid").select("grid_id", "first"), ["grid_id"], ["first"], "label")
    return flats.join(ranks, ["grid_id", "first"], "left").select(*(c for c in flats.columns if c != "first"), F.coalesce("label", F.lit(0)).alias("label"))


def complete_d8(cells: DataFrame, step_size: int = 4, scheme: D8Directions = D8) -> DataFrame:
    """Simple D8 with flats resolved: adds code, ds, is_flat, label, z_syn.

    z_syn = push + step_size * pull; a no-flow cell goes to the neighbour of its flat with the
    strictly lowest z_syn.
    """
    if scheme.window == 3:
        synthetic = numbered(tiled_flats(cells, [*cells.columns, "code", "ds", "is_flat", "push", "pull", "first"], scheme))
    else:
        synthetic = flat_gradients(durable(flat_labels(durable(flat_edges(durable(simple_d8(cells, scheme)))))))
    work = durable(synthetic.withColumn("z_syn", F.col("push") + step_size * F.col("pull")))
    merged = with_lowest(work, "z_syn", F.col("valid") & (F.col("label") > 0), scheme, "label")
    use = F.col("valid") & F.col("ds").isNull() & F.col("_b.cid").isNotNull()
    return merged.select(*cells.columns, F.when(use, F.col("_b.code")).otherwise(F.col("code")).alias("code"), F.when(use, F.col("_b.cid")).otherwise(F.col("ds")).alias("ds"), "is_flat", "label", "z_syn")


def synthetic_d8(cells: DataFrame, scheme: D8Directions = D8) -> DataFrame:
    """Directions on (z_syn, label) alone: the lowest z_syn within the label."""
    best = with_lowest(cells, "z_syn", F.col("valid") & (F.col("label") > 0), scheme, "label")
    return best.select(*cells.columns, F.coalesce("_b.code", F.lit(scheme.no_flow_code).cast("smallint")).alias("code"), F.col("_b.cid").alias("ds"))


def flow_from_codes(cells: DataFrame, scheme: D8Directions = D8) -> DataFrame:
    """Add ``ds`` to cells with a ``code``: the target's cid, null for no flow, off-grid or invalid targets; and ``is_sink``."""
    from .stencil import downstream

    down = downstream(cells, scheme)
    target = cells.select("grid_id", F.col("cid").alias("ds_cid"), F.col("valid").alias("_tv"))
    own = F.col("ds_cid") == F.col("cid")
    out = down.join(target, ["grid_id", "ds_cid"], "left")
    ds = F.when(F.col("valid") & F.coalesce(F.col("_tv"), F.lit(False)) & ~own, F.col("ds_cid"))
    return out.select(*cells.columns, ds.alias("ds"), (F.col("valid") & F.coalesce(own, F.lit(False))).alias("is_sink"))


def indegree(flow: DataFrame) -> DataFrame:
    """grid_id, i, j, cid, indegree: valid cells that flow into each cell."""
    n = flow.where("valid and ds is not null").groupBy("grid_id", F.col("ds").alias("cid")).agg(F.count("*").cast("int").alias("n"))
    return flow.join(n, ["grid_id", "cid"], "left").select("grid_id", "i", "j", "cid", F.coalesce("n", F.lit(0)).alias("indegree"))


def acyclic(flow: DataFrame) -> DataFrame:
    """grid_id, i, j, acyclic, cyclic: cyclic cells lie on a cycle of the flow field; one that only leads into it doesn't."""
    on = on_cycles(flow.where("valid"), ["grid_id"]).withColumn("on", F.lit(True))
    out = flow.join(on, ["grid_id", "cid"], "left")
    return out.select("grid_id", "i", "j", (F.col("valid") & F.col("on").isNull()).alias("acyclic"), (F.col("valid") & F.col("on").isNotNull()).alias("cyclic"))


def _flood(z: np.ndarray, ok: np.ndarray, seeds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], float]]:
    """Priority flood of one tile from ``seeds``: filled levels, watershed labels and spill heights between labels."""
    ni, nj = z.shape
    wide = nj + 2  # flat lists with a rim of cells that don't count
    steps = [d.di * wide + d.dj for d in D8.neighbours()]
    flat = lambda x, rim: np.pad(x, 1, constant_values=rim).ravel().tolist()
    height, free = flat(z, np.nan), flat(ok, False)
    label, heap, n = [-1] * len(height), [], len(seeds)
    for k, (i, j) in enumerate(seeds):
        c = (i + 1) * wide + j + 1
        heap.append((height[c], k, c))
        label[c] = k
    heapq.heapify(heap)
    filled, order = height.copy(), n
    spill: dict[int, float] = {}
    while heap:
        h, _, c = heapq.heappop(heap)
        mine = label[c]
        for s in steps:
            a = c + s
            if not free[a]:
                continue
            theirs = label[a]
            if theirs < 0:
                label[a] = mine
                if height[a] < h:
                    filled[a] = h
                heapq.heappush(heap, (filled[a], order, a))
                order += 1
            elif theirs != mine:
                key = theirs * n + mine if theirs < mine else mine * n + theirs
                level = filled[a] if filled[a] > h else h
                if level < spill.get(key, np.inf):
                    spill[key] = level
    back = lambda x, kind: np.array(x, kind).reshape(ni + 2, wide)[1:-1, 1:-1]
    return back(filled, float), back(label, np.int64), {divmod(key, n): level for key, level in spill.items()}


def fill_depressions(cells: DataFrame, tile: int = 256, extra_sinks: DataFrame | None = None) -> DataFrame:
    """The cells with every depression raised to its spill level: the least, over ways to a sink, of the way's highest cell.

    Sinks are valid cells on the raster's edge or beside an invalid cell, and ``extra_sinks``
    (grid_id, cid). Each tile is flooded from its border cells and sinks; the heights at
    which watersheds spill into each other, within and across tiles, form a small graph whose
    minimax levels lift the tiles (parallel priority flood, Barnes 2016). The graph, a few
    nodes per border cell of a tile, is solved in one task per grid.
    """
    shape = shapes(cells)
    near = neighbourhood(cells.withColumn("_z", F.col("z").cast("float").cast("double")), ["valid"])
    beside = any_neighbour(lambda n: ~n["valid"])
    marked = near.join(F.broadcast(shape), "grid_id")
    edge = (F.col("i") == 0) | (F.col("j") == 0) | (F.col("i") == F.col("nrows") - 1) | (F.col("j") == F.col("ncols") - 1)
    marked = marked.withColumn("sink", F.col("valid") & (edge | beside))
    if extra_sinks is not None:
        marked = marked.join(extra_sinks.select("grid_id", "cid", F.lit(True).alias("_x")), ["grid_id", "cid"], "left").withColumn("sink", F.col("sink") | (F.col("valid") & F.col("_x").isNotNull()))
    tiled = marked.select("grid_id", "i", "j", "cid", "_z", "valid", "sink", F.floor(F.col("i") / tile).alias("ti"), F.floor(F.col("j") / tile).alias("tj"))

    def flood(pdf: pd.DataFrame) -> pd.DataFrame:
        i0, j0 = int(pdf.i.min()), int(pdf.j.min())
        ni, nj = int(pdf.i.max()) - i0 + 1, int(pdf.j.max()) - j0 + 1
        i, j = pdf.i.to_numpy() - i0, pdf.j.to_numpy() - j0
        z, ok, sink = np.full((ni, nj), np.nan), np.zeros((ni, nj), bool), np.zeros((ni, nj), bool)
        z[i, j], ok[i, j], sink[i, j] = pdf._z.to_numpy(), pdf.valid.to_numpy(bool), pdf.sink.to_numpy(bool)
        rim = np.zeros((ni, nj), bool)
        rim[[0, -1], :], rim[:, [0, -1]] = True, True
        seeds = [(int(a), int(b)) for a, b in zip(*np.nonzero(ok & (rim | sink)))]
        filled, label, spill = _flood(z, ok, seeds)
        ids = np.full((ni, nj), -1, np.int64)
        ids[i, j] = pdf.cid.to_numpy()
        name = ids[ok & (rim | sink)]  # a watershed is known by its seed cell
        rows = pdf[["grid_id", "i", "j", "cid"]].copy()
        lab = label[i, j]
        rows["w"] = filled[i, j]
        rows["shed"] = np.where(lab >= 0, name[lab] if len(name) else 0, -1)
        rows["rim"] = rim[i, j] & ok[i, j]
        rows["sink"] = sink[i, j]
        rows["a"], rows["b"], rows["level"] = -1, -1, np.nan
        x, y = np.array(list(spill), np.int64).reshape(-1, 2).T
        edges = pd.DataFrame({"grid_id": pdf.grid_id.iloc[0], "i": -1, "j": -1, "cid": -1, "w": np.nan, "shed": -1, "rim": False, "sink": False, "a": name[x], "b": name[y], "level": list(spill.values())})
        return pd.concat([rows, edges], ignore_index=True) if len(edges) else rows

    kinds = "grid_id string, i int, j int, cid long, w double, shed long, rim boolean, sink boolean, a long, b long, level double"
    tiles = durable(tiled.groupBy("grid_id", "ti", "tj").applyInPandas(flood, kinds))
    rows = tiles.where("a < 0")
    # across tiles: neighbouring rim cells spill at the higher of the two
    rims = rows.where("rim").select("grid_id", "i", "j", "cid", "w", "shed")
    offsets = F.array(*(F.struct(F.lit(d.di).alias("di"), F.lit(d.dj).alias("dj")) for d in D8.neighbours() if (d.di, d.dj) > (0, 0)))
    sent = rims.select("grid_id", F.explode(offsets).alias("d"), "i", "j", F.col("w").alias("w1"), F.col("shed").alias("a")).select("grid_id", (F.col("i") + F.col("d.di")).alias("i"), (F.col("j") + F.col("d.dj")).alias("j"), "w1", "a")
    across = sent.join(rims.select("grid_id", "i", "j", F.col("w").alias("w2"), F.col("shed").alias("b")), ["grid_id", "i", "j"]).where("a <> b").select("grid_id", "a", "b", F.greatest("w1", "w2").alias("level"))
    outlets = rows.where("sink").select("grid_id", F.col("shed").alias("a"), F.lit(-2).cast("long").alias("b"), F.col("w").alias("level"))
    graph = tiles.where("a >= 0").select("grid_id", "a", "b", "level").unionByName(across).groupBy("grid_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("level").alias("level")).unionByName(outlets)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        links: dict[int, list[tuple[int, float]]] = {}
        heap = []
        for a, b, h in zip(pdf.a.tolist(), pdf.b.tolist(), pdf.level.tolist()):
            if b == -2:
                heap.append((h, a))
            else:
                links.setdefault(a, []).append((b, h))
                links.setdefault(b, []).append((a, h))
        heapq.heapify(heap)
        best: dict[int, float] = {}
        while heap:
            h, a = heapq.heappop(heap)
            if a in best:
                continue
            best[a] = h
            for b, e in links.get(a, ()):
                if b not in best:
                    heapq.heappush(heap, (max(h, e), b))
        return pd.DataFrame({"grid_id": pdf.grid_id.iloc[0], "shed": list(best), "lift": list(best.values())})

    lifts = graph.groupBy("grid_id").applyInPandas(solve, "grid_id string, shed long, lift double")
    lifted = rows.join(lifts, ["grid_id", "shed"], "left").select("grid_id", "cid", F.greatest("w", "lift").alias("_w"))
    kind = cells.schema["z"].dataType
    return cells.join(lifted, ["grid_id", "cid"], "left").withColumn("z", F.when(F.col("valid"), F.col("_w").cast(kind)).otherwise(F.col("z"))).select(*cells.columns)


def fill_small_depressions(cells: DataFrame, max_fill_size: int, tile: int = 256) -> DataFrame:
    """Fill depressions, but a raised area of more than ``max_fill_size`` cells keeps a sink at its lowest cell.

    The lowest cell (ties by row, then column) of each large area joins the sinks of a second
    flood, whose result replaces the first in the large areas alone.
    """
    first = durable(fill_depressions(cells, tile))
    both = cells.join(first.select("grid_id", "cid", F.col("z").alias("z1")), ["grid_id", "cid"])
    comps = durable(component_of(with_ids(both), F.col("valid") & (F.col("z1") > F.col("z"))))
    large = comps.groupBy("grid_id", "comp").agg(F.count("*").alias("n")).where(F.col("n") > max_fill_size).select("grid_id", "comp")
    wet = durable(comps.join(large, ["grid_id", "comp"], "left_semi").join(cells.select("grid_id", "cid", "z"), ["grid_id", "cid"]))
    lows = wet.groupBy("grid_id", "comp").agg(F.min(F.struct("z", "i", "j", "cid")).alias("m")).select("grid_id", F.col("m.cid").alias("cid"))
    second = fill_depressions(cells, tile, lows)
    replace = second.join(wet.select("grid_id", "cid"), ["grid_id", "cid"], "left_semi").select("grid_id", "cid", F.col("z").alias("z2"))
    return first.join(replace, ["grid_id", "cid"], "left").withColumn("z", F.coalesce("z2", "z")).select(*cells.columns)


def flowdir(cells: DataFrame, fill_depression: bool = False, resolve_flat: bool = True, step_size: int = 4, scheme: D8Directions = D8) -> DataFrame:
    """Facade: optional filling, then complete or simple D8."""
    work = fill_depressions(cells) if fill_depression else cells
    return complete_d8(work, step_size, scheme) if resolve_flat else simple_d8(work, scheme).withColumn("label", F.lit(None).cast("int")).withColumn("z_syn", F.lit(None).cast("long"))


__all__ = ["acyclic", "complete_d8", "fill_depressions", "fill_small_depressions", "flat_edges", "flat_gradients", "flat_labels", "flow_from_codes", "flowdir", "indegree", "layers", "numbered", "simple_d8", "synthetic_d8", "tiled_flats"]
