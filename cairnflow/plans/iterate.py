"""Iterative plans: durable cuts, pointer doubling over forests, connected components.

All loops run on the driver over lazy plans and cut their lineage in the folder of
spark.checkpoint.dir after each round; no data passes through the driver but counts.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share; a temporary one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cairnflow-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint, so that a lost executor costs a reread and no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tiles of 2**TILE_BITS rows and columns are solved by a kernel call each; what crosses them, by one task a grid up to
#: ALONE links and by rounds beyond. Tables of up to SMALL rows are broadcast.
TILE_BITS, ALONE, SMALL = 9, 1_000_000, 100_000


def _side(c: str) -> tuple[Column, Column]:
    """Row and column of the tile of a cell id."""
    return F.shiftright(F.col(c).bitwiseAND(F.lit((1 << 31) - 1)), TILE_BITS), F.shiftright(c, 31 + TILE_BITS)


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL else df


def _np(t: pa.Table, name: str) -> np.ndarray:
    return pc.fill_null(t.column(name), 0).to_numpy()


def _ways(cid: np.ndarray, ds: np.ndarray, has: np.ndarray, hops: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over nodes sorted by id: the next one's position (its own at ends), the last one's (-1 for a way into a cycle), hops and length to it, and the nodes on cycles.

    A node whose target isn't among the nodes is an end. ``hops`` and ``dist`` are those of the step.
    """
    n = len(cid)
    at = np.minimum(np.searchsorted(cid, ds), max(n - 1, 0))
    inside = has & (cid[at] == ds)
    step = np.where(inside, at, np.arange(n))
    to, h, d = step.copy(), np.where(inside, hops, 0), np.where(inside, dist, 0.0)
    live = np.flatnonzero(inside)
    live = live[inside[to[live]]]
    for _ in range(n.bit_length() + 1):
        if not len(live):
            break
        t = to[live]
        h[live], d[live], to[live] = h[live] + h[t], d[live] + d[t], to[t]
        live = live[inside[to[live]]]
    ring = np.unique(to[live])  # 2**rounds steps lead from any node that never ends onto its cycle
    to[live] = -1
    return step, to, h, d, ring


def _lifts(step: np.ndarray, hops: np.ndarray) -> list[np.ndarray]:
    """Tables of the 2**n-th nodes ahead, ends being their own."""
    lifts = [step]
    while 2 ** len(lifts) <= hops.max(initial=0):
        lifts.append(lifts[-1][lifts[-1]])
    return lifts


def lifted(lifts: list[np.ndarray], at: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The nodes ``by`` steps ahead."""
    for n, far in enumerate(lifts):
        at = np.where(by >> n & 1, far[at], at)
    return at


def meeting(lifts: list[np.ndarray], hops: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The first common node of the ways from u and v, which have one end."""
    u, v = lifted(lifts, u, np.maximum(hops[u] - hops[v], 0)), lifted(lifts, v, np.maximum(hops[v] - hops[u], 0))
    for far in reversed(lifts):
        a, b = far[u], far[v]
        u, v = np.where(a != b, a, u), np.where(a != b, b, v)
    return np.where(u == v, u, lifts[0][u])


def _local(tree: DataFrame, k: list[str], step: Column, more=None, kinds_more: str = "") -> tuple[DataFrame, DataFrame, int]:
    """(every node's way within its tile, the links between tiles, their number).

    The first: key, cid, exit (the way's last node in the tile, null for a cycle), hops, dist, ring (lies on a cycle in the
    tile) and, at exits that lead on, ds and step. The second: key, cid (an exit), ds, to (the exit of the tile it leads
    to; null if it has none), hops and dist from exit to exit. ``more`` may add columns, of ``kinds_more``, to the first.
    """
    kinds = ", ".join(f"`{c}` {tree.schema[c].dataType.simpleString()}" for c in k)

    def run(t: pa.Table) -> pa.Table:
        t = t.select([*k, "cid", "ds", "step"]).sort_by("cid")
        cid, has = t.column("cid").to_numpy(), t.column("ds").is_valid().to_numpy()
        next_, end, hops, dist, on = _ways(cid, _np(t, "ds"), has, np.ones(len(cid), np.int64), _np(t, "step"))
        ring = np.zeros(len(cid), bool)
        ring[on] = True
        extra = more(cid, next_, end, hops, dist, has) if more else {}
        inner = ~has | (end != np.arange(len(cid)))
        added = {"exit": pa.array(cid[end], mask=end < 0), "hops": pa.array(hops), "dist": pa.array(dist), "ring": pa.array(ring), "ds": pa.array(_np(t, "ds"), mask=inner), "step": pa.array(_np(t, "step"), mask=inner)}
        t = t.select([*k, "cid"])
        for name, column in (added | extra).items():
            t = t.append_column(name, column)
        return t

    nodes = tree.select(*k, "cid", "ds", F.when(F.col("ds").isNotNull(), step).cast("double").alias("step"))
    local = durable(nodes.groupBy(*k, *_side("cid")).applyInArrow(run, f"{kinds}, cid long, exit long, hops long, dist double, ring boolean, ds long, step double{kinds_more}"))
    leaving = durable(local.where("ds is not null").select(*k, "cid", "ds", "step"))
    n = leaving.count()
    there = local.select(*k, F.col("cid").alias("ds"), F.col("exit").alias("to"), "hops", F.col("dist").alias("far"))
    found = there.join(_few(leaving, n), [*k, "ds"]).select(*k, "cid", "to", (F.col("hops") + 1).alias("hops"), (F.col("step") + F.col("far")).alias("dist"))
    links = durable(leaving.select(*k, "cid", "ds").join(found, [*k, "cid"], "left"))
    return local, links, n


def _solve(links: DataFrame, k: list[str], n: int, max_rounds: int) -> DataFrame:
    """(key, cid, root, hops, dist, ring) of links between tiles; root is null for ways into a cycle, and ring marks the links on one."""
    kinds = ", ".join(f"`{c}` {links.schema[c].dataType.simpleString()}" for c in k)
    if n <= ALONE:

        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by("cid")
            cid, to, has = t.column("cid").to_numpy(), _np(t, "to"), t.column("to").is_valid().to_numpy()
            own_h, own_d = _np(t, "hops"), _np(t, "dist")
            _, end, hops, dist, on = _ways(cid, to, has, own_h, own_d)
            ring = np.zeros(len(cid), bool)
            ring[on] = True
            # the last link leads out of the links: to a root, or into a cycle of a tile
            lost = (end < 0) | ~has[end]
            out = t.select([*k, "cid"])
            for name, column in (("root", pa.array(to[end], mask=lost)), ("hops", pa.array(hops + own_h[end])), ("dist", pa.array(dist + own_d[end])), ("ring", pa.array(ring))):
                out = out.append_column(name, column)
            return out

        return durable(links.groupBy(*k).applyInArrow(run, f"{kinds}, cid long, root long, hops long, dist double, ring boolean"))
    now = links.select(*k, "cid", "to", "hops", "dist", F.lit(None).cast("long").alias("root"))
    rounds = 0
    while 2**rounds <= 2 * n and rounds < max_rounds:
        up = now.select(*k, F.col("cid").alias("to"), F.lit(True).alias("hit"), F.col("to").alias("n_to"), F.col("hops").alias("n_hops"), F.col("dist").alias("n_dist"), F.col("root").alias("n_root"))
        open_ = now.where("root is null and to is not null").join(up, [*k, "to"], "left")
        on = F.col("hit").isNotNull()
        moved = open_.select(*k, "cid", F.when(on, F.col("n_to")).otherwise(F.col("to")).alias("to"), (F.col("hops") + F.coalesce("n_hops", F.lit(0))).alias("hops"), (F.col("dist") + F.coalesce("n_dist", F.lit(0.0))).alias("dist"), F.when(on, F.col("n_root")).otherwise(F.col("to")).alias("root"))
        now = durable(now.where("root is not null or to is null").unionByName(moved).coalesce(64))
        rounds += 1
        if now.where("root is null and to is not null").isEmpty():
            break
    ring = now.where("root is null and to is not null").select(*k, F.col("to").alias("cid"), F.lit(True).alias("ring")).distinct()
    return durable(now.drop("to").join(ring, [*k, "cid"], "left").withColumn("ring", F.coalesce("ring", F.lit(False))))


def descend(tree: DataFrame, key: Sequence[str], step: Column, max_rounds: int = 40) -> DataFrame:
    """Root, hops and path length of every node of a forest.

    ``tree`` has ``key`` columns, ``cid`` and ``ds`` (the parent's cid, null at roots). Adds
    ``root``, ``hops`` and ``dist`` (sum of ``step`` along the way). Nodes that never reach a
    root, which are those that lead into a cycle, get null root and hops. Ways are followed inside
    tiles first; only the exits of tiles take part in what is left.
    """
    k = list(key)
    local, links, n = _local(tree, k, step)
    solved = _solve(links, k, n, max_rounds).select(*k, F.col("cid").alias("exit"), F.lit(True).alias("far"), F.col("root").alias("r"), F.col("hops").alias("h"), F.col("dist").alias("d"))
    met = local.drop("ds", "step", "ring").join(_few(solved, n), [*k, "exit"], "left").withColumn("root", F.when(F.col("far"), F.col("r")).otherwise(F.col("exit")))
    on = F.col("root").isNotNull()
    return met.select(*k, "cid", "root", F.when(on, F.col("hops") + F.coalesce("h", F.lit(0))).alias("hops"), F.when(on, F.col("dist") + F.coalesce("d", F.lit(0.0))).alias("dist"))


def on_cycles(tree: DataFrame, key: Sequence[str], max_rounds: int = 40) -> DataFrame:
    """(key, cid) of the nodes that lie on a cycle: inside tiles, and where exits of tiles form one, the ways between them."""
    k = list(key)
    tree = durable(tree.select(*k, "cid", "ds"))
    local, links, n = _local(tree, k, F.lit(1.0))
    inner = local.where("ring").select(*k, "cid")
    exits = _solve(links, k, n, max_rounds).where("ring").select(*k, "cid")
    seeds = durable(links.join(exits, [*k, "cid"], "left_semi").select(*k, F.col("ds").alias("cid"), F.lit(1).alias("seed")).distinct())
    if seeds.isEmpty():
        return inner
    seeded = tree.join(_few(seeds, n), [*k, "cid"], "left").withColumn("seed", F.coalesce("seed", F.lit(0)))
    return inner.union(_within(seeded, k, {"seed": "max"}, loops=True).where("seed = 1").select(*k, "cid"))


def _ranks(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each value's rank (-1 for null) and the positions in order; structs go by their fields."""
    fields = column.flatten() if pa.types.is_struct(column.type) else [column]
    some = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    order = some[np.lexsort([pc.fill_null(f, 0).to_numpy(zero_copy_only=False)[some] for f in reversed(fields)])]
    rank = np.full(len(column), -1)
    rank[order] = np.arange(len(order))
    return rank, order


def _gathered(t: pa.Table, to: str, values: dict[str, str], loops: bool = False) -> tuple[dict[str, pa.Array], np.ndarray, np.ndarray] | None:
    """Of a table sorted by cid: the aggregates over each node and those above it, the position of each one's last node, and whether it has a target; None if there is a cycle."""
    cid, has = t.column("cid").to_numpy(), t.column(to).is_valid().to_numpy()
    one = np.ones(len(cid), np.int64)
    step, end, hops, _, _ = _ways(cid, _np(t, to), has, one, one)
    if (end < 0).any():
        if not loops:
            return None
        hops = np.where(end < 0, 0, hops)
    order = np.argsort(-hops, kind="stable")
    ends = np.cumsum(np.bincount(hops)[::-1])  # nodes of the greatest depth come first
    parts = [order[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends)][:-1]
    out = {}
    for name, f in values.items():
        column = t.column(name).combine_chunks()
        if f == "sum":
            got = pc.fill_null(column, 0).to_numpy(zero_copy_only=False).copy()
            for p in parts:
                np.add.at(got, step[p], got[p])
            out[name] = pa.array(got, column.type)
        else:
            got, order_ = _ranks(column)
            for p in parts:
                np.maximum.at(got, step[p], got[p])
            out[name] = column.take(pa.array(order_[got] if len(order_) else got, mask=got < 0))
    return out, end, has


def _within(tree: DataFrame, k: list[str], values: dict[str, str], loops: bool = False) -> DataFrame:
    """(key, cid, values) with the aggregates over the nodes above each node in its tile; ``loops`` leaves out what leads into cycles."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("cid")
        got = _gathered(t, "ds", values, loops)
        if got is None:
            raise ValueError("the flow field has a cycle")
        out = t.select([*k, "cid"])
        for name, column in got[0].items():
            out = out.append_column(name, column)
        return out

    work = tree.select(*k, "cid", "ds", *values)
    kinds = ", ".join(f"`{c}` {work.schema[c].dataType.simpleString()}" for c in (*k, "cid", *values))
    return work.groupBy(*k, *_side("cid")).applyInArrow(run, kinds)


def gather_upstream(tree: DataFrame, key: Sequence[str], values: dict[str, str], max_rounds: int = 40) -> DataFrame:
    """For every node of a forest, aggregates over itself and all nodes above it.

    ``values`` maps a column of ``tree`` to 'sum' or 'max'. Each tile gives the aggregates at the nodes where ways leave
    it; these form a small forest, whose aggregates then enter the tiles again.
    """
    k, agg = list(key), {"sum": F.sum, "max": F.max}
    now = durable(tree.select(*k, "cid", "ds", *values))
    apart = F.lit(False)
    for a, b in zip(_side("cid"), _side("ds")):
        apart = apart | (a != b)
    leaving = durable(now.where(F.col("ds").isNotNull() & apart).select(*k, F.col("ds").alias("cid"), F.lit(True).alias("entry")))
    n = leaving.count()
    marked = now.join(_few(leaving.distinct(), n), [*k, "cid"], "left")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("cid")
        got = _gathered(t, "ds", values)
        if got is None:
            out = t.slice(0, 1).select([*k, "cid"]).append_column("to", pa.array([None], pa.int64())).append_column("kind", pa.array([2], pa.int32()))
            for name in values:
                out = out.append_column(name, t.column(name).slice(0, 1))
            return out
        up, end, has = got
        cid = t.column("cid").to_numpy()
        rows = [np.flatnonzero(has & (end == np.arange(len(cid)))), np.flatnonzero(t.column("entry").is_valid().to_numpy())]
        to = np.r_[_np(t, "ds")[rows[0]], cid[end[rows[1]]]]
        both = pa.array(np.concatenate(rows))
        out = t.select([*k, "cid"]).take(both).append_column("to", pa.array(to)).append_column("kind", pa.array(np.repeat([0, 1], [len(r) for r in rows]).astype(np.int32)))
        for name, column in up.items():
            out = out.append_column(name, column.take(both))
        return out

    shown = lambda columns: ", ".join(f"`{c}` {now.schema[c].dataType.simpleString()}" for c in columns)
    part = durable(marked.groupBy(*k, *_side("cid")).applyInArrow(run, f"{shown([*k, 'cid'])}, to long, kind int, {shown(values)}"))
    if not part.where("kind = 2").isEmpty():
        raise ValueError("the flow field has a cycle")
    if not n:
        return _within(now, k, values)
    ways = part.where("kind = 1").select(*k, F.col("cid").alias("at"), F.col("to").alias("ds"))
    links = durable(part.where("kind = 0").select(*k, "cid", F.col("to").alias("at"), *values).join(ways, [*k, "at"], "left"))
    if n <= ALONE:

        def solve(t: pa.Table) -> pa.Table:
            t = t.sort_by("cid")
            got = _gathered(t, "ds", values)
            if got is None:
                raise ValueError("the flow field has a cycle")
            out = t.select([*k, "at"])
            for name, column in got[0].items():
                out = out.append_column(name, column)
            return out

        solved = links.groupBy(*k).applyInArrow(solve, f"{shown(k)}, at long, {shown(values)}")
    else:
        solved = links.select(*k, "cid", "at").join(_gather_rounds(links, k, values, max_rounds), [*k, "cid"])
    entering = durable(solved.groupBy(*k, F.col("at").alias("cid")).agg(*(agg[f](c).alias(f"in_{c}") for c, f in values.items())))
    merged = [(F.col(c) + F.coalesce(F.col(f"in_{c}"), F.lit(0)) if f == "sum" else F.greatest(c, f"in_{c}")).cast(now.schema[c].dataType).alias(c) for c, f in values.items()]
    return _within(now.join(_few(entering, n), [*k, "cid"], "left").select(*k, "cid", "ds", *merged), k, values)


def _gather_rounds(tree: DataFrame, k: list[str], values: dict[str, str], max_rounds: int) -> DataFrame:
    """The aggregates by rounds of joins. After round r each node holds those over the nodes fewer than 2**r hops above it."""
    agg = {"sum": F.sum, "max": F.max}
    now = durable(tree.select(*k, "cid", F.col("ds").alias("to"), *values))
    for _ in range(max_rounds):
        live = now.where("to is not null")
        if live.isEmpty():
            break
        sent = live.groupBy(*k, F.col("to").alias("cid")).agg(*(agg[f](c).alias(f"in_{c}") for c, f in values.items()))
        jump = now.select(*k, F.col("cid").alias("to"), F.col("to").alias("n_to"))
        merged = [(F.col(c) + F.coalesce(F.col(f"in_{c}"), F.lit(0)) if f == "sum" else F.greatest(c, f"in_{c}")).alias(c) for c, f in values.items()]
        now = durable(now.join(sent, [*k, "cid"], "left").select(*k, "cid", "to", *merged).join(jump, [*k, "to"], "left").select(*k, "cid", F.col("n_to").alias("to"), *values))
    else:
        raise ValueError("the flow field has a cycle")
    return now.select(*k, "cid", *values)


def ranked(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: the row's number from 1 in ``order`` within ``key``. Ranges are numbered apart and moved by the rows before them."""
    k = list(key)
    placed = durable(df.repartitionByRange(*k, *order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy(*k, "_part").agg(F.count("*").alias("_n"))
    before = counts.select(*k, "_part", F.coalesce(F.sum("_n").over(W.partitionBy(*k).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = F.row_number().over(W.partitionBy("_part", *k).orderBy(*order))
    return placed.join(before, [*k, "_part"]).select(*df.columns, (F.col("_before") + at).cast("int").alias(name))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of a link (u, v); component is its smallest reachable node.

    Alternating large-star and small-star steps (Kiveris et al. 2014): grouped minima and
    joins. Self-links and nulls are ignored.
    """
    edges = durable(links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == tuple(mark) or not mark.n:
            break
        before = tuple(mark)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = durable(small.distinct())
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
