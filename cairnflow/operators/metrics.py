"""Flow-tree metrics: accumulation, watersheds, distances, Strahler order.

Input is a flow table (grid_id, i, j, cid, valid, ds; ds is the target's cid or null). All
are pointer doubling: as many rounds of joins as the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import descend, durable, gather_upstream, ranked
from ..plans.streams import orders, source_ways

KEY = ["grid_id"]


def step_length(flow: DataFrame, coordinates: bool = False) -> DataFrame:
    """Add ``step``: the length of each cell's flow edge, by index or by x and y."""
    a, b = ("x", "y") if coordinates else ("j", "i")
    if not coordinates:
        # ids hold the indices, so no join is needed
        di = F.col("ds").bitwiseAND(F.lit((1 << 31) - 1)) - F.col("i")
        dj = F.shiftright("ds", 31) - F.col("j")
        return flow.withColumn("step", F.when(F.col("ds").isNotNull(), F.sqrt((di * di + dj * dj).cast("double"))))
    target = flow.select("grid_id", F.col("cid").alias("ds"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    out = flow.join(target, ["grid_id", "ds"], "left")
    d = F.sqrt((F.col("_a") - F.col(a)) ** 2 + (F.col("_b") - F.col(b)) ** 2)
    return out.withColumn("step", F.when(F.col("ds").isNotNull(), d)).drop("_a", "_b")


def l1_step(flow: DataFrame) -> DataFrame:
    """Add ``step`` as the sum of absolute index differences."""
    di = F.col("ds").bitwiseAND(F.lit((1 << 31) - 1)) - F.col("i")
    dj = F.shiftright("ds", 31) - F.col("j")
    return flow.withColumn("step", (F.abs(di) + F.abs(dj)).cast("double"))


def _places() -> list[Column]:
    """i and j of a cell id."""
    return [F.col("cid").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("i"), F.shiftright("cid", 31).cast("int").alias("j")]


def accumulation(flow: DataFrame, weight: Column | None = None) -> DataFrame:
    """grid_id, i, j, cid, accum: the weights of all cells that drain through each, itself included; null on invalid cells."""
    w = F.coalesce(weight.cast("double") if weight is not None else F.lit(1.0), F.lit(0.0))
    got = gather_upstream(flow.where("valid").withColumn("accum", w), KEY, {"accum": "sum"})
    return flow.select("grid_id", "i", "j", "cid").join(got, ["grid_id", "cid"], "left").select("grid_id", "i", "j", "cid", "accum")


def _sinks(flow: DataFrame) -> Column:
    """A true sink has the no-flow code; a cell whose target is off-grid or invalid isn't one."""
    return F.col("is_sink") if "is_sink" in flow.columns else F.col("valid") & F.col("ds").isNull()


def watersheds(flow: DataFrame) -> DataFrame:
    """grid_id, i, j, label: the rank of the cell's sink, column by column; 0 where no sink is reached."""
    roots = descend(flow.where("valid"), KEY, F.lit(1.0)).select("grid_id", "cid", "root")
    sinks = flow.where(_sinks(flow)).select("grid_id", F.col("cid").alias("root"))
    ranks = ranked(sinks, KEY, ["root"], "label")
    got = roots.join(ranks, ["grid_id", "root"], "left").select("grid_id", "cid", "label")
    return flow.select("grid_id", "i", "j", "cid").join(got, ["grid_id", "cid"], "left").select("grid_id", "i", "j", "cid", F.coalesce("label", F.lit(0)).alias("label"))


def tree(flow: DataFrame, coordinates: bool = False) -> DataFrame:
    """grid_id, cid, root, hops, dist of the valid cells, down to the last cell of each path."""
    stepped = step_length(flow.where("valid"), coordinates)
    return descend(stepped, KEY, F.col("step"))


def dist2sink(flow: DataFrame, coordinates: bool = False) -> DataFrame:
    """grid_id, i, j, dist: length of the way to the sink; -1 where none is reached or the cell is invalid."""
    sinks = flow.where(_sinks(flow)).select("grid_id", F.col("cid").alias("root"), F.lit(True).alias("ok"))
    got = tree(flow, coordinates).join(sinks, ["grid_id", "root"]).select("grid_id", "cid", "dist")
    return flow.select("grid_id", "i", "j", "cid").join(got, ["grid_id", "cid"], "left").select("grid_id", "i", "j", "cid", F.coalesce("dist", F.lit(-1.0)).alias("dist"))


def dist2source(flow: DataFrame, coordinates: bool = False, l1: bool = False) -> DataFrame:
    """grid_id, i, j, dist: length of the upstream way with most steps, ties by the larger source id; 0 on sources, null on invalid cells.

    Steps from a source to a cell are the difference of their depths, so the best source is
    the greatest (depth, id) in the cell's subtree: an upstream maximum. Tiles settle it in two passes; gatherings of
    depths do it where too much lies between tiles.
    """
    valid = flow.where("valid")
    lengths = l1_step(flow) if l1 else step_length(flow, coordinates)
    got = source_ways(lengths)
    if got is not None:
        return got.select("grid_id", *_places(), "cid", "dist")
    fed = valid.where("ds is not null").select("grid_id", F.col("ds").alias("cid")).distinct().withColumn("fed", F.lit(True))
    stepped = l1_step(valid) if l1 else step_length(valid, coordinates)
    depths = durable(descend(stepped, KEY, F.col("step")))
    base = valid.select("grid_id", "cid", "ds").join(depths, ["grid_id", "cid"]).join(fed, ["grid_id", "cid"], "left")
    best = base.withColumn("best", F.when(F.col("fed").isNull(), F.struct(F.col("hops").alias("h"), F.col("cid").alias("c"), F.col("dist").alias("d"))))
    got = gather_upstream(best, KEY, {"best": "max"}).join(depths, ["grid_id", "cid"]).select("grid_id", "cid", (F.col("best.d") - F.col("dist")).alias("dist"))
    return flow.select("grid_id", "i", "j", "cid").join(got, ["grid_id", "cid"], "left").select("grid_id", "i", "j", "cid", "dist")


def strahler(flow: DataFrame) -> DataFrame:
    """grid_id, i, j, ord: Strahler stream order; 0 on invalid cells and where a cycle flows in.

    A cell has order k + 1 or more exactly if it is, or lies below, a cell with two
    tributaries of order k or more. So each order is one grouped count and one upstream
    gathering over the cells of the order before, which get fewer by a factor each time. That is the way where too much
    lies between tiles for one task; else tiles settle the orders in two passes.
    """
    got = orders(flow)
    if got is not None:
        return got.select("grid_id", *_places(), "cid", "ord")
    valid = flow.where("valid").select("grid_id", "cid", "ds")
    ends = descend(valid, KEY, F.lit(1.0))
    now = durable(valid.join(ends.where("root is not null").select("grid_id", "cid"), ["grid_id", "cid"], "left_semi"))
    found = now.select("grid_id", "cid", F.lit(1).alias("ord"))
    order = 1
    while True:
        meet = now.where("ds is not null").groupBy("grid_id", F.col("ds").alias("cid")).agg(F.count("*").alias("n")).where("n >= 2").select("grid_id", "cid", F.lit(1).alias("seed"))
        seeded = now.join(meet, ["grid_id", "cid"], "left").withColumn("seed", F.coalesce("seed", F.lit(0)))
        up = gather_upstream(seeded, KEY, {"seed": "max"}).where("seed = 1").select("grid_id", "cid")
        now = durable(now.join(up, ["grid_id", "cid"], "left_semi"))
        order += 1
        if now.isEmpty():
            break
        found = found.unionByName(now.select("grid_id", "cid", F.lit(order).alias("ord")))
    top = found.groupBy("grid_id", "cid").agg(F.max("ord").alias("ord"))
    return flow.select("grid_id", "i", "j", "cid").join(top, ["grid_id", "cid"], "left").select("grid_id", "i", "j", "cid", F.coalesce("ord", F.lit(0)).alias("ord"))


def flood_upstream(flow: DataFrame, seeds: Column) -> DataFrame:
    """grid_id, i, j, wet: cells that drain through a seed cell."""
    marked = flow.where("valid").withColumn("_seed", F.coalesce(seeds, F.lit(False)))
    # cut the tree below each seed: a cell is wet exactly if its path ends at a seed
    cut = durable(marked.select("grid_id", "cid", F.when(~F.col("_seed"), F.col("ds")).alias("ds"), "_seed"))
    ends = descend(cut, KEY, F.lit(1.0)).select("grid_id", "cid", "root")
    seed = cut.where("_seed").select("grid_id", F.col("cid").alias("root"), F.lit(True).alias("wet"))
    got = ends.join(seed, ["grid_id", "root"], "left").select("grid_id", "cid", F.coalesce("wet", F.lit(False)).alias("wet"))
    return flow.select("grid_id", "i", "j", "cid").join(got, ["grid_id", "cid"], "left").select("grid_id", "i", "j", "cid", F.coalesce("wet", F.lit(False)).alias("wet"))
