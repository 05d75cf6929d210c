"""Neighbour access over cells.

3 x 3 neighbourhoods come from two windows: ``lag``/``lead`` along the row, then along the
column over the row's triples, within blocks of 2**BLOCK_BITS rows and columns and a rim of one cell around. That is one
shuffle of the cells and no join; a partition holds one block. Other windows push each value to its neighbours and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .directions import D8, D8Directions, Direction
from .grid import at


def neighbour(d: Direction) -> Column:
    """The struct that ``neighbourhood`` adds for the cell at the direction's offset, whatever the scheme's order."""
    return F.col(f"nb_{d.di + 1}{d.dj + 1}")


BLOCK_BITS = 7


def neighbourhood(cells: DataFrame, values: Sequence[str]) -> DataFrame:
    """Add a struct of ``values`` (and i, j, cid) for each 3 x 3 neighbour, null outside the raster: see ``neighbour``."""
    me = F.struct("i", "j", "cid", *values)
    blocks = lambda c: F.explode(F.sequence(F.shiftright(F.greatest(F.col(c) - 1, F.lit(0)), BLOCK_BITS), F.shiftright(F.col(c) + 1, BLOCK_BITS)))
    block = ["grid_id", "_bi", "_bj"]
    rimmed = cells.select("*", blocks("i").alias("_bi")).select("*", blocks("j").alias("_bj")).repartition(*block)
    row = W.partitionBy(*block, "i").orderBy("j")
    side = lambda f, step: F.when(f("j").over(row) == F.col("j") + step, f(me).over(row))
    triple = rimmed.withColumn("_w", side(F.lag, -1)).withColumn("_e", side(F.lead, 1)).withColumn("_me", me)
    line = W.partitionBy(*block, "j").orderBy("i")
    all3 = F.struct("_w", "_me", "_e", "i")
    pick = lambda f, step: F.when(f("i").over(line) == F.col("i") + step, f(all3).over(line))
    both = triple.withColumn("_up", pick(F.lag, -1)).withColumn("_down", pick(F.lead, 1))
    own = both.where((F.shiftright("i", BLOCK_BITS) == F.col("_bi")) & (F.shiftright("j", BLOCK_BITS) == F.col("_bj")))
    of = {-1: "_w", 0: "_me", 1: "_e"}
    source = lambda d: F.col(of[d.dj]) if d.di == 0 else F.col("_up" if d.di < 0 else "_down")[of[d.dj]]
    # a diagonal needs its row neighbour's row, which a hole in the row hides: triples exist for present cells only
    return own.select(*cells.columns, *(source(d).alias(f"nb_{d.di + 1}{d.dj + 1}") for d in D8.neighbours()))


def lowest(z: Column, usable: Column, field: str = "z", ok: str = "valid", scheme: D8Directions = D8, same: tuple[str, Column] | None = None) -> Column:
    """Struct (z, ord, code, cid) of the lowest of the cell itself and its usable neighbours.

    The cell has ord 0, so it wins ties: a code other than no-flow means strictly lower.
    """
    own = F.struct(z.alias("z"), F.lit(0).alias("ord"), F.lit(scheme.no_flow_code).cast("smallint").alias("code"), F.lit(None).cast("long").alias("cid"))
    found = [own]
    for d in scheme.neighbours():
        n = neighbour(d)
        good = n[ok] if same is None else n[ok] & (n[same[0]] == same[1])
        found.append(F.when(good, F.struct(n[field].alias("z"), F.lit(d.ord).alias("ord"), F.lit(d.code).cast("smallint").alias("code"), n["cid"].alias("cid"))))
    return F.when(usable, F.least(*found))


def with_lowest(cells: DataFrame, field: str, usable: Column, scheme: D8Directions = D8, same: str | None = None) -> DataFrame:
    """Add ``_b``: as ``lowest`` of ``field`` over valid neighbours (with an equal ``same``), for a window of any size.

    Wider windows than 3 x 3 can't be read off two windows of lines: their cells send values.
    """
    more = [same] if same else []
    if scheme.window == 3:
        near = neighbourhood(cells, [field, "valid", *more])
        return near.withColumn("_b", lowest(F.col(field), usable, field, "valid", scheme, (same, F.col(same)) if same else None)).select(*cells.columns, "_b")
    sent = push(cells.where("valid"), scheme, [field, "cid", *more]).withColumnRenamed("cid", "_cid")
    if same:
        own = cells.select("grid_id", "i", "j", F.col(same).alias("_own"))
        sent = sent.join(own, ["grid_id", "i", "j"]).where(F.col(same) == F.col("_own"))
    best = sent.groupBy("grid_id", "i", "j").agg(F.min(F.struct(F.col(field).alias("z"), "ord", "code", F.col("_cid").alias("cid"))).alias("_b"))
    lower = F.when(usable & (F.col("_b.z") < F.col(field)), F.col("_b"))
    return cells.join(best, ["grid_id", "i", "j"], "left").select(*cells.columns, lower.alias("_b"))


def any_neighbour(test, dirs: Sequence[Direction] = D8.neighbours()) -> Column:
    """Whether ``test`` of any neighbour struct holds."""
    out = F.lit(False)
    for d in dirs:
        out = out | F.coalesce(test(neighbour(d)), F.lit(False))
    return out


def push(cells: DataFrame, scheme: D8Directions, values: Sequence[str]) -> DataFrame:
    """(target i, j, ord, code and the neighbour's values) for any scheme: each cell sends to its neighbours."""
    offsets = F.array(*(F.struct(F.lit(d.ord).alias("ord"), F.lit(d.di).alias("di"), F.lit(d.dj).alias("dj"), F.lit(d.code).cast("smallint").alias("code")) for d in scheme.neighbours()))
    sent = cells.select("grid_id", "i", "j", *values, F.explode(offsets).alias("d"))
    return sent.select("grid_id", (F.col("i") - F.col("d.di")).alias("i"), (F.col("j") - F.col("d.dj")).alias("j"), F.col("d.ord").alias("ord"), F.col("d.code").alias("code"), *values)


def neighbour_values(cells: DataFrame, scheme: D8Directions = D8, pad: float | None = None, include_self: bool = False, self_at_last: bool = False) -> DataFrame:
    """One row per cell and direction: grid_id, i, j, ord, code, value; outside the raster the pad."""
    got = push(cells, scheme, ["z"]).withColumnRenamed("z", "value")
    slots = F.array(*(F.struct(F.lit(d.ord).alias("ord"), F.lit(d.code).cast("smallint").alias("code")) for d in scheme.neighbours()))
    frame = cells.select("grid_id", "i", "j", F.explode(slots).alias("s")).select("grid_id", "i", "j", "s.ord", "s.code")
    out = frame.join(got.drop("code"), ["grid_id", "i", "j", "ord"], "left").withColumn("value", F.coalesce("value", F.lit(pad).cast("double")))
    if include_self:
        last = len(scheme.neighbours()) + 1
        own = cells.select("grid_id", "i", "j", F.lit(last if self_at_last else 0).alias("ord"), F.lit(scheme.no_flow_code).cast("smallint").alias("code"), F.col("z").alias("value"))
        out = out.unionByName(own)
    return out


def downstream(flow: DataFrame, scheme: D8Directions = D8) -> DataFrame:
    """Add dsi, dsj, ds_cid and inbounds for a flow table (i, j, code, valid); -1 where invalid."""
    from .grid import shapes

    shape = shapes(flow)
    out = flow.join(F.broadcast(shape), "grid_id")
    di, dj = scheme.di_of(F.col("code")), scheme.dj_of(F.col("code"))
    out = out.withColumn("dsi", F.when(F.col("valid"), F.col("i") + di).otherwise(-1)).withColumn("dsj", F.when(F.col("valid"), F.col("j") + dj).otherwise(-1))
    inside = F.when(F.col("valid"), F.col("dsi").between(0, F.col("nrows") - 1) & F.col("dsj").between(0, F.col("ncols") - 1)).otherwise(True)
    out = out.withColumn("inbounds", inside)
    flat = F.when(~F.col("valid"), -1).otherwise(F.col("dsj").cast("long") * F.col("nrows") + F.col("dsi"))
    return out.withColumn("flat", flat).withColumn("ds_cid", F.when(F.col("valid") & F.col("inbounds"), at(F.col("dsi"), F.col("dsj"))))


def check_inbounds(flow: DataFrame, scheme: D8Directions = D8) -> None:
    """Raise if a valid cell flows off the raster; names up to ten."""
    bad = downstream(flow, scheme).where("not inbounds").select("grid_id", "i", "j").limit(10).collect()
    if bad:
        raise ValueError(f"cells flow off the raster: {[tuple(r) for r in bad]}")
