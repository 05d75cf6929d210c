"""Slope, hillshade, elevation pyramid, isolation and prominence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans.iterate import durable
from .directions import D8
from .grid import shapes
from .prominence import prominence, prominence_features  # noqa: F401
from .stencil import any_neighbour, neighbour, neighbourhood


def _gradient(value: Column, over, step: Column | float | None, position: Column | None) -> Column:
    """numpy-style gradient along a window: central inside, one-sided at the ends, 0 on a line of one cell."""
    prev, nxt = F.lag(value).over(over), F.lead(value).over(over)
    if position is not None:
        a, b = F.lag(position).over(over), F.lead(position).over(over)
        hd, hs = b - position, position - a
        inside = (hs * hs * nxt + (hd * hd - hs * hs) * value - hd * hd * prev) / (hs * hd * (hd + hs))
        return F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull(), (nxt - value) / hd).when(b.isNull(), (value - prev) / hs).otherwise(inside)
    step = F.lit(1.0 if step is None else step)
    return F.when(prev.isNull() & nxt.isNull(), 0.0).when(prev.isNull(), (nxt - value) / step).when(nxt.isNull(), (value - prev) / step).otherwise((nxt - prev) / (2 * step))


def gradients(cells: DataFrame, dx: float | None = None, dy: float | None = None, coordinates: bool = False) -> DataFrame:
    """Add gx (along a row) and gy (along a column); coordinate columns x and y beat the spacings."""
    z = F.col("z").cast("double")
    row, col = W.partitionBy("grid_id", "i").orderBy("j"), W.partitionBy("grid_id", "j").orderBy("i")
    gx = _gradient(z, row, dx, F.col("x") if coordinates else None)
    gy = _gradient(z, col, dy, F.col("y") if coordinates else None)
    return cells.withColumn("gx", gx).withColumn("gy", gy)


def slope(cells: DataFrame, dx: float | None = None, dy: float | None = None, coordinates: bool = False) -> DataFrame:
    """Add ``slope``: length of the gradient, NaN on invalid cells."""
    out = gradients(cells, dx, dy, coordinates)
    return out.withColumn("slope", F.when(F.col("valid"), F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2)).otherwise(F.lit(float("nan")))).drop("gx", "gy")


def hillshade(cells: DataFrame, azimuth: float, altitude: float, method: str = "hard", zfactor: float = 1.0) -> DataFrame:
    """Add ``shade``: cosine between the surface normal and the light, in one of three renderings.

    hard (or clamped) clips to 0 .. 1, half is (1 + c) / 2, soft (or lambert) its square.
    """
    method = {"clamped": "hard", "lambert": "soft"}.get(method.lower(), method.lower())
    if method not in ("hard", "half", "soft"):
        raise ValueError("method is hard (clamped), half or soft (lambert)")
    az, alt = math.radians(180 - azimuth), math.radians(altitude)
    light = (math.cos(az) * math.cos(alt), math.sin(az) * math.cos(alt), math.sin(alt))
    out = gradients(cells.withColumn("z", F.col("z") * zfactor))
    # row axis first: the surface normal is (-dz/di, -dz/dj, 1)
    dot = (-F.col("gy") * light[0] - F.col("gx") * light[1] + light[2]) / F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2 + 1)
    shade = {"hard": F.least(F.greatest(dot, F.lit(0.0)), F.lit(1.0)), "half": (dot + 1) / 2, "soft": ((dot + 1) / 2) * ((dot + 1) / 2)}[method]
    return out.withColumn("shade", shade).withColumn("z", F.col("z") / zfactor).drop("gx", "gy")


def elevation_pyramid(cells: DataFrame, levels: int | None = None) -> DataFrame:
    """(grid_id, level, bi, bj, zmax): maxima over blocks of 2**level cells, each level from the one below."""
    if levels is None:
        size = shapes(cells).agg(F.max(F.greatest("nrows", "ncols")).alias("n")).first().n or 1
        levels = max(0, math.ceil(math.log2(size))) if size > 1 else 0
    now = cells.where("valid").select("grid_id", F.lit(0).alias("level"), F.col("i").alias("bi"), F.col("j").alias("bj"), F.col("z").alias("zmax"))
    out = now
    for level in range(1, levels + 1):
        half = lambda c: F.shiftright(c, 1)
        now = now.groupBy("grid_id", half("bi").alias("bi"), half("bj").alias("bj")).agg(F.max("zmax").alias("zmax")).select("grid_id", F.lit(level).alias("level"), "bi", "bj", "zmax")
        out = out.unionByName(now)
    return out


def isolation(cells: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """grid_id, i, j, iso, ilp_i, ilp_j, censored: distance to the nearest strictly higher valid cell.

    A cell with a higher neighbour needs no search where dx = dy. The rest look in blocks of
    2**level cells: the 3 x 3 blocks around a cell hold every cell within one block's side,
    so a find within it is final; the others go on to the next level, where they are fewer.
    A block takes part only if its maximum is higher.
    """
    known = cells.select("grid_id", "i", "j", "cid", "z", "valid")
    size = shapes(known)
    spans = size.agg(F.max(F.greatest("nrows", "ncols")).alias("n")).first().n or 1
    high = durable(known.where("valid"))
    todo = high.select("grid_id", "i", "j", "cid", "z")
    done = None
    if dx == dy:
        near = neighbourhood(known, ["z", "valid"])
        hits = []
        for d in D8.neighbours():
            n = neighbour(d)
            dist2 = F.lit((d.di * dy) ** 2 + (d.dj * dx) ** 2)
            hits.append(F.when(n["valid"] & (n["z"] > F.col("z")), F.struct(dist2.alias("d2"), n["cid"].alias("cid"), n["i"].alias("i"), n["j"].alias("j"))))
        found = durable(near.where("valid").select("grid_id", "i", "j", "cid", "z", F.least(*hits).alias("hit")))
        done = found.where("hit is not null").select("grid_id", "i", "j", "hit")
        todo = found.where("hit is null").drop("hit")
    level = 2
    while True:
        side = 1 << level
        # only cells above the lowest of those that still look can be found; they get fewer as the looking ones do
        lowest = todo.agg(F.min("z").alias("z")).first().z
        if lowest is not None:
            high = durable(high.where(F.col("z") > lowest))
        block = lambda c: F.shiftright(c, level)  # noqa: B023, E731
        tops = high.groupBy("grid_id", block("i").alias("bi"), block("j").alias("bj")).agg(F.max("z").alias("top"))
        around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
        asked = todo.select("*", F.explode(around).alias("o")).withColumn("bi", block("i") + F.col("o.a")).withColumn("bj", block("j") + F.col("o.b")).drop("o")
        asked = asked.join(tops, ["grid_id", "bi", "bj"]).where("top > z").drop("top")
        cand = high.select("grid_id", block("i").alias("bi"), block("j").alias("bj"), F.col("i").alias("hi"), F.col("j").alias("hj"), F.col("cid").alias("hcid"), F.col("z").alias("hz"))
        d2 = ((F.col("hi") - F.col("i")) * F.lit(dy)) ** 2 + ((F.col("hj") - F.col("j")) * F.lit(dx)) ** 2
        best = asked.join(cand, ["grid_id", "bi", "bj"]).where("hz > z").groupBy("grid_id", "i", "j").agg(F.min(F.struct(d2.alias("d2"), F.col("hcid").alias("cid"), F.col("hi").alias("i"), F.col("hj").alias("j"))).alias("hit"))
        joined = durable(todo.join(best, ["grid_id", "i", "j"], "left"))
        whole = side >= spans
        final = F.col("hit").isNotNull() & (F.lit(whole) | (F.col("hit.d2") <= (side * min(dx, dy)) ** 2))
        got = joined.where(final).select("grid_id", "i", "j", "hit")
        done = got if done is None else done.unionByName(got)
        todo = joined.where(~final if not whole else F.col("hit").isNull()).drop("hit")
        if whole or todo.isEmpty():
            break
        level += 1
    out = known.join(done, ["grid_id", "i", "j"], "left").join(F.broadcast(size), "grid_id")
    iso = F.coalesce(F.sqrt(F.col("hit.d2")), F.lit(0.0))
    edge = F.least((F.least(F.col("i"), F.col("nrows") - 1 - F.col("i")) + 0.5) * dy, (F.least(F.col("j"), F.col("ncols") - 1 - F.col("j")) + 0.5) * dx)
    censored = F.col("valid") & (F.col("hit").isNull() | (edge < iso))
    return out.select("grid_id", "i", "j", iso.alias("iso"), F.coalesce("hit.i", F.lit(-1)).alias("ilp_i"), F.coalesce("hit.j", F.lit(-1)).alias("ilp_j"), censored.alias("censored"))


def float32_merges(cells: DataFrame) -> int:
    """How many distinct elevations coincide in 32 bits (then flats grow)."""
    r = cells.where("valid").agg((F.count_distinct("z") - F.count_distinct(F.col("z").cast("float"))).alias("n")).first()
    return int(r.n or 0)


def fill_pits(cells: DataFrame) -> DataFrame:
    """Raise every cell that is below all its neighbours to the lowest of them; adds ``is_pit``."""
    near = neighbourhood(cells, ["z", "valid"])
    low = F.least(*(F.when(neighbour(d)["valid"], neighbour(d)["z"]) for d in D8.neighbours()), F.lit(None).cast("double"))
    pit = F.col("valid") & F.coalesce(F.col("z") < low, F.lit(False))
    return near.withColumn("is_pit", pit).withColumn("z", F.when(pit, low).otherwise(F.col("z"))).select(*cells.columns, "is_pit")


def find_flat(cells: DataFrame, only_min: bool = True) -> DataFrame:
    """Add ``flat``: the cell equals its lowest neighbour (or, with only_min off, any)."""
    near = neighbourhood(cells, ["z", "valid"])
    equal = any_neighbour(lambda n: n["valid"] & (n["z"] == F.col("z")))
    lower = any_neighbour(lambda n: n["valid"] & (n["z"] < F.col("z")))
    return near.withColumn("flat", F.col("valid") & equal & (~lower if only_min else F.lit(True))).select(*cells.columns, "flat")


def find_ambiguous(cells: DataFrame) -> DataFrame:
    """Add ``ambiguous``: more than one neighbour at the minimum, which is below the cell."""
    near = neighbourhood(cells, ["z", "valid"])
    zs = [F.when(neighbour(d)["valid"], neighbour(d)["z"]) for d in D8.neighbours()]
    low = F.least(*zs)
    at_low = sum((F.coalesce((x == low).cast("int"), F.lit(0)) for x in zs), F.lit(0))
    return near.withColumn("ambiguous", F.col("valid") & F.coalesce((at_low > 1) & (low < F.col("z")), F.lit(False))).select(*cells.columns, "ambiguous")


