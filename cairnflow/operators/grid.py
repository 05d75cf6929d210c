"""Rasters as cells: sources from tables and arrays, coordinates, stride, crop, masks, smoothing.

cells: grid_id string, i int, j int, cid long (column-major linear id), z double, valid boolean.
``z`` holds the elevation; where 32-bit comparison matters the caller casts it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

KEY = ("grid_id",)


@dataclass(frozen=True)
class Affine:
    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = 1.0
    f: float = 0.0

    def strided(self, s: int) -> Affine:
        return Affine(self.a * s, self.b * s, self.c, self.d * s, self.e * s, self.f)


def cells_from_vectors(df: DataFrame, row: str, values: str, z: Column | None = None, grid_id: str = "g") -> DataFrame:
    """One raster row per table row: i = ``row``, j = position in the array ``values``."""
    exploded = df.select(F.col(row).cast("int").alias("i"), F.posexplode(values).alias("j", "e"))
    out = exploded.select(F.lit(grid_id).alias("grid_id"), "i", F.col("j").cast("int").alias("j"), (z if z is not None else F.col("e").cast("double")).alias("z"))
    return with_ids(out.withColumn("valid", F.col("z").isNotNull() & ~F.isnan(F.col("z").cast("double"))))


def cells_from_array(spark: SparkSession, array: Sequence[Sequence[float]], valid: Sequence[Sequence[bool]] | None = None, grid_id: str = "g") -> DataFrame:
    """Cells of a small array; NaN or a false mask makes a cell invalid."""
    rows = [(grid_id, i, j, float(z), not math.isnan(z) and (valid is None or bool(valid[i][j]))) for i, line in enumerate(array) for j, z in enumerate(line)]
    return with_ids(spark.createDataFrame(rows, "grid_id string, i int, j int, z double, valid boolean"))


def shapes(cells: DataFrame) -> DataFrame:
    """(grid_id, nrows, ncols)."""
    return cells.groupBy("grid_id").agg((F.max("i") + 1).alias("nrows"), (F.max("j") + 1).alias("ncols"))


def with_ids(cells: DataFrame) -> DataFrame:
    """Add the column-major id: j * 2**31 + i orders cells as j * nrows + i does, without the shape."""
    return cells.withColumn("cid", F.shiftleft(F.col("j").cast("long"), 31) + F.col("i"))


def flat_id(cells: DataFrame) -> DataFrame:
    """Add ``flat``: j * nrows + i."""
    return cells.join(F.broadcast(shapes(cells)), "grid_id").withColumn("flat", F.col("j").cast("long") * F.col("nrows") + F.col("i"))


def at(i: Column, j: Column) -> Column:
    """The id of the cell in row i and column j."""
    return F.shiftleft(j.cast("long"), 31) + i


def transform2xy(cells: DataFrame, t: Affine = Affine()) -> DataFrame:
    """Cell-centre coordinates x, y."""
    jj, ii = F.col("j") + 0.5, F.col("i") + 0.5
    return cells.withColumn("x", t.c + t.a * jj + t.b * ii).withColumn("y", t.f + t.d * jj + t.e * ii)


def stride(cells: DataFrame, s: int) -> DataFrame:
    """Every s-th row and column, renumbered; a filter and a projection."""
    if s < 1:
        raise ValueError("stride must be positive")
    kept = cells.where((F.col("i") % s == 0) & (F.col("j") % s == 0))
    return with_ids(kept.withColumn("i", (F.col("i") / s).cast("int")).withColumn("j", (F.col("j") / s).cast("int")))


def crop(cells: DataFrame, xlim: tuple[float, float] | None = None, ylim: tuple[float, float] | None = None) -> DataFrame:
    """Cells whose x and y lie in the closed ranges, renumbered from the first kept row and column."""
    out = cells
    for name, lim in (("x", xlim), ("y", ylim)):
        if lim is not None:
            lo, hi = sorted(lim)
            if lo == hi:
                raise ValueError(f"empty {name} range")
            out = out.where(F.col(name).between(lo, hi))
    first = out.groupBy("grid_id").agg(F.min("i").alias("i0"), F.min("j").alias("j0"))
    moved = out.join(F.broadcast(first), "grid_id")
    return with_ids(moved.withColumn("i", F.col("i") - F.col("i0")).withColumn("j", F.col("j") - F.col("j0")).drop("i0", "j0"))


def validity(cells: DataFrame, mask: Column | None = None) -> DataFrame:
    """valid = finite elevation and, if given, the mask."""
    z = F.col("z").cast("double")
    ok = z.isNotNull() & ~F.isnan(z) & (F.abs(z) != float("inf"))
    return cells.withColumn("valid", F.coalesce(ok & mask if mask is not None else ok, F.lit(False)))


def astype(cells: DataFrame, kind: str) -> DataFrame:
    return cells.withColumn("z", F.col("z").cast(kind))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def gaussian_filter(cells: DataFrame, sigma: float, truncate: float = 4.0) -> DataFrame:
    """Separable Gaussian with reflected edges: two sliding windows of 4r + 3 cells.

    Invalid cells keep their value and, as in plain convolution, a NaN spreads within reach.
    """
    w = gaussian_weights(sigma, truncate)
    r = len(w) // 2
    out = cells.withColumn("z0", F.col("z"))
    for across, along in (("j", "i"), ("i", "j")):
        n = F.count(F.lit(1)).over(W.partitionBy("grid_id", across))
        line = W.partitionBy("grid_id", across).orderBy(along).rowsBetween(-2 * r - 1, 2 * r + 1)
        near = F.collect_list(F.col("z")).over(line)
        first = F.greatest(F.col(along) - (2 * r + 1), F.lit(0))
        total = F.lit(0.0)
        for k, weight in zip(range(-r, r + 1), w):
            total = total + weight * F.get(F.col("near"), (_reflect(F.col(along) + k, F.col("len")) - F.col("first")).cast("int"))
        out = out.withColumn("len", n).withColumn("near", near).withColumn("first", first).withColumn("z", total).drop("len", "near", "first")
    return out.withColumn("z", F.when(F.col("valid"), F.col("z")).otherwise(F.col("z0"))).drop("z0")


def _reflect(at_: Column, n: Column) -> Column:
    """Index with the edge cell repeated: d c b a | a b c d | d c b a."""
    m = F.pmod(at_, 2 * n)
    return F.when(m < n, m).otherwise(2 * n - 1 - m)
