"""The D8 direction scheme: offsets, codes and names, with a fixed scan order.

``ord`` is the order in which ties between neighbours are settled: by distance, then by
azimuth name order N, W, E, S, NW, NE, SW, SE for the 3 x 3 window.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = ("E", "SE", "S", "SW", "W", "NW", "N", "NE")
DIRS_SCHEMA = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("di", T.IntegerType()), T.StructField("dj", T.IntegerType()), T.StructField("code", T.ShortType()), T.StructField("name", T.StringType())])


@dataclass(frozen=True)
class Direction:
    ord: int
    di: int
    dj: int
    code: int
    name: str


def _power_of_two(k: int) -> int:
    return 1 << (k - 1)


@dataclass(frozen=True)
class D8Directions:
    """Directions of a square window cut into ``slices`` by azimuth (rows point south)."""

    window: int = 3
    slices: int = 8
    shape: str = "circular"
    transform_codes: Callable[[int], int] = _power_of_two
    sort_by_distance: bool = True

    def __post_init__(self) -> None:
        if self.window < 3 or self.window % 2 == 0:
            raise ValueError("window must be odd and at least 3")
        if self.slices < 2:
            raise ValueError("slices must be at least 2")
        if self.shape not in ("circular", "square"):
            raise ValueError("shape is circular or square")
        codes = {d.code for d in self.all()}
        if any(not 0 <= c <= 255 for c in codes):
            raise ValueError("codes must lie in 0 .. 255")
        if self.window == 3 and len(codes) != len(self.all()):
            raise ValueError("codes repeat")

    def all(self) -> tuple[Direction, ...]:
        """Self first, then the neighbours in scan order."""
        r, found = self.window // 2, []
        for di in range(-r, r + 1):
            for dj in range(-r, r + 1):
                d2 = di * di + dj * dj
                if d2 == 0 or (self.shape == "circular" and d2 > (self.window / 2) ** 2 and self.window > 3):
                    continue
                k = round(math.atan2(di, dj) / (2 * math.pi) * self.slices) % self.slices + 1
                found.append((d2 if self.sort_by_distance else 0, di, dj, int(self.transform_codes(k)), NAMES[k - 1] if self.slices == 8 else str(k)))
        found.sort(key=lambda x: x[0])
        return (Direction(0, 0, 0, 0, "self"), *(Direction(n, di, dj, c, s) for n, (_, di, dj, c, s) in enumerate(found, 1)))

    def neighbours(self) -> tuple[Direction, ...]:
        return self.all()[1:]

    @property
    def no_flow_code(self) -> int:
        return next((d.code for d in self.all() if (d.di, d.dj) == (0, 0)), 0)

    def offset(self, code: int) -> tuple[int, int]:
        """(di, dj) of a code; (0, 0) for an unknown one."""
        return next(((d.di, d.dj) for d in self.all() if d.code == code), (0, 0))

    def opposite_codes(self) -> dict[int, int]:
        by = {(d.di, d.dj): d.code for d in self.all()}
        return {d.code: by[-d.di, -d.dj] for d in self.all() if (-d.di, -d.dj) in by}

    def frame(self, spark: SparkSession) -> DataFrame:
        """The scheme as a table of a few rows."""
        return spark.createDataFrame([(d.ord, d.di, d.dj, d.code, d.name) for d in self.all()], DIRS_SCHEMA)

    def di_of(self, code: Column) -> Column:
        return self._lookup(code, lambda d: d.di)

    def dj_of(self, code: Column) -> Column:
        return self._lookup(code, lambda d: d.dj)

    def _lookup(self, code: Column, of: Callable[[Direction], int]) -> Column:
        out = F.when(code.isNull(), F.lit(None).cast("int"))
        for d in self.neighbours():
            out = out.when(code == d.code, of(d))
        return out.otherwise(0)


D8 = D8Directions()


def identity_scheme() -> D8Directions:
    """Codes 1 .. 8 from E clockwise."""
    return D8Directions(transform_codes=int)
