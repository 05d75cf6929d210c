"""A facade over one raster: constructor steps and lazily built results, immutable."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components, flow, grid, metrics, ridges, terrain
from .directions import D8, D8Directions


class Terrain:
    """Cells with derived results; every change gives a new Terrain, so nothing needs invalidating."""

    def __init__(self, cells: DataFrame, transform: grid.Affine = grid.Affine(), xlim=None, ylim=None, gaussian_filter: float | None = None, stride: int | None = None, detect_ocean: bool = False, directions: D8Directions = D8, astype: str | None = None, min_ocean_size: int = 1, ocean_flood_below: bool = True):
        if stride:
            cells, transform = grid.stride(cells, stride), transform.strided(stride)
        cells = grid.transform2xy(cells, transform)
        if xlim is not None or ylim is not None:
            cells = grid.crop(cells, xlim, ylim)
        if astype:
            cells = grid.astype(cells, astype)
        cells = grid.validity(cells, F.col("valid") if "valid" in cells.columns else None)
        if detect_ocean:
            cells = components.invalidate_ocean_basins(cells, 0, ocean_flood_below, min_ocean_size)
        if gaussian_filter:
            cells = grid.gaussian_filter(cells, gaussian_filter)
        self.cells, self.transform, self.directions = cells, transform, directions

    def _with(self, cells: DataFrame) -> Terrain:
        out = object.__new__(Terrain)
        out.cells, out.transform, out.directions = cells, self.transform, self.directions
        return out

    def fill_depressions(self, max_fill_size: int | None = None) -> Terrain:
        return self._with(flow.fill_depressions(self.cells) if max_fill_size is None else flow.fill_small_depressions(self.cells, max_fill_size))

    def invalidate_ocean_basins(self, ocean_level: float = 0, min_size: int = 1, flood_below: bool = True) -> Terrain:
        return self._with(components.invalidate_ocean_basins(self.cells, ocean_level, flood_below, min_size))

    def with_mask(self, mask: Column) -> Terrain:
        return self._with(grid.validity(self.cells, mask))

    @cached_property
    def shape(self) -> tuple[int, int]:
        r = grid.shapes(self.cells).first()
        return (r.nrows, r.ncols)

    @cached_property
    def slope(self) -> DataFrame:
        return terrain.slope(self.cells, coordinates=True)

    @cached_property
    def prominence(self) -> DataFrame:
        return terrain.prominence(self.cells, self.directions)

    @cached_property
    def isolation(self) -> DataFrame:
        return terrain.isolation(self.cells)

    @cached_property
    def ocean_mask(self) -> DataFrame:
        return components.ocean_basins(self.cells).withColumn("ocean", F.col("label") > 0)

    @property
    def sea_mask(self) -> DataFrame:
        return self.ocean_mask

    @cached_property
    def flowdir(self) -> DataFrame:
        return flow.durable(flow.complete_d8(self.cells, scheme=self.directions))

    @cached_property
    def indegree(self) -> DataFrame:
        return flow.indegree(self.flowdir)

    @cached_property
    def accumulation(self) -> DataFrame:
        return metrics.accumulation(self.flowdir)

    @cached_property
    def strahler_order(self) -> DataFrame:
        return metrics.strahler(self.flowdir)

    @cached_property
    def dist2source(self) -> DataFrame:
        return metrics.dist2source(self.flowdir)

    @property
    def flow_distance(self) -> DataFrame:
        return self.dist2source

    @cached_property
    def watersheds(self) -> DataFrame:
        return metrics.watersheds(self.flowdir)

    @cached_property
    def dist2sink(self) -> DataFrame:
        return metrics.dist2sink(self.flowdir)

    @property
    def backdist(self) -> DataFrame:
        return self.dist2sink

    @cached_property
    def bmax(self) -> DataFrame:
        return ridges.dist2conf_max(self.flowdir)

    @property
    def ridge_dist(self) -> DataFrame:
        return self.bmax

    @cached_property
    def ridgedir(self) -> DataFrame:
        return flow.durable(ridges.ridgedir(self.flowdir))

    @cached_property
    def dist2ridge(self) -> DataFrame:
        return ridges.dist2ridge(self.ridgedir, dir_is_ridge=True)

    @cached_property
    def ridge_strahler_order(self) -> DataFrame:
        return ridges.ridge_strahler(self.ridgedir, dir_is_ridge=True)
