"""Raster sources: SRTM .hgt, ESRI ASCII and (with rasterio) GeoTIFF, as cells.

``register(spark)`` adds the data source "raster": one partition per block of rows of each
file, with filters on i and j pushed into the reader. ``read_dem`` gives cells with
coordinates; ``write_cells`` stores cells by tile.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..operators.grid import Affine, transform2xy, with_ids

ROWS = 256
SCHEMA = "grid_id string, i int, j int, z double, valid boolean"


@dataclass(frozen=True)
class RasterInfo:
    rows: int
    cols: int
    transform: Affine
    nodata: float | None
    kind: str
    skip: int = 0


def hgt_transform(path: str, size: int) -> Affine:
    """From the name (N25E121.hgt): the posts lie on whole degrees, the first is the north-west one."""
    m = re.fullmatch(r"([NS])(\d{1,2})([EW])(\d{1,3})", os.path.splitext(os.path.basename(path))[0].upper())
    if not m:
        raise ValueError(f"{path} isn't named by its corner, like N25E121.hgt")
    lat = int(m[2]) * (1 if m[1] == "N" else -1)
    lon = int(m[4]) * (1 if m[3] == "E" else -1)
    step = 1.0 / (size - 1)
    return Affine(step, 0.0, lon - step / 2, 0.0, -step, lat + 1 + step / 2)


def raster_info(path: str) -> RasterInfo:
    ext = os.path.splitext(path)[1].lower()
    if ext == ".hgt":
        size = int(round((os.path.getsize(path) / 2) ** 0.5))
        if size * size * 2 != os.path.getsize(path) or size not in (1201, 3601):
            raise ValueError(f"{path} isn't a square of 1201 or 3601 posts")
        return RasterInfo(size, size, hgt_transform(path, size), -32768.0, "hgt")
    if ext in (".asc", ".txt"):
        head: dict[str, float] = {}
        skip = 0
        with open(path) as f:
            for line in f:
                parts = line.split()
                if len(parts) != 2 or not parts[0][0].isalpha():
                    break
                head[parts[0].lower()] = float(parts[1])
                skip += 1
        rows, cols, cell = int(head["nrows"]), int(head["ncols"]), head["cellsize"]
        west = head["xllcorner"] if "xllcorner" in head else head["xllcenter"] - cell / 2
        south = head["yllcorner"] if "yllcorner" in head else head["yllcenter"] - cell / 2
        return RasterInfo(rows, cols, Affine(cell, 0.0, west, 0.0, -cell, south + rows * cell), head.get("nodata_value"), "ascii", skip)
    try:
        import rasterio
    except ImportError as err:
        raise ValueError(f"{path}: reading this format needs rasterio") from err
    with rasterio.open(path) as src:
        t = src.transform
        return RasterInfo(src.height, src.width, Affine(t.a, t.b, t.c, t.d, t.e, t.f), src.nodata, "rasterio")


def read_block(path: str, info: RasterInfo, first: int, last: int, band: int = 1) -> np.ndarray:
    """Rows first .. last - 1 as doubles, no data as NaN."""
    if info.kind == "hgt":
        with open(path, "rb") as f:
            f.seek(2 * info.cols * first)
            z = np.frombuffer(f.read(2 * info.cols * (last - first)), ">i2").astype(float).reshape(-1, info.cols)
    elif info.kind == "ascii":
        with open(path) as f:
            for _ in range(info.skip + first):
                next(f)
            z = np.array([next(f).split() for _ in range(last - first)], float)
    else:
        import rasterio
        from rasterio.windows import Window

        with rasterio.open(path) as src:
            z = src.read(band, window=Window(0, first, info.cols, last - first))
        if np.iscomplexobj(z):
            raise ValueError("complex rasters aren't elevations")
        z = z.astype(float)
    if info.nodata is not None:
        z = np.where(z == info.nodata, np.nan, z)
    return z


class RowBlock(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        path = options["path"]
        self.paths = [path] if os.path.isfile(path) else sorted(os.path.join(path, n) for n in os.listdir(path) if not n.startswith((".", "_")))
        self.band = int(options.get("band", 1))
        self.rows = int(options.get("rowsPerPartition", ROWS))
        self.low, self.high = {"i": 0, "j": 0}, {"i": 1 << 31, "j": 1 << 31}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name not in self.low or not isinstance(getattr(f, "value", None), int):
                yield f
                continue
            if isinstance(f, (GreaterThanOrEqual, GreaterThan, EqualTo)):
                self.low[name] = max(self.low[name], f.value + isinstance(f, GreaterThan))
            if isinstance(f, (LessThanOrEqual, LessThan, EqualTo)):
                self.high[name] = min(self.high[name], f.value + 1 - isinstance(f, LessThan))
            if not isinstance(f, (GreaterThanOrEqual, GreaterThan, EqualTo, LessThanOrEqual, LessThan)):
                yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for p in self.paths:
            n = raster_info(p).rows
            lo, hi = min(self.low["i"], n), min(self.high["i"], n)
            out += [RowBlock(p, a, min(a + self.rows, hi)) for a in range(lo, hi, self.rows)]
        return out or [RowBlock(self.paths[0], 0, 0)]

    def read(self, part: RowBlock) -> Iterator[pa.RecordBatch]:
        info = raster_info(part.path)
        if part.last > part.first:
            z = read_block(part.path, info, part.first, part.last, self.band)
            lo, hi = min(self.low["j"], info.cols), min(self.high["j"], info.cols)
            z = z[:, lo:hi]
            i, j = np.meshgrid(np.arange(part.first, part.last, dtype=np.int32), np.arange(lo, hi, dtype=np.int32), indexing="ij")
            name = pa.array([os.path.splitext(os.path.basename(part.path))[0]]).take(pa.array(np.zeros(z.size, np.int32)))
            yield pa.RecordBatch.from_arrays([name, pa.array(i.ravel()), pa.array(j.ravel()), pa.array(z.ravel()), pa.array(~np.isnan(z.ravel()))], names=["grid_id", "i", "j", "z", "valid"])


class RasterSource(DataSource):
    """spark.read.format("raster").load(file or folder); options band, rowsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return RasterReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)


def read_dem(spark: SparkSession, path: str, band: int = 1) -> tuple[DataFrame, Affine]:
    """(cells with x and y, transform) of one raster file."""
    register(spark)
    info = raster_info(path)
    cells = spark.read.format("raster").option("band", str(band)).load(path)
    return transform2xy(with_ids(cells), info.transform), info.transform


def write_cells(cells: DataFrame, path: str, tile: int = 1024) -> None:
    """Parquet by grid and tile, so that a crop reads its tiles alone."""
    tiled = cells.withColumn("ti", F.floor(F.col("i") / tile).cast("int")).withColumn("tj", F.floor(F.col("j") / tile).cast("int"))
    tiled.repartition("grid_id", "ti", "tj").sortWithinPartitions("i", "j").write.mode("overwrite").partitionBy("grid_id", "ti", "tj").parquet(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def nodata_to_nan(cells: DataFrame, nodata: float) -> DataFrame:
    z = F.when(F.col("z") == nodata, F.lit(float("nan"))).otherwise(F.col("z"))
    return cells.withColumn("z", z).withColumn("valid", F.col("valid") & ~F.isnan(z))
