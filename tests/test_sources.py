"""Raster files, services, streaming, the facade and the registry."""

import struct

import numpy as np
import pytest

from cairnflow.operators import flow, grid
from cairnflow.operators.terrain_frame import Terrain
from cairnflow.plans import registry
from cairnflow.sources import rasters, services
from cairnflow.streaming import tiles
from pyspark.sql import functions as F


def test_hgt(spark, tmp_path):
    path = tmp_path / "N25E121.hgt"
    data = np.zeros((1201, 1201), ">i2")
    data[0, 0], data[0, 1], data[1200, 1200] = -32768, 7, 9
    path.write_bytes(data.tobytes())
    cells, t = rasters.read_dem(spark, str(path))
    assert t.a == pytest.approx(1 / 1200)
    some = {(r.i, r.j): r for r in cells.where("(i = 0 and j < 2) or (i = 1200 and j = 1200)").collect()}
    assert not some[0, 0].valid and some[0, 0].x == pytest.approx(121) and some[0, 0].y == pytest.approx(26)
    assert some[0, 1].z == 7 and some[1200, 1200].z == 9 and some[1200, 1200].y == pytest.approx(25)
    with pytest.raises(ValueError):
        rasters.hgt_transform("mountain.hgt", 1201)


def test_ascii_and_filters(spark, tmp_path):
    path = tmp_path / "a.asc"
    path.write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 2\nNODATA_value -9\n1 2 3\n4 -9 6\n")
    cells, t = rasters.read_dem(spark, str(path))
    got = {(r.i, r.j): (r.z, r.valid, r.x, r.y) for r in cells.collect()}
    assert got[0, 0] == (1.0, True, 11.0, 23.0) and not got[1, 1][1] and got[1, 2] == (6.0, True, 15.0, 21.0)
    assert [r.z for r in cells.where("i = 1 and j >= 2").collect()] == [6.0]
    reader = rasters.RasterReader({"path": str(path), "rowsPerPartition": "1"})
    assert len(reader.partitions()) == 2


def test_write_and_read(spark, tmp_path):
    c = grid.cells_from_array(spark, np.arange(12.0).reshape(3, 4).tolist())
    rasters.write_cells(c, str(tmp_path / "t"), tile=2)
    back = rasters.read_cells(spark, str(tmp_path / "t"))
    assert back.count() == 12 and back.where("ti = 0 and tj = 1").count() == 4
    assert rasters.nodata_to_nan(c, 5.0).where("not valid").count() == 1


def test_service_requests(tmp_path):
    with pytest.warns(UserWarning):
        lat, lon = services.check_limits((25, 24), (190, 191))
    assert lat == (24.0, 25.0) and lon == (-170.0, -169.0)
    with pytest.raises(ValueError):
        services.check_limits((1, 1), (0, 1))
    url = services.gmrt_request((24, 25), (121, 122), "high", "esriascii")
    assert "north=25.0" in url and "resolution=high" in url
    assert "mresolution=100" in services.gmrt_request((24, 25), (121, 122), 100)
    assert "API_Key=k" in services.opentopo_request((24, 25), (121, 122), "k")
    with pytest.raises(ValueError):
        services.opentopo_request((24, 25), (121, 122), "k", "MOON")
    name = services.cache_path("gmrt", (-0.5, 1), (0.25, 2), "high", ".tif", services.DataDir(str(tmp_path)))
    assert name.endswith("gmrt_high_m0p5_1_0p25_2.tif")
    assert services.cache_path("gmrt", (0, 1), (0, 1), "0.25", ".tif").endswith("gmrt_p25_0_1_0_1.tif")
    (tmp_path / "x").write_text("here")
    assert services.fetch("http://nowhere.invalid/", str(tmp_path / "x")) == str(tmp_path / "x")


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    for n in range(2):
        c = grid.cells_from_array(spark, [[1.0, 2, 3], [4, 5, 6]], grid_id=f"g{n}")
        c.select("grid_id", "i", "j", "z", "valid").write.mode("append").parquet(src)
    q = tiles.run_per_batch(tiles.stream_cells(spark, src), lambda b: flow.simple_d8(grid.with_ids(b)), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 12 and out.where("code > 0").count() == 10


def test_facade(spark):
    z = [[9.0, 9, 9, 9], [9, 3, 2, 1], [9, 4, 9, 9], [9, 9, 9, 9]]
    t = Terrain(grid.cells_from_array(spark, z), gaussian_filter=None)
    assert t.shape == (4, 4)
    assert t.accumulation.agg(F.max("accum")).first()[0] == 16
    assert t.watersheds.agg(F.max("label")).first()[0] == 1
    assert t.fill_depressions().cells.count() == 16 and t.strahler_order.count() == 16
    assert t.with_mask(F.col("z") < 9).cells.where("valid").count() == 4
    s = Terrain(grid.cells_from_array(spark, z), stride=2, xlim=(0, 3), astype="float")
    assert s.shape == (2, 1) or s.shape == (2, 2)


def test_registry_runs(spark):
    sf = "/root/testdata/sf0.001"
    assert set(registry.SQL) <= set(registry.QUERIES) and len(registry.QUERIES) > 60
    r = registry.QUERIES["accumulation"](spark, sf).first()
    assert set(r.asDict()) == {"i", "j", "z", "code", "indegree", "accum"}
    assert struct.calcsize("<I") == 4
