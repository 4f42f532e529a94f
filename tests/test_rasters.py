"""Rasters written and read by many tasks; files of other writers; faults leave nothing."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from epigrid.functions.places import Grid
from epigrid.sources import rasters


def tiff(values, block=None, order="<", predictor=1, deflate=True, extra=()):
    """A classic TIFF of an array (rows, columns[, bands]), in tiles of ``block`` or strips of two rows."""
    v = values if values.ndim == 3 else values[:, :, None]
    rows, cols, bands = v.shape
    kind = v.dtype.newbyteorder(order)
    h, w = block or (2, cols)
    blocks = []
    for r in range(0, rows, h):
        for c in range(0, cols, w):
            b = v[r : r + h, c : c + w]
            if block:
                b = np.pad(b, ((0, h - b.shape[0]), (0, w - b.shape[1]), (0, 0)))
            if predictor == 2:
                b = np.diff(b, axis=1, prepend=np.zeros_like(b[:, :1]))
            if predictor == 3:
                raw = np.ascontiguousarray(b.astype(v.dtype.newbyteorder(">"))).view(np.uint8).reshape(b.shape[0], -1, v.dtype.itemsize).transpose(0, 2, 1).reshape(b.shape[0], -1)
                raw = np.concatenate([raw[:, :bands], raw[:, bands:] - raw[:, :-bands]], axis=1).tobytes()
            else:
                raw = b.astype(kind).tobytes()
            blocks.append(zlib.compress(raw) if deflate else raw)
    offsets = (8 + np.cumsum([0] + [len(b) for b in blocks])[:-1]).tolist()
    sizes = [len(b) for b in blocks]
    fields = [(256, "I", [cols]), (257, "I", [rows]), (258, "H", [v.dtype.itemsize * 8] * bands), (259, "H", [8 if deflate else 1]), (277, "H", [bands]), (317, "H", [predictor]), (339, "H", [{"u": 1, "i": 2, "f": 3}[v.dtype.kind]] * bands), *extra]
    fields += [(322, "I", [w]), (323, "I", [h]), (324, "I", offsets), (325, "I", sizes)] if block else [(273, "I", offsets), (278, "I", [h]), (279, "I", sizes)]
    at = 8 + sum(sizes)
    beyond_at, entries, beyond = at + 2 + 12 * len(fields) + 4, b"", b""
    for tag, code, x in sorted(fields, key=lambda f: f[0]):
        raw = x if code == "s" else struct.pack(f"{order}{len(x)}{code}", *x)
        n = len(x)
        held = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(f"{order}I", beyond_at + len(beyond))
        beyond += raw if len(raw) > 4 else b""
        entries += struct.pack(f"{order}HHI", tag, {"H": 3, "I": 4, "d": 12, "s": 2}[code], n) + held
    return struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, at) + b"".join(blocks) + struct.pack(f"{order}H", len(fields)) + entries + bytes(4) + beyond


PLACED = [(33550, "d", [0.5, 0.25, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 10.0, 50.0, 0.0]), (34735, "H", [1, 1, 0, 1, 3072, 0, 1, 5070]), (42113, "s", b"-1\0")]


@pytest.mark.parametrize("dtype, order, block, predictor, deflate", [("f8", "<", None, 1, True), ("f4", ">", (16, 16), 1, True), ("i2", "<", (16, 32), 2, True), ("u1", "<", None, 1, False), ("f4", "<", (16, 16), 3, True), ("f8", "<", None, 3, True), ("i4", "<", None, 2, True)])
def test_files_of_other_writers(spark, tmp_path, dtype, order, block, predictor, deflate):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 100, (21, 37)).astype(dtype)
    (tmp_path / "a.tif").write_bytes(tiff(v, block, order, predictor, deflate, PLACED))
    got = rasters.read_rasters(spark, str(tmp_path), cells_per_partition=100)
    assert got.rdd.getNumPartitions() > 1
    cells = {r.cell_id: r.value for r in got.collect()}
    assert [cells[i + 1] for i in range(v.size)] == v.ravel().astype(float).tolist()
    info = rasters.raster_info(spark, str(tmp_path)).first()
    assert (info.rows, info.cols, info.xmin, info.xmax, info.ymin, info.ymax, info.crs, info.nodata) == (21, 37, 10.0, 28.5, 44.75, 50.0, "EPSG:5070", -1.0)


def test_bands_and_missing_values(spark, tmp_path):
    v = np.arange(40, dtype=np.float32).reshape(5, 4, 2)
    v[0, 0, 0], v[1, 1, 1] = -1, np.nan
    (tmp_path / "b.tif").write_bytes(tiff(v, extra=PLACED))
    got = {(r.band, r.cell_id): r.value for r in rasters.read_rasters(spark, str(tmp_path / "b.tif")).collect()}
    assert got[1, 1] is None and got[2, 6] is None and got[1, 2] == 2.0 and got[2, 20] == 39.0 and len(got) == 40


def test_round_trip(spark, tmp_path):
    g = Grid(300, 40, -10.0, 10.0, 20.0, 50.0)
    rows = spark.range(1, 300 * 40 + 1).where("id % 7 <> 0").selectExpr("id as cell_id", "case when id % 5 = 0 then null when id % 11 = 0 then double('nan') else sin(id) end as value")
    both = rows.withColumn("raster", F.lit("count_y2024_w07")).unionByName(rows.where("cell_id > 11000").withColumn("raster", F.lit("count_y2023_w52")))
    path = str(tmp_path / "out")
    rasters.write_rasters(both, g, path, crs="EPSG:5070", strip_cells=1000)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["count_y2023_w52.tif", "count_y2024_w07.tif"]
    cells = rasters.read_rasters(spark, path, cells_per_partition=2000)
    assert cells.rdd.getNumPartitions() >= 12 and cells.count() == 2 * 12000
    stack = rasters.raster_stack(cells)
    assert [tuple(r) for r in stack.select("layer", "label", "epiyear", "epiweek").distinct().orderBy("layer").collect()] == [(1, "y2023_w52", 2023, 52), (2, "y2024_w07", 2024, 7)]
    got = stack.where("layer = 2 and value is not null").select("cell_id", "value")
    want = rows.where("value is not null and not isnan(value)")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    info = rasters.raster_info(spark, path)
    assert {(r.rows, r.cols, r.xmin, r.xmax, r.ymin, r.ymax, r.crs, r.nodata, r.dtype, r.blocks) for r in info.collect()} == {(300, 40, -10.0, 10.0, 20.0, 50.0, "EPSG:5070", -9999.0, "float64", 12)}
    assert rasters.raster_problems(info, "EPSG:5070", info.limit(1)).collect() == []
    # Written again, one of them replaced.
    rasters.write_rasters(both.where("raster = 'count_y2023_w52' and cell_id = 11001"), g, path, crs="here, in km")
    again = rasters.raster_info(spark, path)
    assert {r.crs for r in again.collect()} == {"EPSG:5070", "here, in km"}
    assert [(r.path[-11:], r.problem, r.severity) for r in rasters.raster_problems(again, "EPSG:5070").collect()] == [("023_w52.tif", "other coordinate system", "WARNING")]
    assert rasters.read_rasters(spark, path + "/count_y2023_w52.tif").where("value is not null").count() == 1


def test_geometry_problems(spark, tmp_path):
    v = np.zeros((4, 4), np.float64)
    (tmp_path / "t.tif").write_bytes(tiff(v, extra=PLACED))
    (tmp_path / "u.tif").write_bytes(tiff(np.zeros((4, 5)), extra=PLACED))
    (tmp_path / "v.tif").write_bytes(tiff(v))
    info = rasters.raster_info(spark, str(tmp_path))
    got = sorted((r.path[-5], r.problem) for r in rasters.raster_problems(info, "epsg:5070", rasters.raster_info(spark, str(tmp_path / "t.tif"))).collect())
    assert got == [("u", "other geometry than the template"), ("v", "no coordinate system"), ("v", "other geometry than the template")]


@pytest.mark.parametrize("cells", [[1, 1], [0], [17]])
def test_faults_leave_no_file(spark, tmp_path, cells):
    df = spark.createDataFrame([("a", c, 1.0) for c in cells] + [("b", 2, 1.0)], "raster string, cell_id long, value double")
    with pytest.raises(Exception, match="twice|no cell"):
        rasters.write_rasters(df, Grid(4, 4, 0.0, 4.0, 0.0, 4.0), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or [p.name for p in (tmp_path / "out").iterdir()] == []


def test_missing_input(spark, tmp_path):
    with pytest.raises(Exception, match="does not exist"):
        rasters.read_rasters(spark, str(tmp_path / "none")).collect()
    (tmp_path / "c.tif").write_bytes(b"no raster at all")
    with pytest.raises(Exception, match="not a TIFF"):
        rasters.read_rasters(spark, str(tmp_path)).collect()
