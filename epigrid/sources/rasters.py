"""GeoTIFF rasters as tables, read and written by many tasks.

``read_rasters`` gives (path, band, cell_id, value), cells numbered from the top left by row
from 1. A partition is a run of a file's strips or tiles, so a raster of any size is read
by many tasks, a block at a time. ``write_rasters`` compresses strips in tasks; the commit,
which only a successful job reaches, joins them into files and renames those, so readers
never see a part of one. Paths are local folders that all machines share, or URIs that
pyarrow's file systems open.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .. import importable
from ..functions.places import Grid
from .files import WEEK_IN_NAME, check_weekly_files, weekly_files

#: Sizes and struct codes of TIFF's field types, by their number.
FIELD = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
#: The tags that are read, by name.
TAG = {
    "width": 256, "height": 257, "bits": 258, "compression": 259, "strip_offsets": 273, "bands": 277, "rows_per_strip": 278, "strip_bytes": 279, "planar": 284, "predictor": 317,
    "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_bytes": 325, "format": 339, "scale": 33550, "tiepoint": 33922, "transform": 34264, "geo_keys": 34735, "geo_text": 34737, "nodata": 42113,
}
DEFLATE = (8, 32946)
CELLS = "path string, band int, cell_id long, value double"
INFO = "path string, rows int, cols int, bands int, xmin double, xmax double, ymin double, ymax double, crs string, nodata double, dtype string, blocks int"


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Header:
    """What a file's first directory says."""

    rows: int
    cols: int
    bands: int
    dtype: str
    compression: int
    predictor: int
    planar: bool
    block: tuple[int, int]
    tiled: bool
    offsets: list[int]
    sizes: list[int]
    extent: tuple[float, float, float, float]
    crs: str | None
    nodata: float | None

    @property
    def across(self) -> int:
        return math.ceil(self.cols / self.block[1])

    @property
    def per_band(self) -> int:
        return self.across * math.ceil(self.rows / self.block[0])


def read_header(f) -> Header:
    start = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    version = struct.unpack(f"{order}H", start[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack(f"{order}Q", start[8:16])[0] if big else struct.unpack(f"{order}I", start[4:8])[0]
    f.seek(at)
    n = struct.unpack(f"{order}{'Q' if big else 'H'}", f.read(8 if big else 2))[0]
    entry = 20 if big else 12
    table, fields = f.read(n * entry), {}
    for k in range(n):
        one = table[k * entry : (k + 1) * entry]
        tag, kind, count = struct.unpack(f"{order}HH{'Q' if big else 'I'}", one[: 12 if big else 8])
        if kind not in FIELD:
            continue
        size, code = FIELD[kind]
        held = one[12 if big else 8 :]
        if size * count > len(held):
            f.seek(struct.unpack(f"{order}{'Q' if big else 'I'}", held)[0])
            held = f.read(size * count)
        fields[tag] = held[:count] if code == "s" else struct.unpack(f"{order}{count}{code}", held[: size * count])
    one = lambda name, default: fields.get(TAG[name], (default,))[0]
    rows, cols, bands, bits = one("height", 0), one("width", 0), one("bands", 1), one("bits", 8)
    dtype = order + {1: "u", 2: "i", 3: "f"}[one("format", 1)] + str(bits // 8)
    if one("compression", 1) not in (1, *DEFLATE):
        raise ValueError(f"compression {one('compression', 1)} is not supported")
    tiled = TAG["tile_width"] in fields
    block = (one("tile_height", 0), one("tile_width", 0)) if tiled else (min(one("rows_per_strip", rows), rows), cols)
    kind = "tile" if tiled else "strip"
    text = lambda raw: raw.split(b"\0")[0].decode("ascii", "replace").strip("| ")
    keys, said = fields.get(TAG["geo_keys"], ()), fields.get(TAG["geo_text"], b"")
    geo = {}
    for k in range(1, len(keys) // 4):
        key, where, count, value = keys[4 * k : 4 * k + 4]
        geo[key] = value if where == 0 else text(said[value : value + count]) if where == TAG["geo_text"] else None
    code = next((geo[k] for k in (3072, 2048) if 0 < geo.get(k, 0) < 32767), None)
    crs = f"EPSG:{code}" if code else next((geo[k] for k in (3073, 2049, 1026) if geo.get(k)), None)
    if TAG["scale"] in fields and TAG["tiepoint"] in fields:
        (dx, dy, *_), (i, j, _, x, y, *_) = fields[TAG["scale"]], fields[TAG["tiepoint"]]
        xmin, ymax = x - i * dx, y + j * dy
    elif TAG["transform"] in fields:
        m = fields[TAG["transform"]]
        dx, dy, xmin, ymax = m[0], -m[5], m[3], m[7]
    else:
        dx, dy, xmin, ymax = 1.0, 1.0, 0.0, float(rows)
    missing = text(fields[TAG["nodata"]]) if TAG["nodata"] in fields else ""
    return Header(rows, cols, bands, dtype, one("compression", 1), one("predictor", 1), one("planar", 1) == 2, block, tiled, list(fields[TAG[f"{kind}_offsets"]]), list(fields[TAG[f"{kind}_bytes"]]), (xmin, xmin + cols * dx, ymax - rows * dy, ymax), crs, float(missing) if missing else None)


def read_block(f, h: Header, k: int) -> tuple[np.ndarray, int, int, int]:
    """Block k as (rows, columns, bands of it), its first row and column, and its first band."""
    band, at = divmod(k, h.per_band) if h.planar else (0, k)
    row, col = (at // h.across) * h.block[0], (at % h.across) * h.block[1]
    n = 1 if h.planar else h.bands
    height = h.block[0] if h.tiled else min(h.block[0], h.rows - row)
    if not h.sizes[k]:  # a block that was never written
        return np.full((height, h.block[1], n), np.nan)[: h.rows - row, : h.cols - col], row, col, band
    f.seek(h.offsets[k])
    raw = f.read(h.sizes[k])
    raw = zlib.decompress(raw) if h.compression in DEFLATE else raw
    kind = np.dtype(h.dtype)
    if h.predictor == 3:  # bytes of a row's numbers, highest first, as differences
        planes = np.frombuffer(raw, np.uint8)[: height * h.block[1] * n * kind.itemsize].reshape(height, -1)
        whole = np.zeros_like(planes)
        for first in range(n):
            whole[:, first::n] = np.cumsum(planes[:, first::n], axis=1, dtype=np.uint8)
        values = whole.reshape(height, kind.itemsize, -1).transpose(0, 2, 1).copy().view(kind.newbyteorder(">"))
        block = values.reshape(height, h.block[1], n)
    else:
        block = np.frombuffer(raw, kind)[: height * h.block[1] * n].reshape(height, h.block[1], n)
        if h.predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
    return block[: h.rows - row, : h.cols - col].astype(np.float64), row, col, band


@dataclass
class Blocks(InputPartition):
    path: str
    first: int
    last: int


class RasterReader(DataSourceReader):
    def __init__(self, options, info: bool):
        self.path, self.info = options["path"], info
        self.cells = int(options.get("cellsPerPartition", 4_000_000))

    def _files(self) -> list[str]:
        from pyarrow import fs

        system, path = file_system(self.path)
        found = system.get_file_info(path)
        prefix = self.path.rstrip("/")[: -len(path.rstrip("/"))] if self.path.rstrip("/").endswith(path.rstrip("/")) else ""
        if found.type == fs.FileType.File:
            return [self.path]
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"raster input does not exist: {self.path}")
        return sorted(prefix + x.path for x in system.get_file_info(fs.FileSelector(path)) if x.path.lower().endswith((".tif", ".tiff")) and "/." not in x.path)

    def partitions(self):
        out = []
        for path in self._files():
            if self.info:
                out.append(Blocks(path, 0, 0))
                continue
            system, own = file_system(path)
            with system.open_input_file(own) as f:
                h = read_header(f)
            step = max(1, self.cells // max(1, h.block[0] * h.block[1] * (1 if h.planar else h.bands)))
            out += [Blocks(path, k, min(k + step, len(h.offsets))) for k in range(0, len(h.offsets), step)]
        return out

    def read(self, partition: Blocks) -> Iterator:
        import pyarrow as pa

        system, own = file_system(partition.path)
        with system.open_input_file(own) as f:
            h = read_header(f)
            if self.info:
                yield (partition.path, h.rows, h.cols, h.bands, *h.extent, h.crs, h.nodata, np.dtype(h.dtype).name, len(h.offsets))
                return
            for k in range(partition.first, partition.last):
                block, row, col, first = read_block(f, h, k)
                ids = (np.arange(block.shape[0])[:, None] + row) * h.cols + np.arange(block.shape[1])[None] + col + 1
                for b in range(block.shape[2]):
                    v = block[:, :, b].ravel()
                    missing = ~np.isfinite(v) if h.nodata is None else ~np.isfinite(v) | (v == h.nodata)
                    columns = [pa.array([partition.path] * len(v)), pa.array(np.full(len(v), first + b + 1, np.int32)), pa.array(ids.ravel().astype(np.int64)), pa.array(v, mask=missing)]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "band", "cell_id", "value"])


@dataclass
class Strips(WriterCommitMessage):
    part: str
    held: list  # (raster, strip, offset, length)


class RasterWriter(DataSourceArrowWriter):
    """Rows (raster, strip, cell_id, value), each strip's rows together."""

    def __init__(self, options):
        self.path = options["path"]
        self.rows, self.cols, self.strip_rows = (int(options[k]) for k in ("rows", "cols", "stripRows"))
        self.extent = [float(options[k]) for k in ("xmin", "xmax", "ymin", "ymax")]
        self.crs, self.missing = options.get("crs", ""), float(options.get("missing", -9999.0))
        self.parts = f"_parts-{options['run']}"

    def _strip(self, n: int) -> np.ndarray:
        first = n * self.strip_rows
        return np.full(min(self.strip_rows, self.rows - first) * self.cols, self.missing)

    def write(self, iterator):
        system, top = file_system(self.path)
        system.create_dir(f"{top}/{self.parts}", recursive=True)
        name, held, at = f"{self.parts}/{uuid.uuid4().hex}", [], 0
        with system.open_output_stream(f"{top}/{name}") as out:
            now, values, seen = None, None, None

            def close():
                nonlocal at
                if now is not None:
                    packed = zlib.compress(values.astype("<f8").tobytes(), 6)
                    out.write(packed)
                    held.append((*now, at, len(packed)))
                    at += len(packed)

            for batch in iterator:
                if not batch.num_rows:
                    continue
                column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
                names, strips = column("raster").dictionary_encode(), np.asarray(column("strip"))
                codes, cells = np.asarray(names.indices), np.asarray(column("cell_id"))
                numbers = np.asarray(column("value").cast("double").fill_null(np.nan), dtype=np.float64)
                edge = np.flatnonzero(np.diff(codes) | np.diff(strips)) + 1
                for lo, hi in zip([0, *edge], [*edge, len(cells)], strict=True):  # a strip's rows of the batch
                    mine = (names.dictionary[int(codes[lo])].as_py(), int(strips[lo]))
                    if now != mine:
                        close()
                        now, values = mine, self._strip(mine[1])
                        seen = np.zeros(len(values), np.int64)
                    i = cells[lo:hi] - 1 - mine[1] * self.strip_rows * self.cols
                    np.add.at(seen, i, 1)
                    if seen.max() > 1:
                        raise ValueError(f"cell {int(seen.argmax()) + 1 + mine[1] * self.strip_rows * self.cols} of {mine[0]} is there twice")
                    good = np.isfinite(numbers[lo:hi])
                    values[i[good]] = numbers[lo:hi][good]
            close()
        return Strips(name, held)

    def commit(self, messages):
        system, top = file_system(self.path)
        system.create_dir(top, recursive=True)
        strips: dict = {}
        for m in filter(None, messages):
            for raster, strip, at, n in m.held:
                if (raster, strip) in strips:
                    raise ValueError(f"strip {strip} of {raster} was written twice")
                strips[raster, strip] = (m.part, at, n)
        count = math.ceil(self.rows / self.strip_rows)
        for raster in sorted({r for r, _ in strips}):
            empty = {n: zlib.compress(self._strip(n).astype("<f8").tobytes(), 6) for n in range(count) if (raster, n) not in strips}
            sizes = [len(empty[n]) if n in empty else strips[raster, n][2] for n in range(count)]
            with system.open_output_stream(f"{top}/.{raster}.tif-{self.parts}") as out:
                out.write(self._header(sizes))
                for n in range(count):
                    if n in empty:
                        out.write(empty[n])
                        continue
                    part, at, left = strips[raster, n]
                    with system.open_input_file(f"{top}/{part}") as f:
                        f.seek(at)
                        while left:
                            some = f.read(min(left, 1 << 20))
                            out.write(some)
                            left -= len(some)
            system.move(f"{top}/.{raster}.tif-{self.parts}", f"{top}/{raster}.tif")
        self.abort(messages)

    def abort(self, messages):
        system, top = file_system(self.path)
        from pyarrow import fs

        if system.get_file_info(f"{top}/{self.parts}").type == fs.FileType.Directory:
            system.delete_dir(f"{top}/{self.parts}")

    def _header(self, sizes: list[int]) -> bytes:
        """A little-endian BigTIFF directory before the strips: doubles, deflate, one band."""
        text = self.crs.encode("ascii")
        code = int(self.crs[5:]) if self.crs.upper().startswith("EPSG:") and self.crs[5:].isdigit() else None
        if code is not None:
            geographic = 4000 <= code < 5000
            keys = [(1024, 0, 1, 2 if geographic else 1), (1025, 0, 1, 1), (2048 if geographic else 3072, 0, 1, code)]
            text = b""
        else:
            text = text + b"|" if text else b""
            keys = [(1024, 0, 1, 1), (1025, 0, 1, 1)] + ([(1026, TAG["geo_text"], len(text), 0)] if text else [])
        xmin, xmax, ymin, ymax = self.extent
        grid = [v for k in [(1, 1, 0, len(keys)), *keys] for v in k]
        fields = [
            (256, 4, [self.cols]), (257, 4, [self.rows]), (258, 3, [64]), (259, 3, [8]), (262, 3, [1]), (273, 16, [0] * len(sizes)), (277, 3, [1]), (278, 4, [self.strip_rows]), (279, 16, sizes), (284, 3, [1]), (339, 3, [3]),
            (33550, 12, [(xmax - xmin) / self.cols, (ymax - ymin) / self.rows, 0.0]), (33922, 12, [0.0, 0.0, 0.0, xmin, ymax, 0.0]), (34735, 3, grid), *([(34737, 2, text + b"\0")] if text else []), (42113, 2, f"{self.missing:.17g}".encode() + b"\0"),
        ]
        base = 16 + 8 + 20 * len(fields) + 8

        def packed(offsets):
            entries, beyond = b"", b""
            for tag, kind, v in fields:
                v = offsets if tag == 273 else v
                raw = v if kind == 2 else struct.pack(f"<{len(v)}{FIELD[kind][1]}", *v)
                if len(raw) > 8:
                    held = struct.pack("<Q", base + len(beyond))
                    beyond += raw + b"\0" * (-len(raw) % 8)
                else:
                    held = raw.ljust(8, b"\0")
                entries += struct.pack("<HHQ", tag, kind, len(v)) + held
            return struct.pack("<2sHHHQQ", b"II", 43, 8, 0, 16, len(fields)) + entries + struct.pack("<Q", 0) + beyond

        start = len(packed([0] * len(sizes)))
        return packed([start + int(x) for x in np.cumsum([0, *sizes])[:-1]])


class RasterSource(DataSource):
    info = False

    @classmethod
    def name(cls):
        return "epigrid_raster"

    def schema(self):
        return CELLS

    def reader(self, schema):
        return RasterReader(self.options, self.info)

    def writer(self, schema, overwrite):
        return RasterWriter(self.options)


class RasterInfo(RasterSource):
    info = True

    @classmethod
    def name(cls):
        return "epigrid_raster_info"

    def schema(self):
        return INFO


def _source(spark: SparkSession, name: str):
    importable(spark)
    spark.dataSource.register(RasterSource)
    spark.dataSource.register(RasterInfo)
    return spark.read.format(name)


def read_rasters(spark: SparkSession, path: str, cells_per_partition: int = 4_000_000) -> DataFrame:
    """(path, band, cell_id, value) of a GeoTIFF file, or of all in a folder; missing and
    non-finite values are null."""
    return _source(spark, "epigrid_raster").option("cellsPerPartition", cells_per_partition).load(path)


def raster_info(spark: SparkSession, path: str) -> DataFrame:
    """A row a file (INFO): its size, extent, coordinate system, missing value, type and blocks."""
    return _source(spark, "epigrid_raster_info").load(path)


def write_rasters(values: DataFrame, grid: Grid, path: str, crs: str = "", missing: float = -9999.0, strip_cells: int = 1 << 20) -> None:
    """A GeoTIFF <raster>.tif in a folder for every raster of values (raster, cell_id, value): doubles,
    deflate, null and non-finite as ``missing``. Cells without a row are missing; a cell
    that is there twice, or is none of the grid's, is an error, and then no file is changed.

    Tasks get whole strips of about ``strip_cells`` cells, of any raster, so neither many
    small rasters nor one large one meets in one task."""
    spark = values.sparkSession
    _source(spark, "epigrid_raster")
    rows = max(1, min(grid.rows, strip_cells // grid.cols))
    inside = F.col("cell_id").between(1, grid.rows * grid.cols)
    checked = values.select("raster", F.when(inside, F.col("cell_id")).otherwise(F.raise_error(F.concat(F.lit("no cell of the grid: "), F.col("cell_id").cast("string"))).cast("long")).cast("long").alias("cell_id"), F.col("value").cast("double").alias("value"))
    strips = checked.withColumn("strip", F.expr(f"cast((cell_id - 1) div {rows * grid.cols} as int)")).repartition("raster", "strip").sortWithinPartitions("raster", "strip")
    options = {"rows": grid.rows, "cols": grid.cols, "stripRows": rows, "xmin": grid.xmin, "xmax": grid.xmax, "ymin": grid.ymin, "ymax": grid.ymax, "crs": crs, "missing": missing, "run": uuid.uuid4().hex}
    strips.select("raster", "strip", "cell_id", "value").write.format("epigrid_raster").options(**{k: str(v) for k, v in options.items()}).mode("append").save(path)


def raster_problems(info: DataFrame, crs: str | None = None, template: DataFrame | None = None, tolerance: float = 1e-6) -> DataFrame:
    """(path, problem, severity) of rasters: without a coordinate system (an error), in another
    than ``crs``, or of another shape or extent than the template's row of ``raster_info``
    (warnings: such rasters are transformed on extraction)."""
    rows = info
    found = [F.when(F.col("crs").isNull(), F.struct(F.lit("no coordinate system").alias("problem"), F.lit("ERROR").alias("severity")))]
    if crs is not None:
        found.append(F.when(F.upper("crs") != crs.upper(), F.struct(F.lit("other coordinate system").alias("problem"), F.lit("WARNING").alias("severity"))))
    if template is not None:
        t = template.limit(1).select(*[F.col(c).alias(f"t_{c}") for c in ("rows", "cols", "xmin", "xmax", "ymin", "ymax", "crs")])
        rows = rows.crossJoin(F.broadcast(t))
        size = (F.col("xmax") - F.col("xmin")) / F.col("cols")
        same = (F.col("rows") == F.col("t_rows")) & (F.col("cols") == F.col("t_cols")) & F.col("crs").eqNullSafe(F.col("t_crs"))
        for side in ("xmin", "xmax", "ymin", "ymax"):
            same = same & (F.abs(F.col(side) - F.col(f"t_{side}")) <= F.abs(size) * tolerance)
        found.append(F.when(~same, F.struct(F.lit("other geometry than the template").alias("problem"), F.lit("WARNING").alias("severity"))))
    return rows.select("path", F.explode(F.array_compact(F.array(*found))).alias("p")).select("path", "p.*")


def raster_stack(cells: DataFrame) -> DataFrame:
    """(layer, label, epiyear, epiweek, cell_id, value) of weekly rasters: layers in the order of year and week,
    labels without ``count_`` and the ending. Files whose names hold no week are left out."""
    names = weekly_files(cells.select("path").distinct(), WEEK_IN_NAME)
    label = F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.tiff?$", ""), "count_", "")
    order = names.withColumn("label", label).groupBy().agg(F.array_sort(F.collect_list(F.struct("epiyear", "epiweek", "label", "path"))).alias("all"))  # a row a file
    layers = order.select(F.posexplode("all").alias("k", "f")).select((F.col("k") + 1).alias("layer"), "f.*")
    return cells.join(F.broadcast(layers), "path").select("layer", "label", "epiyear", "epiweek", "cell_id", "value")


__all__ = ["check_weekly_files", "raster_info", "raster_problems", "raster_stack", "read_rasters", "write_rasters"]
