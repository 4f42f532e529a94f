"""Polygons as edge tables (poly_id, ring, x1, y1, x2, y2), and what points they hold.

A point is inside when a ray from it crosses an odd number of edges, whatever ring they
belong to, so holes need no care; on an edge it is covered, but not strictly within.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-12


def rings_of(wkt: str) -> list[np.ndarray]:
    """The rings of a POLYGON or MULTIPOLYGON."""
    return [np.array([[float(v) for v in p.split()[:2]] for p in ring.split(",")]) for ring in re.findall(r"\(([^()]+)\)", wkt)]


def edges(polygons: DataFrame, poly_id: str = "poly_id", wkt: str = "wkt") -> DataFrame:
    """The edge table of a table of well-known texts."""
    kind = polygons.schema[poly_id].dataType.simpleString()

    def split(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for key, text in zip(pdf[poly_id], pdf[wkt], strict=True):
                for i, ring in enumerate(rings_of(text or "")):
                    closed = ring if (ring[0] == ring[-1]).all() else np.vstack([ring, ring[:1]])
                    rows += [(key, i, *a, *b) for a, b in zip(closed, closed[1:], strict=False)]
            yield pd.DataFrame(rows, columns=[poly_id, "ring", "x1", "y1", "x2", "y2"])

    return polygons.select(poly_id, wkt).mapInPandas(split, f"{poly_id} {kind}, ring int, x1 double, y1 double, x2 double, y2 double")


def boxes(edge: DataFrame, poly_id: str = "poly_id") -> DataFrame:
    return edge.groupBy(poly_id).agg(F.min("x1").alias("bx1"), F.max("x1").alias("bx2"), F.min("y1").alias("by1"), F.max("y1").alias("by2"))


def point_polygons(points: DataFrame, edge: DataFrame, keys: list[str], strict: bool = False, x: str = "x", y: str = "y", poly_id: str = "poly_id", size: float | None = None) -> DataFrame:
    """(keys, poly_id) of the polygons that cover each point, or hold it strictly.

    Points and boxes meet by the cells of a coarse grid of width ``size`` (by default a
    64th of the whole extent), so that no point is compared with far polygons.
    """
    box = boxes(edge, poly_id)
    if size is None:
        e = box.agg(F.min("bx1"), F.max("bx2"), F.min("by1"), F.max("by2")).first()
        if e[0] is None:
            return points.select(*keys).limit(0).join(box.select(poly_id).limit(0))
        size = max(e[1] - e[0], e[3] - e[2], 1e-9) / 64
    at = lambda c: F.floor(c / size)
    tiles = box.withColumn("_i", F.explode(F.sequence(at(F.col("bx1")), at(F.col("bx2"))))).withColumn("_j", F.explode(F.sequence(at(F.col("by1")), at(F.col("by2")))))
    placed = points.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), at(F.col(x)).alias("_i"), at(F.col(y)).alias("_j"))
    near = placed.join(tiles, ["_i", "_j"]).where("_x between bx1 and bx2 and _y between by1 and by2").select(*keys, "_x", "_y", poly_id)
    pairs = near.join(edge, poly_id)
    px, py = F.col("_x"), F.col("_y")
    crosses = ((F.col("y1") > py) != (F.col("y2") > py)) & (px < (F.col("x2") - F.col("x1")) * (py - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    flat = F.abs((F.col("x2") - F.col("x1")) * (py - F.col("y1")) - (F.col("y2") - F.col("y1")) * (px - F.col("x1"))) <= TOLERANCE
    on = flat & px.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & py.between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    crossing = F.when((F.col("y1") > py) != (F.col("y2") > py), crosses).otherwise(F.lit(False))
    sums = pairs.groupBy(*keys, poly_id).agg(F.sum(crossing.cast("int")).alias("_n"), F.bool_or(on).alias("_on"))
    hit = (~F.col("_on") & (F.col("_n") % 2 == 1)) if strict else (F.col("_on") | (F.col("_n") % 2 == 1))
    return sums.where(hit).select(*keys, poly_id)


def assign_one(points: DataFrame, edge: DataFrame, keys: list[str], **options) -> DataFrame:
    """points with the one polygon that covers each; any other number is an error."""
    found = point_polygons(points, edge, keys, **options)
    counts = points.select(*keys).join(found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("poly_id").alias("poly_id")), keys, "left")
    bad = counts.where("coalesce(_n, 0) <> 1").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].asDict()} is in {bad[0]['_n'] or 0} polygons")
    return points.join(counts.drop("_n"), keys)


def assign_unit(points: DataFrame, edge: DataFrame, units: DataFrame, keys: list[str], unknown: str = "Unk", **options) -> DataFrame:
    """points with the alphabetically first unit that covers them; none or blank: unknown.
    units: poly_id, unit."""
    found = point_polygons(points, edge, keys, **options).join(units, "poly_id").where(F.trim("unit") != "")
    first = found.groupBy(*keys).agg(F.min("unit").alias("admin_u"))
    return points.join(first, keys, "left").withColumn("admin_u", F.coalesce("admin_u", F.lit(unknown)))


def polygon_areas(edge: DataFrame, poly_id: str = "poly_id") -> DataFrame:
    """Areas by the shoelace formula; a ring that turns the other way is a hole."""
    rings = edge.groupBy(poly_id, "ring").agg((F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("a"))
    return rings.groupBy(poly_id).agg(F.abs(F.sum("a")).alias("area"))


def clip_ring(ring: np.ndarray, window: np.ndarray) -> np.ndarray:
    """A ring cut by a convex window (counter-clockwise), side by side."""
    out = ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring
    for a, b in zip(window, np.roll(window, -1, axis=0), strict=True):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        kept = []
        for i in range(len(out)):
            p, q, s, t = out[i - 1], out[i], side[i - 1], side[i]
            if (s >= 0) != (t >= 0):
                kept.append(p + (q - p) * (s / (s - t)))
            if t >= 0:
                kept.append(q)
        out = np.array(kept).reshape(-1, 2)
    return out


def ring_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2) if len(ring) > 2 else 0.0


def clipped_areas(cells: DataFrame, domain: list[np.ndarray], cell_id: str = "poly_id", wkt: str = "wkt") -> DataFrame:
    """(cell_id, full_area, clipped_area, intersects) of convex cells against a domain of
    disjoint rings (a small, fixed outline)."""
    kind = cells.schema[cell_id].dataType.simpleString()

    def cut(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for key, text in zip(pdf[cell_id], pdf[wkt], strict=True):
                window = rings_of(text)[0]
                window = window[:-1] if (window[0] == window[-1]).all() else window
                turn = np.dot(window[:, 0], np.roll(window[:, 1], -1)) - np.dot(window[:, 1], np.roll(window[:, 0], -1))
                window = window if turn > 0 else window[::-1]
                area = sum(ring_area(clip_ring(r, window)) for r in domain)
                rows.append((key, ring_area(window), area, area > 0))
            yield pd.DataFrame(rows, columns=[cell_id, "full_area", "clipped_area", "intersects"])

    return cells.select(cell_id, wkt).mapInPandas(cut, f"{cell_id} {kind}, full_area double, clipped_area double, intersects boolean")
