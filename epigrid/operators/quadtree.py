"""Which polygons hold which points, where points crowd.

Cells of a grid are joined into squares of four as long as a square holds few enough points
(a quadtree, built from counts); a cell that alone holds more is dealt by salt. So no task gets more
than about ``most`` points, whatever the crowd. A leaf keeps, of every polygon whose box meets it, the edges
in its rows that lie to its left or in it, which is all that a ray to the left can meet: a point is tested
within its row, and no point is shuffled again for its edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .geometry import TOLERANCE, boxes

#: Cells a side of the coarsest squares' grid, how often they are halved, and edges that are broadcast at most.
SIDE, DEPTH, BROADCAST_EDGES = 64, 5, 200_000


def leaves(counts: DataFrame, most: int, depth: int = DEPTH) -> DataFrame:
    """(_i, _j, _k, _salts) of counts (_i, _j, _n), _n points a finest cell: the leaf of a cell is its square of
    2**_k cells a side, and has so many salts. counts has a row a cell, however many points."""
    out, level, held = counts, F.lit(0), F.col("_n")
    for k in range(1, depth + 1):
        square = Window.partitionBy(F.shiftright("_i", k), F.shiftright("_j", k))
        out = out.withColumn(f"_n{k}", F.sum("_n").over(square))
    for k in range(1, depth + 1):
        fits = F.col(f"_n{k}") <= most
        level, held = F.when(fits, F.lit(k)).otherwise(level), F.when(fits, F.col(f"_n{k}")).otherwise(held)
    return out.select("_i", "_j", level.alias("_k"), F.ceil(held / F.lit(most)).cast("int").alias("_salts"))


def _shift(c: str):
    return F.expr(f"shiftright({c}, _k)")


def located(points: DataFrame, edge: DataFrame, keys: list[str], strict: bool = False, x: str = "x", y: str = "y", poly_id: str = "poly_id", most: int = 100_000, depth: int = DEPTH) -> DataFrame:
    """(keys, poly_id) of the polygons that cover each point, or hold it strictly: what
    ``geometry.point_polygons`` gives, by another way."""
    box = boxes(edge, poly_id)
    e = box.agg(F.min("bx1"), F.max("bx2"), F.min("by1"), F.max("by2")).first()
    if e[0] is None:
        return points.select(*keys).limit(0).join(box.select(poly_id).limit(0))
    ox, oy, size = e[0], e[2], max(e[1] - e[0], e[3] - e[2], 1e-9) / SIDE / (1 << depth)
    at = lambda c, o: F.floor((c - F.lit(o)) / F.lit(size))
    placed = points.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).where(F.col("_x").between(e[0], e[1]) & F.col("_y").between(e[2], e[3]))
    placed = placed.withColumns({"_i": at(F.col("_x"), ox), "_j": at(F.col("_y"), oy)})
    tree = leaves(placed.groupBy("_i", "_j").agg(F.count(F.lit(1)).alias("_n")), most, depth)
    leaf = tree.select("_k", _shift("_i").alias("_li"), _shift("_j").alias("_lj"), "_salts").distinct()
    # Rows of squares that an edge passes, on every level; only those with leaves go on.
    sides = edge.withColumns({"_x0": F.least("x1", "x2"), "_a": at(F.least("y1", "y2"), oy), "_b": at(F.greatest("y1", "y2"), oy)})
    spread = sides.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("_lj", F.explode(F.sequence(_shift("_a"), _shift("_b"))))
    width = F.lit(size) * F.expr("shiftleft(1L, _k)")
    in_row = spread.join(leaf, ["_k", "_lj"]).join(box, poly_id)
    left, right = F.lit(ox) + F.col("_li") * width, F.lit(ox) + (F.col("_li") + 1) * width
    slack = F.lit(size * 1e-6)
    near = in_row.where((F.col("_x0") <= right + slack) & (F.col("bx1") <= right + slack) & (F.col("bx2") >= left - slack))
    parts = near.groupBy("_k", "_li", "_lj", poly_id).agg(F.first("_salts").alias("_salts"), F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"))
    parts = parts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    n_cells, n_edges = leaf.count(), edge.count()
    tree = F.broadcast(tree) if n_cells * (1 << 2 * depth) <= 1_000_000 else tree
    own = placed.join(tree, ["_i", "_j"]).withColumns({"_li": _shift("_i"), "_lj": _shift("_j"), "_salt": F.pmod(F.xxhash64(*keys), F.col("_salts")).cast("int")})
    # Each leaf can hold every edge of its rows: both bounds are known before anything is sent.
    parts = F.broadcast(parts) if n_edges * SIDE * (1 << depth) <= BROADCAST_EDGES else parts
    both = own.join(parts, ["_k", "_li", "_lj", "_salt"])
    px, py = F.col("_x"), F.col("_y")
    over = lambda s: (s.y1 > py) != (s.y2 > py)
    flat = lambda s: F.abs((s.x2 - s.x1) * (py - s.y1) - (s.y2 - s.y1) * (px - s.x1)) <= TOLERANCE
    touches = lambda s: flat(s) & px.between(F.least(s.x1, s.x2), F.greatest(s.x1, s.x2)) & py.between(F.least(s.y1, s.y2), F.greatest(s.y1, s.y2))
    # The ray goes left: edges beyond the leaf's right side are not at hand.
    behind = lambda s: F.when(over(s), (px > (s.x2 - s.x1) * (py - s.y1) / (s.y2 - s.y1) + s.x1).cast("int")).otherwise(0)
    odd = F.aggregate("_edges", F.lit(0), lambda t, s: t + behind(s)) % 2 == 1
    on = F.exists("_edges", touches)
    return both.where(~on & odd if strict else on | odd).select(*keys, poly_id)
