"""Triangulated meshes as tables: nodes, triangles, segments, dual cells, projectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sets import by_key, dealt


def structured_mesh(spark: SparkSession, columns: int, rows: int, step: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, triangles) of a rectangle cut into squares and each square in two."""
    n = spark.range((columns + 1) * (rows + 1))
    i, j = F.col("id") % (columns + 1), F.floor(F.col("id") / (columns + 1))
    nodes = n.select((F.col("id") + 1).alias("node"), (i * step).alias("x"), (j * step).alias("y"))
    squares = spark.range(columns * rows)
    a = F.floor(F.col("id") / columns) * (columns + 1) + F.col("id") % columns + 1
    corner = squares.select("id", a.alias("a"), (a + 1).alias("b"), (a + columns + 1).alias("c"), (a + columns + 2).alias("d"))
    two = corner.select("id", F.explode(F.array(F.struct(F.lit(0).alias("h"), F.col("a").alias("n1"), F.col("b").alias("n2"), F.col("d").alias("n3")), F.struct(F.lit(1).alias("h"), F.col("a").alias("n1"), F.col("d").alias("n2"), F.col("c").alias("n3")))).alias("t"))
    return nodes, two.select((F.col("id") * 2 + F.col("t.h") + 1).alias("tri"), "t.n1", "t.n2", "t.n3")


def network(triangles: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """(a, b, kind): the triangles' sides, once each, and given segments (a, b, kind)."""
    side = lambda p, q: F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    sides = triangles.select(F.explode(F.array(side("n1", "n2"), side("n2", "n3"), side("n1", "n3"))).alias("s")).select("s.a", "s.b", F.lit("edge").alias("kind")).distinct()
    return sides if segments is None else sides.unionByName(segments.select("a", "b", "kind"))


def boundary(triangles: DataFrame) -> DataFrame:
    """Sides that only one triangle has."""
    side = lambda p, q: F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    sides = triangles.select(F.explode(F.array(side("n1", "n2"), side("n2", "n3"), side("n1", "n3"))).alias("s")).select("s.a", "s.b")
    return sides.groupBy("a", "b").count().where("count = 1").select("a", "b", F.lit("boundary").alias("kind"))


def _corners(nodes: DataFrame, triangles: DataFrame) -> DataFrame:
    out, n = triangles, triangles.count()
    for k in (1, 2, 3):
        out = dealt(out, f"n{k}", count=n).join(by_key(nodes.select(F.col("node").alias(f"n{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))), f"n{k}")
    return out


def dual_areas(nodes: DataFrame, triangles: DataFrame) -> DataFrame:
    """(node, area): each node has a third of the area of its triangles."""
    t = _corners(nodes, triangles)
    area = F.abs((F.col("x2") - F.col("x1")) * (F.col("y3") - F.col("y1")) - (F.col("x3") - F.col("x1")) * (F.col("y2") - F.col("y1"))) / 2
    return t.select(F.explode(F.array("n1", "n2", "n3")).alias("node"), (area / 3).alias("a")).groupBy("node").agg(F.sum("a").alias("area"))


def dual_cells(nodes: DataFrame, triangles: DataFrame) -> DataFrame:
    """(node, wkt): the polygon through the centroids of a node's triangles and the
    midpoints of its sides, sorted by angle; a node on the boundary is a corner itself.
    A node has a handful of triangles, so its group is small. Around an inner node the cell
    has the area that ``dual_areas`` gives."""
    t = _corners(nodes, triangles)
    cx, cy = (F.col("x1") + F.col("x2") + F.col("x3")) / 3, (F.col("y1") + F.col("y2") + F.col("y3")) / 3
    point = lambda x, y: F.struct(x.alias("px"), y.alias("py"))
    middle = lambda p, q: point((F.col(f"x{p}") + F.col(f"x{q}")) / 2, (F.col(f"y{p}") + F.col(f"y{q}")) / 2)
    per = lambda k, a, b: F.struct(F.col(f"n{k}").alias("node"), point(F.col(f"x{k}"), F.col(f"y{k}")).alias("at"), F.array(point(cx, cy), middle(k, a), middle(k, b)).alias("points"), F.array(f"n{a}", f"n{b}").alias("others"))
    each = t.select(F.explode(F.array(per(1, 2, 3), per(2, 1, 3), per(3, 1, 2))).alias("c")).select("c.*")
    # All of a node at once: what its triangles share is there as often as they have it, and a neighbour that only one of them has is across the boundary.
    around = dealt(each, "node", count=3 * triangles.count()).groupBy("node").agg(F.first("at").alias("at"), F.array_distinct(F.flatten(F.collect_list("points"))).alias("ps"), F.flatten(F.collect_list("others")).alias("others"))
    outer = F.exists("others", lambda o: F.size(F.filter("others", lambda q: q == o)) == 1)
    mean = lambda c: F.aggregate("ps", F.lit(0.0), lambda a, p: a + p[c]) / F.size("ps")
    ring = around.withColumn("ps", F.when(outer, F.concat("ps", F.array("at"))).otherwise(F.col("ps"))).withColumns({"mx": mean("px"), "my": mean("py")})
    turned = F.array_sort(F.transform("ps", lambda p: F.struct(F.atan2(p["py"] - F.col("my"), p["px"] - F.col("mx")).alias("at"), p["px"].alias("px"), p["py"].alias("py"))))
    texts = F.transform(turned, lambda p: F.concat_ws(" ", p["px"].cast("string"), p["py"].cast("string")))
    return ring.withColumn("t", texts).select("node", F.concat(F.lit("POLYGON(("), F.array_join("t", ", "), F.lit(", "), F.element_at("t", 1), F.lit("))")).alias("wkt"))


def projector(points: DataFrame, nodes: DataFrame, triangles: DataFrame, row_id: str, group: str | None = None, size: float | None = None) -> DataFrame:
    """(row, node, group, weight): barycentric weights of points in the triangle that holds
    them (the lowest one on a side). Points meet triangles by the cells of a coarse grid."""
    t = _corners(nodes, triangles)
    if size is None:
        e = nodes.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        size = max(e[1] - e[0], e[3] - e[2], 1e-9) / 64
    at = lambda c: F.floor(c / size)
    spread = lambda a, b: F.explode(F.sequence(at(a), at(b)))
    tiles = t.withColumn("_i", spread(F.least("x1", "x2", "x3"), F.greatest("x1", "x2", "x3"))).withColumn("_j", spread(F.least("y1", "y2", "y3"), F.greatest("y1", "y2", "y3")))
    p = points.select(F.col(row_id).alias("row"), (F.col(group) if group else F.lit(1)).alias("group"), F.col("x").alias("_x"), F.col("y").alias("_y"), at(F.col("x")).alias("_i"), at(F.col("y")).alias("_j"))
    m = p.join(tiles, ["_i", "_j"])
    det = (F.col("y2") - F.col("y3")) * (F.col("x1") - F.col("x3")) + (F.col("x3") - F.col("x2")) * (F.col("y1") - F.col("y3"))
    w1 = ((F.col("y2") - F.col("y3")) * (F.col("_x") - F.col("x3")) + (F.col("x3") - F.col("x2")) * (F.col("_y") - F.col("y3"))) / det
    w2 = ((F.col("y3") - F.col("y1")) * (F.col("_x") - F.col("x3")) + (F.col("x1") - F.col("x3")) * (F.col("_y") - F.col("y3"))) / det
    m = m.withColumns({"w1": w1, "w2": w2}).withColumn("w3", 1 - F.col("w1") - F.col("w2")).where("least(w1, w2, w3) >= -1e-12")
    best = m.groupBy("row", "group").agg(F.min_by(F.array(*[F.struct(F.col(f"n{k}").alias("node"), F.col(f"w{k}").alias("weight")) for k in (1, 2, 3)]), "tri").alias("c"))
    return best.select("row", "group", F.explode("c").alias("c")).select("row", "c.node", "group", "c.weight")


def project_field(projection: DataFrame, field: DataFrame, mean: str = "mean") -> DataFrame:
    """(row, value): the sparse product of a projector with a field (node, group, mean)."""
    return projection.join(field.select("node", "group", F.col(mean).alias("_m")), ["node", "group"]).groupBy("row").agg(F.sum(F.col("weight") * F.col("_m")).alias("value"))
