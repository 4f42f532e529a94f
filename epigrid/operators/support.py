"""Which cells of a mesh count as land, under several rules, and where each cell stands.

All mesh variants go through together: a cell's key is (variant, poly_id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.places import Grid
from ..sources.tables import kept
from . import clipping, geometry, grid
from .sets import by_key

#: The rules and the kinds of representative place.
RULES = ["legacy_intersection", "refactor_node_inside_intersection"]
METHODS = ["legacy_centroid", "clipped_centroid", "point_on_surface", "mesh_node"]
KEY = ["variant", "poly_id"]


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.struct(*KEY))


def category(inside: Column, intersects: Column) -> Column:
    """The four kinds of cell by its node and its polygon."""
    return (
        F.when(inside & intersects, "A_node_inside_polygon_intersects").when(~inside & intersects, "B_node_outside_polygon_intersects")
        .when(inside & ~intersects, "C_node_inside_polygon_disjoint").otherwise("D_node_outside_polygon_disjoint")
    )


def ring_centroids(edge: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y): centroids of whole polygons; holes turn the other way."""
    turn = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    sums = edge.groupBy(*keys).agg(F.sum(turn).alias("a"), F.sum((F.col("x1") + F.col("x2")) * turn).alias("mx"), F.sum((F.col("y1") + F.col("y2")) * turn).alias("my"))
    return sums.where("a <> 0").select(*keys, (F.col("mx") / (3 * F.col("a"))).alias("x"), (F.col("my") / (3 * F.col("a"))).alias("y"))


def in_own_polygon(points: DataFrame, edge: DataFrame, keys: list[str], own: list[str]) -> DataFrame:
    """(keys) of the points that the polygon of their ``own`` columns covers."""
    pairs = points.select(*keys, F.col("x").alias("px"), F.col("y").alias("py")).join(by_key(edge), own)
    px, py = F.col("px"), F.col("py")
    over = (F.col("y1") > py) != (F.col("y2") > py)
    left = F.when(over, px < (F.col("x2") - F.col("x1")) * (py - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")).otherwise(F.lit(False))
    flat = F.abs((F.col("x2") - F.col("x1")) * (py - F.col("y1")) - (F.col("y2") - F.col("y1")) * (px - F.col("x1"))) <= geometry.TOLERANCE
    on = flat & px.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & py.between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    return pairs.groupBy(*keys).agg(F.sum(left.cast("int")).alias("n"), F.bool_or(on).alias("on")).where("on or n % 2 = 1").select(*keys)


def _on_land(points: DataFrame, domain: DataFrame, keys: list[str]) -> DataFrame:
    """(keys) of the points that some polygon of the domain covers."""
    return geometry.point_polygons(points, domain.withColumnRenamed("poly_id", "domain_id"), keys, poly_id="domain_id").select(*keys).distinct()


def classify(cells: DataFrame, nodes: DataFrame, domain: DataFrame, size: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(classes, overlay). classes: variant, poly_id, node_x, node_y, full_area, clipped_area,
    clipped_full_ratio, cx, cy (centroid of the clipped part), node_inside_domain,
    polygon_intersects_domain, category. cells: edge table with variant and poly_id; nodes:
    variant, poly_id, x, y; domain: edge table of polygons that do not overlap. Both results are
    written once, to the shared folder."""
    over = kept(clipping.overlay(_keyed(cells), domain, size, "key"), "overlay")
    report = clipping.clip_from(over, _keyed(cells), "key").select("key.*", "full_area", "clipped_area", "clipped_ratio", "intersects", "cx", "cy")
    inside = _on_land(nodes, domain, KEY).withColumn("in_", F.lit(True))
    placed = nodes.select(*KEY, F.col("x").alias("node_x"), F.col("y").alias("node_y")).join(by_key(inside), KEY, "left").join(by_key(report), KEY, "left")
    a, b = F.coalesce("in_", F.lit(False)), F.coalesce("intersects", F.lit(False))
    classes = placed.select(*KEY, "node_x", "node_y", "full_area", "clipped_area", F.col("clipped_ratio").alias("clipped_full_ratio"), "cx", "cy", a.alias("node_inside_domain"), b.alias("polygon_intersects_domain"), category(a, b).alias("category"))
    return kept(classes, "classes"), over


def by_rule(classes: DataFrame) -> DataFrame:
    """The classes once for each rule that keeps them."""
    node, cell = F.col("node_inside_domain"), F.col("polygon_intersects_domain")
    kept = F.array_compact(F.array(F.when(cell, RULES[0]), F.when(node & cell, RULES[1])))
    return classes.withColumn("rule", F.explode(kept))


def summary(classes: DataFrame) -> DataFrame:
    """A row for each variant and rule: nodes, cells of each kind, cells that keep an area, and areas."""
    count = lambda c: F.count(F.when(c, 1))
    node, cell, land = F.col("node_inside_domain"), F.col("polygon_intersects_domain"), F.coalesce(F.col("clipped_area") > 0, F.lit(False))
    keeps = {RULES[0]: cell, RULES[1]: node & cell}
    one = classes.groupBy("variant").agg(
        F.count(F.lit(1)).alias("mesh_nodes"), F.count("full_area").alias("natural_neighborhoods"), count(cell).alias("polygon_intersects_domain"), count(node).alias("node_inside_domain"),
        F.array(*[F.struct(F.lit(r).alias("rule"), count(k & land).alias("tier2_polygons"), F.sum(F.when(k, F.col("full_area"))).alias("full_area_total"), F.sum(F.when(k, F.col("clipped_area"))).alias("clipped_area_total")) for r, k in keeps.items()]).alias("r"),
    )
    return one.select("variant", "mesh_nodes", "natural_neighborhoods", "polygon_intersects_domain", "node_inside_domain", F.explode("r").alias("r")).select("variant", "r.rule", "mesh_nodes", "natural_neighborhoods", "polygon_intersects_domain", "node_inside_domain", "r.tier2_polygons", "r.full_area_total", "r.clipped_area_total")


def categories(classes: DataFrame) -> DataFrame:
    return classes.groupBy("variant", "category").agg(F.count(F.lit(1)).alias("polygons"))


def representatives(classes: DataFrame, over: DataFrame, cells: DataFrame, domain: DataFrame, template: tuple[DataFrame, Grid] | None = None) -> DataFrame:
    """(variant, rule, method, poly_id, x, y, inside_own_full_polygon, inside_own_clipped_polygon,
    inside_domain, valid_template_support) of the cells that keep an area. A cell's places
    are found and tested once, whatever rules keep it. Where several polygons of the domain
    share a cell, its point on surface lies in the largest part. template: (cell_id, value) and its Grid; without
    one the last column is null."""
    land = classes.where("clipped_area > 0")
    point = lambda df, m, x="x", y="y": df.select(*KEY, F.lit(m).alias("method"), F.col(x).alias("x"), F.col(y).alias("y"))
    largest = clipping.shared(over).groupBy("a").agg(F.max_by("b", F.struct("area", "b")).alias("b"))
    surface = clipping.surface_points(over).join(by_key(largest), ["a", "b"]).select("a.*", "x", "y")
    sets = [point(ring_centroids(cells, KEY), METHODS[0]), point(land, METHODS[1], "cx", "cy"), point(surface, METHODS[2]), point(land, METHODS[3], "node_x", "node_y")]
    places = reduce(lambda p, q: p.unionByName(q), sets).join(by_key(land.select(*KEY)), KEY, "left_semi")
    keys = [*KEY, "method"]
    own = in_own_polygon(places, cells, keys, KEY).withColumn("own", F.lit(True))
    inside = _on_land(places, domain, keys).withColumn("dom", F.lit(True))
    out = places.join(by_key(own), keys, "left").join(by_key(inside), keys, "left")
    if template:
        values, cells_of = template
        out = grid.bilinear(out, values, cells_of, keys, out="seen")
    else:
        out = out.withColumn("seen", F.lit(None).cast("double"))
    full, dom = F.coalesce("own", F.lit(False)), F.coalesce("dom", F.lit(False))
    rules = by_rule(classes).select(*KEY, "rule")
    valid = F.col("seen").isNotNull() if template else F.lit(None).cast("boolean")
    return out.join(by_key(rules), KEY).select("variant", "rule", "method", "poly_id", "x", "y", full.alias("inside_own_full_polygon"), (full & dom).alias("inside_own_clipped_polygon"), dom.alias("inside_domain"), valid.alias("valid_template_support"))


def weekly_gaps(places: DataFrame, values: DataFrame, cells_of: Grid, radius: float, keys: list[str], **distance) -> DataFrame:
    """``grid.gap_summary`` of the places (keys, x, y) that some variable has no direct value for
    in some week. values: variable, epiyear, epiweek, cell_id, value; a gap takes the
    nearest valid cell within ``radius`` km of its own week."""
    week = ["variable", "epiyear", "epiweek"]
    asked = places.select(*keys, "x", "y").crossJoin(F.broadcast(values.select(*week).distinct()))  # a row a variable and week
    gaps = grid.bilinear(asked, values, cells_of, [*keys, *week], out="direct", by=week).where("direct is null")
    near = grid.nearest_valid(gaps, values, cells_of, [*keys, *week], radius, by=week, **distance)
    return grid.gap_summary(gaps.join(near, [*keys, *week], "left"), [*keys, "variable"])
