"""What two tables of polygons share: areas, flags and shapes, holes and concave rings included.

Polygons are edge tables, as in ``geometry``; a place is inside where an odd number of a
polygon's edges lies below it, whatever ring they belong to. Both tables are cut along the
tiles of one grid, so a polygon of any size is worked on in pieces, each beside the few that
share its tile. A tile needs a polygon's edges within it and whether its corner is inside,
which follows from the edges that cross the tile's row.

Within a tile, the x of all ends and meetings cuts it into upright slabs in which no two
edges cross. Edges are sorted by height in each slab and counted from below; between two of
them the shared part, where both counts are odd, is a trapezoid. Areas and moments of
trapezoids are sums, so nothing has to be joined together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import TOLERANCE, boxes, polygon_areas
from .sets import by_key, dealt

#: Where the grid begins, in tiles: off the round numbers that corners tend to have.
SHIFT = (-0.6180339887498949, -0.41421356237309515)
SHAPE = "x1 double, x2 double, lo1 double, lo2 double, hi1 double, hi2 double"


def tile_size(edge: DataFrame, poly_id: str = "poly_id") -> float:
    """One and a half times the mean side of the polygons' boxes."""
    side = boxes(edge, poly_id).agg(F.avg(F.greatest(F.col("bx2") - F.col("bx1"), F.col("by2") - F.col("by1")))).first()[0]
    return 1.5 * side if side else 1.0


def ring_edges(rings: DataFrame, keys: list[str], ring: str = "ring", corners: str = "corners") -> DataFrame:
    """The edge table (keys, ring, x1, y1, x2, y2) of rings given as arrays of (x, y), closed or not."""
    c = F.col(corners)
    closed = F.when(F.element_at(c, 1) == F.element_at(c, -1), c).otherwise(F.concat(c, F.slice(c, 1, 1)))
    sides = F.zip_with(F.slice("_c", 1, F.size("_c") - 1), F.slice("_c", 2, F.size("_c") - 1), lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))
    return rings.select(*keys, F.col(ring).alias("ring"), closed.alias("_c")).where(F.size("_c") > 1).select(*keys, "ring", F.explode(sides).alias("_s")).select(*keys, "ring", "_s.*")


def _line(k: Column, origin: float, size: float) -> Column:
    return F.lit(origin) + k * F.lit(size)


def _cell(v: Column, origin: float, size: float) -> Column:
    return F.floor((v - F.lit(origin)) / F.lit(size))


def _rising(edge: DataFrame, poly_id: str) -> DataFrame:
    """(poly, ax, ay, bx, by) of the edges, from left to right (upwards where upright)."""
    turned = (F.col("x1") > F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") > F.col("y2")))
    pick = lambda p, q: F.when(turned, F.col(q)).otherwise(F.col(p))
    return edge.select(F.col(poly_id).alias("poly"), pick("x1", "x2").alias("ax"), pick("y1", "y2").alias("ay"), pick("x2", "x1").alias("bx"), pick("y2", "y1").alias("by")).where("ax <> bx or ay <> by")


def _x_at(y: Column) -> Column:
    return F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))


def _y_at(x: Column) -> Column:
    return F.when(x == F.col("ax"), F.col("ay")).when(x == F.col("bx"), F.col("by")).otherwise(F.col("ay") + (x - F.col("ax")) * (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax")))


def edge_pieces(rising: DataFrame, size: float) -> DataFrame:
    """(poly, i, j, piece) of the edges cut along the grid; a piece runs from left to right."""
    ox, oy = (s * size for s in SHIFT)
    ax, bx = F.col("ax"), F.col("bx")
    columns = rising.withColumn("i", F.explode(F.sequence(_cell(ax, ox, size), _cell(bx, ox, size))))
    xa, xb = F.greatest(ax, _line(F.col("i"), ox, size)), F.least(bx, _line(F.col("i") + 1, ox, size))
    upright = ax == bx
    columns = columns.withColumns({"xa": xa, "xb": xb}).where("xa <= xb")
    columns = columns.withColumns({"ya": F.when(upright, F.col("ay")).otherwise(_y_at(F.col("xa"))), "yb": F.when(upright, F.col("by")).otherwise(_y_at(F.col("xb")))})
    rows = columns.withColumn("j", F.explode(F.sequence(_cell(F.least("ya", "yb"), oy, size), _cell(F.greatest("ya", "yb"), oy, size))))
    low, high = _line(F.col("j"), oy, size), _line(F.col("j") + 1, oy, size)

    def end(x: str, y: str) -> Column:
        v = F.col(y)
        return F.when(v < low, F.struct(_x_at(low).alias("x"), low.alias("y"))).when(v > high, F.struct(_x_at(high).alias("x"), high.alias("y"))).otherwise(F.struct(F.col(x).alias("x"), v.alias("y")))

    cut = rows.withColumns({"a": end("xa", "ya"), "b": end("xb", "yb")})
    return cut.select("poly", "i", "j", F.struct(F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2")).alias("piece"))


def row_crossings(rising: DataFrame, size: float) -> DataFrame:
    """(poly, i, j, x): where edges cross the lower side of the tiles of row j. An edge
    holds its lower end and not its upper one, so a corner on the line counts once or twice, as it must."""
    ox, oy = (s * size for s in SHIFT)
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    lines = rising.withColumn("j", F.explode(F.sequence(_cell(low, oy, size), _cell(high, oy, size) + 1)))
    y = _line(F.col("j"), oy, size)
    met = lines.where((low <= y) & (y < high)).withColumn("x", _x_at(y))
    return met.select("poly", _cell(F.col("x"), ox, size).alias("i"), "j", "x")


def inner_corners(crossings: DataFrame, size: float, first: int, last: int) -> DataFrame:
    """(poly, i, j) of the tiles from column first to last whose lower left corner is inside:
    those between the odd and the even crossings of their row."""
    ox = SHIFT[0] * size
    along = Window.partitionBy("poly", "j").orderBy("x")
    spans = crossings.select("poly", "j", "x", F.row_number().over(along).alias("n"), F.lead("x").over(along).alias("until")).where("n % 2 = 1 and until is not null")
    spans = spans.withColumns({"from": F.greatest(_cell(F.col("x"), ox, size), F.lit(first)), "to": F.least(_cell(F.col("until"), ox, size) + 1, F.lit(last))}).where("from <= to")
    corner = _line(F.col("i"), ox, size)
    return spans.withColumn("i", F.explode(F.sequence("from", "to"))).where((corner > F.col("x")) & (corner <= F.col("until"))).select("poly", "i", "j")


def tiles(edge: DataFrame, size: float, poly_id: str = "poly_id", columns: tuple[int, int] = (-(1 << 60), 1 << 60)) -> DataFrame:
    """(poly, i, j, pieces, crossings, corner): what each tile has of each polygon."""
    rising = _rising(edge, poly_id)
    crossings = row_crossings(rising, size)
    kind = "struct<x1:double,y1:double,x2:double,y2:double>"
    empty = lambda t: F.lit(None).cast(t)
    parts = edge_pieces(rising, size).select("poly", "i", "j", "piece", empty("double").alias("x"), F.lit(False).alias("corner"))
    parts = parts.unionByName(crossings.select("poly", "i", "j", empty(kind).alias("piece"), "x", F.lit(False).alias("corner")))
    parts = parts.unionByName(inner_corners(crossings, size, *columns).select("poly", "i", "j", empty(kind).alias("piece"), empty("double").alias("x"), F.lit(True).alias("corner")))
    within = parts.where(F.col("i").between(*columns))
    return within.groupBy("poly", "i", "j").agg(F.collect_list("piece").alias("pieces"), F.collect_list("x").alias("crossings"), F.max("corner").alias("corner"))


def _meeting(a: Column, b: Column) -> Column:
    """x where two pieces meet, if they are not parallel. Most pairs are apart, which comparisons show."""
    dx, dy, ex, ey = a.x2 - a.x1, a.y2 - a.y1, b.x2 - b.x1, b.y2 - b.y1
    turn = dx * ey - dy * ex
    t = ((b.x1 - a.x1) * ey - (b.y1 - a.y1) * ex) / turn
    u = ((b.x1 - a.x1) * dy - (b.y1 - a.y1) * dx) / turn
    return F.when(_near(a, b), F.when(turn != 0, F.when(t.between(0, 1) & u.between(0, 1), a.x1 + t * dx)))


def _near(a: Column, b: Column) -> Column:
    """Whether the boxes of two pieces meet."""
    upright = (F.greatest(F.least(a.y1, a.y2), F.least(b.y1, b.y2)) <= F.least(F.greatest(a.y1, a.y2), F.greatest(b.y1, b.y2)) + TOLERANCE)
    return (a.x1 <= b.x2 + TOLERANCE) & (b.x1 <= a.x2 + TOLERANCE) & upright


def _touching(a: Column, b: Column) -> Column:
    """Whether two pieces have a point in common, parallel ones included."""
    dx, dy = a.x2 - a.x1, a.y2 - a.y1
    off = lambda x, y: F.abs(dx * (y - a.y1) - dy * (x - a.x1)) <= TOLERANCE
    return _near(a, b) & (_meeting(a, b).isNotNull() | (off(b.x1, b.y1) & off(b.x2, b.y2)))


def overlay(a: DataFrame, b: DataFrame, size: float | None = None, a_id: str = "poly_id", b_id: str = "poly_id") -> DataFrame:
    """(a, b, i, j, touches, shapes): for every tile and pair of polygons of two edge tables
    that both have a part in it, whether their edges touch there, and what they share: an
    array of trapezoids with upright sides (SHAPE: from x1 to x2, between lo and hi).

    Rings may be in any order and turn either way; rings of one polygon must not cross each
    other. Polygons without edges share nothing.
    """
    size = size or tile_size(a, a_id)
    ox, oy = (s * size for s in SHIFT)
    extent = a.agg(F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.count(F.lit(1))).first()
    columns = (0, -1) if extent[0] is None else tuple(int((v - ox) // size) + d for v, d in zip(extent[:2], (-1, 1), strict=True))
    left = tiles(a, size, a_id, columns).select(F.col("poly").alias("a"), "i", "j", F.col("pieces").alias("pa"), F.col("crossings").alias("ca"), F.col("corner").alias("ina"))
    right = tiles(b, size, b_id, columns).select(F.col("poly").alias("b"), "i", "j", F.col("pieces").alias("pb"), F.col("crossings").alias("cb"), F.col("corner").alias("inb"))
    # What follows is much work on few bytes, by which Spark would put its tasks together.
    both = dealt(left.join(right, ["i", "j"]), "a", "b", "i", "j", count=extent[2])
    meetings = F.flatten(F.transform("pa", lambda p: F.filter(F.transform("pb", lambda q: _meeting(p, q)), lambda x: x.isNotNull())))
    ends = [F.col(c)[k] for c in ("pa", "pb") for k in ("x1", "x2")]  # of all pieces
    sides = F.array(_line(F.col("i"), ox, size), _line(F.col("i") + 1, ox, size))
    both = both.withColumn("cuts", F.array_sort(F.array_distinct(F.concat(sides, *ends, meetings))))
    both = both.withColumn("touches", F.exists("pa", lambda p: F.exists("pb", lambda q: _touching(p, q))))
    slabs = F.transform(F.slice("cuts", 1, F.size("cuts") - 1), lambda x, k: F.struct(x.alias("l"), F.element_at("cuts", k + 2).alias("r")))
    bottom, top = _line(F.col("j"), oy, size), _line(F.col("j") + 1, oy, size)

    def shapes(s: Column) -> Column:
        middle = (s.l + s.r) / 2
        height = lambda e, x: e.y1 + (x - e.x1) * (e.y2 - e.y1) / (e.x2 - e.x1)

        def events(pieces: str, who: int) -> Column:
            across = F.filter(pieces, lambda e: (e.x1 <= s.l) & (e.x2 >= s.r) & (e.x1 < e.x2))
            return F.transform(across, lambda e: F.struct(height(e, middle).alias("m"), height(e, s.l).alias("l"), height(e, s.r).alias("r"), F.lit(who).alias("who")))

        end = F.array(F.struct(top.alias("m"), top.alias("l"), top.alias("r"), F.lit(2).alias("who")))
        odd = lambda c: F.size(F.filter(c, lambda x: x < middle)) % 2 == 1
        none = F.array().cast(f"array<struct<{', '.join(x.replace(' ', ':') for x in SHAPE.split(', '))}>>")
        start = F.struct((F.col("ina") != odd("ca")).alias("a"), (F.col("inb") != odd("cb")).alias("b"), bottom.alias("l"), bottom.alias("r"), none.alias("out"))

        def step(t: Column, e: Column) -> Column:
            shape = F.struct(s.l.alias("x1"), s.r.alias("x2"), t.l.alias("lo1"), t.r.alias("lo2"), e.l.alias("hi1"), e.r.alias("hi2"))
            out = F.when(t.a & t.b & (e.l + e.r > t.l + t.r), F.concat(t.out, F.array(shape))).otherwise(t.out)
            return F.struct((t.a != (e.who == 0)).alias("a"), (t.b != (e.who == 1)).alias("b"), e.l.alias("l"), e.r.alias("r"), out.alias("out"))

        ordered = F.concat(F.array_sort(F.concat(events("pa", 0), events("pb", 1))), end)
        return F.aggregate(ordered, start, step, lambda t: t.out)

    return both.select("a", "b", "i", "j", "touches", F.flatten(F.transform(slabs, shapes)).alias("shapes"))


def shape_area(s: Column) -> Column:
    return (s.x2 - s.x1) * (s.hi1 - s.lo1 + s.hi2 - s.lo2) / 2


def _moments(s: Column) -> tuple[Column, Column]:
    """The integrals of x and of y over a trapezoid."""
    w, p, q = s.x2 - s.x1, s.hi1 - s.lo1, s.hi2 - s.lo2
    mx = w * (s.x1 * (2 * p + q) + s.x2 * (p + 2 * q)) / 6
    my = w * (s.hi1 * s.hi1 + s.hi1 * s.hi2 + s.hi2 * s.hi2 - s.lo1 * s.lo1 - s.lo1 * s.lo2 - s.lo2 * s.lo2) / 6
    return mx, my


def _total(of) -> Column:
    return F.sum(F.aggregate("shapes", F.lit(0.0), lambda t, s: t + of(s)))


def shared(over: DataFrame) -> DataFrame:
    """(a, b, area, cx, cy, intersects) of an overlay: what each pair shares, its centroid
    (null without area), and whether they have any point in common, edges included."""
    sums = over.groupBy("a", "b").agg(_total(shape_area).alias("area"), _total(lambda s: _moments(s)[0]).alias("_mx"), _total(lambda s: _moments(s)[1]).alias("_my"), F.bool_or("touches").alias("_t"))
    whole = F.col("area") > 0
    return sums.select("a", "b", "area", F.when(whole, F.col("_mx") / F.col("area")).alias("cx"), F.when(whole, F.col("_my") / F.col("area")).alias("cy"), (whole | F.col("_t")).alias("intersects"))


def clip_from(over: DataFrame, cells: DataFrame, poly_id: str = "poly_id") -> DataFrame:
    """``clip_report`` of an overlay that is there already."""
    parts = shared(over).groupBy(F.col("a").alias(poly_id)).agg(
        F.sum("area").alias("clipped_area"), F.bool_or("intersects").alias("intersects"), F.sum(F.col("cx") * F.col("area")).alias("_mx"), F.sum(F.col("cy") * F.col("area")).alias("_my")
    )
    out = polygon_areas(cells, poly_id).withColumnRenamed("area", "full_area").join(by_key(parts), poly_id, "left")
    some = F.coalesce(F.col("clipped_area"), F.lit(0.0))
    return out.select(poly_id, "full_area", some.alias("clipped_area"), F.when(F.col("full_area") > 0, some / F.col("full_area")).alias("clipped_ratio"), F.coalesce("intersects", F.lit(False)).alias("intersects"), F.when(some > 0, F.col("_mx") / some).alias("cx"), F.when(some > 0, F.col("_my") / some).alias("cy"))


def clip_report(cells: DataFrame, domain: DataFrame, size: float | None = None, poly_id: str = "poly_id") -> DataFrame:
    """(poly_id, full_area, clipped_area, clipped_ratio, intersects, cx, cy) of every cell
    against a domain, both edge tables. Polygons of the domain must not overlap; (cx, cy) is
    the centroid of what is left of the cell, null where nothing is."""
    return clip_from(overlay(cells, domain, size, poly_id), cells, poly_id)


def surface_points(over: DataFrame) -> DataFrame:
    """(a, b, x, y): a place inside what each pair shares: the middle of the longest stretch of
    the upright line through the middle of its widest slab; of equals the leftmost and lowest."""
    parts = over.select("a", "b", F.explode("shapes").alias("s"))
    widest = parts.groupBy("a", "b").agg(F.max(F.struct((F.col("s.x2") - F.col("s.x1")).alias("w"), (-F.col("s.x1")).alias("neg"))).alias("best")).select("a", "b", ((-F.col("best.neg")) + F.col("best.w") / 2).alias("x"))
    s = F.col("s")
    at = lambda p, q: s[p] + (F.col("x") - s.x1) * (s[q] - s[p]) / (s.x2 - s.x1)
    cut = parts.join(by_key(widest), ["a", "b"]).where((s.x1 <= F.col("x")) & (F.col("x") <= s.x2)).select("a", "b", "x", at("lo1", "lo2").alias("lo"), at("hi1", "hi2").alias("hi"))
    # Stretches that meet at a tile's side are one.
    up = Window.partitionBy("a", "b").orderBy("lo", "hi")
    apart = F.coalesce(F.col("lo") > F.lag("hi").over(up) + TOLERANCE, F.lit(True))
    runs = cut.withColumn("apart", apart).withColumn("run", F.sum(F.col("apart").cast("int")).over(up)).groupBy("a", "b", "x", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    best = F.max(F.struct((F.col("hi") - F.col("lo")).alias("len"), (-F.col("lo")).alias("neg"), (F.col("lo") + F.col("hi")).alias("both")))
    return runs.groupBy("a", "b", "x").agg(best.alias("r")).select("a", "b", "x", (F.col("r.both") / 2).alias("y"))


def shape_texts(over: DataFrame) -> DataFrame:
    """(a, b, n, wkt): every trapezoid as a closed POLYGON, numbered from 1 from the left, and upwards."""
    parts = over.select("a", "b", F.explode("shapes").alias("s"))
    n = F.row_number().over(Window.partitionBy("a", "b").orderBy("s.x1", "s.lo1", "s.x2", "s.lo2"))
    point = lambda x, y: F.concat_ws(" ", F.col(f"s.{x}").cast("string"), F.col(f"s.{y}").cast("string"))
    ring = [point("x1", "lo1"), point("x2", "lo2"), point("x2", "hi2"), point("x1", "hi1"), point("x1", "lo1")]
    return parts.select("a", "b", n.alias("n"), F.concat(F.lit("POLYGON(("), F.concat_ws(", ", *ring), F.lit("))")).alias("wkt"))
