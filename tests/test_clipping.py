"""Overlays against counts of a fine raster of places, over odd shapes; support rules."""

import math
import random

import numpy as np
import pytest

from epigrid.functions.places import Grid
from epigrid.operators import clipping, geometry, quadtree, support


def inside(rings, x, y):
    """Even-odd membership of arrays of places."""
    out = np.zeros(np.shape(x), bool)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if y1 != y2:
                out ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return out


def star(rng, cx, cy, r, n):
    """A concave ring."""
    at = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + r * s * math.cos(a), cy + r * s * math.sin(a)) for a in at for s in [rng.uniform(0.4, 1)]]


def frame(spark, polygons):
    rows = [(k, i, [(float(x), float(y)) for x, y in ring]) for k, rings in polygons.items() for i, ring in enumerate(rings)]
    return clipping.ring_edges(spark.createDataFrame(rows, "poly_id int, ring int, corners array<struct<x:double,y:double>>"), ["poly_id"])


@pytest.mark.parametrize("size", [None, 0.7, 3.1])
def test_areas_equal_a_raster_count(spark, size):
    rng = random.Random(7)
    cells = {k: [star(rng, rng.uniform(0, 10), rng.uniform(0, 10), 1.5, 9)] for k in range(25)}
    cells[3].append([(x * 0.2 + 4, y * 0.2 + 4) for x, y in [(0, 0), (1, 0), (1, 1), (0, 1)]])  # a ring of its own elsewhere
    domain = {100: [star(rng, 5, 5, 6, 40), [(4, 4), (6, 4.5), (6.5, 6), (4.2, 5.9)]], 101: [[(11, 11), (14, 11), (14, 14)]]}
    got = {r.poly_id: r for r in clipping.clip_report(frame(spark, cells), frame(spark, domain), size).collect()}
    n = 1400
    x, y = np.meshgrid((np.arange(n) + 0.5) / n * 13 - 1.5, (np.arange(n) + 0.5) / n * 13 - 1.5)
    land = inside(domain[100], x, y) | inside(domain[101], x, y)
    assert sorted(got) == sorted(cells)
    for k, rings in cells.items():
        hit = inside(rings, x, y) & land
        area = hit.sum() * (13 / n) ** 2
        assert got[k].clipped_area == pytest.approx(area, abs=0.03)
        assert got[k].intersects == (got[k].clipped_area > 0) and (area < 0.001 or got[k].intersects)
        if area > 0.2:
            assert (got[k].cx, got[k].cy) == pytest.approx((x[hit].mean(), y[hit].mean()), abs=0.02)


def test_tiles_of_any_size_agree(spark):
    rng = random.Random(3)
    cells = {k: [star(rng, rng.uniform(0, 4), rng.uniform(0, 4), 1, 7)] for k in range(8)}
    domain = {9: [star(rng, 2, 2, 3, 25)]}
    runs = [sorted((r.poly_id, r.clipped_area) for r in clipping.clip_report(frame(spark, cells), frame(spark, domain), s).collect()) for s in (0.3, 1.0, 50.0)]
    for other in runs[1:]:
        assert [a for _, a in other] == pytest.approx([a for _, a in runs[0]], rel=1e-9, abs=1e-12)


def square(x, y, w=1.0, h=None):
    return [(x, y), (x + w, y), (x + w, y + (h or w)), (x, y + (h or w))]


def test_whole_touching_disjoint_equal_and_hole(spark):
    domain = {0: [square(0, 0, 10), square(4, 4, 2)]}
    cells = {
        1: [square(1, 1)], 2: [square(10, 0)], 3: [square(10, 10)], 4: [square(10.5, 0)], 5: [square(4.5, 4.5)], 6: [square(4, 4, 2)],
        7: [square(0, 0, 10), square(4, 4, 2)], 8: [square(-5, -5, 30)], 9: [square(3, 3, 4), square(3.5, 3.5, 3)], 10: [square(9.5, 3)], 11: [list(reversed(square(1, 1)))],
    }
    got = {r.poly_id: (round(r.clipped_area, 9), r.intersects) for r in clipping.clip_report(frame(spark, cells), frame(spark, domain)).collect()}
    assert got == {1: (1, True), 2: (0, True), 3: (0, True), 4: (0, False), 5: (0, False), 6: (0, True), 7: (96, True), 8: (96, True), 9: (16 - 9, True), 10: (0.5, True), 11: (1, True)}


def test_no_polygons(spark):
    one, none = frame(spark, {1: [square(0, 0)]}), frame(spark, {1: [square(0, 0)]}).where("false")
    assert [(r.clipped_area, r.intersects) for r in clipping.clip_report(one, none).collect()] == [(0.0, False)]
    assert clipping.clip_report(none, one).collect() == [] and clipping.surface_points(clipping.overlay(none, one)).collect() == []


def test_points_on_surface_and_shapes(spark):
    rng = random.Random(11)
    cells = {k: [star(rng, rng.uniform(0, 8), rng.uniform(0, 8), 2, 8)] for k in range(12)}
    domain = {0: [star(rng, 4, 4, 5, 30), square(3, 3, 2)]}
    over = clipping.overlay(frame(spark, cells), frame(spark, domain))
    points = {r.a: (r.x, r.y) for r in clipping.surface_points(over).collect()}
    areas = {r.a: r.area for r in clipping.shared(over).where("area > 0").collect()}
    assert points.keys() == areas.keys()
    for k, (x, y) in points.items():
        assert inside(cells[k], np.array(x), np.array(y)) and inside(domain[0], np.array(x), np.array(y))
    texts = clipping.shape_texts(over).withColumnRenamed("a", "cell")
    back = geometry.polygon_areas(geometry.edges(texts.selectExpr("cell * 100000 + n as k", "wkt"), "k"), "k").collect()
    assert sum(r.area for r in back) == pytest.approx(sum(areas.values()), rel=1e-9)


def test_support_of_mesh_variants(spark):
    """Two variants of square cells against a square domain: classes, rules, places."""
    rows, nodes = [], []
    for v, shift in (("fixed", 0.0), ("legacy", 0.6)):
        for k in range(9):
            x, y = (k % 3) * 2 + shift, (k // 3) * 2.0
            rows.append((v, k, 0, [(float(a), float(b)) for a, b in square(x, y, 2)]))
            nodes.append((v, k, x + 1.0, y + 1.0))
    cells = clipping.ring_edges(spark.createDataFrame(rows, "variant string, poly_id int, ring int, corners array<struct<x:double,y:double>>"), ["variant", "poly_id"])
    domain = frame(spark, {0: [square(0, 0, 4.5, 4)]})
    classes, over = support.classify(cells, spark.createDataFrame(nodes, "variant string, poly_id int, x double, y double"), domain)
    got = {(r.variant, r.poly_id): (r.category[0], round(r.clipped_area, 9)) for r in classes.collect()}
    want = {}
    for v, shift in (("fixed", 0.0), ("legacy", 0.6)):
        for k in range(9):
            x, y = (k % 3) * 2 + shift, (k // 3) * 2.0
            area = max(0.0, min(x + 2, 4.5) - x) * max(0.0, min(y + 2, 4) - y)
            node, touch = x + 1 <= 4.5 and y + 1 <= 4, x <= 4.5 and y <= 4
            want[v, k] = ({(True, True): "A", (False, True): "B", (True, False): "C", (False, False): "D"}[node, touch], round(area, 9))
    assert got == want
    table = {(r.variant, r.rule): r for r in support.summary(classes).collect()}
    assert len(table) == 4
    for (v, rule), r in table.items():
        keep = [k for (w, k), (c, _) in want.items() if w == v and (c in "AB" if rule == support.RULES[0] else c == "A")]
        assert (r.mesh_nodes, r.natural_neighborhoods) == (9, 9) and r.full_area_total == pytest.approx(4.0 * len(keep))
        assert r.clipped_area_total == pytest.approx(sum(want[v, k][1] for k in keep)) and r.tier2_polygons == sum(want[v, k][1] > 0 for k in keep)
    raster = spark.range(1, 101).selectExpr("id as cell_id", "cast(case when id > 50 then 1 end as double) as value")  # the lower half
    places = support.representatives(classes, over, cells, domain, (raster, Grid(10, 10, 0.0, 10.0, 0.0, 10.0))).collect()
    assert {r.method for r in places} == set(support.METHODS) and {r.rule for r in places} == set(support.RULES)
    for r in places:
        x0 = (r.poly_id % 3) * 2 + (0.6 if r.variant == "legacy" else 0.0)
        assert r.inside_own_full_polygon == (x0 <= r.x <= x0 + 2) and r.inside_domain == (r.x <= 4.5 and r.y <= 4)
        assert r.inside_own_clipped_polygon or r.method in ("legacy_centroid", "mesh_node")
        assert r.valid_template_support == (0.5 <= r.x and 0.5 <= r.y <= 4.5)
    counted = {(r.variant, r.category): r.polygons for r in support.categories(classes).collect()}
    assert sum(counted.values()) == 18


def test_weekly_gaps(spark):
    g = Grid(4, 4, 0.0, 4.0, 0.0, 4.0)
    places = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.5, 3.5)], "k int, x double, y double")
    rows = [("t", 2024, w, c, None if (w == 2 and c == 9) or (w == 3 and c in (9, 10, 13, 14, 4)) or w == 4 else float(c)) for w in range(1, 5) for c in range(1, 17)]
    values = spark.createDataFrame(rows, "variable string, epiyear int, epiweek int, cell_id long, value double")
    got = {r.k: r for r in support.weekly_gaps(places, values, g, 1.0, ["k"]).collect()}
    assert (got[1].weeks_affected, got[1].fallback_success_weeks, got[1].unresolved_weeks) == (3, 1, 2)  # week 2 has three cells left
    assert (got[2].weeks_affected, got[2].fallback_success_weeks) == (2, 1)
    assert got[1].nearest_min_km == pytest.approx(math.sqrt(0.5)) and got[2].nearest_median_km == pytest.approx(1.0)


def test_crowded_points_go_to_many_small_leaves(spark):
    """Against the plain way; half of the points stand at one place, which no square can split."""
    rng = random.Random(2)
    domain = frame(spark, {k: [star(rng, rng.uniform(0, 10), rng.uniform(0, 10), 2.5, 14)] for k in range(6)} | {50: [square(2, 2, 6), square(4, 4, 2)]})
    spots = [(i, rng.uniform(-1, 11), rng.uniform(-1, 11)) for i in range(600)] + [(i, 4.0, 3.0) for i in range(600, 900)] + [(i, 4.001 + rng.random() / 1000, 3.0) for i in range(900, 1200)] + [(1200, 2.0, 2.0), (1201, 4.0, 5.0), (1202, 8.0, 8.0)]
    points = spark.createDataFrame(spots, "k long, x double, y double")
    for strict in (False, True):
        want = {tuple(r) for r in geometry.point_polygons(points, domain, ["k"], strict).collect()}
        for most in (10, 200, 10_000):
            assert {tuple(r) for r in quadtree.located(points, domain, ["k"], strict, most=most).collect()} == want
    counts = spark.createDataFrame([(0, 0, 5), (1, 0, 4), (2, 2, 1), (31, 31, 300)], "_i long, _j long, _n long")
    got = {(r._i, r._j): (r._k, r._salts) for r in quadtree.leaves(counts, 10).collect()}
    assert got == {(0, 0): (4, 1), (1, 0): (4, 1), (2, 2): (4, 1), (31, 31): (0, 30)}
    assert quadtree.located(points, domain.where("false"), ["k"]).collect() == []
