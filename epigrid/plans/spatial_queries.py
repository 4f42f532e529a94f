"""Registered queries of polygons, meshes, rasters and the stack before a fit, each with its SQL.

Stand-ins: a cell is a customer's polygon, the domain 25 rectangles with rectangular holes, one a nation;
a stack row is an order, an entry of its matrix a line item, a latent column a part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clipping, preflight, sets, support
from ..sources import rasters, tables
from .queries import CELL, EVENTS, GRID, query, rounded, table, weekly_events

# --- polygons ------------------------------------------------------------------------------


def _ring(x, y, *corners):
    return F.array(*[F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in corners])


def _corner(spark, sf_dir):
    k = F.col("c_custkey")
    return sets.dealt(table(spark, sf_dir, "customer"), "c_custkey").select(k.alias("poly_id"), ((k * 37 % 500) / 10 + 0.013).alias("x"), ((k * 91 % 500) / 10 + 0.017).alias("y"))


def _domain(spark, sf_dir):
    a, b = F.col("n_nationkey") % 5 * 10.0, F.floor(F.col("n_nationkey") / 5) * 10.0
    outer = _ring(a, b, (1, 1), (8, 1), (8, 9), (1, 9))
    hole = _ring(a, b, (3.5, 4), (6, 4), (6, 6.25), (3.5, 6.25))
    return clipping.ring_edges(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("poly_id"), F.posexplode(F.array(outer, hole)).alias("ring", "corners")), ["poly_id"])


CORNERS = "c AS (SELECT c_custkey AS poly_id, (c_custkey * 37 % 500) / 10 + 0.013::DOUBLE AS x, (c_custkey * 91 % 500) / 10 + 0.017::DOUBLE AS y FROM customer)"
DOMAIN = """n AS (SELECT n_nationkey % 5 * 10.0::DOUBLE AS a, n_nationkey // 5 * 10.0::DOUBLE AS b FROM nation),
d AS (SELECT 1 AS s, a + 1 AS x1, a + 8 AS x2, b + 1 AS y1, b + 9 AS y2 FROM n UNION ALL SELECT -1, a + 3.5, a + 6, b + 4, b + 6.25 FROM n)"""


def _overlap(rectangles: str) -> str:
    """Area and moments of signed rectangles r(key, s, x1, x2, y1, y2) within the domain."""
    return f"""{rectangles}, o AS (SELECT key, r.s * d.s * (least(r.x2, d.x2) - greatest(r.x1, d.x1)) * (least(r.y2, d.y2) - greatest(r.y1, d.y1)) AS area, (least(r.x2, d.x2) + greatest(r.x1, d.x1)) / 2 AS mx, (least(r.y2, d.y2) + greatest(r.y1, d.y1)) / 2 AS my
FROM r JOIN d ON r.x1 < d.x2 AND d.x1 < r.x2 AND r.y1 < d.y2 AND d.y1 < r.y2), t AS (SELECT key, sum(area) AS area, sum(area * mx) AS mx, sum(area * my) AS my FROM o GROUP BY key)"""


ANGLES = _overlap("r AS (SELECT poly_id AS key, 1 AS s, x AS x1, x + 2 AS x2, y AS y1, y + 2 AS y2 FROM c UNION ALL SELECT poly_id, -1, x + 1, x + 2, y + 1, y + 2 FROM c)")


@query(f"""WITH {CORNERS}, {DOMAIN}, {ANGLES} SELECT poly_id, 3.0::DOUBLE AS full_area, round(CASE WHEN area > 1e-9 THEN area ELSE 0 END, 6) AS clipped_area, round(CASE WHEN area > 1e-9 THEN area / 3 ELSE 0 END, 6) AS clipped_ratio, coalesce(area > 1e-9, false) AS intersects,
CASE WHEN area > 1e-9 THEN round(mx / area, 6) END AS cx, CASE WHEN area > 1e-9 THEN round(my / area, 6) END AS cy FROM c LEFT JOIN t ON poly_id = key""")
def clip_to_domain(spark, sf_dir):
    """Concave cells against a domain with holes."""
    c = _corner(spark, sf_dir)
    corners = _ring(F.col("x"), F.col("y"), (0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2))
    cells = clipping.ring_edges(c.select("poly_id", F.lit(0).alias("ring"), corners.alias("corners")), ["poly_id"])
    return rounded(clipping.clip_report(cells, _domain(spark, sf_dir)), "full_area", "clipped_area", "clipped_ratio", "cx", "cy")


def _variants(spark, sf_dir):
    """Two variants of square cells with their nodes."""
    c = _corner(spark, sf_dir).withColumn("variant", F.explode(F.array(F.lit("fixed"), F.lit("legacy"))))
    c = c.withColumn("x", F.col("x") + F.when(F.col("variant") == "legacy", 0.6).otherwise(0.0))
    cells = clipping.ring_edges(c.select("variant", "poly_id", F.lit(0).alias("ring"), _ring(F.col("x"), F.col("y"), (0, 0), (2, 0), (2, 2), (0, 2)).alias("corners")), ["variant", "poly_id"])
    return cells, c.select("variant", "poly_id", (F.col("x") + 1.2).alias("x"), (F.col("y") + 0.9).alias("y"))


SQUARES = f"""{CORNERS}, {DOMAIN}, v AS (SELECT variant || ':' || poly_id AS key, variant, poly_id, x + CASE variant WHEN 'legacy' THEN 0.6 ELSE 0 END::DOUBLE AS x, y FROM c, (VALUES ('fixed'), ('legacy')) t(variant)),
{_overlap("r AS (SELECT key, 1 AS s, x AS x1, x + 2 AS x2, y AS y1, y + 2 AS y2 FROM v)")},
i AS (SELECT key, sum(s) > 0 AS inside FROM v JOIN d ON x + 1.2 BETWEEN x1 AND x2 AND y + 0.9 BETWEEN y1 AND y2 GROUP BY key),
k AS (SELECT v.*, coalesce(inside, false) AS node, coalesce(area > 1e-9, false) AS cell, CASE WHEN area > 1e-9 THEN area ELSE 0 END AS area, mx / area AS cx, my / area AS cy FROM v LEFT JOIN i USING (key) LEFT JOIN t USING (key)),
ru AS (SELECT k.*, rule FROM k, (VALUES ('legacy_intersection'), ('refactor_node_inside_intersection')) u(rule) WHERE cell AND (node OR rule = 'legacy_intersection'))"""


@query(f"""WITH {SQUARES}, g AS (SELECT variant, count(*) AS mesh_nodes, count(*) FILTER (cell) AS polygon_intersects_domain, count(*) FILTER (node) AS node_inside_domain FROM k GROUP BY variant)
SELECT variant, rule, any_value(mesh_nodes) AS mesh_nodes, any_value(mesh_nodes) AS natural_neighborhoods, any_value(polygon_intersects_domain) AS polygon_intersects_domain, any_value(node_inside_domain) AS node_inside_domain, count(*) AS tier2_polygons, 4.0::DOUBLE * count(*) AS full_area_total, round(sum(area), 4) AS clipped_area_total FROM ru JOIN g USING (variant) GROUP BY variant, rule""")
def support_variants(spark, sf_dir):
    cells, nodes = _variants(spark, sf_dir)
    classes, _ = support.classify(cells, nodes, _domain(spark, sf_dir))
    return rounded(support.summary(classes), "full_area_total", "clipped_area_total", digits=4)


@query(f"""WITH {SQUARES} SELECT variant, category, count(*) AS polygons FROM (SELECT variant, CASE WHEN node AND cell THEN 'A_node_inside_polygon_intersects' WHEN cell THEN 'B_node_outside_polygon_intersects' WHEN node THEN 'C_node_inside_polygon_disjoint' ELSE 'D_node_outside_polygon_disjoint' END AS category FROM k) GROUP BY ALL""")
def support_categories(spark, sf_dir):
    cells, nodes = _variants(spark, sf_dir)
    return support.categories(support.classify(cells, nodes, _domain(spark, sf_dir))[0])


@query(f"""WITH {SQUARES}, m AS (SELECT variant, rule, 'legacy_centroid' AS method, key, x + 1 AS px, y + 1 AS py FROM ru UNION ALL SELECT variant, rule, 'clipped_centroid', key, cx, cy FROM ru UNION ALL SELECT variant, rule, 'mesh_node', key, x + 1.2, y + 0.9 FROM ru),
h AS (SELECT variant, rule, method, key, coalesce(sum(s), 0) > 0 AS land FROM m LEFT JOIN d ON px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2 GROUP BY ALL)
SELECT variant, rule, method, count(*) AS places, count(*) AS in_full, count(*) FILTER (land) AS in_clipped, count(*) FILTER (land) AS in_domain FROM h GROUP BY ALL UNION ALL SELECT variant, rule, 'point_on_surface', count(*), count(*), count(*), count(*) FROM ru GROUP BY ALL""")
def support_places(spark, sf_dir):
    """Every cell's four places, tested against its own polygon and the domain."""
    cells, nodes = _variants(spark, sf_dir)
    domain = _domain(spark, sf_dir)
    classes, over = support.classify(cells, nodes, domain)
    p = support.representatives(classes, over, cells, domain)
    count = lambda c: F.count(F.when(F.col(c), 1))
    return p.groupBy("variant", "rule", "method").agg(F.count(F.lit(1)).alias("places"), count("inside_own_full_polygon").alias("in_full"), count("inside_own_clipped_polygon").alias("in_clipped"), count("inside_domain").alias("in_domain"))


# --- the stack before a fit ----------------------------------------------------------------

INDICES = {"week_steps": "p_size", "admin_f": "p_partkey % 50", "cattle_q": "p_size % 9 + 1", "tier1_field_group": "p_partkey % 4 + 1", "tier2_field": "p_partkey", "tier2_week": "CASE WHEN p_size % 10 <> 3 THEN p_size % 10 END"}
NUMBERS = {"north": "p_retailprice", "mintemp": "CASE WHEN p_partkey % 101 = 0 THEN cast('nan' AS double) ELSE p_retailprice END", "cattle_mid_log1p": "CASE WHEN p_partkey % 67 <> 0 THEN p_size / 2.0 END"}
TERMS = [*preflight.fixed_terms(["north", "mintemp"]), *[t for t in preflight.random_terms(nodes=150, groups=4, bins=12) if t.name in {**INDICES, **NUMBERS}]]


def _stack(spark, sf_dir):
    """Orders as rows; some have another link, another response, or no exposure."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS row", "CASE WHEN o_orderkey % 97 = 0 THEN 3 ELSE cast(o_orderkey % 2 + 1 AS int) END AS link",
        "CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 3 <> 0 THEN CASE WHEN o_orderkey % 41 = 0 THEN 2.0D ELSE cast(o_custkey % 2 AS double) END END AS y1",
        "CASE WHEN o_orderkey % 2 = 1 AND o_custkey % 5 <> 0 THEN CASE WHEN o_orderkey % 43 = 0 THEN -1.0D ELSE cast(o_totalprice AS double) END WHEN o_orderkey % 202 = 0 THEN 1.0D END AS y2",
        "CASE WHEN o_orderkey % 2 = 1 THEN cast(o_custkey % 7 AS double) END AS exposure",
    )


def _matrix(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS row", "l_partkey AS column", "CASE WHEN l_orderkey % 503 = 1 THEN double('nan') ELSE cast(l_discount AS double) END AS value")


def _latent(spark, sf_dir):
    whole = [f"cast({v} AS int) AS {k}" for k, v in INDICES.items()]
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS column", *whole, *[f"cast({v} AS double) AS {k}" for k, v in NUMBERS.items()])


STACK = """st AS (SELECT o_orderkey AS row, CASE WHEN o_orderkey % 97 = 0 THEN 3 ELSE o_orderkey % 2 + 1 END AS link,
  CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 3 <> 0 THEN CASE WHEN o_orderkey % 41 = 0 THEN 2.0 ELSE o_custkey % 2 END END AS y1,
  CASE WHEN o_orderkey % 2 = 1 AND o_custkey % 5 <> 0 THEN CASE WHEN o_orderkey % 43 = 0 THEN -1.0 ELSE o_totalprice END WHEN o_orderkey % 202 = 0 THEN 1.0 END AS y2,
  CASE WHEN o_orderkey % 2 = 1 THEN o_custkey % 7 END AS exposure FROM orders)"""
MATRIX = "a AS (SELECT l_orderkey AS row, l_partkey AS col, CASE WHEN l_orderkey % 503 = 1 THEN 'nan'::DOUBLE ELSE l_discount::DOUBLE END AS v FROM lineitem)"
LATENT = "la AS (SELECT p_partkey AS col, " + ", ".join([*[f"({v})::DOUBLE AS {k}" for k, v in INDICES.items()], *[f"({v})::DOUBLE AS {k}" for k, v in NUMBERS.items()]]) + " FROM part)"


def _checks(names: list[tuple[str, str, str]]) -> str:
    """Rows of a gate from (check, severity, expression over x)."""
    return "SELECT 'preflight' AS gate, c AS \"check\", s AS severity, CASE WHEN n = 0 THEN 'PASS' WHEN s = 'WARNING' THEN 'WARN' ELSE 'FAIL' END AS status, '0' AS expected, n::BIGINT::VARCHAR AS observed FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS c, '{s}' AS s, ({e}) AS n FROM x" for c, s, e in names) + ")"


def _shown(checks):
    return checks.select("gate", "check", "severity", "status", "expected", "observed")


RESPONSES = _checks([
    ("rows_unique", "BLOCKING", "n - u"), ("no_simultaneous_responses", "BLOCKING", "two"), ("tier1_binary_values", "BLOCKING", "b1"), ("tier2_positive_values", "BLOCKING", "b2"), ("link_type_values", "BLOCKING", "bl"),
    ("link_response_alignment", "BLOCKING", "al"), ("tier1_exposure_semantics", "BLOCKING", "e1"), ("tier2_active_exposure", "BLOCKING", "e2"),
])


@query(f"""WITH {STACK}, x AS (SELECT count(*) AS n, count(DISTINCT row) AS u, count(*) FILTER (y1 IS NOT NULL AND y2 IS NOT NULL) AS two, count(*) FILTER (y1 NOT IN (0, 1)) AS b1, count(*) FILTER (y2 <= 0) AS b2, count(*) FILTER (link NOT IN (1, 2)) AS bl,
count(*) FILTER ((y1 IS NOT NULL AND link <> 1) OR (y2 IS NOT NULL AND link <> 2)) AS al, count(*) FILTER (link = 1 AND exposure IS NOT NULL) AS e1, count(*) FILTER (link = 2 AND y2 IS NOT NULL AND NOT coalesce(exposure > 0, false)) AS e2 FROM st) {RESPONSES}""")
def preflight_responses(spark, sf_dir):
    return _shown(preflight.response_checks(_stack(spark, sf_dir)))


PROJECTION = _checks([
    ("A_dimensions", "BLOCKING", "0"), ("A_row_count", "BLOCKING", "strange"), ("A_column_bounds", "BLOCKING", "outside"), ("A_finite_entries", "BLOCKING", "bad"), ("active_nonzero_rows", "BLOCKING", "zero"), ("field_row_sums", "WARNING", "off"), ("A_repeated_entries", "BLOCKING", "again"),
])


@query(f"""WITH {STACK}, {MATRIX}, g AS (SELECT row, count(*) FILTER (col NOT BETWEEN 1 AND 150) AS outside, count(*) FILTER (isnan(v)) AS bad, sum(v) FILTER (NOT isnan(v)) AS total, count(*) FILTER (col BETWEEN 1 AND 100) AS inf, sum(v) FILTER (col BETWEEN 1 AND 100 AND NOT isnan(v)) AS w FROM a GROUP BY row),
j AS (SELECT g.*, st.row IS NULL AS strange, y1 IS NOT NULL OR y2 IS NOT NULL AS active FROM g FULL JOIN st ON g.row = st.row),
x AS (SELECT count(*) FILTER (strange) AS strange, sum(outside) AS outside, sum(bad) AS bad, count(*) FILTER (active AND coalesce(total, 0) = 0) AS zero, count(*) FILTER (inf > 0 AND NOT coalesce(abs(w - 1) <= 1e-10, false)) AS off, (SELECT count(*) - count(DISTINCT (row, col)) FROM a) AS again FROM j) {PROJECTION}""")
def preflight_projection(spark, sf_dir):
    return _shown(preflight.projection_checks(_stack(spark, sf_dir), _matrix(spark, sf_dir), 150, (1, 100)))


MASK = {"tier1": "link = 1 AND y1 IS NOT NULL", "tier2": "link = 2 AND y2 IS NOT NULL", "tier1_rows": "link = 1", "tier2_rows": "link = 2", "any": "y1 IS NOT NULL OR y2 IS NOT NULL"}
NONE = "NULL::INTEGER"
METRICS = f"{STACK}, {MATRIX}, {LATENT}, m AS (" + " UNION ALL ".join(f"""SELECT '{t.name}' AS term, '{t.active}' AS mask, {str(t.whole).lower()} AS whole, {t.least if t.least is not None else NONE} AS least, {t.most if t.most is not None else NONE} AS most, {t.levels or NONE} AS levels, {str(t.contiguous).lower()} AS contiguous, (SELECT count(*) FROM st WHERE {MASK[t.active]}) AS active_rows,
(SELECT count(*) FROM st WHERE {MASK[t.active]}) - count(DISTINCT row) AS unprojected_rows, count(DISTINCT col) FILTER (NOT isnan(v)) AS finite_count, count(DISTINCT col) FILTER (isnan(v)) AS nonfinite_count, count(DISTINCT col) FILTER (abs(v - round(v)) > 1.5e-8 AND NOT isnan(v)) AS fractions, count(DISTINCT col) FILTER (v < {t.least if t.least is not None else 'NULL'}) AS below, count(DISTINCT col) FILTER (v > {t.most if t.most is not None else 'NULL'} AND NOT isnan(v)) AS above,
count(DISTINCT v) FILTER (NOT isnan(v)) AS unique_count, min(v) FILTER (NOT isnan(v)) AS minimum, max(v) FILTER (NOT isnan(v)) AS maximum FROM (SELECT a.row, a.col, la.{t.name} AS v FROM a JOIN st ON a.row = st.row JOIN la ON a.col = la.col WHERE a.v <> 0 AND ({MASK[t.active]}) AND la.{t.name} IS NOT NULL)""" for t in TERMS) + ")"


@query(f"WITH {METRICS} SELECT * EXCLUDE (mask, whole, least, most, levels, contiguous) FROM m")
def preflight_terms(spark, sf_dir):
    return preflight.term_metrics(_stack(spark, sf_dir), _matrix(spark, sf_dir), _latent(spark, sf_dir), TERMS).drop("mask", "whole", "least", "most", "levels", "contiguous")


@query(f"""WITH {METRICS}, x AS (SELECT term, unnest([{{'name': 'active_finite', 'w': true, 'n': nonfinite_count + unprojected_rows}}, {{'name': 'active_values', 'w': true, 'n': (finite_count = 0)::BIGINT}}, {{'name': 'integer_valued', 'w': whole, 'n': fractions}}, {{'name': 'minimum', 'w': least IS NOT NULL, 'n': below}}, {{'name': 'maximum', 'w': most IS NOT NULL, 'n': above}},
{{'name': 'levels', 'w': levels IS NOT NULL, 'n': abs(levels - unique_count) + below + (maximum > levels)::BIGINT}}, {{'name': 'contiguous_levels', 'w': contiguous, 'n': (maximum - minimum + 1 - unique_count)::BIGINT}}]) AS r FROM m)
SELECT 'preflight' AS gate, term || '_' || r.name AS "check", 'BLOCKING' AS severity, CASE WHEN r.n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, '0' AS expected, r.n::VARCHAR AS observed FROM x WHERE r.w""")
def preflight_indices(spark, sf_dir):
    return _shown(preflight.term_checks(preflight.term_metrics(_stack(spark, sf_dir), _matrix(spark, sf_dir), _latent(spark, sf_dir), TERMS)))


CURVE = _checks([
    ("cattle_q_feature_support", "BLOCKING", "(SELECT 12 - count(DISTINCT q) FROM u WHERE q IS NOT NULL) + all_rows - seen"), ("cattle_q_active_structural_support", "BLOCKING", "greatest(5 - active, 0)"),
    ("cattle_q_active_occupancy", "WARNING", "12 - active"), ("cattle_mid_log1p_feature_alignment", "BLOCKING", "apart"),
])


@query(f"""WITH {STACK}, {MATRIX}, {LATENT}, u AS (SELECT st.row, a.col, cattle_q AS q, cattle_mid_log1p AS mid, y2 IS NOT NULL AS act FROM a JOIN st ON a.row = st.row JOIN la ON a.col = la.col WHERE a.v <> 0 AND link = 2),
x AS (SELECT (SELECT count(*) FROM st WHERE link = 2) AS all_rows, count(DISTINCT row) FILTER (q IS NOT NULL) AS seen, count(DISTINCT q) FILTER (act) AS active, count(DISTINCT col) FILTER ((q IS NULL) <> (mid IS NULL)) AS apart FROM u) {CURVE}""")
def preflight_curve(spark, sf_dir):
    return _shown(preflight.curve_support(_stack(spark, sf_dir), _matrix(spark, sf_dir), _latent(spark, sf_dir), 12))


# --- rasters -------------------------------------------------------------------------------


def _weekly_rasters(spark, sf_dir) -> str:
    """The events' values summed by week and cell, written as one GeoTIFF a week."""
    e = weekly_events(spark, sf_dir).withColumn("cell_id", GRID.cell("x", "y")).where("cell_id is not null")
    sums = e.groupBy("epiyear", "epiweek", "cell_id").agg(F.round(F.sum("value"), 6).alias("value"))
    named = sums.select(F.format_string("count_y%04d_w%02d", "epiyear", "epiweek").alias("raster"), "cell_id", "value")
    path = tables.scratch_folder(spark, "rasters")
    rasters.write_rasters(named, GRID, path, crs="EPSG:5070", strip_cells=40)
    return path


WEEKLY = f"{EVENTS}, r AS (SELECT epiyear, epiweek, {CELL} AS cell_id, value FROM e), s AS (SELECT epiyear, epiweek, cell_id, round(sum(value), 6) AS value FROM r WHERE cell_id IS NOT NULL GROUP BY ALL), w AS (SELECT epiyear, epiweek, 'y' || lpad(epiyear::VARCHAR, 4, '0') || '_w' || lpad(epiweek::VARCHAR, 2, '0') AS label, row_number() OVER (ORDER BY epiyear, epiweek)::INTEGER AS layer FROM (SELECT DISTINCT epiyear, epiweek FROM s))"


@query(f"WITH {WEEKLY} SELECT layer, label, epiyear, epiweek, cell_id, value + 0.0 AS value FROM s JOIN w USING (epiyear, epiweek)")
def raster_round_trip(spark, sf_dir):
    """Weekly rasters written by tasks, read back and stacked by week."""
    cells = rasters.read_rasters(spark, _weekly_rasters(spark, sf_dir), cells_per_partition=80)
    return rasters.raster_stack(cells).where("value is not null").withColumn("value", F.col("value") + F.lit(0.0))


@query(f"WITH {WEEKLY} SELECT label, 10 AS rows, 10 AS cols, 0.0::DOUBLE AS xmin, 10.0::DOUBLE AS xmax, 'EPSG:5070' AS crs, 3 AS blocks, CASE WHEN epiweek % 2 = 0 THEN 'other coordinate system' ELSE 'other geometry than the template' END AS problem FROM w")
def raster_geometry(spark, sf_dir):
    """Odd weeks are held against a template of another shape, even ones against another system."""
    info = rasters.raster_info(spark, _weekly_rasters(spark, sf_dir))
    label = F.regexp_extract("path", r"count_(y\d+_w\d+)\.tif$", 1)
    even = F.substring(label, -2, 2).cast("int") % 2 == 0
    template = info.select(*[(F.col(c) + 1).alias(c) if c == "rows" else F.col(c) for c in info.columns])
    found = rasters.raster_problems(info.where(even), "EPSG:4326").unionByName(rasters.raster_problems(info.where(~even), "epsg:5070", template))
    return info.join(found, "path").select(label.alias("label"), "rows", "cols", "xmin", "xmax", "crs", "blocks", "problem")
