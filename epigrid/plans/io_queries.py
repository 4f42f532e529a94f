"""Registered queries of sources and sinks: a given table goes out to the shared folder and comes back.

Also the queries of crowded points, meshes taken from a table, weekly gaps, and projections both ways.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import nulls, places, timeidx
from ..operators import clipping, geometry, grid, mesh, persistence, quadtree, sets, support
from ..sources import files, tables
from . import config
from .queries import CELL, EVENTS, GRID, ORACLES, query, rounded, table, weekly_events
from .spatial_queries import DOMAIN, _domain, _weekly_rasters

# --- tables out and in ---------------------------------------------------------------------


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_round_trip(spark, sf_dir):
    """A table as Parquet and CSV, both read back."""
    path = tables.scratch_folder(spark, "table")
    tables.write_table(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), path)
    kept = spark.read.parquet(f"{path}.parquet")
    return kept.unionByName(tables.read_csv(spark, f"{path}.csv", kept.schema.simpleString()[7:-1].replace(":", " ")))


@query("SELECT n_nationkey, n_name, n_regionkey, 1 AS refused FROM nation")
def lookup_round_trip(spark, sf_dir):
    """A lookup read by its key; with a key that repeats, reading is refused."""
    path = tables.scratch_folder(spark, "lookup")
    kind = dict(table(spark, sf_dir, "nation").dtypes)
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").write.option("header", True).csv(path)
    found = tables.read_lookup(spark, path, "n_nationkey", ["n_nationkey", "n_name"])
    try:
        tables.read_lookup(spark, path, "n_regionkey", ["n_regionkey"])
        refused = 0
    except ValueError:
        refused = 1
    return found.select(*[F.col(c).cast(kind[c]).alias(c) for c in ("n_nationkey", "n_name", "n_regionkey")], F.lit(refused).alias("refused"))


@query("SELECT 'nation' AS name, n_nationkey::BIGINT AS key, n_name AS label, 'nation,region' AS held FROM nation UNION ALL SELECT 'region', r_regionkey, r_name, 'nation,region' FROM region")
def bundle_round_trip(spark, sf_dir):
    path = tables.scratch_folder(spark, "bundle")
    tables.write_bundle({"nation": table(spark, sf_dir, "nation"), "region": table(spark, sf_dir, "region")}, path)
    held, facts = tables.read_bundle(spark, path)
    one = lambda n, k, v: held[n].select(F.lit(n).alias("name"), F.col(k).cast("long").alias("key"), F.col(v).alias("label"))
    return one("nation", "n_nationkey", "n_name").unionByName(one("region", "r_regionkey", "r_name")).withColumn("held", F.lit(",".join(facts["tables"])))


@query("SELECT c_custkey, c_nationkey, 1 AS refused FROM customer")
def commit_round_trip(spark, sf_dir):
    """Tables put in place by one rename; a second commit to the path is refused and changes nothing."""
    path = tables.scratch_folder(spark, "commit")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    tables.commit_tables({"customer": customer}, path)
    try:
        tables.commit_tables({"customer": customer.where("false")}, path)
        refused = 0
    except FileExistsError:
        refused = 1
    return tables.read_bundle(spark, path)[0]["customer"].withColumn("refused", F.lit(refused))


WEEKS = "o AS (SELECT isoyear(o_orderdate)::INTEGER AS epiyear, week(o_orderdate)::INTEGER AS epiweek, o_orderkey FROM orders)"


def _order_weeks(spark, sf_dir):
    return timeidx.with_week(table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate")), "day").select("epiyear", "epiweek", "o_orderkey")


@query(f"WITH {WEEKS} SELECT epiyear, epiweek, count(*) AS rows, true AS whole FROM o GROUP BY ALL")
def weekly_partitions(spark, sf_dir):
    """One partition a week with its row of the manifest: rows, and a hash that a second copy of other layout has, too."""
    orders = _order_weeks(spark, sf_dir)
    first = tables.write_weekly(orders, tables.scratch_folder(spark, "weekly"))
    second = tables.write_weekly(orders.repartition(7), tables.scratch_folder(spark, "weekly")).select("epiyear", "epiweek", F.col("sha256").alias("again"))
    return first.join(second, ["epiyear", "epiweek"]).select("epiyear", "epiweek", "rows", ((F.col("sha256") == F.col("again")) & (F.length("sha256") == 64)).alias("whole"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def json_round_trip(spark, sf_dir):
    path = tables.scratch_folder(spark, "json")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").repartition("n_nationkey").write.option("maxRecordsPerFile", 1).json(path)
    return tables.read_json_objects(spark, path, "n_nationkey long, n_name string").select("n_nationkey", "n_name")


@query("SELECT 'k' || r_regionkey AS role, 'txt' AS format, length(r_name) + 1 AS bytes, sha256(r_name || chr(10)) AS sha256, (SELECT count(*) FROM region) AS listed FROM region")
def file_manifest_round_trip(spark, sf_dir):
    """A file a region, found again by name, with role, format, size and hash."""
    path = tables.scratch_folder(spark, "files")
    region = table(spark, sf_dir, "region")
    region.select(F.col("r_name").alias("value"), F.concat(F.lit("k"), "r_regionkey").alias("role")).repartition("role").write.partitionBy("role").text(path)
    found = files.list_files(spark, path, "*.txt")
    role = F.regexp_extract("path", r"role=(k\d+)/", 1)
    return files.file_manifest(found).select(role.alias("role"), "format", "bytes", "sha256").crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("listed"))))


@query(f"WITH {EVENTS}, w AS (SELECT DISTINCT epiyear, epiweek FROM e), k AS (SELECT * FROM w QUALIFY row_number() OVER (ORDER BY epiyear, epiweek) > 1) SELECT epiyear, epiweek, 'found' AS problem FROM w UNION ALL SELECT epiyear - 1, epiweek, 'missing' FROM k WHERE (epiyear - 1, epiweek) NOT IN (SELECT (epiyear, epiweek) FROM w)")
def weekly_file_index(spark, sf_dir):
    """Weekly rasters found by name, and expected weeks that have none."""
    found = files.weekly_files(files.list_files(spark, _weekly_rasters(spark, sf_dir), "*.tif"))
    later = found.withColumn("n", F.row_number().over(Window.orderBy("epiyear", "epiweek"))).where("n > 1")  # a row a file
    expected = later.select((F.col("epiyear") - 1).alias("epiyear"), "epiweek")
    return found.select("epiyear", "epiweek", F.lit("found").alias("problem")).unionByName(files.check_weekly_files(found, expected))


@query("""SELECT 'maps/y' || (2000 + o_orderkey % 20) || '_w' || lpad((o_orderkey // 20 % 52 + 1)::VARCHAR, 2, '0') || '_' || o_orderkey AS path,
CASE WHEN o_custkey % 4 = 0 THEN 'absent' WHEN o_custkey % 4 = 1 THEN 'malformed hash' WHEN o_custkey % 4 = 2 THEN 'other content' ELSE 'repeated week' END AS problem
FROM orders WHERE o_custkey % 4 < 3 OR o_orderkey IN (SELECT o_orderkey FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderkey % 20, o_orderkey // 20 % 52) AS n FROM orders) WHERE n > 1)""")
def manifest_faults(spark, sf_dir):
    """A manifest of orders' maps against the maps: some absent, some of other content or hash, weeks that repeat."""
    week = F.expr("cast(o_orderkey div 20 % 52 + 1 as int)")
    o = table(spark, sf_dir, "orders").withColumns({"epiyear": (2000 + F.col("o_orderkey") % 20).cast("int"), "epiweek": week})
    name = F.format_string("maps/y%d_w%02d_%d", F.col("epiyear"), F.col("epiweek"), F.col("o_orderkey").cast("long"))
    kind = F.col("o_custkey") % 4
    content = F.encode(F.col("o_orderkey").cast("string"), "UTF-8")
    there = o.where(kind != 0).select(name.alias("path"), content.alias("content"))
    said = F.when(kind == 1, "no hash").when(kind == 2, F.sha2(F.lit("else"), 256)).otherwise(F.sha2(content, 256))
    return files.manifest_faults(o.select(name.alias("path"), "epiyear", "epiweek", said.alias("sha256")), there)


@query("SELECT a.epiyear, a.epiweek, a.path AS maps, b.path AS limits FROM (SELECT o_custkey AS epiyear, o_orderkey AS epiweek, 'a' || o_orderkey AS path FROM orders WHERE o_orderkey % 3 <> 0) a JOIN (SELECT o_custkey AS epiyear, o_orderkey AS epiweek, 'b' || o_orderkey AS path FROM orders WHERE o_orderkey % 5 <> 0) b USING (epiyear, epiweek)")
def paired_maps(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    one = lambda product, mark, keep: o.where(keep).select(F.lit(product).alias("product"), F.col("o_custkey").alias("epiyear"), F.col("o_orderkey").alias("epiweek"), F.concat(F.lit(mark), F.col("o_orderkey").cast("string")).alias("path"))
    return files.paired_maps(one("maps", "a", "o_orderkey % 3 <> 0").unionByName(one("limits", "b", "o_orderkey % 5 <> 0")), "maps", "limits")


@query("SELECT c_name AS path, c_custkey AS endpoint, c_nationkey AS completed_at FROM customer WHERE c_custkey % 3 = 0 ORDER BY c_custkey DESC, c_nationkey DESC, c_name DESC LIMIT 1")
def latest_portfolio(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("path"), F.col("c_custkey").alias("endpoint"), F.col("c_nationkey").alias("completed_at"), F.when(F.col("c_custkey") % 3 == 0, "complete").otherwise("running").alias("status"))
    return files.latest_portfolio(c).drop("status")


@query(f"WITH {EVENTS} SELECT event_id, round(user_id % 240 - 120.0, 6) AS lon, round((user_id * 7 % 130) - 55.0, 6) AS lat FROM e WHERE user_id % 240 - 120.0 >= -100 AND (user_id * 7 % 130) - 55.0 <= 70 AND value > 20")
def located_observations(spark, sf_dir):
    """Places in degrees, those that are none left out, projected and back again."""
    e = table(spark, sf_dir, "events").withColumns({"lon": F.when(F.col("value") > 20, (F.col("user_id") % 240 - 120).cast("double")), "lat": (F.col("user_id") * 7 % 130 - 55).cast("double")})
    e = e.withColumns({"lon": F.when(F.col("lon") < -100, F.col("lon") * 2).otherwise(F.col("lon")), "lat": F.when(F.col("lat") > 70, float("nan")).otherwise(F.col("lat"))})
    e = e.withColumn("lon", F.when(F.col("lon") < -180, F.col("lon")).when(F.col("lon") < -100, None).otherwise(F.col("lon")))
    at = {"lon0": -96.0, "lat0": 23.0, "lat1": 29.5, "lat2": 45.5}
    xy = tables.read_located(e, "lonlat", lambda lon, lat: places.albers(lon, lat, **at))
    lon, lat = places.albers_inverse("x", "y", **at)
    return rounded(xy.select("event_id", lon.alias("lon"), lat.alias("lat")), "lon", "lat")


@query("SELECT c_custkey, round((c_custkey % 600) / 10.0 - 126, 6) AS lon, round((c_custkey * 7 % 250) / 10.0 + 25, 6) AS lat, true AS near FROM customer")
def albers_round_trip(spark, sf_dir):
    """Degrees to kilometres and back, to 1e-9 degrees."""
    c = table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") % 600) / 10 - 126).alias("lon"), ((F.col("c_custkey") * 7 % 250) / 10 + 25).alias("lat"))
    at = {"lon0": -96.0, "lat0": 23.0, "lat1": 29.5, "lat2": 45.5}
    x, y = places.albers("lon", "lat", **at)
    lon, lat = places.albers_inverse("x", "y", **at)
    back = c.withColumns({"x": x, "y": y}).withColumns({"lon2": lon, "lat2": lat})
    near = (F.abs(F.col("lon") - F.col("lon2")) < 1e-9) & (F.abs(F.col("lat") - F.col("lat2")) < 1e-9)
    return rounded(back.select("c_custkey", F.col("lon2").alias("lon"), F.col("lat2").alias("lat"), near.alias("near")), "lon", "lat")


@query("SELECT s_suppkey, s_acctbal AS value FROM supplier")
def alias_columns(spark, sf_dir):
    """The first of several names that a table has."""
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", F.col(nulls.resolve_alias(s, ["balance", "s_acctbal", "s_name"])).alias("value"))


# --- grids ---------------------------------------------------------------------------------


@query(f"WITH {EVENTS}, r AS (SELECT {CELL} AS cell_id, value FROM e) SELECT i AS cell_id, round(s, 4) AS value FROM range(1, 101) t(i) LEFT JOIN (SELECT cell_id, sum(value) AS s FROM r WHERE cell_id % 7 <> 0 GROUP BY 1) ON cell_id = i")
def ascii_grid_round_trip(spark, sf_dir):
    e = weekly_events(spark, sf_dir).withColumn("cell_id", GRID.cell("x", "y")).where("cell_id % 7 <> 0").groupBy("cell_id").agg(F.sum("value").alias("value"))
    path = tables.scratch_folder(spark, "grid")
    head = [f"ncols {GRID.cols}", f"nrows {GRID.rows}", f"xllcorner {GRID.xmin}", f"yllcorner {GRID.ymin}", f"cellsize {GRID.width}", "NODATA_value -9999.0"]
    lines = files.grid_lines(e, GRID).unionByName(spark.createDataFrame([(k - 100, x) for k, x in enumerate(head)], "row long, line string"))
    lines.orderBy("row").coalesce(1).select("line").write.text(path)  # a grid's lines are few
    return rounded(files.read_ascii_grids(spark, path).select("cell_id", "value"), "value", digits=4)


WIDE = "i AS (SELECT epiyear, epiweek, user_id % 5 AS k, avg(value) FILTER (user_id % 3 = 0) AS a, avg(value) FILTER (user_id % 3 = 1) AS b FROM e GROUP BY ALL)"


@query(f"WITH {EVENTS}, {WIDE}, w AS (SELECT DISTINCT epiyear, epiweek FROM e) SELECT w.*, j::BIGINT AS k, round(a, 6) AS a, round(b, 6) AS b FROM w CROSS JOIN range(7) t(j) LEFT JOIN i ON i.epiyear = w.epiyear AND i.epiweek = w.epiweek AND i.k = j")
def joined_covariates(spark, sf_dir):
    """Long covariates as columns beside the rows that they are joined to."""
    e = weekly_events(spark, sf_dir)
    name = F.when(F.col("user_id") % 3 == 0, "a").when(F.col("user_id") % 3 == 1, "b")
    values = e.withColumn("variable", name).where("variable is not null").groupBy("epiyear", "epiweek", (F.col("user_id") % 5).alias("k"), "variable").agg(F.avg("value").alias("value"))
    rows = sets.crossing(e.select("epiyear", "epiweek").distinct(), spark.range(7).withColumnRenamed("id", "k"))
    return rounded(grid.join_covariates(rows, values, ["epiyear", "epiweek", "k"], ["a", "b"]), "a", "b")


@query(f"""WITH {EVENTS}, r AS (SELECT epiyear, epiweek, {CELL} AS cell_id, round(sum(value), 6) AS value FROM e GROUP BY ALL HAVING {CELL} IS NOT NULL), w AS (SELECT DISTINCT epiyear, epiweek FROM r), s AS (SELECT s_suppkey, (s_suppkey * 37 % 97) / 10 + 0.15 AS x, (s_suppkey * 53 % 97) / 10 + 0.15 AS y FROM supplier),
k AS (SELECT s_suppkey, w.*, floor(x - 0.5) + dc AS c, floor(9.5 - y) + dr AS r, (1 - abs(9.5 - y - floor(9.5 - y) - dr)) * (1 - abs(x - 0.5 - floor(x - 0.5) - dc)) AS wt FROM s, w, range(2) a(dr), range(2) b(dc)),
g AS (SELECT s_suppkey, epiyear, epiweek, CASE WHEN c BETWEEN 0 AND 9 AND r BETWEEN 0 AND 9 THEN r * 10 + c + 1 END AS cell_id FROM k WHERE wt > 0), d AS (SELECT g.s_suppkey, g.epiyear, g.epiweek FROM g LEFT JOIN r USING (epiyear, epiweek, cell_id) GROUP BY ALL HAVING count(value) < count(*)),
n AS (SELECT d.*, min(sqrt((x - ((cell_id - 1) % 10) - 0.5) ** 2 + (y - 9.5 + (cell_id - 1) // 10) ** 2)) AS km FROM d JOIN s USING (s_suppkey) LEFT JOIN r ON r.epiyear = d.epiyear AND r.epiweek = d.epiweek AND sqrt((x - ((cell_id - 1) % 10) - 0.5) ** 2 + (y - 9.5 + (cell_id - 1) // 10) ** 2) <= 1.5 GROUP BY d.s_suppkey, d.epiyear, d.epiweek)
SELECT s_suppkey, 'sum' AS variable, count(*) AS weeks_affected, count(km) AS fallback_success_weeks, count(*) - count(km) AS unresolved_weeks, round(min(km), 6) AS nearest_min_km, round(median(km), 6) AS nearest_median_km, round(max(km), 6) AS nearest_max_km, array_to_string(list_sort(list_distinct(list(CASE WHEN km IS NULL THEN 'none' ELSE '<=25 km' END))), ';') AS nearest_distance_bins FROM n GROUP BY s_suppkey""")
def weekly_gaps(spark, sf_dir):
    """Places that lack a direct value in some week, and what the nearest cell gives them."""
    e = weekly_events(spark, sf_dir).withColumn("cell_id", GRID.cell("x", "y")).where("cell_id is not null")
    values = e.groupBy("epiyear", "epiweek", "cell_id").agg(F.round(F.sum("value"), 6).alias("value")).withColumn("variable", F.lit("sum"))
    k = F.col("s_suppkey")
    at = table(spark, sf_dir, "supplier").select("s_suppkey", ((k * 37 % 97) / 10 + 0.15).alias("x"), ((k * 53 % 97) / 10 + 0.15).alias("y"))
    return rounded(support.weekly_gaps(at, values, GRID, 1.5, ["s_suppkey"]), "nearest_min_km", "nearest_median_km", "nearest_max_km")


# --- crowds, meshes, walks -----------------------------------------------------------------


@query(f"WITH {DOMAIN}, n2 AS (SELECT n_nationkey AS poly_id, n_nationkey % 5 * 10.0 AS a, n_nationkey // 5 * 10.0 AS b FROM nation), p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN 2.3 + l_partkey % 10 / 1000 ELSE l_partkey * 37 % 499 / 10 + 0.03 END AS x, CASE WHEN l_orderkey % 2 = 0 THEN 2.1 + l_suppkey % 10 / 1000 ELSE l_suppkey * 91 % 499 / 10 + 0.03 END AS y FROM lineitem) SELECT l_orderkey, l_linenumber, poly_id FROM p JOIN n2 ON x BETWEEN a + 1 AND a + 8 AND y BETWEEN b + 1 AND b + 9 AND NOT (x BETWEEN a + 3.5 AND a + 6 AND y BETWEEN b + 4 AND b + 6.25)")
def crowded_points(spark, sf_dir):
    """Half of all points stand within a hundredth of a cell."""
    crowd = F.col("l_orderkey") % 2 == 0
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(crowd, 2.3 + F.col("l_partkey") % 10 / 1000).otherwise(F.col("l_partkey") * 37 % 499 / 10 + 0.03).alias("x"), F.when(crowd, 2.1 + F.col("l_suppkey") % 10 / 1000).otherwise(F.col("l_suppkey") * 91 % 499 / 10 + 0.03).alias("y"))
    return quadtree.located(p, _domain(spark, sf_dir), ["l_orderkey", "l_linenumber"], most=5000)


def _part_mesh(spark, sf_dir):
    """Parts as nodes, 20 a row, off their places by a little; squares of four parts cut in two."""
    k = F.col("p_partkey")
    nodes = sets.dealt(table(spark, sf_dir, "part"), "p_partkey").select((k + 1).cast("long").alias("node"), (k % 20 + (k * 7 % 5) / 20).alias("x"), (F.floor(k / 20) + (k * 3 % 7) / 30).alias("y"))
    here = nodes.select("node").where("(node - 1) % 20 < 19")
    whole = here.join(sets.by_key(nodes.select((F.col("node") - 21).alias("node"))), "node")
    two = F.array(F.struct(F.lit(0).alias("h"), F.col("node").alias("n1"), (F.col("node") + 1).alias("n2"), (F.col("node") + 21).alias("n3")), F.struct(F.lit(1).alias("h"), F.col("node").alias("n1"), (F.col("node") + 21).alias("n2"), (F.col("node") + 20).alias("n3")))
    triangles = whole.select("node", F.explode(two).alias("t")).select((F.col("node") * 2 + F.col("t.h")).alias("tri"), "t.n1", "t.n2", "t.n3")
    return nodes, triangles


MESH = """nd AS (SELECT p_partkey::BIGINT + 1 AS node, p_partkey % 20 + (p_partkey * 7 % 5) / 20 AS x, p_partkey // 20 + (p_partkey * 3 % 7) / 30 AS y FROM part), sq AS (SELECT a.node FROM nd a JOIN nd b ON b.node = a.node + 21 WHERE (a.node - 1) % 20 < 19),
tr AS (SELECT node AS n1, node + 1 AS n2, node + 21 AS n3 FROM sq UNION ALL SELECT node, node + 21, node + 20 FROM sq), sd AS (SELECT least(n1, n2) AS a, greatest(n1, n2) AS b FROM tr UNION ALL SELECT least(n2, n3), greatest(n2, n3) FROM tr UNION ALL SELECT least(n1, n3), greatest(n1, n3) FROM tr),
bd AS (SELECT a, b FROM sd GROUP BY ALL HAVING count(*) = 1)"""


@query(f"WITH {MESH} SELECT a, b, 'edge' AS kind FROM (SELECT DISTINCT a, b FROM sd) UNION ALL SELECT a, b, 'boundary' FROM bd")
def mesh_network(spark, sf_dir):
    _, triangles = _part_mesh(spark, sf_dir)
    return mesh.network(triangles, mesh.boundary(triangles))


@query(f"""WITH {MESH}, ar AS (SELECT unnest([n1, n2, n3]) AS node, abs((q.x - p.x) * (s.y - p.y) - (s.x - p.x) * (q.y - p.y)) / 6 AS a FROM tr JOIN nd p ON p.node = n1 JOIN nd q ON q.node = n2 JOIN nd s ON s.node = n3)
SELECT node, round(sum(a), 6) AS area, CASE WHEN node NOT IN (SELECT a FROM bd UNION SELECT b FROM bd) THEN round(sum(a), 6) END AS cell_area FROM ar GROUP BY node""")
def mesh_dual_areas(spark, sf_dir):
    """Areas of dual cells by thirds of triangles and, around inner nodes, of the cells' own polygons."""
    nodes, triangles = _part_mesh(spark, sf_dir)
    cells = geometry.edges(mesh.dual_cells(nodes, triangles), "node")
    own = geometry.polygon_areas(cells, "node").withColumnRenamed("area", "cell_area")
    edge = mesh.boundary(triangles)
    outer = edge.select(F.col("a").alias("node")).union(edge.select("b")).distinct()
    return rounded(mesh.dual_areas(nodes, triangles).join(sets.by_key(own.join(outer, "node", "left_anti")), "node", "left"), "area", "cell_area")


@query(f"WITH {MESH}, ar AS (SELECT unnest([n1, n2, n3]) AS node FROM tr) SELECT node, 2 * count(*)::INTEGER AS corners FROM ar WHERE node NOT IN (SELECT a FROM bd UNION SELECT b FROM bd) GROUP BY node")
def mesh_dual_cells(spark, sf_dir):
    """Cells around inner nodes have two corners a triangle: its centroid and the middle of a side."""
    nodes, triangles = _part_mesh(spark, sf_dir)
    edge = mesh.boundary(triangles)
    outer = edge.select(F.col("a").alias("node")).union(edge.select("b")).distinct()
    return mesh.dual_cells(nodes, triangles).join(outer, "node", "left_anti").select("node", (F.size(F.split("wkt", ",")) - 1).alias("corners"))


@query("SELECT n_nationkey AS poly_id, round((7 + n_nationkey / 10) * 8 - 5.625, 6) AS area FROM nation")
def polygon_areas(spark, sf_dir):
    """Rectangles with holes, which turn the other way."""
    k = F.col("n_nationkey")
    at = lambda x, y: F.struct((F.lit(0.0) + x).alias("x"), (F.lit(0.0) + y).alias("y"))
    wide = F.lit(7) + k / 10
    rings = F.array(F.array(at(0, 0), at(wide, 0), at(wide, 8), at(0, 8)), F.array(at(1, 1), at(1, 3.25), at(3.5, 3.25), at(3.5, 1)))
    edges = clipping.ring_edges(table(spark, sf_dir, "nation").select(k.alias("poly_id"), F.posexplode(rings).alias("ring", "corners")), ["poly_id"])
    return rounded(geometry.polygon_areas(edges), "area")


ORACLES["unit_assignment"] = f"""WITH {EVENTS}, u AS (SELECT DISTINCT user_id, x, y FROM e), h AS ({ORACLES["points_in_polygons"]})
SELECT u.user_id, coalesce(min(CASE poly_id WHEN 1 THEN 'b' WHEN 2 THEN 'a' END), 'Unk') AS admin_u FROM u LEFT JOIN h USING (user_id) GROUP BY u.user_id"""

WALK = """f AS (SELECT n_nationkey AS k, i AS t, CASE WHEN (n_nationkey * 31 + i * 17) % 11 <> 0 THEN ((n_nationkey + 1) * i * 7 % 23)::DOUBLE END AS v FROM nation, range(30) r(i)),
g AS (SELECT k, t, v, CASE WHEN v IS NULL THEN 0 ELSE 1 END + 10.0 * (CASE t WHEN 0 THEN 1 WHEN 29 THEN 1 ELSE 2 END) + 1e-9 AS d, coalesce(v, 0) AS r FROM f)"""


@query(f"""WITH RECURSIVE {WALK}, down AS (SELECT k, t, d::DOUBLE AS d, r::DOUBLE AS r FROM g WHERE t = 0 UNION ALL SELECT g.k, g.t, g.d - 100.0 / down.d, g.r + 10.0 * down.r / down.d FROM down JOIN g ON g.k = down.k AND g.t = down.t + 1),
up AS (SELECT k, t, r / d AS x FROM down WHERE t = 29 UNION ALL SELECT down.k, down.t, (down.r + 10.0 * up.x) / down.d FROM up JOIN down ON down.k = up.k AND down.t = up.t - 1) SELECT k, t, round(x, 6) AS smoothed FROM up""")
def smoothed_series(spark, sf_dir):
    """A series a nation, solved in blocks of eight steps."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).crossJoin(F.broadcast(spark.range(30).withColumnRenamed("id", "t")))
    v = F.when((F.col("k") * 31 + F.col("t") * 17) % 11 != 0, ((F.col("k") + 1) * F.col("t") * 7 % 23).cast("double"))
    return rounded(persistence.smooth_walks(n.withColumn("v", v), ["k"], "t", "v", block=8), "smoothed")


FRONT = "ev AS (SELECT ts::DATE AS d, value AS y FROM events WHERE value IS NOT NULL AND isfinite(value)), sp AS (SELECT unnest(generate_series((SELECT min(d) FROM ev), (SELECT max(d) FROM ev), INTERVAL 1 DAY))::DATE AS day), q AS (SELECT day, CASE WHEN count(y) >= 5 THEN quantile_cont(y, 0.95) END AS front FROM sp LEFT JOIN ev ON d BETWEEN day - 6 AND day GROUP BY day), st AS (SELECT day, row_number() OVER (ORDER BY day) AS t, front - lag(front) OVER (ORDER BY day) AS s FROM q), g AS (SELECT day, t, CASE WHEN s > 0 THEN s ELSE 0 END AS r, 1 + 10.0 * (CASE WHEN t IN (1, (SELECT count(*) FROM st)) THEN 1 ELSE 2 END) + 1e-9 AS d FROM st)"
ORACLES["front_smoothed"] = f"""WITH RECURSIVE {FRONT}, down AS (SELECT day, t, d::DOUBLE AS d, r::DOUBLE AS r FROM g WHERE t = 1 UNION ALL SELECT g.day, g.t, g.d - 100.0 / down.d, g.r + 10.0 * down.r / down.d FROM down JOIN g ON g.t = down.t + 1),
up AS (SELECT day, t, r / d AS x FROM down WHERE t = (SELECT max(t) FROM g) UNION ALL SELECT down.day, down.t, (down.r + 10.0 * up.x) / down.d FROM up JOIN down ON down.t = up.t - 1) SELECT day::VARCHAR AS day, round(x, 6) AS smoothed FROM up"""

# --- states of a run -----------------------------------------------------------------------


@query("SELECT r_name AS stage, r_regionkey < 3 AS done, (SELECT r_name FROM region WHERE r_regionkey >= 3 ORDER BY r_regionkey LIMIT 1) AS resume FROM region")
def run_status(spark, sf_dir):
    """A run's state written, read again, and where it goes on."""
    region = table(spark, sf_dir, "region").orderBy("r_regionkey").select(F.col("r_name").alias("stage"), (F.col("r_regionkey") < 3).alias("done"))
    path = tables.scratch_folder(spark, "status")
    tables.write_bundle({"status": region}, path, {"order": [r.stage for r in region.collect()]})  # the stages of a run
    held, facts = tables.read_bundle(spark, path)
    done = {r.stage: r.done for r in held["status"].collect()}
    return held["status"].withColumn("resume", F.lit(config.resume_stage(done, tuple(facts["order"]))))

