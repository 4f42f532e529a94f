"""Registered queries: the operators on the driver's tables, each with its SQL.

Stand-ins: a week is an ISO week, an area a nation, a cell a nation's number or user_id % 40, a
density a quantity or an order total.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import importable
from ..functions import numbers, places, text, timeidx
from ..operators import cleaning, gates, geometry, grid, hosts, mesh, metrics, persistence, predictor, reporting, responses, sets, tiers
from ..sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on the order of rows; the last digits are not compared."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def dates_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n, t in df.dtypes if t == "date"})


GRID = places.Grid(10, 10, 0.0, 10.0, 0.0, 10.0)

# --- base tables ---------------------------------------------------------------------------


def weekly_events(spark, sf_dir) -> DataFrame:
    """Events with a day, a week, a cell and pseudo-coordinates."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    e = timeidx.with_week(e, "day")
    return e.withColumns({"cell_id": F.col("user_id") % 40, "x": (F.col("user_id") * 37 % 101) / 10.0, "y": (F.col("user_id") * 53 % 103) / 10.0})


EVENTS = """e AS (SELECT *, ts::DATE AS day, isoyear(ts)::INTEGER AS epiyear, week(ts)::INTEGER AS epiweek, user_id % 40 AS cell_id,
  (user_id * 37 % 101) / 10.0::DOUBLE AS x, (user_id * 53 % 103) / 10.0::DOUBLE AS y FROM events)"""


def nation_weeks(spark, sf_dir) -> DataFrame:
    """Order totals by nation and week, the grid completed with missing values."""
    o = timeidx.with_week(table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate")), "day")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("cell_id"))
    sums = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("cell_id", "epiyear", "epiweek").agg(F.sum("o_totalprice").alias("value"))
    weeks = timeidx.index_weeks(table(spark, sf_dir, "orders"), "o_orderdate")
    cells = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cell_id"))
    return sets.crossing(cells, weeks).join(sums, ["cell_id", "epiyear", "epiweek"], "left")


NATION_WEEKS = """o AS (SELECT c_nationkey AS cell_id, isoyear(o_orderdate)::INTEGER AS epiyear, week(o_orderdate)::INTEGER AS epiweek, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
w AS (SELECT epiyear, epiweek, row_number() OVER (ORDER BY epiyear, epiweek)::INTEGER AS time_index FROM (SELECT DISTINCT isoyear(o_orderdate)::INTEGER AS epiyear, week(o_orderdate)::INTEGER AS epiweek FROM orders)),
s AS (SELECT cell_id, epiyear, epiweek, sum(o_totalprice) AS value FROM o GROUP BY ALL),
g AS (SELECT n_nationkey AS cell_id, w.*, s.value FROM nation CROSS JOIN w LEFT JOIN s ON s.cell_id = n_nationkey AND s.epiyear = w.epiyear AND s.epiweek = w.epiweek)"""

# --- cleaning ------------------------------------------------------------------------------


def _marked_events(spark, sf_dir):
    e = weekly_events(spark, sf_dir).withColumn("raw_day", F.when(F.col("event_type") != "signup", F.col("day").cast("string")))
    e = e.withColumns({"parsed": F.when(F.col("value") < 200, F.to_date("raw_day")), "lon": (F.col("user_id") % 200 - 10).cast("double"), "lat": F.when(F.col("user_id") % 7 != 0, (F.col("user_id") % 90).cast("double"))})
    return cleaning.clean_observations(e, "2024-01-03", "2024-01-25", inside=F.col("lon") < 120, raw_date="raw_day", date="parsed", order="event_id")


MARKED = EVENTS + """, d AS (SELECT *, CASE WHEN event_type <> 'signup' THEN day END AS raw_day, CASE WHEN value < 200 AND event_type <> 'signup' THEN day END AS parsed, (user_id % 200 - 10)::DOUBLE AS lon, CASE WHEN user_id % 7 <> 0 THEN (user_id % 90)::DOUBLE END AS lat FROM e),
r AS (SELECT *, CASE WHEN raw_day IS NULL THEN 'missing_date' WHEN parsed IS NULL THEN 'invalid_date' WHEN NOT parsed BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' THEN 'outside_study_period'
  WHEN lat IS NULL OR lon NOT BETWEEN -180 AND 180 OR lat NOT BETWEEN -90 AND 90 THEN 'invalid_coordinates' WHEN NOT lon < 120 THEN 'outside_spatial_domain' END AS first_reason FROM d),
m AS (SELECT *, CASE WHEN first_reason IS NULL AND row_number() OVER (PARTITION BY parsed, lon, lat, first_reason IS NULL ORDER BY event_id) > 1 THEN 'exact_date_location_duplicate' ELSE first_reason END AS exclusion_reason FROM r)"""


@query(f"WITH {MARKED} SELECT event_id, exclusion_reason FROM m")
def clean_reason_cascade(spark, sf_dir):
    return _marked_events(spark, sf_dir).select("event_id", "exclusion_reason")


@query(f"""WITH {MARKED}, st(position, stage) AS (VALUES (0, 'input'), (1, 'missing_date'), (2, 'invalid_date'), (3, 'outside_study_period'), (4, 'invalid_coordinates'), (5, 'outside_spatial_domain'), (6, 'exact_date_location_duplicate'), (7, 'retained')),
n AS (SELECT coalesce(exclusion_reason, 'retained') AS stage, count(*) AS c FROM m GROUP BY 1 UNION ALL SELECT 'input', count(*) FROM m)
SELECT position::INTEGER AS position, st.stage, coalesce(c, 0)::BIGINT AS count FROM st LEFT JOIN n USING (stage)""")
def clean_exclusion_audit(spark, sf_dir):
    return cleaning.exclusion_audit(_marked_events(spark, sf_dir), cleaning.RAW_REASONS)


@query(f"""WITH {EVENTS}, r AS (SELECT event_id, epiyear, epiweek, x, y, CASE WHEN NOT epiweek BETWEEN 2 AND 4 THEN 'outside_study_period' END AS reason FROM e)
SELECT event_id, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY epiyear, epiweek, x, y, reason IS NULL ORDER BY event_id) > 1 THEN 'exact_point_week_duplicate' ELSE reason END AS exclusion_reason FROM r""")
def clean_weekly_cascade(spark, sf_dir):
    weeks = timeidx.week_index(spark, "2024-01-08", "2024-01-28")
    return cleaning.clean_weekly_observations(weekly_events(spark, sf_dir), weeks, order="event_id").select("event_id", "exclusion_reason")


@query(f"WITH {EVENTS}, l AS (SELECT max(day) AS last_date FROM e), c AS (SELECT last_date, CASE WHEN date_trunc('week', last_date)::DATE + 6 <= last_date THEN date_trunc('week', last_date)::DATE ELSE date_trunc('week', last_date)::DATE - 7 END AS monday FROM l) SELECT last_date::VARCHAR AS last_date, isoyear(monday)::INTEGER AS epiyear, week(monday)::INTEGER AS epiweek, (monday + 6)::DATE::VARCHAR AS week_end FROM c")
def last_complete_week(spark, sf_dir):
    return dates_as_text(timeidx.last_complete_week(table(spark, sf_dir, "events"), "ts"))


@query(f"WITH {EVENTS}, l AS (SELECT max(day) AS d FROM e), c AS (SELECT CASE WHEN date_trunc('week', d)::DATE + 6 <= d THEN date_trunc('week', d)::DATE + 6 ELSE date_trunc('week', d)::DATE - 1 END AS w FROM l) SELECT CASE WHEN day > w THEN 'after_auto_last_complete_observation_week' END AS exclusion_reason, count(*) AS n FROM e, c GROUP BY 1")
def incomplete_week_trim(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return cleaning.trim_incomplete_week(e, "ts", timeidx.last_complete_week(e, "ts")).groupBy("exclusion_reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT epiyear, epiweek, row_number() OVER (ORDER BY epiyear, epiweek)::INTEGER AS time_index FROM (SELECT DISTINCT isoyear(o_orderdate)::INTEGER AS epiyear, week(o_orderdate)::INTEGER AS epiweek FROM orders)")
def week_index(spark, sf_dir):
    return timeidx.index_weeks(table(spark, sf_dir, "orders"), "o_orderdate")


@query("""WITH d AS (SELECT DISTINCT date_trunc('week', o_orderdate)::DATE AS m, isoyear(o_orderdate)::INTEGER AS epiyear, week(o_orderdate)::INTEGER AS epiweek FROM orders), t AS (SELECT *, row_number() OVER (ORDER BY m) AS time_index, min(m) OVER () AS f FROM d)
SELECT epiyear, epiweek, time_index::INTEGER AS time_index, m::VARCHAR AS week_start, time_index::INTEGER AS timestep, ((time_index + 1) // 2)::INTEGER AS timestep_2wk, (((year(m) - year(f)) * 12 + month(m) - month(f)) // 3 + 1)::INTEGER AS quarter_index, (((year(m) - year(f)) * 12 + month(m) - month(f)) // 6 + 1)::INTEGER AS sixmo_index, dense_rank() OVER (ORDER BY year(m))::INTEGER AS year_index FROM t""")
def time_buckets(spark, sf_dir):
    return dates_as_text(timeidx.time_buckets(timeidx.index_weeks(table(spark, sf_dir, "orders"), "o_orderdate")))


@query("SELECT o_orderkey, date_trunc('week', o_orderdate)::DATE::VARCHAR AS week_start, (date_trunc('week', o_orderdate)::DATE + 6)::DATE::VARCHAR AS week_end, printf('%04d-W%02d', isoyear(o_orderdate), week(o_orderdate)) AS label, isoyear(o_orderdate)::INTEGER AS epiyear, week(o_orderdate)::INTEGER AS epiweek FROM orders")
def epiweek_roundtrip(spark, sf_dir):
    o = timeidx.with_week(table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate")), "day", "_y", "_w")
    o = o.withColumn("label", timeidx.week_label("_y", "_w"))
    y, w = timeidx.parse_week_label("label")
    return dates_as_text(o.withColumns({"epiyear": y, "epiweek": w}).select("o_orderkey", timeidx.week_start("epiyear", "epiweek").alias("week_start"), timeidx.week_end("epiyear", "epiweek").alias("week_end"), "label", "epiyear", "epiweek"))


# --- model tables --------------------------------------------------------------------------


def _observations(spark, sf_dir):
    return weekly_events(spark, sf_dir).withColumnRenamed("event_id", "observation_id")


def _nodes(spark, sf_dir):
    return spark.range(40).select(F.col("id").alias("node"), F.col("id").cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"), (F.col("id") + 1).cast("double").alias("area"), (F.col("id") % 3 != 0).alias("inside_domain"))


def _event_weeks(spark, sf_dir):
    return timeidx.index_weeks(table(spark, sf_dir, "events"), "ts")


EVENT_WEEKS = "w AS (SELECT epiyear, epiweek, row_number() OVER (ORDER BY epiyear, epiweek)::INTEGER AS time_index FROM (SELECT DISTINCT epiyear, epiweek FROM e))"


@query(f"""WITH {EVENTS}, {EVENT_WEEKS}, p AS (SELECT 'obs_' || event_id AS row_id, epiyear, epiweek, 1 AS yi, 0.0001::DOUBLE AS exposure FROM e),
b AS (SELECT 'quad_' || i || '_' || time_index AS row_id, epiyear, epiweek, 0 AS yi, CASE WHEN i % 3 <> 0 THEN i + 1.0 ELSE 0.0001 END::DOUBLE AS exposure FROM range(40) t(i), w)
SELECT * FROM p UNION ALL SELECT * FROM b""")
def tier1_union(spark, sf_dir):
    weeks = _event_weeks(spark, sf_dir)
    t = tiers.presence_background(_observations(spark, sf_dir).join(F.broadcast(weeks), ["epiyear", "epiweek"]), _nodes(spark, sf_dir), weeks)
    return t.select("row_id", "epiyear", "epiweek", F.col("Yi").alias("yi"), F.col("sc_Exp").alias("exposure"))


@query(f"WITH {EVENTS}, {EVENT_WEEKS}, c AS (SELECT cell_id, epiyear, epiweek, count(*) AS n FROM e GROUP BY ALL) SELECT i AS poly_id, w.epiyear, w.epiweek, time_index, coalesce(n, 0) AS count FROM range(40) t(i) CROSS JOIN w LEFT JOIN c ON c.cell_id = i AND c.epiyear = w.epiyear AND c.epiweek = w.epiweek")
def tier2_grid_counts(spark, sf_dir):
    o = _observations(spark, sf_dir).withColumnRenamed("cell_id", "poly_id")
    return tiers.area_week_counts(o, spark.range(40).withColumnRenamed("id", "poly_id"), _event_weeks(spark, sf_dir)).select("poly_id", "epiyear", "epiweek", "time_index", "count")


@query("SELECT count(*) AS eligible, count(*) AS presences, count(*) AS counted, true AS conserved FROM events")
def conservation(spark, sf_dir):
    o, weeks = _observations(spark, sf_dir), _event_weeks(spark, sf_dir)
    t1 = tiers.presence_background(o.join(F.broadcast(weeks), ["epiyear", "epiweek"]), _nodes(spark, sf_dir), weeks)
    t2 = tiers.area_week_counts(o.withColumnRenamed("cell_id", "poly_id"), spark.range(40).withColumnRenamed("id", "poly_id"), weeks)
    out = tiers.conservation(o, t1, t2)
    return out.select("eligible", F.col("presences").cast("long").alias("presences"), F.col("counted").cast("long").alias("counted"), "conserved")


@query(f"WITH {EVENTS}, {EVENT_WEEKS} SELECT 'cell_' || i || '_time_' || time_index AS space_time_id, i AS cell_id, epiyear, epiweek FROM range(1, 101) t(i), w WHERE i % 4 <> 0 AND i % 9 <> 0")
def prediction_grid(spark, sf_dir):
    x, y = GRID.center("cell_id")
    cells = spark.range(1, 101).withColumnRenamed("id", "cell_id").withColumns({"x": x, "y": y, "value": F.when(F.col("cell_id") % 4 != 0, 1.0), "inside": F.col("cell_id") % 9 != 0})
    return tiers.prediction_grid(cells, _event_weeks(spark, sf_dir)).select("space_time_id", "cell_id", "epiyear", "epiweek")


THINNED = EVENTS + ", t AS (SELECT *, (event_type = 'purchase')::INTEGER AS yi, CASE WHEN user_id % 11 <> 0 THEN cell_id END AS c FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY yi = 1, epiyear, epiweek, c ORDER BY md5('7|' || event_id), event_id) AS rk FROM t), m AS (SELECT *, CASE WHEN yi = 1 THEN CASE WHEN c IS NULL THEN 'outside' WHEN rk = 1 THEN 'kept' ELSE 'duplicate' END END AS thinning FROM k)"


def _thinned(spark, sf_dir):
    e = weekly_events(spark, sf_dir).withColumns({"Yi": (F.col("event_type") == "purchase").cast("int"), "cell_id": F.when(F.col("user_id") % 11 != 0, F.col("cell_id"))})
    return tiers.thin_presences(e, 7, row_id="event_id")


@query(f"WITH {THINNED} SELECT event_id, thinning FROM m")
def thin_one_per_cellweek(spark, sf_dir):
    return _thinned(spark, sf_dir).select("event_id", "thinning")


@query(f"WITH {THINNED} SELECT count(thinning) AS presences, count(*) FILTER (thinning = 'kept') AS kept, count(*) FILTER (thinning = 'duplicate') AS duplicate, count(*) FILTER (thinning = 'outside') AS outside, true AS balanced FROM m")
def thinning_audit(spark, sf_dir):
    return tiers.thinning_audit(_thinned(spark, sf_dir))


@query("""WITH e AS (SELECT o_orderkey, o_totalprice, o_orderstatus = 'F' AS c, o_orderstatus <> 'F' AND o_totalprice > 100000 AS ok FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY md5('11|' || o_orderkey), o_orderkey) AS k, count(*) FILTER (ok) OVER () AS n FROM e)
SELECT o_orderkey, ok AND k <= ceil(n * 0.2) AS is_test_point FROM r""")
def holdout_hash(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumns({"is_censored": F.col("o_orderstatus") == "F", "response_censored": F.greatest(F.col("o_totalprice") - 100000, F.lit(0.0))})
    return responses.holdout(o, 0.2, 11, "o_orderkey").select("o_orderkey", "is_test_point")


CENSOR = """a AS (SELECT o_orderkey, o_custkey % 400 AS area, isoyear(o_orderdate) * 100 + week(o_orderdate) AS k, CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END AS y FROM orders),
f AS (SELECT area, coalesce(bool_or(k < 199926 AND y > 0), false) AND NOT coalesce(bool_or(k >= 199926 AND y > 0), false) AS silent FROM a GROUP BY 1)"""


@query(f"WITH {CENSOR} SELECT o_orderkey, silent AND k >= 199926 AS is_censored, coalesce(CASE WHEN NOT (silent AND k >= 199926) THEN y END, -1)::INTEGER AS response_censored FROM a JOIN f USING (area)")
def censor_admin(spark, sf_dir):
    o = timeidx.with_week(table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate")), "day").withColumns({"area": F.col("o_custkey") % 400, "y": F.when(F.col("o_totalprice") > 400000, 1).otherwise(0)})
    return responses.censor(o, responses.silent_areas(o, "area", "y", 1999, 26), "area", "y", 1999, 26).select("o_orderkey", "is_censored", F.coalesce("response_censored", F.lit(-1)).alias("response_censored"))


@query("WITH s AS (SELECT avg(l_quantity) c, greatest(stddev_samp(l_quantity), 2.220446049250313e-16) d FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_quantity - c) / d, 6) AS l_quantity_z, round(ln(1 + l_tax), 6) AS l_tax_log1p, round(greatest(0, l_discount - 0.05), 6) AS l_discount_hinge FROM lineitem, s")
def standardize_log1p_hinge(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    out = responses.apply_standardizers(li, responses.standardizers(li, ["l_quantity"]))
    out = responses.apply_hinges(responses.apply_log1p(out, {"l_tax": 0.0}), {"l_discount": 0.05})
    return rounded(out.select("l_orderkey", "l_linenumber", "l_quantity_z", "l_tax_log1p", "l_discount_hinge"), "l_quantity_z", "l_tax_log1p", "l_discount_hinge")


@query("WITH r AS (SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS k, count(*) OVER () AS n FROM part) SELECT p_partkey, greatest(1, ceil(k * 8 / n - 1e-12))::INTEGER AS bin FROM r")
def quantile_bins_train(spark, sf_dir):
    return responses.rank_bins(table(spark, sf_dir, "part"), "p_size", 8).select("p_partkey", "bin")


@query("""WITH b AS (SELECT [quantile_cont(p_size, i / 8.0) FOR i IN range(9)] AS x FROM (SELECT list(p_size) AS l FROM part)), q AS (SELECT quantile_cont(p_size::DOUBLE, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]) AS br FROM part),
s AS (SELECT l_orderkey, l_linenumber, l_quantity, br, greatest(1, least(8, len(list_filter(br, lambda k: k <= l_quantity))))::INTEGER AS qty_q FROM lineitem, q)
SELECT l_orderkey, l_linenumber, qty_q, round((br[qty_q] + br[qty_q + 1]) / 2, 6) AS qty_mid FROM s""".replace("b AS (SELECT [quantile_cont(p_size, i / 8.0) FOR i IN range(9)] AS x FROM (SELECT list(p_size) AS l FROM part)), ", ""))
def quantile_bins_apply(spark, sf_dir):
    breaks = responses.quantile_breaks(table(spark, sf_dir, "part"), "p_size", 8)
    return rounded(responses.apply_breaks(table(spark, sf_dir, "lineitem"), "l_quantity", breaks, "qty").select("l_orderkey", "l_linenumber", "qty_q", "qty_mid"), "qty_mid")


@query("WITH n AS (SELECT CASE WHEN n_nationkey % 9 = 0 THEN 'Unk' WHEN n_nationkey % 10 = 0 THEN 'Unk' ELSE n_name END AS admin_u FROM nation) SELECT admin_u, row_number() OVER (ORDER BY admin_u = 'Unk', admin_u)::INTEGER AS admin_f FROM (SELECT DISTINCT admin_u FROM n)")
def admin_factor(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 9 != 0, F.when(F.col("n_nationkey") % 10 == 0, "").otherwise(F.col("n_name"))).alias("admin_u"))
    return responses.area_factor(n)


@query("SELECT count(DISTINCT p_size) AS groups, min(p_size) AS least, max(p_size) AS greatest, min(p_size) = 1 AND max(p_size) = count(DISTINCT p_size) AS contiguous FROM part")
def group_audit(spark, sf_dir):
    return responses.group_audit(table(spark, sf_dir, "part"), "p_size")


# --- hosts ---------------------------------------------------------------------------------

PART_PATTERNS = [("r", "Er", "Livestock"), ("gizmo|gear", "Geared", "Wildlife"), ("(?<!l)bolt", "Bolt", "Equids"), ("^old", "Old", "Human"), ("ring", "Ring", "Birds")]
EXPANDED = """p AS (SELECT p_partkey AS submission, regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS host_cleaned FROM part),
t(pattern_id, pattern, common_name, broad_group) AS (VALUES (0, 'r', 'Er', 'Livestock'), (1, 'gizmo|gear', 'Geared', 'Wildlife'), (2, '(^|[^l])bolt', 'Bolt', 'Equids'), (3, '^old', 'Old', 'Human'), (4, 'ring', 'Ring', 'Birds')),
x AS (SELECT submission, host_cleaned, pattern_id::INTEGER AS pattern_id, coalesce(common_name, 'Unreported') AS common_name, coalesce(broad_group, 'Unreported') AS broad_group FROM p LEFT JOIN t ON regexp_matches(host_cleaned, pattern))"""


def _expanded(spark, sf_dir):
    return hosts.expand_hosts(table(spark, sf_dir, "part"), hosts.pattern_table(spark, PART_PATTERNS), "p_name", "p_partkey")


@query(f"WITH {EXPANDED} SELECT * REPLACE (coalesce(pattern_id, -1)::INTEGER AS pattern_id) FROM x")
def host_regex_expand(spark, sf_dir):
    return _expanded(spark, sf_dir).na.fill(-1, ["pattern_id"])


@query(f"WITH {EXPANDED} SELECT submission, host_cleaned, coalesce(pattern_id, -1)::INTEGER AS pattern_id, common_name, broad_group FROM x QUALIFY row_number() OVER (PARTITION BY submission ORDER BY coalesce(pattern_id, 1000)) = 1")
def host_first_match(spark, sf_dir):
    return hosts.first_hosts(_expanded(spark, sf_dir)).na.fill(-1, ["pattern_id"])


@query(f"""WITH {EXPANDED}, d AS (SELECT count(*) AS n FROM part) SELECT common_name, broad_group, count(*) AS count, round(count(*) / n, 6) AS prop, round(100.0 * count(*) / n, 6) AS pct, CASE WHEN 100.0 * count(*) / n >= 1 THEN 'Major Hosts' ELSE 'Minor Hosts (<1%)' END AS tier, n AS denominator,
list_position(['Livestock', 'Equids', 'Companion Animals', 'Human', 'Wildlife', 'Birds', 'Unreported'], broad_group)::BIGINT AS group_order FROM x, d GROUP BY common_name, broad_group, n""")
def host_composition(spark, sf_dir):
    n = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"))
    return rounded(hosts.composition(_expanded(spark, sf_dir), n), "prop", "pct")


@query(f"""WITH {EXPANDED}, f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY submission ORDER BY coalesce(pattern_id, 1000)) = 1), a AS (SELECT common_name, count(*) AS c FROM x GROUP BY 1), b AS (SELECT common_name, count(*) AS c FROM f GROUP BY 1)
SELECT common_name, coalesce(a.c, 0) AS a_value, coalesce(b.c, 0) AS b_value, coalesce(a.c, 0) - coalesce(b.c, 0) AS difference FROM a FULL JOIN b USING (common_name)""")
def host_sensitivity(spark, sf_dir):
    x = _expanded(spark, sf_dir)
    count = lambda d: d.groupBy("common_name").agg(F.count(F.lit(1)).alias("c"))
    return sets.full_comparison(count(x), count(hosts.first_hosts(x)), ["common_name"], "c")


@query(f"WITH {EXPANDED}, s AS (SELECT submission, count(pattern_id) AS m FROM x GROUP BY 1) SELECT count(*) AS submissions, sum(greatest(m, 1))::BIGINT AS expanded, count(*) FILTER (m > 1) AS compound, count(*) FILTER (m = 0) AS unmatched, (SELECT count(DISTINCT p_name) FROM part) AS raw_names FROM s")
def host_audit(spark, sf_dir):
    return hosts.host_audit(_expanded(spark, sf_dir), table(spark, sf_dir, "part"), "p_name")


@query("""WITH c AS (SELECT c_custkey, regexp_replace(lower(c_mktsegment), '[^a-z]', '', 'g') AS k FROM customer), l(host_cleaned, s, g) AS (VALUES ('building', 'bovine', 'livestock'), ('household', 'canine', 'domestic'))
SELECT c_custkey, coalesce(s, 'unknown') AS host_standardized, coalesce(g, 'unknown') AS host_group FROM c LEFT JOIN l ON k = host_cleaned""")
def host_lookup_fallback(spark, sf_dir):
    lookup = spark.createDataFrame([("building", "bovine", "livestock", False), ("household", "canine", "domestic", False)], "host_cleaned string, host_standardized string, host_group string, multiple_host_flag boolean")
    return cleaning.with_hosts(table(spark, sf_dir, "customer"), lookup, "c_mktsegment").select("c_custkey", "host_standardized", "host_group")


@query("SELECT trim(coalesce(p_type, '')) AS species, count(*) AS count, round(count(*) / 5000.0, 6) AS prop, min_by(p_brand, p_partkey) AS category FROM part GROUP BY 1")
def species_composition(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    categories = p.select(F.col("p_type").alias("species"), F.col("p_brand").alias("category"), F.col("p_partkey").alias("position"))
    return rounded(hosts.species_composition(p, "p_type", categories, 5000), "prop")


# --- profiles and metrics ------------------------------------------------------------------


@query("""WITH l AS (SELECT l_returnflag, measure, v FROM (SELECT l_returnflag, l_quantity, l_extendedprice FROM lineitem) UNPIVOT (v FOR measure IN (l_quantity, l_extendedprice)))
SELECT measure, l_returnflag, count(v) AS n, count(*) - count(v) AS nonfinite, min(v) AS min, round(quantile_cont(v, 0.01), 6) AS q01, round(quantile_cont(v, 0.05), 6) AS q05, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75, round(quantile_cont(v, 0.95), 6) AS q95, round(quantile_cont(v, 0.99), 6) AS q99, round(avg(v), 6) AS mean, max(v) AS max
FROM l GROUP BY GROUPING SETS ((measure), (measure, l_returnflag))""")
def distribution_profile(spark, sf_dir):
    out = grid.distribution_profile(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"], ["l_returnflag"])
    return rounded(out, "q01", "q05", "q25", "q50", "q75", "q95", "q99", "mean")


SCORED = "d AS (SELECT doc_id, (n_chars % 997)::DOUBLE AS score, quality, 1.0 / (1 + exp(-((n_chars % 997) - 500) / 200.0)) AS p FROM documents JOIN labels USING (doc_id))"


def _scored(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 997).cast("double").alias("score"))
    return d.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("p", numbers.inverse_logit((F.col("score") - 500) / 200.0))


@query(f"WITH {SCORED}, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM d) SELECT round((sum(k) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 6) AS auc FROM r")
def rank_auc(spark, sf_dir):
    return rounded(metrics.rank_auc(_scored(spark, sf_dir), "score", "quality"), "auc")


BACKGROUND = EVENTS + ", p AS (SELECT * FROM e WHERE event_type = 'purchase'), b AS (SELECT * FROM e WHERE event_type = 'view')"


def _presences(spark, sf_dir):
    e = weekly_events(spark, sf_dir)
    return e.where("event_type = 'purchase'"), e.where("event_type = 'view'")


@query(f"WITH {BACKGROUND}, v AS (SELECT value, count(*) AS n FROM p GROUP BY 1), w AS (SELECT value, sum(user_id + 1.0) AS w FROM b GROUP BY 1), c AS (SELECT v.value, v.n, sum(CASE WHEN w.value < v.value THEN w ELSE w / 2 END) AS below FROM v JOIN w ON w.value <= v.value GROUP BY ALL), t AS (SELECT sum(user_id + 1.0) AS total FROM b) SELECT round(sum(n * below) / (SELECT count(*) FROM p) / any_value(total), 6) AS auc FROM c, t")
def weighted_pb_auc(spark, sf_dir):
    p, b = _presences(spark, sf_dir)
    return rounded(metrics.weighted_auc(p, b, "value", F.col("user_id") + 1.0), "auc")


@query(f"""WITH {BACKGROUND} SELECT p.event_id, round(sum(CASE WHEN b.value < p.value THEN 1.0 WHEN b.value = p.value THEN 0.5 ELSE 0 END) / count(*), 6) AS percentile, round(sum(CASE WHEN b.value < p.value THEN b.user_id + 1.0 WHEN b.value = p.value THEN (b.user_id + 1.0) / 2 ELSE 0 END) / sum(b.user_id + 1.0), 6) AS weighted_percentile
FROM p JOIN b ON p.epiyear = b.epiyear AND p.epiweek = b.epiweek GROUP BY 1""")
def same_week_percentile(spark, sf_dir):
    p, b = _presences(spark, sf_dir)
    b = b.withColumn("w", F.col("user_id") + 1.0)
    return rounded(metrics.same_week_percentiles(p, b, "value", "w", ["epiyear", "epiweek"]).select("event_id", "percentile", "weighted_percentile"), "percentile", "weighted_percentile")


@query(f"""WITH {BACKGROUND}, q AS (SELECT p.event_id, p.epiyear, p.epiweek, sum(CASE WHEN b.value < p.value THEN 1.0 WHEN b.value = p.value THEN 0.5 ELSE 0 END) / count(*) AS percentile FROM p JOIN b ON p.epiyear = b.epiyear AND p.epiweek = b.epiweek GROUP BY ALL)
SELECT epiyear, epiweek, count(*) AS n, round(avg(percentile), 6) AS mean_percentile, round(quantile_cont(percentile, 0.5), 6) AS median_percentile FROM q GROUP BY ALL""")
def weekly_rank_summary(spark, sf_dir):
    p, b = _presences(spark, sf_dir)
    q = metrics.same_week_percentiles(p, b.withColumn("w", F.lit(1.0)), "value", "w", ["epiyear", "epiweek"])
    return rounded(metrics.weekly_rank_summary(q, ["epiyear", "epiweek"]).drop("mean_weighted_percentile"), "mean_percentile", "median_percentile")


@query(f"""WITH {BACKGROUND}, a AS (SELECT value AS s, 1 AS p, 0 AS b FROM p UNION ALL SELECT value, 0, 1 FROM b), x AS (SELECT min(s) lo, max(s) hi, sum(p) np, sum(b) nb FROM a), f AS (SELECT i AS window_id, lo + (hi - lo) * (i - 1) / 99 AS m, (hi - lo) * 0.1 / 2 AS h, np, nb FROM range(1, 101) t(i), x)
SELECT window_id, round(m, 6) AS midpoint, coalesce(sum(a.p), 0)::BIGINT AS n_presences, coalesce(sum(a.b), 0)::BIGINT AS n_background, CASE WHEN sum(a.b) > 0 THEN round(sum(a.p) / np / (sum(a.b) / nb), 6) END AS p_over_e FROM f LEFT JOIN a ON s >= m - h AND s <= m + h GROUP BY window_id, m, np, nb""")
def boyce_curve(spark, sf_dir):
    p, b = _presences(spark, sf_dir)
    return rounded(metrics.boyce_curve(p, b, "value").select("window_id", "midpoint", "n_presences", "n_background", "p_over_e"), "midpoint", "p_over_e")


@query(f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY score, doc_id) AS k, count(*) OVER () AS n FROM d) SELECT (((k - 1) * 10) // n + 1)::INTEGER AS bin, count(*) AS n, round(avg(score), 6) AS mean_predicted, round(avg(quality), 6) AS mean_observed, sum(quality)::BIGINT AS sum_observed FROM r GROUP BY 1")
def equal_freq_bins(spark, sf_dir):
    return rounded(metrics.equal_frequency_bins(_scored(spark, sf_dir), "score", "quality", "doc_id", 10), "mean_predicted", "mean_observed")


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem")
def count_calibration(spark, sf_dir):
    return rounded(metrics.linear_calibration(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity"), "intercept", "slope", digits=4)


@query("""WITH b AS (SELECT l_extendedprice AS o, l_quantity * 1500.0 AS p FROM lineitem), r AS (SELECT o, p, rank() OVER (ORDER BY o) + (count(*) OVER (PARTITION BY o) - 1) / 2.0 AS ro, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM b)
SELECT count(*) AS n, round(avg(abs(o - p)), 4) AS mae, round(sqrt(avg((o - p) * (o - p))), 4) AS rmse, round(corr(o, p), 6) AS pearson, round(avg(o) / avg(p), 6) AS mean_ratio, round(corr(ro, rp), 6) AS spearman FROM r""")
def error_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("predicted", F.col("l_quantity") * 1500.0)
    return rounded(rounded(metrics.error_metrics(li, "l_extendedprice", "predicted"), "pearson", "mean_ratio", "spearman"), "mae", "rmse", digits=4)


@query(f"WITH {SCORED} SELECT round(avg((p - quality) * (p - quality)), 6) AS brier, round(avg(-(quality * ln(p) + (1 - quality) * ln(1 - p))), 6) AS log_loss FROM d")
def brier_logloss(spark, sf_dir):
    return rounded(metrics.brier_log_loss(_scored(spark, sf_dir), "quality", "p"), "brier", "log_loss")


LOGISTIC = [f"WITH RECURSIVE {SCORED}, x AS (SELECT quality::DOUBLE AS y, ln(p / (1 - p)) AS x FROM d), b(i, b0, b1) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT i + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (SELECT i, b0, b1, sum(y - m) AS g0, sum((y - m) * x) AS g1, sum(m * (1 - m)) AS h00, sum(m * (1 - m) * x) AS h01, sum(m * (1 - m) * x * x) AS h11 FROM (SELECT i, b0, b1, x, y, 1 / (1 + exp(-(b0 + b1 * x))) AS m FROM b, x WHERE i < 12) GROUP BY i, b0, b1))"]


@query(LOGISTIC[0] + " SELECT round(b0, 6) AS intercept, round(b1, 6) AS slope FROM b WHERE i = 12")
def logistic_calibration(spark, sf_dir):
    a, b = metrics.logistic_calibration(_scored(spark, sf_dir), "quality", "p")
    return spark.createDataFrame([(round(a, 6), round(b, 6))], "intercept double, slope double")


@query(f"WITH {SCORED}, v AS (SELECT score / 997 AS v FROM d) SELECT metric, value FROM (SELECT count(*)::DOUBLE AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.5), 6) AS median, round(avg((v > 0.9)::INTEGER), 6) AS above_90 FROM v) UNPIVOT (value FOR metric IN (n, mean, sd, min, max, median, above_90))")
def percentile_summary(spark, sf_dir):
    out = metrics.percentile_summary(_scored(spark, sf_dir).withColumn("v", F.col("score") / 997), "v")
    return rounded(out.where(F.col("metric").isin("n", "mean", "sd", "min", "max", "median", "above_90")), "value")


# --- predictor -----------------------------------------------------------------------------

FIXED = {"intercept": 0.5, "qty": 0.01, "disc": -2.0, "tax": 1.5, "qty:disc": 0.02}
COLUMNS = {"qty": "l_quantity", "disc": "l_discount", "tax": "l_tax"}
PREDICTED = """f AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, 0.5 + 0.01 * l_quantity - 2.0 * l_discount + 0.02 * l_quantity * l_discount AS fixed1, 0.5 + 1.5 * l_tax AS fixed2, CASE WHEN s_nationkey < 20 THEN s_nationkey / 100.0 ELSE 0 END AS admin, s_nationkey >= 20 AS admin_unseen FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
a AS (SELECT *, fixed1 + admin AS eta1, fixed2 + admin AS eta2 FROM f)"""


def _predicted(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    li = li.withColumns({"fixed1": predictor.fixed_contribution(FIXED, COLUMNS, ["intercept", "qty", "disc", "qty:disc"]), "fixed2": predictor.fixed_contribution(FIXED, COLUMNS, ["intercept", "tax"])})
    effects = spark.range(20).select(F.col("id").alias("index"), (F.col("id") / 100.0).alias("mean"))
    out = predictor.random_effect(li, effects, "s_nationkey", "admin", unseen="zero")
    return predictor.assemble(out, ["fixed1", "admin"], ["fixed2", "admin"], "l_quantity")


@query(f"WITH {PREDICTED} SELECT l_orderkey, l_linenumber, round(eta1, 6) AS eta1_mean, round(1 / (1 + exp(-eta1)), 6) AS tier1_probability_plugin, round(eta2, 6) AS eta2_mean, round(exp(eta2), 6) AS tier2_intensity_plugin FROM a")
def linear_predictor_components(spark, sf_dir):
    return rounded(_predicted(spark, sf_dir).select("l_orderkey", "l_linenumber", "eta1_mean", "tier1_probability_plugin", "eta2_mean", "tier2_intensity_plugin"), "eta1_mean", "tier1_probability_plugin", "eta2_mean", "tier2_intensity_plugin")


@query(f"WITH {PREDICTED} SELECT l_suppkey, l_returnflag, count(*) AS rows, count(DISTINCT l_linenumber) AS weeks FROM a WHERE admin_unseen GROUP BY ALL")
def random_lookup_unseen(spark, sf_dir):
    return predictor.unseen_levels(_predicted(spark, sf_dir), "l_suppkey", "l_returnflag", "admin_unseen", ["l_linenumber"])


@query(f"""WITH {PREDICTED}, e AS (SELECT l_returnflag, eta1 - round(eta1, 3) AS e FROM a) SELECT l_returnflag, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(quantile_cont(abs(e), 0.5), 6) AS median_abs, round(quantile_cont(abs(e), 0.99), 6) AS q99_abs, round(max(abs(e)), 6) AS max_abs FROM e GROUP BY 1""")
def reconstruction_audit(spark, sf_dir):
    p = _predicted(spark, sf_dir).withColumn("expected", F.round("eta1_mean", 3))
    out = metrics.reconstruction_audit(p, ["l_returnflag"], "expected", "eta1_mean").select("l_returnflag", "n", "mae", "rmse", "median_abs", "q99_abs", "max_abs")
    return rounded(out, "mae", "rmse", "median_abs", "q99_abs", "max_abs")


@query("SELECT l_returnflag, l_orderkey, l_linenumber, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY abs(l_quantity - 25) DESC, l_orderkey * 10 + l_linenumber) AS place FROM lineitem) WHERE place <= 20")
def worst_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("rid", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return metrics.worst_rows(li, ["l_returnflag"], F.col("l_quantity") - 25, "rid").select("l_returnflag", "l_orderkey", "l_linenumber", "place")


@query("""WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS w, generate_subscripts(embedding, 1) AS node FROM embeddings) SELECT vec_id AS "row", round(sum(w * node / 10.0), 4) AS value FROM u WHERE w <> 0 GROUP BY 1""")
def sparse_projection(spark, sf_dir):
    coo = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("node", "weight")).select("row", (F.col("node") + 1).alias("node"), F.lit(1).alias("group"), F.col("weight").cast("double").alias("weight")).where("weight <> 0")
    field = spark.range(1, 65).select(F.col("id").cast("int").alias("node"), F.lit(1).alias("group"), (F.col("id") / 10.0).alias("mean"))
    return rounded(mesh.project_field(coo, field), "value", digits=4)


@query("SELECT o_orderkey FROM (SELECT min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_orderpriority UNION SELECT min(o_orderkey) FROM orders GROUP BY o_orderstatus UNION SELECT min(o_orderkey) FROM orders GROUP BY o_custkey)")
def stratified_first_rows(spark, sf_dir):
    return predictor.stratified_first_rows(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus", "o_custkey"], "o_orderkey", 0).select("o_orderkey")


@query("SELECT \"check\", failures FROM (SELECT 0::BIGINT AS one_response_at_most, 0::BIGINT AS tier1_link, 0::BIGINT AS tier2_link, (SELECT count(*) FROM lineitem WHERE NOT l_tax > 0) AS tier2_exposure, (SELECT count(*) FROM labels WHERE quality NOT IN (0, 1)) AS binary_response, 0::BIGINT AS count_response) UNPIVOT (failures FOR \"check\" IN (one_response_at_most, tier1_link, tier2_link, tier2_exposure, binary_response, count_response))")
def joint_stack_checks(spark, sf_dir):
    t1 = table(spark, sf_dir, "labels")
    t2 = table(spark, sf_dir, "lineitem").withColumn("doc_id", F.col("l_orderkey"))
    return predictor.stack_checks(predictor.joint_stack(t1, t2, "quality", "l_quantity", "l_tax", "doc_id"))


# --- masks, persistence, fronts ------------------------------------------------------------

MASKED = EVENTS + ", m AS (SELECT event_id, epiyear, epiweek, cell_id, value, CASE WHEN user_id % 13 <> 0 THEN (user_id % 30)::DOUBLE END AS temperature FROM e), k AS (SELECT *, CASE WHEN temperature IS NOT NULL THEN CASE WHEN temperature >= 14.5 THEN value ELSE 0 END END AS masked, CASE WHEN temperature IS NOT NULL THEN CASE WHEN temperature >= 20 THEN value ELSE 0 END END AS strict FROM m)"


def _masked(spark, sf_dir):
    e = weekly_events(spark, sf_dir).withColumn("temperature", F.when(F.col("user_id") % 13 != 0, (F.col("user_id") % 30).cast("double")))
    return persistence.apply_mask(persistence.apply_mask(e, "value", "temperature", 14.5), "value", "temperature", 20.0, "strict")


@query(f"WITH {MASKED} SELECT event_id, masked, strict FROM k")
def temperature_mask(spark, sf_dir):
    return _masked(spark, sf_dir).select("event_id", "masked", "strict")


@query(f"WITH {MASKED} SELECT epiyear, epiweek, count(masked) AS supported, count(*) FILTER (masked = 0 AND value <> 0) AS zeroed, count(*) FILTER (masked IS NULL) AS missing, count(masked) - count(*) FILTER (masked = 0 AND value <> 0) AS retained, round(count(*) FILTER (masked = 0 AND value <> 0) / count(masked), 6) AS share_zeroed FROM k GROUP BY ALL")
def mask_weekly_audit(spark, sf_dir):
    return rounded(persistence.mask_audit(_masked(spark, sf_dir), ["epiyear", "epiweek"], "value"), "share_zeroed")


@query(f"WITH {MASKED} SELECT epiyear, epiweek, count(*) FILTER (masked > 0 AND coalesce(strict, 0) = 0) AS removed, count(*) FILTER (coalesce(masked, 0) = 0 AND strict > 0) AS violations FROM k GROUP BY ALL")
def mask_subset_compare(spark, sf_dir):
    return persistence.mask_comparison(_masked(spark, sf_dir), ["epiyear", "epiweek"], "masked", "strict")


PAIRS = NATION_WEEKS + ", b AS (SELECT o_orderkey, c_nationkey AS cell_id, isoyear(o_orderdate)::INTEGER AS epiyear, week(o_orderdate)::INTEGER AS epiweek FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'), v AS (SELECT b.*, g.value FROM b LEFT JOIN g USING (cell_id, epiyear, epiweek))"


def _urgent(spark, sf_dir):
    o = timeidx.with_week(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").withColumn("day", F.to_date("o_orderdate")), "day")
    return o.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("cell_id")), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "cell_id", "epiyear", "epiweek")


@query(f"WITH {PAIRS} SELECT o_orderkey, round(value, 2) AS value FROM v")
def same_week_pairs(spark, sf_dir):
    return rounded(grid.same_week_values(_urgent(spark, sf_dir), nation_weeks(spark, sf_dir), ["epiyear", "epiweek"]).select("o_orderkey", "value"), "value", digits=2)


@query(f"WITH {PAIRS} SELECT round(quantile_cont(value, 0.1), 2) AS threshold, count(*) AS total, count(value) AS used, count(*) FILTER (value = 0) AS zeros FROM v")
def dynamic_threshold(spark, sf_dir):
    out = persistence.dynamic_threshold(_urgent(spark, sf_dir), nation_weeks(spark, sf_dir).drop("time_index"), ["epiyear", "epiweek"])
    return rounded(out.select("threshold", "total", "used", "zeros"), "threshold", digits=2)


RUNS = NATION_WEEKS + """, i AS (SELECT cell_id, coalesce(value > {t}, false) AS f, time_index, row_number() OVER (PARTITION BY cell_id ORDER BY time_index) - sum(coalesce(value > {t}, false)::INTEGER) OVER (PARTITION BY cell_id ORDER BY time_index) AS island, value FROM g),
n AS (SELECT cell_id, island, sum(f::INTEGER) AS n, bool_or(value IS NOT NULL) AS ok FROM i GROUP BY ALL), l AS (SELECT cell_id, CASE WHEN bool_or(ok) THEN max(n) END::BIGINT AS longest_run FROM n GROUP BY 1),
k AS (SELECT *, longest_run * 7.0::DOUBLE / 21 AS rpi, CASE WHEN longest_run IS NULL THEN NULL WHEN longest_run / 3.0 < 3 THEN 0 WHEN longest_run / 3.0 < 8 THEN 1 WHEN longest_run / 3.0 < 15 THEN 2 ELSE 3 END::INTEGER AS rpi_class FROM l)"""


def _runs(spark, sf_dir, threshold: float):
    return persistence.persistence(persistence.longest_run(nation_weeks(spark, sf_dir), threshold, ["time_index"]))


@query(f"WITH {RUNS.format(t='200000.0')} SELECT cell_id, longest_run, round(rpi, 6) AS rpi, rpi_class FROM k")
def rpi_longest_run(spark, sf_dir):
    return rounded(_runs(spark, sf_dir, 200000.0), "rpi")


RPI_AREAS = "WITH " + NATION_WEEKS + """, q AS (SELECT quantile_cont(value, 0.10) AS t FROM g WHERE value > 0), i AS (SELECT cell_id, coalesce(value > t, false) AS f, row_number() OVER (PARTITION BY cell_id ORDER BY time_index) - sum(coalesce(value > t, false)::INTEGER) OVER (PARTITION BY cell_id ORDER BY time_index) AS island FROM g, q),
n AS (SELECT cell_id, island, sum(f::INTEGER) AS n FROM i GROUP BY ALL), l AS (SELECT cell_id, max(n) AS longest_run FROM n GROUP BY 1),
k AS (SELECT CASE WHEN longest_run / 3.0 < 3 THEN 0 WHEN longest_run / 3.0 < 8 THEN 1 WHEN longest_run / 3.0 < 15 THEN 2 ELSE 3 END AS c FROM l)
SELECT i::INTEGER AS rpi_class, count(c) AS cells, count(c) * 623.467152902406::DOUBLE AS area, round(count(c) / (SELECT count(*) FROM k), 6) AS share FROM range(4) r(i) LEFT JOIN k ON c = i GROUP BY 1"""


@query(RPI_AREAS)
def rpi_class_area(spark, sf_dir):
    """From order totals to class areas: the threshold is the first decile of all values."""
    stack = nation_weeks(spark, sf_dir)
    threshold = stack.where("value > 0").agg(F.percentile("value", F.lit(0.10)).alias("threshold"))
    runs = persistence.threshold_sweep(stack, threshold.withColumn("label", F.lit("p10")), ["time_index"])
    return rounded(persistence.class_areas(runs, 623.467152902406), "share")


@query("WITH " + NATION_WEEKS + """, th(label, t) AS (VALUES ('low', 50000.0), ('mid', 200000.0), ('high', 400000.0)), i AS (SELECT label, cell_id, coalesce(value > t, false) AS f, row_number() OVER (PARTITION BY label, cell_id ORDER BY time_index) - sum(coalesce(value > t, false)::INTEGER) OVER (PARTITION BY label, cell_id ORDER BY time_index) AS island FROM g, th),
n AS (SELECT label, cell_id, island, sum(f::INTEGER) AS n FROM i GROUP BY ALL) SELECT label, cell_id, max(n)::BIGINT AS longest_run, round(max(n) / 3.0, 6) AS rpi, CASE WHEN max(n) / 3.0 < 3 THEN 0 WHEN max(n) / 3.0 < 8 THEN 1 WHEN max(n) / 3.0 < 15 THEN 2 ELSE 3 END::INTEGER AS rpi_class FROM n GROUP BY ALL""")
def rpi_threshold_sweep(spark, sf_dir):
    thresholds = spark.createDataFrame([("low", 50000.0), ("mid", 200000.0), ("high", 400000.0)], "label string, threshold double")
    return rounded(persistence.threshold_sweep(nation_weeks(spark, sf_dir), thresholds, ["time_index"]), "rpi")


@query(f"WITH {RUNS.format(t='50000.0')}, a AS (SELECT cell_id, rpi_class AS f FROM k) SELECT f AS from_class, count(*) FILTER (c = 0) AS to_0, count(*) FILTER (c = 1) AS to_1, count(*) FILTER (c = 2) AS to_2, count(*) FILTER (c = 3) AS to_3 FROM a JOIN (SELECT cell_id, rpi_class AS c FROM (WITH {RUNS.format(t='200000.0')} SELECT * FROM k)) USING (cell_id) GROUP BY 1")
def rpi_transition(spark, sf_dir):
    return persistence.transitions(_runs(spark, sf_dir, 50000.0), _runs(spark, sf_dir, 200000.0))


STACK = "s AS (SELECT cell_id, epiyear, epiweek, sum(value) AS value FROM e GROUP BY ALL)"


def _stack(spark, sf_dir):
    return weekly_events(spark, sf_dir).groupBy("cell_id", "epiyear", "epiweek").agg(F.sum("value").alias("value"))


@query(f"WITH {EVENTS}, {STACK}, c AS (SELECT cell_id, avg(value) AS m, stddev_samp(value) AS d FROM s GROUP BY 1) SELECT cell_id, round(m, 6) AS mean, round(d, 6) AS sd, round(d / max(d) OVER (), 6) AS relative_sd, round(m * (1 - d / max(d) OVER ()), 6) AS stability FROM c")
def stability_index(spark, sf_dir):
    return rounded(grid.stability(_stack(spark, sf_dir)), "mean", "sd", "relative_sd", "stability")


@query(f"WITH {EVENTS}, s AS (SELECT cell_id, epiyear, epiweek, sum(user_id) * 1.0 AS value FROM e GROUP BY ALL) SELECT epiyear, epiweek, floor(sum(CASE WHEN value >= 500 THEN value ELSE 0 END))::BIGINT AS total FROM s GROUP BY ALL")
def weekly_sum_floor(spark, sf_dir):
    s = weekly_events(spark, sf_dir).groupBy("cell_id", "epiyear", "epiweek").agg((F.sum("user_id") * 1.0).alias("value"))
    return grid.weekly_sum_floor(s, ["epiyear", "epiweek"], 500.0)


@query(f"WITH {EVENTS}, {STACK} SELECT cell_id, epiyear, epiweek, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS scaled FROM s")
def rescale_minmax(spark, sf_dir):
    return rounded(grid.rescale_all(_stack(spark, sf_dir)).select("cell_id", "epiyear", "epiweek", "scaled"), "scaled")


FRONTS = EVENTS + ", d AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM e), f AS (SELECT d.day, CASE WHEN count(value) >= 5 THEN quantile_cont(value, 0.95) END AS front FROM d LEFT JOIN e ON e.day > d.day - 7 AND e.day <= d.day GROUP BY 1)"


@query(f"WITH {FRONTS} SELECT day::VARCHAR AS day, round(front, 6) AS front FROM f")
def rolling_front_quantile(spark, sf_dir):
    return dates_as_text(rounded(persistence.front_quantiles(table(spark, sf_dir, "events"), "ts", "value"), "front"))


@query(f"WITH {FRONTS} SELECT day::VARCHAR AS day, round(front, 6) AS front, round(CASE WHEN front - lag(front) OVER (ORDER BY day) > 0 THEN front - lag(front) OVER (ORDER BY day) ELSE 0 END, 6) AS advance, row_number() OVER (ORDER BY day)::INTEGER AS day_index FROM f")
def front_velocity(spark, sf_dir):
    return dates_as_text(rounded(persistence.front_velocity(persistence.front_quantiles(table(spark, sf_dir, "events"), "ts", "value")), "front", "advance"))


@query()
def front_smoothed(spark, sf_dir):
    return dates_as_text(rounded(persistence.smooth_walk(persistence.front_velocity(persistence.front_quantiles(table(spark, sf_dir, "events"), "ts", "value"))), "smoothed"))


# --- grid, places --------------------------------------------------------------------------

CELL = "CASE WHEN x BETWEEN 0 AND 10 AND y BETWEEN 0 AND 10 THEN least(floor((10 - y) / 1.0), 9) * 10 + least(floor(x / 1.0), 9) + 1 END::BIGINT"


@query(f"WITH {EVENTS} SELECT event_id, coalesce({CELL}, 0) AS grid_cell FROM e")
def cell_from_xy(spark, sf_dir):
    return weekly_events(spark, sf_dir).withColumn("grid_cell", F.coalesce(GRID.cell("x", "y"), F.lit(0))).select("event_id", "grid_cell")


def _raster(spark):
    return spark.range(1, 101).select(F.col("id").alias("cell_id"), F.when(F.col("id") % 6 != 0, (F.col("id") * 7 % 23).cast("double")).alias("value"))


RASTER = "v AS (SELECT i AS cell_id, CASE WHEN i % 6 <> 0 THEN (i * 7 % 23)::DOUBLE END AS value, ((i - 1) % 10) + 0.5 AS cx, 10 - ((i - 1) // 10) - 0.5 AS cy FROM range(1, 101) t(i))"


@query(f"WITH {EVENTS}, u AS (SELECT DISTINCT user_id, x, y FROM e), {RASTER}, n AS (SELECT user_id, cell_id, value, sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y)) AS d FROM u JOIN v ON value IS NOT NULL), b AS (SELECT * FROM n WHERE d <= 1.5 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY d, cell_id) = 1) SELECT user_id, cell_id AS nearest_cell, value AS nearest_value, round(d, 6) AS distance_km FROM b")
def nearest_cell(spark, sf_dir):
    u = weekly_events(spark, sf_dir).select("user_id", "x", "y").distinct()
    return rounded(grid.nearest_valid(u, _raster(spark), GRID, ["user_id"], 1.5), "distance_km")


@query(f"""WITH {EVENTS}, u AS (SELECT DISTINCT user_id, x, y FROM e), {RASTER}, k AS (SELECT user_id, floor(x - 0.5) + dc AS c, floor(9.5 - y) + dr AS r, (1 - abs(9.5 - y - floor(9.5 - y) - dr)) * (1 - abs(x - 0.5 - floor(x - 0.5) - dc)) AS w FROM u, range(2) a(dr), range(2) b(dc)),
g AS (SELECT user_id, w, CASE WHEN c BETWEEN 0 AND 9 AND r BETWEEN 0 AND 9 THEN r * 10 + c + 1 END AS cell_id FROM k WHERE w > 0) SELECT user_id, CASE WHEN count(value) = count(*) THEN round(sum(w * value), 6) END AS value FROM g LEFT JOIN v USING (cell_id) GROUP BY 1""")
def bilinear(spark, sf_dir):
    u = weekly_events(spark, sf_dir).select("user_id", "x", "y").distinct()
    return rounded(grid.bilinear(u, _raster(spark), GRID, ["user_id"]).select("user_id", "value"), "value")


@query(f"""WITH {EVENTS}, u AS (SELECT DISTINCT user_id, x, y FROM e), {RASTER}, k AS (SELECT user_id, floor(x - 0.5) + dc AS c, floor(9.5 - y) + dr AS r, (1 - abs(9.5 - y - floor(9.5 - y) - dr)) * (1 - abs(x - 0.5 - floor(x - 0.5) - dc)) AS w FROM u, range(2) a(dr), range(2) b(dc)),
g AS (SELECT user_id, w, CASE WHEN c BETWEEN 0 AND 9 AND r BETWEEN 0 AND 9 THEN r * 10 + c + 1 END AS cell_id FROM k WHERE w > 0), d AS (SELECT user_id, CASE WHEN count(value) = count(*) THEN sum(w * value) END AS direct FROM g LEFT JOIN v USING (cell_id) GROUP BY 1),
n AS (SELECT user_id, value, sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y)) AS km FROM u JOIN v ON value IS NOT NULL WHERE sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y)) <= 1.5 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY km, cell_id) = 1), o AS (SELECT user_id, direct, CASE WHEN direct IS NULL THEN n.value END AS near, CASE WHEN direct IS NULL THEN km END AS km FROM d LEFT JOIN n USING (user_id))
SELECT user_id, round(direct, 6) AS direct, round(coalesce(direct, near), 6) AS value, CASE WHEN direct IS NOT NULL THEN 'direct' WHEN near IS NOT NULL THEN 'fallback' ELSE 'unresolved' END AS method, round(km, 6) AS distance_km, CASE WHEN km <= 25 THEN '<=25 km' ELSE 'none' END AS distance_class FROM o""")
def extraction_fallback(spark, sf_dir):
    u = weekly_events(spark, sf_dir).select("user_id", "x", "y").distinct()
    return rounded(grid.extract_with_fallback(u, _raster(spark), GRID, ["user_id"], 1.5).select("user_id", "direct", "value", "method", "distance_km", "distance_class"), "direct", "value", "distance_km")


SQUARES = [(1, "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))"), (2, "POLYGON((4 0, 10 0, 10 6, 4 4, 4 0))"), (3, "POLYGON((0 4, 4 4, 10 6, 10 10, 0 10, 0 4))")]


def _edges(spark):
    return geometry.edges(spark.createDataFrame(SQUARES, "poly_id int, wkt string"))


EDGES = "p(poly_id, ring, x1, y1, x2, y2) AS (VALUES " + ", ".join(
    f"({k}, {i}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for k, wkt in SQUARES for i, ring in enumerate(geometry.rings_of(wkt)) for a, b in zip(ring, ring[1:], strict=False)
) + ")"


@query(f"""WITH {EVENTS}, u AS (SELECT DISTINCT user_id, x, y FROM e), {EDGES}, t AS (SELECT user_id, poly_id, sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (CASE WHEN y2 = y1 THEN 1 ELSE y2 - y1 END) + x1 THEN 1 ELSE 0 END) AS n,
bool_or(abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) <= 1e-12 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) AS on_edge FROM u, p GROUP BY ALL) SELECT user_id, poly_id::INTEGER AS poly_id FROM t WHERE on_edge OR n % 2 = 1""")
def points_in_polygons(spark, sf_dir):
    u = weekly_events(spark, sf_dir).select("user_id", "x", "y").distinct()
    return geometry.point_polygons(u, _edges(spark), ["user_id"])


@query()
def unit_assignment(spark, sf_dir):
    u = weekly_events(spark, sf_dir).select("user_id", "x", "y").distinct()
    return geometry.assign_unit(u, _edges(spark), spark.createDataFrame([(1, "b"), (2, "a"), (3, " ")], "poly_id int, unit string"), ["user_id"]).select("user_id", "admin_u")


@query(f"WITH {EVENTS}, u AS (SELECT DISTINCT user_id, x, y FROM e) SELECT user_id AS \"row\", round(3 * x - 2 * y, 6) AS value FROM u")
def mesh_projection(spark, sf_dir):
    """A linear field is projected without error, whatever the triangles."""
    nodes, triangles = mesh.structured_mesh(spark, 11, 11)
    u = weekly_events(spark, sf_dir).select("user_id", "x", "y").distinct()
    a = mesh.projector(u, nodes, triangles, "user_id")
    return rounded(mesh.project_field(a, nodes.select("node", F.lit(1).alias("group"), (3 * F.col("x") - 2 * F.col("y")).alias("mean"))), "value")


# --- sets, gates, text ---------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_key_check(spark, sf_dir):
    return sets.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_right, NOT EXISTS (SELECT * FROM a EXCEPT SELECT * FROM b) AND NOT EXISTS (SELECT * FROM b EXCEPT SELECT * FROM a) AS equal")
def setequal_check(spark, sf_dir):
    return sets.set_difference_counts(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))


@query("WITH c AS (SELECT p_size AS a, (p_partkey % 7 + 1) AS b, count(*) AS n FROM part GROUP BY ALL), g AS (SELECT i AS a, j AS b FROM range(1, 51) t(i), range(1, 8) u(j)) SELECT sum(coalesce(n, 0))::BIGINT AS rows, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (g.a IS NULL) AS unexpected, false AS complete FROM g FULL JOIN c ON g.a = c.a AND g.b = c.b")
def cross_product_check(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("a"), (F.col("p_partkey") % 7 + 1).alias("b"))
    return sets.cross_product_check(p, "a", "b", 50, 7)


@query("SELECT n_name, n_regionkey, row_number() OVER (ORDER BY list_position([3, 1, 4, 0, 2], n_regionkey), n_name)::INTEGER AS position FROM nation")
def custom_order(spark, sf_dir):
    place = F.array_position(F.array(*[F.lit(i) for i in (3, 1, 4, 0, 2)]), F.col("n_regionkey"))
    return table(spark, sf_dir, "nation").withColumn("position", F.row_number().over(Window.orderBy(place, "n_name"))).select("n_name", "n_regionkey", "position")


@query("WITH w AS (SELECT epiyear, epiweek, row_number() OVER (ORDER BY epiyear, epiweek) AS position, count(*) OVER () AS n FROM (SELECT DISTINCT isoyear(o_orderdate)::INTEGER AS epiyear, week(o_orderdate)::INTEGER AS epiweek FROM orders)) SELECT epiyear, epiweek, position::INTEGER AS position FROM w WHERE position IN (SELECT round_even(1 + i * (n - 1) / 3.0, 0) FROM range(4) t(i))")
def evenly_spaced_weeks(spark, sf_dir):
    return grid.evenly_spaced_rows(timeidx.index_weeks(table(spark, sf_dir, "orders"), "o_orderdate").drop("time_index"), ["epiyear", "epiweek"], 4)


@query("""WITH c AS (SELECT count(*) FILTER (l_quantity <= 0) AS a, count(*) FILTER (l_discount > 0.09) AS b, count(*) FILTER (l_tax IS NULL) AS d FROM lineitem) SELECT 'lineitem' AS gate, (a > 0)::BIGINT AS failure_count, (b > 0)::BIGINT AS warning_count, 3::BIGINT AS checks, CASE WHEN a > 0 THEN 'FAIL' WHEN b > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS outcome FROM c""")
def gate_outcome(spark, sf_dir):
    rules = [
        ("quantity", "BLOCKING", F.count(F.when(F.col("l_quantity") <= 0, 1)), "quantity is not positive"),
        ("discount", "WARNING", F.count(F.when(F.col("l_discount") > 0.09, 1)), "large discounts"),
        ("tax", "BLOCKING", F.count(F.when(F.col("l_tax").isNull(), 1)), "tax is missing"),
    ]
    return gates.outcome(gates.checks_from(table(spark, sf_dir, "lineitem"), "lineitem", rules), ["gate"])


@query("WITH u AS (SELECT DISTINCT p_size AS i FROM part WHERE p_size <= 60) SELECT count(*)::INTEGER AS active, coalesce((SELECT string_agg(i, ',' ORDER BY i) FROM range(1, 61) t(i) WHERE i NOT IN (SELECT i FROM u)), '') AS missing, round(count(*) / 60.0, 6) AS share, CASE WHEN count(*) < 5 THEN 'FAIL' WHEN count(*) < 60 THEN 'WARN' ELSE 'PASS' END AS status FROM u")
def bin_occupancy(spark, sf_dir):
    return rounded(gates.bin_occupancy(table(spark, sf_dir, "part"), "p_size", 60), "share")


@query("SELECT event_id, coalesce(json_extract_string(props, '$.key'), json_extract_string(props, '$.k')) AS k FROM events")
def json_alias_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.json_alias("props", "$.key", "$.k").alias("k"))


@query("""WITH h AS (SELECT sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}') AS h FROM nation), c AS (SELECT h[1:3] AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1) SELECT sha256(string_agg(p || h, '' ORDER BY p || h)) AS fingerprint FROM c""")
def canonical_fingerprint(spark, sf_dir):
    return files.set_fingerprint(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name"])


@query("SELECT o_custkey, CASE WHEN max(m) - min(m) + 1 = count(DISTINCT m) THEN min(m) || ':' || max(m) || ' (' || count(DISTINCT m) || ' timesteps)' ELSE string_agg(DISTINCT m::VARCHAR, ',' ORDER BY lpad(m::VARCHAR, 2, '0')) END AS label FROM (SELECT o_custkey, month(o_orderdate) AS m FROM orders) GROUP BY 1".replace("string_agg(DISTINCT m::VARCHAR, ',' ORDER BY lpad(m::VARCHAR, 2, '0'))", "array_to_string(list_sort(list_distinct(list(m))), ',')"))
def range_labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.month("o_orderdate")).alias("m")).select("o_custkey", text.range_label("m").alias("label"))


@query(f"""WITH {NATION_WEEKS}, q AS (SELECT time_index, cell_id, value ** 1.5 AS w FROM g WHERE value > 0), c AS (SELECT time_index, cell_id, sum(w) OVER (PARTITION BY time_index ORDER BY cell_id) / sum(w) OVER (PARTITION BY time_index) AS upper FROM q), sp AS (SELECT *, coalesce(lag(upper) OVER (PARTITION BY time_index ORDER BY cell_id), 0) AS lower FROM c),
u AS (SELECT time_index, i AS point, ('0x' || substr(md5('3|' || time_index || '|' || i), 1, 8))::BIGINT / 4294967296.0 AS u FROM w, range(1, 21) t(i)) SELECT u.time_index, u.point, sp.cell_id FROM u JOIN sp ON u.time_index = sp.time_index AND u >= lower AND u < upper""")
def simulate_points(spark, sf_dir):
    density = nation_weeks(spark, sf_dir).select("time_index", "cell_id", "value")
    return tiers.simulate_points(density, 20, 3)


@query("WITH s AS (SELECT l_returnflag, l_quantity - 25 AS v FROM lineitem) SELECT l_returnflag, count(*) AS rows, count(v) AS finite, count(*) FILTER (v = 0) AS zeros, round(count(*) FILTER (v = 0) / count(v), 6) AS zero_share, min(v) AS min, round(quantile_cont(v, 0.01), 6) AS p01, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS median, round(avg(v), 6) AS mean, max(v) AS max FROM s GROUP BY 1")
def distribution_audit(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_quantity") - 25)
    return rounded(reporting.distribution_audit(li, "v", ["l_returnflag"]), "zero_share", "p01", "p05", "p10", "median", "mean")


@query("WITH s AS (SELECT user_id % 4 AS c, (user_id * 53 % 103) / 10.0::DOUBLE AS lat FROM events) SELECT count(*) AS cells, round(quantile_cont(lat, 0.5), 6) AS median, round(quantile_cont(lat, 0.95), 6) AS q95, max(lat) AS max, count(*) FILTER (lat > 4) AS north_of_4, count(*) FILTER (lat > 8) AS north_of_8 FROM s WHERE c = 3")
def class_front(spark, sf_dir):
    e = weekly_events(spark, sf_dir).withColumn("rpi_class", F.col("user_id") % 4)
    return rounded(reporting.class_front(e, "y", lines=(4.0, 8.0)), "median", "q95")


@query("SELECT 'orders' AS variant, r AS rule, count(*) AS total, count(*) FILTER (CASE r WHEN 'urgent' THEN o_orderpriority = '1-URGENT' ELSE o_totalprice > 200000 END) AS supported, round(count(*) FILTER (CASE r WHEN 'urgent' THEN o_orderpriority = '1-URGENT' ELSE o_totalprice > 200000 END) / count(*), 6) AS share FROM orders, (VALUES ('urgent'), ('large')) t(r) GROUP BY r")
def variant_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return rounded(reporting.variant_counts({"orders": o}, {"urgent": F.col("o_orderpriority") == "1-URGENT", "large": F.col("o_totalprice") > 200000}), "share")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpi_class_area(spark, sf_dir)
