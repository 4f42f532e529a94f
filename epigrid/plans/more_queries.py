"""Further registered queries: smaller operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, text, timeidx
from ..operators import cleaning, gates, grid, hosts, metrics, predictor, reporting, responses, sets, tiers
from ..sources import files
from .queries import EVENTS, GRID, NATION_WEEKS, RASTER, _raster, nation_weeks, query, rounded, table, weekly_events

# --- filters, joins, sets ------------------------------------------------------------------

ORIGINS = "s AS (SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'obs_' || event_id ELSE 'quad_' || event_id END AS row_id, CASE WHEN event_type = 'purchase' THEN event_id END AS source_obs_id, CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END AS yi, user_id % 5 <> 0 AS inside_domain, user_id % 7 = 0 AS is_censored, value, isoyear(ts)::INTEGER AS epiyear, week(ts)::INTEGER AS epiweek FROM events), o AS (SELECT *, CASE WHEN yi = 1 AND source_obs_id IS NOT NULL THEN 'occurrence' WHEN yi = 0 AND source_obs_id IS NULL THEN 'quadrature' ELSE 'unclassified' END AS origin FROM s)"


def _origins(spark, sf_dir):
    e = weekly_events(spark, sf_dir)
    bought = F.col("event_type") == "purchase"
    e = e.withColumns({
        "row_id": F.concat(F.when(bought, "obs_").otherwise("quad_"), "event_id"), "source_obs_id": F.when(bought, F.col("event_id")), "Yi": F.when(F.col("event_type").isin("purchase", "error"), 1).otherwise(0),
        "inside_domain": F.col("user_id") % 5 != 0, "is_censored": F.col("user_id") % 7 == 0, "sc_Exp": F.lit(1.0), "prediction": F.col("value"),
    })
    return cleaning.source_origin(e, row_id="row_id")


@query(f"WITH {ORIGINS} SELECT event_id, origin FROM o")
def source_origin(spark, sf_dir):
    return _origins(spark, sf_dir).select("event_id", "origin")


@query(f"WITH {ORIGINS} SELECT event_id FROM o WHERE origin = 'quadrature' AND inside_domain AND NOT is_censored")
def reference_background(spark, sf_dir):
    return cleaning.reference_background(_origins(spark, sf_dir)).select("event_id")


@query("SELECT l_returnflag, l_linestatus, count(*) AS rows, count(*) - count(DISTINCT l_orderkey) AS repeated_ids, 0::BIGINT AS not_finite, count(*) FILTER (l_tax * 20 > 1) AS bad_probability, count(*) FILTER (l_discount <= 0) AS bad_intensity FROM lineitem GROUP BY ALL")
def weekly_faults(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_tax") * 20)
    return grid.weekly_faults(li, ["l_returnflag", "l_linestatus"], "l_orderkey", "p", "l_discount")


@query("SELECT \"column\", n_nonfinite FROM (SELECT count(*) FILTER (lat IS NULL) AS lat, 0::BIGINT AS value FROM (SELECT CASE WHEN user_id % 7 <> 0 THEN 1.0 END AS lat FROM events)) UNPIVOT (n_nonfinite FOR \"column\" IN (lat, value))")
def nonfinite_counts(spark, sf_dir):
    from ..functions.nulls import nonfinite_counts as count

    e = table(spark, sf_dir, "events").withColumn("lat", F.when(F.col("user_id") % 7 != 0, F.lit(1.0)).otherwise(F.lit(float("nan"))))
    return count(e, ["lat", "value"])


@query("SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def checked_left_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return sets.left_join_checked(table(spark, sf_dir, "orders"), c, ["o_custkey"]).select("o_orderkey", "c_mktsegment")


@query("SELECT c_custkey, coalesce(p, 'none') AS o_orderpriority FROM customer LEFT JOIN (SELECT o_custkey, min_by(o_orderpriority, o_orderkey) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey")
def first_match_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderkey")
    return sets.lookup(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", "o_orderpriority", ["o_orderkey"], default="none")


@query("WITH a AS (SELECT o_orderpriority AS k, count(*) AS v FROM orders GROUP BY 1), b AS (SELECT o_orderpriority AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT k, a.v AS reference, b.v AS production, b.v - a.v AS difference, round(b.v / a.v, 6) AS ratio FROM a JOIN b USING (k)")
def summary_comparison(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    count = lambda d: d.groupBy(F.col("o_orderpriority").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    return rounded(sets.summary_comparison(count(o), count(o.where("o_orderstatus = 'O'")), "k", "v"), "ratio")


@query("SELECT s_suppkey AS id, s_nationkey AS nation, '-' AS segment FROM supplier UNION ALL SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def union_filled(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return sets.union_filled(s, c).na.fill("-", ["segment"])


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def first_rows(spark, sf_dir):
    return cleaning.first_rows(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id")


@query(f"WITH {EVENTS} SELECT event_id, row_number() OVER (PARTITION BY epiyear, epiweek, cell_id ORDER BY event_id)::INTEGER AS occurrence FROM e")
def occurrence_ranks(spark, sf_dir):
    return tiers.occurrence_ranks(weekly_events(spark, sf_dir), ["epiyear", "epiweek", "cell_id"], "event_id").select("event_id", "occurrence")


# --- scalar functions ----------------------------------------------------------------------


@query("SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey::VARCHAR END, '<NA>') || '|' || s_name AS k, regexp_replace(s_name, '[^A-Za-z0-9_]+', '_', 'g') AS identifier, regexp_replace(lower(trim(s_name)), '[^a-z]', '', 'g') AS cleaned FROM supplier")
def keys_and_names(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("n", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")))
    return s.select("s_suppkey", text.composite_key("n", "s_name").alias("k"), text.safe_identifier("s_name").alias("identifier"), text.clean_host("s_name").alias("cleaned"))


@query("SELECT o_orderkey, (make_date(year(o_orderdate), 1, 1) + (dayofyear(o_orderdate) - 1)::INTEGER)::DATE::VARCHAR AS day, (year(o_orderdate) * 100 + month(o_orderdate) < 199806) AS early FROM orders")
def day_of_year_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", timeidx.day_of_year_date(F.year("o_orderdate"), F.dayofyear("o_orderdate")).cast("string").alias("day"), timeidx.before_week(F.year("o_orderdate"), F.month("o_orderdate"), 1998, 6).alias("early"))


@query("SELECT l_orderkey, l_linenumber, round(ln(greatest(1e-12, least(1 - 1e-12, l_discount * 9)) / (1 - greatest(1e-12, least(1 - 1e-12, l_discount * 9)))), 4) AS logit, round((l_quantity - 1) / 49 * 90 + 5, 6) AS scaled, CASE WHEN l_quantity <= 25 THEN '<=25 km' WHEN l_quantity <= 50 THEN '25-50 km' END AS distance FROM lineitem")
def scalar_numbers(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    out = li.select("l_orderkey", "l_linenumber", numbers.logit(F.col("l_discount") * 9).alias("logit"), numbers.rescale("l_quantity", F.lit(1.0), F.lit(50.0), 5.0, 95.0).alias("scaled"), numbers.distance_bin("l_quantity").alias("distance"))
    return rounded(rounded(out, "logit", digits=4), "scaled")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Northing' ELSE n_name END AS label FROM nation")
def effect_labels(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("term", F.when(F.col("n_nationkey") % 2 == 0, "north").otherwise(F.col("n_name")))
    return n.select("n_nationkey", text.effect_label("term").alias("label"))


@query("WITH p(parameter, component) AS (VALUES ('Range for tier1_field', 'Tier 1 SPDE'), ('Stdev for tier2_field', 'Tier 2 SPDE'), ('Precision for week_steps', 'Tier 1 weekly RW1'), ('Precision for admin_f', 'Tier 1 administrative IID'), ('Beta for tier2_shared', 'Tier 2 copy/shared field'), ('Precision for cattle_q', 'Cattle RW2'), ('size for the nbinomial observations', 'Negative-binomial likelihood'), ('other', 'INLA hyperparameter')) SELECT parameter AS source_name, component FROM p")
def hyperparameter_names(spark, sf_dir):
    names = ["Range for tier1_field", "Stdev for tier2_field", "Precision for week_steps", "Precision for admin_f", "Beta for tier2_shared", "Precision for cattle_q", "size for the nbinomial observations", "other"]
    return reporting.hyperparameters(spark.createDataFrame([(n,) for n in names], "parameter string")).select("source_name", "component")


@query("SELECT p_size AS q, round(avg(p_retailprice) * (p_size - 25), 4) AS mean, round(CASE WHEN p_size < 25 THEN max(p_retailprice) ELSE min(p_retailprice) END * (p_size - 25), 4) AS q025, round(CASE WHEN p_size < 25 THEN min(p_retailprice) ELSE max(p_retailprice) END * (p_size - 25), 4) AS q975 FROM part GROUP BY 1")
def weighted_effects(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    e = p.groupBy(F.col("p_size").alias("q")).agg(F.avg("p_retailprice").alias("mean"), F.min("p_retailprice").alias("q025"), F.avg("p_retailprice").alias("median"), F.max("p_retailprice").alias("q975"))
    return rounded(reporting.weighted_effects(e, e.select("q", (F.col("q") - 25).alias("w")), "q", "w"), "mean", "q025", "q975", digits=4)


# --- grids, predictor, gates ---------------------------------------------------------------


@query(f"WITH {RASTER} SELECT v.cell_id, t.x AS value FROM v LEFT JOIN (SELECT p_size * 2 AS cell_id, max(p_retailprice) AS x FROM part GROUP BY 1) t USING (cell_id)")
def assign_to_grid(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy((F.col("p_size") * 2).cast("long").alias("cell_id")).agg(F.max("p_retailprice").alias("v"))
    return grid.assign_to_grid(p, GRID, "v")


@query(f"WITH {EVENTS}, {RASTER}, c AS (SELECT e.event_id, CASE WHEN x BETWEEN 0 AND 10 AND y BETWEEN 0 AND 10 THEN least(floor((10 - y) / 1.0), 9) * 10 + least(floor(x / 1.0), 9) + 1 END AS cell_id FROM e) SELECT count(*) AS total, count(c.cell_id) AS inside_extent, count(v.value) AS supported, count(v.value) > 0 AS any_supported FROM c LEFT JOIN v ON v.cell_id = c.cell_id")
def extent_audit(spark, sf_dir):
    return grid.extent_audit(weekly_events(spark, sf_dir), GRID, _raster(spark))


@query(f"WITH {RASTER}, t AS (SELECT abs(cx + (cell_id % 3) / 100.0 - cx) AS dx, abs(cy - cy) AS dy FROM v) SELECT round(quantile_cont(dx, 0.5), 6) AS dx_median, round(quantile_cont(dx, 0.95), 6) AS dx_q95, round(max(dx), 6) AS dx_max, 0.0::DOUBLE AS dy_max, false AS within FROM t")
def coordinate_check(spark, sf_dir):
    x, y = GRID.center("cell_id")
    t = _raster(spark).withColumns({"x": x + (F.col("cell_id") % 3) / 100.0, "y": y})
    return rounded(grid.coordinate_check(t, GRID).select("dx_median", "dx_q95", "dx_max", "dy_max", "within"), "dx_median", "dx_q95", "dx_max", "dy_max")


@query("SELECT p_size, count(*) AS \"full\", count(*) FILTER (p_partkey % 3 <> 0) AS active, count(*) FILTER (p_partkey % 3 = 1) AS positive, min(p_retailprice) AS midpoint FROM part GROUP BY 1")
def bin_support(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("y", F.when(F.col("p_partkey") % 3 != 0, F.when(F.col("p_partkey") % 3 == 1, 1).otherwise(0)))
    return predictor.bin_support(p, "p_size", "y", "p_retailprice")


@query("SELECT l_linestatus AS criterion, round(sum(l_tax), 4) AS local_sum, count(DISTINCT l_returnflag) AS families, true AS reconciled FROM lineitem GROUP BY 1")
def criteria_by_family(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    local = li.select(F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("criterion"), F.col("l_tax").alias("value"))
    totals = li.groupBy(F.col("l_linestatus").alias("criterion")).agg(F.sum("l_tax").alias("value"))
    return rounded(predictor.criteria_by_family(local, totals, "family").select("criterion", "local_sum", "families", "reconciled"), "local_sum", digits=4)


@query("SELECT round(avg((c_mktsegment <> 'BUILDING')::INTEGER), 6) AS mapped_share FROM customer")
def mapping_rate(spark, sf_dir):
    return rounded(gates.mapping_rate(table(spark, sf_dir, "customer"), "c_mktsegment", "BUILDING"), "mapped_share")


@query("SELECT CASE WHEN (SELECT count(*) FROM lineitem WHERE l_discount > 0.09) > 0 THEN 'PASS_WITH_NONBLOCKING_WARNINGS' ELSE 'PASS' END AS outcome")
def acceptance(spark, sf_dir):
    one = table(spark, sf_dir, "lineitem").agg(F.when(F.count(F.when(F.col("l_discount") > 0.09, 1)) > 0, "WARNING").otherwise("PASS").alias("status"))
    return gates.acceptance(one)


@query("WITH s AS (SELECT user_id % 3 AS variable, (user_id % 6)::VARCHAR AS week_id, count(*) AS n FROM events GROUP BY ALL), v AS (SELECT DISTINCT user_id % 3 AS variable FROM events), w AS (SELECT i::VARCHAR AS week_id FROM range(7) t(i)) SELECT v.variable::VARCHAR AS variable, w.week_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' END AS problem FROM v CROSS JOIN w LEFT JOIN s USING (variable, week_id) WHERE n IS NULL OR n > 1")
def lineage_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 3).cast("string").alias("variable"), (F.col("user_id") % 6).cast("string").alias("week_id"), F.lit("f").alias("fingerprint"), F.lit("0" * 64).alias("sha256"))
    weeks = spark.range(7).select(F.col("id").cast("string").alias("week_id"))
    return files.lineage_coverage(e, e, weeks)


@query(f"WITH {NATION_WEEKS}, d AS (SELECT cell_id, value FROM g) SELECT cell_id, round(corr(rx, ry), 6) AS spearman FROM (SELECT cell_id, rank() OVER (PARTITION BY cell_id ORDER BY value) + (count(*) OVER (PARTITION BY cell_id, value) - 1) / 2.0 AS rx, row_number() OVER (PARTITION BY cell_id ORDER BY time_index) AS ry FROM g WHERE value IS NOT NULL) GROUP BY 1")
def cell_trend(spark, sf_dir):
    """Rank correlation of value and week in each cell."""
    return rounded(metrics.spearman(nation_weeks(spark, sf_dir), "value", "time_index", ["cell_id"]), "spearman")


@query("SELECT o_orderkey, response FROM (SELECT o_orderkey, coalesce(nullif(o_orderkey % 4, 0), -1) AS response FROM orders)")
def zero_policy(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("response"))
    return responses.zero_policy(o, "exclude", "response").na.fill(-1, ["response"])


@query(f"WITH {EVENTS} SELECT event_id, round(y - (SELECT min(y) - 25 FROM e), 6) AS northing FROM e")
def northing(spark, sf_dir):
    return rounded(responses.northing(weekly_events(spark, sf_dir)).select("event_id", "northing"), "northing")


@query("SELECT common_name, count(*) AS n FROM (SELECT unnest(CASE WHEN p_name LIKE '%ring' THEN ['Ring'] ELSE ['Unreported'] END) AS common_name FROM part) GROUP BY 1")
def host_single_pattern(spark, sf_dir):
    x = hosts.expand_hosts(table(spark, sf_dir, "part"), hosts.pattern_table(spark, [("ring$", "Ring", "Birds")]), "p_name", "p_partkey")
    return x.groupBy("common_name").agg(F.count(F.lit(1)).alias("n"))
