"""Registered queries for gates, lineage, contracts and report tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import places, text, timeidx
from ..operators import cleaning, gate_rules, grid, metrics, persistence, predictor, reporting, sets
from ..sources import files, tables
from . import config
from .queries import EVENTS, GRID, NATION_WEEKS, ORACLES, RASTER, _raster, boyce_curve, nation_weeks, query, rounded, table, weekly_events


def checks_sql(*parts: tuple[str, list[tuple[str, str, str]]], start: str = "") -> str:
    """SQL of check rows: (from clause, [(check, severity, failures)])."""
    whole = lambda e: f"(count(*) * 0 + {e})" if e.isdigit() else e
    parts = [(frm, [(n, s, whole(e)) for n, s, e in rules]) for frm, rules in parts]
    one = [f"SELECT '{n}' AS \"check\", '{s}' AS severity, CASE WHEN coalesce({e}, 0) = 0 THEN 'PASS' WHEN '{s}' = 'WARNING' THEN 'WARN' ELSE 'FAIL' END AS status, coalesce({e}, 0)::BIGINT::VARCHAR AS observed FROM {frm}" for frm, rules in parts for n, s, e in rules]
    return start + " UNION ALL ".join(one)


def shown(checks):
    return checks.select("check", "severity", "status", "observed")


# --- gates ---------------------------------------------------------------------------------

PREPARED = f"WITH {NATION_WEEKS}, p AS (SELECT *, CASE WHEN cell_id % 5 = 0 AND time_index % 50 = 0 THEN NULL ELSE cell_id * 1.0 END AS x, ((time_index - 1) % 4 + 1) AS q4, CASE WHEN cell_id % 3 = 0 THEN 5 ELSE cell_id % 3 END AS g3 FROM g), "


def _prepared(spark, sf_dir):
    t, c = F.col("time_index"), F.col("cell_id")
    return nation_weeks(spark, sf_dir).withColumns({"x": F.when(~((c % 5 == 0) & (t % 50 == 0)), c * 1.0), "q4": (t - 1) % 4 + 1, "g3": F.when(c % 3 == 0, 5).otherwise(c % 3)})


@query(checks_sql(("p, n", [
    ("dynamic_horizon", "BLOCKING", "any_value((weeks <> (SELECT count(*) FROM (SELECT DISTINCT epiyear, epiweek FROM p)))::INTEGER)"), ("supported_cells", "BLOCKING", "(count(DISTINCT cell_id) <> 25)::INTEGER"),
    ("dynamic_dimensions", "BLOCKING", "(count(*) <> any_value(weeks) * 25)::INTEGER"), ("required_columns", "BLOCKING", "1"), ("model_covariates_finite", "BLOCKING", "count(*) FILTER (x IS NULL OR epiyear IS NULL)"),
    ("group_q4", "BLOCKING", "count(*) FILTER (NOT q4 BETWEEN 1 AND 4) + 4 - count(DISTINCT q4)"), ("group_g3", "BLOCKING", "count(*) FILTER (NOT g3 BETWEEN 1 AND 3) + 3 - count(DISTINCT g3) FILTER (g3 BETWEEN 1 AND 3)"),
]), start=PREPARED + "n AS (SELECT count(*) AS weeks FROM w) "))
def gate_prepare(spark, sf_dir):
    p = _prepared(spark, sf_dir)
    weeks = timeidx.index_weeks(table(spark, sf_dir, "orders"), "o_orderdate").count()
    return shown(gate_rules.prepare_gate(p, weeks, 25, {"q4": 4, "g3": 3}, ["x", "epiyear", "humidity"]))


@query(checks_sql(("l", [
    ("artifacts_readable", "BLOCKING", "count(*) FILTER (NOT here)"), ("parents_named", "BLOCKING", "count(*) FILTER (parent IS NOT NULL AND rp IS DISTINCT FROM parent)"), ("parents_hashed", "BLOCKING", "count(*) FILTER (parent IS NOT NULL AND rs IS DISTINCT FROM s)"),
]), start="WITH l AS (SELECT p_partkey % 11 <> 0 AS here, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS parent, CASE WHEN p_partkey % 13 <> 0 THEN p_brand END AS rp, md5(p_name) AS rs, CASE WHEN p_partkey % 17 = 0 THEN md5(p_type) ELSE md5(p_name) END AS s FROM part) "))
def gate_lineage(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select((k % 11 != 0).alias("exists"), F.when(k % 4 != 0, F.col("p_brand")).alias("parent"), F.when(k % 13 != 0, F.col("p_brand")).alias("recorded_parent"), F.md5("p_name").alias("recorded_sha256"), F.when(k % 17 == 0, F.md5("p_type")).otherwise(F.md5("p_name")).alias("sha256"))
    return shown(gate_rules.lineage_gate(p, "lineage"))


SECTIONS = ["fixed", "hyper", *gate_rules.COMPONENTS]
SUMMARIES = "s AS (SELECT list_extract([" + ", ".join(f"'{x}'" for x in SECTIONS) + "], (p_size % 8 + 1)::INTEGER) AS section, CASE WHEN p_partkey % 97 <> 0 THEN p_retailprice END AS mean, CASE WHEN p_partkey % 89 = 0 THEN 'NaN'::DOUBLE ELSE 1.0 END AS sd FROM part)"


def _summaries(spark, sf_dir):
    k = F.col("p_partkey")
    section = F.array(*[F.lit(x) for x in SECTIONS])[(F.col("p_size") % 8).cast("int")]
    return table(spark, sf_dir, "part").select(section.alias("section"), F.when(k % 97 != 0, F.col("p_retailprice")).alias("mean"), F.when(k % 89 == 0, F.lit(float("nan"))).otherwise(1.0).alias("sd"), F.lit(0.0).alias("q025"), F.lit(None).cast("double").alias("q975"), F.col("p_name").alias("term"))


def _run(spark, sf_dir):
    n = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("c"), F.count(F.when(F.col("o_totalprice") > 400000, 1)).alias("w"))
    return n.select(F.array(F.lit("binomial"), F.lit("nbinomial")).alias("families"), F.lit("Success").alias("status"), (F.col("n") > 0).alias("ok"), F.lit("previous_theta").alias("configured"), F.lit("previous_theta").alias("recorded"), (F.col("c") < 0).alias("theta_ok"), F.col("n").alias("n_observed"), F.col("c").alias("n_latent"), (F.col("n") + F.col("c")).alias("n_total"), F.col("n").alias("stack_rows"), F.col("w").alias("warnings"))


CRITERIA = [("dic", True, 1.0), ("waic", True, None), ("marginal_log_likelihood", False, 2.0)]
HEALTH_SQL = checks_sql(
    ("r", [("likelihood_families", "BLOCKING", "0"), ("fit_completion_status", "BLOCKING", "0"), ("fit_internal_ok", "BLOCKING", "(n = 0)::INTEGER"), ("initialization_provenance", "WARNING", "0"), ("theta_initialization_provenance", "WARNING", "1"), ("joint_stack_structure", "BLOCKING", "0"), ("predictor_layout", "BLOCKING", "0"), ("fit_warnings_recorded", "WARNING", "w")]),
    ("s", [("required_random_components", "BLOCKING", "7 - count(DISTINCT section) FILTER (section NOT IN ('fixed', 'hyper'))"), *[(f"summary_{x}_finite", "BLOCKING", f"count(*) FILTER (section = '{x}' AND (mean IS NULL OR isnan(sd))) + (count(*) FILTER (section = '{x}') = 0)::INTEGER") for x in SECTIONS]]),
    ("(SELECT 1)", [("dic_finite", "WARNING", "0"), ("waic_finite", "WARNING", "1"), ("marginal_log_likelihood_finite", "WARNING", "1")]),
    start=f"WITH {SUMMARIES}, r AS (SELECT count(*) AS n, count(*) FILTER (o_totalprice > 400000) AS w FROM orders) ",
)


def _health(spark, sf_dir):
    return gate_rules.fit_health(_run(spark, sf_dir), _summaries(spark, sf_dir), spark.createDataFrame(CRITERIA, "criterion string, requested boolean, value double"))


@query(HEALTH_SQL)
def fit_health(spark, sf_dir):
    """One component has no summary, some have values that are not finite."""
    return shown(_health(spark, sf_dir))


@query(f"WITH h AS ({HEALTH_SQL}) " + checks_sql(("h", [("fit_health_structure", "BLOCKING", "count(*) FILTER (severity = 'BLOCKING' AND status = 'FAIL')"), ("historical_fit_diagnostics", "WARNING", "count(*) FILTER (status = 'WARN')")])))
def gate_fit(spark, sf_dir):
    return shown(gate_rules.fit_gate(_health(spark, sf_dir)))


FITTED = "f AS (SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'tier1' ELSE 'tier2' END AS tier, CASE WHEN l_orderkey % 50 = 1 THEN 2 WHEN l_linenumber % 2 = 1 THEN 1 ELSE 2 END AS link, CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 2 END AS family, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS y, l_returnflag <> 'A' AS test, (l_discount * 11)::DOUBLE AS m FROM lineitem)"


def _fitted(spark, sf_dir):
    one = F.col("l_linenumber") % 2 == 1
    return table(spark, sf_dir, "lineitem").select(
        F.when(one, "tier1").otherwise("tier2").alias("tier"), F.when(F.col("l_orderkey") % 50 == 1, 2).when(one, 1).otherwise(2).alias("link"), F.when(one, 1).otherwise(2).alias("family_index"), F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("response_training"),
        (F.col("l_returnflag") != "A").alias("is_test_point"), (F.col("l_discount") * 11).cast("double").alias("fitted_mean"),
    )


@query(checks_sql(
    ("f", [("tier_row_counts", "BLOCKING", "0"), ("active_training_counts", "BLOCKING", "0"), ("holdout_rows", "BLOCKING", "count(*) FILTER (test AND y IS NOT NULL)"), ("likelihood_link_counts", "BLOCKING", "count(*) FILTER (link <> family)"), ("named_tier_indices", "BLOCKING", "count(*) FILTER (link <> family)"), ("observed_fitted_values_finite", "BLOCKING", "0"),
      ("tier1_fitted_probability_range", "BLOCKING", "count(*) FILTER (link = 1 AND NOT m BETWEEN 0 AND 1)"), ("tier2_fitted_positive", "BLOCKING", "count(*) FILTER (link = 2 AND NOT m > 0)")]),
    ("part", [("fixed_count", "BLOCKING", "(count(DISTINCT p_size) <> 16)::INTEGER"), ("hyper_count", "BLOCKING", "0"), ("random_count", "BLOCKING", "0"), ("admin_levels_count", "BLOCKING", "1"), ("admin_fitted_count", "BLOCKING", "1"), ("cattle_bins_count", "BLOCKING", "1")]), start=f"WITH {FITTED} "))
def extraction_audit(spark, sf_dir):
    f = _fitted(spark, sf_dir)
    counts = table(spark, sf_dir, "part").agg(F.count_distinct("p_size").alias("n")).select(F.lit("fixed").alias("name"), "n").unionByName(spark.createDataFrame([("hyper", 10), ("random", 7), ("admin_levels", 25)], "name string, n long"))
    return shown(gate_rules.extraction_audit(f, f.drop("link"), counts))


@query(checks_sql(("e, n", [(f"{c}_support", "BLOCKING", f"count(*) FILTER (c = '{c}' AND NOT known) + count(*) FILTER (c = '{c}' AND known) - count(DISTINCT t) FILTER (c = '{c}' AND known) + any_value(weeks) - count(DISTINCT t) FILTER (c = '{c}' AND known)") for c in ("week_steps", "tier2_week")]),
       start=f"WITH {NATION_WEEKS}, n AS (SELECT count(*) AS weeks FROM w), e AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'week_steps' ELSE 'tier2_week' END AS c, o_orderkey % 400 AS t, EXISTS (SELECT 1 FROM w WHERE time_index = o_orderkey % 400) AS known FROM orders) "))
def temporal_support(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    effects = o.select(F.when(F.col("o_orderkey") % 2 == 0, "week_steps").otherwise("tier2_week").alias("component"), (F.col("o_orderkey") % 400).cast("int").alias("time_index"))
    return shown(gate_rules.temporal_support(effects, timeidx.index_weeks(o, "o_orderdate")))


@query(checks_sql(
    ("f", [("stage2_holdout_counts", "BLOCKING", "(count(*) FILTER (test AND m < 1) <> count(*) FILTER (test))::INTEGER")]),
    ("(SELECT * FROM f WHERE test AND m < 1)", [("holdout_rows_are_test_points", "BLOCKING", "0"), ("holdout_response_finite", "BLOCKING", "count(*) FILTER (y IS NULL)"), ("family_labels", "BLOCKING", "count(*) FILTER (link <> family)"), ("same_week_percentile_coverage", "BLOCKING", "count(*) FILTER (tier = 'tier1' AND m = 0)")]),
    ("lineitem", [("background_terrestrial_support", "BLOCKING", "(count(*) = 0)::INTEGER"), ("background_weighting", "BLOCKING", "count(*) FILTER (NOT l_tax > 0)")]),
    ("(SELECT 1)", [("PB_AUC_area_weighted", "WARNING", "0"), ("PB_AUC_unweighted", "WARNING", "1"), ("continuous_boyce_area_weighted", "WARNING", "1"), ("continuous_boyce_unweighted", "WARNING", "1"), ("mae", "WARNING", "0"), ("rmse", "WARNING", "1"), ("pearson", "WARNING", "1"), ("spearman", "WARNING", "1")]), start=f"WITH {FITTED} "))
def validation_audit(spark, sf_dir):
    f = _fitted(spark, sf_dir)
    holdout = f.where("is_test_point and fitted_mean < 1").select("tier", "is_test_point", F.col("response_training").alias("response"), F.when(F.col("link") == 1, "binomial").otherwise("nbinomial").alias("family"), F.nullif("fitted_mean", F.lit(0.0)).alias("percentile"))
    scores = spark.createDataFrame([("PB_AUC_area_weighted", 0.7), ("mae", 0.1), ("rmse", float("nan"))], "metric string, value double")
    return shown(gate_rules.validation_audit(holdout, f, scores, table(spark, sf_dir, "lineitem").select(F.col("l_tax").alias("weight"))))


PRODUCTS = "p AS (SELECT name, rows, expected_rows, faults FROM (VALUES " + ", ".join(f"('{n}', {r}, {e}, {f})" for n, r, e, f in (
    ("fit", "(SELECT count(*) FROM part)", "NULL", "NULL"), ("hosts", "(SELECT count(*) FROM customer)", "NULL", "(SELECT count(*) FROM customer WHERE c_acctbal < 0)"), ("host_assignments", "(SELECT count(*) FROM customer)", "(SELECT count(*) FROM orders)", "0"), ("rpi_classes", "(SELECT count(*) FROM nation)", "25", "0"), ("manifest", "1", "1", "0"))) + ") t(name, rows, expected_rows, faults))"
REPORT_SQL = {"there": "(count(*) FILTER (name = '{n}' AND rows > 0) = 0)::INTEGER", "whole": "(count(*) FILTER (name = '{n}' AND rows > 0 AND rows IS NOT DISTINCT FROM expected_rows) = 0)::INTEGER", "faultless": "(count(*) FILTER (name = '{n}' AND rows > 0 AND coalesce(faults, 0) = 0) = 0)::INTEGER"}


@query(checks_sql(("p", [(c, "WARNING" if c in gate_rules.REPORT_WARNINGS else "BLOCKING", REPORT_SQL[asks].format(n=n)) for c, (n, asks) in gate_rules.REPORT_CHECKS.items()]), start=f"WITH {PRODUCTS} "))
def reporting_qa(spark, sf_dir):
    count = lambda name, t, expected=None, faults=None: table(spark, sf_dir, t).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), (expected if expected is not None else F.lit(None)).cast("long").alias("expected_rows"), (faults if faults is not None else F.lit(None)).cast("long").alias("faults"))
    orders = table(spark, sf_dir, "orders").count()
    parts = [count("fit", "part"), count("hosts", "customer", None, F.count(F.when(F.col("c_acctbal") < 0, 1))), count("host_assignments", "customer", F.lit(orders), F.lit(0)), count("rpi_classes", "nation", F.lit(25), F.lit(0)), spark.createDataFrame([("manifest", 1, 1, 0)], "name string, rows long, expected_rows long, faults long")]
    return shown(gate_rules.reporting_qa(gate_rules.union(*parts)))


@query(checks_sql(("(SELECT DISTINCT p_size AS k, CASE WHEN p_size % 7 = 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM part)", [
    *[(c, "BLOCKING", f"(NOT (count(*) FILTER (k = {i + 1}) > 0 AND count(*) FILTER (k = {i + 1} AND status = 'FAIL') = 0))::INTEGER") for i, c in enumerate(gate_rules.POSTFIT)], ("unseen_administrative_support", "WARNING", "3")])))
def gate_postfit(spark, sf_dir):
    """An audit for each size of part; the names of the gate's checks are those of sizes 1 to 15."""
    names = F.array(*[F.lit(c) for c in gate_rules.POSTFIT])
    audits = table(spark, sf_dir, "part").select("p_size").distinct().select(F.coalesce(F.get(names, F.col("p_size").cast("int") - 1), F.lit("other")).alias("check"), F.lit(1).alias("rows"), F.when(F.col("p_size") % 7 == 0, "FAIL").otherwise("PASS").alias("status"))
    return shown(gate_rules.postfit_gate(audits, 3))


STACK = "k AS (SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'tier1' ELSE 'tier2' END AS tier, CASE WHEN l_orderkey % 60 = 1 THEN 1 WHEN l_linenumber % 2 = 1 THEN 1 ELSE 2 END AS link, CASE WHEN l_linenumber % 2 = 1 THEN l_linenumber % 3 END::DOUBLE AS y1, CASE WHEN l_linenumber % 2 = 0 OR l_orderkey % 40 = 1 THEN l_quantity / 2 END::DOUBLE AS y2, (CASE WHEN l_linenumber % 2 = 0 THEN l_tax END)::DOUBLE AS exposure, l_quantity / 2.0 AS i FROM lineitem)"


@query(checks_sql(("k", [
    ("one_response", "BLOCKING", "count(*) FILTER (y1 IS NOT NULL AND y2 IS NOT NULL)"), ("links", "BLOCKING", "count(*) FILTER (NOT ((tier = 'tier1' AND link = 1) OR (tier = 'tier2' AND link = 2)))"), ("binary_response", "BLOCKING", "count(*) FILTER (y1 NOT IN (0, 1))"), ("count_response", "BLOCKING", "count(*) FILTER (y2 < 0 OR y2 <> floor(y2))"),
    ("exposure", "BLOCKING", "count(*) FILTER (tier = 'tier2' AND NOT coalesce(exposure > 0, false))"), ("both_tiers", "BLOCKING", "0"), ("some_training", "BLOCKING", "0"), ("index_i", "BLOCKING", "count(*) FILTER (i <> floor(i) OR NOT i BETWEEN 1 AND 30)"), ("levels_i", "WARNING", "30 - count(DISTINCT i) FILTER (i BETWEEN 1 AND 30)"),
]), start=f"WITH {STACK} "))
def preflight(spark, sf_dir):
    odd, k = F.col("l_linenumber") % 2 == 1, F.col("l_orderkey")
    stack = table(spark, sf_dir, "lineitem").select(
        F.when(odd, "tier1").otherwise("tier2").alias("tier"), F.when(k % 60 == 1, 1).when(odd, 1).otherwise(2).alias("link"), F.when(odd, (F.col("l_linenumber") % 3).cast("double")).alias("y1"), F.when(~odd | (k % 40 == 1), (F.col("l_quantity") / 2).cast("double")).alias("y2"),
        F.when(~odd, F.col("l_tax").cast("double")).alias("exposure"), (F.col("l_quantity") / 2).cast("double").alias("i"),
    )
    return shown(gate_rules.preflight(stack, {"i": 30}))


@query(checks_sql(
    ("e", [("rows", "BLOCKING", "0"), ("coordinates", "BLOCKING", "count(*) FILTER (user_id % 9 = 0)"), ("repeats", "WARNING", "count(*) - (SELECT count(*) FROM (SELECT DISTINCT epiyear, epiweek, CASE WHEN user_id % 9 <> 0 THEN x END, y FROM e WHERE user_id % 9 <> 0))"), ("mapping_rate", "WARNING", "(avg((event_type <> 'error')::INTEGER::DOUBLE) < 0.99)::INTEGER")]),
    ("w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.epiyear = w.epiyear AND e.epiweek = w.epiweek)", [("weeks_with_records", "WARNING", "count(*)")]),
    ("(SELECT DISTINCT user_id % 4 AS v FROM e) a, w WHERE NOT EXISTS (SELECT 1 FROM e WHERE user_id % 4 = v AND e.epiyear = w.epiyear AND e.epiweek = w.epiweek AND event_type = 'purchase')", [("weeks_with_covariates", "BLOCKING", "count(*)")]),
    start=f"WITH {EVENTS}, w AS (SELECT 2024 AS epiyear, i AS epiweek FROM range(1, 9) t(i)) "))
def input_preflight(spark, sf_dir):
    e = weekly_events(spark, sf_dir).withColumn("x", F.when(F.col("user_id") % 9 != 0, F.col("x")))
    weeks = spark.range(1, 9).select(F.lit(2024).alias("epiyear"), F.col("id").cast("int").alias("epiweek"))
    covariates = weekly_events(spark, sf_dir).where("event_type = 'purchase'").select((F.col("user_id") % 4).alias("variable"), "epiyear", "epiweek")
    return shown(gate_rules.input_preflight(e, weeks, covariates, F.col("event_type") != "error", 0.99))


OUTPUT = f"{NATION_WEEKS}, t AS (SELECT cell_id, epiyear, epiweek, time_index, cell_id || '_' || time_index AS k, value FROM g), z AS (SELECT *, CASE WHEN cell_id % 10 <> 0 THEN 1.0 END AS x, value IS NULL AS bad, time_index % 5 + 1 AS grp FROM t WHERE time_index % 20 <> 0)"


def _output(spark, sf_dir):
    g = nation_weeks(spark, sf_dir).withColumn("space_time_id", F.concat_ws("_", "cell_id", "time_index"))
    out = g.where("time_index % 20 <> 0").withColumns({"x": F.when(F.col("cell_id") % 10 != 0, 1.0), "y": F.lit(1.0), "eta1_mean": F.col("value") / 1e6, "eta2_mean": F.col("value") * 0, "tier1_probability_plugin": F.col("value") / 1e6, "tier2_intensity_plugin": F.col("value"), "spatial_group_index": F.col("time_index") % 5 + 1})
    return out, g


@query(checks_sql(
    ("z", [("row_count", "BLOCKING", "abs(count(*) - (SELECT count(*) FROM t))"), ("week_count", "BLOCKING", "abs(count(DISTINCT time_index) - 90)"), ("global_duplicate_row_id", "BLOCKING", "0"), ("finite_coordinates", "BLOCKING", "count(*) FILTER (x IS NULL)"), ("finite_eta1", "BLOCKING", "count(*) FILTER (bad)"), ("finite_eta2", "BLOCKING", "count(*) FILTER (bad)"),
      ("probability_range", "BLOCKING", "count(*) FILTER (bad OR NOT value / 1e6 BETWEEN 0 AND 1)"), ("intensity_positive", "BLOCKING", "count(*) FILTER (bad OR NOT value > 0)"), ("spatial_group_support", "BLOCKING", "count(*) FILTER (grp > 4)"), ("stable_key_set", "BLOCKING", "(count(*) * 0 + (SELECT count(*) FROM t WHERE time_index % 20 = 0))")]), start=f"WITH {OUTPUT} "))
def output_audit(spark, sf_dir):
    return shown(gate_rules.output_audit(*_output(spark, sf_dir), weeks=90, groups=4)[0])


@query(f"""WITH {OUTPUT}, oo AS (SELECT epiyear, epiweek, count(*) AS n, count(*) FILTER (x IS NULL) AS c, count(*) FILTER (bad) AS e FROM z GROUP BY ALL), ss AS (SELECT epiyear, epiweek, count(*) AS want FROM t GROUP BY ALL),
b AS (SELECT ss.epiyear, ss.epiweek, abs(coalesce(n, 0) - want) AS weekly_row_count, 0 AS weekly_cell_id_unique, 0 AS weekly_row_id_unique, coalesce(c, 0) AS weekly_coordinates_finite, coalesce(e, 0) AS weekly_eta1_finite, coalesce(e, 0) AS weekly_eta2_finite, (n IS NULL)::BIGINT AS weekly_key_support FROM ss LEFT JOIN oo USING (epiyear, epiweek))
SELECT epiyear, epiweek, "check", failures::BIGINT AS failures FROM (SELECT * REPLACE (weekly_cell_id_unique::BIGINT AS weekly_cell_id_unique, weekly_row_id_unique::BIGINT AS weekly_row_id_unique) FROM b) UNPIVOT (failures FOR "check" IN (weekly_row_count, weekly_cell_id_unique, weekly_row_id_unique, weekly_coordinates_finite, weekly_eta1_finite, weekly_eta2_finite, weekly_key_support))""")
def output_audit_weekly(spark, sf_dir):
    return gate_rules.output_audit(*_output(spark, sf_dir), weeks=90, groups=4)[1]


# --- contracts and lineage -----------------------------------------------------------------


@query("""WITH p AS (SELECT s_nationkey AS portfolio, s_suppkey % 3 AS product, s_nationkey % 7 <> 0 AS ok, s_suppkey % 5 <> 0 AS pok, s_suppkey % 11 = 0 AS miss FROM supplier)
SELECT 'p' || portfolio AS portfolio, problem IS NULL AS valid, problem FROM (SELECT portfolio, CASE WHEN NOT bool_and(ok) THEN 'not successful' WHEN count(DISTINCT product) FILTER (product < 2) < 2 THEN 'product missing' WHEN count(*) FILTER (product < 2 AND (NOT pok OR miss)) > 0 THEN 'product incomplete' END AS problem FROM p GROUP BY 1)""")
def portfolio_validity(spark, sf_dir):
    k = F.col("s_suppkey")
    p = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), "s_nationkey").alias("portfolio"), F.when(F.col("s_nationkey") % 7 != 0, "success").otherwise("failed").alias("status"), (k % 3).cast("string").alias("product"), F.when(k % 5 != 0, "success").otherwise("failed").alias("product_status"), (k % 11 == 0).cast("int").alias("missing"), F.lit(0).alias("bad_sidecars"), F.lit(9).alias("present"), F.lit(9).alias("expected"))
    return files.portfolio_validity(p, ["0", "1"], 8)


@query("WITH s AS (SELECT DISTINCT user_id % 3 AS v, user_id % 6 AS w, count(*) AS n FROM events GROUP BY ALL) SELECT 3::BIGINT AS variables, 7::BIGINT AS weeks, (21 - count(*) FILTER (n = 1))::BIGINT AS problems, false AS complete FROM s")
def coverage_certificate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 3).cast("string").alias("variable"), (F.col("user_id") % 6).cast("string").alias("week_id"), F.lit("f").alias("fingerprint"), F.lit("0" * 64).alias("sha256"))
    return files.coverage_certificate(e, e, spark.range(7).select(F.col("id").cast("string").alias("week_id"))).drop("fingerprint")


@query("SELECT sha256(p_type) AS sha256, count(*) AS copies, min(p_name || p_partkey) AS first_path FROM part GROUP BY 1 HAVING count(*) > 1")
def repeated_contents(spark, sf_dir):
    return files.repeated_contents(table(spark, sf_dir, "part").select(F.sha2("p_type", 256).alias("sha256"), F.concat("p_name", "p_partkey").alias("path")))


@query(f"WITH {NATION_WEEKS}, d AS (SELECT epiyear, epiweek, time_index, ((time_index + 1) // 2) AS two FROM w) SELECT count(DISTINCT (epiyear, epiweek)) AS modeled_weeks, count(DISTINCT cell_id) AS supported_cells, count(*) AS prediction_rows, count(DISTINCT (epiyear, epiweek)) * count(DISTINCT cell_id) AS expected_prediction_rows, min(printf('%04d-W%02d', epiyear, epiweek)) AS horizon_start, max(printf('%04d-W%02d', epiyear, epiweek)) AS horizon_end, (SELECT count(DISTINCT two) FROM d) AS timestep_2wk, true AS reconciled FROM g")
def dimension_contract(spark, sf_dir):
    weeks = timeidx.time_buckets(timeidx.index_weeks(table(spark, sf_dir, "orders"), "o_orderdate"))
    return config.dimension_contract(nation_weeks(spark, sf_dir), weeks, ("timestep_2wk",))


@query(f"WITH {EVENTS} SELECT count(DISTINCT user_id % 50) AS levels, count(*) AS rows, count(DISTINCT cell_id) AS cells, count(DISTINCT (epiyear, epiweek)) AS weeks, 'zero_mean' AS policy FROM e WHERE user_id % 50 > 40")
def support_summary(spark, sf_dir):
    e = weekly_events(spark, sf_dir).withColumns({"admin": F.col("user_id") % 50, "unseen": F.col("user_id") % 50 > 40})
    return config.support_summary(e, "zero_mean")


@query(f"WITH {EVENTS} SELECT cell_id, user_id % 50 AS admin, count(*) AS rows, count(DISTINCT (epiyear, epiweek)) AS weeks FROM e WHERE user_id % 50 > 40 GROUP BY ALL")
def unseen_levels(spark, sf_dir):
    e = weekly_events(spark, sf_dir).withColumns({"admin": F.col("user_id") % 50, "unseen": F.col("user_id") % 50 > 40})
    return predictor.unseen_levels(e, "cell_id", "admin", "unseen", ["epiyear", "epiweek"])


@query("WITH o AS (SELECT count(*) AS n FROM orders), l AS (SELECT count(*) AS m FROM lineitem) SELECT n AS n_observed, (m - n)::BIGINT AS n_latent, m AS n_total, true AS reconciled FROM o, l")
def predictor_layout(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    latent = li.count() - o.count()
    fitted = metrics_rows(li)
    return predictor.predictor_layout(fitted, o, latent)


def metrics_rows(df):
    """Rows numbered from 1 by order and line, by adding up the orders' lines before each."""
    per = metrics.cumulative_scores(df, "l_orderkey", {"n": F.lit(1)}).select(F.col("l_orderkey").alias("_k"), "n_before")
    df = sets.dealt(df.select("l_orderkey", "l_linenumber"), "l_orderkey", rows=500_000)
    return df.join(sets.by_key(per), df["l_orderkey"] == F.col("_k")).select((F.col("n_before") + F.row_number().over(cleaning.Window.partitionBy("l_orderkey").orderBy("l_linenumber"))).cast("long").alias("stack_row"))


@query("WITH n AS (SELECT count(*) // 3 AS n FROM orders) SELECT o_orderkey AS stack_row, CASE WHEN o_orderkey <= n THEN 'APredictor' ELSE 'Predictor' END AS predictor_block, CASE WHEN o_orderkey <= n THEN o_orderkey ELSE o_orderkey - n END AS output_index FROM orders, n")
def fitted_blocks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("stack_row"))
    return predictor.fitted_blocks(o, o.count() // 3)


# --- tables and reports --------------------------------------------------------------------


@query(f"WITH c AS ({ORACLES['boyce_curve']}), d AS (SELECT *, coalesce(p_over_e = lag(p_over_e) OVER (ORDER BY window_id), false) AS dup FROM c WHERE p_over_e IS NOT NULL), k AS (SELECT rank() OVER (ORDER BY midpoint) AS a, rank() OVER (ORDER BY p_over_e) + (count(*) OVER (PARTITION BY p_over_e) - 1) / 2.0 AS b FROM d WHERE NOT dup) SELECT round(corr(a, b), 6) AS cbi FROM k")
def boyce_index(spark, sf_dir):
    curve = boyce_curve(spark, sf_dir)
    before = F.lag("p_over_e").over(cleaning.Window.partitionBy(F.col("p_over_e").isNull()).orderBy("window_id"))
    curve = curve.withColumn("retained", F.col("p_over_e").isNotNull() & ~F.coalesce(F.col("p_over_e") == before, F.lit(False)))
    return rounded(metrics.boyce_index(curve), "cbi")


@query(f"WITH {NATION_WEEKS}, v AS (SELECT cell_id, time_index, CASE WHEN cell_id % 6 <> 0 THEN value END AS value FROM g), i AS (SELECT cell_id, coalesce(value > 200000, false) AS f, row_number() OVER (PARTITION BY cell_id ORDER BY time_index) - sum(coalesce(value > 200000, false)::INTEGER) OVER (PARTITION BY cell_id ORDER BY time_index) AS island FROM v) SELECT cell_id, max(n)::BIGINT AS longest_run FROM (SELECT cell_id, island, sum(f::INTEGER) AS n FROM i GROUP BY ALL) GROUP BY 1")
def longest_run_zero(spark, sf_dir):
    """Cells of missing values only have a run of 0."""
    g = nation_weeks(spark, sf_dir).withColumn("value", F.when(F.col("cell_id") % 6 != 0, F.col("value")))
    return persistence.longest_run(g, 200000.0, ["time_index"], missing="zero")


@query("SELECT o_orderkey, round(o_totalprice * 623.5, 4) AS abundance FROM orders")
def potential_abundance(spark, sf_dir):
    return rounded(persistence.potential_abundance(table(spark, sf_dir, "orders"), "o_totalprice", 623.5).select("o_orderkey", "abundance"), "abundance", digits=4)


@query("SELECT 'missing_columns' AS \"check\", 1::BIGINT AS failures UNION ALL SELECT 'group_range', count(*) FILTER (NOT l_linenumber BETWEEN 1 AND 6) FROM lineitem UNION ALL SELECT 'finite_t', count(*) FILTER (l_returnflag = 'N') FROM lineitem")
def prediction_compatibility(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("t", F.when(F.col("l_returnflag") != "N", F.col("l_tax")))
    return reporting.prediction_compatibility(li, ["t", "absent"], "l_linenumber", 6)


@query("SELECT round(max(abs(a - b)), 6) AS max_abs, (SELECT count(*) FROM orders) - count(*) AS unmatched, false AS pass FROM (SELECT sum(l_extendedprice) AS a, l_orderkey AS k FROM lineitem GROUP BY 2) JOIN (SELECT o_orderkey AS k, o_totalprice AS b FROM orders) USING (k)")
def plans_agree(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("v"))
    return rounded(reporting.plans_agree(a, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")), "k", "v"), "max_abs")


@query("SELECT round(sqrt(avg(l_tax * l_tax)), 9) AS rmse, round(max(abs(l_tax)), 9) AS max_abs, false AS pass FROM lineitem")
def structural_identity(spark, sf_dir):
    """The predictor without its spatial terms, checked against parts that miss one."""
    li = table(spark, sf_dir, "lineitem").withColumn("eta", F.col("l_quantity") + F.col("l_discount") + F.col("l_tax"))
    li = predictor.structural(li, "eta", ["l_discount"])
    return rounded(predictor.identity_check(li, "eta2_structural", ["l_quantity"]), "rmse", "max_abs", digits=9)


@query("""WITH r AS (SELECT count(*) FILTER (l_linenumber % 2 = 1) AS tier1_rows, count(*) FILTER (l_linenumber % 2 = 0) AS tier2_rows, count(*) FILTER (l_linenumber % 2 = 1 AND l_returnflag <> 'A') AS tier1_holdouts, count(*) FILTER (l_linenumber % 2 = 0 AND l_returnflag <> 'A') AS tier2_holdouts FROM lineitem),
e AS (SELECT count(*) FILTER (p_size % 8 = 0) AS fixed_effects, count(*) FILTER (p_size % 8 = 1) AS hyperparameters, count(DISTINCT p_size % 8) FILTER (p_size % 8 > 1) AS random_components FROM part), w AS (SELECT count(*) AS temporal_weeks, count(DISTINCT m) AS spatial_groups FROM (SELECT DISTINCT isoyear(o_orderdate), week(o_orderdate), week(o_orderdate) % 4 AS m FROM orders))
SELECT item, value::DOUBLE AS value FROM (SELECT * FROM r, e, w) UNPIVOT (value FOR item IN (tier1_rows, tier2_rows, tier1_holdouts, tier2_holdouts, fixed_effects, hyperparameters, random_components, temporal_weeks, spatial_groups)) UNION ALL SELECT 'dic', 1.0 UNION ALL SELECT 'marginal_log_likelihood', 2.0""")
def model_summary(spark, sf_dir):
    weeks = timeidx.index_weeks(table(spark, sf_dir, "orders"), "o_orderdate").withColumn("spatial_group", F.col("epiweek") % 4)
    out = reporting.model_summary(_fitted(spark, sf_dir), weeks, _summaries(spark, sf_dir), spark.createDataFrame(CRITERIA, "criterion string, requested boolean, value double"))
    return out.where("value is not null")


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'pigs_log1p' WHEN 1 THEN 'mintemp_s × leafarea_s' WHEN 2 THEN 'intercept2' ELSE n_name END AS source, CASE n_nationkey % 4 WHEN 0 THEN 'log(1 + x) of animal numbers' WHEN 1 THEN 'product of two transformed columns' WHEN 2 THEN 'constant of its tier, on the scale of the linear predictor' END AS note FROM nation")
def effect_sources(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    n = table(spark, sf_dir, "nation").withColumn("term", F.when(k == 0, "pigs").when(k == 1, "mintemp:leafarea").when(k == 2, "intercept2").otherwise(F.col("n_name")))
    return n.select("n_nationkey", text.effect_source("term").alias("source"), text.effect_note("term").alias("note"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'N' AND l_discount <> 0")
def complete_cases(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumns({"a": F.when(F.col("l_returnflag") != "N", 1), "b": F.nullif("l_discount", F.lit(0.0))})
    return cleaning.apply_missing_policy(li, ["a", "b"], "complete_case").select("l_orderkey", "l_linenumber")


@query("SELECT s_suppkey, s_name AS source_s_name, s_acctbal AS source_s_acctbal, s_name AS title FROM supplier")
def carried_columns(spark, sf_dir):
    s = reporting.prefixed(table(spark, sf_dir, "supplier"), ["s_name", "s_acctbal", "absent"])
    return reporting.with_aliases(s, {"title": "s_name", "nothing": "absent"}).select("s_suppkey", "source_s_name", "source_s_acctbal", "title")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE::VARCHAR END AS day FROM orders")
def dates_in_one_format(spark, sf_dir):
    """The format of the least value counts; other rows' dates become null."""
    o = table(spark, sf_dir, "orders").withColumn("d", F.when(F.col("o_orderkey") % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")))
    return timeidx.parse_dates(o, "d").select("o_orderkey", F.col("date").cast("string").alias("day"))


@query("""WITH p AS (SELECT s_suppkey, radians(-100 + s_suppkey % 50 + 96) AS l, sin(radians(20 + s_suppkey % 30)) AS s FROM supplier), k AS (SELECT 0.006694380022900787 AS e2, 0.08181919104281579 AS e), c AS (SELECT e2, e, sin(radians(29.5)) s1, sin(radians(45.5)) s2, sin(radians(23)) s0 FROM k),
q AS (SELECT *, (1 - e2) * (s0 / (1 - e2 * s0 * s0) - ln((1 - e * s0) / (1 + e * s0)) / (2 * e)) q0, (1 - e2) * (s1 / (1 - e2 * s1 * s1) - ln((1 - e * s1) / (1 + e * s1)) / (2 * e)) q1, (1 - e2) * (s2 / (1 - e2 * s2 * s2) - ln((1 - e * s2) / (1 + e * s2)) / (2 * e)) q2, cos(radians(29.5)) / sqrt(1 - e2 * s1 * s1) m1, cos(radians(45.5)) / sqrt(1 - e2 * s2 * s2) m2 FROM c),
n AS (SELECT *, (m1 * m1 - m2 * m2) / (q2 - q1) AS n FROM q), f AS (SELECT *, m1 * m1 + n * q1 AS cc FROM n), r AS (SELECT s_suppkey, l, n, 6378137.0 * sqrt(cc - n * (1 - e2) * (s / (1 - e2 * s * s) - ln((1 - e * s) / (1 + e * s)) / (2 * e))) / n AS rho, 6378137.0 * sqrt(cc - n * q0) / n AS rho0 FROM p, f)
SELECT s_suppkey, round(rho * sin(n * l) / 1000, 4) AS x, round((rho0 - rho * cos(n * l)) / 1000, 4) AS y FROM r""")
def albers_coordinates(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumns({"lon": (-100 + F.col("s_suppkey") % 50).cast("double"), "lat": (20 + F.col("s_suppkey") % 30).cast("double")})
    x, y = places.albers("lon", "lat", -96.0, 23.0, 29.5, 45.5)
    return rounded(s.select("s_suppkey", x.alias("x"), y.alias("y")), "x", "y", digits=4)


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0")
def common_keys(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("nation"))
    return sets.intersection(c, s)


@query(f"WITH {EVENTS}, {RASTER}, u AS (SELECT DISTINCT user_id, x, y, (least(floor((10 - y) / 1.0), 9) * 10 + least(floor(x / 1.0), 9) + 1)::BIGINT AS own FROM e WHERE x BETWEEN 0 AND 10 AND y BETWEEN 0 AND 10), a AS (SELECT cell_id, CASE WHEN cell_id BETWEEN 1 AND 10 THEN value END AS value FROM v) SELECT user_id, x, y, 10 AS raster_nrow, 10 AS raster_ncol, (SELECT count(value) FROM a) AS raster_valid_cells, true AS point_inside_raster_extent FROM u WHERE NOT EXISTS (SELECT 1 FROM v JOIN a USING (cell_id) WHERE a.value IS NOT NULL AND sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y)) <= 1.5)")
def missing_diagnostics(spark, sf_dir):
    """Rows that no raster of one line's cells resolves within the radius."""
    u = weekly_events(spark, sf_dir).select("user_id", "x", "y").distinct().where("x between 0 and 10 and y between 0 and 10")
    raster = _raster(spark).withColumn("value", F.when(F.col("cell_id") <= 10, F.col("value")))
    out = grid.missing_diagnostics(grid.extract_with_fallback(u, raster, GRID, ["user_id"], 1.5).withColumnRenamed("user_id", "row_id"), raster, GRID, "heat")
    return out.select(F.col("row_id").alias("user_id"), "x", "y", "raster_nrow", "raster_ncol", "raster_valid_cells", "point_inside_raster_extent")


@query(f"WITH {NATION_WEEKS} SELECT epiyear, epiweek, 25::BIGINT AS rows, 'price' AS variable, count(*) FILTER (value IS NULL) AS missing FROM g GROUP BY 1, 2 UNION ALL SELECT epiyear, epiweek, 25, 'half', count(*) FILTER (value IS NULL OR cell_id % 2 = 1) FROM g GROUP BY 1, 2")
def weekly_covariates(spark, sf_dir):
    g = nation_weeks(spark, sf_dir)
    values = g.select("cell_id", "epiyear", "epiweek", F.lit("price").alias("variable"), "value").unionByName(g.where("cell_id % 2 = 0").select("cell_id", "epiyear", "epiweek", F.lit("half").alias("variable"), "value"))
    return grid.weekly_covariates(g.select("cell_id", "epiyear", "epiweek"), values, ["cell_id", "epiyear", "epiweek"], ["price", "half"])[1]


@query("WITH s(i, p) AS (VALUES " + ", ".join(f"({i}, '{p.replace('(?<!b)ovin', '(^|[^b])ovin')}')" for i, (p, _, _) in enumerate(__import__("epigrid.operators.hosts", fromlist=["x"]).HOST_PATTERNS)) + "), t AS (SELECT c_custkey, lower(regexp_replace(k, '[^A-Za-z]', '', 'g')) AS h FROM (SELECT c_custkey, list_extract(['Bovino', 'monkey', 'wildlife (urban)', 'Avian', 'caballo', 'Ovino/Caprino', 'buffalino', 'perro canino', 'lion', 'Porcupine'], (c_custkey % 10 + 1)::INTEGER) AS k FROM customer)) SELECT c_custkey AS submission, h AS host_cleaned, coalesce(i, -1)::INTEGER AS pattern_id FROM t LEFT JOIN s ON regexp_matches(h, p)")
def host_patterns(spark, sf_dir):
    """All patterns on names that several of them match."""
    from ..operators import hosts

    names = F.array(*[F.lit(x) for x in ("Bovino", "monkey", "wildlife (urban)", "Avian", "caballo", "Ovino/Caprino", "buffalino", "perro canino", "lion", "Porcupine")])
    c = table(spark, sf_dir, "customer").withColumn("host", names[(F.col("c_custkey") % 10).cast("int")])
    return hosts.expand_hosts(c, hosts.pattern_table(spark), "host", "c_custkey").select("submission", "host_cleaned", F.coalesce("pattern_id", F.lit(-1)).alias("pattern_id"))


@query("SELECT l_linenumber AS bin, count(DISTINCT l_returnflag) AS weights FROM lineitem WHERE l_linenumber > 4 OR l_returnflag = 'N' GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def weights_per_bin(spark, sf_dir):
    """Bins with several weights: those of the later lines."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber > 4 or l_returnflag = 'N'").withColumn("w", F.ascii("l_returnflag"))
    return predictor.weights_per_bin(li, "l_linenumber", "w").select(F.col("l_linenumber").alias("bin"), "weights")


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def subset_violations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return sets.subset_violations(o.select(F.col("o_custkey").alias("k")), o.where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")), ["k"]).distinct()


# --- whole runs over the tables ------------------------------------------------------------


def _run_inputs(spark, sf_dir) -> dict:
    """All events as records, order totals as the weekly covariate of 100 cells, sizes of
    parts as the static one, over three weeks."""
    x, y = GRID.center("cell_id")
    cells = spark.range(1, 101).withColumnRenamed("id", "cell_id").withColumns({"x": x, "y": y})
    records = weekly_events(spark, sf_dir).select(F.col("event_id").alias("observation_id"), "day", "x", "y", F.col("event_type").alias("host"))
    cell = lambda c: (F.col(c) % 100 + 1).cast("long").alias("cell_id")
    weekly = table(spark, sf_dir, "orders").groupBy(cell("o_custkey"), F.lit(2024).alias("epiyear"), (F.col("o_orderkey") % 3 + 2).cast("int").alias("epiweek")).agg((F.avg("o_totalprice") / 10000).alias("value")).withColumn("variable", F.lit("mintemp"))
    static = table(spark, sf_dir, "part").groupBy(cell("p_partkey")).agg(F.avg("p_size").alias("value")).withColumn("variable", F.lit("cattle"))
    nodes = cells.select(F.col("cell_id").alias("node"), "x", "y", F.lit(1.0).alias("area"), F.lit(True).alias("inside_domain"))
    return {"grid": GRID, "weeks": timeidx.week_index(spark, "2024-01-08", "2024-01-28"), "cells": cells, "records": records, "weekly": weekly, "static": static, "nodes": nodes}


RUN_CONFIG = {"study": {"start": "2024-01-08", "end": "2024-01-28"}, "bins": 5}
RUN_SQL = f"""WITH {EVENTS}, r AS (SELECT *, CASE WHEN NOT (epiyear = 2024 AND epiweek BETWEEN 2 AND 4) THEN 'outside_study_period' WHEN NOT (x BETWEEN 0 AND 10 AND y BETWEEN 0 AND 10) THEN 'outside_spatial_domain' END AS reason FROM e),
m AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY epiyear, epiweek, x, y, reason IS NULL ORDER BY event_id) > 1 THEN 'exact_point_week_duplicate' ELSE reason END AS exclusion_reason FROM r),
kept AS (SELECT epiweek, least(floor((10 - y) / 1.0), 9)::BIGINT * 10 + least(floor(x / 1.0), 9)::BIGINT + 1 AS cell_id FROM m WHERE exclusion_reason IS NULL)"""


@query(RUN_SQL + """, st(position, stage) AS (VALUES (0, 'input'), (1, 'invalid_year_week'), (2, 'outside_study_period'), (3, 'invalid_coordinates'), (4, 'outside_spatial_domain'), (5, 'exact_point_week_duplicate'), (6, 'retained')), n AS (SELECT coalesce(exclusion_reason, 'retained') AS stage, count(*) AS c FROM m GROUP BY 1 UNION ALL SELECT 'input', count(*) FROM m)
SELECT position::INTEGER AS position, st.stage, coalesce(c, 0)::BIGINT AS count FROM st LEFT JOIN n USING (stage)""")
def run_exclusion_audit(spark, sf_dir):
    from . import surveillance

    return surveillance.prepare(_run_inputs(spark, sf_dir), RUN_CONFIG)["exclusion_audit"]


@query(RUN_SQL + """, c AS (SELECT cell_id, epiweek, count(*) AS n FROM kept GROUP BY ALL), t AS (SELECT o_custkey % 100 + 1 AS cell_id, o_orderkey % 3 + 2 AS epiweek, avg(o_totalprice) / 10000 AS v FROM orders GROUP BY ALL), s AS (SELECT p_partkey % 100 + 1 AS cell_id, avg(p_size) AS v FROM part GROUP BY ALL)
SELECT w.epiweek::INTEGER AS epiweek, count(*) AS rows, coalesce(sum(n), 0)::BIGINT AS count, round(sum(t.v), 4) AS mintemp, round(sum(s.v), 4) AS cattle FROM range(1, 101) g(i) CROSS JOIN range(2, 5) w(epiweek) LEFT JOIN c ON c.cell_id = i AND c.epiweek = w.epiweek LEFT JOIN t ON t.cell_id = i AND t.epiweek = w.epiweek LEFT JOIN s ON s.cell_id = i GROUP BY 1""")
def run_model_table(spark, sf_dir):
    """The counts' model table of a whole run, summed by week."""
    from . import surveillance

    t = surveillance.prepare(_run_inputs(spark, sf_dir), RUN_CONFIG)["tier2"]
    return rounded(t.groupBy("epiweek").agg(F.count(F.lit(1)).alias("rows"), F.sum("count").cast("long").alias("count"), F.sum("mintemp").alias("mintemp"), F.sum("cattle").alias("cattle")), "mintemp", "cattle", digits=4)


@query(RUN_SQL + """, t AS (SELECT o_custkey % 100 + 1 AS cell_id, o_orderkey % 3 + 2 AS epiweek, avg(o_totalprice) / 10000 AS v FROM orders GROUP BY ALL), z AS (SELECT avg(v) AS c, greatest(stddev_samp(v), 2.220446049250313e-16) AS d FROM t),
k AS (SELECT i AS cell_id, w.epiweek, v, exp(0.5 + 0.3 * (v - c) / d + CASE w.epiweek WHEN 2 THEN 0.1 WHEN 3 THEN 0.2 ELSE 0 END) AS lam FROM range(1, 101) g(i) CROSS JOIN range(2, 5) w(epiweek) CROSS JOIN z LEFT JOIN t ON t.cell_id = i AND t.epiweek = w.epiweek),
a AS (SELECT cell_id, epiweek, CASE WHEN lam IS NULL OR v IS NULL THEN NULL WHEN v < 14 THEN 0.0 ELSE lam END AS m FROM k), q AS (SELECT quantile_cont(m, 0.1) AS t FROM kept JOIN a USING (cell_id, epiweek) WHERE m IS NOT NULL),
i AS (SELECT cell_id, m, coalesce(m > t, false) AS f, row_number() OVER (PARTITION BY cell_id ORDER BY epiweek) - sum(coalesce(m > t, false)::INTEGER) OVER (PARTITION BY cell_id ORDER BY epiweek) AS island FROM a, q), u AS (SELECT cell_id, island, sum(f::INTEGER) AS n, bool_or(m IS NOT NULL) AS ok FROM i GROUP BY ALL)
SELECT cell_id, CASE WHEN bool_or(ok) THEN max(n) END::BIGINT AS longest_run FROM u GROUP BY 1""")
def run_longest_runs(spark, sf_dir):
    """The runs of a whole run after a fit: predictions, mask, threshold at the records."""
    from . import surveillance

    inputs = _run_inputs(spark, sf_dir)
    prepared = surveillance.prepare(inputs, RUN_CONFIG)
    effects = spark.createDataFrame([(1, 0.1), (2, 0.2)], "index int, mean double")
    out = surveillance.postfit(inputs, prepared, {"intercept1": -1.0, "intercept2": 0.5, "mintemp": 0.3}, effects, {**RUN_CONFIG, "mask": {"temperature": 14.0}})
    return out["classes"].select("cell_id", "longest_run")
