"""Registered queries of gates over many runs at once, all inputs drawn from tables.

Stand-ins: a run is a nation, its components' summaries are its customers, its criteria its suppliers;
or a run is a last digit of a supplier's key, and its fitted rows are line items.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gate_rules, gates, preflight
from .queries import query, table

SECTIONS = ["fixed", "hyper", *gate_rules.COMPONENTS]
CRITERIA = ["dic", "waic", "marginal_log_likelihood"]


def _sql(run: str, *parts: tuple[str, list[tuple[str, str, str]]], start: str) -> str:
    """SQL of check rows a run: (from clause, [(check, severity, failures)])."""
    one = [f"SELECT {run}, '{n}' AS \"check\", '{s}' AS severity, CASE WHEN coalesce({e}, 0) = 0 THEN 'PASS' WHEN '{s}' = 'WARNING' THEN 'WARN' ELSE 'FAIL' END AS status, coalesce({e}, 0)::BIGINT::VARCHAR AS observed FROM {frm} GROUP BY {run}" for frm, rules in parts for n, s, e in rules]
    return start + " UNION ALL ".join(one)


def _shown(checks):
    return checks.select("run", "check", "severity", "status", "observed")


def _fits(spark, sf_dir):
    customer, supplier, k = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), F.col("n_nationkey")
    totals = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_observed"), F.count(F.when(F.col("c_acctbal") < -900, 1)).alias("warnings"))
    families = F.when(k % 6 == 5, F.array(F.lit("nbinomial"), F.lit("binomial"))).otherwise(F.array(*[F.lit(f) for f in gate_rules.FAMILIES]))
    run = table(spark, sf_dir, "nation").join(totals, "n_nationkey").select(
        k.alias("run"), families.alias("families"), F.when(k % 4 == 3, "Crashed").otherwise("Success").alias("status"), (k % 5 != 0).alias("ok"), F.lit("default").alias("configured"), F.when(k % 3 == 0, "previous_theta").otherwise("default").alias("recorded"), (k % 6 != 0).alias("theta_ok"),
        "n_observed", (F.col("n_regionkey") * 10).alias("n_latent"), (F.col("n_observed") + F.col("n_regionkey") * 10 + F.when(k % 7 == 0, 1).otherwise(0)).alias("n_total"), (F.col("n_observed") - F.when(k % 8 == 0, 1).otherwise(0)).alias("stack_rows"), "warnings",
    )
    name = F.get(F.array(*[F.lit(s) for s in SECTIONS]), (F.col("c_custkey") % 9).cast("int"))
    summaries = customer.where("c_custkey % 9 <> c_nationkey % 11").select(F.col("c_nationkey").alias("run"), name.alias("section"), F.when(F.col("c_acctbal") < -950, float("nan")).otherwise(F.col("c_acctbal").cast("double")).alias("mean"), F.when(F.col("c_acctbal") > 9900, float("inf")).alias("sd"), F.lit(None).cast("double").alias("q025"), F.lit(None).cast("double").alias("q975"))
    criteria = supplier.select(F.col("s_nationkey").alias("run"), F.get(F.array(*[F.lit(c) for c in CRITERIA]), (F.col("s_suppkey") % 3).cast("int")).alias("criterion"), (F.col("s_acctbal") > 0).alias("requested"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal").cast("double")).alias("value"))
    return gate_rules.fit_health(run, summaries, criteria, by=["run"])


_FIT = """WITH t AS (SELECT c_nationkey AS run, count(*) AS n, count(*) FILTER (c_acctbal < -900) AS w FROM customer GROUP BY 1), r AS (SELECT t.*, n_regionkey * 10 AS latent FROM t JOIN nation ON run = n_nationkey),
s AS (SELECT c_nationkey AS run, c_custkey % 9 AS k, c_acctbal < -950 OR c_acctbal > 9900 AS bad FROM customer WHERE c_custkey % 9 <> c_nationkey % 11), c AS (SELECT s_nationkey AS run, s_suppkey % 3 AS k, s_acctbal > 0 AND s_suppkey % 7 <> 0 AS good FROM supplier) """
FIT_SQL = _sql("run",
    ("r", [("likelihood_families", "BLOCKING", "(run % 6 = 5)::INTEGER * count(*)"), ("fit_completion_status", "BLOCKING", "(run % 4 = 3)::INTEGER * count(*)"), ("fit_internal_ok", "BLOCKING", "(run % 5 = 0)::INTEGER * count(*)"), ("initialization_provenance", "WARNING", "(run % 3 = 0)::INTEGER * count(*)"), ("theta_initialization_provenance", "WARNING", "(run % 6 = 0)::INTEGER * count(*)"),
           ("joint_stack_structure", "BLOCKING", "(run % 8 = 0)::INTEGER * count(*)"), ("predictor_layout", "BLOCKING", "count(*) FILTER (n + latent <> n + latent + (run % 7 = 0)::INTEGER)"), ("fit_warnings_recorded", "WARNING", "sum(w)")]),
    ("s", [("required_random_components", "BLOCKING", "7 - count(DISTINCT k) FILTER (k >= 2)"), *[(f"summary_{x}_finite", "BLOCKING", f"count(*) FILTER (k = {i} AND bad) + (count(*) FILTER (k = {i}) = 0)::INTEGER") for i, x in enumerate(SECTIONS)]]),
    ("c", [(f"{x}_finite", "WARNING", f"(count(*) FILTER (k = {i} AND good) = 0)::INTEGER") for i, x in enumerate(CRITERIA)]), start=_FIT)


@query(FIT_SQL)
def fit_health_runs(spark, sf_dir):
    """The health of 25 fits in one pass over each table."""
    return _shown(_fits(spark, sf_dir))


@query(f"WITH h AS ({FIT_SQL}) SELECT run, count(*) FILTER (severity = 'BLOCKING' AND status = 'FAIL') AS failure_count, count(*) FILTER (status = 'WARN') AS warning_count, count(*) AS checks, CASE WHEN count(*) FILTER (severity = 'BLOCKING' AND status = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (status = 'WARN') > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS outcome FROM h GROUP BY run")
def fit_outcomes(spark, sf_dir):
    return gates.outcome(_fits(spark, sf_dir), ["run"])


def _items(spark, sf_dir):
    odd, run, k = F.col("l_linenumber") % 2 == 1, F.col("l_suppkey") % 10, F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        run.alias("run"), F.when(odd, "tier1").otherwise("tier2").alias("tier"), F.when((run == 1) & (k % 50 == 1), 2).when(odd, 1).otherwise(2).alias("link"), F.when(odd, 1).otherwise(2).alias("family_index"), F.when((F.col("l_returnflag") != "N") & ((run != 2) | (F.col("l_returnflag") == "A")), F.col("l_quantity").cast("double")).alias("response_training"),
        ((F.col("l_returnflag") == "N") | ((run == 3) & (F.col("l_returnflag") == "R"))).alias("is_test_point"), F.when((run == 4) & (k % 9 == 0), float("nan")).when(odd, F.col("l_discount").cast("double")).otherwise(F.col("l_quantity") - F.when(run == 5, 1).otherwise(0)).cast("double").alias("fitted_mean"), k.alias("k"),
        F.col("l_returnflag").alias("flag"), F.col("l_tax").cast("double").alias("tax"),
    )


_ITEMS = """WITH f AS (SELECT l_suppkey % 10 AS run, l_linenumber % 2 = 1 AS one, CASE WHEN l_suppkey % 10 = 1 AND l_orderkey % 50 = 1 THEN 2 WHEN l_linenumber % 2 = 1 THEN 1 ELSE 2 END AS link, CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 2 END AS family,
CASE WHEN l_returnflag <> 'N' AND (l_suppkey % 10 <> 2 OR l_returnflag = 'A') THEN l_quantity END AS y, l_returnflag = 'N' OR (l_suppkey % 10 = 3 AND l_returnflag = 'R') AS test, CASE WHEN l_suppkey % 10 = 4 AND l_orderkey % 9 = 0 THEN NULL WHEN l_linenumber % 2 = 1 THEN l_discount::DOUBLE ELSE l_quantity - (l_suppkey % 10 = 5)::INTEGER END AS m,
l_orderkey AS k, l_returnflag AS flag, l_tax AS tax FROM lineitem), """


@query(_sql("run",
    ("a JOIN b USING (run)", [("tier_row_counts", "BLOCKING", "(any_value(r1) <> any_value(s1))::INTEGER + (any_value(r2) <> any_value(s2))::INTEGER"), ("active_training_counts", "BLOCKING", "(any_value(a1) <> any_value(t1))::INTEGER + (any_value(a2) <> any_value(t2))::INTEGER"), ("holdout_rows", "BLOCKING", "any_value(leaks)")]),
    ("f", [("likelihood_link_counts", "BLOCKING", "count(*) FILTER (link <> family)"), ("named_tier_indices", "BLOCKING", "count(*) FILTER (link <> family)"), ("observed_fitted_values_finite", "BLOCKING", "count(*) FILTER (m IS NULL)"), ("tier1_fitted_probability_range", "BLOCKING", "count(*) FILTER (link = 1 AND NOT coalesce(m BETWEEN 0 AND 1, false))"), ("tier2_fitted_positive", "BLOCKING", "count(*) FILTER (link = 2 AND NOT (m IS NULL OR m > 0))")]),
    ("p", [(f"{x}_count", "BLOCKING", f"(count(DISTINCT size) FILTER (name = {i}) <> 4)::INTEGER") for i, x in enumerate(gate_rules.EXPECTED)]),
    start=_ITEMS + """a AS (SELECT run, count(*) FILTER (one) AS r1, count(*) FILTER (NOT one) AS r2, count(y) FILTER (one) AS a1, count(y) FILTER (NOT one) AS a2 FROM f GROUP BY run),
b AS (SELECT run, count(*) FILTER (one) AS s1, count(*) FILTER (NOT one) AS s2, count(y) FILTER (one) AS t1, count(y) FILTER (NOT one) AS t2, count(*) FILTER (test AND y IS NOT NULL) AS leaks FROM f WHERE NOT (run = 6 AND k % 100 = 1) AND NOT (run = 7 AND flag = 'A') GROUP BY run),
p AS (SELECT p_partkey % 10 AS run, p_partkey // 10 % 6 AS name, p_size % 4 AS size FROM part) """))  # fmt: skip
def extraction_runs(spark, sf_dir):
    """Ten runs; the source of one lacks rows, that of another responses, others have other faults."""
    f = _items(spark, sf_dir)
    source = f.where("not (run = 6 and k % 100 = 1) and not (run = 7 and flag = 'A')").drop("link", "fitted_mean")
    names = F.get(F.array(*[F.lit(n) for n in gate_rules.EXPECTED]), F.expr("cast(p_partkey div 10 % 6 as int)"))
    counts = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 10).alias("run"), names.alias("name")).agg(F.count_distinct(F.col("p_size") % 4).alias("n"))
    return _shown(gate_rules.extraction_audit(f, source, counts, dict.fromkeys(gate_rules.EXPECTED, 4), by=["run"]))


METRICS = ["PB_AUC_area_weighted", "PB_AUC_unweighted", "continuous_boyce_area_weighted", "continuous_boyce_unweighted", "mae", "rmse", "pearson", "spearman"]


@query(_sql("run",
    ("h2 JOIN t2 USING (run)", [("stage2_holdout_counts", "BLOCKING", "(any_value(h1) <> any_value(s1) OR any_value(hh) <> any_value(ss))::INTEGER")]),
    ("h", [("holdout_rows_are_test_points", "BLOCKING", "count(*) FILTER (NOT test)"), ("holdout_response_finite", "BLOCKING", "count(*) FILTER (q IS NULL)"), ("family_labels", "BLOCKING", "count(*) FILTER (link <> family)"), ("same_week_percentile_coverage", "BLOCKING", "count(*) FILTER (one AND m IS NULL)")]),
    ("f", [("background_terrestrial_support", "BLOCKING", "(count(*) = 0)::INTEGER"), ("background_weighting", "BLOCKING", "count(*) FILTER (NOT tax + (run < 5)::INTEGER > 0)")]),
    ("mt", [(m, "WARNING", f"(count(*) FILTER (k = {i} AND good) = 0)::INTEGER") for i, m in enumerate(METRICS)]),
    start=_ITEMS + """h AS (SELECT *, CASE WHEN run <> 8 OR k % 20 <> 3 THEN k END AS q FROM f WHERE (test AND NOT (run = 6 AND k % 100 = 1)) OR (run = 7 AND flag = 'A' AND k % 10 = 1)), h2 AS (SELECT run, count(*) FILTER (one) AS h1, count(*) FILTER (NOT one) AS hh FROM h GROUP BY run),
t2 AS (SELECT run, count(*) FILTER (one) AS s1, count(*) FILTER (NOT one) AS ss FROM f WHERE test GROUP BY run), mt AS (SELECT s_suppkey % 10 AS run, s_suppkey // 10 % 8 AS k, s_acctbal > 0 AS good FROM supplier) """))  # fmt: skip
def validation_runs(spark, sf_dir):
    """Ten validations; one lacks test points, one holds rows that are none, one has no percentiles for some."""
    f = _items(spark, sf_dir)
    holdout = f.where("(is_test_point and not (run = 6 and k % 100 = 1)) or (run = 7 and flag = 'A' and k % 10 = 1)").select("run", "tier", "is_test_point", F.when((F.col("run") != 8) | (F.col("k") % 20 != 3), F.col("k").cast("double")).alias("response"), F.when(F.col("link") == 1, "binomial").otherwise("nbinomial").alias("family"), F.col("fitted_mean").alias("percentile"))
    name = F.get(F.array(*[F.lit(m) for m in METRICS]), F.expr("cast(s_suppkey div 10 % 8 as int)"))
    scores = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 10).alias("run"), name.alias("metric"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal").cast("double")).otherwise(float("nan")).alias("value"))
    return _shown(gate_rules.validation_audit(holdout, f, scores, f.select("run", (F.col("tax") + F.when(F.col("run") < 5, 1).otherwise(0)).alias("weight")), by=["run"]))


@query(f"WITH h AS ({FIT_SQL}) SELECT DISTINCT 'fit_health' AS gate, \"check\", severity FROM h")
def check_inventory(spark, sf_dir):
    """The checks that a gate defines, from its own rows over 25 fits."""
    return gates.inventory(_fits(spark, sf_dir))


@query("""WITH t AS (SELECT c_custkey AS position, c_mktsegment AS a, CASE WHEN c_custkey % 13 <> 0 THEN c_acctbal END AS v FROM customer WHERE c_custkey % 17 <> 0), o AS (SELECT c_custkey AS position, CASE WHEN c_custkey % 29 = 0 THEN 'OTHER' ELSE c_mktsegment END AS b FROM customer WHERE c_custkey % 19 <> 0),
x AS (SELECT count(*) FILTER (t.position IS NULL OR o.position IS NULL) + count(*) FILTER (t.position IS NOT NULL AND v IS NULL) AS shape, count(*) FILTER (t.position IS NOT NULL AND a IS DISTINCT FROM b) AS names FROM t FULL JOIN o ON t.position = o.position)
SELECT 'theta_shape' AS "check", 'WARNING' AS severity, CASE WHEN shape = 0 THEN 'PASS' ELSE 'WARN' END AS status, shape::VARCHAR AS observed FROM x UNION ALL SELECT 'theta_order_provenance', 'WARNING', CASE WHEN names = 0 THEN 'PASS' ELSE 'WARN' END, names::VARCHAR FROM x""")
def preflight_theta(spark, sf_dir):
    """Values of an earlier fit against the order of the model at hand: some lack, some have other names."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    theta = c.where(k % 17 != 0).select(k.alias("position"), F.col("c_mktsegment").alias("name"), F.when(k % 13 != 0, F.col("c_acctbal").cast("double")).alias("value"))
    order = c.where(k % 19 != 0).select(k.alias("position"), F.when(k % 29 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("name"))
    return preflight.theta_checks(theta, order).select("check", "severity", "status", "observed")


@query("""SELECT 'prediction_variables_audited' AS "check", 'BLOCKING' AS severity, CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END AS status, (count(*) = 0)::INTEGER::VARCHAR AS observed FROM part UNION ALL
SELECT 'prediction_required_variables_finite', 'BLOCKING', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*)::VARCHAR FROM (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) FILTER (p_retailprice < 905) > 0)""")
def preflight_prediction(spark, sf_dir):
    """Brands as variables, low prices as values that are not finite."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("variable")).agg(F.count(F.when(F.col("p_retailprice") < 905, 1)).alias("nonfinite"))
    return preflight.prediction_checks(p).select("check", "severity", "status", "observed")
