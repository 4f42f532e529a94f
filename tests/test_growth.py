"""Steps that must not grow with their tables: what passes through the driver, and how many rows a task gets."""

import re

from pyspark.sql import functions as F
from test_clipping import frame, square

from epigrid.operators import clipping, mesh, metrics, predictor, preflight, sets, support


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _squares(spark, n):
    """n square cells, with their nodes, in two variants."""
    c = spark.range(n).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("variant"), F.col("id").alias("poly_id"), (F.col("id") % 5 * 1.0).alias("x"), (F.col("id") % 7 * 1.0).alias("y"))
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    cells = clipping.ring_edges(c.select("variant", "poly_id", F.lit(0).alias("ring"), F.array(corner(0, 0), corner(2, 0), corner(2, 2), corner(0, 2)).alias("corners")), ["variant", "poly_id"])
    return cells, c.select("variant", "poly_id", F.col("x") + 1.0, F.col("y") + 1.0).toDF("variant", "poly_id", "x", "y")


def test_places_broadcast_no_cells(spark):
    cells, nodes = _squares(spark, 20)
    domain = frame(spark, {0: [square(0, 0, 4.5, 4)]})
    classes, over = support.classify(cells, nodes, domain)
    places = support.representatives(classes, over, cells, domain)
    assert places.count()
    joins = re.findall(r"BroadcastHashJoin \[(.*?)\]", _plan(places))
    assert not [j for j in joins if re.search(r"variant|poly_id|\ba#|key", j)]
    assert "SortMergeJoin" in _plan(places)


def test_an_overlay_is_dealt_to_all_cores(spark):
    """Few bytes, much work: tasks are not put together."""
    cells, _ = _squares(spark, 20)
    over = clipping.overlay(cells.withColumn("key", F.struct("variant", "poly_id")), frame(spark, {0: [square(0, 0, 4.5, 4)]}), a_id="key")
    assert over.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_dealt_has_no_task_of_all_rows(spark):
    df = sets.dealt(spark.range(0, 1000, 1, 1), "id", rows=50)
    assert df.rdd.getNumPartitions() == 20
    assert max(df.rdd.glom().map(len).collect()) < 120 and df.count() == 1000


def test_dual_cells_put_no_points_together_before_they_are_dealt(spark):
    """A task that reads many nodes must not hold the distinct points of all of them."""
    nodes, triangles = mesh.structured_mesh(spark, 4, 3)
    cells = mesh.dual_cells(nodes, triangles)
    keys = re.findall(r"HashAggregate\(keys=\[(.*?)\], functions", _plan(cells))
    assert keys and not [k for k in keys if "px" in k]
    assert not re.search(r"BroadcastHashJoin \[n\d", _plan(cells))
    assert cells.count() == 20


def test_layout_deals_rows_before_equal_ones_are_put_together(spark):
    rows = spark.range(1, 101, 1, 1).toDF("stack_row")
    out = predictor.predictor_layout(rows, spark.range(40), 60)
    plan = _plan(out)
    assert "partial_count(distinct stack_row" not in plan and "REPARTITION_BY_NUM" in plan
    assert tuple(out.first()) == (40, 60, 100, True)
    twice = rows.unionByName(rows.where("stack_row = 7")).where("stack_row <> 9")
    assert tuple(predictor.predictor_layout(twice, spark.range(40), 60).first()) == (40, 60, 100, False)
    assert tuple(predictor.predictor_layout(rows.limit(0), spark.range(0), 0).first())[:3] == (0, 0, 0)


def test_quantiles_of_counted_values(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (10.0, 4)], "v double, c int")
    many = df.select(F.explode(F.array_repeat("v", F.col("c"))).alias("v"))
    probs = {"a": 0.1, "b": 0.5, "c_": 0.6}
    assert metrics.exact_quantiles(df, "v", probs, weight="c").collect() == metrics.exact_quantiles(many, "v", probs).collect()


def test_terms_are_not_put_together_by_row_or_latent_column_of_entries(spark):
    """An entry stays one row, whatever the terms; more terms than bits go in blocks."""
    stack = spark.createDataFrame([(1, 1, 1.0, None, None), (2, 2, None, 3.0, 1.0)], "row long, link int, y1 double, y2 double, exposure double")
    matrix = spark.createDataFrame([(1, 1, 1.0), (2, 2, 0.5), (2, 3, 0.0)], "row long, column long, value double")
    names = [f"t{k}" for k in range(70)]
    latent = spark.range(1, 4).select(F.col("id").alias("column"), *[(F.col("id") * 10 + k).cast("double").alias(n) for k, n in enumerate(names)])
    out = preflight.term_metrics(stack, matrix, latent, preflight.fixed_terms(names))
    assert not re.search(r"HashAggregate\(keys=\[term#\d+, row#", _plan(preflight.term_metrics(stack, matrix, latent, preflight.fixed_terms(names[:3]))))
    got = {r.term: r for r in out.collect()}
    assert len(got) == 70 and all((r.active_rows, r.unprojected_rows, r.finite_count) == (2, 0, 2) for r in got.values())
    assert (got["t69"].minimum, got["t69"].maximum) == (79.0, 89.0)
