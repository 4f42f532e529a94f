"""A sound stack passes every check; each fault is found by its own."""

import pytest
from pyspark.sql import functions as F

from epigrid.operators import preflight

LATENT = "column long, intercept1 double, north double, intercept2 double, mintemp double, tier1_field int, tier1_field_group int, tier2_field int, tier2_field_group int, tier2_copy_field int, tier2_copy_field_group int, week_steps int, tier2_week int, admin_f int, cattle_q int, cattle_mid_log1p double"
OPTIONS = {"columns": 20, "fixed": ["intercept1", "north", "intercept2", "mintemp"], "nodes": 3, "groups": 2, "bins": 5}


@pytest.fixture(scope="module")
def sound(spark):
    stack = [(i, 1, float(i % 2), None, None) for i in range(1, 11)] + [(i, 2, None, float(i), 1.5) for i in range(11, 21)]
    latent = [(i, 1.0, i / 7, None, None, i % 3 + 1, i % 2 + 1, None, None, None, None, i, None, i % 4 + 1, None, None) for i in range(1, 11)]
    latent += [(i, None, None, 1.0, i / 3, None, None, i % 3 + 1, i % 2 + 1, i % 3 + 1, i % 2 + 1, None, i - 10, None, i % 5 + 1, (i % 5 + 1) / 2) for i in range(11, 21)]
    return (
        spark.createDataFrame(stack, "row long, link int, y1 double, y2 double, exposure double"), spark.createDataFrame([(i, i, 1.0) for i in range(1, 21)], "row long, column long, value double"),
        spark.createDataFrame(latent, LATENT),
    )


def faults(stack, matrix, latent, **more):
    rows = preflight.stack_preflight(stack, matrix, latent, **{**OPTIONS, **more}).collect()
    assert len({r.check for r in rows}) == len(rows)
    return {r.check: int(r.observed) for r in rows if r.status != "PASS"}


def test_a_sound_stack(spark, sound):
    prediction = spark.createDataFrame([("mintemp", 0), ("north", 0)], "variable string, nonfinite long")
    theta = spark.createDataFrame([(1, "a", 0.5), (2, "b", 1.5)], "position int, name string, value double")
    assert faults(*sound, field_columns=(1, 10), prediction=prediction, theta=(theta, theta.drop("value"))) == {}


def test_matrix_faults(spark, sound):
    stack, matrix, latent = sound
    more = lambda *rows: matrix.unionByName(spark.createDataFrame([*rows], "row long, column long, value double"))
    assert faults(stack, more((99, 1, 1.0)), latent) == {"A_row_count": 1}
    assert faults(stack, more((1, 21, 1.0), (2, 0, 1.0)), latent) == {"A_column_bounds": 2}
    assert faults(stack, more((1, 1, 1.0)), latent, field_columns=(1, 10)) == {"A_repeated_entries": 1, "field_row_sums": 1}
    assert faults(stack, more((3, 4, float("nan"))), latent) == {"A_finite_entries": 1}
    gone = faults(stack, matrix.where("row <> 12"), latent)
    assert gone["active_nonzero_rows"] == 1 and gone["mintemp_active_finite"] == 1 and gone["tier2_week_active_finite"] == 1 and gone["tier2_week_contiguous_levels"] == 1 and "north_active_finite" not in gone
    assert faults(stack, matrix.where("false"), latent)["A_dimensions"] == 1


def test_response_faults(spark, sound):
    stack, matrix, latent = sound
    at = lambda row, **values: stack.withColumns({c: F.when(F.col("row") == row, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})
    assert faults(at(1, y1=2.0), matrix, latent) == {"tier1_binary_values": 1}
    assert faults(at(1, y1=float("nan")), matrix, latent) == {"tier1_binary_values": 1}
    assert faults(at(11, y2=0.0), matrix, latent) == {"tier2_positive_values": 1}
    assert faults(at(11, exposure=float("inf")), matrix, latent) == {"tier2_active_exposure": 1}
    assert faults(at(1, exposure=1.0), matrix, latent) == {"tier1_exposure_semantics": 1}
    assert faults(at(1, y2=3.0), matrix, latent) == {"no_simultaneous_responses": 1, "link_response_alignment": 1}


def test_term_faults(spark, sound):
    stack, matrix, latent = sound
    at = lambda column, **values: latent.withColumns({c: F.when(F.col("column") == column, F.lit(v)).otherwise(F.col(c)).cast(dict(latent.dtypes)[c]) for c, v in values.items()})
    assert faults(stack, matrix, at(2, north=float("nan"))) == {"north_active_finite": 1}
    assert faults(stack, matrix, at(2, north=None)) == {"north_active_finite": 1}
    assert faults(stack, matrix, at(5, week_steps=6)) == {"week_steps_contiguous_levels": 1}
    assert faults(stack, matrix, at(5, tier1_field=4)) == {"tier1_field_maximum": 1}
    assert faults(stack, matrix, at(5, admin_f=0)) == {"admin_f_minimum": 1}
    assert faults(stack, matrix, latent.withColumn("admin_f", F.col("admin_f") + 0.5)) == {"admin_f_type": 1, "admin_f_integer_valued": 10}
    assert faults(stack, matrix, latent.drop("admin_f")) == {"admin_f_type": 1}
    grouped = faults(stack, matrix, latent.withColumns({f"{f}_group": F.when(F.col(f"{f}_group").isNotNull(), 1).cast("int") for f in ("tier1_field", "tier2_field", "tier2_copy_field")}))
    assert grouped == {"tier1_field_group_levels": 1, "tier2_field_group_levels": 1, "tier2_copy_field_group_levels": 1, "quarter_group_count": 1}
    assert faults(stack, matrix, latent.where("column < 20")) == {"latent_columns": 2, **{f"{t}_active_finite": 1 for t in ("intercept2", "mintemp", "tier2_field", "tier2_field_group", "tier2_copy_field", "tier2_copy_field_group", "tier2_week", "cattle_q", "cattle_mid_log1p")}, "cattle_q_feature_support": 1}


def test_curve_and_outer_faults(spark, sound):
    stack, matrix, latent = sound
    few = latent.withColumn("cattle_q", F.when(F.col("cattle_q") > 2, 1).otherwise(F.col("cattle_q")).cast("int"))
    assert faults(stack, matrix, few) == {"cattle_q_feature_support": 3, "cattle_q_active_structural_support": 3, "cattle_q_active_occupancy": 3}
    assert faults(stack.withColumn("y2", F.when(F.col("row") % 5 != 0, F.col("y2"))), matrix, latent) == {"cattle_q_active_structural_support": 1, "cattle_q_active_occupancy": 1}
    lost = faults(stack, matrix, latent.withColumn("cattle_mid_log1p", F.when(F.col("column") != 13, F.col("cattle_mid_log1p"))))
    assert lost == {"cattle_mid_log1p_active_finite": 1, "cattle_mid_log1p_feature_alignment": 1}
    prediction = spark.createDataFrame([("mintemp", 3)], "variable string, nonfinite long")
    old = spark.createDataFrame([(1, "b", 0.5), (2, "a", None), (3, "c", 1.0)], "position int, name string, value double")
    new = spark.createDataFrame([(1, "a"), (2, "b")], "position int, name string")
    assert faults(*sound, prediction=prediction, theta=(old, new)) == {"prediction_required_variables_finite": 1, "theta_shape": 2, "theta_order_provenance": 3}
