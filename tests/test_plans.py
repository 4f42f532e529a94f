import json

import pytest
from pyspark.sql import functions as F

from epigrid.functions import timeidx
from epigrid.operators import reporting
from epigrid.plans.config import configured, contract_differences, read_config, resume_stage
from epigrid.plans.surveillance import demo_inputs, postfit, prepare

CFG = {"study": {"start": "2024-01-01", "end": "2024-03-31"}, "bins": 5}


def test_config(tmp_path):
    assert configured({"holdout": {"fraction": 0.5}})["holdout"] == {"fraction": 0.5, "seed": 1}
    for bad in ({"holdout": {"fraction": 0}}, {"nothing": 1}, {"study": {"start": "2025-01-01"}}):
        with pytest.raises(ValueError):
            configured(bad)
    (tmp_path / "c.json").write_text(json.dumps(CFG))
    assert read_config(str(tmp_path / "c.json"))["bins"] == 5
    assert contract_differences({"a": 1, "b": 2}, {"a": 1}, ("a", "b")) == ["b"]
    assert resume_stage({"prepare": True}, ("prepare", "fit", "postfit")) == "fit"


def test_records_to_class_areas(spark):
    inputs = demo_inputs(spark, configured(CFG), rows=8, cols=8, n=300)
    t = prepare(inputs, CFG)
    audit = {r["stage"]: r["count"] for r in t["exclusion_audit"].collect()}
    assert audit["input"] == 300 == sum(v for k, v in audit.items() if k != "input") and audit["retained"] == t["observations"].count()
    assert audit["outside_study_period"] > 0 and audit["outside_spatial_domain"] > 0
    assert t["conservation"].first().conserved and t["thinning_audit"].first().balanced
    weeks = inputs["weeks"].count()
    assert t["tier2"].count() == 64 * weeks == t["prediction_grid"].count()
    assert t["tier2"].agg(F.sum("count")).first()[0] == audit["retained"]
    assert t["tier2"].where("cattle_q not between 1 and 5 or mintemp_z is null").count() == 0
    effects = inputs["weeks"].where("time_index <> 3").select(F.col("time_index").alias("index"), (F.col("time_index") / 50.0).alias("mean"))
    out = postfit(inputs, t, {"intercept1": -1.0, "intercept2": 0.5, "mintemp": 0.3}, effects, CFG)
    assert out["gate"].first().outcome == "PASS"
    assert out["predictions"].where("week_effect_unseen").count() == 64
    assert out["areas"].agg(F.sum("cells"), F.sum("area")).first() == (64, 64.0)
    used = out["threshold"].first()
    assert used.used == used.total == audit["retained"]
    repeated = postfit({**inputs, "weekly": inputs["weekly"].repartition(7)}, t, {"intercept1": -1.0, "intercept2": 0.5, "mintemp": 0.3}, effects.repartition(3), CFG)
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(out["classes"]) == key(repeated["classes"])


def test_reports(spark):
    fixed = spark.createDataFrame([("north", 1.0, 0.1, 0.8, 1.0, 1.2), ("pigs", 0.1, 0.3, -0.5, 0.1, 0.7)], "term string, mean double, sd double, `0.025quant` double, `0.5quant` double, `0.975quant` double")
    got = {r.term: r for r in reporting.fixed_effects(fixed, ["north"]).collect()}
    assert got["north"].tier == "Tier 1" and got["north"].excludes_zero and got["pigs"].label == "Pigs" and not got["pigs"].excludes_zero
    effects = spark.createDataFrame([(1, 1.0, 0.6, 1.0, 1.4), (2, 2.0, 1.6, 2.0, 2.4), (3, 3.0, 2.6, 3.0, 3.4)], "q int, mean double, q025 double, median double, q975 double")
    weights = spark.createDataFrame([(1, 0.1), (2, 0.5), (3, 1.0)], "q int, w double")
    w = {r.q: (round(r["mean"], 9), round(r.q025, 9)) for r in reporting.weighted_effects(effects, weights, "q", "w").collect()}
    assert w == {1: (0.1, 0.06), 2: (1.0, 0.8), 3: (3.0, 2.6)}
    weeks = timeidx.week_index(spark, "2024-01-01", "2024-01-14")
    t = reporting.temporal_effects(effects.withColumnRenamed("q", "index"), weeks)
    assert {r["index"]: r.week for r in t.collect()} == {1: "2024-W01", 2: "2024-W02", 3: None}
    h = reporting.hyperparameters(spark.createDataFrame([("Range for tier2_field", 5.0)], "parameter string, mean double")).first()
    assert (h.component, h.parameter) == ("Tier 2 SPDE", "range")
    v = spark.createDataFrame([(0.0,), (1.0,), (None,), (float("nan"),)], "v double")
    d = reporting.distribution_audit(v, "v").first()
    assert (d.rows, d.finite, d.zeros, d.zero_share, d.median) == (4, 2, 1, 0.5, 0.5)
    f = reporting.class_front(spark.createDataFrame([(3, 31.0), (3, 41.0), (1, 50.0)], "rpi_class int, lat double"), "lat").first()
    assert (f.cells, f.max, f.north_of_30, f.north_of_40) == (2, 41.0, 2, 1)
    c = reporting.variant_counts({"a": v, "b": v.limit(1)}, {"some": F.col("v").isNotNull()})
    assert {r.variant: r.total for r in c.collect()} == {"a": 4, "b": 1}
    p = {r.check: r.failures for r in reporting.prediction_compatibility(v.withColumn("g", F.lit(9)), ["v", "x"], "g", 8).collect()}
    assert p == {"missing_columns": 1, "group_range": 4, "finite_v": 2}
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    assert reporting.plans_agree(a, a.repartition(2), "k", "v").first()["pass"] and not reporting.plans_agree(a, a.limit(1), "k", "v").first()["pass"]
    assert reporting.with_aliases(reporting.prefixed(a, ["v", "z"]), {"w": "v", "u": "z"}).columns == ["k", "v", "source_v", "w"]


def test_ids_and_contracts(spark):
    from epigrid.plans.config import dimension_contract, run_id, support_summary

    assert run_id(" a ", None) == ("a", False) and run_id(None, "b") == ("b", True) and run_id("", " ") == (None, False)
    with pytest.raises(ValueError):
        run_id("a", "b")
    weeks = timeidx.time_buckets(timeidx.week_index(spark, "2024-01-01", "2024-06-30"))
    grid = weeks.crossJoin(spark.range(3).withColumnRenamed("id", "cell_id"))
    got = dimension_contract(grid, weeks).first()
    assert got.reconciled and got.modeled_weeks == 26 and got.prediction_rows == 78 and got.horizon_start == "2024-W01"
    assert not dimension_contract(grid.where("not (cell_id = 1 and time_index = 4)"), weeks).first().reconciled
    flagged = grid.withColumns({"admin": F.col("cell_id"), "unseen": F.col("cell_id") == 2})
    assert support_summary(flagged, "zero_mean").first()["rows"] == 26
    with pytest.raises(ValueError):
        support_summary(flagged, "fail")


def test_weekly_covariates_fail_on_request(spark):
    from epigrid.operators import grid

    rows = spark.createDataFrame([(1, 2024, 1), (2, 2024, 1)], "cell_id int, epiyear int, epiweek int")
    values = spark.createDataFrame([(1, 2024, 1, "t", 5.0)], "cell_id int, epiyear int, epiweek int, variable string, value double")
    joined, counts = grid.weekly_covariates(rows, values, ["cell_id", "epiyear", "epiweek"], ["t"])
    assert joined.count() == 2 and counts.first().missing == 1
    with pytest.raises(ValueError):
        grid.weekly_covariates(rows, values, ["cell_id", "epiyear", "epiweek"], ["t"], "fail")


def test_model_summary_and_gate_outcome(spark):
    from epigrid.operators import gate_rules, gates

    products = spark.createDataFrame([(n, 5, 5, 0) for n, _ in gate_rules.REPORT_CHECKS.values()], "name string, rows long, expected_rows long, faults long").distinct()
    checks = gate_rules.reporting_qa(products)
    assert checks.count() == 22 and gates.outcome(checks).first().outcome == "PASS"
    assert gates.outcome(gate_rules.reporting_qa(products.where("name <> 'manifest'"))).first().outcome == "PASS_WITH_WARNINGS"
    assert gates.outcome(gate_rules.reporting_qa(products.where("name <> 'fit'"))).first().outcome == "FAIL"
    audits = spark.createDataFrame([(c, "PASS") for c in gate_rules.POSTFIT], "check string, status string")
    assert gates.outcome(gate_rules.postfit_gate(audits)).first().outcome == "PASS"
    assert gates.outcome(gate_rules.postfit_gate(audits.where("check <> 'raster_mapping'"))).first().outcome == "FAIL"


def test_exact_quantiles(spark):
    from epigrid.operators import metrics

    rows = [(i % 3, float((i * 37) % 11) if i % 7 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    import numpy as np

    got = {r.g: (r.a, r.b, r.c) for r in metrics.exact_quantiles(df, "v", {"a": 0.05, "b": 0.5, "c": 0.93}, ["g"]).collect()}
    for g in range(3):
        v = [x for h, x in rows if h == g and x is not None]
        assert np.allclose(got[g], np.quantile(v, [0.05, 0.5, 0.93]))
    nulls = metrics.exact_quantiles(spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double"), "v", {"m": 0.5}, ["g"])
    assert {(r.g, r.m) for r in nulls.collect()} == {(None, 2.0), ("a", 5.0)}
    assert metrics.exact_quantiles(df.limit(0), "v", {"m": 0.5}).count() == 0


def test_ties_are_dealt_to_bins_by_row_id(spark, monkeypatch):
    from epigrid.operators import metrics

    rows = [(i, 0.0 if i % 3 else float(i), float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, p double, o double").repartition(4)
    plain = sorted(map(tuple, metrics.equal_frequency_bins(df, "p", "o", "id", 7).collect()))
    monkeypatch.setattr(metrics, "TIED", 10)
    assert sorted(map(tuple, metrics.equal_frequency_bins(df, "p", "o", "id", 7).collect())) == plain
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    want = [sum(r[2] for k, r in enumerate(order) if k * 7 // 300 == b) for b in range(7)]
    assert [r[4] for r in plain] == want
