import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from epigrid.functions import timeidx
from epigrid.functions.places import Grid
from epigrid.operators import cleaning, gates, geometry, grid, hosts, mesh, metrics, persistence, predictor, responses, sets, tiers


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# cleaning


def test_first_reason_wins_and_the_audit_balances(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-05", 1.0, 1.0), (2, None, 1.0, 1.0), (3, "x", 1.0, 1.0), (4, "2023-01-05", None, 1.0), (5, "2024-01-05", float("nan"), 1.0), (6, "2024-01-05", 9.0, 1.0), (7, "2024-01-05", 1.0, 1.0), (8, "2023-01-05", 1.0, 1.0)],
        "observation_id int, date string, lon double, lat double",
    ).withColumn("parsed_date", F.to_date(F.try_to_timestamp("date", F.lit("yyyy-MM-dd"))))
    marked = cleaning.clean_observations(df, "2024-01-01", "2024-12-31", inside=F.col("lon") < 5)
    got = {r.observation_id: r.exclusion_reason for r in marked.collect()}
    assert got == {1: None, 2: "missing_date", 3: "invalid_date", 4: "outside_study_period", 5: "invalid_coordinates", 6: "outside_spatial_domain", 7: "exact_date_location_duplicate", 8: "outside_study_period"}
    audit = {r["stage"]: r["count"] for r in cleaning.exclusion_audit(marked, cleaning.RAW_REASONS).collect()}
    assert audit["input"] == 8 == audit["retained"] + sum(audit[x] for x in cleaning.RAW_REASONS)
    kept, gone = cleaning.split_reasons(marked)
    assert kept.count() == 1 and gone.count() == 7


def test_weekly_cascade_and_missing_policy(spark):
    weeks = timeidx.week_index(spark, "2024-01-01", "2024-01-14")
    df = spark.createDataFrame([(1, 2024, 1, 1.0, 1.0), (2, 2024, 54, 1.0, 1.0), (3, 2024, 9, 1.0, 1.0), (4, 2024, 1, 1.0, 1.0), (5, None, 1, 1.0, 1.0)], "observation_id int, epiyear int, epiweek int, x double, y double")
    got = dict(rows(cleaning.clean_weekly_observations(df, weeks), "observation_id", "exclusion_reason"))
    assert got == {1: None, 2: "invalid_year_week", 3: "outside_study_period", 4: "exact_point_week_duplicate", 5: "invalid_year_week"}
    assert cleaning.apply_missing_policy(df, ["epiyear"], "complete_case").count() == 4
    with pytest.raises(ValueError):
        cleaning.apply_missing_policy(df, ["epiyear"], "fail")


def test_origins_and_background(spark):
    df = spark.createDataFrame([("obs_1", 1, 1, None, 0.1, False), ("quad_1", None, 0, True, 1.0, False), ("quad_2", None, 0, None, 1.0, False), ("quad_3", None, 0, True, 0.0, False), ("quad_4", None, 0, True, 1.0, True), ("x", None, 1, True, 1.0, False)], "row string, source_obs_id int, Yi int, inside_domain boolean, sc_Exp double, is_censored boolean")
    o = cleaning.source_origin(df, row_id="row").withColumn("prediction", F.lit(1.0))
    assert [r.origin for r in o.collect()] == ["occurrence", "quadrature", "quadrature", "quadrature", "quadrature", "unclassified"]
    assert rows(cleaning.reference_background(o), "row") == [("quad_1",)]


# tiers and responses


def test_conservation_and_grid(spark):
    weeks = timeidx.week_index(spark, "2024-01-01", "2024-01-14")
    o = spark.createDataFrame([(1, 0.5, 0.5, 2024, 1, 1, 7), (2, 0.5, 0.5, 2024, 1, 1, 7), (3, 0.5, 0.5, 2024, 2, 2, 8)], "observation_id int, x double, y double, epiyear int, epiweek int, time_index int, poly_id int")
    nodes = spark.createDataFrame([(1, 0.0, 0.0, 4.0, True), (2, 1.0, 1.0, 5.0, None)], "node int, x double, y double, area double, inside_domain boolean")
    t1 = tiers.presence_background(o, nodes, weeks)
    t2 = tiers.area_week_counts(o, spark.createDataFrame([(7,), (8,), (9,)], "poly_id int"), weeks)
    assert t1.count() == 3 + 4 and rows(t1.where("Yi = 0"), "sc_Exp") == [(0.0001,), (0.0001,), (4.0,), (4.0,)]
    assert t2.count() == 6 and t2.agg(F.max("count")).first()[0] == 2
    assert tiers.conservation(o, t1, t2).first().conserved


def test_thinning(spark):
    df = spark.createDataFrame([(1, 2024, 1, 5, 1), (2, 2024, 1, 5, 1), (3, 2024, 1, 5, 1), (4, 2024, 2, 5, 1), (5, 2024, 2, None, 1), (6, 2024, 1, 5, 0), (7, 2024, 1, 5, 0)], "row_id int, epiyear int, epiweek int, cell_id int, Yi int")
    a = tiers.thinning_audit(tiers.thin_presences(df, 1)).first()
    assert (a.presences, a.kept, a.duplicate, a.outside, a.balanced) == (5, 2, 2, 1, True)
    pick = lambda seed, n: rows(tiers.thin_presences(df.repartition(n), seed).where("thinning = 'kept'"), "row_id")
    assert pick(1, 1) == pick(1, 3) and len({tuple(pick(s, 1)) for s in range(6)}) > 1
    assert tiers.thinning_audit(tiers.thin_presences(df, 1, enabled=False)).first().kept == 5


def test_censoring_zeros_and_holdout(spark):
    df = spark.createDataFrame([("A", 2025, 31, 2.0), ("A", 2025, 32, 0.0), ("B", 2025, 31, 1.0), ("B", 2025, 32, 3.0)], "admin string, epiyear int, epiweek int, y double")
    silent = responses.silent_areas(df, "admin", "y", 2025, 32)
    out = responses.censor(df, silent, "admin", "y", 2025, 32)
    assert {(r.admin, r.epiweek) for r in out.where("is_censored").collect()} == {("A", 32)}
    assert out.where("response_censored is null").count() == 1
    z = responses.zero_policy(spark.createDataFrame([(0.0,), (1.0,), (0.0,)], "r double"), "exclude", "r")
    assert sorted([r.r for r in z.collect()], key=str) == [1.0, None, None]
    many = spark.range(1000).select("id", F.lit(False).alias("is_censored"), (F.col("id") % 4).cast("double").alias("response_censored"))
    pick = lambda d, s: rows(responses.holdout(d, 0.1, s, "id").where("is_test_point"), "id")
    assert len(pick(many, 1)) == 75 and pick(many, 1) == pick(many.repartition(7), 1) != pick(many, 2)
    assert responses.holdout(many, 0.1, 1, "id").where("is_test_point and (response_censored <= 0 or response_training is not null)").count() == 0


def test_factors_bins_and_standardizers(spark):
    names = spark.createDataFrame([("b",), ("a",), (None,), ("",), ("Unk",)], "admin_u string")
    assert rows(responses.area_factor(names), "admin_f", "admin_u") == [(1, "a"), (2, "b"), (3, "Unk")]
    x = spark.createDataFrame([(float(v),) for v in (1, 1, 2, 3, 4, 5, 6, 7)], "x double")
    assert [b for _, b in rows(responses.rank_bins(x, "x", 4), "x", "bin")] == [1, 1, 2, 2, 3, 3, 4, 4]
    spec = responses.standardizers(x.unionByName(spark.createDataFrame([(None,)], "x double")), ["x"]).first()
    assert spec.center == pytest.approx(29 / 8) and spec.scale == pytest.approx(np.std([1, 1, 2, 3, 4, 5, 6, 7], ddof=1))
    assert responses.group_audit(spark.range(1, 11).unionByName(spark.createDataFrame([(12,)], "id long")), "id").first().contiguous is False


def test_simulated_points_follow_the_density(spark):
    density = spark.createDataFrame([(1, 1, 1.0), (1, 2, 4.0), (1, 3, 0.0), (1, 4, None)], "time_index int, cell_id int, value double")
    got = tiers.simulate_points(density, 2000, 5).groupBy("cell_id").count().collect()
    n = {r["cell_id"]: r["count"] for r in got}
    assert sum(n.values()) == 2000 and set(n) == {1, 2} and abs(n[2] / 2000 - 8 / 9) < 0.04


# metrics


def scores(spark, values, extra=()):
    return spark.createDataFrame([(float(v), *e) for v, e in zip(values, extra or [()] * len(values), strict=True)], "s double" + (", w double" if extra else ""))


@pytest.mark.parametrize(("p", "b", "w", "auc"), [((3, 4), (1, 2), (1, 1), 1), ((1, 2), (3, 4), (1, 1), 0), ((1, 1), (1, 1), (1, 1), 0.5), ((2,), (1, 3), (0.9, 0.1), 0.9)])
def test_weighted_auc(spark, p, b, w, auc):
    background = scores(spark, b, [(float(x),) for x in w])
    assert metrics.weighted_auc(scores(spark, p), background, "s", F.col("w")).first().auc == pytest.approx(auc)


def test_same_week_percentiles(spark):
    b = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 2.0), (1, 3.0, 1.0)], "k int, s double, w double")
    p = spark.createDataFrame([(1, 0.0), (1, 4.0), (1, 2.0)], "k int, s double")
    got = {r.s: (r.percentile, r.weighted_percentile) for r in metrics.same_week_percentiles(p, b, "s", "w", ["k"]).collect()}
    assert got == {0.0: (0, 0), 4.0: (1, 1), 2.0: (pytest.approx(0.5), pytest.approx(0.5))}


def test_ranks_and_auc_match_sorting(spark):
    rng = random.Random(3)
    data = [(i, float(rng.randint(0, 40)) if i % 9 else None, int(rng.random() < 0.4)) for i in range(500)]
    df = spark.createDataFrame(data, "i int, s double, y int").repartition(5)
    ranks = {r.i: r.k for r in metrics.average_rank(df, "s", "k").collect()}
    have = sorted(s for _, s, _ in data if s is not None)
    for i, s, _ in data:
        assert ranks[i] == (None if s is None else have.index(s) + (have.count(s) + 1) / 2)
    pos, neg = ([s for _, s, y in data if s is not None and y == k] for k in (1, 0))
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert metrics.rank_auc(df, "s", "y").first().auc == pytest.approx(want)


def test_boyce(spark):
    background = scores(spark, range(100))
    index = lambda p: metrics.boyce_index(metrics.boyce_curve(scores(spark, p), background, "s")).collect()
    assert index([60, 70, 80, 85, 90, 92, 95, 97, 98, 99])[0].cbi > 0 > index([0, 1, 2, 3, 5, 8, 15, 30, 40])[0].cbi
    assert metrics.boyce_curve(scores(spark, [5, 5]), scores(spark, [5, 5]), "s").count() == 0


def test_calibration_and_errors(spark):
    df = spark.createDataFrame([(float(2 * i + 1), float(i)) for i in range(30)], "o double, p double")
    c = metrics.linear_calibration(df, "o", "p").first()
    assert c.intercept == pytest.approx(1) and c.slope == pytest.approx(2)
    e = metrics.error_metrics(df, "o", "p").first()
    assert e.mae == pytest.approx(np.mean([i + 1 for i in range(30)])) and e.pearson == pytest.approx(1) and e.spearman == pytest.approx(1)
    assert metrics.linear_calibration(df.limit(2), "o", "p").first().slope is None
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 2 * x)))).astype(int)
    table = spark.createDataFrame([(int(a), float(1 / (1 + np.exp(-b)))) for a, b in zip(y, x, strict=True)], "y int, p double")
    a, b = metrics.logistic_calibration(table, "y", "p")
    assert abs(a - 0.5) < 0.15 and abs(b - 2) < 0.25


# grids


def test_extraction_and_fallback(spark):
    g = Grid(5, 5, 0.0, 5.0, 0.0, 5.0)
    cells = spark.range(1, 26).select(F.col("id").alias("cell_id"), F.when(F.col("id") != 13, F.col("id").cast("double")).alias("value"))
    points = spark.createDataFrame([(1, 1.0, 4.0), (2, 2.5, 2.5), (3, 9.0, 9.0), (4, 0.5, 4.5)], "k int, x double, y double")
    got = {r.k: r for r in grid.extract_with_fallback(points, cells, g, ["k"], 1.2).collect()}
    assert got[1].direct == pytest.approx((1 + 2 + 6 + 7) / 4) and got[1].method == "direct"
    assert got[2].method == "fallback" and got[2].value == 8.0 and got[2].distance_km == pytest.approx(1.0)
    assert got[3].method == "unresolved" and got[3].value is None
    assert got[4].direct == 1.0
    audit = grid.extraction_audit(grid.extract_with_fallback(points, cells, g, ["k"], 1.2).withColumn("v", F.lit("a")), ["v"]).first()
    assert (audit.n_direct, audit.n_fallback, audit.n_unresolved) == (2, 1, 1)


def test_same_week_and_assignment(spark):
    stack = spark.createDataFrame([(2024, w, c, float(c + 10 * (w - 1))) for w in (1, 2) for c in range(1, 5)], "epiyear int, epiweek int, cell_id long, value double")
    o = spark.createDataFrame([(1, 2024, 1, 1), (2, 2024, 9, 1)], "k int, epiyear int, epiweek int, cell_id long")
    assert rows(grid.same_week_values(o, stack, ["epiyear", "epiweek"]).na.fill(-1.0, ["value"]), "k", "value") == [(1, 1.0), (2, -1.0)]
    g = Grid(2, 2, 0.0, 2.0, 0.0, 2.0)
    table = spark.createDataFrame([(3, 30.0), (1, 10.0)], "cell_id long, v double")
    assert [r.value for r in grid.assign_to_grid(table, g, "v").orderBy("cell_id").collect()] == [10.0, None, 30.0, None]
    bad = grid.assignment_faults(spark.createDataFrame([(1, 1.0), (1, float("nan")), (9, 1.0)], "cell_id long, v double"), g, "v").first()
    assert tuple(bad) == (1, 1, 1)


# persistence


def stack_of(spark, cells):
    return spark.createDataFrame([(c, t, v) for c, vs in cells.items() for t, v in enumerate(vs)], "cell_id int, t int, value double")


def test_longest_runs(spark):
    s = stack_of(spark, {1: [2.0] * 9, 2: [2.0, None, 2.0, 2.0, 0.0, 2.0], 3: [None] * 4, 4: [0.0] * 3, 5: [float("nan"), 5.0, 5.0]})
    assert rows(persistence.longest_run(s, 1.0, ["t"]).where("longest_run is not null"), "cell_id", "longest_run") == [(1, 9), (2, 2), (4, 0), (5, 2)]
    assert dict(rows(persistence.longest_run(s, 1.0, ["t"], missing="zero"), "cell_id", "longest_run"))[3] == 0
    long = persistence.persistence(persistence.longest_run(stack_of(spark, {1: [2.0] * 24, 2: [2.0] * 45}), 1.0, ["t"]))
    assert rows(long, "rpi", "rpi_class") == [(8.0, 2), (15.0, 3)]
    areas = persistence.class_areas(long, 10.0)
    assert rows(areas, "rpi_class", "cells", "area", "share") == [(0, 0, 0.0, 0.0), (1, 0, 0.0, 0.0), (2, 1, 10.0, 0.5), (3, 1, 10.0, 0.5)]


def test_threshold(spark):
    stack = spark.createDataFrame([(w, c, None if c == 3 else float(v)) for w in (1, 2, 3) for c, v in ((1, 2 * (w - 1)), (2, 2 * (w - 1) + 1), (3, 0))], "w int, cell_id long, value double")
    o = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3), (9, 1)], "w int, cell_id long")
    got = persistence.dynamic_threshold(o, stack, ["w"]).first()
    assert got.threshold == pytest.approx(0.2) and (got.total, got.outside_horizon, got.unsupported, got.used, got.zeros) == (5, 1, 1, 3, 1)


def test_fronts(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, d), float(d * 10 + k)) for d in range(1, 11) for k in range(2)], "d date, y double")
    f = persistence.front_velocity(persistence.front_quantiles(df, "d", "y"))
    got = {r.day.day: r for r in f.collect()}
    assert got[2].front is None and got[3].front == pytest.approx(np.quantile([10, 11, 20, 21, 30, 31], 0.95)) and got[3].advance == 0
    assert got[10].advance == pytest.approx(10)
    smooth = {r.day.day: r.smoothed for r in persistence.smooth_walk(f).collect()}
    assert len(smooth) == 10 and max(smooth.values()) < 10
    none = persistence.transitions(*[spark.createDataFrame([(1, c), (2, 3)], "cell_id int, rpi_class int") for c in (0, 1)])
    assert rows(none, "from_class", "to_0", "to_1", "to_2", "to_3") == [(0, 0, 1, 0, 0), (3, 0, 0, 0, 1)]


# hosts, geometry, mesh


def test_host_patterns(spark):
    names = ["Bovino-Suino", "ovino", "bovino", "porcupine", "dragon", None] + ["bovino"] * 94
    df = spark.createDataFrame(list(enumerate(names)), "i int, h string")
    x = hosts.expand_hosts(df, hosts.pattern_table(spark), "h", "i")
    a = hosts.host_audit(x, df, "h").first()
    assert (a.submissions, a.expanded, a.compound, a.unmatched) == (100, 102, 2, 2)
    assert rows(x.where("submission = 1"), "common_name") == [("Sheep",)] and rows(x.where("submission = 3"), "common_name") == [("Pig",), ("Porcupine",)]
    first = hosts.first_hosts(x)
    assert first.count() == 100 and first.where("submission = 0").first().common_name == "Cattle"
    c = {r.common_name: r for r in hosts.composition(x, df.agg(F.count(F.lit(1)).alias("n"))).collect()}
    assert c["Cattle"].tier == "Major Hosts" and c["Cattle"]["count"] == 96 and c["Unreported"].group_order == 7


def test_polygons(spark):
    shapes = spark.createDataFrame([(1, "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))"), (2, "POLYGON((4 0, 8 0, 8 4, 4 4, 4 0))")], "poly_id int, wkt string")
    e = geometry.edges(shapes)
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 4.0, 2.0), (4, 9.0, 9.0), (5, 1.0, 1.5), (6, 6.0, 1.0)], "k int, x double, y double")
    assert rows(geometry.point_polygons(p, e, ["k"]), "k", "poly_id") == [(1, 1), (3, 1), (3, 2), (5, 1), (6, 2)]
    assert rows(geometry.point_polygons(p, e, ["k"], strict=True), "k", "poly_id") == [(1, 1), (6, 2)]
    assert rows(geometry.polygon_areas(e), "poly_id", "area") == [(1, 15.0), (2, 16.0)]
    with pytest.raises(ValueError):
        geometry.assign_one(p, e, ["k"])
    assert rows(geometry.assign_one(p.where("k in (1, 6)"), e, ["k"]), "k", "poly_id") == [(1, 1), (6, 2)]
    units = spark.createDataFrame([(1, "z"), (2, "a")], "poly_id int, unit string")
    assert dict(rows(geometry.assign_unit(p, e, units, ["k"]), "k", "admin_u")) == {1: "z", 2: "Unk", 3: "a", 4: "Unk", 5: "z", 6: "a"}
    cells = spark.createDataFrame([(1, "POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))"), (2, "POLYGON((5 5, 6 5, 6 6, 5 6, 5 5))")], "poly_id int, wkt string")
    cut = geometry.clipped_areas(cells, [np.array([[1.0, 1.0], [4.0, 1.0], [4.0, 4.0], [1.0, 4.0]])])
    assert rows(cut, "poly_id", "full_area", "clipped_area", "intersects") == [(1, 4.0, 1.0, True), (2, 1.0, 0.0, False)]


def test_mesh(spark):
    nodes, triangles = mesh.structured_mesh(spark, 4, 3)
    assert mesh.dual_areas(nodes, triangles).agg(F.sum("area")).first()[0] == pytest.approx(12)
    assert mesh.network(triangles).count() == 20 + 24 - 1 and mesh.boundary(triangles).count() == 14  # edges = nodes + triangles - 1
    cells = mesh.dual_cells(nodes, triangles)
    total = geometry.polygon_areas(geometry.edges(cells, "node"), "node").agg(F.sum("area")).first()[0]
    assert cells.count() == 20 and total == pytest.approx(12)
    p = spark.createDataFrame([(1, 0.25, 0.5), (2, 3.9, 2.9), (3, 7.0, 7.0)], "k int, x double, y double")
    a = mesh.projector(p, nodes, triangles, "k")
    assert {r["row"]: r["s"] for r in a.groupBy("row").agg(F.sum("weight").alias("s")).collect()} == {1: pytest.approx(1), 2: pytest.approx(1)}
    got = {r["row"]: r["value"] for r in mesh.project_field(a, nodes.select("node", F.lit(1).alias("group"), (F.col("x") + 10 * F.col("y")).alias("mean"))).collect()}
    assert got == {1: pytest.approx(5.25), 2: pytest.approx(32.9)}


# predictor, sets, gates


def test_predictor(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0, 1), (2, 3.0, 4.0, 6.0, 3)], "r int, a double, b double, c double, lvl int")
    value = predictor.fixed_contribution({"i": 1.0, "a": 3.0, "b": 4.0, "c": 2.0, "a:b": 10.0}, {"a": "a", "b": "b", "c": "c"}, ["i", "a", "b", "a:b"])
    assert [r.v for r in df.orderBy("r").select(value.alias("v")).collect()] == [1 + 6 + 12 + 60, 1 + 9 + 16 + 120]
    effects = spark.createDataFrame([(1, 0.25), (2, 0.5)], "index int, mean double")
    with pytest.raises(ValueError):
        predictor.random_effect(df, effects, "lvl", "e")
    z = predictor.random_effect(df, effects, "lvl", "e", unseen="zero")
    assert rows(z, "r", "e", "e_unseen") == [(1, 0.25, False), (2, 0.0, True)]
    full = predictor.assemble(z.withColumn("f", F.lit(1.0)), ["f", "e"], ["f"], "c")
    assert full.where("r = 1").first().tier1_probability_plugin == pytest.approx(1 / (1 + np.exp(-1.25)))
    assert predictor.identity_check(predictor.structural(full, "eta1_mean", ["e"], "s"), "eta1_mean", ["s", "e"]).first()["pass"]
    one, weekly = predictor.output_checks(full.withColumn("space_time_id", F.col("r")).withColumn("w", F.lit(1)), ["w"])
    assert {r.failures for r in one.collect()} == {0} == {r.failures for r in weekly.collect()}


def test_stratified_rows_and_criteria(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2) for i in range(1, 21)], "i int, a int, b int")
    assert rows(predictor.stratified_first_rows(df, ["a", "b"], "i", 5), "i") == [(1,), (2,), (3,), (4,), (5,)]
    local = spark.createDataFrame([("f1", "dic", 1.0), ("f1", "dic", 2.0), ("f2", "dic", 7.0), ("f2", "dic", None)], "family string, criterion string, value double")
    assert predictor.criteria_by_family(local, spark.createDataFrame([("dic", 10.0)], "criterion string, value double"), "family").first().reconciled


def test_sets(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, v string")
    with pytest.raises(ValueError):
        sets.left_join_checked(a, a, ["k"])
    joined = sets.left_join_checked(a, a.where("k = 1"), ["k"])
    assert joined.count() == 3 and "v_right" in joined.columns
    first = sets.lookup(spark.createDataFrame([(2,), (3,)], "k int"), a, "k", "v", ["v"], default="none")
    assert rows(first, "k", "v") == [(2, "y"), (3, "none")]
    grid_ = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "n int, g int")
    c = sets.cross_product_check(grid_, "n", "g", 2, 2).first()
    assert (c.missing, c.repeated, c.complete) == (1, 0, False)
    assert sets.cross_product_check(grid_.unionByName(spark.createDataFrame([(2, 2)], "n int, g int")), "n", "g", 2, 2).first().complete
    assert sets.set_difference_counts(a.select("k"), a.select("k").distinct()).first().equal


def test_gates(spark):
    row = lambda sev, st: ("g", "c", sev, st, "", "", "")
    result = lambda *r: gates.outcome(gates.check_rows(spark, list(r))).first()
    assert result(row("BLOCKING", "PASS"), row("WARNING", "WARN"), row("INFO", "PASS")).outcome == "PASS_WITH_WARNINGS"
    assert result(*[row("BLOCKING", "FAIL")] * 3).failure_count == 3
    assert result(row("BLOCKING", "PASS")).outcome == "PASS"
    bins = spark.createDataFrame([(i,) for i in range(1, 23) if i not in (1, 3)], "q int")
    b = gates.bin_occupancy(bins, "q", 22).first()
    assert (b.active, b.missing, b.status) == (20, "1,3", "WARN") and b.share == pytest.approx(20 / 22)
    assert gates.bin_occupancy(bins.limit(4), "q", 22).first().status == "FAIL"
    found = {r.check: r.status for r in gates.checks_from(spark.createDataFrame([(1.0,), (2.5,)], "i double"), "g", gates.index_rules("i", 3)).collect()}
    assert found == {"whole": "FAIL", "from_one": "PASS", "no_gap": "FAIL"}
    accept = gates.acceptance(spark.createDataFrame([("PASS",), ("WARNING",)], "status string")).first().outcome
    assert accept == "PASS_WITH_NONBLOCKING_WARNINGS"


def test_walks_in_blocks_equal_a_dense_solve(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    for n, block in ((1, 4), (2, 4), (4, 4), (5, 4), (6, 4), (41, 4), (40, 8), (30, 1), (30, 2), (30, 3), (10, 100)):
        series = {k: [None if rng.random() < 0.3 else float(rng.normal()) for _ in range(n)] for k in "ab"}
        rows = [(k, i + 7, v) for k, vs in series.items() for i, v in enumerate(vs)]
        df = spark.createDataFrame(rows, "k string, i long, v double")
        got = {(r.k, r.i): r.smoothed for r in persistence.smooth_walks(df, ["k"], "i", "v", 10.0, block).collect()}
        for k, vs in series.items():
            step = np.diff(np.eye(n), axis=0) if n > 1 else np.zeros((0, n))
            a = np.diag([1e-9 + (v is not None) for v in vs]) + 10.0 * step.T @ step
            want = np.linalg.solve(a, [v or 0.0 for v in vs])
            assert np.allclose([got[k, i + 7] for i in range(n)], want, rtol=1e-6, atol=1e-9), (n, block)
