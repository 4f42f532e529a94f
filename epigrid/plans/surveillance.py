"""Whole runs: from records and grids to model tables, from posteriors to class areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeidx
from ..functions.places import Grid
from ..operators import cleaning, gates, grid, persistence, predictor, responses, tiers
from .config import configured


def demo_inputs(spark: SparkSession, cfg: dict, rows: int = 20, cols: int = 20, n: int = 400) -> dict:
    """Synthetic records, weekly and static covariates on a grid, and nodes, all from
    arithmetic on spark.range, so the same everywhere."""
    g = Grid(rows, cols, 0.0, float(cols), 0.0, float(rows))
    weeks = timeidx.week_index(spark, cfg["study"]["start"], cfg["study"]["end"])
    x, y = g.center("cell_id")
    cells = spark.range(1, rows * cols + 1).withColumnRenamed("id", "cell_id").withColumns({"x": x, "y": y})
    days = F.datediff(F.lit(cfg["study"]["end"]).cast("date"), F.lit(cfg["study"]["start"]).cast("date"))
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100_000)) / 100_000.0
    records = spark.range(n).select(
        F.col("id").alias("observation_id"), F.date_add(F.lit(cfg["study"]["start"]).cast("date"), F.floor(h(1) * (days + 20)).cast("int")).alias("day"), (h(2) * (cols + 1)).alias("x"), (h(3) * rows).alias("y"), F.when(h(4) < 0.3, "Bovino").when(h(4) < 0.6, "Canino").otherwise("Ovino-x").alias("host")
    )
    weekly = cells.crossJoin(F.broadcast(weeks)).select("cell_id", "epiyear", "epiweek", F.lit("mintemp").alias("variable"), (10 + F.col("y") / 2 + F.col("time_index") % 9).alias("value"))
    static = cells.select("cell_id", F.lit("cattle").alias("variable"), (F.col("cell_id") * 37 % 101).cast("double").alias("value"))
    nodes = cells.select(F.col("cell_id").alias("node"), "x", "y", F.lit(g.cell_area).alias("area"), (F.col("x") < cols - 1).alias("inside_domain"))
    return {"grid": g, "weeks": weeks, "cells": cells, "records": records, "weekly": weekly, "static": static, "nodes": nodes}


def prepare(inputs: dict, over: dict | None = None) -> dict[str, DataFrame]:
    """Clean records, both model tables, the prediction grid and the audits."""
    cfg = configured(over)
    g, weeks = inputs["grid"], inputs["weeks"]
    dated = timeidx.with_week(inputs["records"], "day")
    marked = cleaning.clean_weekly_observations(dated, weeks, inside=g.cell("x", "y").isNotNull())
    kept, excluded = cleaning.split_reasons(marked)
    kept = kept.withColumn("cell_id", g.cell("x", "y")).join(F.broadcast(weeks), ["epiyear", "epiweek"])
    tier1 = tiers.presence_background(kept, inputs["nodes"], weeks).withColumn("cell_id", g.cell("x", "y"))
    thinned = tiers.thin_presences(tier1, cfg["thinning"]["seed"], enabled=cfg["thinning"]["enabled"])
    tier1 = thinned.where("coalesce(thinning, 'kept') = 'kept'")
    areas = inputs["cells"].select(F.col("cell_id").alias("poly_id"))
    counts = tiers.area_week_counts(kept.withColumnRenamed("cell_id", "poly_id"), areas, weeks)
    covariates = inputs["weekly"].withColumnRenamed("cell_id", "poly_id")
    tier2 = grid.join_covariates(counts, covariates, ["poly_id", "epiyear", "epiweek"], ["mintemp"])
    tier2 = grid.join_covariates(tier2, inputs["static"].withColumnRenamed("cell_id", "poly_id"), ["poly_id"], ["cattle"])
    cut = cfg["censoring"]
    silent = responses.silent_areas(tier2, "poly_id", "count", cut["cutoff_year"], cut["cutoff_week"])
    tier2 = responses.censor(tier2, silent, "poly_id", "count", cut["cutoff_year"], cut["cutoff_week"])
    tier2 = tier2.withColumn("row_id", F.concat_ws("_", "poly_id", "time_index"))
    tier2 = responses.zero_policy(responses.holdout(tier2, cfg["holdout"]["fraction"], cfg["holdout"]["seed"], "row_id"), cfg["zero_count_policy"])
    tier2 = responses.apply_standardizers(tier2, responses.standardizers(tier2, ["mintemp"]))
    tier2 = responses.apply_breaks(tier2, "cattle", responses.quantile_breaks(inputs["static"].where("variable = 'cattle'").withColumnRenamed("value", "cattle"), "cattle", cfg["bins"]), "cattle")
    cells = inputs["cells"].withColumns({"value": F.lit(1.0), "inside": F.lit(True)})
    return {
        "tier1": tier1, "tier2": tier2, "prediction_grid": tiers.prediction_grid(cells, weeks), "excluded": excluded, "observations": kept,
        "exclusion_audit": cleaning.exclusion_audit(marked, cleaning.WEEK_REASONS), "thinning_audit": tiers.thinning_audit(thinned), "conservation": tiers.conservation(kept, thinned, counts),
    }


def postfit(inputs: dict, prepared: dict[str, DataFrame], fixed: dict[str, float], effects: DataFrame, over: dict | None = None) -> dict[str, DataFrame]:
    """Predictions for every cell and week from posterior means, the temperature mask, the
    threshold at the observations, runs, classes, areas and a gate. effects: (index, mean)
    of the weeks."""
    cfg, g = configured(over), inputs["grid"]
    spec = responses.standardizers(inputs["weekly"].where("variable = 'mintemp'").withColumnRenamed("value", "mintemp"), ["mintemp"])
    rows = grid.join_covariates(prepared["prediction_grid"], inputs["weekly"], ["cell_id", "epiyear", "epiweek"], ["mintemp"])
    rows = responses.apply_standardizers(rows, spec)
    rows = rows.withColumns({"fixed1": predictor.fixed_contribution(fixed, {}, ["intercept1"]), "fixed2": predictor.fixed_contribution(fixed, {"mintemp": "mintemp_z"}, ["intercept2", "mintemp"])})
    rows = predictor.random_effect(rows, effects, "time_index", "week_effect", unseen="zero")
    predicted = predictor.assemble(rows, ["fixed1", "week_effect"], ["fixed2", "week_effect"])
    abundance = persistence.apply_mask(persistence.potential_abundance(predicted, "tier2_intensity_plugin", g.cell_area), "abundance", "mintemp", cfg["mask"]["temperature"])
    stack = abundance.select("cell_id", "epiyear", "epiweek", "time_index", F.col("masked").alias("value"))
    found = persistence.dynamic_threshold(prepared["observations"].select("cell_id", "epiyear", "epiweek"), stack.drop("time_index"), ["epiyear", "epiweek"], cfg["persistence"]["quantile"])
    threshold = found.first()["threshold"]
    runs = persistence.longest_run(stack, threshold if threshold is not None else float("inf"), ["time_index"])
    classes = persistence.persistence(runs, cfg["persistence"]["days_per_layer"], cfg["persistence"]["generation_days"])
    one, _ = predictor.output_checks(predicted, ["epiyear", "epiweek"])
    gate = gates.outcome(one.select(F.lit("postfit").alias("gate"), "check", F.lit("BLOCKING").alias("severity"), F.when(F.col("failures") == 0, "PASS").otherwise("FAIL").alias("status")))
    return {"predictions": predicted, "stack": stack, "threshold": found, "classes": classes, "areas": persistence.class_areas(classes, g.cell_area), "mask_audit": persistence.mask_audit(abundance, ["epiyear", "epiweek"], "abundance"), "gate": gate}
