"""The gates' own checks, over tables: what a prepared model table, a finished fit, an
extraction, a validation and a report must hold. Every function makes one pass over each
table it is given and returns check rows (see ``gates.check_rows``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import finite
from .gates import checks_from

#: What the accepted production fit is made of.
FAMILIES = ["binomial", "nbinomial"]
COMPONENTS = ["tier1_field", "tier2_field", "tier2_copy_field", "week_steps", "tier2_week", "admin_f", "cattle_q"]
EXPECTED = {"fixed": 16, "hyper": 10, "random": 7, "admin_levels": 340, "admin_fitted": 319, "cattle_bins": 22}
DONE = ["success", "completed", "ok"]


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def failing(condition: Column) -> Column:
    """Rows for which a condition does not hold; null counts as not holding."""
    return F.count(F.when(~F.coalesce(condition, F.lit(False)), 1))


def differs(a: Column, b) -> Column:
    """0 where two aggregates are equal, else 1."""
    return F.when(a.eqNullSafe(b if isinstance(b, Column) else F.lit(b)), 0).otherwise(1)


def lineage_gate(files: DataFrame, gate: str) -> DataFrame:
    """files: artifact, parent, exists, recorded_parent, recorded_sha256, sha256 (of the parent).
    Every artifact is there, names its parent and has that parent's hash."""
    inner = F.col("parent").isNotNull()
    return checks_from(files, gate, [
        ("artifacts_readable", "BLOCKING", failing(F.col("exists")), "every artifact of the run is there"),
        ("parents_named", "BLOCKING", F.count(F.when(inner & ~F.coalesce(F.col("recorded_parent") == F.col("parent"), F.lit(False)), 1)), "an artifact records the one it was made from"),
        ("parents_hashed", "BLOCKING", F.count(F.when(inner & ~F.coalesce(F.col("recorded_sha256") == F.col("sha256"), F.lit(False)), 1)), "and its hash"),
    ])


def prepare_gate(grid: DataFrame, weeks: int, cells: int, groups: dict[str, int], required: list[str]) -> DataFrame:
    """The prediction grid before a fit: all weeks, cells and rows, group levels from 1
    without gaps, required columns there and finite. ``groups``: level column to its count."""
    have = [c for c in required if c in grid.columns]
    rules = [
        ("dynamic_horizon", "BLOCKING", differs(F.count_distinct("epiyear", "epiweek"), weeks), "the grid has the modelled weeks"),
        ("supported_cells", "BLOCKING", differs(F.count_distinct("cell_id"), cells), "and the supported cells"),
        ("dynamic_dimensions", "BLOCKING", differs(F.count(F.lit(1)), weeks * cells), "each cell once in each week"),
        ("required_columns", "BLOCKING", F.lit(len(required) - len(have)), "required columns are there"),
        ("model_covariates_finite", "BLOCKING", F.count(F.when(~reduce(lambda a, b: a & b, [finite(c) for c in have], F.lit(True)), 1)), "required columns are finite"),
    ]
    for c, n in groups.items():
        whole = F.col(c).isNotNull() & (F.col(c) == F.floor(F.col(c))) & F.col(c).between(1, n)
        rules.append((f"group_{c}", "BLOCKING", failing(whole) + F.lit(n) - F.count_distinct(F.when(whole, F.col(c))), f"levels of {c} run from 1 to {n}"))
    return checks_from(grid, "prepare", rules)


def _beside(a: DataFrame, b: DataFrame, by: list[str] | None) -> DataFrame:
    """Two tables of one row, or of one row a run, as one."""
    return a.join(b, by) if by else a.crossJoin(F.broadcast(b))


def fit_health(run: DataFrame, summaries: DataFrame, criteria: DataFrame, components: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """A finished fit. run: one row with families (array), status, ok, configured and recorded
    initialization, theta_ok, n_observed, n_latent, n_total, stack_rows, warnings. summaries:
    section (fixed, hyper or a component), mean, sd, q025, q975. criteria: criterion,
    requested, value. by: columns that name the run, for many runs at once."""
    components = components or COMPONENTS
    previous = F.col("recorded") == "previous_theta"
    bad = lambda c: F.count(F.when(~F.coalesce(c, F.lit(False)), 1))
    one = checks_from(run, "fit_health", [
        ("likelihood_families", "BLOCKING", bad(F.col("families") == F.array(*[F.lit(f) for f in FAMILIES])), "a binomial and a negative binomial likelihood"),
        ("fit_completion_status", "BLOCKING", bad(F.lower("status").isin(DONE)), "the runner recorded success"),
        ("fit_internal_ok", "BLOCKING", bad(F.col("ok")), "the fit calls itself ok"),
        ("initialization_provenance", "WARNING", bad(F.col("configured") == F.col("recorded")), "configured and recorded initialization agree"),
        ("theta_initialization_provenance", "WARNING", F.count(F.when(previous & ~F.coalesce(F.col("theta_ok"), F.lit(False)), 1)), "an earlier theta is complete, in order and compatible"),
        ("joint_stack_structure", "BLOCKING", bad(F.col("stack_rows") == F.col("n_observed")), "the stack has the observed rows"),
        ("predictor_layout", "BLOCKING", bad(F.col("n_observed") + F.col("n_latent") == F.col("n_total")), "observed and latent blocks add up"),
        ("fit_warnings_recorded", "WARNING", F.coalesce(F.sum("warnings"), F.lit(0)), "the fit gave no warnings"),
    ], by)
    numbers = finite("mean") & (F.col("sd").isNull() | finite("sd")) & (F.col("q025").isNull() | finite("q025")) & (F.col("q975").isNull() | finite("q975"))
    sections = ["fixed", "hyper", *components]
    rules = [("required_random_components", "BLOCKING", F.lit(len(components)) - F.count_distinct(F.when(F.col("section").isin(components), F.col("section"))), "all random components are summarized")]
    for s in sections:
        mine = F.col("section") == s
        rules.append((f"summary_{s}_finite", "BLOCKING", F.count(F.when(mine & ~numbers, 1)) + F.when(F.count(F.when(mine, 1)) == 0, 1).otherwise(0), f"summaries of {s} are there and finite"))
    wanted = F.coalesce(F.col("requested"), F.lit(False))
    more = [(f"{c}_finite", "WARNING", F.when(F.count(F.when((F.col("criterion") == c) & wanted & finite("value"), 1)) > 0, 0).otherwise(1), f"{c} was asked for and is finite") for c in ("dic", "waic", "marginal_log_likelihood")]
    return union(one, checks_from(summaries, "fit_health", rules, by), checks_from(criteria, "fit_health", more, by))


def extraction_audit(rows: DataFrame, source: DataFrame, counts: DataFrame, expected: dict[str, int] | None = None, by: list[str] | None = None) -> DataFrame:
    """Fitted values mapped to the stack. rows: tier, link, family_index, response_training,
    fitted_mean; source: tier, response_training, is_test_point (what went in); counts: name,
    n (of effects, levels and bins). Rows and responses of each tier must be those of the source. by: the columns that name a run."""
    tiers = (("tier1", 1), ("tier2", 2))
    runs, by = by, lambda c: F.count(F.when(c, 1))
    sums = lambda df: df.groupBy(*(runs or [])).agg(*[by((F.col("tier") == t)).alias(f"rows_{t}") for t, _ in tiers], *[by((F.col("tier") == t) & F.col("response_training").isNotNull()).alias(f"active_{t}") for t, _ in tiers])
    a = sums(rows)
    b = source.groupBy(*(runs or [])).agg(*[by((F.col("tier") == t)).alias(f"s_rows_{t}") for t, _ in tiers], *[by((F.col("tier") == t) & F.col("response_training").isNotNull()).alias(f"s_active_{t}") for t, _ in tiers], by(F.col("is_test_point") & F.col("response_training").isNotNull()).alias("leaks"))
    both = _beside(a, b, runs)
    any_ = lambda *c: F.max(reduce(lambda x, y: x + y, [F.when(i, 0).otherwise(1) for i in c]))
    first = checks_from(both, "extraction", [
        ("tier_row_counts", "BLOCKING", any_(*[F.col(f"rows_{t}") == F.col(f"s_rows_{t}") for t, _ in tiers]), "rows of both tiers are those of the source"),
        ("active_training_counts", "BLOCKING", any_(*[F.col(f"active_{t}") == F.col(f"s_active_{t}") for t, _ in tiers]), "and so are the responses trained on"),
        ("holdout_rows", "BLOCKING", F.max("leaks"), "no test point was trained on"),
    ], runs)
    second = checks_from(rows, "extraction", [
        ("likelihood_link_counts", "BLOCKING", failing(F.col("link") == F.col("family_index")), "a row's link is its likelihood's"),
        ("named_tier_indices", "BLOCKING", failing(reduce(lambda x, y: x | y, [(F.col("tier") == t) & (F.col("link") == k) for t, k in tiers])), "tiers have their links"),
        ("observed_fitted_values_finite", "BLOCKING", failing(finite("fitted_mean")), "fitted means are finite"),
        ("tier1_fitted_probability_range", "BLOCKING", by((F.col("link") == 1) & ~F.coalesce(F.col("fitted_mean").between(0, 1), F.lit(False))), "presence is a probability"),
        ("tier2_fitted_positive", "BLOCKING", by((F.col("link") == 2) & ~F.coalesce(F.col("fitted_mean") > 0, F.lit(False))), "intensity is positive"),
    ], runs)
    third = [(f"{k}_count", "BLOCKING", differs(F.max(F.when(F.col("name") == k, F.col("n"))), F.lit(v)), f"{v} of {k}") for k, v in (expected or EXPECTED).items()]
    return union(first, second, checks_from(counts, "extraction", third, runs))


def temporal_support(effects: DataFrame, weeks: DataFrame, components: tuple[str, ...] = ("week_steps", "tier2_week")) -> DataFrame:
    """effects: component, time_index; each component has every week once."""
    n = weeks.agg(F.count(F.lit(1)).alias("n"))
    levels = effects.join(weeks.select("time_index", F.lit(1).alias("known")), "time_index", "left").crossJoin(F.broadcast(n))
    rules = []
    for c in components:
        mine = F.col("component") == c
        once = F.count(F.when(mine & F.col("known").isNotNull(), 1)) - F.count_distinct(F.when(mine & F.col("known").isNotNull(), F.col("time_index")))
        rules.append((f"{c}_support", "BLOCKING", F.count(F.when(mine & F.col("known").isNull(), 1)) + once + F.max("n") - F.count_distinct(F.when(mine & F.col("known").isNotNull(), F.col("time_index"))), f"{c} has each week once"))
    return checks_from(levels, "extraction", rules)


def validation_audit(holdout: DataFrame, source: DataFrame, metrics: DataFrame, background: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Before metrics are believed. holdout: tier, is_test_point, response, family, percentile
    (tier 1); source: tier, is_test_point; metrics: metric, value; background: weight. The
    holdout is all test points, and nothing else; the background has positive weights."""
    tiers = ("tier1", "tier2")
    a = holdout.groupBy(*(by or [])).agg(*[F.count(F.when(F.col("tier") == t, 1)).alias(t) for t in tiers])
    b = source.where("is_test_point").groupBy(*(by or [])).agg(*[F.count(F.when(F.col("tier") == t, 1)).alias(f"s_{t}") for t in tiers])
    first = checks_from(_beside(a, b, by), "validation", [("stage2_holdout_counts", "BLOCKING", F.max(F.when((F.col("tier1") == F.col("s_tier1")) & (F.col("tier2") == F.col("s_tier2")), 0).otherwise(1)), "as many rows as test points")], by)
    family = F.when(F.col("tier") == "tier1", FAMILIES[0]).otherwise(FAMILIES[1])
    second = checks_from(holdout, "validation", [
        ("holdout_rows_are_test_points", "BLOCKING", failing(F.col("is_test_point")), "only test points"),
        ("holdout_response_finite", "BLOCKING", failing(finite("response")), "observed responses are finite"),
        ("family_labels", "BLOCKING", failing(F.col("family") == family), "families are the tiers' own"),
        ("same_week_percentile_coverage", "BLOCKING", F.count(F.when((F.col("tier") == "tier1") & ~finite("percentile"), 1)), "each presence has a percentile in its week"),
    ], by)
    third = checks_from(background, "validation", [
        ("background_terrestrial_support", "BLOCKING", F.when(F.count(F.lit(1)) > 0, 0).otherwise(1), "there is a background"),
        ("background_weighting", "BLOCKING", failing(finite("weight") & (F.col("weight") > 0)), "its weights are positive"),
    ], by)
    names = (("PB_AUC_area_weighted", "WARNING"), ("PB_AUC_unweighted", "WARNING"), ("continuous_boyce_area_weighted", "WARNING"), ("continuous_boyce_unweighted", "WARNING"), ("mae", "WARNING"), ("rmse", "WARNING"), ("pearson", "WARNING"), ("spearman", "WARNING"))
    fourth = checks_from(metrics, "validation", [(m, severity, F.when(F.count(F.when((F.col("metric") == m) & finite("value"), 1)) > 0, 0).otherwise(1), f"{m} is finite") for m, severity in names], by)
    return union(first, second, third, fourth)


def preflight(stack: DataFrame, indices: dict[str, int]) -> DataFrame:
    """The stack just before a fit: one response at most in a row, of its own kind, positive
    exposure, random-effect indices whole and within their levels. ``indices``: column to
    its number of levels. stack as ``predictor.joint_stack`` makes it, with those columns."""
    one, two = F.col("tier") == "tier1", F.col("tier") == "tier2"
    rules = [
        ("one_response", "BLOCKING", F.count(F.when(F.col("y1").isNotNull() & F.col("y2").isNotNull(), 1)), "one response at most in a row"),
        ("links", "BLOCKING", failing((one & (F.col("link") == 1)) | (two & (F.col("link") == 2))), "tiers have their links"),
        ("binary_response", "BLOCKING", F.count(F.when(F.col("y1").isNotNull() & ~F.col("y1").isin(0.0, 1.0), 1)), "presence is 0 or 1"),
        ("count_response", "BLOCKING", F.count(F.when((F.col("y2") < 0) | (F.col("y2") != F.floor("y2")), 1)), "counts are whole and not negative"),
        ("exposure", "BLOCKING", F.count(F.when(two & ~F.coalesce(finite("exposure") & (F.col("exposure") > 0), F.lit(False)), 1)), "counts have a positive exposure"),
        ("both_tiers", "BLOCKING", F.when((F.count(F.when(one, 1)) > 0) & (F.count(F.when(two, 1)) > 0), 0).otherwise(1), "both tiers have rows"),
        ("some_training", "BLOCKING", F.when(F.count("y1") + F.count("y2") > 0, 0).otherwise(1), "some responses are trained on"),
    ]
    for c, n in indices.items():
        i = F.col(c)
        rules.append((f"index_{c}", "BLOCKING", F.count(F.when(i.isNotNull() & ((i != F.floor(i)) | ~i.between(1, n)), 1)), f"{c} is whole and within 1 to {n}"))
        rules.append((f"levels_{c}", "WARNING", F.lit(n) - F.count_distinct(F.when(i.between(1, n), i)), f"all levels of {c} occur"))
    return checks_from(stack, "preflight", rules)


def input_preflight(records: DataFrame, weeks: DataFrame, covariates: DataFrame, mapped: Column, least_mapped: float = 0.9) -> DataFrame:
    """Raw inputs. records: epiyear, epiweek, x, y; weeks: the horizon; covariates: variable,
    epiyear, epiweek. Weeks without records or covariates, coordinates missing, exact
    repeats, and records whose host is not mapped."""
    base = checks_from(records, "inputs", [
        ("rows", "BLOCKING", F.when(F.count(F.lit(1)) > 0, 0).otherwise(1), "there are records"),
        ("coordinates", "BLOCKING", failing(finite("x") & finite("y")), "coordinates are finite"),
        ("repeats", "WARNING", F.count(F.lit(1)) - F.count_distinct("epiyear", "epiweek", "x", "y"), "no place twice in a week"),
        ("mapping_rate", "WARNING", F.when(F.avg(mapped.cast("double")) >= least_mapped, 0).otherwise(1), "most hosts are mapped"),
    ])
    empty = weeks.join(records.select("epiyear", "epiweek").distinct(), ["epiyear", "epiweek"], "left_anti")
    pairs = covariates.select("variable").distinct().crossJoin(F.broadcast(weeks.select("epiyear", "epiweek")))
    lacking = pairs.join(covariates.select("variable", "epiyear", "epiweek").distinct(), ["variable", "epiyear", "epiweek"], "left_anti")
    count = lambda df, name, severity, message: checks_from(df, "inputs", [(name, severity, F.count(F.lit(1)), message)])
    return union(base, count(empty, "weeks_with_records", "WARNING", "each week has records"), count(lacking, "weeks_with_covariates", "BLOCKING", "each variable has each week"))


#: The checks of a report, and what each asks of the table of products
#: (name, rows, expected_rows, faults): that it is there, whole, or without faults.
REPORT_CHECKS = {
    "reference_fit_available": ("fit", "there"), "stage2_provenance": ("stage2", "there"), "stage3a_provenance": ("stage3a", "there"), "host_csv_availability": ("hosts", "there"),
    "host_mapping_coverage": ("hosts", "faultless"), "denominator_reconciliation": ("host_assignments", "whole"), "denominator_label_accuracy": ("host_denominator", "whole"), "species_product": ("species_composition", "there"),
    "coefficient_tables": ("fixed_effects", "there"), "cattle_product": ("cattle_effect", "there"), "cattle_unit_provenance": ("cattle_units", "faultless"), "temporal_product": ("temporal_effects", "there"),
    "phase3_raster_access": ("weekly_maps", "there"), "map_generation": ("selected_weeks", "there"), "potential_abundance_conversion": ("potential_abundance", "whole"), "structural_product_horizon": ("structural", "whole"),
    "structural_masked_support": ("structural_masked", "faultless"), "rpi_observation_provenance": ("rpi_observations", "there"), "rpi_readiness": ("rpi_observations", "faultless"), "dynamic_rpi_threshold": ("rpi_threshold", "faultless"),
    "rpi_classification_support": ("rpi_classes", "whole"), "manifest_checksum_prerequisites": ("manifest", "faultless"),
}
#: Of those, the ones that only warn.
REPORT_WARNINGS = ["host_mapping_coverage", "denominator_reconciliation", "denominator_label_accuracy", "cattle_unit_provenance", "potential_abundance_conversion", "rpi_observation_provenance", "rpi_readiness", "manifest_checksum_prerequisites"]


def reporting_qa(products: DataFrame) -> DataFrame:
    """The 22 checks of a report, over its table of products (name, rows, expected_rows, faults)."""
    rules = []
    for check, (name, asks) in REPORT_CHECKS.items():
        mine = (F.col("name") == name) & (F.col("rows") > 0)
        good = {"there": mine, "whole": mine & F.col("rows").eqNullSafe(F.col("expected_rows")), "faultless": mine & (F.coalesce("faults", F.lit(0)) == 0)}[asks]
        rules.append((check, "WARNING" if check in REPORT_WARNINGS else "BLOCKING", F.when(F.count(F.when(good, 1)) > 0, 0).otherwise(1), f"{name} is {asks}"))
    return checks_from(products, "reporting", rules)


#: What the gate after a fit asks of the audits before it.
POSTFIT = ["extraction_completed", "holdout_alignment", "validation_predictions_finite", "projection_reconstruction", "projection_dimensions", "raster_mapping", "raster_reconciliation", "structural_reconstruction", "temperature_mask", "final_manifest", "dynamic_rpi_threshold", "rpi_class_support", "authoritative_coordinate_transform", "same_week_rpi_matching", "final_reporting_artifacts"]


def fit_gate(health: DataFrame) -> DataFrame:
    """The gate after a fit: no blocking failure in its health, and its warnings kept as such."""
    return checks_from(health, "fit", [
        ("fit_health_structure", "BLOCKING", F.count(F.when((F.col("severity") == "BLOCKING") & (F.col("status") == "FAIL"), 1)), "fit health has no failure"),
        ("historical_fit_diagnostics", "WARNING", F.count(F.when(F.col("status") == "WARN", 1)), "its warnings do not block"),
    ])


def postfit_gate(audits: DataFrame, unseen_rows: int = 0) -> DataFrame:
    """The gate before results leave: audits (check, rows, status) has a row without failure
    for each of POSTFIT. Levels without an effect that were given zero are a warning."""
    rules = [(c, "BLOCKING", F.when((F.count(F.when(F.col("check") == c, 1)) > 0) & (F.count(F.when((F.col("check") == c) & (F.col("status") == "FAIL"), 1)) == 0), 0).otherwise(1), f"{c} is audited and does not fail") for c in POSTFIT]
    rules.append(("unseen_administrative_support", "WARNING", F.lit(unseen_rows), "levels without an effect were given zero"))
    return checks_from(audits, "postfit", rules)


def output_audit(output: DataFrame, source: DataFrame, weeks: int, groups: int, key: str = "space_time_id") -> tuple[DataFrame, DataFrame]:
    """Projected rows against the grid they were made for: ten checks over everything, and
    (epiyear, epiweek, check, failures) for each week, with the weeks that only one side has."""
    p, lam, g = F.col("tier1_probability_plugin"), F.col("tier2_intensity_plugin"), F.col("spatial_group_index")
    ids = output.select(key, F.lit(1).alias("_o")).join(source.select(key, F.lit(1).alias("_s")), key, "full")
    sides = ids.agg(F.count("_o").alias("o"), F.count("_s").alias("s"), F.count(F.when(F.col("_o").isNull() | F.col("_s").isNull(), 1)).alias("apart"))
    n = source.agg(F.count(F.lit(1)).alias("_rows"))
    first = checks_from(output.crossJoin(F.broadcast(n)), "output", [
        ("row_count", "BLOCKING", F.abs(F.count(F.lit(1)) - F.max("_rows")), "as many rows as the grid"),
        ("week_count", "BLOCKING", F.abs(F.count_distinct("epiyear", "epiweek") - F.lit(weeks)), "all weeks"),
        ("global_duplicate_row_id", "BLOCKING", F.count(key) - F.count_distinct(key), "ids are unique"),
        ("finite_coordinates", "BLOCKING", failing(finite("x") & finite("y")), "coordinates are finite"),
        ("finite_eta1", "BLOCKING", failing(finite("eta1_mean")), "first predictors are finite"),
        ("finite_eta2", "BLOCKING", failing(finite("eta2_mean")), "second predictors are finite"),
        ("probability_range", "BLOCKING", failing(p.between(0, 1)), "probabilities are within 0 and 1"),
        ("intensity_positive", "BLOCKING", failing(lam > 0), "intensities are positive"),
        ("spatial_group_support", "BLOCKING", failing(g.between(1, groups)), "groups are those of the field"),
    ])
    keys = checks_from(sides, "output", [("stable_key_set", "BLOCKING", F.max("apart"), "the ids are the grid's")])
    week = ["epiyear", "epiweek"]
    mine = output.groupBy(*week).agg(
        F.count(F.lit(1)).alias("_n"), (F.count("cell_id") - F.count_distinct("cell_id")).alias("weekly_cell_id_unique"), (F.count(key) - F.count_distinct(key)).alias("weekly_row_id_unique"), failing(finite("x") & finite("y")).alias("weekly_coordinates_finite"),
        failing(finite("eta1_mean")).alias("weekly_eta1_finite"), failing(finite("eta2_mean")).alias("weekly_eta2_finite"),
    )
    theirs = source.groupBy(*week).agg(F.count(F.lit(1)).alias("_want"))
    both = mine.join(theirs, week, "full")
    both = both.withColumns({"weekly_row_count": F.abs(F.coalesce("_n", F.lit(0)) - F.coalesce("_want", F.lit(0))), "weekly_key_support": F.when(F.col("_n").isNull() | F.col("_want").isNull(), 1).otherwise(0).cast("long")})
    names = ["weekly_row_count", "weekly_cell_id_unique", "weekly_row_id_unique", "weekly_coordinates_finite", "weekly_eta1_finite", "weekly_eta2_finite", "weekly_key_support"]
    return union(first, keys), both.select(*week, *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in names]).unpivot(week, names, "check", "failures")
