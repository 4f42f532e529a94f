"""Linear predictors assembled from posterior summary tables, and their checks.

The fit itself is outside: fixed (term, mean), random (component, index, mean) and field
(component, node, group, mean) tables are the contract.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import finite
from ..functions.numbers import inverse_logit
from .sets import dealt


def joint_stack(tier1: DataFrame, tier2: DataFrame, response1: str, response2: str, exposure: str, row_id: str = "row_id") -> DataFrame:
    """(tier, source_row, link, y1, y2, exposure): one row a response, presence rows with link
    1 and no exposure, count rows with link 2."""
    a = tier1.select(F.lit("tier1").alias("tier"), F.col(row_id).alias("source_row"), F.lit(1).alias("link"), F.col(response1).cast("double").alias("y1"), F.lit(None).cast("double").alias("y2"), F.lit(None).cast("double").alias("exposure"))
    b = tier2.select(F.lit("tier2").alias("tier"), F.col(row_id).alias("source_row"), F.lit(2).alias("link"), F.lit(None).cast("double").alias("y1"), F.col(response2).cast("double").alias("y2"), F.col(exposure).cast("double").alias("exposure"))
    return a.unionByName(b)


def stack_checks(stack: DataFrame) -> DataFrame:
    """(check, failures) of the stack's contract."""
    one = stack.agg(
        F.count(F.when(F.col("y1").isNotNull() & F.col("y2").isNotNull(), 1)).alias("one_response_at_most"), F.count(F.when((F.col("tier") == "tier1") & (F.col("link") != 1), 1)).alias("tier1_link"), F.count(F.when((F.col("tier") == "tier2") & (F.col("link") != 2), 1)).alias("tier2_link"),
        F.count(F.when((F.col("tier") == "tier2") & ~F.coalesce(F.col("exposure") > 0, F.lit(False)), 1)).alias("tier2_exposure"), F.count(F.when(F.col("y1").isNotNull() & ~F.col("y1").isin(0.0, 1.0), 1)).alias("binary_response"), F.count(F.when(F.col("y2") < 0, 1)).alias("count_response"),
    )
    return one.unpivot([], one.columns, "check", "failures")


def row_map(stack: DataFrame, fitted: DataFrame) -> DataFrame:
    """Fitted rows (stack_row, mean) beside the stack rows they belong to."""
    return stack.join(fitted, "stack_row", "left")


def predictor_layout(fitted: DataFrame, observed: DataFrame, n_latent: int) -> DataFrame:
    """One row: rows of the observed block (the stack's), of the latent one behind it, of
    both, and whether the fitted table (stack_row from 1) has just those."""
    n = observed.agg(F.count(F.lit(1)).alias("n_observed"))
    # Rows are dealt before equal ones are put together, so that no task holds more than its share of distinct ones.
    places = dealt(fitted.select("stack_row"), "stack_row", rows=500_000, count=observed.count() + n_latent).groupBy("stack_row").agg(F.count(F.lit(1)).alias("_c"))
    have = places.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n_total"), F.count("stack_row").alias("_distinct"), F.min("stack_row").alias("_first"), F.max("stack_row").alias("_last"))
    out = n.crossJoin(F.broadcast(have)).withColumn("n_latent", F.lit(n_latent).cast("long"))
    whole = (F.col("n_total") == F.col("n_observed") + F.col("n_latent")) & (F.col("_distinct") == F.col("n_total")) & (F.col("_first") == 1) & (F.col("_last") == F.col("n_total"))
    return out.select("n_observed", "n_latent", "n_total", whole.alias("reconciled"))


def fitted_blocks(fitted: DataFrame, n_observed: int) -> DataFrame:
    """fitted with its block (APredictor for the observed rows, Predictor for the latent ones)
    and its place in the block."""
    first = F.col("stack_row") <= n_observed
    return fitted.withColumns({"predictor_block": F.when(first, "APredictor").otherwise("Predictor"), "output_index": F.when(first, F.col("stack_row")).otherwise(F.col("stack_row") - n_observed)})


def fixed_contribution(fixed: dict[str, float], columns: dict[str, str], terms: list[str]) -> Column:
    """Sum of coefficient times column over the stated terms of a tier; a term "a:b" is the
    product of two columns. Terms are listed a tier, never inferred from what is present."""
    parts = []
    for term in terms:
        product = reduce(lambda a, b: a * b, [F.col(columns[p]) for p in term.split(":")]) if term in columns or ":" in term else F.lit(1.0)
        parts.append(F.lit(float(fixed[term])) * (F.col(columns[term]) if term in columns else product))
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def random_effect(df: DataFrame, effects: DataFrame, index: str, out: str, unseen: str = "error", weight: Column | None = None) -> DataFrame:
    """df with the mean of its level (effects: index, mean), times a weight if given.

    unseen: "error" raises for a level without effect, "zero" gives 0 and flags the row in
    out_unseen. Levels are few (weeks, areas, bins), Spark broadcasts them when small.
    """
    got = df.join(effects.select(F.col("index").alias("_i"), F.col("mean").alias("_m")), F.col(index) == F.col("_i"), "left")
    missing = F.col("_m").isNull()
    if unseen == "error" and got.where(missing).take(1):
        raise ValueError(f"{index} has levels without an effect")
    value = F.coalesce("_m", F.lit(0.0)) * (F.lit(1.0) if weight is None else weight)
    return got.withColumns({out: value, f"{out}_unseen": missing}).drop("_i", "_m")


def weights_per_bin(df: DataFrame, index: str, weight: str) -> DataFrame:
    """Bins with more than one weight (there must be none)."""
    return df.groupBy(index).agg(F.count_distinct(weight).alias("weights")).where("weights > 1")


def assemble(df: DataFrame, parts1: list[str], parts2: list[str], area: str | None = None) -> DataFrame:
    """eta1_mean, tier1_probability_plugin, eta2_mean, tier2_intensity_plugin and, with an
    area, expected_count_plugin."""
    total = lambda names: reduce(lambda a, b: a + b, [F.col(n) for n in names])
    out = df.withColumns({"eta1_mean": total(parts1), "eta2_mean": total(parts2)})
    out = out.withColumns({"tier1_probability_plugin": inverse_logit("eta1_mean"), "tier2_intensity_plugin": F.exp("eta2_mean")})
    return out if area is None else out.withColumn("expected_count_plugin", F.col("tier2_intensity_plugin") * F.col(area))


def structural(df: DataFrame, eta: str, spatial: list[str], out: str = "eta2_structural") -> DataFrame:
    """The predictor without its spatial terms."""
    return df.withColumn(out, reduce(lambda a, b: a - b, [F.col(s) for s in spatial], F.col(eta)))


def identity_check(df: DataFrame, whole: str, parts: list[str], rmse: float = 1e-8, most: float = 1e-6) -> DataFrame:
    e = F.col(whole) - reduce(lambda a, b: a + b, [F.col(p) for p in parts])
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.max(F.abs(e)).alias("max_abs")).withColumn("pass", (F.col("rmse") <= rmse) & (F.col("max_abs") <= most))


def output_checks(df: DataFrame, week: list[str], key: str = "space_time_id") -> tuple[DataFrame, DataFrame]:
    """(check, failures) over everything, and the same by week."""
    p, lam = F.col("tier1_probability_plugin"), F.col("tier2_intensity_plugin")
    checks = [
        F.count(F.when(~finite("eta1_mean"), 1)).alias("eta1_finite"), F.count(F.when(~finite("eta2_mean"), 1)).alias("eta2_finite"), F.count(F.when(~F.coalesce(p.between(0, 1), F.lit(False)), 1)).alias("probability_range"),
        F.count(F.when(~F.coalesce(lam > 0, F.lit(False)), 1)).alias("intensity_positive"), (F.count(F.lit(1)) - F.count_distinct(key)).alias("unique_ids"),
    ]
    one = df.agg(*checks)
    weekly = df.groupBy(*week).agg(*checks)
    return one.unpivot([], one.columns, "check", "failures"), weekly.unpivot(week, [c for c in weekly.columns if c not in week], "check", "failures")


def stratified_first_rows(df: DataFrame, strata: list[str], index: str, target: int) -> DataFrame:
    """The lowest row of every value of every stratum, then the lowest others up to target."""
    firsts = reduce(lambda a, b: a.unionByName(b), [df.groupBy(F.col(s).cast("string").alias("_v")).agg(F.min(index).alias(index)).select(index) for s in strata]).distinct()
    n = firsts.count()  # one row a level of a stratum
    rest = df.select(index).join(firsts, index, "left_anti").orderBy(index).limit(max(0, target - n))
    return df.join(firsts.unionByName(rest), index, "left_semi")


def criteria_by_family(local: DataFrame, totals: DataFrame, family: str, tolerance: float = 1e-6) -> DataFrame:
    """Local criteria (family, criterion, value) summed against global ones."""
    sums = local.where(finite("value")).groupBy("criterion").agg(F.sum("value").alias("local_sum"), F.count_distinct(family).alias("families"))
    out = sums.join(totals.select("criterion", F.col("value").alias("global")), "criterion")
    return out.withColumn("reconciled", F.abs(F.col("local_sum") - F.col("global")) <= tolerance)


def unseen_levels(df: DataFrame, cell: str, area: str, flag: str, week: list[str]) -> DataFrame:
    return df.where(F.col(flag)).groupBy(cell, area).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(*week).alias("weeks"))


def bin_support(df: DataFrame, index: str, response: str, midpoint: str) -> DataFrame:
    return df.groupBy(index).agg(F.count(F.lit(1)).alias("full"), F.count(response).alias("active"), F.count(F.when(F.col(response) > 0, 1)).alias("positive"), F.min(midpoint).alias("midpoint"))
