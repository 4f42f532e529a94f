"""Report tables: effects, hyperparameters, distributions and comparisons of variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.nulls import finite
from ..functions.numbers import weighted_quantiles

QUANTILES = {"q025": ("q025", "0.025quant"), "median": ("median", "0.5quant"), "q975": ("q975", "0.975quant")}


def named_quantiles(df: DataFrame) -> DataFrame:
    """Posterior quantile columns under one spelling, the first that is present."""
    out = df
    for name, spellings in QUANTILES.items():
        found = next((s for s in spellings if s in df.columns), None)
        if found is None:
            raise ValueError(f"no column for {name}")
        out = out.withColumn(name, F.col(f"`{found}`"))
    return out


def fixed_effects(df: DataFrame, tier1_terms: list[str]) -> DataFrame:
    """term, label, note, source, tier, mean, sd, quantiles, and whether 0 lies outside the interval."""
    q = named_quantiles(df)
    return q.select(
        "term", text.effect_label("term").alias("label"), text.effect_note("term").alias("note"), text.effect_source("term").alias("source"), F.when(F.col("term").isin(tier1_terms), "Tier 1").otherwise("Tier 2").alias("tier"), "mean", "sd", "q025", "median", "q975",
        ((F.col("q025") > 0) | (F.col("q975") < 0)).alias("excludes_zero"),
    )


def weighted_effects(effects: DataFrame, weights: DataFrame, key: str, weight: str) -> DataFrame:
    """Effects of bins times each bin's weight; bounds swap where it is negative."""
    q = named_quantiles(effects).join(weights.select(key, weight), key)
    mean, low, high = weighted_quantiles("mean", "q025", "q975", weight)
    return q.select(key, mean.alias("mean"), low.alias("q025"), high.alias("q975"))


def temporal_effects(effects: DataFrame, weeks: DataFrame) -> DataFrame:
    """Weekly effects (index) with the week they belong to, unmatched ones null."""
    return named_quantiles(effects).join(weeks.select(F.col("time_index").alias("index"), "epiyear", "epiweek", text_label().alias("week")), "index", "left")


def text_label() -> Column:
    from ..functions.timeidx import week_label

    return week_label("epiyear", "epiweek")


def hyperparameters(df: DataFrame) -> DataFrame:
    h = text.hyperparameter("parameter")
    return df.withColumn("h", h).select(F.col("parameter").alias("source_name"), "h.component", F.col("h.parameter").alias("parameter"), "h.units", "h.scale", *[c for c in df.columns if c != "parameter"])


def model_summary(rows: DataFrame, weeks: DataFrame, effects: DataFrame, criteria: DataFrame) -> DataFrame:
    """(item, value) of a fitted model. rows: tier, is_test_point; weeks: a row a week with
    spatial_group; effects: section, term; criteria: criterion, value."""
    count = lambda c: F.count(F.when(c, 1)).cast("double")
    t = F.col("tier")
    one = rows.agg(*[count(t == k).alias(f"{k}_rows") for k in ("tier1", "tier2")], *[count((t == k) & F.coalesce("is_test_point", F.lit(False))).alias(f"{k}_holdouts") for k in ("tier1", "tier2")])
    two = weeks.agg(F.count(F.lit(1)).cast("double").alias("temporal_weeks"), F.count_distinct("spatial_group").cast("double").alias("spatial_groups"))
    three = effects.agg(count(F.col("section") == "fixed").alias("fixed_effects"), count(F.col("section") == "hyper").alias("hyperparameters"), F.count_distinct(F.when(~F.col("section").isin("fixed", "hyper"), F.col("section"))).cast("double").alias("random_components"))
    four = criteria.agg(*[F.max(F.when(F.col("criterion") == k, F.col("value"))).alias(k) for k in ("dic", "waic", "marginal_log_likelihood")])
    return reduce(lambda a, b: a.unionByName(b), [x.unpivot([], x.columns, "item", "value") for x in (one, two, three, four)])


def distribution_audit(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Counts, share of zeros, extremes, low quantiles, median and mean of finite values."""
    v = F.when(finite(value), F.col(value))
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows"), F.count(v).alias("finite"), F.count(F.when(v == 0, 1)).alias("zeros"), (F.count(F.when(v == 0, 1)) / F.nullif(F.count(v), F.lit(0))).alias("zero_share"), F.min(v).alias("min"),
        *[F.percentile(v, F.lit(p)).alias(n) for n, p in (("p01", 0.01), ("p05", 0.05), ("p10", 0.1), ("median", 0.5))], F.avg(v).alias("mean"), F.max(v).alias("max"),
    )


def class_front(classes: DataFrame, latitude: str, column: str = "rpi_class", top: int = 3, lines: tuple[float, ...] = (30.0, 35.0, 40.0)) -> DataFrame:
    """How far north the top class reaches: count, median, 95 %, maximum, cells beyond lines."""
    t = classes.where(F.col(column) == top)
    return t.agg(F.count(F.lit(1)).alias("cells"), F.percentile(latitude, F.lit(0.5)).alias("median"), F.percentile(latitude, F.lit(0.95)).alias("q95"), F.max(latitude).alias("max"), *[F.count(F.when(F.col(latitude) > x, 1)).alias(f"north_of_{x:g}") for x in lines])


def variant_counts(variants: dict[str, DataFrame], rules: dict[str, Column]) -> DataFrame:
    """(variant, rule, total, supported, share) of support tables under several rules, one
    pass a variant."""
    parts = []
    for name, df in variants.items():
        one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(F.when(c, 1)).alias(r) for r, c in rules.items()])
        parts.append(one.unpivot(["total"], list(rules), "rule", "supported").withColumn("variant", F.lit(name)))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.select("variant", "rule", "total", "supported", (F.col("supported") / F.nullif(F.col("total"), F.lit(0))).alias("share"))


def prediction_compatibility(df: DataFrame, required: list[str], group: str, groups: int) -> DataFrame:
    """(check, failures): columns that are missing, values not finite, groups out of range."""
    have = [c for c in required if c in df.columns]
    one = df.agg(F.lit(len(required) - len(have)).cast("long").alias("missing_columns"), F.count(F.when(~F.coalesce(F.col(group).between(1, groups), F.lit(False)), 1)).alias("group_range"), *[F.count(F.when(~finite(c), 1)).alias(f"finite_{c}") for c in have])
    return one.unpivot([], one.columns, "check", "failures")


def plans_agree(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float = 1e-10) -> DataFrame:
    """One row: the largest difference of two ways to compute the same rows, rows that only
    one has, and whether both are within the tolerance."""
    both = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key, "full")
    out = both.agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_abs"), F.count(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1)).alias("unmatched"))
    return out.withColumn("pass", (F.coalesce("max_abs", F.lit(0.0)) <= tolerance) & (F.col("unmatched") == 0))


def prefixed(df: DataFrame, columns: list[str], prefix: str = "source_") -> DataFrame:
    """df with copies of those of the columns that it has, under a prefix."""
    return df.withColumns({prefix + c: F.col(c) for c in columns if c in df.columns})


def with_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """df with alias columns (alias: column) for those columns that it has."""
    return df.withColumns({a: F.col(c) for a, c in aliases.items() if c in df.columns})
