"""Model responses: censoring, holdouts, zero policy, factors and bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import EPSILON, hinge, interval_bin, log1p_imputed, midpoints, zscore
from ..functions.timeidx import before_week
from .metrics import average_rank


def silent_areas(df: DataFrame, area: str, response: str, cutoff_year: int, cutoff_week: int) -> DataFrame:
    """Areas that reported before the cutoff week and never from there on."""
    before, seen = before_week("epiyear", "epiweek", cutoff_year, cutoff_week), F.col(response) > 0
    flags = df.groupBy(area).agg(F.coalesce(F.bool_or(before & seen), F.lit(False)).alias("_before"), F.coalesce(F.bool_or(~before & seen), F.lit(False)).alias("_after"))
    return flags.where("_before and not _after").select(area)


def censor(df: DataFrame, silent: DataFrame, area: str, response: str, cutoff_year: int, cutoff_week: int) -> DataFrame:
    """is_censored, and response_censored: null from the cutoff on in silent areas (few,
    one a unit; the join broadcasts them by itself when they are small)."""
    marked = df.join(silent.select(F.col(area).alias("_silent")), F.col(area) == F.col("_silent"), "left")
    late = F.col("_silent").isNotNull() & ~before_week("epiyear", "epiweek", cutoff_year, cutoff_week)
    return marked.withColumns({"is_censored": late, "response_censored": F.when(~late, F.col(response))}).drop("_silent")


def holdout(df: DataFrame, fraction: float, seed, stable_id: str, response: str = "response_censored", censored: str = "is_censored") -> DataFrame:
    """is_test_point for ceil(n * fraction) of the uncensored positive rows, the first in
    the order of a hash of seed and id; response_training is null there.

    Ranks come from the hash's leading two digits first (a window a prefix), then from
    those before it, so no task holds all rows.
    """
    eligible = F.coalesce(~F.col(censored) & (F.col(response) > 0), F.lit(False))
    digest = F.md5(F.concat(F.lit(str(seed)), F.lit("|"), F.col(stable_id).cast("string")))
    df = df.withColumns({"_e": eligible, "_d": digest}).withColumn("_p", F.substring("_d", 1, 2))
    counts = df.where("_e").groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # at most 256 rows
    ahead = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_ahead"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_all"))
    ranked = df.join(F.broadcast(ahead), "_p", "left").withColumn("_r", F.row_number().over(Window.partitionBy("_p", "_e").orderBy("_d", stable_id)))
    chosen = F.coalesce(F.col("_e") & (F.col("_r") + F.col("_ahead") <= F.ceil(F.col("_all") * F.lit(fraction))), F.lit(False))
    out = ranked.withColumn("is_test_point", chosen)
    return out.withColumn("response_training", F.when(~F.col("is_test_point"), F.col(response))).drop("_e", "_d", "_p", "_ahead", "_all", "_r")


def zero_policy(df: DataFrame, policy: str, response: str = "response_training") -> DataFrame:
    """exclude: zero responses become null, rows stay; retain: unchanged."""
    if policy == "exclude":
        return df.withColumn(response, F.when(F.col(response) != 0, F.col(response)))
    return df


def area_factor(*tables: DataFrame, area: str = "admin_u", unknown: str = "Unk") -> DataFrame:
    """(area, admin_f): the areas of all tables numbered from 1 in binary order, the
    unknown last; missing and empty names are unknown. Areas are few."""
    names = tables[0].select(area)
    for t in tables[1:]:
        names = names.unionByName(t.select(area))
    names = names.select(F.when(F.coalesce(F.col(area), F.lit("")) == "", unknown).otherwise(F.col(area)).alias(area)).distinct()
    return names.withColumn("admin_f", F.row_number().over(Window.orderBy(F.col(area) == unknown, area)))


def standardizers(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, center, scale): mean and sample deviation, the latter at least epsilon."""
    one = df.agg(*[F.struct(F.avg(c).alias("center"), F.greatest(F.coalesce(F.stddev_samp(c), F.lit(0.0)), F.lit(EPSILON)).alias("scale")).alias(c) for c in columns])
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*columns))).alias("variable", "s")).select("variable", "s.center", "s.scale")


def apply_standardizers(df: DataFrame, specs: DataFrame, suffix: str = "_z") -> DataFrame:
    """A z-score a variable of specs (one row each, read to the driver)."""
    return df.withColumns({r["variable"] + suffix: zscore(r["variable"], F.lit(r["center"]), F.lit(r["scale"])) for r in specs.collect()})


def apply_log1p(df: DataFrame, fills: dict[str, float], suffix: str = "_log1p") -> DataFrame:
    return df.withColumns({c + suffix: log1p_imputed(c, F.lit(v)) for c, v in fills.items()})


def apply_hinges(df: DataFrame, knots: dict[str, float], suffix: str = "_hinge") -> DataFrame:
    return df.withColumns({c + suffix: hinge(c, k) for c, k in knots.items()})


def northing(df: DataFrame, y: str = "y", offset: float = 25.0) -> DataFrame:
    """Distance from a line ``offset`` below the least y."""
    low = df.agg((F.min(y) - offset).alias("_origin"))
    return df.crossJoin(F.broadcast(low)).withColumn("northing", F.col(y) - F.col("_origin")).drop("_origin")


def rank_bins(df: DataFrame, column: str, bins: int, out: str = "bin") -> DataFrame:
    """Training bins: ceil(bins * average rank / n); ties share a bin."""
    ranked = average_rank(df, column, "_rank", count="_n")
    return ranked.withColumn(out, F.greatest(F.lit(1), F.ceil(F.col("_rank") * bins / F.col("_n") - 1e-12)).cast("int")).drop("_rank", "_n")


def quantile_breaks(df: DataFrame, column: str, bins: int) -> DataFrame:
    """One row: breaks (type-7 quantiles at 0, 1/bins, ..., 1) and their midpoints."""
    probs = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    return df.agg(F.percentile(column, probs).alias("breaks")).withColumn("midpoints", midpoints("breaks"))


def apply_breaks(df: DataFrame, column: str, breaks: DataFrame, prefix: str) -> DataFrame:
    """Prediction bins: the interval, its midpoint and log1p of that."""
    out = df.crossJoin(F.broadcast(breaks)).withColumn(f"{prefix}_q", interval_bin(column, "breaks"))
    out = out.withColumn(f"{prefix}_mid", F.element_at("midpoints", F.col(f"{prefix}_q")))
    return out.withColumn(f"{prefix}_mid_log1p", F.log1p(f"{prefix}_mid")).drop("breaks", "midpoints")


def group_audit(df: DataFrame, group: str) -> DataFrame:
    """One row: groups, least, greatest, and whether they are 1..G without a gap."""
    return df.agg(F.count_distinct(group).alias("groups"), F.min(group).alias("least"), F.max(group).alias("greatest")).withColumn("contiguous", (F.col("least") == 1) & (F.col("greatest") == F.col("groups")))
