"""Filters with a reason: every row that goes is kept apart, with why."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.nulls import finite, holds, require_columns
from .sets import small


def mark_reasons(df: DataFrame, rules: list[tuple[str, object]], duplicate: tuple[str, list, str] | None = None, out: str = "exclusion_reason") -> DataFrame:
    """df with the first reason whose condition holds, null for rows that stay.

    rules: (reason, condition) in order; a null condition does not hold. duplicate:
    (reason, key columns, order column) then marks all but the first of the rows that
    passed the rules and share a key.
    """
    reason = F
    for name, condition in rules:
        reason = reason.when(holds(condition), name)
    df = df.withColumn(out, reason.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string"))
    if duplicate is None:
        return df
    name, keys, order = duplicate
    # Rows already excluded rank apart, by their reason, so they shadow no row that stays.
    place = F.row_number().over(Window.partitionBy(*keys, F.col(out).isNull()).orderBy(order))
    return df.withColumn("_place", place).withColumn(out, F.when(F.col(out).isNull() & (F.col("_place") > 1), name).otherwise(F.col(out))).drop("_place")


def split_reasons(marked: DataFrame, out: str = "exclusion_reason") -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that go)."""
    return marked.where(F.col(out).isNull()).drop(out), marked.where(F.col(out).isNotNull())


def exclusion_audit(marked: DataFrame, reasons: list[str], out: str = "exclusion_reason") -> DataFrame:
    """(stage, count): input, each reason in order (0 if none), retained."""
    spark = marked.sparkSession
    stages = ["input", *reasons, "retained"]
    order = spark.createDataFrame(list(enumerate(stages)), "position int, stage string")
    one = marked.groupBy(F.coalesce(F.col(out), F.lit("retained")).alias("stage")).count()
    counts = one.unionByName(one.agg(F.sum("count").alias("count")).select(F.lit("input").alias("stage"), "count"))
    return order.join(F.broadcast(counts), "stage", "left").select("position", "stage", F.coalesce("count", F.lit(0)).alias("count"))


RAW_REASONS = ["missing_date", "invalid_date", "outside_study_period", "invalid_coordinates", "outside_spatial_domain", "exact_date_location_duplicate"]
WEEK_REASONS = ["invalid_year_week", "outside_study_period", "invalid_coordinates", "outside_spatial_domain", "exact_point_week_duplicate"]


def clean_observations(df: DataFrame, start: str, end: str, inside=None, raw_date: str = "date", date: str = "parsed_date", lon: str = "lon", lat: str = "lat", order: str = "observation_id") -> DataFrame:
    """Dated point records with the reason for which each goes (dates already parsed)."""
    domain = F.lit(False) if inside is None else ~F.coalesce(inside, F.lit(False))
    rules = [
        ("missing_date", F.col(raw_date).isNull()),
        ("invalid_date", F.col(date).isNull()),
        ("outside_study_period", ~F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))),
        ("invalid_coordinates", ~(finite(lon) & finite(lat) & F.col(lon).between(-180, 180) & F.col(lat).between(-90, 90))),
        ("outside_spatial_domain", domain),
    ]
    key = [F.col(date), text.significant(lon), text.significant(lat)]
    return mark_reasons(df, rules, ("exact_date_location_duplicate", key, order))


def clean_weekly_observations(df: DataFrame, weeks: DataFrame, inside=None, year: str = "epiyear", week: str = "epiweek", x: str = "x", y: str = "y", order: str = "observation_id") -> DataFrame:
    """Records dated by week, with the reason for which each goes; weeks is the study's
    week index (few rows)."""
    known = weeks.select(F.col("epiyear").alias("_y"), F.col("epiweek").alias("_w")).distinct()
    df = df.join(small(known), (F.col(year) == F.col("_y")) & (F.col(week) == F.col("_w")), "left")
    domain = F.lit(False) if inside is None else ~F.coalesce(inside, F.lit(False))
    rules = [
        ("invalid_year_week", ~holds((F.col(year) > 0) & F.col(week).between(1, 53))),
        ("outside_study_period", F.col("_y").isNull()),
        ("invalid_coordinates", ~(finite(x) & finite(y))),
        ("outside_spatial_domain", domain),
    ]
    key = [F.col(year), F.col(week), text.significant(x), text.significant(y)]
    return mark_reasons(df, rules, ("exact_point_week_duplicate", key, order)).drop("_y", "_w")


def trim_incomplete_week(df: DataFrame, date: str, complete: DataFrame, out: str = "exclusion_reason") -> DataFrame:
    """Marks rows after the end of the last complete week (one row, ``last_complete_week``)."""
    df = df.crossJoin(F.broadcast(complete.select("week_end")))
    late = F.to_date(date) > F.col("week_end")
    return df.withColumn(out, F.when(late, "after_auto_last_complete_observation_week")).drop("week_end")


def with_hosts(df: DataFrame, lookup: DataFrame, host: str = "host") -> DataFrame:
    """host_cleaned, host_standardized, host_group, multiple_host_flag: by the lookup's
    (unique) cleaned name, else by the fixed classes, else "unknown"."""
    require_columns(lookup, ["host_cleaned", "host_standardized", "host_group", "multiple_host_flag"], "host lookup")
    df = df.withColumn("host_cleaned", text.clean_host(host)).join(small(lookup), "host_cleaned", "left")
    missing, by_class = F.col("host_standardized").isNull(), text.host_class("host_cleaned").otherwise(F.lit(None))
    group = F.when(missing & by_class.isNotNull(), text.host_group(by_class)).otherwise(F.col("host_group"))
    several = F.when(missing, text.multiple_hosts("host_cleaned")).otherwise(F.col("multiple_host_flag"))
    return df.withColumns({"host_group": F.coalesce(group, F.lit("unknown")), "multiple_host_flag": several, "host_standardized": F.coalesce("host_standardized", by_class, F.lit("unknown"))})


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def apply_missing_policy(df: DataFrame, columns: list[str], policy: str) -> DataFrame:
    """complete_case drops rows with a missing value, fail raises on one, keep keeps."""
    if policy == "complete_case":
        return df.dropna(subset=columns)
    if policy == "fail" and df.where(" or ".join(f"`{c}` is null" for c in columns)).take(1):
        raise ValueError(f"missing values in {columns}")
    return df


def source_origin(df: DataFrame, row_id: str = ".row_id", out: str = "origin") -> DataFrame:
    """occurrence, quadrature or unclassified, by response, source and row id."""
    r = F.col(f"`{row_id}`")
    occurrence = (F.col("Yi") == 1) & F.col("source_obs_id").isNotNull() & r.rlike("^obs_")
    quadrature = (F.col("Yi") == 0) & F.col("source_obs_id").isNull() & r.rlike("^quad_")
    return df.withColumn(out, F.when(occurrence, "occurrence").when(quadrature, "quadrature").otherwise("unclassified"))


def reference_background(df: DataFrame, weight: str = "sc_Exp", prediction: str = "prediction") -> DataFrame:
    """Quadrature rows inside the domain, uncensored, with weight and a finite prediction."""
    ok = (F.col("origin") == "quadrature") & F.col("inside_domain") & ~F.coalesce("is_censored", F.lit(False)) & (F.col(weight) > 0)
    return df.where(holds(ok) & finite(prediction))


def uncovered_weeks(background: DataFrame, weeks: DataFrame) -> DataFrame:
    return weeks.join(background, ["epiyear", "epiweek"], "left_anti")


