"""Quality gates: checks as rows, and what they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import finite

CHECK = "gate string, check string, severity string, status string, message string, expected string, observed string"


def check_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(gate, check, severity, status, message, expected, observed)."""
    return spark.createDataFrame(rows, CHECK)


def checks_from(df: DataFrame, gate: str, rules: list[tuple[str, str, Column, str]], by: list[str] | None = None) -> DataFrame:
    """One check a rule (name, severity, aggregate that is 0 when all is well, message), all
    from one pass over df. by: the same for each of many runs; their columns come first, and
    a run without a row in df has no checks of it."""
    by = by or []
    one = df.groupBy(*by).agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, _, c, _ in rules])
    meta = F.create_map(*[x for n, s, _, m in rules for x in (F.lit(n), F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message")))])
    long = one.unpivot(by, [n for n, *_ in rules], "check", "n").withColumn("m", meta[F.col("check")])
    status = F.when(F.col("n") == 0, "PASS").when(F.col("m.severity") == "WARNING", "WARN").otherwise("FAIL")
    return long.select(*by, F.lit(gate).alias("gate"), "check", F.col("m.severity").alias("severity"), status.alias("status"), F.col("m.message").alias("message"), F.lit("0").alias("expected"), F.col("n").cast("string").alias("observed"))


def outcome(checks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """FAIL with any blocking failure, else PASS_WITH_WARNINGS with any warning, else PASS;
    with the counts of both."""
    failed, warned = (F.col("severity") == "BLOCKING") & (F.col("status") == "FAIL"), F.col("status") == "WARN"
    out = checks.groupBy(*(by or [])).agg(F.count(F.when(failed, 1)).alias("failure_count"), F.count(F.when(warned, 1)).alias("warning_count"), F.count(F.lit(1)).alias("checks"))
    return out.withColumn("outcome", F.when(F.col("failure_count") > 0, "FAIL").when(F.col("warning_count") > 0, "PASS_WITH_WARNINGS").otherwise("PASS"))


def acceptance(checks: DataFrame) -> DataFrame:
    fail, warn = F.count(F.when(F.col("status") == "FAIL", 1)), F.count(F.when(F.col("status") == "WARNING", 1))
    return checks.agg(F.when(fail > 0, "FAIL").when(warn > 0, "PASS_WITH_NONBLOCKING_WARNINGS").otherwise("PASS").alias("outcome"))


def inventory(checks: DataFrame) -> DataFrame:
    """The checks that gates define, from their own rows."""
    return checks.select("gate", "check", "severity").distinct()


def index_rules(index: str, most: int | None = None) -> list[tuple[str, str, Column, str]]:
    """Random-effect indices are whole numbers from 1, without gaps up to ``most``."""
    c = F.col(index)
    rules = [("whole", "BLOCKING", F.count(F.when(c.isNotNull() & (c != F.floor(c)), 1)), f"{index} has fractions"), ("from_one", "BLOCKING", F.count(F.when(c < 1, 1)), f"{index} is below 1")]
    if most is not None:
        rules.append(("no_gap", "BLOCKING", F.lit(most) - F.count_distinct(index), f"{index} misses levels"))
    return rules


def bin_occupancy(df: DataFrame, index: str, bins: int, least: int = 5) -> DataFrame:
    """One row: active bins, those missing, their share, and pass, warning or fail."""
    used = df.where(finite(index)).select(F.col(index).cast("int").alias("i")).distinct().agg(F.array_sort(F.collect_set("i")).alias("used"))
    missing = F.array_except(F.sequence(F.lit(1), F.lit(bins)), "used")
    out = used.select(F.size("used").alias("active"), F.array_join(missing, ",").alias("missing"), (F.size("used") / F.lit(bins)).alias("share"))
    return out.withColumn("status", F.when(F.col("active") < least, "FAIL").when(F.col("active") < bins, "WARN").otherwise("PASS"))


def coverage_rules(weeks_expected: int) -> list[tuple[str, str, Column, str]]:
    return [("weeks", "BLOCKING", F.lit(weeks_expected) - F.count_distinct("epiyear", "epiweek"), "weeks are missing"), ("coordinates", "BLOCKING", F.count(F.when(~finite("x") | ~finite("y"), 1)), "coordinates are missing")]


def mapping_rate(df: DataFrame, column: str, unknown: str = "unknown") -> DataFrame:
    return df.agg((F.count(F.when(F.col(column) != unknown, 1)) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("mapped_share"))
