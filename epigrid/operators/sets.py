"""Keys, sets and joins with checked cardinality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def assert_unique_keys(df: DataFrame, keys: list[str], label: str = "table") -> None:
    found = duplicate_keys(df, keys).limit(1).collect()
    if found:
        raise ValueError(f"{label}: duplicate key {found[0].asDict()}")


def left_join_checked(left: DataFrame, right: DataFrame, keys: list[str], suffix: str = "_right") -> DataFrame:
    """A left join that keeps left's rows one for one: right's keys must be unique, and
    its other columns that left has too get a suffix."""
    assert_unique_keys(right, keys, "right side")
    renamed = right.withColumnsRenamed({c: c + suffix for c in right.columns if c in left.columns and c not in keys})
    return left.join(renamed, keys, "left")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, order: list, default=None, must: bool = False) -> DataFrame:
    """df with ``value`` of the first row of table (in a stated order) that has its key;
    rows without one get the default, or are an error where they must not be."""
    first = table.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").select(key, value)
    out = df.join(first, key, "left")
    if must and out.where(F.col(value).isNull()).take(1):
        raise ValueError(f"no {value} for some {key}")
    return out if default is None else out.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def with_first_category(df: DataFrame, table: DataFrame, key: str, value: str, order: list) -> DataFrame:
    return lookup(df, table, key, value, order)


def full_comparison(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer join of two counts: a_value, b_value (missing: 0) and their difference."""
    x, y = a.select(*keys, F.col(value).alias("a_value")), b.select(*keys, F.col(value).alias("b_value"))
    out = x.join(y, keys, "full")
    out = out.withColumns({"a_value": F.coalesce("a_value", F.lit(0)), "b_value": F.coalesce("b_value", F.lit(0))})
    return out.withColumn("difference", F.col("a_value") - F.col("b_value"))


def summary_comparison(reference: DataFrame, production: DataFrame, key: str, value: str) -> DataFrame:
    """Inner join of two summaries with difference and ratio (null where the base is 0)."""
    a, b = reference.select(key, F.col(value).alias("reference")), production.select(key, F.col(value).alias("production"))
    return a.join(b, key).select(key, "reference", "production", (F.col("production") - F.col("reference")).alias("difference"), (F.col("production") / F.nullif(F.col("reference"), F.lit(0))).alias("ratio"))


def set_difference_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows of each set the other lacks, and whether the sets are equal."""
    missing = a.subtract(b).agg(F.count(F.lit(1)).alias("only_left")).crossJoin(F.broadcast(b.subtract(a).agg(F.count(F.lit(1)).alias("only_right"))))
    return missing.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows that both have."""
    return a.intersect(b)


def subset_violations(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    return inner.join(outer, keys, "left_anti")


def cross_product_check(df: DataFrame, left: str, right: str, n_left: int, n_right: int) -> DataFrame:
    """One row: rows, missing and repeated pairs of a table meant to have each of
    1..n_left with each of 1..n_right (the fewer: groups, weeks) once."""
    spark = df.sparkSession
    want = spark.range(1, n_left + 1).select(F.col("id").alias(left)).crossJoin(F.broadcast(spark.range(1, n_right + 1).select(F.col("id").alias(right))))
    counts = df.groupBy(left, right).count()
    return want.join(counts, [left, right], "full").agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.count(F.when(F.col("count").isNull(), 1)).alias("missing"), F.count(F.when(F.col("count") > 1, 1)).alias("repeated"),
        F.count(F.when(~F.col(left).between(1, n_left) | ~F.col(right).between(1, n_right), 1)).alias("unexpected"),
    ).withColumn("complete", (F.col("missing") == 0) & (F.col("repeated") == 0) & (F.col("unexpected") == 0))


#: Rows of a table that is broadcast; larger ones are left to Spark to join.
FEW = 200_000


def small(df: DataFrame) -> DataFrame:
    """df, marked to be broadcast if it has at most FEW rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def by_key(df: DataFrame) -> DataFrame:
    """df, marked to be joined by sorting: Spark judges its size by packed bytes, and a few megabytes of
    running numbers and repeated texts are millions of rows, which would pass through the driver."""
    return df.hint("merge")


#: Rows of a task where a row costs more time or memory than its bytes show.
DEALT = 50_000


def dealt(df: DataFrame, *keys: str, rows: int = DEALT, count: int | None = None) -> DataFrame:
    """df over so many tasks that each has about ``rows`` rows, and no fewer than run at once: a small file
    of many rows is read by one task, and Spark puts tasks together by bytes. count: df's rows, where they are known."""
    spark = df.sparkSession
    most, need = spark.sparkContext.defaultParallelism, -(-(df.count() if count is None else count) // rows)
    # With fewer tasks than its own number Spark would shuffle again for a join.
    return df.repartition(max(need, int(spark.conf.get("spark.sql.shuffle.partitions"))) if need > most else most, *keys)


def crossing(*tables: DataFrame) -> DataFrame:
    """Every combination of the distinct rows; all but the first table are meant to be small
    (weeks, variants), and broadcast when they are."""
    out = tables[0].distinct()
    for t in tables[1:]:
        out = out.crossJoin(small(t.distinct()))
    return out


def union_filled(*tables: DataFrame) -> DataFrame:
    """Rows of all tables; columns that one lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
