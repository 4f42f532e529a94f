"""The two model tables and the prediction grid: presence with background, counts, cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.places import Grid
from .sets import crossing, union_filled

SMALL_WEIGHT = 0.0001  # the exposure of presences, and of nodes outside the domain


def presence_background(observations: DataFrame, nodes: DataFrame, weeks: DataFrame) -> DataFrame:
    """Presences (Yi 1) and every node in every week (Yi 0), weighted by the node's area
    inside the domain. nodes: node, x, y, area, inside_domain."""
    seen = observations.select(
        F.concat(F.lit("obs_"), F.col("observation_id")).alias("row_id"), F.col("observation_id").alias("source_obs_id"), "x", "y", "epiyear", "epiweek", "time_index", F.lit(1).alias("Yi"), F.lit(SMALL_WEIGHT).alias("sc_Exp")
    )
    grid = crossing(nodes, weeks)
    background = grid.select(
        F.concat(F.lit("quad_"), "node", F.lit("_"), "time_index").alias("row_id"), "node", "x", "y", "epiyear", "epiweek", "time_index", F.lit(0).alias("Yi"), F.when(F.col("inside_domain"), F.col("area")).otherwise(F.lit(SMALL_WEIGHT)).alias("sc_Exp"), "inside_domain"
    )
    return union_filled(seen, background)


def area_week_counts(observations: DataFrame, areas: DataFrame, weeks: DataFrame, area: str = "poly_id") -> DataFrame:
    """Counts of every area in every week, 0 where nothing was seen. observations have
    area, epiyear, epiweek."""
    keys = [area, "epiyear", "epiweek"]
    counts = observations.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return crossing(areas, weeks).join(counts, keys, "left").withColumn("count", F.coalesce("count", F.lit(0)))


def conservation(observations: DataFrame, presence: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: observations, presences and counts, and whether all three agree."""
    one = observations.agg(F.count(F.lit(1)).alias("eligible")).crossJoin(F.broadcast(presence.agg(F.coalesce(F.sum("Yi"), F.lit(0)).alias("presences")))).crossJoin(F.broadcast(counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("counted"))))
    return one.withColumn("conserved", (F.col("eligible") == F.col("presences")) & (F.col("eligible") == F.col("counted")))


def prediction_grid(cells: DataFrame, weeks: DataFrame) -> DataFrame:
    """Cells with a template value, strictly inside, in every week. cells: cell_id, x, y,
    value, inside (nullable booleans count as false)."""
    valid = cells.where(F.col("value").isNotNull() & F.coalesce("inside", F.lit(False))).select("cell_id", "x", "y")
    grid = crossing(valid, weeks)
    return grid.withColumn("space_time_id", F.concat(F.lit("cell_"), "cell_id", F.lit("_time_"), "time_index"))


def selection_rank(df: DataFrame, keys: list[str], seed, row_id: str, out: str = "selection_rank") -> DataFrame:
    """1, 2, ... within each key in an order fixed by the seed and the row's id alone."""
    digest = F.md5(F.concat(F.lit(str(seed)), F.lit("|"), F.col(row_id).cast("string")))
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(digest, row_id)))


def thin_presences(df: DataFrame, seed, keys: tuple = ("epiyear", "epiweek", "cell_id"), row_id: str = "row_id", response: str = "Yi", enabled: bool = True) -> DataFrame:
    """One presence a cell and week; presences without a cell go, all zeros stay. Adds
    thinning: kept, duplicate or outside (null for zeros)."""
    if not enabled:
        return df.withColumn("thinning", F.when(F.col(response) == 1, "kept"))
    one = F.coalesce(F.col(response), F.lit(0)) == 1
    ranked = selection_rank(df.withColumn("_one", one), ["_one", *keys], seed, row_id, "_rank")
    status = F.when(F.col("_one"), F.when(F.col(keys[-1]).isNull(), "outside").when(F.col("_rank") == 1, "kept").otherwise("duplicate"))
    return ranked.withColumn("thinning", status).drop("_one", "_rank")


def thinning_audit(marked: DataFrame) -> DataFrame:
    """One row of counts; presences in = kept + duplicate + outside."""
    n = lambda s: F.count(F.when(F.col("thinning") == s, 1)).alias(s)
    return marked.agg(F.count("thinning").alias("presences"), n("kept"), n("duplicate"), n("outside")).withColumn("balanced", F.col("presences") == F.col("kept") + F.col("duplicate") + F.col("outside"))


def occurrence_ranks(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def simulate_points(density: DataFrame, n: int, seed, power: float = 1.5, week: str = "time_index") -> DataFrame:
    """n points a week with cells drawn in proportion to value ** power: uniforms by hash
    against the cells' cumulative weight. density: week, cell_id, value."""
    weights = density.where("value > 0").withColumn("w", F.pow("value", F.lit(power)))
    order = Window.partitionBy(week).orderBy("cell_id")
    upper = F.sum("w").over(order) / F.sum("w").over(Window.partitionBy(week))
    spans = weights.select(week, "cell_id", upper.alias("upper")).withColumn("lower", F.coalesce(F.lag("upper").over(order), F.lit(0.0)))
    spark = density.sparkSession
    draws = density.select(week).distinct().crossJoin(F.broadcast(spark.range(1, n + 1).withColumnRenamed("id", "point")))
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(week).cast("string"), F.col("point").cast("string"))), 1, 8), 16, 10).cast("double")
    draws = draws.withColumn("u", digest / 4294967296.0)
    # Both go to slices of the unit interval, so that a draw meets the few cells of its own.
    slices = 1024
    spans = spans.withColumn("slice", F.explode(F.sequence(F.floor(F.col("lower") * slices), F.floor(F.col("upper") * slices))))
    draws = draws.withColumn("slice", F.floor(F.col("u") * slices))
    return draws.join(spans, [week, "slice"]).where("u >= lower and u < upper").select(week, "point", "cell_id")


def cell_counts(points: DataFrame, grid: Grid, x: str = "x", y: str = "y") -> DataFrame:
    return points.withColumn("cell_id", grid.cell(x, y)).groupBy("cell_id").agg(F.count(F.lit(1)).alias("count"))
