"""Gridded values: extraction at points, fallbacks, weekly pairs, and checks.

A raster is a long table (cell_id, value) with a ``Grid``; a stack adds epiyear, epiweek.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import clean, finite
from ..functions.numbers import distance_bin
from ..functions.places import Grid


def bilinear(points: DataFrame, values: DataFrame, grid: Grid, keys: list[str], x: str = "x", y: str = "y", out: str = "value", by: list[str] | None = None) -> DataFrame:
    """points with the value interpolated between the four nearest cell centres; null where
    one of them with weight has no value or lies outside. keys identify a point; by joins
    further columns (the week, the variable)."""
    by = by or []
    column, row = (F.col(x) - grid.xmin) / grid.width - 0.5, (grid.ymax - F.col(y)) / grid.height - 0.5
    c0, r0 = F.floor(column), F.floor(row)
    corner = lambda dr, dc: F.struct((r0 + dr).alias("r"), (c0 + dc).alias("c"), ((1 - F.abs(row - r0 - dr)) * (1 - F.abs(column - c0 - dc))).alias("w"))
    four = points.select(*keys, *[b for b in by if b not in keys], F.explode(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))).alias("_k")).where("_k.w > 0")
    inside = F.col("_k.r").between(0, grid.rows - 1) & F.col("_k.c").between(0, grid.cols - 1)
    four = four.withColumn("cell_id", F.when(inside, F.col("_k.r") * grid.cols + F.col("_k.c") + 1).cast("long"))
    got = four.join(values.select(*by, "cell_id", clean("value").alias("_v")), [*by, "cell_id"], "left")
    sums = got.groupBy(*keys, *[b for b in by if b not in keys]).agg(F.when(F.count("_v") == F.count(F.lit(1)), F.sum(F.col("_v") * F.col("_k.w"))).alias(out))
    return points.join(sums, [*keys, *[b for b in by if b not in keys]], "left")


def nearest_valid(points: DataFrame, values: DataFrame, grid: Grid, keys: list[str], radius: float, x: str = "x", y: str = "y", lonlat: bool = False, unit_km: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """The nearest cell with a value within ``radius`` km of each point: keys, nearest_cell,
    nearest_value, distance_km (the lowest cell on ties). Only the cells of the window
    that the radius spans are looked at: a bounded list of offsets, joined by cell. by:
    keys that values have, too (the week, the variable)."""
    by = by or []
    per_y = radius / 111.32 if lonlat else radius / unit_km
    rows = math.ceil(per_y / grid.height)
    shrink = F.greatest(F.cos(F.radians(F.col(y))), F.lit(0.01)) if lonlat else F.lit(1.0)
    cols = F.ceil(F.lit(per_y / grid.width) / shrink)
    r, c = F.floor((grid.ymax - F.col(y)) / grid.height), F.floor((F.col(x) - grid.xmin) / grid.width)
    spread = points.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), r.alias("_r"), c.alias("_c"), cols.cast("int").alias("_n"))
    spread = spread.withColumn("_r", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_r") - rows), F.least(F.lit(grid.rows - 1), F.col("_r") + rows)))).where(F.col("_r").between(0, grid.rows - 1))
    spread = spread.withColumn("_c", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_c") - F.col("_n")), F.least(F.lit(grid.cols - 1), F.col("_c") + F.col("_n"))))).where(F.col("_c").between(0, grid.cols - 1))
    spread = spread.withColumn("cell_id", (F.col("_r") * grid.cols + F.col("_c") + 1).cast("long"))
    near = spread.join(values.where(finite("value")).select(*by, "cell_id", "value"), [*by, "cell_id"])
    cx, cy = grid.center("cell_id")
    if lonlat:  # each candidate's own mean latitude
        km = F.sqrt(F.pow((cx - F.col("_x")) * 111.32 * F.cos(F.radians((cy + F.col("_y")) / 2)), F.lit(2)) + F.pow((cy - F.col("_y")) * 111.32, F.lit(2)))
    else:
        km = F.sqrt(F.pow(cx - F.col("_x"), F.lit(2)) + F.pow(cy - F.col("_y"), F.lit(2))) * unit_km
    near = near.withColumn("distance_km", km).where(F.col("distance_km") <= radius)
    best = near.groupBy(*keys).agg(F.min(F.struct("distance_km", "cell_id", "value")).alias("b"))
    return best.select(*keys, F.col("b.cell_id").alias("nearest_cell"), F.col("b.value").alias("nearest_value"), F.col("b.distance_km").alias("distance_km"))


def extract_with_fallback(points: DataFrame, values: DataFrame, grid: Grid, keys: list[str], radius: float, **place) -> DataFrame:
    """direct (bilinear), value (direct, or the nearest within the radius), distance_km and
    method: direct, fallback or unresolved."""
    direct = bilinear(points, values, grid, keys, out="direct", **{k: v for k, v in place.items() if k in ("x", "y")})
    missing = direct.where("direct is null")
    near = nearest_valid(missing, values, grid, keys, radius, **place)
    out = direct.join(near, keys, "left")
    method = F.when(F.col("direct").isNotNull(), "direct").when(F.col("nearest_value").isNotNull(), "fallback").otherwise("unresolved")
    return out.withColumns({"value": F.coalesce("direct", "nearest_value"), "method": method, "distance_class": distance_bin("distance_km")})


def extraction_audit(extracted: DataFrame, by: list[str]) -> DataFrame:
    n = lambda m: F.count(F.when(F.col("method") == m, 1)).alias(f"n_{m}")
    return extracted.groupBy(*by).agg(n("direct"), n("fallback"), n("unresolved"), F.min("distance_km").alias("min_km"), F.percentile("distance_km", F.lit(0.5)).alias("median_km"), F.max("distance_km").alias("max_km"), F.array_join(F.array_sort(F.collect_set("distance_class")), ";").alias("distance_classes"))


def gap_summary(gaps: DataFrame, by: list[str]) -> DataFrame:
    """A row for each place and variable (``by``) with gaps, a gap a row with nearest_value and
    distance_km (null where no valid cell was near): weeks without a direct value, how many
    of them the nearest cell filled, distances, and the distance classes that occur, in order."""
    found = F.col("nearest_value").isNotNull()
    return gaps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("weeks_affected"), F.count(F.when(found, 1)).alias("fallback_success_weeks"), F.count(F.when(~found, 1)).alias("unresolved_weeks"),
        F.min("distance_km").alias("nearest_min_km"), F.percentile("distance_km", F.lit(0.5)).alias("nearest_median_km"), F.max("distance_km").alias("nearest_max_km"),
        F.array_join(F.array_sort(F.collect_set(distance_bin("distance_km"))), ";").alias("nearest_distance_bins"),
    )


def missing_diagnostics(extracted: DataFrame, stack: DataFrame, grid: Grid, variable: str, scope: str = "dynamic", x: str = "x", y: str = "y") -> DataFrame:
    """A row for each unresolved row of ``extract_with_fallback``: what was tried, the nearest
    valid cell however far it is known, and the raster it was sought in. stack: cell_id, value."""
    place = grid.cell(x, y)
    known = stack.where(finite("value")).select(F.col("cell_id").alias("_cell"), F.col("value").alias("_at"))
    cells = known.agg(F.count(F.lit(1)).alias("raster_valid_cells"))
    missing = extracted.where(F.col("method") == "unresolved").withColumn("_place", place).join(known, F.col("_place") == F.col("_cell"), "left").crossJoin(F.broadcast(cells))
    nx, ny = grid.center("nearest_cell")
    fixed = {
        "variable": variable, "scope": scope, "fallback_attempted": True, "raster_nrow": grid.rows, "raster_ncol": grid.cols, "raster_resolution_x": (grid.xmax - grid.xmin) / grid.cols, "raster_resolution_y": (grid.ymax - grid.ymin) / grid.rows,
        "raster_xmin": grid.xmin, "raster_xmax": grid.xmax, "raster_ymin": grid.ymin, "raster_ymax": grid.ymax,
    }
    keep = [c for c in ("row_id", "poly_id", "epiyear", "epiweek") if c in extracted.columns]
    return missing.select(
        *keep, F.col(x).alias("x"), F.col(y).alias("y"), *[F.lit(v).alias(k) for k, v in fixed.items()], F.col("distance_km").alias("fallback_distance_km"), distance_bin("distance_km").alias("nearest_distance_bin"), nx.alias("nearest_valid_x"), ny.alias("nearest_valid_y"),
        F.col("_place").isNotNull().alias("point_inside_raster_extent"), F.col("_at").alias("point_cell_value"), "raster_valid_cells",
    )


def weekly_covariates(rows: DataFrame, values: DataFrame, keys: list[str], variables: list[str], policy: str = "retain") -> tuple[DataFrame, DataFrame]:
    """``join_covariates`` for weekly variables, and (epiyear, epiweek, variable, rows, missing).
    ``policy``: "retain" keeps rows without a value, "fail" raises on one."""
    joined = join_covariates(rows, values, keys, variables)
    counts = joined.groupBy("epiyear", "epiweek").agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(~finite(v), 1)).alias(v) for v in variables]).unpivot(["epiyear", "epiweek", "rows"], variables, "variable", "missing")
    if policy == "fail" and counts.where("missing > 0").take(1):
        raise ValueError(f"missing values among {variables}")
    return joined, counts


def join_covariates(rows: DataFrame, values: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """Long covariates (variable, keys, value) as one column a variable beside rows."""
    wide = values.groupBy(*keys).pivot("variable", variables).agg(F.first("value"))
    return rows.join(wide, keys, "left")


def same_week_values(points: DataFrame, stack: DataFrame, week: list[str], out: str = "value") -> DataFrame:
    """Each point's value in its own week; null for weeks and cells without one."""
    return points.join(stack.select(*week, "cell_id", clean("value").alias(out)), [*week, "cell_id"], "left")


def all_week_values(points: DataFrame, stack: DataFrame) -> DataFrame:
    return points.join(stack, "cell_id")


def assign_to_grid(table: DataFrame, grid: Grid, value: str) -> DataFrame:
    """All cells with the table's value (null where it has none)."""
    spine = table.sparkSession.range(1, grid.rows * grid.cols + 1).withColumnRenamed("id", "cell_id")
    return spine.join(table.select("cell_id", F.col(value).alias("value")), "cell_id", "left")


def assignment_faults(table: DataFrame, grid: Grid, value: str) -> DataFrame:
    """One row of counts: ids out of range, repeated ids, values not finite."""
    n = table.groupBy("cell_id").count()
    bad = n.agg(F.count(F.when(~F.col("cell_id").between(1, grid.rows * grid.cols), 1)).alias("out_of_range"), F.count(F.when(F.col("count") > 1, 1)).alias("repeated"))
    return bad.crossJoin(F.broadcast(table.agg(F.count(F.when(~finite(value), 1)).alias("not_finite"))))


def coordinate_check(table: DataFrame, grid: Grid, tolerance: float = 1e-7) -> DataFrame:
    """One row: largest distances of stated coordinates from cell centres, median, 95%."""
    cx, cy = grid.center("cell_id")
    d = table.select(F.abs(F.col("x") - cx).alias("dx"), F.abs(F.col("y") - cy).alias("dy"))
    return d.agg(*[f.alias(n) for c in ("dx", "dy") for n, f in ((f"{c}_median", F.percentile(c, F.lit(0.5))), (f"{c}_q95", F.percentile(c, F.lit(0.95))), (f"{c}_max", F.max(c)))]).withColumn("within", (F.col("dx_max") <= tolerance) & (F.col("dy_max") <= tolerance))


def weekly_faults(table: DataFrame, week: list[str], key: str, probability: str, intensity: str) -> DataFrame:
    """Counts of contract breaks a week: repeated ids, values not finite or out of range."""
    return table.groupBy(*week).agg(
        F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.count_distinct(key)).alias("repeated_ids"), F.count(F.when(~finite(probability) | ~finite(intensity), 1)).alias("not_finite"),
        F.count(F.when(~F.col(probability).between(0, 1), 1)).alias("bad_probability"), F.count(F.when(F.col(intensity) <= 0, 1)).alias("bad_intensity"),
    )


def weekly_sum_floor(stack: DataFrame, week: list[str], least: float) -> DataFrame:
    return stack.groupBy(*week).agg(F.floor(F.sum(F.when(finite("value") & (F.col("value") >= least), F.col("value")).otherwise(0.0))).cast("long").alias("total"))


def rescale_all(stack: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Values rescaled by the least and greatest of all."""
    ends = stack.agg(F.min(clean("value")).alias("_lo"), F.max(clean("value")).alias("_hi"))
    out = stack.crossJoin(F.broadcast(ends))
    return out.withColumn("scaled", F.when(F.col("_hi") > F.col("_lo"), low + (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (high - low))).drop("_lo", "_hi")


def stability(stack: DataFrame) -> DataFrame:
    """cell_id, mean, sd, relative sd and mean * (1 - sd / largest sd)."""
    cells = stack.where(finite("value")).groupBy("cell_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    top = cells.agg(F.max("sd").alias("_top"))
    out = cells.crossJoin(F.broadcast(top))
    return out.select("cell_id", "mean", "sd", (F.col("sd") / F.nullif("_top", F.lit(0.0))).alias("relative_sd"), (F.col("mean") * (1 - F.col("sd") / F.nullif("_top", F.lit(0.0)))).alias("stability"))


def distribution_profile(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(measure, by..., n, nonfinite, min, q01..q99, mean, max), by group and overall (by
    null), over the unpivoted measures. The rows are read once, and counted by distinct value."""
    from ..sources.tables import kept
    from .metrics import exact_quantiles

    long = df.unpivot(by, columns, "measure", "v").withColumn("ok", F.when(finite("v"), F.col("v").cast("double")))
    long = kept(long.groupBy("measure", *by, "ok").agg(F.count(F.lit(1)).alias("c")), "profile")
    probs = {"q01": 0.01, "q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}
    seen = F.coalesce(F.sum(F.when(F.col("ok").isNotNull(), F.col("c"))), F.lit(0))
    parts = []
    for keys in (["measure"], ["measure", *by]):
        plain = long.groupBy(*keys).agg(seen.alias("n"), (F.sum("c") - seen).alias("nonfinite"), F.min("ok").alias("min"), (F.sum(F.col("ok") * F.col("c")) / F.nullif(seen, F.lit(0))).alias("mean"), F.max("ok").alias("max"))
        quantiles = exact_quantiles(long, "ok", probs, keys, "c").withColumnsRenamed({k: f"_{k}" for k in keys})
        both = plain.join(quantiles, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
        parts.append(both.select("measure", *[F.col(k) if k in keys else F.lit(None).cast(df.schema[k].dataType).alias(k) for k in by], "n", "nonfinite", "min", *probs, "mean", "max"))
    return parts[0].unionByName(parts[1])


def extent_audit(points: DataFrame, grid: Grid, template: DataFrame) -> DataFrame:
    """One row: points, inside the extent, on a cell with a template value."""
    placed = points.withColumn("cell_id", grid.cell("x", "y")).join(template.where(finite("value")).select("cell_id", F.lit(1).alias("_s")), "cell_id", "left")
    return placed.agg(F.count(F.lit(1)).alias("total"), F.count("cell_id").alias("inside_extent"), F.count("_s").alias("supported"), F.coalesce(F.bool_or(F.col("_s") == 1), F.lit(False)).alias("any_supported"))


def evenly_spaced_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """n rows evenly spaced in a small ordered table (weeks, maps)."""
    from ..functions.numbers import evenly_spaced

    ranked = df.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    return ranked.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n")))).where(evenly_spaced("position", F.col("_n"), n)).drop("_n")
