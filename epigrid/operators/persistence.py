"""Masked potential abundance, its threshold, and how long it persists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import finite, holds
from ..functions.numbers import masked_by_temperature, persistence_class, persistence_index
from ..functions.places import Grid
from .grid import same_week_values
from .sets import small


def potential_abundance(df: DataFrame, intensity: str, area: float, out: str = "abundance") -> DataFrame:
    return df.withColumn(out, F.col(intensity) * F.lit(float(area)))


def apply_mask(df: DataFrame, value: str, temperature: str, threshold: float, out: str = "masked") -> DataFrame:
    return df.withColumn(out, masked_by_temperature(value, temperature, threshold))


def mask_audit(masked: DataFrame, by: list[str], value: str, out: str = "masked") -> DataFrame:
    """Retained, zeroed and missing cells a group, and the share of supported ones zeroed."""
    zeroed = finite(value) & (F.col(out) == 0) & (F.col(value) != 0)
    agg = masked.groupBy(*by).agg(F.count(out).alias("supported"), F.count(F.when(zeroed, 1)).alias("zeroed"), F.count(F.when(F.col(out).isNull(), 1)).alias("missing"))
    return agg.withColumn("retained", F.col("supported") - F.col("zeroed")).withColumn("share_zeroed", F.col("zeroed") / F.nullif(F.col("supported"), F.lit(0)))


def mask_comparison(masked: DataFrame, by: list[str], loose: str, strict: str) -> DataFrame:
    """Cells that the stricter mask removes from the looser, and cells it wrongly adds."""
    removed, added = (F.col(loose) > 0) & (F.coalesce(strict, F.lit(0.0)) == 0), (F.coalesce(loose, F.lit(0.0)) == 0) & (F.col(strict) > 0)
    return masked.groupBy(*by).agg(F.count(F.when(removed, 1)).alias("removed"), F.count(F.when(added, 1)).alias("violations"))


def dynamic_threshold(observations: DataFrame, stack: DataFrame, week: list[str], quantile: float = 0.10, grid: Grid | None = None) -> DataFrame:
    """One row: the quantile of the values at the observations in their own weeks (zeros
    count), with how many observations were used and why others were not."""
    weeks = stack.select(*week).distinct().withColumn("_w", F.lit(True))
    support = stack.where(finite("value")).select("cell_id").distinct().withColumn("_s", F.lit(True))
    paired = same_week_values(observations, stack, week).join(small(weeks), week, "left").join(support, "cell_id", "left")
    used = finite("value")
    inside = F.col("cell_id").isNotNull()
    return paired.agg(
        F.percentile(F.when(used, F.col("value")), F.lit(quantile)).alias("threshold"), F.count(F.lit(1)).alias("total"), F.count(F.when(inside, 1)).alias("inside_extent"), F.count(F.when(inside & F.col("_s").isNull(), 1)).alias("unsupported"),
        F.count(F.when(F.col("_w").isNull(), 1)).alias("outside_horizon"), F.count(F.when(used, 1)).alias("used"), F.count(F.when(used & (F.col("value") == 0), 1)).alias("zeros"),
    )


def longest_run(stack: DataFrame, threshold, order: list, cell: str = "cell_id", missing: str = "null", value: str = "value") -> DataFrame:
    """(cell, longest_run): weeks in a row above the threshold. Missing values break a run;
    a cell of only missing values has no run (missing="null") or one of 0 ("zero")."""
    suitable = holds(finite(value) & (F.col(value) > threshold))
    w = Window.partitionBy(cell).orderBy(*order)
    rows = stack.select(cell, *order, suitable.alias("_on"), finite(value).alias("_ok"))
    rows = rows.withColumn("_island", F.row_number().over(w) - F.sum(F.col("_on").cast("int")).over(w))
    runs = rows.groupBy(cell, "_island").agg(F.sum(F.col("_on").cast("int")).alias("_n"), F.bool_or("_ok").alias("_ok"))
    best = F.max("_n")
    return runs.groupBy(cell).agg((F.when(F.bool_or("_ok"), best) if missing == "null" else best).alias("longest_run"))


def persistence(runs: DataFrame, days_per_layer: int = 7, generation_days: int = 21) -> DataFrame:
    out = runs.withColumn("rpi", persistence_index("longest_run", days_per_layer, generation_days))
    return out.withColumn("rpi_class", persistence_class("rpi"))


def class_areas(classes: DataFrame, area: float, column: str = "rpi_class") -> DataFrame:
    """(class, cells, area, share) for classes 0 to 3; share of the supported cells."""
    counts = classes.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("rpi_class")).agg(F.count(F.lit(1)).alias("cells"))
    total = classes.agg(F.count(column).alias("_t"))
    dim = classes.sparkSession.range(4).select(F.col("id").cast("int").alias("rpi_class"))
    out = dim.join(F.broadcast(counts), "rpi_class", "left").crossJoin(F.broadcast(total)).withColumn("cells", F.coalesce("cells", F.lit(0)))
    return out.select("rpi_class", "cells", (F.col("cells") * F.lit(float(area))).alias("area"), (F.col("cells") / F.nullif("_t", F.lit(0))).alias("share"))


def transitions(before: DataFrame, after: DataFrame, cell: str = "cell_id", column: str = "rpi_class") -> DataFrame:
    """A row a class before, a column a class after (to_0 .. to_3), empty cells 0."""
    both = before.select(cell, F.col(column).alias("from_class")).join(after.select(cell, F.col(column).alias("_to")), cell).where("from_class is not null and _to is not null")
    out = both.groupBy("from_class").pivot("_to", [0, 1, 2, 3]).count().na.fill(0)
    return out.withColumnsRenamed({str(i): f"to_{i}" for i in range(4)})


def threshold_sweep(stack: DataFrame, thresholds: DataFrame, order: list, cell: str = "cell_id") -> DataFrame:
    """Longest runs and classes for each of a few thresholds (label, threshold)."""
    rows = stack.crossJoin(small(thresholds))
    on = holds(finite("value") & (F.col("value") > F.col("threshold")))
    w = Window.partitionBy("label", cell).orderBy(*order)
    rows = rows.select("label", cell, *order, on.alias("_on")).withColumn("_i", F.row_number().over(w) - F.sum(F.col("_on").cast("int")).over(w))
    runs = rows.groupBy("label", cell, "_i").agg(F.sum(F.col("_on").cast("int")).alias("_n")).groupBy("label", cell).agg(F.max("_n").alias("longest_run"))
    return persistence(runs)


def front_quantiles(df: DataFrame, date: str, y: str, days: int = 7, quantile: float = 0.95, least: int = 5) -> DataFrame:
    """(day, front): for every day from the first to the last, the quantile of y over the
    ``days`` days that end with it; null with fewer than ``least`` values. A row goes to the
    days of its own window only."""
    seen = df.where(finite(y)).select(F.to_date(date).alias("_d"), F.col(y).cast("double").alias("_y"))
    span = seen.agg(F.min("_d").alias("a"), F.max("_d").alias("b"))
    spine = span.where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    spread = seen.select(F.explode(F.sequence(F.col("_d"), F.date_add("_d", days - 1), F.expr("interval 1 day"))).alias("day"), "_y")
    fronts = spread.groupBy("day").agg(F.when(F.count(F.lit(1)) >= least, F.percentile("_y", F.lit(quantile))).alias("front"))
    return spine.join(fronts, "day", "left")


def front_velocity(fronts: DataFrame) -> DataFrame:
    """Daily advance of the front (days are few): steps back and gaps count as 0."""
    w = Window.orderBy("day")
    step = F.col("front") - F.lag("front").over(w)
    return fronts.withColumns({"advance": F.when(step > 0, step).otherwise(0.0), "day_index": F.row_number().over(w)})


def smooth_walk(fronts: DataFrame, value: str = "advance", precision: float = 10.0) -> DataFrame:
    """(day, smoothed): ``smooth_walks`` of one daily series without gaps."""
    first = fronts.agg(F.min("day").alias("first"))
    numbered = fronts.crossJoin(F.broadcast(first)).select(F.lit(0).alias("series"), F.date_diff("day", "first").cast("long").alias("i"), "first", value)
    days = numbered.select("series", "i", F.date_add("first", F.col("i").cast("int")).alias("day"))
    return days.join(smooth_walks(numbered, ["series"], "i", value, precision), ["series", "i"]).select("day", "smoothed")


def _eliminated(lower, diagonal, upper, right):
    """The solution of tridiagonal systems with one matrix and the columns of ``right``."""
    import numpy as np

    n, d, r = len(diagonal), diagonal.copy(), np.array(right, dtype=float)
    for k in range(1, n):
        f = lower[k] / d[k - 1]
        d[k] -= f * upper[k - 1]
        r[k] -= f * r[k - 1]
    for k in reversed(range(n)):
        r[k] = (r[k] - (upper[k] * r[k + 1] if k + 1 < n else 0)) / d[k]
    return r


def smooth_walks(series: DataFrame, keys: list[str], order: str, value: str, precision: float = 10.0, block: int = 512) -> DataFrame:
    """(keys, order, smoothed): the mean of a first-order random walk around the values of
    each series, a tridiagonal system with one unknown a step. ``order`` is a whole number
    that rises by one; values that are not finite are filled by the walk.

    Series are cut into blocks of ``block`` steps. Each block's inner unknowns are eliminated
    in a task of its own, in terms of its two ends; the ends of a series make a tridiagonal
    system of two unknowns a block, solved in one task a series; the inner ones follow."""
    import numpy as np
    import pandas as pd

    kinds, block = dict(series.dtypes), max(2, block)  # only the last block of a series can have a single step
    typed = ", ".join(f"{k} {kinds[k]}" for k in keys)
    rows = series.select(*keys, F.col(order).cast("long").alias("_i"), F.col(value).cast("double").alias("_v"))
    ends = rows.groupBy(*keys).agg(F.min("_i").alias("_first"), F.max("_i").alias("_last"))
    rows = rows.join(ends, keys).withColumn("_b", F.expr(f"(_i - _first) div {block}"))

    def system(pdf):
        pdf = pdf.sort_values("_i")
        i, v = pdf["_i"].to_numpy(), pdf["_v"].to_numpy(dtype=float)
        have = np.isfinite(v)
        first, last = pdf["_first"].iloc[0], pdf["_last"].iloc[0]
        diagonal = have + precision * ((i > first).astype(float) + (i < last)) + 1e-9
        return pdf, i, diagonal, np.where(have, v, 0.0), first, last

    def inner(diagonal, right):
        """Columns: the right side's part of the inner unknowns, and those of the two ends."""
        n = len(diagonal) - 2
        sides = np.zeros((n, 3))
        sides[:, 0], sides[0, 1], sides[-1, 2] = right[1:-1], precision, precision
        off = np.full(n, -precision)
        return _eliminated(off, diagonal[1:-1], off, sides)

    def condense(pdf):
        """The equations of a block's ends: previous end, own, next end, right side."""
        pdf, i, diagonal, right, first, last = system(pdf)
        n, before, after = len(i), (-precision if i[0] > first else 0.0), (-precision if i[-1] < last else 0.0)
        if n == 1:  # the last block: both ends are one
            low, high = (before, diagonal[0], 0.0, right[0]), (-1.0, 1.0, 0.0, 0.0)
        elif n == 2:
            low, high = (before, diagonal[0], -precision, right[0]), (-precision, diagonal[1], after, right[1])
        else:
            x = inner(diagonal, right)
            low = (before, diagonal[0] - precision * x[0, 1], -precision * x[0, 2], right[0] + precision * x[0, 0])
            high = (-precision * x[-1, 1], diagonal[-1] - precision * x[-1, 2], after, right[-1] + precision * x[-1, 0])
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], pdf["_b"].iloc[0], *low, *high]])

    def settle(pdf):
        pdf = pdf.sort_values("_b")
        eq = pdf.iloc[:, len(keys) + 1 :].to_numpy(dtype=float).reshape(-1, 4)
        x = _eliminated(eq[:, 0], eq[:, 1], eq[:, 2], eq[:, 3:4])[:, 0].reshape(-1, 2)
        return pdf[[*keys, "_b"]].assign(_low=x[:, 0], _high=x[:, 1])

    def fill(pdf):
        pdf, i, diagonal, right, *_ = system(pdf)
        low, high = pdf["_low"].iloc[0], pdf["_high"].iloc[0]
        x = np.full(len(i), low)
        x[-1] = high if len(i) > 1 else low
        if len(i) > 2:
            x[1:-1] = inner(diagonal, right) @ np.array([1.0, low, high])
        return pd.DataFrame({**{k: pdf[k] for k in keys}, order: i, "smoothed": x})

    equations = ", ".join(f"_{s}{k} double" for s in ("l", "h") for k in range(4))
    condensed = rows.groupBy(*keys, "_b").applyInPandas(condense, f"{typed}, _b long, {equations}")
    solved = condensed.groupBy(*keys).applyInPandas(settle, f"{typed}, _b long, _low double, _high double")
    return rows.join(solved, [*keys, "_b"]).groupBy(*keys, "_b").applyInPandas(fill, f"{typed}, {order} long, smoothed double")
