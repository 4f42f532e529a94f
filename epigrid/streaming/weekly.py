"""Weekly operators on streams: buckets from Monday, the complete-week cut as a watermark,
sliding fronts, and runs of suitable weeks as keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import finite


def weekly_counts(events: DataFrame, ts: str, keys: list[str], late: str = "7 days") -> DataFrame:
    """Counts by key and week. Day 0 of the epoch was a Thursday, so weeks start four days
    later, on Monday. Weeks close once the watermark is past them."""
    w = F.window(ts, "7 days", startTime="4 days")
    counts = events.withWatermark(ts, late).groupBy(w.alias("week"), *keys).agg(F.count(F.lit(1)).alias("count"), F.sum("value").alias("total"))
    return counts.select(F.to_date("week.start").alias("week_start"), *keys, "count", "total")


def sliding_fronts(events: DataFrame, ts: str, value: str, late: str = "1 day", quantile: float = 0.95) -> DataFrame:
    """The front over the seven days that end with each day, approximately."""
    w = F.window(ts, "7 days", "1 day")
    out = events.where(finite(value)).withWatermark(ts, late).groupBy(w.alias("w")).agg(F.percentile_approx(value, quantile, 10_000).alias("front"), F.count(F.lit(1)).alias("n"))
    return out.select(F.date_sub(F.to_date("w.end"), 1).alias("day"), F.when(F.col("n") >= 5, F.col("front")).alias("front"))


def with_same_week(events: DataFrame, stack: DataFrame, ts: str) -> DataFrame:
    """Events with the static value of their cell and week."""
    monday = F.date_sub(F.to_date(ts), F.weekday(ts))
    return events.withColumn("week_start", monday).join(stack.select("week_start", "cell_id", F.col("value").alias("cell_value")), ["week_start", "cell_id"], "left")


def running_longest(weekly: DataFrame, threshold: float) -> DataFrame:
    """(cell_id, week, run, longest) as weeks come in, in order within each cell: state is
    the present run, the longest, and the last week."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        import pandas as pd

        run, best, last = state.get if state.exists else (0, 0, -1)
        rows = []
        for pdf in frames:
            for week, value in sorted(zip(pdf["week"], pdf["value"], strict=True)):
                on = value == value and value is not None and value > threshold
                run = (run + 1 if week == last + 1 or last < 0 else 1) if on else 0
                best, last = max(best, run), int(week)
                rows.append((key[0], int(week), run, best))
        state.update((run, best, last))
        yield pd.DataFrame(rows, columns=["cell_id", "week", "run", "longest"])

    return weekly.groupBy("cell_id").applyInPandasWithState(step, "cell_id long, week long, run long, longest long", "run long, best long, last long", "append", GroupStateTimeout.NoTimeout)
