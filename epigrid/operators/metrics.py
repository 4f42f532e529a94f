"""Ranks, weighted distributions and validation metrics.

Global ranks never sort all rows in one task: rows are first summed by distinct score,
the scores are dealt to ranges between approximate quantiles (a bounded list), each range
is accumulated on its own, and the ranges' totals are carried on.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import finite
from ..functions.numbers import logit

RANGES = 64


def cumulative_scores(df: DataFrame, score: str, weights: dict[str, Column]) -> DataFrame:
    """One row a distinct finite score: each weight's sum (name) and its sum over all lesser
    scores (name_before)."""
    sums = df.where(finite(score)).groupBy(score).agg(*[F.sum(w).alias(n) for n, w in weights.items()])
    probs = [i / RANGES for i in range(1, RANGES)]
    splits = sums.agg(F.percentile_approx(score, probs, 2000)).first()[0]
    splits = sorted(set(splits or []))
    place = F.size(F.filter(F.array(*[F.lit(s) for s in splits]).cast("array<double>"), lambda s: s <= F.col(score))) if splits else F.lit(0)
    placed = sums.withColumn("_range", place)
    totals = placed.groupBy("_range").agg(*[F.sum(n).alias(f"_{n}") for n in weights])
    carried = totals.select("_range", *[F.coalesce(F.sum(f"_{n}").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_{n}") for n in weights])
    order = Window.partitionBy("_range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumns({f"{n}_before": F.coalesce(F.sum(n).over(order), F.lit(0)) for n in weights})
    out = inside.join(F.broadcast(carried), "_range")  # at most RANGES rows
    return out.select(score, *weights, *[(F.col(f"{n}_before") + F.col(f"_{n}")).alias(f"{n}_before") for n in weights])


def exact_quantiles(df: DataFrame, value: str | Column, probs: dict[str, float], by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by..., name...): exact type 7 quantiles of the finite values of each group (a null is a
    group of its own), without a group's values ever meeting in one task: rows are first
    counted by distinct value, a group's values are dealt to ranges, and the ranges' totals
    carried on. weight: a column of how often each row counts."""
    by = by or []
    v = F.col(value) if isinstance(value, str) else value
    key = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(1))
    counts = df.select(key.alias("_key"), v.cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).alias("_w")).where(finite("_v")).groupBy("_key", "_v").agg(F.sum("_w").alias("_c"))
    splits = counts.groupBy("_key").agg(F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], 1000).alias("_splits"))
    placed = counts.join(splits, "_key").withColumn("_range", F.size(F.filter("_splits", lambda s: s <= F.col("_v")))).drop("_splits")
    totals = placed.groupBy("_key", "_range").agg(F.sum("_c").alias("_t"))  # at most RANGES rows a group
    whole = Window.partitionBy("_key")
    carried = totals.select("_key", "_range", (F.sum("_t").over(whole.orderBy("_range")) - F.col("_t")).alias("_base"), F.sum("_t").over(whole).alias("_n"))
    inside = Window.partitionBy("_key", "_range").orderBy("_v")
    ranked = placed.join(carried, ["_key", "_range"]).withColumn("_before", F.col("_base") + F.sum("_c").over(inside) - F.col("_c"))
    at = lambda k: F.max(F.when((F.col("_before") <= k) & (k < F.col("_before") + F.col("_c")), F.col("_v")))
    ends = []
    for i, p in enumerate(probs.values()):
        h = (F.col("_n") - 1) * F.lit(float(p))
        ends += [at(F.floor(h)).alias(f"_lo{i}"), at(F.ceil(h)).alias(f"_hi{i}"), F.first(h - F.floor(h)).alias(f"_f{i}")]
    out = ranked.groupBy("_key").agg(*ends)
    named = [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(n) for i, n in enumerate(probs)]
    return out.select(*[F.col("_key")[c].alias(c) for c in by], *named)


def average_rank(df: DataFrame, column: str, out: str, partition: list[str] | None = None, count: str | None = None) -> DataFrame:
    """df with 1-based ranks, the mean rank for ties; rows without a finite value get null.
    count names a column for the number of ranked rows."""
    if partition is not None:
        w = Window.partitionBy(*partition, finite(column)).orderBy(column)
        ties = F.count(F.lit(1)).over(Window.partitionBy(*partition, finite(column), column))
        ranked = df.withColumn(out, F.when(finite(column), F.rank().over(w) + (ties - 1) / 2))
        return ranked if count is None else ranked.withColumn(count, F.count(F.when(finite(column), 1)).over(Window.partitionBy(*partition)))
    scores = cumulative_scores(df, column, {"_c": F.lit(1)}).select(F.col(column).alias("_s"), (F.col("_c_before") + (F.col("_c") + 1) / 2).alias(out))
    ranked = df.join(scores, df[column] == scores["_s"], "left").drop("_s")
    if count is not None:
        ranked = ranked.crossJoin(F.broadcast(df.agg(F.count(F.when(finite(column), 1)).alias(count))))
    return ranked


def rank_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row (auc): the chance that a positive outranks a negative, ties half."""
    positive = F.col(label) == 1
    s = cumulative_scores(df.where(F.col(label).isNotNull()), score, {"p": F.when(positive, 1).otherwise(0), "n": F.when(positive, 0).otherwise(1)})
    return s.agg((F.sum(F.col("p") * (F.col("n_before") + F.col("n") / 2)) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"))


def weighted_auc(presences: DataFrame, background: DataFrame, score: str, weight: Column) -> DataFrame:
    """One row (auc): mean over presences of the background's weight below, plus half of
    the weight at the score, over all weight."""
    rows = presences.select(score, F.lit(1).alias("_p"), F.lit(0.0).alias("_w")).unionByName(background.where(finite(weight) & (weight > 0)).select(score, F.lit(0).alias("_p"), weight.cast("double").alias("_w")))
    s = cumulative_scores(rows, score, {"p": F.col("_p"), "w": F.col("_w")})
    return s.agg((F.sum(F.col("p") * (F.col("w_before") + F.col("w") / 2)) / F.nullif(F.sum("p"), F.lit(0)) / F.nullif(F.sum("w"), F.lit(0.0))).alias("auc"))


def same_week_percentiles(presences: DataFrame, background: DataFrame, score: str, weight: str, week: list[str]) -> DataFrame:
    """presences with percentile and weighted_percentile of their score in the background
    of their week (less, plus half of what is equal)."""
    b = background.where(finite(score) & finite(weight) & (F.col(weight) > 0)).select(*week, score, F.lit(1.0).alias("_n"), F.col(weight).cast("double").alias("_w"))
    p = presences.where(finite(score)).select(*week, score).distinct().select(*week, score, F.lit(0.0).alias("_n"), F.lit(0.0).alias("_w"))
    by = b.unionByName(p).groupBy(*week, score).agg(F.sum("_n").alias("_n"), F.sum("_w").alias("_w"))
    order, all_ = Window.partitionBy(*week).orderBy(score), Window.partitionBy(*week)
    part = lambda c: (F.sum(c).over(order) - F.col(c) / 2) / F.nullif(F.sum(c).over(all_), F.lit(0.0))
    return presences.join(by.select(*week, score, part("_n").alias("percentile"), part("_w").alias("weighted_percentile")), [*week, score], "left")


def percentile_summary(df: DataFrame, value: str) -> DataFrame:
    """(metric, value): count, moments, quantiles and shares above .5, .75, .9."""
    v = F.col(value)
    one = df.where(finite(value)).agg(F.count(v).cast("double").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), *[F.avg((v > t).cast("double")).alias(f"above_{int(100 * t)}") for t in (0.5, 0.75, 0.9)])
    quantiles = exact_quantiles(df, value, {"p05": 0.05, "p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95})
    one = one.join(F.broadcast(quantiles), F.lit(True), "left")  # one row each
    return one.unpivot([], one.columns, "metric", "value")


def weekly_rank_summary(df: DataFrame, week: list[str]) -> DataFrame:
    return df.groupBy(*week).agg(F.count("percentile").alias("n"), F.avg("percentile").alias("mean_percentile"), F.percentile("percentile", F.lit(0.5)).alias("median_percentile"), F.avg("weighted_percentile").alias("mean_weighted_percentile"))


def boyce_curve(presences: DataFrame, background: DataFrame, score: str, weight: Column | None = None, width_fraction: float = 0.1, windows: int = 100) -> DataFrame:
    """Moving windows over the joint score range: presences' share over the background's
    expected share, with successive duplicates marked. Empty when the range is."""
    spark = presences.sparkSession
    w = F.lit(1.0) if weight is None else weight.cast("double")
    p = presences.where(finite(score)).select(F.col(score).cast("double").alias("s"), F.lit(1).alias("p"), F.lit(0).alias("b"), F.lit(0.0).alias("w"))
    b = background.where(finite(score) & finite(w) & (w > 0)).select(F.col(score).cast("double").alias("s"), F.lit(0).alias("p"), F.lit(1).alias("b"), w.alias("w"))
    rows = p.unionByName(b).groupBy("s").agg(F.sum("p").alias("p"), F.sum("b").alias("b"), F.sum("w").alias("w"))
    whole = rows.agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.sum("p").alias("all_p"), F.sum("w").alias("all_w")).where("hi > lo and all_p > 0 and all_w > 0")
    middle = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("window_id") - 1) / (windows - 1)
    half = (F.col("hi") - F.col("lo")) * width_fraction / 2
    frames = spark.range(1, windows + 1).withColumnRenamed("id", "window_id").crossJoin(F.broadcast(whole)).withColumns({"midpoint": middle, "lower": middle - half, "upper": middle + half})
    frames = F.broadcast(frames)  # one row a window
    # Each score goes to the some width_fraction * windows that it may lie in, and is tested there.
    step = (F.col("hi") - F.col("lo")) / (windows - 1)
    first, last = (F.col("s") - half - F.col("lo")) / step, (F.col("s") + half - F.col("lo")) / step
    spread = rows.crossJoin(F.broadcast(whole.select("lo", "hi"))).select("s", "p", "b", "w", F.explode(F.sequence(F.greatest(F.lit(1), F.floor(first)).cast("long"), F.least(F.lit(windows), F.ceil(last) + 2).cast("long"))).alias("window_id"))
    sums = spread.join(frames.select("window_id", "lower", "upper"), "window_id").where((F.col("s") >= F.col("lower")) & (F.col("s") <= F.col("upper"))).groupBy("window_id").agg(F.sum("p").alias("n_presences"), F.sum("b").alias("n_background"), F.sum("w").alias("background_weight"))
    curve = frames.join(sums, "window_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_presences", "n_background", "background_weight")})
    curve = curve.withColumn("expected", F.col("background_weight") / F.col("all_w")).withColumn("p_over_e", F.when(F.col("expected") > 0, F.col("n_presences") / F.col("all_p") / F.col("expected")))
    before = F.lag("p_over_e").over(Window.partitionBy(F.col("p_over_e").isNull()).orderBy("window_id"))
    curve = curve.withColumn("duplicate", F.coalesce(F.col("p_over_e") == before, F.lit(False))).withColumn("retained", F.col("p_over_e").isNotNull() & ~F.col("duplicate"))
    return curve.select("window_id", "lower", "midpoint", "upper", "n_presences", "n_background", "background_weight", "expected", "p_over_e", "duplicate", "retained")


def boyce_index(curve: DataFrame) -> DataFrame:
    """One row (cbi): Spearman correlation of midpoint and ratio over the retained windows."""
    return spearman(curve.where("retained").withColumn("_k", F.lit(1)), "midpoint", "p_over_e", ["_k"]).select(F.col("spearman").alias("cbi"))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Correlation of average ranks within groups (each of which one task ranks)."""
    both = df.where(finite(x) & finite(y))
    ranked = average_rank(average_rank(both, x, "_rx", by), y, "_ry", by)
    return ranked.groupBy(*by).agg(F.when((F.count_distinct("_rx") > 1) & (F.count_distinct("_ry") > 1), F.corr("_rx", "_ry")).alias("spearman"))


def error_metrics(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    """One row: n, mae, rmse, pearson, spearman, mean observed/expected. Ranks are those of
    pairs of values with their counts, so a common value is a few rows."""
    o, p = F.col("_o"), F.col("_p")
    both = df.where(finite(observed) & finite(predicted)).select(F.col(observed).cast("double").alias("_o"), F.col(predicted).cast("double").alias("_p"))
    basic = both.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(o - p)).alias("mae"), F.sqrt(F.avg((o - p) * (o - p))).alias("rmse"), F.corr(o, p).alias("pearson"), (F.avg(o) / F.nullif(F.avg(p), F.lit(0.0))).alias("mean_ratio"))
    pairs = both.groupBy("_o", "_p").agg(F.count(F.lit(1)).alias("_k"))
    ranked = pairs
    for column, out in (("_o", "_ro"), ("_p", "_rp")):
        scores = cumulative_scores(pairs, column, {"_c": F.col("_k")}).select(F.col(column).alias("_s"), (F.col("_c_before") + (F.col("_c") + 1) / 2).alias(out))
        ranked = ranked.join(scores, F.col(column) == F.col("_s")).drop("_s")
    ranked = ranked.crossJoin(F.broadcast(both.agg(((F.count(F.lit(1)) + 1) / 2).alias("_m"))))  # the mean of all ranks
    x, y, k = F.col("_ro") - F.col("_m"), F.col("_rp") - F.col("_m"), F.col("_k")
    spread = F.sqrt(F.sum(k * x * x) * F.sum(k * y * y))
    return basic.crossJoin(F.broadcast(ranked.agg((F.sum(k * x * y) / F.nullif(spread, F.lit(0.0))).alias("spearman"))))


def brier_log_loss(df: DataFrame, label: str, probability: str, clip: float = 1e-12) -> DataFrame:
    y, p = F.col(label).cast("double"), F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col(probability)))
    return df.where(finite(probability) & F.col(label).isNotNull()).agg(F.avg(F.pow(F.col(probability) - y, 2)).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def linear_calibration(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    """One row (intercept, slope) of observed on predicted; null below three rows or two
    distinct predictions."""
    both = df.where(finite(observed) & finite(predicted))
    enough = (F.count(F.lit(1)) >= 3) & (F.min(predicted) < F.max(predicted))
    return both.agg(F.when(enough, F.regr_intercept(observed, predicted)).alias("intercept"), F.when(enough, F.regr_slope(observed, predicted)).alias("slope"))


def logistic_calibration(df: DataFrame, label: str, probability: str, steps: int = 25) -> tuple[float, float]:
    """Intercept and slope of label on logit(probability): Newton steps, each one aggregate
    over the rows (five sums reach the driver)."""
    rows = df.where(finite(probability) & F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), logit(probability).alias("x"))
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + F.exp(-(F.lit(float(beta[0])) + F.lit(float(beta[1])) * F.col("x"))))
        w, r, x = p * (1 - p), F.col("y") - p, F.col("x")
        s = rows.agg(*[F.coalesce(F.sum(e), F.lit(0.0)).alias(n) for n, e in (("g0", r), ("g1", r * x), ("h00", w), ("h01", w * x), ("h11", w * x * x))]).first()
        h = np.array([[s["h00"], s["h01"]], [s["h01"], s["h11"]]])
        if np.linalg.det(h) <= 1e-300:
            break
        step = np.linalg.solve(h, [s["g0"], s["g1"]])
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    return float(beta[0]), float(beta[1])


#: Rows of one score that are ranked together; more are dealt to ranges of their ids.
TIED = 100_000


def equal_frequency_bins(df: DataFrame, predicted: str, observed: str, row_id: str, bins: int) -> DataFrame:
    """(bin, n, mean_predicted, mean_observed, sum_observed): floor((r - 1) * b / n) + 1 of
    the rank r by prediction and row id (a number), with b at most n bins."""
    rows = df.where(finite(predicted))
    hot = rows.groupBy(predicted).agg(F.count(F.lit(1)).alias("_c"), F.percentile_approx(row_id, [i / RANGES for i in range(1, RANGES)], 1000).alias("_cuts")).where(F.col("_c") > TIED)
    hot = hot.select(F.col(predicted).alias("_h"), "_cuts")  # at most rows / TIED
    dealt = rows.join(F.broadcast(hot), rows[predicted] == hot["_h"], "left").drop("_h")
    dealt = dealt.withColumn("_part", F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c <= F.col(row_id))))).drop("_cuts")
    parts = dealt.groupBy(predicted, "_part").agg(F.count(F.lit(1)).alias("_k"))
    before = F.sum("_k").over(Window.partitionBy(predicted).orderBy("_part")) - F.col("_k")
    parts = parts.select(F.col(predicted).alias("_s2"), F.col("_part").alias("_p2"), before.alias("_first"))
    ties = F.row_number().over(Window.partitionBy(predicted, "_part").orderBy(row_id)) - 1
    scores = cumulative_scores(rows, predicted, {"_c": F.lit(1)}).select(F.col(predicted).alias("_s"), "_c_before")
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    ranked = dealt.withColumn("_t", ties).join(parts, (dealt[predicted] == parts["_s2"]) & (F.col("_part") == F.col("_p2"))).join(scores, dealt[predicted] == scores["_s"]).crossJoin(F.broadcast(n))
    b = F.least(F.lit(bins), F.col("_n"))
    ranked = ranked.withColumn("bin", (F.floor((F.col("_c_before") + F.col("_first") + F.col("_t")) * b / F.col("_n")) + 1).cast("int"))
    return ranked.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(predicted).alias("mean_predicted"), F.avg(observed).alias("mean_observed"), F.sum(observed).alias("sum_observed"))


def reconstruction_audit(df: DataFrame, by: list[str], expected: str, actual: str, rmse: float = 1e-8, median: float = 1e-10, most: float = 1e-6) -> DataFrame:
    """Error moments, quantiles and tolerances of actual against expected, a row a group."""
    e = F.col(actual) - F.col(expected)
    a = F.abs(e)
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(e).alias("mean_error"), F.avg(a).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(a).alias("max_abs"))
    quantiles = exact_quantiles(df, a, {"median_abs": 0.5, "q95_abs": 0.95, "q99_abs": 0.99}, by).withColumnsRenamed({c: f"_{c}" for c in by})
    out = out.join(quantiles, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left").drop(*[f"_{c}" for c in by])
    out = out.select(*by, "n", "mean_error", "mae", "rmse", "median_abs", "q95_abs", "q99_abs", "max_abs")
    return out.withColumns({"rmse_ok": F.col("rmse") <= rmse, "median_ok": F.col("median_abs") <= median, "max_ok": F.col("max_abs") <= most})


def worst_rows(df: DataFrame, by: list[str], error: Column, row_id: str, n: int = 20) -> DataFrame:
    """The n rows of largest absolute error in each group, ties by row id."""
    ranked = df.withColumn("abs_error", F.abs(error))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("abs_error"), row_id))).where(F.col("place") <= n)
