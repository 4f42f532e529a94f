"""Numbers: links, hinges, classes and bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col, finite

EPSILON = 2.220446049250313e-16


def zscore(x, center, scale) -> Column:
    """Standardized after the centre took the place of missing values."""
    return (F.coalesce(col(x), center) - center) / scale


def log1p_imputed(x, fill) -> Column:
    return F.log1p(F.coalesce(col(x), fill))


def hinge(x, knot) -> Column:
    """max(0, x - knot); null stays null."""
    return F.when(col(x).isNotNull(), F.greatest(F.lit(0.0), col(x) - knot))


def inverse_logit(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def logit(p, clip: float = 1e-12) -> Column:
    q = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), col(p)))
    return F.log(q / (1 - q))


def interval_bin(x, breaks) -> Column:
    """1-based interval of an array of breaks, the last one closed on the right, values
    outside in the first or last."""
    b = col(breaks)
    return F.greatest(F.lit(1), F.least(F.size(b) - 1, F.size(F.filter(b, lambda k: k <= col(x)))))


def midpoints(breaks) -> Column:
    b = col(breaks)
    return F.zip_with(F.slice(b, F.lit(1), F.size(b) - 1), F.slice(b, F.lit(2), F.size(b) - 1), lambda p, q: (p + q) / 2)


def distance_bin(km) -> Column:
    k = col(km)
    return F.when(k.isNull(), "none").when(k <= 25, "<=25 km").when(k <= 50, "25-50 km").when(k <= 75, "50-75 km").otherwise(">75 km")


def persistence_index(weeks, days_per_layer: int = 7, generation_days: int = 21) -> Column:
    return col(weeks) * F.lit(float(days_per_layer)) / generation_days


def persistence_class(index) -> Column:
    """Classes 0 to 3 of the index: below 3, 8, 15, and from there on."""
    i = col(index)
    return F.when(i.isNull(), None).when(i < 3, 0).when(i < 8, 1).when(i < 15, 2).otherwise(3)


def masked_by_temperature(value, temperature, threshold: float) -> Column:
    """The value where it is warm enough, 0 where not, null where either is missing."""
    return F.when(finite(temperature) & finite(value), F.when(col(temperature) >= threshold, col(value)).otherwise(F.lit(0.0)))


def weighted_quantiles(mean, low, high, weight) -> tuple[Column, Column, Column]:
    """A posterior mean and its bounds times a weight; a negative one swaps the bounds."""
    w = col(weight)
    a, b = w * col(low), w * col(high)
    return w * col(mean), F.when(w < 0, b).otherwise(a), F.when(w < 0, a).otherwise(b)


def gamma_from_range(mean, low, high) -> tuple[Column, Column]:
    """Shape and rate with the mean, and a quarter of the range as standard deviation."""
    sd = (col(high) - col(low)) / 4
    return F.pow(col(mean) / sd, 2), col(mean) / F.pow(sd, 2)


def rescale(x, low, high, to_low: float = 0.0, to_high: float = 1.0) -> Column:
    return F.when(high > low, to_low + (col(x) - low) / (high - low) * (to_high - to_low))


def evenly_spaced(index, n_rows, n: int) -> Column:
    """Whether a 1-based row is one of n evenly spaced ones (halves round to even)."""
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(1 + i * (n_rows - 1) / F.lit(max(1, n - 1))))
    return F.when(n_rows <= n, F.lit(True)).otherwise(F.array_contains(picks, col(index).cast("double")))
