"""Missing values: null, NaN and infinities all count as missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """True for a number that is neither null, NaN nor infinite; never null."""
    x = col(x).cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def clean(x) -> Column:
    """The number, or null where it is not finite."""
    return F.when(finite(x), col(x))


def clean_doubles(df: DataFrame) -> DataFrame:
    """All float and double columns with NaN and infinities as null."""
    return df.withColumns({n: clean(n) for n, t in df.dtypes if t in ("double", "float")})


def holds(condition: Column) -> Column:
    """A condition of which null counts as false."""
    return F.coalesce(condition, F.lit(False))


def nonfinite_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_nonfinite) from one pass over df."""
    one = df.agg(*[F.count(F.when(~finite(c), 1)).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "n_nonfinite")


def resolve_alias(df: DataFrame, candidates: list[str]) -> str:
    """The first of the candidate columns that df has."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of the columns {candidates} is present")


def require_columns(df: DataFrame, names: list[str], label: str = "table") -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{label} lacks columns {missing}")
