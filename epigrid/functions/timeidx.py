"""ISO weeks: labels, starts, sequences and coarser buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .nulls import col


def iso_year(d) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), col(d))


def iso_week(d) -> Column:
    return F.weekofyear(col(d))


def with_week(df: DataFrame, date: str, year: str = "epiyear", week: str = "epiweek") -> DataFrame:
    return df.withColumns({year: iso_year(date).cast("int"), week: iso_week(date).cast("int")})


def week_start(year, week) -> Column:
    """Monday of the week; week 53 of a year without one rolls into the next year."""
    jan4 = F.make_date(col(year), F.lit(1), F.lit(4))
    return F.date_add(jan4, (-F.weekday(jan4) + 7 * (col(week) - 1)).cast("int"))


def week_end(year, week) -> Column:
    return F.date_add(week_start(year, week), 6)


def week_label(year, week) -> Column:
    return F.format_string("%04d-W%02d", col(year).cast("int"), col(week).cast("int"))


def parse_week_label(label) -> tuple[Column, Column]:
    """Year and week of a label, with or without leading zeros; null for other text."""
    year = F.regexp_extract(col(label), r"^(\d{4})-W(\d{1,2})$", 1)
    week = F.regexp_extract(col(label), r"^(\d{4})-W(\d{1,2})$", 2)
    return F.nullif(year, F.lit("")).cast("int"), F.nullif(week, F.lit("")).cast("int")


def week_key(year, week) -> Column:
    return col(year) * 100 + col(week)


def before_week(year, week, cutoff_year: int, cutoff_week: int) -> Column:
    return week_key(year, week) < cutoff_year * 100 + cutoff_week


def week_index(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(epiyear, epiweek, time_index): the weeks of all days from start to end, 1..T."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}', INTERVAL 1 DAY)) AS day")
    return index_weeks(days, "day")


def index_weeks(df: DataFrame, date: str) -> DataFrame:
    """The distinct weeks of a date column, numbered from 1 (weeks are few)."""
    weeks = with_week(df.select(F.to_date(date).alias(date)).where(F.col(date).isNotNull()).distinct(), date).select("epiyear", "epiweek").distinct()
    return weeks.withColumn("time_index", F.row_number().over(Window.orderBy("epiyear", "epiweek")))


def last_complete_week(df: DataFrame, date: str) -> DataFrame:
    """One row (last_date, epiyear, epiweek, week_end): the week of the last date if its
    Sunday is not after it, else the week before."""
    last = df.agg(F.max(F.to_date(date)).alias("last_date"))
    monday = F.date_sub("last_date", F.weekday("last_date"))
    full = F.date_add(monday, 6) <= F.col("last_date")
    start = F.when(full, monday).otherwise(F.date_sub(monday, 7))
    out = last.select("last_date", start.alias("start"))
    return out.select("last_date", iso_year("start").cast("int").alias("epiyear"), iso_week("start").cast("int").alias("epiweek"), F.date_add("start", 6).alias("week_end"))


def time_buckets(weeks: DataFrame) -> DataFrame:
    """Adds week_start, timestep, and two-week, quarter, half-year and year indices, which
    count from the first week."""
    w = weeks.withColumn("week_start", week_start("epiyear", "epiweek"))
    first = w.agg(F.min("week_start").alias("_first"))
    w = w.crossJoin(F.broadcast(first))
    months = (F.year("week_start") - F.year("_first")) * 12 + F.month("week_start") - F.month("_first")
    return w.select(
        *weeks.columns, "week_start", F.col("time_index").alias("timestep"), F.floor((F.col("time_index") + 1) / 2).cast("int").alias("timestep_2wk"),
        (F.floor(months / 3) + 1).cast("int").alias("quarter_index"), (F.floor(months / 6) + 1).cast("int").alias("sixmo_index"),
        F.dense_rank().over(Window.orderBy(F.year("week_start"))).alias("year_index"),
    )


def parse_dates(df: DataFrame, column: str, formats: tuple[str, ...] = ("yyyy-MM-dd", "yyyy/MM/dd"), out: str = "date") -> DataFrame:
    """Dates in the one format that fits the first value present (the least, in the order
    of the text, so that the choice does not hang on row order); others become null."""
    first = df.agg(*[F.min(F.when(F.try_to_timestamp(F.col(column), F.lit(f)).isNotNull(), F.col(column))).alias(str(i)) for i, f in enumerate(formats)]).first()
    chosen = next((f for i, f in enumerate(formats) if first[str(i)] is not None), formats[0])
    return df.withColumn(out, F.to_date(F.try_to_timestamp(F.col(column), F.lit(chosen))))


def day_of_year_date(year, day) -> Column:
    return F.date_add(F.make_date(col(year), F.lit(1), F.lit(1)), (col(day) - 1).cast("int"))


def decimal_year_date(x) -> Column:
    """Date of a decimal year; leap years have 366 days."""
    year = F.floor(col(x)).cast("int")
    days = F.date_diff(F.make_date(year + 1, F.lit(1), F.lit(1)), F.make_date(year, F.lit(1), F.lit(1)))
    return day_of_year_date(year, F.floor((col(x) - year) * days) + 1)
