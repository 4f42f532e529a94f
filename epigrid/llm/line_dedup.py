"""Boilerplate lines by their frequency relative to their site.

Within each host, the pages that contain a line divided by all pages of the host;
lines above a ratio go. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Apart, Workspace

#: Boilerplate sets of up to so many lines are broadcast, larger ones joined.
BROADCAST_LINES = 200_000


def _lines(text):
    return F.split(text, "\n", -1)


def _key(line):
    """128-bit hash of a line without white space at its ends; blank lines have none. Two
    of 1e10 lines have one hash with a chance of 1e-19."""
    bare = F.btrim(line, F.lit(" \t\r\f\x0b"))
    return F.when(bare != "", F.unhex(F.md5(bare)))


def boilerplate_lines(pages: DataFrame, host: str, ratio: float, least_pages: int) -> DataFrame:
    """(host, line, pages, host_pages): hashes of the lines above ``ratio`` in their host,
    on at least ``least_pages`` pages. A line counts once a page; pages without text count."""
    named = pages.select(F.col(host).alias("host"), F.array_distinct(F.transform(_lines(F.col("text")), _key)).alias("keys"))
    totals = named.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    lines = named.select("host", F.explode("keys").alias("line")).where("line is not null")
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least_pages)
    t = totals.withColumnRenamed("host", "t_host")
    return counts.join(t, counts["host"].eqNullSafe(t["t_host"])).drop("t_host").where(F.col("pages") > ratio * F.col("host_pages"))


def drop_boilerplate(pages: DataFrame, host: str = "source", ratio: float = 0.1, least_pages: int = 3) -> DataFrame:
    """pages with the boilerplate lines of their host taken out of ``text``; rows and
    other columns stay, in number and value, and removed_lines (long) comes last.

    Lines end at "\\n" and are compared without white space at their ends; blank lines
    are never boilerplate. Null text stays null (0 removed), a null host is a host of
    its own, repeated rows count as pages. A page of nothing but boilerplate ends up
    with empty text. ``removed_lines`` replaces a column of that name.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "lines")
    bad = ws.result(boilerplate_lines(pages, host, ratio, least_pages).groupBy("host").agg(F.collect_set("line").alias("lines"), F.count(F.lit(1)).alias("n")))
    # At most (lines of a mean page) / ratio lines a host can be above the ratio.
    total = bad.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bad = bad.select(F.col("host").alias("bad_host"), F.col("lines").alias("bad"))
    apart = Apart(pages)
    text, own_host = apart["text"], apart[host]
    if total <= BROADCAST_LINES:
        joined = apart.df.join(F.broadcast(bad), own_host.eqNullSafe(F.col("bad_host")), "left")
    else:  # a hot host is dealt over salted copies of its short list
        salts = 64
        bad = bad.withColumn("bad_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = apart.df.withColumn("salt", F.pmod(F.xxhash64(text), F.lit(salts)).cast("int"))
        joined = salted.join(bad, own_host.eqNullSafe(F.col("bad_host")) & (F.col("salt") == F.col("bad_salt")), "left")
    lines = _lines(text)
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("bad", _key(x)), F.lit(False)))
    clean = F.when(F.col("bad").isNull(), text).otherwise(F.array_join(kept, "\n"))
    removed = F.when(F.col("bad").isNull() | text.isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept)).cast("long")
    return apart.back(joined, {"text": clean}, {"removed_lines": removed}, without=("removed_lines",))
