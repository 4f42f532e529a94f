"""Shards by a Feistel permutation of global row numbers.

Rows are numbered in a fixed order. A Feistel network permutes all numbers of as many bits
as the row count has; a number that it sends past the count is sent on until it falls
within (cycle walking), which makes a permutation of exactly the rows. The place p of a row
then gives shard p % shards and slot p // shards. Both follow from the number alone, and
the inverse gives the row that a slot of a shard holds, so a reader can fetch any part of
any shard, in any order, without a table of places.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Apart, Workspace, running_total

ROUNDS = 6
#: Odd multipliers below 2**31, so that products with 32-bit halves stay within a signed 64-bit integer.
FIRST, SECOND = 0x2C1B3C6D, 0x297A2D39
LOW = (1 << 32) - 1


def round_keys(seed: int) -> list[int]:
    """One 32-bit key a round."""
    return [((seed + 1) * 0x9E3779B1 + i * 0x85EBCA77) & LOW for i in range(ROUNDS)]


def _scrambled(half: np.ndarray, key: int) -> np.ndarray:
    t = (half ^ key) * FIRST
    t = ((t ^ (t >> 29)) & LOW) * SECOND
    return (t ^ (t >> 31)) & LOW


def _widths(n: int) -> tuple[int, int]:
    bits = max(2, (n - 1).bit_length())
    return bits // 2, bits - bits // 2


def _once(x: np.ndarray, n: int, keys: list[int]) -> np.ndarray:
    wide, narrow = _widths(n)[::-1]
    left, right = x >> wide, x & ((1 << wide) - 1)
    a, b = narrow, wide  # bits of left and right; they change places in every round
    for key in keys:
        left, right = right, (left ^ _scrambled(right, key)) & ((1 << a) - 1)
        a, b = b, a
    return (left << wide) | right


def _back(x: np.ndarray, n: int, keys: list[int]) -> np.ndarray:
    wide, narrow = _widths(n)[::-1]
    left, right = x >> wide, x & ((1 << wide) - 1)
    a, b = narrow, wide
    for key in reversed(keys):
        left, right = (right ^ _scrambled(left, key)) & ((1 << b) - 1), left
        a, b = b, a
    return (left << wide) | right


def _walked(step, numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    keys = round_keys(seed)
    out = step(np.asarray(numbers, dtype=np.int64), n, keys)
    while len(far := np.flatnonzero(out >= n)):  # the domain is under 2 * n, or 4
        out[far] = step(out[far], n, keys)
    return out


def permuted(numbers: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The place of each row number under n."""
    return _walked(_once, numbers, n, seed)


def unpermuted(places: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The row number at each place under n."""
    return _walked(_back, places, n, seed)


def rows_at(shard: int, slots: np.ndarray, n: int, shards: int, seed: int = 0) -> np.ndarray:
    """The row numbers that these slots of a shard hold."""
    return unpermuted(np.asarray(slots, dtype=np.int64) * shards + shard, n, seed)


def place_column(number: str | Column, n: int, seed: int = 0) -> Column:
    """``permuted`` of a column of row numbers."""

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(permuted(x.to_numpy(np.int64), n, seed))

    return place(number)


def shuffled_shards(rows: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """All rows, with number (from 0, ascending by the columns of ``order``), shard int and
    slot long (gapless from 0 in every shard; the shards' counts differ by one at most).

    Nulls come first in the order. Rows that tie in it are numbered as they are read, so
    name columns that tie only rows that are equal where it matters; many that tie are
    still dealt to many tasks. Own columns of the new names are kept as own_<name>.
    An empty table gives none. Two runs over the same rows agree, as long as n, shards
    and seed do.
    """
    new = ("number", "shard", "slot")
    named = rows.withColumnsRenamed({c: f"own_{c}" for c in rows.columns if c.lower() in new})
    with Workspace(rows.sparkSession, "sharding") as ws:
        aside = Apart(named)
        # What was read gets its tie-breaker once, before rows move.
        read = ws.table(aside.df.withColumn("tie", F.monotonically_increasing_id()).withColumn("one", F.lit(1).cast("long")), "read")
        by = [aside[c] for c in order] + [F.col("tie")]
        held = running_total(ws, read, by, "one", "numbered")
        n = read.count()
        placed = held.withColumn("place", place_column("before", max(n, 1), seed))
        more = {"number": F.col("before"), "shard": (F.col("place") % shards).cast("int"), "slot": F.expr(f"place div {shards}")}
        return ws.result(aside.back(placed, more=more))


def write_shards(placed: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Rows with shard and slot as Parquet, a folder a shard, every file a run of
    ``rows_per_file`` slots in their order. One shuffle, by (shard, run): no run is larger
    than another."""
    run = F.expr(f"slot div {rows_per_file}")
    ranged = placed.withColumn("run", run).repartition("shard", "run").sortWithinPartitions("shard", "run", "slot")
    ranged.write.partitionBy("shard", "run").parquet(path)


def shard_report(docs: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """Per document: doc_id, size (UTF-8 bytes of the text, none for null, plus 16),
    text_crc32 (that of the empty text for null), law (``rows``: the shards' counts are at
    most one apart), shard, slot and grown_shard, which this law does not have (null).

    Documents are numbered by doc_id (null first), size and text_crc32; rows that tie in
    all three return the same values, whichever comes first. No text is shuffled.
    """
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    thin = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shuffled_shards(thin, ["doc_id", "size", "text_crc32"], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
