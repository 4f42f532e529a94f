"""Passages of many words that stand in more than one text, counted and left in place.

Where a string of ``words`` words stands in two texts, both have the same minimizer there
(the least hash of the k-word grams inside). Starts in a row with one minimizer make a
run; only runs whose minimizer stands in another text too are looked at again. Their
strings meet by minimizer, as 64-bit hashes in packed rows. The strings of a minimizer
with many are grouped one by one instead, and summed before they meet.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, as_bytes, blocks, keyed_texts, least_in_windows, mix, powers, word_hashes

GRAM = 16  # words of a minimizer's gram, at most
BLOCK = 1 << 18  # strings compared at once, more or less
HOT = 1 << 14  # strings of one minimizer, beyond which they do not meet in one task


def _strings(total: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` words, from the running sums of the words' hashes."""
    _, down = powers(len(total))
    return mix((total[width:] - total[:-width]) * down[: len(total) - width])


def _running(words: np.ndarray) -> np.ndarray:
    up, _ = powers(len(words) + 1)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])))


def passage_runs(texts: list[bytes], words: int) -> tuple[np.ndarray, ...]:
    """Words of each text, then runs of starts with one minimizer: (minimizer, text, first start, starts)."""
    h, at = word_hashes(texts)
    sizes = np.diff(at)
    if len(h) < words:
        return (sizes, *(np.empty(0, t) for t in (np.uint64, *[np.int64] * 3)))
    k = max(1, min(GRAM, words // 2))
    gram = _strings(_running(h), k)
    place = least_in_windows(gram, words - k + 1)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(place)]
    start = np.flatnonzero(at[1:][owner] - np.arange(len(place)) >= words)
    if not len(start):
        return (sizes, *(np.empty(0, t) for t in (np.uint64, *[np.int64] * 3)))
    owner, value = owner[start], gram[place[start]]
    first = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])))
    return sizes, value[first], owner[first], start[first] - at[owner[first]], np.diff(np.append(first, len(start)))


def in_other_texts(text: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """For each string (a hash), whether another text has it."""
    order = np.argsort(strings)
    s, t = strings[order], text[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    several = np.minimum.reduceat(t, first) != np.maximum.reduceat(t, first)
    out = np.empty(len(strings), bool)
    out[order] = np.repeat(several, np.diff(np.append(first, len(s))))
    return out


def _scan(docs: DataFrame, words: int) -> DataFrame:
    """A row a document (value null, count its words), and one a run of starts."""

    def scan(batches):
        import pyarrow as pa

        names = ["doc_id", "text_key", "value", "start", "count"]
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for lo, hi in blocks(texts):
                sizes, value, owner, start, count = passage_runs(texts[lo:hi], words)
                own = [batch.column(i).slice(lo, hi - lo) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.nulls(hi - lo, pa.int64()), *map(pa.array, (np.zeros(hi - lo, np.int64), sizes))], names=names)
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in own), pa.array(value.view(np.int64)), *map(pa.array, (start, count))], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed_texts(docs).mapInArrow(scan, f"doc_id {kind}, text_key binary, value long, start long, count long")


def repeated_passages(ws: Workspace, docs: DataFrame, words: int = 50) -> DataFrame:
    """Of each text with a string of ``words`` words that stands in another row of docs too,
    how many of its words such strings cover, and in how many maximal runs.

    docs: doc_id, text. Words are runs of bytes other than white space, A-Z read as a-z; any
    white space separates them. A text that several rows have is a passage as a whole. Returns
    text_key, n_passage_words, n_passages; it is read before the block of ``ws`` ends.
    """
    scanned = ws.table(_scan(docs, words), "passage-runs")
    texts = scanned.where("value is null").groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.max("count").alias("n_words"))
    texts = ws.table(texts.where(F.col("n_words") >= words), "passage-texts")
    runs = scanned.where("value is not null").select("text_key", "value", "start", "count")
    of = F.xxhash64("text_key")
    values = runs.select("value", "count", of.alias("of")).groupBy("value").agg(F.min("of").alias("a"), F.max("of").alias("b"), F.sum("count").alias("strings"))
    values = values.where("a <> b").select("value", (F.col("strings") > HOT).alias("hot"))
    # Texts that several rows have are passages as a whole, but are still what others share.
    hits = runs.join(values, "value").groupBy("text_key").agg(F.collect_set(F.struct("value", "start", "count", "hot")).alias("hits"))
    hits = hits.join(texts, "text_key").select("first_id", F.col("text_key").alias("of_key"), "hits")
    found = keyed_texts(docs).join(hits, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("of_key"))).select("text", "text_key", "hits")

    def emit(batches):
        import pyarrow as pa

        kinds = {"value": pa.int64(), "text_key": pa.binary(), "start": pa.int64(), "strings": pa.binary(), "string": pa.int64()}
        for batch in batches:
            texts, keys, spans = as_bytes(batch.column(0)), batch.column(1), batch.column(2)
            for lo, hi in blocks(texts):
                h, at = word_hashes(texts[lo:hi])
                strings, rows, hot = _strings(_running(h), words), [], []
                for i, s in enumerate(spans.slice(lo, hi - lo).to_pylist()):
                    for x in s:
                        if x["hot"]:
                            hot.append((i, x["start"], x["count"]))
                        else:
                            begin = at[i] + x["start"]
                            rows.append((x["value"], keys[lo + i].as_py(), x["start"], strings[begin : begin + x["count"]].tobytes(), None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))
                if hot:
                    i, first, count = np.array(hot).T
                    start = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                    i = np.repeat(i, count)
                    none = [pa.nulls(len(i), kinds[c]) for c in ("value", "strings")]
                    yield pa.RecordBatch.from_arrays([none[0], keys.take(pa.array(lo + i)), pa.array(start), none[1], pa.array(strings[at[i] + start].view(np.int64))], names=list(kinds))

    met = ws.table(found.mapInArrow(emit, "value long, text_key binary, start long, strings binary, string long"), "passage-strings")

    def compare(batches):
        import pyarrow as pa

        rows, size, last = [], 0, None

        def shared():
            keys = {}
            sizes = np.array([len(r[2]) // 8 for r in rows], np.int64)
            text = np.repeat(np.array([keys.setdefault(r[0], len(keys)) for r in rows], np.int64), sizes)
            start = np.repeat(np.array([r[1] for r in rows], np.int64) - np.cumsum(sizes) + sizes, sizes) + np.arange(len(text))
            again = in_other_texts(text, np.frombuffer(b"".join(r[2] for r in rows), np.uint64)) if rows else np.empty(0, bool)
            text, start = text[again], start[again]
            order = np.argsort(text, kind="stable")
            text, start = text[order], start[order]
            first = np.flatnonzero(np.diff(text, prepend=-1))
            names = list(keys)
            starts = pa.ListArray.from_arrays(pa.array(np.append(first, len(text)).astype(np.int32)), pa.array(start))
            return pa.RecordBatch.from_arrays([pa.array([names[t] for t in text[first]], pa.binary()), starts], names=["text_key", "starts"])

        for batch in batches:
            for value, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if value != last and size > BLOCK:
                    yield shared()
                    rows, size = [], 0
                last = value
                rows.append(row)
                size += len(row[2]) // 8
        yield shared()

    few = met.where("string is null").select("value", "text_key", "start", "strings").repartition("value").sortWithinPartitions("value")
    many = met.where("string is not null").select("text_key", "start", "string")
    again = many.select("string", of.alias("of")).groupBy("string").agg(F.min("of").alias("a"), F.max("of").alias("b")).where("a <> b").select("string")
    late = many.join(again, "string", "left_semi").groupBy("text_key").agg(F.collect_list("start").alias("starts"))
    starts = few.mapInArrow(compare, "text_key binary, starts array<bigint>").unionByName(late).groupBy("text_key").agg(F.array_sort(F.flatten(F.collect_list("starts"))).alias("s"))
    steps = F.zip_with(F.slice("s", 2, F.size("s")), F.slice("s", 1, F.size("s") - 1), lambda b, a: b - a)
    starts = starts.select("text_key", "s", steps.alias("steps"))
    covered = F.aggregate("steps", F.lit(words).cast("long"), lambda total, d: total + F.least(d, F.lit(words).cast("long")))
    counts = starts.select("text_key", covered.alias("covered"), (F.size(F.filter("steps", lambda d: d > words)) + 1).cast("long").alias("n_passages"))
    counts = texts.where("copies > 1").select("text_key", "n_words").join(counts, "text_key", "full")
    return counts.select("text_key", F.coalesce("n_words", "covered").alias("n_passage_words"), F.when(F.col("n_words").isNull(), F.col("n_passages")).otherwise(F.lit(1)).cast("long").alias("n_passages"))
