"""Repeated substrings by interval expansion on Burrows-Wheeler transforms.

Where a string of ``width`` bytes starts more than once, all its occurrences have the same
minimizer (the least hash of the k-grams inside). Starts in a row with one minimizer make a
run; runs whose minimizer occurs once cannot repeat and stay where they are, and the
text of the others is shuffled by minimizer. Each task builds the Burrows-Wheeler
transform of a block of runs and extends intervals backwards, breadth first, which gives
the common prefixes of neighbouring suffixes by increasing length; it stops at ``width``:
suffixes whose common prefix is still open then are those that repeat.

Strings that a piece repeats within itself (periodic texts) enter the transform once. A
minimizer with more text than a block holds is dealt over many tasks: its strings are
compared by 128-bit hashes there, in packed rows, by buckets of the hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, as_bytes, blocks, keyed_texts, least_in_windows, mix, powers
from .passages import repeated_passages

BLOCK = 1 << 20  # bytes of one transform, more or less
HOT = 1 << 20  # bytes of one minimizer's runs, from which on they are dealt over several tasks
GRAM = 128  # bytes of a minimizer's k-gram, at most
LONG = 1 << 20  # starts of a text that are scanned at once


# The transform of one block.


START = 8  # prefixes of so many bytes are read off the packed keys


def suffix_order(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all suffixes, ordered by their first ``depth`` bytes at least; and where in
    that order the first min(START, depth) bytes change."""
    n = len(data)
    key = np.zeros(n, np.uint64)
    for j in range(START):
        key[: n - j] |= data[j:].astype(np.uint64) << np.uint64(56 - 8 * j)
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
    short = key >> np.uint64(64 - 8 * min(START, depth))
    changes = np.append(True, short[1:] != short[:-1])
    del key, short
    h = START
    while h < depth and rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[: n - h] += rank[h:] + 1
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
        del key
        h *= 2
    return order, changes


def open_prefixes(data: np.ndarray, order: np.ndarray, changes: np.ndarray, width: int) -> np.ndarray:
    """For each place of ``order``, whether that suffix and the one before it have a common
    prefix of ``width`` or more: breadth-first backward extension on the transform, from
    the intervals of all prefixes of START bytes on."""
    n = len(data)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    step = place[order - 1]  # from a suffix to the one a byte longer; text is read as a ring
    column = data[order]
    del place
    known = np.append(changes, True)
    owner = np.full(n + 1, -1, np.int32)
    low = np.flatnonzero(changes).astype(np.int32)
    high = np.append(low[1:], np.int32(n))
    for _ in range(width - min(START, width)):
        if not len(low):
            break
        size = high - low
        which = np.repeat(np.arange(len(low), dtype=np.int32), size)
        shift = np.repeat(low - (np.cumsum(size, dtype=np.int32) - size), size)
        at = step[np.arange(len(which), dtype=np.int32) + shift]
        del shift
        owner[at] = which
        near = np.minimum(at + 1, n - 1)
        last = (at + 1 == n) | (owner[at + 1] != which) | (column[near] != column[at])
        near = np.maximum(at - 1, 0)
        first = (at == 0) | (owner[at - 1] != which) | (column[near] != column[at])
        owner[at] = -1
        del which, near
        start, end = np.sort(at[first]), np.sort(at[last]) + 1
        fresh = ~known[end]
        known[end] = True
        low, high = start[fresh], end[fresh]
    return ~known[:n]


def repeated_starts(segments: list[bytes], width: int) -> np.ndarray:
    """For each byte of the segments, in turn, whether the string of ``width`` bytes that
    starts there (within its segment) starts elsewhere too."""
    data = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)  # no byte of UTF-8
    order, changes = suffix_order(data, width)
    joined = open_prefixes(data, order, changes, width)
    again = joined.copy()
    again[:-1] |= joined[1:]
    out = np.empty(len(data), bool)
    out[order] = again
    return out


# Minimizer runs.


def gram_size(width: int) -> int:
    return max(1, min(GRAM, width // 2))


def minimizer_runs(texts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with one minimizer: (minimizer, text, first start, starts, how many
    places the minimizer has in the run, first place)."""
    k = gram_size(width)
    w = width - k + 1
    buf = np.frombuffer(b"".join(texts), np.uint8)
    n = len(buf)
    if n < width:
        return tuple(np.empty(0, t) for t in (np.uint64, *[np.int64] * 5))
    up, down = powers(n + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n])))
    gram = mix((total[k:] - total[:-k]) * down[: n - k + 1])
    least = least_in_windows(gram, w)
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(least)]
    start = np.flatnonzero(ends[owner] - np.arange(len(least)) >= width)
    if not len(start):
        return tuple(np.empty(0, t) for t in (np.uint64, *[np.int64] * 5))
    owner = owner[start]
    place = least[start]
    value = gram[place]
    new = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))
    first = np.flatnonzero(new)
    places = np.add.reduceat((np.append(True, place[1:] != place[:-1]) | new).astype(np.int64), first)
    base = (ends - lengths)[owner[first]]
    return value[first], owner[first], start[first] - base, np.diff(np.append(first, len(start))), places, place[first] - base


def stretches(texts: list[bytes], width: int, long: int) -> tuple[list[int], list[int], list[bytes]]:
    """Text numbers, first starts and bytes of the stretches of at most ``long`` starts."""
    out = [(i, lo, t if len(t) < long + width else t[lo : lo + long + width - 1]) for i, t in enumerate(texts) for lo in range(0, max(1, len(t) - width + 1), long)]
    return [list(x) for x in zip(*out, strict=True)] if out else [[], [], []]


def _runs(docs: DataFrame, width: int) -> DataFrame:
    """A row a document (value null, count its bytes), and one a run of starts."""
    long = LONG

    def scan(batches):
        import pyarrow as pa

        names = ["doc_id", "text_key", "value", "start", "count", "places", "place"]
        for batch in batches:
            texts = as_bytes(batch.column(1))
            none = np.zeros(len(texts), np.int64)
            numbers = [none, np.array([len(t) for t in texts], np.int64), none, none]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.nulls(len(texts), pa.int64()), *map(pa.array, numbers)], names=names)
            of, base, parts = stretches(texts, width, long)
            of, base = np.array(of, np.int64), np.array(base, np.int64)
            for lo, hi in blocks(parts):
                value, owner, start, count, places, place = minimizer_runs(parts[lo:hi], width)
                rows = pa.array(of[lo:hi][owner])
                own = [batch.column(i).take(rows) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(value.view(np.int64)), *map(pa.array, (start + base[lo:hi][owner], count, places, place - start))], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed_texts(docs).mapInArrow(scan, f"doc_id {kind}, text_key binary, value long, start long, count long, places long, place long")


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def trimmed(group: list[tuple[bytes, int]], width: int) -> list[tuple[int, int]]:
    """Of each piece (text, place) of one minimizer, the starts that may repeat. Every
    string contains the k-gram with half of the rest on its left, or on its right; where
    no other piece has that half, starts on that side go."""
    k = gram_size(width)
    half = (width - k) // 2
    left, right = {}, {}
    for text, at in group:
        for side, part in ((left, text[max(0, at - half) : at + k]), (right, text[at : at + k + half])):
            side[part] = side.get(part, 0) + 1
    out = []
    for text, at in group:
        lo, hi = 0, len(text) - width + 1
        if left[text[max(0, at - half) : at + k]] < 2:
            lo = max(lo, min(hi, at - half + 1))
        if right[text[at : at + k + half]] < 2:
            hi = min(hi, max(lo, at + k + half - width))
        out.append((lo, hi))
    return out


def repeats_within(text: bytes, width: int, lo: int, hi: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Whether each start of [lo, hi) has its string of ``width`` bytes elsewhere among them,
    and the ranges of starts that together have each string once."""
    data = np.frombuffer(text, np.uint8)[lo : hi + width - 1]
    n = hi - lo
    up, down = powers(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])))
    _, first, of = np.unique((total[width:] - total[:-width]) * down[:n], return_index=True, return_inverse=True)
    back = np.arange(n) - first[of]  # how far behind the first string of that hash
    again, later = np.zeros(n, bool), np.zeros(n, bool)
    edge = np.append(np.flatnonzero(np.diff(back, prepend=-1)), n)
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        d = back[a]
        if d and np.array_equal(data[a : b + width - 1], data[a - d : b - d + width - 1]):
            later[a:b] = again[a:b] = again[a - d : b - d] = True
    return again, [(lo + int(a), lo + int(b)) for a, b in zip(*_spans(~later), strict=True)]


class Solver:
    """Collects the distinct pieces of minimizers and solves them block by block."""

    def __init__(self, width: int):
        self.width, self.size, self.jobs, self.texts = width, 0, [], []

    def add(self, rows: list[tuple]) -> None:
        """rows of one minimizer: (key, text, places, place, copies)."""
        starts = [len(r[1]) - self.width + 1 for r in rows]
        cut = [(0, n) for n in starts]
        if len(rows) > 1 and all(r[2] == 1 for r in rows):
            cut = trimmed([(r[1], r[3]) for r in rows], self.width)
        for (key, text, places, _, copies), n, (lo, hi) in zip(rows, starts, cut, strict=True):
            flags, ranges = np.zeros(n, bool), [(lo, hi)] if hi > lo and (len(rows) > 1 or places > 1) else []
            if places > 1 and hi > lo:
                flags[lo:hi], ranges = repeats_within(text, self.width, lo, hi)
            if copies > 1:
                flags[:] = True
            parts = []
            for a, b in ranges:
                parts.append((a, b, self.size))
                self.texts.append(text[a : b + self.width - 1])
                self.size += b - a + self.width
            if parts or copies > 1 or places > 1:
                self.jobs.append((key, flags, parts))

    def solve(self) -> list[tuple]:
        """(key, begins, ends): the repeated starts of each piece that has some."""
        out = []
        flags = repeated_starts(self.texts, self.width) if self.texts else np.empty(0, bool)
        for key, mine, parts in self.jobs:
            for a, b, at in parts:
                mine[a:b] |= flags[at : at + b - a]
            if mine.any():
                out.append((key, *_spans(mine)))
        self.size, self.jobs, self.texts = 0, [], []
        return out


def hashed_starts(rows: list[tuple], width: int, buckets: int) -> list[tuple[int, bytes]]:
    """(bucket, packed): the starts of rows (key, text, ...) by hash. Packed entries are the
    piece's key (16 bytes), the start (8) and the hash of its string (16)."""
    out: dict[int, list[bytes]] = {}
    for key, text, *_ in rows:
        for i in range(len(text) - width + 1):
            h = hashlib.blake2b(text[i : i + width], digest_size=16).digest()
            out.setdefault(int.from_bytes(h[:8], "big") % buckets, []).append(key + i.to_bytes(8, "big") + h)
    return [(k, b"".join(v)) for k, v in out.items()]


def equal_starts(packed: list[bytes]) -> list[tuple]:
    """(key, begins, ends) of the packed starts whose hash is there more than once."""
    entries = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, 40)
    at = np.ascontiguousarray(entries[:, 16:24]).view(">i8")[:, 0]
    h = np.ascontiguousarray(entries[:, 24:]).view(">u8")
    order = np.lexsort((h[:, 1], h[:, 0]))
    same = (h[order][1:] == h[order][:-1]).all(1)
    some = order[np.append(same, False) | np.append(False, same)]
    raw = [entries[i, :16].tobytes() for i in some]
    by: dict[bytes, list[int]] = {}
    for k, i in zip(raw, at[some].tolist(), strict=True):
        by.setdefault(k, []).append(i)
    return [(k, np.array(v), np.array(v) + 1) for k, v in by.items()]


def remove_repeats(docs: DataFrame, width: int = 400, words: int | None = None) -> DataFrame:
    """Texts without the bytes of strings of ``width`` bytes that start more than once.

    docs: doc_id, text (as UTF-8 bytes; null: empty). Every byte covered by such a string
    goes, in all its occurrences, in one document or several; strings overlap freely, do
    not cross documents, and are judged on the input. Returns a row a row of docs: doc_id,
    n_bytes, n_removed, n_spans (maximal removed runs), kept (binary). Equal texts are
    solved once; texts shorter than ``width`` lose nothing. Other columns are ignored.

    With ``words``, passages of so many words that stand in another row too are counted
    beside it, whatever their bytes, and stay in the text: n_passage_words (words that they
    cover) and n_passages (maximal runs) follow.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "repeats")
    with ws:
        scanned = ws.table(_runs(docs, width), "runs")
        texts = scanned.where("value is null").groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        texts = ws.table(texts, "texts")
        runs = scanned.where("value is not null").drop("doc_id")
        short = F.xxhash64("text_key")
        values = runs.select("value", "start", "count", "places", short.alias("of")).groupBy("value").agg(
            F.min("of").alias("a"), F.max("of").alias("b"), F.min("start").alias("c"), F.max("start").alias("d"), F.max("places").alias("p"), F.sum(F.col("count") + (width - 1)).alias("bytes")
        )
        values = values.where("a <> b or c <> d or p > 1").select("value", F.ceil(F.col("bytes") / HOT).cast("int").alias("split"))
        hits = runs.join(values, "value").groupBy("text_key").agg(F.collect_set(F.struct("value", "start", "count", "places", "place", "split")).alias("hits"))
        hits = ws.table(hits.join(texts, "text_key").select("first_id", F.col("text_key").alias("of_key"), "hits"), "hits")
        ws.drop("runs")
        keyed = keyed_texts(docs)
        found = keyed.join(hits, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("of_key"))).select("text", "text_key", "hits")

        def emit(batches):
            import pyarrow as pa

            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
            for batch in batches:
                for lo in range(0, batch.num_rows, 200):
                    part, rows = batch.slice(lo, 200), []
                    for text, key, spans in zip(as_bytes(part.column(0)), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                        for h in spans:
                            piece = text[h["start"] : h["start"] + h["count"] + width - 1]
                            own = hashlib.blake2b(piece, digest_size=16).digest()
                            rows.append((h["value"], int.from_bytes(own[:4], "big") % h["split"], own, key, h["start"], h["places"], h["place"], piece, h["split"]))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["value", "salt", "piece_key", "text_key", "start", "places", "place", "piece", "split"])

        pieces = ws.table(found.mapInArrow(emit, "value long, salt int, piece_key binary, text_key binary, start long, places long, place long, piece binary, split int"), "pieces")
        # Equal pieces are summed before they meet: a passage with the same surroundings in
        # any number of documents is one row.
        distinct = pieces.groupBy("value", "salt", "piece_key").agg(F.first("piece").alias("piece"), F.max("places").alias("places"), F.min("place").alias("place"), F.count(F.lit(1)).alias("copies"), F.first("split").alias("split"))
        dealt = distinct.repartition("value", "salt").sortWithinPartitions("value", "salt")

        def solve(batches):
            import pyarrow as pa

            solver, group, at = Solver(width), [], None
            types = (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.binary())
            names = ["piece_key", "begins", "ends", "value", "bucket", "packed"]

            def batch_of(rows):
                columns = zip(*rows, strict=True) if rows else [[]] * 6
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

            def hashed(rows, value):
                """Starts in six buckets a block: an entry has 40 bytes, a start some four of its text's.
                A piece that stands in several texts repeats as a whole."""
                whole = [(r[0], [0], [len(r[1]) - width + 1], None, None, None) for r in rows if r[4] > 1]
                return batch_of([*whole, *((None, None, None, value, k, x) for k, x in hashed_starts(rows, width, 6 * rows[0][5]))])

            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                for value, salt, *row in zip(*columns, strict=True):
                    if (value, salt) != at:
                        if solver.size and solver.size + sum(len(r[1]) for r in group) > BLOCK:
                            yield batch_of([(*r, None, None, None) for r in solver.solve()])
                        if group and group[0][5] == 1:
                            solver.add([r[:5] for r in group])
                        elif group:
                            yield hashed(group, at[0])
                        group, at = [], (value, salt)
                    group.append(row)
            if group and group[0][5] == 1:
                solver.add([r[:5] for r in group])
            elif group:
                yield hashed(group, at[0])
            yield batch_of([(*r, None, None, None) for r in solver.solve()])

        solved = dealt.select("value", "salt", "piece_key", "piece", "places", "place", "copies", "split").mapInArrow(solve, "piece_key binary, begins array<bigint>, ends array<bigint>, value long, bucket int, packed binary")
        solved = ws.table(solved, "solved")

        def compare(batches):
            import pyarrow as pa

            packed, at = [], None

            def found():
                columns = zip(*equal_starts(packed), strict=True) if packed else []
                columns = [*columns] or [[]] * 3
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names=["piece_key", "begins", "ends"])

            for batch in batches:
                for value, bucket, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (value, bucket) != at:
                        yield found()
                        packed, at = [], (value, bucket)
                    packed.append(x)
            yield found()

        late = solved.where("packed is not null").select("value", "bucket", "packed").repartition("value", "bucket").sortWithinPartitions("value", "bucket")
        late = late.mapInArrow(compare, "piece_key binary, begins array<bigint>, ends array<bigint>")
        spans = solved.where("packed is null").select("piece_key", "begins", "ends").unionByName(late)
        spans = pieces.select("piece_key", "text_key", "start").join(spans, "piece_key")
        spans = spans.groupBy("text_key").agg(F.collect_list(F.struct("start", "begins", "ends")).alias("spans"))
        known = texts.where("copies > 1").select("text_key", "copies").join(spans, "text_key", "full")
        counted = ["n_passage_words", "n_passages"] if words else []
        if words:
            known = known.join(repeated_passages(ws, docs, words), "text_key", "full")
        known = ws.result(known.select(F.col("text_key").alias("of_key"), F.coalesce("copies", F.lit(1)).alias("copies"), "spans", *counted))
        counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counted]
        owned = keyed.join(known, F.col("text_key") == F.col("of_key"), "left").select("doc_id", "text", F.coalesce("copies", F.lit(1)).alias("copies"), "spans", *counts)

        def cut(batches):
            import pyarrow as pa

            for batch in batches:
                n_bytes, removed, n_spans, kept = [], [], [], []
                for text, copies, found_spans in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    gone = np.zeros(len(text) + 1, np.int64)
                    if copies > 1 and len(text) >= width:
                        gone[0], gone[-1] = 1, -1
                    for s in found_spans or ():
                        np.add.at(gone, np.array(s["begins"]) + s["start"], 1)
                        np.add.at(gone, np.array(s["ends"]) + (s["start"] + width - 1), -1)
                    flags = np.cumsum(gone[:-1]) > 0
                    n_bytes.append(len(text)), removed.append(int(flags.sum())), n_spans.append(len(_spans(flags)[0]))
                    kept.append(np.frombuffer(text, np.uint8)[~flags].tobytes() if flags.any() else text)
                arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, removed, n_spans)), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays([*arrays, *batch.columns[4:]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *counted])

        kind = docs.schema["doc_id"].dataType.simpleString()
        return owned.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary" + "".join(f", {c} long" for c in counted))
