"""Best-fit packing of tokenized documents by linear grouping.

All that packing needs to know of the documents is how many pieces have each length,
at most ``capacity`` numbers. Over those the driver rounds large lengths up within
groups of equal cardinality, chooses configurations of the few sizes by column
generation, lets the actual lengths take the places of the rounded ones, and fills
what is left with small lengths by best fit. The outcome is a bounded table: the
pieces of a length, in some order, from rank r on go to sequences s, s+1, ... at an
offset. Ranking the pieces and looking their place up is done by Spark.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_BATCHES, Workspace, few_rows, lean
from .tokens import token_ids

RANKED = 200_000  # pieces of one length that are ranked in one group
BROADCAST_SHARES = 100_000  # groups whose first ranks are broadcast; more are joined


# The plan over the histogram of lengths.


def group_sizes(counts: np.ndarray, least: int, groups: int) -> list[tuple[int, int, int]]:
    """Large lengths in groups of about equal cardinality, by falling length: (largest,
    smallest, pieces). Pieces of one length stay in one group."""
    lengths = [int(x) for x in np.flatnonzero(counts)[::-1] if x >= least]
    each = max(1, -(-int(sum(counts[x] for x in lengths)) // groups))
    out, top, n, low = [], None, 0, 0
    for x in lengths:
        if top is not None and n + counts[x] > each and n:
            out.append((top, low, n))
            top, n = None, 0
        top, low, n = top or x, x, n + int(counts[x])
    return out + ([(top, low, n)] if n else [])


def best_configuration(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack over few large sizes: at most capacity / min(sizes) items."""
    best, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        new, pick = best.copy(), np.full(capacity + 1, -1)
        for i, s in enumerate(sizes):
            if value[i] > 1e-12:
                gain = best[: capacity + 1 - s] + value[i]
                better = gain > new[s:] + 1e-12
                new[s:][better], pick[s:][better] = gain[better], i
        picks.append(pick)
        if np.array_equal(new, best):
            break
        best = new
    config, room = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(picks):
        if (i := pick[room]) >= 0:
            config[i] += 1
            room -= int(sizes[i])
    return float(value @ config), config


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Configurations and how many sequences take each: the linear relaxation by column
    generation (revised simplex), rounded down. What is left of the demand is the caller's."""
    k = len(sizes)
    columns = np.diag(np.maximum(1, capacity // sizes)).astype(float)
    use = demand / np.diag(columns)
    for _ in range(rounds):
        price = np.linalg.solve(columns.T, np.ones(k))
        worth, config = best_configuration(sizes, price, capacity)
        if worth <= 1 + 1e-9:
            break
        step = np.linalg.solve(columns, config.astype(float))
        use = np.maximum(use, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-10, use / step, np.inf)
        out = int(np.argmin(ratio))
        theta = ratio[out]
        use = use - theta * step
        use[out] = theta
        columns[:, out] = config
    left, result = demand.astype(np.int64).copy(), []
    for j in np.argsort(-use):
        config = columns[:, j].astype(np.int64)
        n = int(np.floor(use[j] + 1e-7))
        if config.any():
            n = min(n, int(np.min(left[config > 0] // config[config > 0])))
            if n > 0:
                result.append((config, n))
                left -= n * config
    return result


class Runs:
    """Sequences in runs that look alike: a run of n sequences holds, for each of its
    items, the pieces of one length with ranks r, r+1, ... in turn."""

    def __init__(self, capacity: int):
        self.capacity, self.open, self.rooms = capacity, defaultdict(list), []

    def add(self, room: int, n: int, items: tuple) -> None:
        if n:
            if not self.open[room]:
                insort(self.rooms, room)
            self.open[room].append((n, items))

    def take(self, need: int, most: int):
        """Up to ``most`` sequences of the tightest room that fits, or none."""
        at = bisect_left(self.rooms, need)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        n, items = self.open[room].pop()
        if n > most:
            self.open[room].append((n - most, tuple((x, r + most) for x, r in items)))
            n = most
        if not self.open[room]:
            self.rooms.pop(at)
        return room, n, items

    def place(self, length: int, first: int, count: int) -> None:
        """Best fit for ``count`` pieces of a length, opening sequences when none fits."""
        while count:
            got = self.take(length, count)
            if got is None:
                fit = self.capacity // length
                for each, n in ((fit, count // fit), (count % fit, 1)):
                    if each and n:
                        self.add(self.capacity - each * length, n, tuple((length, first + j * n) for j in range(each)))
                        first, count = first + each * n, count - each * n
                return
            room, n, items = got
            self.add(room - length, n, (*items, (length, first)))
            first, count = first + n, count - n


def packing_plan(counts: np.ndarray, capacity: int, groups: int = 400, small: int = 4) -> np.ndarray:
    """Rows (length, first rank, sequences, first sequence, offset) that place every piece
    of every length once. ``counts[x]`` pieces have length x, 1 <= x <= capacity."""
    counts = counts.astype(np.int64)
    least = max(1, capacity // small)
    grouped = group_sizes(counts, least, groups)
    used = np.zeros(capacity + 1, np.int64)
    runs = Runs(capacity)
    if grouped:
        sizes, demand = np.array([g[0] for g in grouped]), np.array([g[2] for g in grouped])
        # Within a group the actual pieces come by falling length.
        supply = [[[x, int(counts[x])] for x in range(top, low - 1, -1) if counts[x]] for top, low, _ in grouped]
        for config, n in configurations(sizes, demand, capacity):
            slots = [g for g, times in enumerate(config) for _ in range(times)]
            while n:
                # Alike as long as every slot's next length lasts; a group with several
                # slots whose next length is too short for all of them goes one by one.
                m = min([n] + [max(1, supply[g][0][1] // slots.count(g)) for g in set(slots)])
                items = []
                for g in slots:
                    x = supply[g][0][0]
                    items.append((x, int(used[x])))
                    used[x] += m
                    supply[g][0][1] -= m
                    if not supply[g][0][1]:
                        supply[g].pop(0)
                runs.add(capacity - sum(x for x, _ in items), m, tuple(items))
                n -= m
    for x in range(capacity, 0, -1):
        if counts[x] - used[x]:
            runs.place(x, int(used[x]), int(counts[x] - used[x]))
    rows, sequence = [], 0
    for same in runs.open.values():
        for n, items in same:
            offset = 0
            for x, r in items:
                rows.append((x, r, n, sequence, offset))
                offset += x
            sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


# Spark's part.


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and ``end_id``; only
    what is longer than ``capacity`` is cut, and only its first piece may be shorter."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(token_ids(vocabulary, text), np.uint32(end_id)).astype("<u4")
                at, n = 0, len(ids) % capacity or capacity
                k = 0
                while at < len(ids):
                    row.append(i), piece.append(k), start.append(at), length.append(n)
                    crc.append(zlib.crc32(ids[at : at + n].tobytes()))
                    at, n, k = at + n, capacity, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(cut), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, groups: int = 400) -> DataFrame:
    """Every piece of every document's tokens with its place: sequence_id and offset.

    docs: doc_id, text (null: empty, which leaves the end id alone); other columns are
    ignored. Repeated rows, and rows with a null doc_id, are documents of their own.
    Within a sequence offsets have no gaps from 0, and lengths add up to at most
    ``capacity``. Empty docs: no rows.
    """
    spark = docs.sparkSession
    with Workspace(spark, "packing", SMALL_BATCHES) as ws:
        pieces = ws.table(tokenized_pieces(docs, vocabulary, capacity, end_id), "pieces")
        counts = np.zeros(capacity + 1, np.int64)
        for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most capacity rows
            counts[r["length"]] = r["n"]
        # A length is ranked in as many groups as it has pieces for, so none of them grows.
        lengths = np.flatnonzero(counts)
        salts = few_rows(spark, {"length": lengths, "salts": -(-counts[lengths] // RANKED)}, "length long, salts long")
        salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")))
        share = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
        share = ws.table(share.select("length", "salt", "n", before.alias("first")), "shares")  # capacity + pieces / RANKED rows
        plan = packing_plan(counts, capacity, groups)
        order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
        ranked = salted.withColumn("rank", F.row_number().over(order) - 1)
        few = share.drop("n")
        few = F.broadcast(few) if int(counts.sum()) <= RANKED * BROADCAST_SHARES else few
        ranked = ranked.join(few, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("first"))
        starts = {int(x): np.flatnonzero(plan[:, 0] == x) for x in np.unique(plan[:, 0])}
        known = spark.sparkContext.broadcast((plan, starts))

        def find(batches):
            import pyarrow as pa

            plan, starts = known.value
            for batch in batches:
                length, rank = (np.asarray(batch.column(i), dtype=np.int64) for i in (3, 5))
                row = np.empty(len(length), np.int64)
                for x in np.unique(length):
                    mine = starts[int(x)]
                    at = length == x
                    row[at] = mine[np.searchsorted(plan[mine, 1], rank[at], "right") - 1]
                got = plan[row]
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(got[:, 3] + rank - got[:, 1]), pa.array(got[:, 4])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
        return ws.result(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(lean(find), schema))
