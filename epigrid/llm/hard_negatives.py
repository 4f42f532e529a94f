"""Hard negatives by product quantisation with rigorous bounds.

Components are taken in pairs; a codebook a pair, fitted on a bounded sample, turns a
vector into one byte a pair and the norm of what the codes leave of it (the residual). For
an anchor, one table lookup a pair sums to the inner product with the decoded vector, in
integers; the true score differs from it by at most |anchor| * |residual|. So every row has
a proven range for its score. Rows whose range cannot reach the k-th best lower end of a
window are out; the others get their exact integer score.

Rows lie in blocks and anchors in groups. Each block meets every group in one shuffle; a
task holds one block and reads the groups one after another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

#: Rows that the codebooks are fitted on (those with the smallest hashes), and entries of a codebook.
SAMPLE, CODES = 2048, 256
#: Rows of a block at most and at least, and how many blocks there are if both allow it.
BLOCK, LEAST_BLOCK, BLOCKS = 65_536, 1024, 64
#: Anchors of a group.
GROUP = 128
#: The largest squared norm of an integer vector: every product of two then fits a long.
MOST = 1 << 62


def integer_rows(vectors: DataFrame, width: int, *, id_col: str, vector_col: str, label: Column, scale: float) -> DataFrame:
    """(id, label, vector): components floor(scale * x) as bytes of 32-bit integers, shorter
    vectors ended with zeros. Rows with a null id, label, vector or component, a component
    that is not finite, or a squared norm over 2**62 are left out; equal rows are one."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            column = batch.column(2)
            sizes = np.diff(np.asarray(column.offsets)) if len(column) else np.empty(0, np.int64)
            flat = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            dense = np.zeros((len(sizes), width))
            with np.errstate(over="ignore", invalid="ignore"):
                dense[row, at] = np.floor(scale * flat)
                good = np.flatnonzero((dense * dense).sum(1) < MOST * (1 - 1e-9))  # false for nan
            whole = dense[good].astype("<i4")
            ids, labels = (batch.column(i).take(pa.array(good)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([x.tobytes() for x in whole], pa.binary())], names=["id", "label", "vector"])

    v = F.col(vector_col).cast("array<double>")
    named = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(whole, F.lit(False))).mapInArrow(rows, "id long, label long, vector binary").distinct()


def _nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(1) - 2 * (points @ book.T)).argmin(1)


def fit_codebooks(sample: np.ndarray, rounds: int = 8) -> np.ndarray:
    """(pairs, CODES, 2) integers: k-means on each pair of components, from distinct points
    evenly spaced in their order."""
    pairs = sample.reshape(len(sample), sample.shape[1] // 2, 2).transpose(1, 0, 2).astype(np.float64)
    books = np.zeros((len(pairs), CODES, 2))
    for p, points in enumerate(pairs):
        apart, weight = np.unique(points, axis=0, return_counts=True)
        if not len(apart):
            continue
        book = apart[np.linspace(0, len(apart) - 1, CODES).astype(int)]
        for _ in range(rounds if len(apart) > CODES else 0):
            near = _nearest(apart, book)
            n = np.bincount(near, weight, CODES)
            some = n > 0
            for c in range(2):
                book[some, c] = np.bincount(near, weight * apart[:, c], CODES)[some] / n[some]
        books[p] = np.rint(book)
    return books.astype(np.int64)


def encode(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, pairs) and the norms of the residuals, rounded up."""
    codes = np.empty((len(vectors), len(books)), np.uint8)
    left = np.zeros(len(vectors))
    for p, book in enumerate(books):
        mine = vectors[:, 2 * p : 2 * p + 2].astype(np.float64)
        for lo in range(0, len(mine), 4096):
            codes[lo : lo + 4096, p] = _nearest(mine[lo : lo + 4096], book)
        left += ((mine - book[codes[:, p]]) ** 2).sum(1)  # whatever code was taken
    return codes, np.sqrt(left) * (1 + 1e-9)


class Block:
    """Rows with codes, sorted by label."""

    def __init__(self, labels, vectors, codes, residuals, ids):
        order = np.argsort(labels, kind="stable")
        self.labels, self.vectors, self.codes, self.residuals = labels[order], vectors[order], np.ascontiguousarray(codes[order].T), residuals[order]
        self.ids = [ids[i] for i in order]

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, (label, label + 1)))

    def ranges(self, anchors: np.ndarray, books: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends of the scores of a part's rows, for each anchor."""
        n = len(self.residuals[part])
        middle = np.zeros((len(anchors), n), np.int64)
        for p, book in enumerate(books):
            table = anchors[:, 2 * p : 2 * p + 2] @ book.T  # an anchor a row
            middle += table[:, self.codes[p, part]]
        norms = np.sqrt((anchors.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
        # Beyond 2**53 the decoded product's own sum is exact still; doubles only widen the bound.
        slack = np.ceil(norms[:, None] * self.residuals[None, part] * (1 + 1e-9)).astype(np.int64) + 1
        return middle - slack, middle + slack

    def exact(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.vectors[rows].astype(np.int64) @ anchor


def best_rows(block: Block, anchor: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, least: int | None = None, most: int | None = None) -> tuple[list[tuple[int, int]], int]:
    """(score, row) of those of ``rows`` with scores from least to most that can be among
    the k best of them, and how many were scored exactly. Entries with ties are all there."""
    if least is not None:
        inside = (high >= least) & (low <= most)
        rows, low, high = rows[inside], low[inside], high[inside]
        certain = low[(low >= least) & (high <= most)]
    else:
        certain = low
    if len(certain) >= k:
        reach = high >= np.partition(certain, len(certain) - k)[len(certain) - k]
        rows = rows[reach]
    scores = block.exact(anchor, rows)
    tried = len(rows)
    if least is not None:
        inside = (scores >= least) & (scores <= most)
        rows, scores = rows[inside], scores[inside]
    if len(scores) > k:
        some = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        rows, scores = rows[some], scores[some]
    return [*zip(scores.tolist(), rows.tolist(), strict=True)], tried


def _blocks(ws: Workspace, rows: DataFrame, books, keep: int, width: int) -> tuple[DataFrame, int]:
    """Rows of one vector and label are one entry with its ``keep`` smallest ids; entries are
    dealt to blocks by hash and encoded: (b, label, vector, ids, codes, residual)."""
    nth = F.row_number().over(Window.partitionBy("label", "vector").orderBy("id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= keep)
    entries = ws.table(few.groupBy("label", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    n = entries.count()
    block = min(BLOCK, max(LEAST_BLOCK, n // BLOCKS))
    blocks = max(1, -(-n // block))

    def coded(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            v = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4").reshape(-1, width)
            codes, left = encode(v, books.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left)], names=[*batch.schema.names, "codes", "residual"])

    dealt = entries.withColumn("b", F.pmod(F.xxhash64("label", "vector"), F.lit(blocks)).cast("int"))
    return ws.table(dealt.mapInArrow(coded, "label long, vector binary, ids array<bigint>, b int, codes binary, residual double"), "coded"), blocks


def _meet(ws: Workspace, coded: DataFrame, blocks: int, anchors: DataFrame, books, width: int, answer, schema: str, name: str) -> DataFrame:
    """What ``answer(block, anchors of a group)`` yields, for every block and group of anchors (a, id, label,
    vector, more binary). Within a task rows come sorted: a block's rows, then its groups of anchors."""

    def key(*more):
        return [F.col("b"), *more]

    empty = F.lit(None)
    # Rows are sent as they are, a block's in one partition; anchors once a block.
    left = coded.select(*key(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("a"), "label", "vector", "ids", "codes", "residual", empty.cast("binary").alias("more")))
    each = anchors.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = each.select(*key(F.lit(1).alias("kind"), "a", "label", "vector", F.array("id").alias("ids"), empty.cast("binary").alias("codes"), F.lit(0.0).alias("residual"), "more"))
    both = left.unionByName(right).repartition(blocks, "b").sortWithinPartitions("b", "kind", "a")

    def meet(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows: list = []
        waiting: list = []
        block, at = None, None

        def done():
            nonlocal block, rows
            if block is None:
                label, vector, ids, codes, left = zip(*rows, strict=True)
                block = Block(np.array(label, np.int64), np.frombuffer(b"".join(vector), "<i4").reshape(-1, width), np.frombuffer(b"".join(codes), np.uint8).reshape(len(rows), -1), np.array(left), ids)
                rows = []
            some = [*answer(block, waiting)]
            waiting.clear()
            names = [c.split()[0] for c in schema.split(", ")]
            kinds = [pa.binary() if c.endswith("binary") else pa.int32() if c.endswith(" int") else pa.int64() for c in schema.split(", ")]
            columns = [*zip(*some, strict=True)] if some else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for b, kind, a, label, vector, ids, codes, left, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != at:
                    if waiting:
                        yield done()
                    at, block, rows = b, None, []
                if kind == 0:
                    rows.append((label, vector, ids, codes, left))
                elif rows or block is not None:  # else the block has no rows
                    waiting.append((a, ids[0], label, np.frombuffer(vector, "<i4").astype(np.int64), more))
                    if len(waiting) == GROUP:
                        yield done()
        if waiting:
            yield done()

    return ws.table(both.mapInArrow(meet, schema), name)


def hard_negatives(vectors: DataFrame, anchors: str, *, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", scale: float = 256.0, positives: int = 5, negatives: int = 3, band: tuple[int, int] = (50, 95)) -> DataFrame:
    """For each row that the SQL condition ``anchors`` on ``id`` names and each of its first
    ``positives`` rows of the same label, the first ``negatives`` rows of other labels with
    band[0] * positive_score <= 100 * negative_score <= band[1] * positive_score: anchor_id,
    positive_id, rank int (from 1), negative_id, positive_score, negative_score.

    Scores are integer inner products of floor(scale * x); higher ones come first, ties by
    the smaller id. Rows with a null id, label, vector or component, or a component that is
    not finite, take no part, nor do those whose squared integer norm exceeds 2**62 (their
    products need not fit a long). Shorter vectors end in zeros. Equal rows are one; rows of
    the anchor's own id are neither positives nor negatives. An anchor without rows of its
    label, or without rows in the band, has none. Every row is compared, none is sampled:
    only the codebooks come from a sample, and they change the speed, not the result.
    """
    spark = vectors.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    with Workspace(spark, "negatives") as ws:
        width = vectors.agg(F.max(F.size(vector_col))).first()[0] or 0
        width = max(2, width + width % 2)
        rows = ws.table(integer_rows(vectors, width, id_col=id_col, vector_col=vector_col, label=label, scale=scale), "rows")
        sample = rows.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).collect()
        books = spark.sparkContext.broadcast(fit_codebooks(np.frombuffer(b"".join(bytes(r[0]) for r in sample), "<i4").reshape(-1, width)))
        coded, blocks = _blocks(ws, rows, books, max(positives, negatives) + 1, width)
        asked = ws.table(rows.where(anchors).withColumn("a", F.monotonically_increasing_id()).withColumn("more", F.lit(None).cast("binary")), "anchors")

        def by_label(waiting):
            labels = np.array([w[2] for w in waiting])
            for one in np.unique(labels):
                mine = [w for w in waiting if w[2] == one]
                yield int(one), mine, np.array([w[3] for w in mine])

        def same(block: Block, waiting: list) -> Iterator:
            for one, mine, matrix in by_label(waiting):
                part = block.of_label(one)
                if part.start == part.stop:
                    continue
                low, high = block.ranges(matrix, books.value, part)
                at = np.arange(part.start, part.stop)
                for i, (a, own, _, vector, _) in enumerate(mine):
                    best, _ = best_rows(block, vector, at, low[i], high[i], positives + 1)
                    found = sorted((-s, x) for s, r in best for x in block.ids[r] if x != own)[:positives]
                    yield from ((a, x, -s) for s, x in found)

        first = Window.partitionBy("a").orderBy(F.desc("score"), "id")
        found = _meet(ws, coded, blocks, asked, books, width, same, "a long, id long, score long", "same")
        held = ws.table(found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives), "positives")
        # The scores of an anchor's positives, so many at most, travel with it.
        scores = held.groupBy("a").agg(F.sort_array(F.collect_set("score")).alias("scores"))
        packed = asked.drop("more").join(scores, "a").withColumn("more", F.encode(F.array_join("scores", " "), "UTF-8")).drop("scores")

        def others(block: Block, waiting: list) -> Iterator:
            for one, mine, matrix in by_label(waiting):
                part = block.of_label(one)
                at = np.concatenate([np.arange(part.start), np.arange(part.stop, len(block.labels))])
                if not len(at):
                    continue
                low, high = block.ranges(matrix, books.value, slice(0, len(block.labels)))
                for i, (a, own, _, vector, more) in enumerate(mine):
                    for score in map(int, more.split()):
                        least, most = -(-band[0] * score // 100), band[1] * score // 100
                        if least > most:
                            continue
                        best, _ = best_rows(block, vector, at, low[i][at], high[i][at], negatives + 1, least, most)
                        near = sorted((-s, x) for s, r in best for x in block.ids[r] if x != own)[:negatives]
                        yield from ((a, score, x, -s) for s, x in near)

        nearest = Window.partitionBy("a", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
        found = _meet(ws, coded, blocks, packed, books, width, others, "a long, positive_score long, negative_id long, negative_score long", "others")
        found = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= negatives)
        pairs = held.select("a", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        mined = pairs.join(found, ["a", "positive_score"]).join(asked.select("a", F.col("id").alias("anchor_id")), "a")
        return ws.result(mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
