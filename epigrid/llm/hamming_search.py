"""Exact nearest neighbours among binary codes by incremental multi-index hashing.

A code is cut into segments. Codes within distance d of a query agree with it in some
segment to within d // segments bits, so probing every segment at radius 0, 1, 2, ...
finds all codes up to segments * (radius + 1) - 1; a query is done when its k-th
verified distance is within that. Equal codes are one entry of the index.

A query far from everything would need more probes than there are codes; those still open
then are compared with all distinct codes, a block of queries at a time.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, log2

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches

WORD = 64
#: Probes of one query, over all segments, at one radius; past them a scan is cheaper.
MOST_PROBES = 20_000
#: Queries that one scan of the codes answers.
SCANNED = 4096


def code_words(vectors: DataFrame, vector_col: str) -> int:
    """Words of 64 bits that the longest vector needs."""
    longest = vectors.agg(F.max(F.size(vector_col))).first()[0] or 0
    return max(1, -(-longest // WORD))


def sign_codes(vectors: DataFrame, id_col: str, vector_col: str, words: int | None = None) -> DataFrame:
    """(id, code): bit i of word i // 64 is set where component i is above 0 (nan and null are
    not). All components count; shorter vectors end in zeros. Rows without id or vector have no code."""
    words = words or code_words(vectors, vector_col)
    v = F.col("vector")
    above = F.transform(v, lambda x: (F.coalesce(x > 0, F.lit(False)) & ~F.coalesce(F.isnan(x), F.lit(False))).cast("long"))

    def word(k: int) -> Column:
        bits = F.zip_with(F.slice("above", k * WORD + 1, WORD), F.sequence(F.lit(0), F.least(F.lit(WORD), F.greatest(F.size("above") - k * WORD, F.lit(1))) - 1), lambda b, i: F.call_function("shiftleft", F.coalesce(b, F.lit(0).cast("long")), i))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    return rows.withColumn("above", above).select("id", F.array(*[word(k) for k in range(words)]).alias("code"))


def _cuts(codes: int, words: int) -> list[tuple[int, int, int]]:
    """(word, first bit, bits) of the segments: log2(codes) bits each or a little fewer, so
    that a probe meets a few codes, and few more probes are made than that."""
    m = max(1, min(WORD // 4, ceil(WORD / max(4.0, log2(max(codes, 2))))))
    edges = np.linspace(0, WORD, m + 1).astype(int)
    return [(w, int(a), int(b - a)) for w in range(words) for a, b in zip(edges, edges[1:], strict=False)]


def _segments(cuts: list) -> Column:
    """Entries (seg, bits, value) of a code."""
    parts = []
    for i, (w, first, bits) in enumerate(cuts):
        word = F.col("code")[w]
        value = F.shiftrightunsigned(word, first).bitwiseAND(F.lit((1 << bits) - 1)) if bits < WORD else word
        parts.append(F.struct(F.lit(i).alias("seg"), F.lit(bits).alias("bits"), value.alias("value")))
    return F.array(*parts)


def _flips(bits: int, radius: int) -> list[int]:
    all_ = [sum(1 << b for b in c) for c in combinations(range(bits), radius)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in all_]


def distance(a: str, b: str, words: int) -> Column:
    out = F.lit(0)
    for w in range(words):
        out = out + F.bit_count(F.col(a)[w].bitwiseXOR(F.col(b)[w]))
    return out.cast("int")


def _scan(ws: Workspace, index: DataFrame, open_: DataFrame, words: int, k: int, name: str) -> DataFrame:
    """(q, code, n, least, distance): the k + 1 nearest distinct codes of each open query, by
    comparing blocks of them with all codes."""
    spark = index.sparkSession
    codes = index.select("code", F.size("ids").alias("n"), F.element_at("ids", 1).alias("least"))
    queries = ws.table(open_.select("q", F.pmod(F.xxhash64("q"), F.lit(max(1, ceil(open_.count() / (SCANNED // 2))))).alias("block")), f"{name}-queries")
    out = None
    for block in sorted(r["block"] for r in queries.select("block").distinct().collect()):
        mine = np.array([r["q"] for r in queries.where(F.col("block") == block).select("q").collect()], np.int64)  # about SCANNED / 2
        sent = spark.sparkContext.broadcast(mine)

        def nearest(batches, sent=sent):
            import pyarrow as pa

            q = sent.value.view(np.uint64)
            best = [[] for _ in q]
            for batch in batches:
                if not batch.num_rows:
                    continue
                code = np.asarray(batch.column(0).flatten(), dtype=np.int64).reshape(-1, words)
                n, least = (np.asarray(batch.column(i), dtype=np.int64) for i in (1, 2))
                for i, one in enumerate(q):
                    d = np.bitwise_count(code.view(np.uint64) ^ one).sum(1).astype(np.int64)
                    some = np.argpartition(d, k)[: k + 1] if len(d) > k + 1 else np.arange(len(d))
                    some = np.flatnonzero(d <= d[some].max())  # with all ties
                    best[i] = sorted([*best[i], *((int(d[j]), int(least[j]), tuple(code[j].tolist()), int(n[j])) for j in some)])[: k + 1]
            rows = [(sent.value[i].tolist(), list(c), n, least, d) for i, mine in enumerate(best) for d, least, c, n in mine]
            kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32())
            columns = [*zip(*rows, strict=True)] if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["q", "code", "n", "least", "distance"])

        found = codes.mapInArrow(nearest, "q array<bigint>, code array<bigint>, n long, least long, distance int")
        near = Window.partitionBy("q").orderBy("distance", "least", "code")
        found = ws.table(found.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k + 1).drop("place"), f"{name}-{block}")
        out = found if out is None else out.unionByName(found)
    return out


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest rows of codes (id, code) to each row of queries (id, code), without the
    row of the same id: query_id, rank (from 1), id, distance. Ties go by id. A code is an
    array of 64-bit words, as many in every row.

    With k rows or fewer besides the query, all of them. Repeated ids count once. Each
    code keeps its k + 1 smallest ids, which is all that a result can need of it.
    """
    spark = codes.sparkSession
    bounded_batches(spark)
    words = (codes.select(F.max(F.size("code"))).first()[0]) or 1
    with Workspace(spark, "hamming") as ws:
        first = F.row_number().over(Window.partitionBy("code").orderBy("id"))
        index = codes.distinct().withColumn("n", first).where(F.col("n") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        index = ws.table(index, "index")
        queries = ws.table(queries.distinct(), "queries")
        n_codes = index.count()
        cuts = _cuts(n_codes, words)
        entries = ws.table(index.select("code", F.size("ids").alias("n"), F.element_at("ids", 1).alias("least"), F.explode(_segments(cuts)).alias("e")).select("e.seg", "e.value", "code", "n", "least"), "entries")
        farthest = words * WORD
        open_ = ws.table(queries.select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(farthest)), "open0")
        best, done = None, []
        last_radius = max(b for _, _, b in cuts)
        sizes = sorted({b for _, _, b in cuts})
        for radius in range(last_radius + 1):
            if sum(comb(b, radius) for _, _, b in cuts) > min(MOST_PROBES, max(64, n_codes)):
                done.append(_scan(ws, index, open_, words, k, "scan"))
                break
            flips = spark.createDataFrame([(b, x) for b in sizes for x in _flips(b, radius)], "b int, flip long")  # at most MOST_PROBES rows
            own = open_.select("q", "bound", F.col("q").alias("code")).select("q", "bound", F.explode(_segments(cuts)).alias("e"))
            probes = own.join(F.broadcast(flips), F.col("e.bits") == F.col("b")).select("q", "bound", F.col("e.seg").alias("s"), F.col("e.value").bitwiseXOR(F.col("flip")).alias("v"))
            far = distance("q", "code", words)
            # Merged: probes are far more than their source's size says, and not to be broadcast.
            hit = (F.col("seg") == F.col("s")) & (F.col("value") == F.col("v")) & (far <= F.col("bound"))
            found = probes.hint("merge").join(entries.hint("merge"), hit).select("q", "code", "n", "least", far.alias("distance")).distinct()
            if best is not None:
                found = found.unionByName(best.join(open_.select("q"), "q", "left_semi")).distinct()
            near = Window.partitionBy("q").orderBy("distance", "least", "code")
            best = ws.table(found.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k + 1).drop("place"), f"best{radius}")
            covered = len(cuts) * (radius + 1) - 1
            enough = best.where(F.col("distance") <= covered).groupBy("q").agg(F.sum("n").alias("n")).where(F.col("n") > k).select("q")
            done.append(best if radius == last_radius else best.join(enough, "q", "left_semi"))
            # With k + 1 codes at hand, farther ones than the last of them are out.
            known = best.groupBy("q").agg(F.when(F.count(F.lit(1)) > k, F.max("distance")).otherwise(farthest).cast("int").alias("bound"))
            open_ = ws.table(open_.select("q").join(enough, "q", "left_anti").join(known, "q", "left").select("q", F.coalesce("bound", F.lit(farthest)).alias("bound")), f"open{radius + 1}")
            if not open_.take(1):
                break
        answers = None
        for more in (x for x in done if x is not None):
            more = more.select("q", "code", "distance")
            answers = more if answers is None else answers.unionByName(more)
        if answers is None:  # no queries
            answers = spark.createDataFrame([], "q array<bigint>, code array<bigint>, distance int")
        rows = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(answers, "q").join(index, "code")
        rows = rows.select("query_id", "distance", F.explode("ids").alias("id")).where("id <> query_id")
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)
        return ws.result(ranked.select("query_id", "rank", "id", "distance"))
