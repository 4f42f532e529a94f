"""Ranked search by branch and bound over trees of maxima.

Documents stand in ranges, in the order in which they are read, and within a range by
length, so that neighbours score alike. For every term of the queries a range keeps its
postings and, over them, a tree: the highest weightless contribution of the term within
each 128 documents, each 1024, and the whole range. A node's bound for a query is the sum, over the query's terms, of weight times the node's maximum; no
document below it scores more. A search opens the node with the highest bound first and
stops below the score that k documents already have; nodes whose bound equals it are opened,
since a document there may tie and have a smaller id.

The ranges are the upper level of the same search: the ranges with a query's highest bounds
are searched first, their k-th best score is the floor for all others, and ranges whose
bound is under it are never opened.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, as_bytes

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Bytes of a text whose terms are in memory together.
WINDOW = 1 << 20
#: Documents of a range and of a leaf, and children of a node.
RANGE, LEAF, FAN = 4096, 128, 8
#: Ranges of a query that are searched for its floor.
FIRST = 8
#: Bytes of terms, and queries, of one block: what is sent to all tasks at once. More queries make more blocks.
BLOCK_BYTES, BLOCK_QUERIES = 32 << 20, 5000

INDEX = "range long, n_docs long, n_terms long, ids binary, known binary, lengths binary, terms binary, starts binary, places binary, counts binary"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """All terms of a text, some at a time. Terms are runs of letters and digits of ASCII,
    A-Z in lower case, and of all other characters."""
    at = 0
    while at < len(text):
        cut = GAP.search(text, at + WINDOW) if len(text) - at > WINDOW else None
        end = cut.start() if cut else len(text)
        yield TERM.findall(text[at:end].lower())
        at = end


def length_norm(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of documents of these lengths; in Python integers, since n times a length can be large."""
    return (25 + (lengths.astype(object) * (75 * n)) // total).astype(np.int64)


def contribution(counts: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """What one occurrence of a term in a query adds to a document's score, before the
    term's weight: by the term's count in the document and the document's length."""
    return (1_000_000_000 * counts) // (1000 * counts + 8 * norms)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def index_ranges(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """A row for every range of up to 4096 documents (INDEX): how many of them have terms,
    how many terms, and the postings of the vocabulary's terms, by term and place in the range."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def ranges(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        number, known = TaskContext.get().partitionId() << 32, sent.value.get
        held: list = []

        def packed():
            n = [x[2] for x in held]
            with_hits = sorted((x for x in held if x[3]), key=lambda x: x[2])
            term, place, count = ([], [], [])
            for i, x in enumerate(with_hits):
                term += x[3].keys()
                count += x[3].values()
                place += [i] * len(x[3])
            term, place, count = np.array(term, np.int32), np.array(place, np.int32), np.array(count, np.int64)
            order = np.lexsort((place, term))
            present, starts = np.unique(term[order], return_index=True)
            row = [np.array([x[0] for x in with_hits], np.int64), np.array([x[1] for x in with_hits], np.bool_), np.array([x[2] for x in with_hits], np.int64), present, starts.astype(np.int32), place[order], count[order]]
            return pa.RecordBatch.from_pylist([dict(zip([c.split()[0] for c in INDEX.split(", ")], [number, len(n), sum(n), *(x.tobytes() for x in row)], strict=True))], schema=schema)

        schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.binary()) for c in INDEX.split(", ")])
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                n, hits = 0, Counter()
                for some in terms_of(text):
                    n += len(some)
                    hits.update(map(known, some))
                hits.pop(None, None)
                if n:
                    held.append((i or 0, i is not None, n, hits))
                if len(held) == RANGE:
                    yield packed()
                    number, held = number + 1, []
        if held:
            yield packed()

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(ranges, INDEX)


def _spread(starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from starts[t] to starts[t + 1] of all t in at, and which t each is of."""
    n = starts[at + 1] - starts[at]
    return np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(np.arange(len(at)), n)


class Tree:
    """One range: postings by term, and the terms' maxima by level (0: the leaves)."""

    def __init__(self, row: dict, n: int, total: int):
        get = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, self.known, lengths = get("ids", np.int64), get("known", np.bool_), get("lengths", np.int64)
        self.terms, starts, self.places = get("terms", np.int32), get("starts", np.int32), get("places", np.int32)
        self.ends = np.append(starts, len(self.places)).astype(np.int64)
        self.gains = contribution(get("counts", np.int64), length_norm(lengths, n, total)[self.places])
        self.roots = np.maximum.reduceat(self.gains, starts) if len(starts) else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(self.terms)), np.diff(self.ends))
        #: By level: node numbers, maxima, and where each term's begin.
        self.levels = []
        width = LEAF
        while True:
            nodes = self.places // width
            first = np.flatnonzero(np.diff(owner, prepend=-1) | np.diff(nodes, prepend=-1)) if len(nodes) else np.empty(0, np.int64)
            best = np.maximum.reduceat(self.gains, first) if len(first) else np.empty(0, np.int64)
            self.levels.append((nodes[first], best, np.searchsorted(owner[first], np.arange(len(self.terms) + 1))))
            if width >= len(self.ids):
                break
            width *= FAN

    def by_leaf(self, at: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The weighted postings of these terms by place: places, gains, where each leaf's begin."""
        mine, whose = _spread(self.ends, at)
        places, gains = self.places[mine].astype(np.uint16 if len(self.ids) <= 1 << 16 else np.int32), weights[whose] * self.gains[mine]
        order = np.argsort(places, kind="stable")
        places = places[order].astype(np.int64)
        return places, gains[order], np.searchsorted(places, np.arange(-(-len(self.ids) // LEAF) + 1) * LEAF)

    def scores(self, leaf: int, postings: tuple) -> np.ndarray:
        """The scores of a leaf's documents."""
        places, gains, starts = postings
        mine, out = slice(starts[leaf], starts[leaf + 1]), np.zeros(LEAF, np.int64)
        np.add.at(out, places[mine] - leaf * LEAF, gains[mine])
        return out

    def bounds(self, level: int, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The bounds of all nodes of a level."""
        nodes, best, starts = self.levels[level]
        mine, whose = _spread(starts, at)
        out = np.zeros(-(-len(self.ids) // (LEAF * FAN**level)), np.int64)
        np.add.at(out, nodes[mine], weights[whose] * best[mine])
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> list[tuple[int, bool, int]]:
        """The k best (score, id known, id) that score no less than floor, which is 1 or more."""
        if not len(self.terms):
            return []
        at = np.searchsorted(self.terms, terms)
        here = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)
        at, weights = at[here], weights[here]
        found: list = []
        heap = [(-int((weights * self.roots[at]).sum()), len(self.levels) - 1, 0)]
        bounds: dict[int, np.ndarray] = {}
        postings = None
        while heap and -heap[0][0] >= floor:
            _, level, node = heapq.heappop(heap)
            if level:
                if level not in bounds:
                    bounds[level] = self.bounds(level - 1, at, weights)
                below = bounds[level][node * FAN : (node + 1) * FAN]
                for j in np.flatnonzero(below >= floor):
                    heapq.heappush(heap, (-int(below[j]), level - 1, node * FAN + int(j)))
                continue
            postings = postings or self.by_leaf(at, weights)
            scores, first = self.scores(node, postings), node * LEAF
            good = np.flatnonzero(scores >= floor)
            found += [(-int(scores[j]), not self.known[first + j], int(self.ids[first + j])) for j in good]
            if len(good) and len(found) >= k:
                found = sorted(found)[:k]
                floor = max(floor, -found[-1][0])
        return [(-s, not unknown, i) for s, unknown, i in sorted(found)[:k]]


def _search_tables(ws: Workspace, index: DataFrame, asked: list, n: int, total: int, k: int, vocabulary: int, block: int) -> DataFrame:
    """(q, score, known, id) of the k best, at most, of each query and range, with all that
    belong to the k best of all."""
    spark = index.sparkSession
    # df: one number a term of the block's vocabulary.
    df = np.zeros(vocabulary, np.int64)
    for t, c in index.mapInArrow(_df, "term int, c long").groupBy("term").agg(F.sum("c")).collect():
        df[t] = c
    weights = np.array([weight(n, int(d)) for d in df], np.int64)
    sent = spark.sparkContext.broadcast(([q for q, _, _ in asked], [(t, m * weights[t]) for _, t, m in asked]))
    starts = np.cumsum([0] + [len(t) for _, t, _ in asked])

    def bounds_of(tree: Tree) -> np.ndarray:
        best = np.zeros(vocabulary, np.int64)
        best[tree.terms] = tree.roots
        queries = sent.value[1]
        per_term = np.concatenate([w * best[t] for t, w in queries])
        run = np.concatenate(([0], np.cumsum(per_term)))
        return run[starts[1:]] - run[starts[:-1]]

    def trees(batches: Iterator, only=None) -> Iterator:
        for batch in batches:
            for row in batch.to_pylist():
                if only is None or row["range"] in only:
                    yield row["range"], Tree(row, n, total)

    def out(kinds: dict, rows: list):
        import pyarrow as pa

        columns = [*zip(*rows, strict=True)] if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, getattr(pa, t)()) for c, t in zip(columns, kinds.values(), strict=True)], names=[*kinds])

    def root_bounds(batches: Iterator) -> Iterator:
        for number, tree in trees(batches):
            b = bounds_of(tree)
            yield out({"q": "int64", "range": "int64", "bound": "int64"}, [(sent.value[0][j], number, int(b[j])) for j in np.flatnonzero(b > 0)])

    def searching(which, only=lambda: None):
        def search(batches: Iterator) -> Iterator:
            for number, tree in trees(batches, only()):
                rows = []
                for j, floor in which(number, tree):
                    terms, w = sent.value[1][j]
                    rows += [(sent.value[0][j], *x) for x in tree.search(terms, w, k, floor)]
                yield out({"q": "int64", "score": "int64", "known": "bool_", "id": "int64"}, rows)

        return search

    found_schema = "q long, score long, known boolean, id long"
    highest = Window.partitionBy("q").orderBy(F.desc("bound"), "range")
    first = index.mapInArrow(root_bounds, "q long, range long, bound long").withColumn("nth", F.row_number().over(highest)).where(F.col("nth") <= FIRST)
    number_of = {q: j for j, (q, _, _) in enumerate(asked)}
    chosen: dict[int, list[int]] = {}
    for q, r in first.select("q", "range").collect():  # FIRST a query of the block
        chosen.setdefault(r, []).append(number_of[q])
    first_sent = spark.sparkContext.broadcast(chosen)
    at_first = searching(lambda r, _: [(j, 1) for j in first_sent.value[r]], only=lambda: first_sent.value)
    at_first = ws.table(index.mapInArrow(at_first, found_schema), f"first-{block}")
    floors = np.zeros(len(asked), np.int64)
    for q, s in at_first.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("nth") == k).select("q", "score").collect():
        floors[number_of[q]] = s
    floors_sent = spark.sparkContext.broadcast(np.maximum(floors, 1))

    def others(r: int, tree: Tree) -> list[tuple[int, int]]:
        done = set(first_sent.value.get(r, ()))
        return [(int(j), int(floors_sent.value[j])) for j in np.flatnonzero(bounds_of(tree) >= floors_sent.value) if int(j) not in done]

    return at_first.unionByName(index.mapInArrow(searching(others), found_schema))


def _df(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for row in batch.select(["terms", "starts", "places"]).to_pylist():
            starts = np.append(np.frombuffer(row["starts"], np.int32), len(row["places"]) // 4)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["terms"], np.int32)), pa.array(np.diff(starts).astype(np.int64))], names=["term", "c"])


def _queries(ws: Workspace, queries: DataFrame) -> tuple[DataFrame, int]:
    """(q, _id, _text, block) of the distinct queries, and the number of blocks."""
    rows = ws.table(queries.distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    size, count = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(1, math.ceil(size / BLOCK_BYTES), math.ceil(count / BLOCK_QUERIES))
    return rows.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks))), blocks


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """The k documents with the highest scores above 0 of each query: query_id, rank (from
    1), id_col, score. Equal scores go by ascending id, documents without one last.

    A term's weight is floor(1000 * ln((2N + 2) / (2df + 1))); N documents have terms, df of
    them this one. A document with n of all L terms scores, for each term of the query
    (repeats included), weight * (10**9 * tf div (1000 * tf + 8m)), m = 25 + 75nN div L.

    Every row of docs is a document, repeated rows too. A null text has no terms. Equal
    query rows are one; rows of one id with other texts are ranked each by itself. Queries
    go in blocks of at most 5000 and about 32 MB, each a pass over docs.
    """
    with Workspace(docs.sparkSession, "lexical") as ws:
        rows, blocks = _queries(ws, queries.select(F.col(query_id).alias("_id"), F.col(query_text).alias("_text")))
        results = rows.where("false").select("q", F.lit(0).cast("long").alias("score"), F.lit(True).alias("known"), F.lit(0).cast("long").alias("id"), F.lit(0).alias("rank"))
        for block in range(blocks):
            vocabulary: dict[bytes, int] = {}
            asked = []
            for r in rows.where(F.col("block") == block).orderBy("q").collect():  # bounded by the block
                uses = Counter(t for some in terms_of((r["_text"] or "").encode()) for t in some)
                if uses:
                    ids = [vocabulary.setdefault(t, len(vocabulary)) for t in uses]
                    asked.append((r["q"], np.array(ids, np.int32), np.array([*uses.values()], np.int64)))
            if not asked:
                continue
            index = ws.table(index_ranges(docs, vocabulary, id_col, text_col), f"index-{block}")
            n, total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
            if not n:
                break
            found = _search_tables(ws, index, asked, n, total, k, len(vocabulary), block)
            order = Window.partitionBy("q").orderBy(F.desc("score"), F.desc("known"), "id")
            results = results.unionByName(ws.table(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), f"best-{block}"))
        ranked = results.join(rows.select("q", "_id"), "q")
        return ws.result(ranked.select(F.col("_id").alias(query_id), "rank", F.when(F.col("known"), F.col("id")).alias(id_col), "score"))
