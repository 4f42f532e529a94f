"""MinHash near-duplicates with an LSH forest.

Every distinct shingle set gets one sort key a tree: a sequence of min-hashes. Sorted by
key, the sets with the longest common prefixes are neighbours, and those neighbours are
the candidates: in thin regions they share ``least_depth`` hashes, in dense ones as many
more as it takes to come next to each other. Each dense region also has a hub, a set
with its commonest key, that all its members are held against, since many copies of one
text may be alike to it and yet not to each other. Candidates are confirmed on full sets.

What the forest leaves in different components is then joined: two sets that are alike share
a shingle among the rarest of each (a prefix filter), so all pairs of different components
that do are tested too, without a cap on partners. The tests run inside the tasks, on blocks
of the sets of one shingle, so that only pairs come out which sizes, places and a sketch of
the min-hashes allow, each once or little more often. Only the sketch may err, and loses a
pair of similarity 0.8 with a chance below 1e-8.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_BATCHES, Apart, Workspace, as_bytes, blocks, few_rows, lean, shingle_hashes, word_hashes

HASH_BYTES = 6  # of each shingle's hash, in the sets on which links are confirmed
SAMPLE, COMMON = 10_000, 500_000  # documents that tell which shingles are common, and how many such shingles are sent
BLOCK = 512  # sets of one shingle that are joined with each other in one group
BEFORE = 8  # so many of a set's last shared shingles tell whether a pair has been met before
SIGMAS = 6.0  # by so many standard deviations a sketch may show less than the similarity asked for


class Forest:
    """Sizes of the forest and its hash functions."""

    def __init__(self, trees: int = 32, depth: int = 8, least_depth: int = 3, near: int = 3, seed: int = 11):
        self.trees, self.depth, self.least_depth, self.near = trees, depth, least_depth, near
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1 << 31, 1 << 32, trees * depth, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint64).astype(np.uint32)

    def signature(self, shingles: np.ndarray) -> bytes:
        """Min-hashes of a set, two bytes each, tree by tree."""
        x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for k in range(0, len(x), 2048):
            np.minimum(low, (x[k : k + 2048, None] * self.a + self.b).min(0), out=low)
        return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2").tobytes()

    def sketch(self, signature: bytes) -> bytes:
        """Two bits of every min-hash."""
        x = (np.frombuffer(signature, ">u2") & 3).astype(np.uint8).reshape(-1, 4)
        return (x[:, 0] | x[:, 1] << 2 | x[:, 2] << 4 | x[:, 3] << 6).tobytes()

    def least_matches(self, percent: int) -> float:
        """Entries of two sketches that agree at least, for sets of that similarity."""
        n, p = len(self.a), percent / 100 + (1 - percent / 100) / 4
        return n * p - SIGMAS * (n * p * (1 - p)) ** 0.5

    def candidates(self, tree: np.ndarray, keys: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows to compare, of rows sorted by tree and key: neighbours that share the least
        depth, and in each region of more rows than those its hub with all the others."""
        n, left, right = len(tree), [], []
        if n < 2:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        for gap in range(1, min(self.near, n - 1) + 1):
            d = self.least_depth
            at = np.flatnonzero((tree[gap:] == tree[:-gap]) & (keys[gap:, :d] == keys[:-gap, :d]).all(1))
            left.append(at), right.append(at + gap)
        new = np.append(True, (tree[1:] != tree[:-1]) | (keys[1:] != keys[:-1]).any(1))
        start = np.flatnonzero(new)
        same = np.diff(np.append(start, n))  # rows with one key
        for d in range(self.least_depth, self.depth, 2):
            edge = np.append(True, (tree[1:] != tree[:-1]) | (keys[1:, :d] != keys[:-1, :d]).any(1))
            first = np.flatnonzero(edge)
            many = np.diff(np.append(first, n))
            of = np.searchsorted(first, start, "right") - 1
            best = np.lexsort((-same, of))
            hub = start[best[np.searchsorted(of[best], np.arange(len(first)))]]
            dense = many > self.near + 1
            rows = np.repeat(dense, many)
            left.append(np.repeat(hub[dense], many[dense])), right.append(np.flatnonzero(rows))
        a, b = np.concatenate(left), np.concatenate(right)
        alike = (a != b) & (100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b]))
        return a[alike], b[alike]


def shingle_sets(texts: list[bytes], width: int):
    """The texts' sets of hashed word shingles, in turn."""
    for lo, hi in blocks(texts, 1 << 18):
        h, at = word_hashes(texts[lo:hi])
        for i in range(hi - lo):
            yield shingle_hashes(h[at[i] : at[i + 1]], width)


def set_id(shingles: np.ndarray) -> int:
    """What names a set: 64 bits of a cryptographic hash of its shingles."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def packed(shingles: np.ndarray) -> bytes:
    return shingles.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    return out.view(">u8")[:, 0].astype(np.uint64)


def _signed(docs: DataFrame, width: int, forest: Forest) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_id, signature, sketch) of every row; text_key is the MD5 of the text."""

    def sign(batches):
        import pyarrow as pa

        for batch in batches:
            n, key, signature, sketch = [], [], [], []
            texts = as_bytes(batch.column(1))
            text_keys = [hashlib.md5(t, usedforsecurity=False).digest() for t in texts]
            for s in shingle_sets(texts, width):
                n.append(len(s))
                key.append(set_id(s) if len(s) else None)
                signature.append(forest.signature(s) if len(s) else None)
                sketch.append(forest.sketch(signature[-1]) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text_keys, pa.binary()), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(signature, pa.binary()), pa.array(sketch, pa.binary())], names=["doc_id", "text_key", "n_shingles", "set_id", "signature", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(lean(sign), "doc_id long, text_key binary, n_shingles long, set_id long, signature binary, sketch binary")


def _candidates(ws: Workspace, reps: DataFrame, forest: Forest, percent: int) -> DataFrame:
    """(a, b, trees): pairs of sets to confirm, a < b, and how many trees brought them up."""
    step = 2 * forest.depth
    keys = F.transform(F.sequence(F.lit(0), F.lit(forest.trees - 1)), lambda t: F.substring(F.col("signature"), t * step + 1, F.lit(step)))
    leaves = reps.select("set_id", "n_shingles", F.posexplode(keys).alias("tree", "key"))
    ranged = leaves.repartitionByRange("tree", "key", "set_id").sortWithinPartitions("tree", "key", "set_id").select("tree", "key", "set_id", "n_shingles")
    overlap = 64 * forest.near

    def neighbours(batches):
        import pyarrow as pa

        carried = None

        def pairs(tree, key, ids, size):
            a, b = forest.candidates(tree, key, size, percent)
            lo, hi = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
            both, trees = np.unique(np.stack([lo, hi]), axis=1, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(trees)], names=["a", "b", "trees"])

        for batch in batches:
            now = [
                np.asarray(batch.column(0), dtype=np.int64), np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(batch.num_rows, forest.depth).astype(np.uint16),
                np.asarray(batch.column(2), dtype=np.int64), np.asarray(batch.column(3), dtype=np.int64),
            ]
            if carried:
                now = [np.concatenate(x) for x in zip(carried, now, strict=True)]
            yield pairs(*now)
            carried = [x[-overlap:] for x in now]

    found = ranged.mapInArrow(lean(neighbours), "a long, b long, trees long")
    return ws.table(found.groupBy("a", "b").agg(F.sum("trees").alias("trees")), "candidates")


def _prefix_length(n: int, percent: int) -> int:
    """So many of a set's shingles, in an order common to all sets, that any set alike to it has one of them among its own."""
    return n + percent * n // -100 + 1


def _common_shingles(docs: DataFrame, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles found in three sampled documents or more, and their
    counts. They only order the shingles, so the sample does not change what is found."""

    def some(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [*shingle_sets(as_bytes(batch.column(0)), width)]
            s, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n, pa.int64())], names=["s", "n"])

    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < max(1, 1_000_000 * SAMPLE // max(n_docs, SAMPLE))).select("text")
    counts = part.mapInArrow(lean(some), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where("n >= 3").orderBy(F.desc("n"), "s").limit(COMMON).toArrow()
    s, n = np.asarray(counts.column(0)).astype(np.int64).view(np.uint64), np.asarray(counts.column(1)).astype(np.int64)
    order = np.argsort(s)
    return s[order], n[order]


def _prefixes(docs: DataFrame, n_docs: int, width: int, percent: int) -> DataFrame:
    """(shingle, set_id, n, at): the rarest shingles of each set, their places in its order
    and its size; only shingles that two sets or more have so."""
    common = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, n_docs, width))

    def rarest(batches):
        import pyarrow as pa

        known, count = common.value
        seen = set()  # equal texts come once a task, as far as that many are remembered
        for batch in batches:
            shingles, ids, sizes, at = [], [], [], []
            for s in shingle_sets(as_bytes(batch.column(0)), width):
                i = set_id(s) if len(s) else None
                if i is None or i in seen:
                    continue
                seen.add(i)
                k = _prefix_length(len(s), percent)
                if len(known):
                    place = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    often = np.where(known[place] == s, count[place], 0)
                    s = s[np.argsort(often, kind="stable")] if often.any() else s
                shingles.append(s[:k] >> np.uint64(16)), ids.append(np.full(k, i)), at.append(np.arange(k))
                sizes.append(np.full(k, len(s)))
            if len(seen) > 200_000:
                seen.clear()
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in ((shingles, np.int64), (ids, np.int64), (sizes, np.int32), (at, np.int32))], names=["shingle", "set_id", "n", "at"])

    def shared(batches):
        import pyarrow as pa

        held, linked = None, False  # the last row, and whether it shares its shingle with one before
        for batch in batches:
            rows = pa.Table.from_batches([held, batch] if held else [batch]).combine_chunks().to_batches()[0] if batch.num_rows else None
            if rows is None:
                continue
            s, i = np.asarray(rows.column(0)), np.asarray(rows.column(1))
            fresh = np.append(True, (s[1:] != s[:-1]) | (i[1:] != i[:-1]))
            rows = rows.filter(pa.array(fresh))
            s = s[fresh]
            same = s[1:] == s[:-1]
            keep = np.append(linked, same) | np.append(same, False)
            linked, held = bool(np.append(linked, same)[-1]), rows.slice(len(s) - 1)
            yield rows.slice(0, len(s) - 1).filter(pa.array(keep[:-1]))
        if held is not None and linked:
            yield held

    form = "shingle long, set_id long, n int, at int"
    return docs.select("text").mapInArrow(lean(rarest), form).repartition("shingle").sortWithinPartitions("shingle", "set_id").mapInArrow(lean(shared), form)


class Meeting:
    """Pairs to test among the sets of one shingle (or of two blocks of them)."""

    SMALL = 16  # groups of so many rows are taken together

    def __init__(self, forest: Forest, percent: int):
        self.percent, self.least = percent, forest.least_matches(percent)

    def tested(self, a: np.ndarray, b: np.ndarray, rows: list):
        """The pairs of rows, of different components, that sizes, places and sketches allow
        and that share none of the shingles before this one; and how many sketch entries agree."""
        _, x, y, salt, _, component, size, at, sketch, before = rows
        ok = component[a] != component[b]
        a, b = a[ok], b[ok]
        small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        left = np.minimum(size[a] - at[a], size[b] - at[b])  # in common at most
        ok = (100 * small >= self.percent * large) & ((100 + self.percent) * left >= self.percent * (small + large))
        ok &= (x[a] == y[a]) | (salt[a] != salt[b])
        a, b = a[ok], b[ok]
        found = [[np.empty(0, np.int64)] * 3]
        for k in range(0, len(a), 1 << 16):
            i, j = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
            other = sketch[i] ^ sketch[j]
            other = (other | other >> np.uint64(1)) & np.uint64(0x5555555555555555)
            matches = 32 * sketch.shape[1] - np.bitwise_count(other).sum(1).astype(np.int64)
            good = matches >= self.least
            i, j, matches = i[good], j[good], matches[good]
            seen = before[i]
            fresh = ~((seen[:, :, None] == before[j][:, None, :]) & (seen != 0)[:, :, None]).any((1, 2))
            found.append([i[fresh], j[fresh], matches[fresh]])
        return [np.concatenate(c) for c in zip(*found, strict=True)]

    def pairs(self, rows: list, first: np.ndarray, end: np.ndarray):
        """All tested pairs of the groups of rows [first, end)."""
        component, many = rows[5], end - first
        for_small = many <= self.SMALL
        rest = np.repeat(end, many) - np.arange(len(component))  # rows of the group from each on
        small = np.repeat(for_small, many)
        out = [[np.empty(0, np.int64)] * 3]
        for gap in range(1, self.SMALL):
            a = np.flatnonzero(small & (rest > gap))
            if not len(a):
                break
            out.append(self.tested(a, a + gap, rows))
        for lo, hi in zip(first[~for_small], end[~for_small], strict=True):
            _, of = np.unique(component[lo:hi], return_inverse=True)
            # One of a pair at least is outside the largest component.
            largest = np.bincount(of).argmax()
            few = np.flatnonzero(of != largest)
            step = max(1, (1 << 19) // (hi - lo))
            for k in range(0, len(few), step):
                a, b = (lo + x.ravel() for x in np.meshgrid(few[k : k + step], np.arange(hi - lo), indexing="ij"))
                once = (of[b - lo] == largest) | (a < b)
                out.append(self.tested(a[once], b[once], rows))
        return [np.concatenate(c) for c in zip(*out, strict=True)]


def _apart(ws: Workspace, prefixes: DataFrame, reps: DataFrame, part: DataFrame, forest: Forest, percent: int) -> DataFrame:
    """(a, b, trees): pairs of sets of different components that may be alike, a < b, and how
    many entries of their sketches agree. A shingle of many sets is dealt in blocks."""
    named = ws.table(prefixes.join(part.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id")), "named")
    lists = named.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("many")).where("lo < hi").select("shingle", "many")
    rows = named.join(lists, "shingle").join(reps.select("set_id", "sketch"), "set_id")
    own = Window.partitionBy("set_id").orderBy("at")
    rows = rows.select("*", F.array(*[F.coalesce(F.lag("shingle", i + 1).over(own), F.lit(0)) for i in range(BEFORE)]).alias("before"))
    k = F.ceil(F.col("many") / BLOCK).cast("int")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("set_id"), k).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), k - 1)))
    dealt = dealt.select("shingle", F.least("salt", "other").alias("x"), F.greatest("salt", "other").alias("y"), "salt", "set_id", "component", "n", "at", "sketch", "before")
    dealt = dealt.repartition("shingle", "x", "y").sortWithinPartitions("shingle", "x", "y", "set_id")

    def meet(batches):
        import pyarrow as pa

        meeting, held = Meeting(forest, percent), None
        names = ["a", "b", "trees"]

        def columns(batch):
            numbers = [np.asarray(batch.column(i), dtype=np.int64) for i in range(8)]
            sketch = np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            return [*numbers, sketch, np.asarray(batch.column(9).flatten(), dtype=np.int64).reshape(batch.num_rows, BEFORE)]

        def solve(rows, last: bool):
            """Pairs of all whole groups of rows, and the rows of the last, unless it is the end."""
            key = np.column_stack(rows[:3])
            edge = np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1)
            ends = np.append(edge[1:], len(key))
            if not last:
                edge, ends, rest = edge[:-1], ends[:-1], edge[-1]
            else:
                rest = len(key)
            a, b, m = meeting.pairs([x[:rest] for x in rows], edge, ends)
            i, j = rows[4][a], rows[4][b]
            a, b = np.minimum(i, j), np.maximum(i, j)
            both, at = np.unique(np.stack([a, b]), axis=1, return_index=True) if len(a) else (np.empty((2, 0), np.int64), np.empty(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(m[at])], names=names), [x[rest:] for x in rows]

        for batch in batches:
            if batch.num_rows:
                now = columns(batch)
                got, held = solve([np.concatenate(x) for x in zip(held, now, strict=True)] if held else now, False)
                yield got
        if held:
            yield solve(held, True)[0]

    met = dealt.mapInArrow(lean(meet), "a long, b long, trees long")
    return ws.table(met.groupBy("a", "b").agg(F.max("trees").alias("trees")), "apart")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have a Jaccard similarity of percent / 100 or more."""

    def confirm(batches):
        import pyarrow as pa

        for batch in batches:
            keep, known = [], {}
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                a = known.get(x)
                if a is None:
                    known = {x: unpacked(x)}
                    a = known[x]
                b = unpacked(y)
                n = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * n >= percent * (len(a) + len(b) - n):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    one = sets.select(F.col("id").alias("b"), F.col("shingles").alias("theirs"))
    two = sets.select(F.col("id").alias("a"), F.col("shingles").alias("ours"))
    both = pairs.select("a", "b").join(one, "b").join(two, "a").select("a", "b", "ours", "theirs")
    return both.mapInArrow(lean(confirm), "a long, b long")


#: Bits of the filter on the documents whose sets are needed: 4 MB, however many they are.
SLOTS = 1 << 25


def _slot(column):
    return F.pmod(F.xxhash64(column), F.lit(SLOTS))


def _marked(ids: DataFrame) -> bytes:
    """A bit a slot: whether an id falls there. So most texts without candidates are left
    out before any shuffle; a wrong bit only lets a text in that the join drops."""
    at = ids.select((_slot("id") + 1).alias("s"))
    rows = at.groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    out = bytearray(SLOTS // 8)
    for r in rows:
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = r["bits"]
    return bytes(out)


def connected_components(ws: Workspace, links: DataFrame, name: str) -> DataFrame:
    """(id, component): the smallest id that each id of links (a, b) reaches.

    Large-star and small-star in turn: every id points its larger neighbours, then all of
    its neighbours not above it, at the least of them, until nothing changes.
    """

    def star(edges: DataFrame) -> DataFrame:
        least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        return edges.join(least, "u")

    edges, seen, k = ws.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}0"), None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = star(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        k += 1
        edges = ws.table(small, f"{name}{k}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        ws.drop(f"{name}{k - 1}")
        if tuple(now) == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = tuple(now)


def _sets(ws: Workspace, docs: DataFrame, reps: DataFrame, candidates: DataFrame, width: int, name: str) -> DataFrame:
    """(id, shingles) of the sets that candidates name."""
    sides = candidates.select(F.col("a").alias("set_id")).unionByName(candidates.select(F.col("b").alias("set_id"))).distinct()
    sides = ws.table(reps.select("set_id", "rep").join(sides, "set_id", "left_semi"), f"{name}-sides")
    marks = docs.sparkSession.sparkContext.broadcast(_marked(sides.select(F.col("rep").alias("id"))))
    slotted = docs.select("doc_id", "text", _slot("doc_id").alias("slot"))

    def pack(batches):
        import pyarrow as pa

        bits = np.frombuffer(marks.value, np.uint8)
        for batch in batches:
            slot = np.asarray(batch.column(2).fill_null(0), dtype=np.int64)
            some = batch.filter(pa.array((bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)))
            sets = [(packed(s), set_id(s) if len(s) else None) for s in shingle_sets(as_bytes(some.column(1)), width)]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([x for _, x in sets], pa.int64()), pa.array([x for x, _ in sets], pa.binary())], names=["rep", "id", "shingles"])

    sets = slotted.mapInArrow(lean(pack), "rep long, id long, shingles binary")
    sets = sets.join(sides.withColumnRenamed("set_id", "id"), ["rep", "id"], "left_semi")
    return ws.table(sets.groupBy("id").agg(F.first("shingles").alias("shingles")), f"{name}-sets")


def _settled(ws: Workspace, docs: DataFrame, reps: DataFrame, width: int, percent: int, strongest: int, candidates: DataFrame, links: DataFrame, part: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """links and their components with those of candidates (a, b, trees) added: first the
    strongest of each set are confirmed, then all that are still in different components."""
    if candidates.isEmpty():
        return links, part
    sets = _sets(ws, docs, reps, candidates, width, name)
    ends = candidates.select("a", "b", "trees", F.explode(F.array("a", "b")).alias("end"))
    place = F.row_number().over(Window.partitionBy("end").orderBy(F.desc("trees"), "a", "b"))
    strong = ends.withColumn("k", place).where(F.col("k") <= strongest).select("a", "b").distinct()
    for k in (1, 2):
        if k == 1:
            pairs = strong
        else:
            ca, cb = part.select(F.col("id").alias("a"), F.col("component").alias("ca")), part.select(F.col("id").alias("b"), F.col("component").alias("cb"))
            pairs = candidates.join(ca, "a", "left").join(cb, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
            pairs = pairs.join(strong, ["a", "b"], "left_anti")
        more = ws.table(_confirmed(pairs, sets, percent), f"{name}-links{k}")
        if not more.isEmpty():
            links = links.unionByName(more)
            part = ws.table(connected_components(ws, links, f"{name}-{k}-"), f"{name}-parts{k}")
    return links, part


def _decided(docs: DataFrame, width: int, percent: int, forest: Forest | None, strongest: int) -> DataFrame:
    """``near_duplicates`` with text_key, and component, null for rows that link with nothing."""
    spark, forest = docs.sparkSession, forest or Forest()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Workspace(spark, "near", SMALL_BATCHES) as ws:
        signed = ws.table(_signed(docs, width, forest), "signed")
        whole = signed.where("set_id is not null and doc_id is not null")
        reps = whole.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"))
        reps = ws.table(reps, "reps")
        links, part = few_rows(spark, {"a": [], "b": []}, "a long, b long"), few_rows(spark, {"id": [], "component": []}, "id long, component long")
        links, part = _settled(ws, docs, reps, width, percent, strongest, _candidates(ws, reps, forest, percent), links, part, "forest")
        prefixes = _prefixes(docs.where("doc_id is not null"), signed.count(), width, percent)
        _, part = _settled(ws, docs, reps, width, percent, strongest, _apart(ws, prefixes, reps, part, forest, percent), links, part, "exact")
        named = reps.select("set_id", "rep").join(part, F.col("set_id") == F.col("id"), "left").select("set_id", "rep", F.coalesce("component", "set_id").alias("component"))
        names = ws.table(named.join(named.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("set_id", "component", "component_id"), "names")
        out = signed.join(names, "set_id", "left")
        component_id = F.coalesce("component_id", "doc_id")
        kept = F.coalesce(F.col("doc_id") == component_id, F.lit(True))
        return ws.result(out.select("doc_id", "text_key", "n_shingles", "component", component_id.alias("component_id"), kept.alias("kept")))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, forest: Forest | None = None, strongest: int = 3) -> DataFrame:
    """One row a row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and split into words at space and 0x09-0x0D; a text's set is
    its distinct runs of ``width`` words, or all of its words when they are fewer. Null and
    wordless texts have no set and link with nothing. Texts whose sets have a Jaccard
    similarity of percent / 100 or more are linked; component_id is the smallest doc_id
    reached, and kept says whether it is the row's own. Equal sets are compared once, so a
    group of equal texts costs no pairs. doc_id is an integer; rows that repeat a doc_id
    with its text share the outcome; rows with a null doc_id are kept. Other columns are
    ignored. Candidates that the strongest of each document leave undecided are all
    confirmed too.
    """
    return _decided(docs, width, percent, forest, strongest).select("doc_id", "n_shingles", "component_id", "kept")


#: So many keys (24 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, forest: Forest | None = None, strongest: int = 3) -> DataFrame:
    """docs with one row of each component: the one of the smallest doc_id, of texts that
    share it the one of the smallest MD5, of equal rows the one whose JSON is smallest.

    Rows go by doc_id and text together, so a text stays that has nothing to do with
    another text of its doc_id. Rows without words or doc_id link with nothing and stay.
    """
    ws = Workspace(docs.sparkSession, "gone", SMALL_BATCHES)
    key = ["doc_id", "text_key"]
    rows = _decided(docs, width, percent, forest, strongest).where("component is not null and doc_id is not null")
    texts = ws.table(rows.groupBy(*key, "component", "kept").agg(F.count(F.lit(1)).alias("n")), "texts")
    first = texts.where("kept").groupBy("component").agg(F.min(F.struct(*key)).alias("first"))
    stays = F.col("first") == F.struct(*key)
    judged = ws.table(texts.join(first, "component").where(~stays | (F.col("n") > 1)).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"), stays.alias("again")), "judged")
    few = judged.count() <= BROADCAST_KEYS
    aside = Apart(docs)
    named = aside.df.withColumn("gone_key", F.unhex(F.md5(F.coalesce(aside["text"], F.lit("")))))
    to = lambda t: F.broadcast(t.drop("again")) if few else t.drop("again")
    met = lambda t: (aside["doc_id"].cast("long") == t["gone_id"]) & (named["gone_key"] == t["gone_key"])
    any_ = to(judged)
    kept = named.join(any_, met(any_), "left_anti")
    if judged.where("again").isEmpty():
        return aside.back(kept)
    # Equal texts of one doc_id that stay: one row of each.
    again = to(judged.where("again"))
    one = Window.partitionBy("gone_key", aside["doc_id"]).orderBy(F.to_json(F.struct(*aside.df.columns)))
    single = named.join(again, met(again), "left_semi").withColumn("nth", F.row_number().over(one)).where("nth = 1").drop("nth")
    return aside.back(kept.unionByName(single))
