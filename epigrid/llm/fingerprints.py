"""Context-triggered piecewise hashing of documents.

A rolling hash over seven bytes ends a chunk where it hits a residue of the block
size; each chunk gives one character. Of a chunk more than 16 times in a row the first 16
do, and after them the number of the others in base 64, so that periodic texts of different
lengths differ. Fingerprints of like block sizes are compared by the edit distance
(insertions and deletions) of their signatures.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, mix, powers

LENGTH, LEAST, SPAN, COMMON, RUN = 64, 3, 7, 7, 16
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_SYMBOLS = np.frombuffer(ALPHABET.encode(), np.uint8)
_ROLL = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def _triggers(data: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that end a chunk at block size LEAST * 2**exponent, and for each the
    largest exponent at which it still does."""
    value = _ROLL[data]
    roll = np.zeros(len(data), np.uint32)
    for j in range(min(SPAN, len(data))):
        roll[j:] += value[: len(data) - j] * np.uint32(pow(0x9E3779B1, j, 1 << 32))
    roll ^= roll >> np.uint32(15)
    at = np.flatnonzero((roll & np.uint32((1 << exponent) - 1)) == 0) if exponent else np.arange(len(data))
    at = at[roll[at] % np.uint32(LEAST) == 0]
    low = roll[at].astype(np.int64)
    return at, np.where(low == 0, 32, np.log2(np.maximum(low & -low, 1)).astype(np.int64))


def _chunks(data: np.ndarray, total: np.ndarray, down: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols (0 to 63) of the chunks; of a chunk many times in a row the first RUN count, and
    the digits of how many more there are, the last first."""
    ends = ends + 1
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    starts = np.append(0, ends[:-1])
    raw = total[ends - 1] - np.where(starts > 0, total[starts - 1], np.uint64(0))
    h = mix(raw * down[starts] + (ends - starts).astype(np.uint64))
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(first, len(h)))
    place = np.arange(len(h)) - np.repeat(first, size)
    symbol = (h >> np.uint64(58)).astype(np.int64)
    keep = place < RUN
    for begin, more in zip(first[size > RUN], size[size > RUN] - RUN, strict=True):
        at = begin + RUN
        while more:
            symbol[at], keep[at] = more & 63, True
            at, more = at + 1, more >> 6
    return symbol[keep]


def fingerprint(text: bytes) -> str:
    """``block size:signature:signature at twice the block size``. The block size is the
    least that gives about 64 chunks for the length, doubled while there are over 128;
    signatures cover the whole text."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return f"{LEAST}::"
    up, down = powers(len(data))
    total = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)
    k = 0
    while (LEAST << k) * LENGTH < len(data):
        k += 1
    at, level = _triggers(data, k)
    now, then = (_chunks(data, total, down, at[level >= k + i]) for i in (0, 1))
    while max(len(now), len(then)) > 2 * LENGTH:
        k += 1
        now, then = then, _chunks(data, total, down, at[level >= k + 1])
    first, second = (_SYMBOLS[x].tobytes().decode() for x in (now, then))
    return f"{LEAST << k}:{first}:{second}"


def _common_run(a: str, b: str) -> bool:
    n = min(COMMON, 1 + min(len(a), len(b)) // 4)
    return any(a[i : i + n] in b for i in range(len(a) - n + 1))


def common_lengths(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Lengths of the longest common subsequences, bit-parallel, over all pairs at once
    (signatures have at most 2 * LENGTH characters, two words of bits)."""
    if not pairs:
        return np.zeros(0, np.int64)
    a = np.zeros((len(pairs), 2 * LENGTH), np.uint8)
    b = np.full((len(pairs), 2 * LENGTH), 255, np.uint8)
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)] = np.frombuffer(x.encode(), np.uint8)
        b[i, : len(y)] = np.frombuffer(y.encode(), np.uint8)
    v = np.full((2, len(pairs)), np.uint64(0xFFFFFFFFFFFFFFFF))
    for j in range(max(len(y) for _, y in pairs)):
        same = np.packbits(a == b[:, j, None], axis=1, bitorder="little").view(np.uint64).T
        u = v & same
        low = v[0] + u[0]
        high = v[1] + u[1] + (low < u[0]).astype(np.uint64)  # with the carry
        v = np.stack([low, high]) | (v - u)
    return np.bitwise_count(~v).sum(0).astype(np.int64)


def similarities(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Likeness from 0 to 1 of pairs of fingerprints: 1 less the edit distance over the
    signatures' lengths, the best of those at equal block sizes; 0 without a common run."""
    out, todo = np.zeros(len(pairs)), []
    for i, (x, y) in enumerate(pairs):
        if x == y:
            out[i] = 1.0
            continue
        (p, p1, p2), (q, q1, q2) = x.split(":"), y.split(":")
        p, q = int(p), int(q)
        for s, t in ((p1, q1), (p2, q2)) if p == q else ((p1, q2),) if p == 2 * q else ((p2, q1),) if q == 2 * p else ():
            if s and t and _common_run(s, t):
                todo.append((i, s, t))
    same = common_lengths([(s, t) for _, s, t in todo])
    for (i, s, t), n in zip(todo, same, strict=True):
        out[i] = max(out[i], 2 * n / (len(s) + len(t)))
    return np.round(out, 6)


def edited_with(text: str, following: str) -> str:
    """text with its last quarter replaced by as much of the beginning of another."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compared(ids: list, texts: list, own: list, following: list, theirs: list) -> list:
    changed = [edited_with(a, b).encode() for a, b in zip(texts, following, strict=True)]
    prints = [fingerprint(x) for x in changed]
    likes = similarities([*zip(own, prints, strict=True), *zip(own, theirs, strict=True)]).tolist()
    n = len(ids)
    return [ids, [len(x) for x in texts], [hashlib.sha256(x).hexdigest() for x in changed], own, prints, likes[:n], likes[n:]]


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of docs and of its edited text (``edited_with`` the next
    document by doc_id; after the last comes the first), with likenesses.

    docs: doc_id, text (null: empty). Rows of one doc_id follow each other by text; a null
    doc_id comes first. A single row is its own next. Empty docs: no rows.
    One range shuffle puts neighbours together; where a partition ends, the first row of
    the next one is joined on (one row a partition).
    """
    import pyarrow as pa

    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"{fields}, edge int, part int, text string"

    def rows(id_type, columns: list, edge: int, part: int, texts: list):
        n = len(columns[0])
        types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([edge] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(texts, pa.string())], names=[*names, "edge", "part", "text"])

    def walk(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                piece = batch.slice(lo, 500)
                ids = piece.column(0).to_pylist()
                texts = [x or "" for x in piece.column(1).to_pylist()]
                prints = [fingerprint(x.encode()) for x in texts]
                id_type = piece.column(0).type
                if held is None:
                    yield rows(id_type, [[ids[0]], [len(texts[0])], [None], [prints[0]], [None], [None], [None]], 1, part, [texts[0]])
                else:
                    ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
                if len(ids) > 1:
                    yield rows(id_type, _compared(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:]), 0, part, [None] * (len(ids) - 1))
                held = ids[-1], texts[-1], prints[-1]
        if held is not None:
            yield rows(id_type, [[held[0]], [len(held[1])], [None], [held[2]], [None], [None], [None]], 2, part, [held[1]])

    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    done = Workspace(spark, "fingerprints").result(ranged.mapInArrow(walk, schema))
    parts = sorted(r["part"] for r in done.where("edge = 2").select("part").collect())  # one a partition
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    firsts = done.where("edge = 1").select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    lasts = done.where("edge = 2").select("part", "doc_id", "text", "fingerprint")
    edges = lasts.join(F.broadcast(after), "part").join(firsts, "next").select("doc_id", "text", "fingerprint", "next_text", "next_print")

    def close(batches):
        for b in batches:
            c = [x.to_pylist() for x in b.columns]
            if c[0]:
                yield rows(b.column(0).type, _compared(*c), 0, 0, [None] * len(c[0])).select(names)

    return done.where("edge = 0").select(*names).unionByName(edges.mapInArrow(close, fields))
