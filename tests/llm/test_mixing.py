import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from helpers import odd_docs, odd_rows
from pyspark.sql import functions as F

from epigrid.llm.mixing import mix_report, mixed_documents

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        free = budget - sum(most * sizes[s] for s in full)
        level = free / sum(w[s] for s in names if s not in full) if len(full) < len(names) else 0
        more = {s for s in names if s not in full and level * w[s] >= most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else level * w[s] for s in names}
        full |= more


def spark_hash(*values):
    """xxhash64 of Spark over an int seed, then longs; null leaves the hash as it is."""
    h = 42
    for kind, v in zip("iqq", values, strict=False):
        h = h if v is None else xxhash.xxh64_intdigest(struct.pack("<" + kind, v), seed=h)
    return h - 2**64 if h >= 2**63 else h


def brute(rows, repeats=2, seed=17):
    """(source, size, taken words) by (doc_id, source, size): one queue of all sources, in plain Python, and then
    shorter documents into what is left of each target, in turns."""
    keys = Counter((r[0], r[3], len(WORDS.findall(r[1] or ""))) for r in rows)
    sizes = Counter()
    for (_, s, n), k in keys.items():
        sizes[s] += n * k
    want, own = targets(sizes, (5, 2, 1)), defaultdict(list)
    for (i, s, n), k in keys.items():
        own[s].append(((spark_hash(seed, i, n), i is not None, i or 0, n), n, n * k, (i, s, n)))
    queue = []
    for s, docs in own.items():
        at = 0
        for turn in range(repeats):
            for place, n, mass, key in sorted(docs):
                at += mass
                queue.append((at / want[s] if want[s] else 9e9, turn, place, mass, key, n))
    taken, total, budget = Counter(), 0, sum(want.values())
    copies, last = Counter(), {}
    for finish, turn, place, mass, key, _ in sorted(queue, key=lambda q: (q[0], q[1], q[2][0], q[4][1] is not None, q[4][1] or "", q[2])):
        if mass and finish <= 1 + 1e-12 and total + mass <= budget + 1e-3:
            copies[key] += 1
            taken[key[1]] += mass
            last[key[1]] = (turn, place)
        total += mass
    return sizes, want, copies, taken, last


def test_every_decision_against_plain_python(spark):
    rows = odd_rows(n=300)
    sizes, want, copies, main, _ = brute(rows)
    got = mix_report(odd_docs(spark, n=300)).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    taken, left, extra = Counter(), defaultdict(list), 0
    for r in got:
        s = source[r.doc_id]
        key = (r.doc_id, s, r.size)
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size and r.taken >= copies[key] * r.size
        extra += r.taken - copies[key] * r.size
        taken[s] += r.taken
        if r.taken < 2 * r.size:
            left[s].append(r.size)
    for s in sizes:
        assert main[s] <= taken[s] <= want[s] + 1e-6
        # What is left of a target holds no document that is not taken as often as may be.
        assert not left[s] or want[s] - taken[s] < max(left[s])
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())


def test_a_document_too_long_for_the_rest_is_passed_over(spark):
    """One source whose next document is long ends near its target all the same."""
    rows = [(i, "w " * (3000 if i % 25 == 0 else 20 + i % 7), "ab"[i % 2]) for i in range(400)]
    got = mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)).toPandas()
    for s, r in got.assign(source=got.doc_id.map(lambda i: "ab"[i % 2])).groupby("source"):
        assert 0 <= r.target.iloc[0] - r.taken.sum() < 30


def test_extra_columns_of_any_name(spark):
    docs = odd_docs(spark)
    more = docs.select("*", *[F.lit(f"mine {n}").alias(n) for n in ("_size", "_copy", "copy", "copies", "cut", "fills", "own_0", "of", "source_size")])
    a, b = mixed_documents(docs), mixed_documents(more)
    assert b.columns == more.columns
    rows = b.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in a.collect())
    assert {(r["_copy"], r["_size"], r["copy"], r["own_0"]) for r in rows} == {("mine _copy", "mine _size", "mine copy", "mine own_0")}


def test_reruns_agree_and_rows_multiply(spark):
    docs = odd_docs(spark)
    a, b = mix_report(docs).toPandas(), mix_report(docs.repartition(3)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert a.sort_values(key)[key].fillna(-1).values.tolist() == b.sort_values(key)[key].fillna(-1).values.tolist()
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    rows = mixed.toPandas()
    assert sum(len(WORDS.findall(t or "")) for t in rows.text) == a.taken.sum()
    assert rows.groupby(["doc_id", "text"]).size().max() <= 2 * 3  # one row stands three times in the input


def test_empty_and_wordless_tables(spark):
    docs = odd_docs(spark)
    assert mix_report(docs.limit(0)).count() == 0
    none = docs.where("text is null or trim(text) = ''")
    assert {r.taken for r in mix_report(none).collect()} <= {0}
