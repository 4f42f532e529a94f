"""Mined negatives against plain Python integers; bounds hold; the filter filters."""

import math
from collections import Counter

import numpy as np
import pytest

from epigrid.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, a long, score string"


def brute(rows, anchor, positives=5, negatives=3):
    """rows: (id, vector, label). Counter of result rows."""
    held = set()
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.add((i, tuple(math.floor(256 * float(np.float32(x))) for x in v), y))
    out = Counter()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for i, v, y in held:
        if not anchor(i):
            continue
        scored = sorted((-dot(v, w), j, z) for j, w, z in held if j != i)
        same = [(j, -s) for s, j, z in scored if z == y][:positives]
        for j, s in same:
            windowed = [(k, -t) for t, k, z in scored if z != y and 50 * s <= 100 * -t <= 95 * s][:negatives]
            for rank, (k, t) in enumerate(windowed, 1):
                out[i, j, rank, k, s, t] += 1
    return out


def mined(spark, rows, anchors="id % 10 = 0", parts=4, **more):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(parts)
    return Counter(tuple(r) for r in hn.hard_negatives(df, anchors, **more).collect())


def clustered(n, d, seed=1, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, (labels, d))
    return [(i, (centres[i % labels] + rng.normal(0, 0.15, d)).astype(np.float32).tolist(), int(rng.integers(0, labels))) for i in range(n)]


@pytest.mark.parametrize("n, d", [(400, 8), (300, 33), (250, 1)])
def test_against_plain_python(spark, n, d):
    rows = clustered(n, d)
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_many_small_blocks_and_groups(spark, monkeypatch):
    for name, value in (("LEAST_BLOCK", 40), ("GROUP", 7), ("SAMPLE", 50)):
        monkeypatch.setattr(hn, name, value)
    rows = clustered(500, 16, seed=3)
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    some = [rng.integers(-1, 2, 4).astype(np.float32).tolist() for _ in range(12)]
    rows = [(i, some[int(rng.integers(0, 12))], int(rng.integers(0, 3))) for i in range(200)]  # nearly all tie
    rows += [(1000 + i, some[0], 1) for i in range(300)]  # one hot vector
    rows += [rows[0], rows[0], rows[10]]  # repeated rows
    rows += [(20, some[3], 2), (30, some[4], 0)]  # ids of other rows again
    rows += [(None, some[1], 1), (400, None, 1), (410, some[1], None), (420, [1.0, None], 1), (430, [math.nan, 1.0], 1), (440, [math.inf], 1), (450, [], 1), (460, [1.0], 1), (470, [1.0, 2.0, 3.0, 4.0, 5.0], 2)]
    want = brute(rows, lambda i: i % 10 == 0)
    assert want and mined(spark, rows) == want


def test_large_components(spark):
    rows = [(i, [float(1 << (i % 20)), 3.0 * i, -float(i)], i % 2) for i in range(60)] + [(70, [3e38, 1.0], 1), (80, [-1e12, 0.0], 0)]
    assert mined(spark, rows) == brute(rows[:60], lambda i: i % 10 == 0)


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, None, None)]])
def test_few_rows(spark, rows):
    assert mined(spark, rows) == Counter()


def test_bounds_hold_and_leave_little_to_score():
    rng = np.random.default_rng(2)
    vectors = np.floor(256 * rng.normal(0, 0.125, (5000, 64))).astype(np.int32)
    books = hn.fit_codebooks(vectors[:4096])
    codes, left = hn.encode(vectors, books)
    block = hn.Block(np.zeros(5000, np.int64), vectors, codes, left, [[i] for i in range(5000)])
    anchors = vectors[:20].astype(np.int64)
    low, high = block.ranges(anchors, books, slice(0, 5000))
    true = anchors @ vectors.astype(np.int64).T
    assert ((low <= true) & (true <= high)).all()
    scored = 0
    for i in range(20):
        best, tried = hn.best_rows(block, anchors[i], np.arange(5000), low[i], high[i], 6)
        assert sorted(s for s, _ in best)[-6:] == sorted(true[i])[-6:]
        scored += tried
        window = (int(true[i, i]) // 8, int(true[i, i]) // 4)
        best, tried = hn.best_rows(block, anchors[i], np.arange(5000), low[i], high[i], 3, *window)
        inside = sorted(t for t in true[i] if window[0] <= t <= window[1])
        assert sorted(s for s, _ in best)[-3:] == inside[-3:]
    assert scored < 20 * 5000 * 0.1


def test_a_poor_codebook_changes_nothing(spark, monkeypatch):
    rows = clustered(300, 6, seed=9)
    want = mined(spark, rows)
    monkeypatch.setattr(hn, "fit_codebooks", lambda sample: np.zeros((3, hn.CODES, 2), np.int64))
    assert mined(spark, rows) == want == brute(rows, lambda i: i % 10 == 0)
