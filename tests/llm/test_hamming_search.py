import random

import pytest

import epigrid.llm.hamming_search as hamming_search
from epigrid.llm.hamming_search import nearest_codes, sign_codes

MASK = 2**64 - 1


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def words(x, n):
    return [signed(x >> (64 * i) & MASK) for i in range(n)]


def brute(codes, queries, k):
    out = {}
    for q, c in queries:
        best = sorted((c ^ d).bit_count() * 10**9 + i for i, d in set(codes) if i != q)[:k]
        out[q] = [(x // 10**9, x % 10**9) for x in best]
    return out


def search(spark, codes, queries, n, k=10):
    df = spark.createDataFrame([(i, words(c, n)) for i, c in codes], "id long, code array<bigint>").repartition(3)
    asked = spark.createDataFrame([(i, words(c, n)) for i, c in queries], "id long, code array<bigint>")
    have = {}
    for r in sorted(nearest_codes(df, asked, k=k).collect(), key=lambda r: r["rank"]):
        have.setdefault(r["query_id"], []).append((r["distance"], r["id"]))
    return have


@pytest.mark.parametrize("n", [1, 2])
@pytest.mark.parametrize("kind", ["spread", "close", "one hot code", "fewer than k"])
def test_exact(spark, kind, n):
    rng = random.Random(7)
    base = [rng.getrandbits(64 * n) for _ in range(8)]
    many = 5 if kind == "fewer than k" else 400
    code = {"spread": lambda i: rng.getrandbits(64 * n), "close": lambda i: base[i % 8] ^ (1 << rng.randrange(64 * n)) ^ (1 << rng.randrange(64 * n)), "one hot code": lambda i: base[0] if i % 3 else rng.getrandbits(64 * n)}.get(kind, lambda i: rng.getrandbits(64 * n))
    codes = [(i, code(i)) for i in range(many)]
    queries = [x for x in codes if x[0] % 25 == 0]
    assert search(spark, codes + codes[:3], queries, n) == brute(codes, queries, 10)


def test_outlying_queries_are_scanned(spark, monkeypatch):
    """Few probes are allowed, so queries far from all codes are compared with all of them, in blocks."""
    monkeypatch.setattr(hamming_search, "MOST_PROBES", 40)
    monkeypatch.setattr(hamming_search, "SCANNED", 6)
    rng = random.Random(3)
    near = [rng.getrandbits(30) for _ in range(300)]
    codes = list(enumerate(near))
    queries = codes[:3] + [(1000 + i, (2**64 - 1) ^ rng.getrandbits(6)) for i in range(9)]
    assert search(spark, codes, queries, 1) == brute(codes, queries, 10)


def test_codes_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0, -1.0, 0.0, float("nan"), None, 2.0], "x"), (2, None, "y"), (None, [1.0], "z"), (3, [], "c")], "v long, e array<double>, code string")
    assert {(r.id, tuple(r.code)) for r in sign_codes(df, "v", "e").collect()} == {(1, (0b100001,)), (3, (0,))}
    empty = sign_codes(df.limit(0), "v", "e")
    assert nearest_codes(empty, empty).count() == 0


def test_a_hundred_components(spark):
    rng = random.Random(5)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(100 if i % 9 else 70)]) for i in range(200)]
    codes = [(i, sum(1 << j for j, x in enumerate(v) if x > 0)) for i, v in vectors]
    got = sign_codes(spark.createDataFrame(vectors, "v long, e array<float>"), "v", "e")
    assert {r.id: list(r.code) for r in got.collect()} == {i: words(c, 2) for i, c in codes}
    have = {}
    for r in sorted(nearest_codes(got, got.where("id % 50 = 0"), k=5).collect(), key=lambda r: r["rank"]):
        have.setdefault(r["query_id"], []).append((r["distance"], r["id"]))
    assert have == brute(codes, [c for c in codes if c[0] % 50 == 0], 5)
