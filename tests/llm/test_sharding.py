"""The permutation is one, shards are even and computable, odd rows pass."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import odd_docs, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from epigrid.llm import sharding


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 1 << 40))
def test_permutation_and_inverse(n, seed):
    there = sharding.permuted(np.arange(n), n, seed)
    assert sorted(there.tolist()) == list(range(n))
    assert sharding.unpermuted(there, n, seed).tolist() == list(range(n))


def test_large_counts_stay_within_64_bits():
    n = 3 * 10**17 + 7
    some = np.random.default_rng(1).integers(0, n, 10_000)
    there = sharding.permuted(some, n, 5)
    assert ((there >= 0) & (there < n)).all() and len(set(there.tolist())) == len(set(some.tolist()))
    assert (sharding.unpermuted(there, n, 5) == some).all()


def test_places_look_random():
    n = 100_000
    there = sharding.permuted(np.arange(n), n)
    assert abs(np.corrcoef(np.arange(n), there)[0, 1]) < 0.02
    assert abs((np.diff(there) > 0).mean() - 0.5) < 0.01
    runs = np.bincount(there[:4000] % 40, minlength=40)  # neighbours spread over the shards
    assert runs.min() > 60 and runs.max() < 150
    assert (sharding.permuted(np.arange(n), n, 1) != there).mean() > 0.99


def test_report(spark):
    rows = odd_rows()
    got = sharding.shard_report(odd_docs(spark), shards=7).collect()
    size = lambda t: len((t or "").encode()) + 16
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r[0], size(r[1]), crc(r[1])) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(7)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    # Each row stands where its number says, and a run over other partitions agrees.
    order = sorted(((r[0] is not None, r[0] or 0), size(r[1]), crc(r[1])) for r in rows)
    places = sharding.permuted(np.arange(len(rows)), len(rows))
    want = sorted((k[0][1] if k[0][0] else None, k[1], k[2], int(p % 7), int(p // 7)) for k, p in zip(order, places, strict=True) if k[0][0])
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got if r.doc_id is not None) == want
    again = sharding.shard_report(odd_docs(spark).repartition(9), shards=7).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_shards_hold_texts_and_any_slot_is_computable(spark, tmp_path):
    rows = [(i, f"text {i}", i % 3, "mine") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, `a.b` string").repartition(6)
    placed = sharding.shuffled_shards(docs, ["doc_id"], shards=8, seed=3)
    assert placed.columns == ["doc_id", "text", "own_shard", "a.b", "number", "shard", "slot"]
    sharding.write_shards(placed, str(tmp_path / "shards"), rows_per_file=50)
    held = spark.read.parquet(str(tmp_path / "shards" / "shard=5")).collect()
    by_slot = {r.slot: r.text for r in held}
    wanted = sharding.rows_at(5, np.arange(125), 1000, 8, seed=3)
    assert [by_slot[i] for i in range(125)] == [f"text {j}" for j in wanted]
    assert len(list((tmp_path / "shards" / "shard=5").glob("run=*"))) == 3


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    docs = spark.createDataFrame([(i, None) for i in range(n)], "doc_id long, text string")
    got = sharding.shard_report(docs).collect()
    assert sorted((r["size"], r.text_crc32, r.slot) for r in got) == [(16, 0, 0)] * n and len({r.shard for r in got}) == n


def test_one_key_for_all_rows_is_dealt_to_many_tasks(spark):
    docs = spark.range(0, 5000, 1, 6).selectExpr("cast(null as long) as doc_id", "'same' as text")
    got = sharding.shard_report(docs, shards=40)
    assert got.groupBy("shard").count().agg({"count": "max"}).first()[0] == 125 and got.select("shard", "slot").distinct().count() == 5000
