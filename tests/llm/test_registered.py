"""The registered queries themselves, on the smallest tables, against plain Python or SQL."""

import hashlib
import os
import struct
import zlib
from collections import Counter, defaultdict
from math import log

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from test_mixing import brute as mix_brute
from test_near_dedup import brute as near_brute
from test_suffix_dedup import brute as repeats_brute

from epigrid.llm import queries
from epigrid.llm.fingerprints import edited_with, fingerprint, similarities
from epigrid.llm.tokens import default_vocabulary

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    d = pd.read_parquet(f"{DATA}/documents.parquet")
    return [(int(r.doc_id), None if r.text is None else r.text, r.lang, r.source) for r in d.itertuples()]


@pytest.mark.parametrize("name", ["op4_lines", "op5_search", "op11_ranked", "op12_shards", "op13_negatives"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, DATA).toPandas()[list(want.columns)]
    rows = lambda d: sorted(tuple("null" if pd.isna(x) else str(x) for x in r) for r in d.itertuples(index=False))
    assert rows(got) == rows(want)


def test_op1(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(default_vocabulary())
    got = queries.op1_pack(spark, DATA).collect()
    want = []
    for i, t, *_ in docs:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        at, n, piece = 0, len(ids) % 2048 or 2048, 0
        while at < len(ids):
            want.append((i, piece, at, n, zlib.crc32(struct.pack(f"<{n}I", *ids[at : at + n]))))
            at, n, piece = at + n, 2048, piece + 1
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(w[3] for w in want) // 2048) + 2


def test_op2(spark, docs):
    sizes, want, copies, main, _ = mix_brute([(i, t, None, s) for i, t, _, s in docs])
    got, source, taken = queries.op2_mix(spark, DATA).collect(), {d[0]: d[3] for d in docs}, Counter()
    assert len(got) == len(docs)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert copies[(r.doc_id, s, r.size)] * r.size <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(main[s] <= taken[s] <= want[s] + 1e-6 for s in sizes)
    again = queries.op2_mix(spark, DATA).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_op3(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(default_vocabulary())
    count = lambda t: len(whole.encode(t, add_special_tokens=False).ids)
    text = {d[0]: d[1] or "" for d in docs}
    for r in queries.op3_token_counts(spark, DATA).collect():
        t = text[r.doc_id]
        n, new = len(t), t
        for start, removed, inserted in ((n // 2, 12, ""), (n // 3, 0, t[:10]), (n // 5, 5, " they'll see 42 ")):
            new = new[:start] + inserted + new[start + removed :]
        assert (r.n_tokens, r.n_tokens_edited) == (count(t), count(new))


def test_op6(spark, docs):
    rows = sorted((i, t or "") for i, t, *_ in docs)
    got = {r.doc_id: r for r in queries.op6_fingerprint(spark, DATA).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        new = edited_with(t, following).encode()
        own, theirs, changed = fingerprint(t.encode()), fingerprint(following.encode()), fingerprint(new)
        near = similarities([(own, changed), (own, theirs)])
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(new).hexdigest(), own, changed)
        assert (r.near_edited, r.near_next) == tuple(near)


@pytest.mark.parametrize("partitions", [5, 50, 211])
def test_op7_at_any_number_of_partitions(spark, docs, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op7_near(spark, DATA).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == near_brute([(i, t) for i, t, *_ in docs], 4, 80)


def test_op8(spark, docs):
    got = {r.doc_id: r for r in queries.op8_language(spark, DATA).collect()}
    names = {d[2] for d in docs if d[2] is not None and zlib.crc32(str(d[0]).encode()) % 4 != 2}
    right = []
    for i, t, lang, _ in docs:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not t or not any(map(str.isalpha, t)))
        assert r.lang_pred in names | {"und"}
        if r.held_out and lang is not None:
            right.append(r.lang_pred == lang)
    assert np.mean(right) > 0.9


def test_op9(spark, docs):
    got = queries.op9_repeats(spark, DATA).collect()
    want = Counter((i, n, gone, spans, hashlib.sha256(kept).hexdigest(), len(kept), kept.decode("utf-8", "replace")) for (i, n, gone, spans, kept), k in repeats_brute([(i, t) for i, t, *_ in docs], 400).items() for _ in range(k))
    cut = lambda r: r[:6]  # noqa: E731  (how broken characters are shown is not compared)
    assert Counter(map(cut, want)) == Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_kept) for r in got)


def test_op10_draws_by_gumbel_keys(spark, docs):
    """Keys follow from weights and ids, and the largest are drawn."""
    got = queries.op10_quality(spark, DATA).collect()
    labels = pd.read_parquet(f"{DATA}/labels.parquet")
    keep = labels.quality.sum() / labels.quality.count()
    assert len(got) == len(docs) and sum(r.selected for r in got) == round(keep * len(docs))
    for r in got:
        h = xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), seed=xxhash.xxh64_intdigest(struct.pack("<i", 30), seed=42))
        h = h - 2**64 if h >= 2**63 else h
        u = ((h % 2**52) + 0.5) / 2**52
        assert r.gumbel_key == pytest.approx(r.log_weight - log(-log(u)), rel=1e-9)
    least = min(r.gumbel_key for r in got if r.selected)
    assert all(r.selected == (r.gumbel_key >= least) for r in got)


def test_op12(spark, docs):
    from epigrid.llm.sharding import permuted

    got = queries.op12_shards(spark, DATA).collect()
    order = sorted(docs, key=lambda d: d[0])
    places = permuted(np.arange(len(docs)), len(docs))
    want = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "rows", int(p % 40), int(p // 40), None) for (i, t, *_), p in zip(order, places, strict=True)]
    assert sorted(tuple(r) for r in got) == sorted(want)
