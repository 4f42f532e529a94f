"""Ranked search against plain Python, over trees of several levels, ties and odd rows."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from helpers import odd_docs, odd_rows

from epigrid.llm import lexical_search
from epigrid.llm.lexical_search import ranked_search

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, queries, k=10):
    """docs: (id, text); queries: (id, text). Rows (query id, rank, doc id, score)."""
    held = [(i, Counter(t := terms(x)), len(t)) for i, x in docs]
    held = [h for h in held if h[2]]
    n, total = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for q, text in set(queries):
        scored = []
        for i, c, length in held:
            m = 25 + (75 * length * n) // total
            s = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return out


def run(spark, docs, queries, k=10, parts=5):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return ranked_search(d, spark.createDataFrame(queries, "item_id long, text string"), k)


def rows(found):
    return sorted(map(str, (tuple(r) for r in found)))


def test_odd_rows(spark):
    docs = [(r[0], r[1]) for r in odd_rows()]
    queries = [(1, "The house of STONE"), (2, "über naïve 日本 ÜBER the"), (3, None), (4, ""), (5, "nowhere, ever"), (6, "lang lang don't"), (6, "river"), (1, "The house of STONE"), (None, "42 and no id")]
    got = ranked_search(odd_docs(spark), spark.createDataFrame(queries, "item_id long, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(got.collect()) == rows(brute(docs, queries))


@pytest.mark.parametrize("ranges", [(4096, 16), (64, 4), (7, 2)])
def test_trees_of_any_shape(spark, monkeypatch, ranges):
    """Many documents tie; the word that all share weighs little, and copies come in hundreds."""
    monkeypatch.setattr(lexical_search, "RANGE", ranges[0])
    monkeypatch.setattr(lexical_search, "LEAF", ranges[1])
    rng = random.Random(4)
    words = [f"w{i}" for i in range(80)]
    docs = [(i, "all " + " ".join(rng.choices(words, [1 / (j + 1) for j in range(80)], k=rng.choice([1, 5, 40])))) for i in range(700)]
    docs += [(5000 - i, "all w79 w78 copy") for i in range(300)]
    queries = [(i, " ".join(rng.sample(words, 3))) for i in range(25)] + [(100, "copy all"), (101, "all"), (102, "w79 w79 w78")]
    # RANGE travels with the function; workers read LEAF afresh, so the next test tries it on trees.
    assert rows(run(spark, docs, queries).collect()) == rows(brute(docs, queries))
    assert rows(run(spark, docs, queries, k=3, parts=1).collect()) == rows(brute(docs, queries, 3))


@pytest.mark.parametrize("fan, leaf", [(2, 1), (3, 4), (16, 16)])
def test_a_tree_finds_the_best_and_all_that_tie(monkeypatch, fan, leaf):
    monkeypatch.setattr(lexical_search, "FAN", fan)
    monkeypatch.setattr(lexical_search, "LEAF", leaf)
    rng = np.random.default_rng(fan)
    for size in (1, 2, 15, 16, 17, 300):
        hits = rng.random((6, size)) < 0.3
        counts = rng.integers(1, 3, (6, size)) * hits
        lengths = rng.integers(5, 8, size).astype(np.int64)
        term, place = np.nonzero(hits)
        present, starts = np.unique(term, return_index=True)
        ids = rng.permutation(size).astype(np.int64)
        row = {"ids": ids, "known": np.ones(size, bool), "lengths": lengths, "terms": present.astype(np.int32), "starts": starts.astype(np.int32), "places": place.astype(np.int32), "counts": counts[term, place].astype(np.int64)}
        tree = lexical_search.Tree({k: v.tobytes() for k, v in row.items()}, size, int(lengths.sum()))
        gains = np.zeros((6, size), np.int64)
        gains[term, place] = tree.gains
        for asked, floor in (([0, 1], 1), ([2, 3, 4, 5], 1), ([1, 9], 1), ([0, 1, 2], 2_000_000)):
            real = [t for t in asked if t < 6]
            w = np.arange(1, len(asked) + 1)
            scores = (w[: len(real), None] * gains[real]).sum(0)
            want = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if s >= floor)[:4]
            assert [(-s, i) for s, _, i in tree.search(np.array(asked, np.int32), w, 4, floor)] == want


def test_the_search_leaves_most_leaves_closed(monkeypatch):
    """Of 4096 documents, 20 hold a rare term: few leaves are opened for it."""
    size, rare = 4096, np.arange(20) * 200
    row = {"ids": np.arange(size), "known": np.ones(size, bool), "lengths": np.full(size, 10), "terms": np.arange(2, dtype=np.int32), "starts": np.array([0, size], np.int32), "places": np.concatenate([np.arange(size), rare]).astype(np.int32), "counts": np.ones(size + 20, np.int64)}
    tree = lexical_search.Tree({k: v.tobytes() for k, v in row.items()}, size, size * 10)
    opened, real = [], lexical_search.Tree.scores
    monkeypatch.setattr(lexical_search.Tree, "scores", lambda self, leaf, *x: (opened.append(leaf), real(self, leaf, *x))[1])
    found = tree.search(np.array([0, 1]), np.array([1, 50]), 10, 1)
    assert [i for *_, i in found] == rare[:10].tolist() and len(opened) <= 20


def test_long_texts_are_read_in_windows(monkeypatch):
    monkeypatch.setattr(lexical_search, "WINDOW", 7)
    text = "Eine ganz-lange Straße, averyveryverylongword; x"
    assert [t.decode() for some in lexical_search.terms_of(text.encode()) for t in some] == terms(text)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_QUERIES", 3)
    docs = [(r[0], r[1]) for r in odd_rows(2)]
    queries = [(i, t) for i, t in enumerate(["the", "of house", "42", "river stone", "", "über", "they ll"])]
    assert rows(run(spark, docs, queries).collect()) == rows(brute(docs, queries))


@pytest.mark.parametrize("docs, queries", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None), (2, "--")], [(1, "a")]), ([(1, "b")], [(1, "a")]), ([], [])])
def test_empty(spark, docs, queries):
    found = run(spark, docs, queries, parts=1)
    assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]
