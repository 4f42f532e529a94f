import random
import time
from collections import Counter

import numpy as np
import pytest
from helpers import odd_docs, odd_rows

import epigrid.llm.suffix_dedup as suffix_dedup
from epigrid.llm.suffix_dedup import Solver, minimizer_runs, remove_repeats, repeated_starts, repeats_within


def starts(texts, width):
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    return [np.array([count[t[i : i + width]] > 1 for i in range(max(0, len(t) - width + 1))], bool) for t in texts]


def fixture(seed, alphabet):
    rng = random.Random(seed)
    base = bytes(rng.choices(alphabet, k=300))
    junk = lambda: bytes(rng.choices(alphabet, k=rng.randrange(60)))
    texts = []
    for _ in range(12):
        i = rng.randrange(250)
        texts.append(junk() + base[i : i + rng.randrange(5, 120)] + junk())
    return [*texts, alphabet[:1] * 100, alphabet[:2] * 80, b"", alphabet[:3]]


@pytest.mark.parametrize("width", [4, 7, 16, 40])
@pytest.mark.parametrize("alphabet", [b"ab", b"abcdefgh", bytes(range(97, 123))])
def test_transform_and_minimizers_against_counting(width, alphabet):
    for seed in range(4):
        texts = fixture(seed, alphabet)
        want = starts(texts, width)
        flags, at = repeated_starts(texts, width), 0
        for t, w in zip(texts, want, strict=True):
            assert (flags[at : at + len(w)] == w).all()
            at += len(t) + 1
        groups, of = {}, {}
        for v, o, s, c, p, q in zip(*(x.tolist() for x in minimizer_runs(texts, width)), strict=True):
            piece = texts[o][s : s + c + width - 1]
            groups.setdefault(v, {}).setdefault(piece, [p, q - s, 0])[2] += 1
            of.setdefault((v, piece), []).append((o, s))
        solver, got = Solver(width), [np.zeros(len(w), bool) for w in want]
        for v, g in groups.items():
            solver.add([((v, piece), piece, p, q, n) for piece, (p, q, n) in g.items()])
        for key, begins, ends in solver.solve():
            for o, s in of[key]:
                for a, b in zip(begins, ends, strict=True):
                    got[o][s + a : s + b] = True
        assert all((g == w).all() for g, w in zip(got, want, strict=True))


def brute(rows, width):
    texts = [(r[1] or "").encode() for r in rows]
    out = []
    for r, t, s in zip(rows, texts, starts(texts, width), strict=True):
        gone = np.zeros(len(t), bool)
        for i in np.flatnonzero(s):
            gone[i : i + width] = True
        spans = int(np.sum(np.diff(np.append(0, gone.astype(int))) == 1))
        out.append((r[0], len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return Counter(out)


@pytest.mark.parametrize(("hot", "long"), [(1 << 20, 1 << 20), (70, 1 << 20), (1 << 20, 128), (70, 100)])
def test_removal_against_counting(spark, monkeypatch, hot, long):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # 70: all groups of two runs are split over tasks
    monkeypatch.setattr(suffix_dedup, "LONG", long)  # 128: most texts are scanned in stretches
    rows = [(r[0], r[1][:3000] if r[1] else r[1], *r[2:]) for r in odd_rows()]
    base = "Passage that many documents share, with its own words 0123456789. " * 3
    rows += [(1000 + i, f"{i * 7919} before {i} " + base[: 60 + 9 * i] + f" after {i * i}", None, None, 0, 1, 2.0, 3, 4, 5, "v", "h") for i in range(15)]
    from helpers import SCHEMA

    got = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4), width=50).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute(rows, 50)


def test_empty_table(spark):
    assert remove_repeats(odd_docs(spark).limit(0)).count() == 0


def test_strings_within_a_piece_enter_once():
    for text in (b"a" * 300, b"abc" * 100, b"xyz" + b"abcd" * 50 + b"q", bytes(range(200)), b"ab" * 30 + b"ba" * 30):
        n = len(text) - 9
        again, ranges = repeats_within(text, 10, 0, n)
        count = Counter(text[i : i + 10] for i in range(n))
        assert again.tolist() == [count[text[i : i + 10]] > 1 for i in range(n)]
        once = [text[i : i + 10] for a, b in ranges for i in range(a, b)]
        assert sorted(once) == sorted(count)


def test_long_periodic_texts_take_seconds(spark):
    rows = [(1, "a" * 5_000_000), (2, "xyz " * 500_000), (3, "b" + "a" * 400 + "c"), (4, "d" + "a" * 399 + "e")]
    began = time.time()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width=400).collect()}
    assert got == {1: (5_000_000, 5_000_000, 1), 2: (2_000_000, 2_000_000, 1), 3: (402, 400, 1), 4: (401, 0, 0)}
    assert time.time() - began < 60
