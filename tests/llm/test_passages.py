import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, odd_docs, odd_rows
from pyspark.sql import functions as F

import epigrid.llm.passages as passages
from epigrid.llm.suffix_dedup import remove_repeats

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute(rows, width):
    texts = [re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode().translate(LOWER)) for r in rows]
    holders = {}
    for i, t in enumerate(texts):
        for j in range(len(t) - width + 1):
            holders.setdefault(tuple(t[j : j + width]), set()).add(i)
    out = []
    for r, t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - width + 1):
            if len(holders[tuple(t[j : j + width])]) > 1:
                gone[j : j + width] = True
        out.append((r[0], int(gone.sum()), int(np.sum(np.diff(np.append(0, gone.astype(int))) == 1))))
    return Counter(out)


def counted(docs, words):
    return Counter((r.doc_id, r.n_passage_words, r.n_passages) for r in remove_repeats(docs, width=400, words=words).collect())


def row(i, text):
    return (i, text, None, None, 0, 1, 2.0, 3, 4, 5, "v", "h")


@pytest.mark.parametrize(("hot", "block"), [(1 << 16, 1 << 18), (4, 1 << 18), (1 << 16, 1), (4, 1)])
@pytest.mark.parametrize("words", [1, 2, 7, 50])
def test_passages_against_counting(spark, monkeypatch, hot, block, words):
    monkeypatch.setattr(passages, "HOT", hot)  # 4: the strings of most minimizers are grouped one by one
    monkeypatch.setattr(passages, "BLOCK", block)
    rng = random.Random(words)
    base = [f"w{rng.randrange(40)}" for _ in range(200)]
    own = lambda i: [f"{i}x{j}" for j in range(rng.randrange(20))]
    rows = [(r[0], r[1][:3000] if r[1] else r[1], *r[2:]) for r in odd_rows()]
    for i in range(20):
        at = rng.randrange(150)
        rows.append(row(1000 + i, " ".join(own(i) + base[at : at + rng.randrange(words, 120)] + own(-i))))
    rows += [row(2000, "in " * 90), row(2001, "a in " + "in " * 70), row(2002, " ".join(base)), row(2003, "\n".join(base).upper())]
    assert counted(spark.createDataFrame(rows, SCHEMA).repartition(4), words) == brute(rows, words)


def test_short_words_are_a_passage_under_400_bytes(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    assert len(passage) < 400
    rows = [(1, f"one before {passage} and after"), (2, f"Two {passage.upper()}"), (3, " ".join(f"q{i}" for i in range(90))), (4, passage[: passage.index("p49")]), (5, None), (6, "word " * 200)]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width=400, words=50).collect()}
    assert {i: (r.n_passage_words, r.n_passages) for i, r in got.items()} == {1: (60, 1), 2: (60, 1), 3: (0, 0), 4: (0, 0), 5: (0, 0), 6: (0, 0)}
    assert all(r.n_removed == 0 for i, r in got.items() if i != 6)  # what goes is decided by bytes alone


def test_what_is_removed_does_not_change(spark):
    docs = odd_docs(spark).withColumn("text", F.substring("text", 1, 3000))
    plain, beside = remove_repeats(docs, width=50), remove_repeats(docs, width=50, words=5)
    assert Counter(map(tuple, plain.collect())) == Counter(tuple(r)[:5] for r in beside.collect())


def test_empty_table_and_long_texts(spark):
    assert remove_repeats(odd_docs(spark).limit(0), words=50).count() == 0
    rows = [(1, "a" * 2_000_000), (2, "xyz " * 300_000), (3, "abc " + "xyz " * 200_000)]
    assert counted(spark.createDataFrame(rows, "doc_id long, text string"), 50) == Counter([(1, 0, 0), (2, 300_000, 1), (3, 200_000, 1)])
