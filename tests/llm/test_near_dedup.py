import random

import pytest

from epigrid.llm.near_dedup import Forest, connected_components, near_duplicates, without_near_duplicates
from epigrid.llm.common import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, component_id string"


def rows(texts):
    return [(i, t, None, "s", 0, "x", "y") for i, t in texts]


def shingles(text, width):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(texts, width, percent):
    sets = {i: shingles(t, width) for i, t in texts}
    part = {i: i for i in sets}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                p, q = root(a), root(b)
                part[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def near_corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randrange(1, 160))] for _ in range(60)]
    texts = []
    for i, b in enumerate(base):
        for _ in range(12 if i % 10 == 0 else 2):
            c = list(b)
            for _ in range(rng.randrange(0, 4)):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", "  "]).join(c).upper() if rng.random() < 0.2 else " ".join(c))
    texts += [None, "", "   \n", "solo", "solo", "SOLO", "a b", "a b c d e", "long " * 30000]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i * 7, texts[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("width", [4, 5])
def test_same_components_as_all_pairs(spark, width):
    texts = near_corpus()
    got = near_duplicates(spark.createDataFrame(rows(texts), SCHEMA).repartition(5), width=width, percent=80).collect()
    want = brute(texts, width, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want


def test_repeats_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame(rows([(3, "one two three"), (3, "one two three"), (1, "one two three"), (None, "one two three"), (9, None)]), SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_duplicates(df).collect())
    assert got == [(-1, 1, True), (1, 1, True), (3, 1, False), (3, 1, False), (9, 9, True)]
    assert near_duplicates(df.limit(0)).count() == 0
    kept = without_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 9]


def test_hub_links_copies_that_are_unlike_each_other(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    texts = [(0, " ".join(base))]
    for i in range(1, 120):
        c = list(base)
        for k in rng.sample(range(4, 116), 3):
            c[k] = f"n{i}_{k}"
        texts.append((i, " ".join(c)))
    df = spark.createDataFrame(rows(texts), SCHEMA)
    got = near_duplicates(df, width=4, percent=80).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: v[1] for i, v in brute(texts, 4, 80).items()}


def test_connected_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    with Workspace(spark, "t") as ws:
        got = {r.id: r.component for r in connected_components(ws, spark.createDataFrame(edges, "a long, b long"), "c").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}}


def test_signatures_estimate_similarity():
    import numpy as np

    forest = Forest()
    rng = np.random.default_rng(0)
    common = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 50, dtype=np.uint64)])) for _ in range(2))
    x, y = (np.frombuffer(forest.signature(s), ">u2") for s in (a, b))
    assert abs((x == y).mean() - 0.8) < 0.12


@pytest.mark.parametrize("at", [0.5, 1])
def test_star_of_copies_whose_original_is_not_the_first(spark, at, many=200):
    """Copies alike to the original (0.81 to 0.87) and not to each other, in any order."""
    rng = random.Random(many)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(many):
        c = list(base)
        for k in rng.sample(range(3, 147, 4), 3):
            c[k] = f"n{i}_{k}"
        texts.append(" ".join(c))
    texts.insert(int(at * many), " ".join(base))
    texts += [f"other{i} " + " ".join(rng.choice("abcdefgh") for _ in range(40)) for i in range(50)]
    texts = list(enumerate(texts))
    got = near_duplicates(spark.createDataFrame(rows(texts), SCHEMA).repartition(5), width=4, percent=80).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: v[1] for i, v in brute(texts, 4, 80).items()}


def test_exact_join_alone_finds_all_pairs(spark, monkeypatch):
    """Without any candidate of the forest, and with shingles dealt in small blocks."""
    from epigrid.llm import near_dedup

    monkeypatch.setattr(near_dedup, "_candidates", lambda ws, *_: spark.createDataFrame([], "a long, b long, trees long"))
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    texts = near_corpus()
    got = near_duplicates(spark.createDataFrame(rows(texts), SCHEMA).repartition(5), width=4, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(texts, 4, 80)
