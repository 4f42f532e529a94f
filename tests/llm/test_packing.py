import zlib

import numpy as np
import pytest
from helpers import odd_docs, odd_rows

from epigrid.llm.packing import best_configuration, configurations, pack_documents, packing_plan
from epigrid.llm.tokens import default_vocabulary, token_ids


def loads(plan, counts):
    """Lengths and loads of a plan, checked for gaps, overlaps and pieces left out."""
    x = np.repeat(plan[:, 0], plan[:, 2])
    step = np.concatenate([np.arange(m) for m in plan[:, 2]]) if len(plan) else np.empty(0, int)
    rank, seq, off = np.repeat(plan[:, 1], plan[:, 2]) + step, np.repeat(plan[:, 3], plan[:, 2]) + step, np.repeat(plan[:, 4], plan[:, 2])
    for length in np.flatnonzero(counts):
        assert sorted(rank[x == length]) == list(range(counts[length]))
    order = np.lexsort((off, seq))
    s, o, n = seq[order], off[order], x[order]
    first = np.append(True, s[1:] != s[:-1])
    assert (np.where(first, 0, np.append(0, (o + n)[:-1])) == o).all()
    return np.bincount(seq, x)


@pytest.mark.parametrize("kind", ["even", "skewed", "one length", "few", "large only"])
def test_plan_places_everything_once_and_tightly(kind):
    rng = np.random.default_rng(3)
    lengths = {
        "even": rng.integers(1, 513, 30_000), "skewed": np.clip(rng.lognormal(4.5, 1, 30_000).astype(int), 1, 512), "one length": np.full(5000, 130),
        "few": rng.integers(1, 20, 30), "large only": rng.integers(200, 400, 10_000),
    }[kind]
    counts = np.bincount(lengths, minlength=513)
    load = loads(packing_plan(counts, 512), counts)
    assert load.max() <= 512
    least = {"one length": -(-5000 // 3), "large only": 0}.get(kind, -(-lengths.sum() // 512))
    assert len(load) <= 1.02 * least + 30 or kind == "large only"


def test_configurations_meet_the_linear_bound():
    sizes, demand = np.array([60, 50, 40, 30]), np.array([100, 200, 300, 400])
    used = configurations(sizes, demand, 100)
    packed = sum(n * c for c, n in used)
    assert (packed <= demand).all() and all(sizes @ c <= 100 for c, _ in used)
    assert sum(n for _, n in used) >= (sizes @ packed) / 100
    assert best_configuration(np.array([60, 50, 40]), np.array([0.6, 0.5, 0.45]), 100)[0] == pytest.approx(1.05)


def test_ids_are_those_of_tokenizers():
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(default_vocabulary())
    texts = [r[1] or "" for r in odd_rows()] + ["a <|endoftext|> b", "  \n\n x", "I'll've 's", "\x00​�", "é" * 300, "a\r\n\r\n\tb  "]
    for t in texts:
        assert token_ids(default_vocabulary(), t).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_pieces_are_whole_and_gapless(spark):
    docs = odd_docs(spark)
    got = pack_documents(docs, default_vocabulary(), capacity=256).toPandas()
    want = []
    for r in odd_rows():
        ids = np.append(token_ids(default_vocabulary(), r[1]), 0).astype("<u4")
        at, n, k = 0, len(ids) % 256 or 256, 0
        while at < len(ids):
            want.append((-1 if r[0] is None else r[0], k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at, n, k = at + n, 256, k + 1
    have = sorted(zip(got.doc_id.fillna(-1).astype(int), got.piece, got.start, got.length, got.ids_crc32, strict=True))
    assert have == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 256
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 256) + 2


def test_empty_table(spark):
    assert pack_documents(odd_docs(spark).limit(0), default_vocabulary()).count() == 0
