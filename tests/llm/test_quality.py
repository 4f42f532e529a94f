import random

import numpy as np
from helpers import odd_docs

from epigrid.llm.quality import features, importance_resample
from epigrid.llm.common import word_hashes

GOOD, BAD = ["clear", "plain", "river", "stone", "house", "walks"], ["zzz", "$$$", "qqq", "!!!"]


def corpus(spark, n=400):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(GOOD if i % 4 else BAD) for _ in range(rng.randint(10, 50)))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows


def test_good_documents_are_drawn(spark):
    docs, rows = corpus(spark)
    target = spark.createDataFrame([(i,) for i in range(0, 400, 3) if i % 4], "doc_id long")
    got = importance_resample(docs, target, keep=0.75).toPandas()
    assert got.selected.sum() == 300 and len(got) == 400
    assert (got[got.selected].doc_id % 4 != 0).mean() > 0.98
    again = importance_resample(docs.repartition(5), target, keep=0.75).toPandas()
    assert set(got[got.selected].doc_id) == set(again[again.selected].doc_id)


def test_weights_are_those_of_the_models(spark):
    docs, rows = corpus(spark, 60)
    target = spark.createDataFrame([(i,) for i in range(60) if i % 4], "doc_id long")
    got = {r.doc_id: r for r in importance_resample(docs, target, keep=0.5, buckets=97).collect()}
    count = lambda part: np.bincount(np.concatenate([features(*word_hashes([t.encode()]), 97)[0] for _, t in part]), minlength=97)
    raw, good = count(rows), count([r for r in rows if r[0] % 4])
    ratio = np.log((good + 0.5) / (good.sum() + 0.5 * 97)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * 97))
    for i, t in rows:
        assert abs(got[i].log_weight - ratio[features(*word_hashes([t.encode()]), 97)[0]].sum()) < 1e-5
        assert got[i].n_features == 2 * len(t.split()) - 1


def test_odd_rows(spark):
    docs = odd_docs(spark)
    target = docs.select("doc_id").limit(20)
    got = importance_resample(docs, target, keep=0.5).toPandas()
    n = docs.count()
    assert len(got) == n and got.selected.sum() == round(n / 2)
    assert (got[got.doc_id.isin([100, 101, 102])].log_weight == 0).all()
    assert importance_resample(docs.limit(0), target, keep=0.5).count() == 0
    none = importance_resample(docs, target.limit(0), keep=1.0).toPandas()
    assert (none.log_weight == 0).all() and none.selected.all()
