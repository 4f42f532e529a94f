import random
import zlib

import numpy as np
from helpers import odd_docs

from epigrid.llm.language_id import ByteGRU, identify_languages, known_language, language_report, padded, train_languages

SYLLABLES = {"aa": ["tha", "ing", "the", "wh", "ou"], "bb": ["sch", "ei", "ung", "ver", "ü"], "cc": ["ção", "lh", "os", "nh", "ar"]}


def corpus(n=500, seed=3):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words), lang, rng.choice(["s", None]), 1))
    return rows


def test_gradients_are_those_of_differences():
    net = ByteGRU(3, 4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows, lengths = padded([b"abc", b"de", "fé".encode()])
    label = np.array([0, 1, 2])
    _, g = net.gradients(rows, lengths, label)
    rng = np.random.default_rng(0)
    for k in net.p:
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in net.p[k].shape)
            if k == "x":
                at = (at[0], ord("abde"[at[2] % 4]), at[2])
            net.p[k][at] += 1e-4
            up, _ = net.gradients(rows, lengths, label)
            net.p[k][at] -= 2e-4
            down, _ = net.gradients(rows, lengths, label)
            net.p[k][at] += 1e-4
            assert abs((up - down) / 2e-4 - g[k][at]) < 1e-4


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = language_report(df, steps=100).toPandas()
    truth = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out, strict=True))
    out = got[got.held_out]
    assert np.mean([truth[i] == p for i, p in zip(out.doc_id, out.lang_pred, strict=True)]) > 0.97


def test_labels_do_not_enter_a_prediction(spark):
    df = spark.createDataFrame(corpus(200), "doc_id long, text string, lang string, source string, n_chars long")
    known = train_languages(df, steps=60)
    a = identify_languages(df, known).select("text", "lang_pred", "score").collect()
    b = identify_languages(df.selectExpr("doc_id + 7 as doc_id", "text", "'zz' as lang", "null as source", "n_chars"), known).select("text", "lang_pred", "score").collect()
    assert sorted(a) == sorted(b)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = language_report(docs, steps=30).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[100].lang_pred == by[101].lang_pred == by[102].lang_pred == "und"
    assert {r.lang_pred for r in got} <= {"en", "de", "und"}
    kept = known_language(docs, steps=30)
    assert kept.columns == docs.columns and {100, 101, 102}.isdisjoint(r.doc_id for r in kept.collect())
    clash = known_language(docs.selectExpr("doc_id", "text", "lang", "'mine' as lang_pred", "7 as score"), steps=30)
    assert clash.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and {(r.lang_pred, r.score) for r in clash.collect()} == {("mine", 7)}
    assert language_report(docs.limit(0)).count() == 0
    unlabelled = language_report(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_a_label_depends_on_the_word_before(spark):
    """The second word is the same in both languages; only the state that runs on tells."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"{'ba' if i % 2 else 'bi'} mo" for _ in range(rng.randint(20, 40))), "xy"[i % 2], None, 1) for i in range(200)]
    known = train_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), steps=120)
    texts, lengths = padded([b"bi mo", b"ba mo"])
    e = known.model.forward(texts, lengths)
    at_mo = e[:, 3:5].mean(1)  # read with no word after it, so from the word before alone
    assert known.names == ["x", "y"] and at_mo[0, 0] > 0.8 and at_mo[1, 1] > 0.8


def test_windows_label_every_position_once():
    rng = np.random.default_rng(1)
    net = ByteGRU(3, 4)
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (1, 5, 95, 96, 97, 112, 113, 500, 1921)]
    total = net.sums(texts)
    assert total[:, -1].tolist() == [len(t) for t in texts]
    rows, lengths = padded(texts)
    whole = net.forward(rows, lengths)
    for i in (0, 1, 2, 3):  # one window each
        assert np.allclose(total[i, :-1], whole[i, : len(texts[i])].sum(0), atol=1e-3)
    mean = total[:, :-1] / total[:, -1:]
    assert all(np.allclose(mean[i], whole[i, : len(t)].mean(0), atol=0.02) for i, t in enumerate(texts))  # warm states come near


def test_languages_of_long_texts_only_are_learned(spark):
    rows = corpus(60)
    long = [(1000 + i, " ".join(["zzyz", "qoq", "zyq"][(i * k) % 3] for k in range(1, 40_000)), "long", None, 1) for i in range(9)]
    df = spark.createDataFrame(rows + long, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.lang_pred for r in language_report(df, steps=120).collect()}
    assert all(got[r[0]] == "long" for r in long)


def test_rejects_what_is_no_learned_language_and_keeps_the_rest(spark):
    rows = corpus(200)
    rng = random.Random(5)
    junk = [(2000 + i, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) + " " for _ in range(80)), None, None, 1) for i in range(20)]
    df = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in known_language(df, steps=200).collect()}
    assert len(kept & {r[0] for r in rows}) >= 0.99 * len(rows)
    assert len(kept & {r[0] for r in junk}) <= 10
