"""The stages and the whole pipeline against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from helpers import odd_rows

import corpus_pipeline
from pyspark.sql import functions as F

from epigrid.llm.common import Workspace
from epigrid.llm.language_id import identify_languages, train_languages
from epigrid.llm.mixing import mix_report
from epigrid.llm.tokens import default_vocabulary, token_ids

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark):
    rows = [r[:5] for r in odd_rows(n=80)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def without_boilerplate(rows):
    pages, lines, bare = Counter(), defaultdict(Counter), lambda x: x.strip(" \t\r\f\x0b")
    for r in rows:
        pages[r.source] += 1
        for x in {bare(x) for x in (r.text or "").split("\n")} - {""}:
            lines[r.source][x] += 1
    out = []
    for r in rows:
        bad = {x for x, n in lines[r.source].items() if n >= 3 and n > 0.1 * pages[r.source]}
        text = None if r.text is None else "\n".join(x for x in r.text.split("\n") if bare(x) not in bad)
        out.append((r.doc_id, text, r.lang, r.source, None if text is None else len(text)))
    return out


def first_of_each_group(rows):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for r in rows:
        w = WORDS.findall(lower(r[1]))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * len(sets[i] | sets[j]):
                part[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    digest = lambda r: hashlib.md5((r[1] or "").encode()).digest()
    first = {}
    for i, r in enumerate(rows):
        if r[0] is not None and sets[i] and r[0] == least[root(i)]:
            first[root(i)] = min(first.get(root(i), (digest(r), json(r))), (digest(r), json(r)))
    out, seen = [], set()
    for i, r in enumerate(rows):
        if r[0] is None or not sets[i]:
            out.append(r)
        elif r[0] == least[root(i)] and (digest(r), json(r)) == first[root(i)] and root(i) not in seen:
            seen.add(root(i))
            out.append(r)
    return out


def json(r):
    return [str(x) for x in r]


def key(rows):
    return sorted((tuple(str(x) for x in r) for r in rows))


def test_stages_and_run(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "near_duplicates", "mix", "pack"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = train_languages(docs)
    least = {n: 0.7 * x for n, x in zip(model.names, model.least)}
    scored = identify_languages(docs, model).collect()
    known = stages["language"](spark, docs, "")
    assert known.columns == docs.columns
    assert key(known.collect()) == key(r[:5] for r in scored if r.lang_pred != "und" and r.score >= least[r.lang_pred])
    clean = stages["lines"](spark, known, "")
    assert clean.columns == docs.columns and key(clean.collect()) == key(without_boilerplate(known.collect()))
    single = stages["near_duplicates"](spark, clean, "")
    assert single.columns == docs.columns and key(single.collect()) == key(first_of_each_group([tuple(r) for r in clean.collect()]))
    mixed = stages["mix"](spark, single, "")
    copies = {(r.doc_id, r["size"]): r.taken // max(1, r["size"]) for r in mix_report(single).collect()}
    want = [r for r in single.collect() for _ in range(copies[r.doc_id, len(WORDS.findall(r.text or ""))])]
    assert mixed.columns == docs.columns and key(mixed.collect()) == key(want)
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    tokens = Counter()
    for r in want:
        tokens[len(token_ids(default_vocabulary(), r.text)) + 1] += 1
    assert packed.length.sum() == sum(n * c for n, c in tokens.items())
    assert (packed.piece == 0).sum() == len(want)
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048


def test_stages_keep_columns_of_any_name(spark):
    names = ["a.b", "a`b", "gone_key", "again", "text_key", "nth", "_size", "_copy", "_bad", "_salt", "_gone", "_own_lang_pred", "lang_pred", "score", "removed_lines", "copies", "own_0", "slot", "set_id"]
    docs = documents(spark)
    more = docs.select("*", *[F.lit(f"mine {n}").alias(n) for n in names])
    quoted = ["`" + n.replace("`", "``") + "`" for n in names]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        more = Workspace(spark, f"any-{name}").result(stage(spark, more, ""))
        docs = Workspace(spark, f"plain-{name}").result(stage(spark, docs, ""))
        assert more.columns == [*docs.columns, *names] and more.select(*quoted).distinct().collect() == [tuple(f"mine {n}" for n in names)]
        assert key(more.select(*docs.columns).collect()) == key(docs.collect())


def test_repeated_ids_lose_no_text(spark):
    """Texts that share an id with a copy of another text stay; of equal rows one stays."""
    a, b, c = ("the quick brown fox jumps over", "a text of quite another kind", "and a third one, with more words")
    rows = [(1, a, "en", "s", 1), (2, a, "en", "s", 1), (2, b, "en", "s", 1), (3, c, "en", "s", 1), (3, c, "en", "s", 1), (4, "", "en", "s", 0), (4, "", "en", "s", 0), (None, a, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert key(got.collect()) == key([rows[0], rows[2], rows[3], rows[5], rows[6], rows[7]]) == key(first_of_each_group(rows))


def test_stages_on_an_empty_table(spark):
    docs = documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        if name != "pack":
            assert out.columns == docs.columns
    assert corpus_pipeline.ORACLE_SQL is None
