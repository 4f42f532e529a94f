from collections import Counter, defaultdict

from helpers import odd_docs, odd_rows

from pyspark.sql import functions as F

import epigrid.llm.line_dedup as line_dedup
from epigrid.llm.line_dedup import drop_boilerplate


def brute(rows, ratio, least):
    pages, lines = Counter(), defaultdict(Counter)
    bare = lambda x: x.strip(" \t\r\f\x0b")
    for r in rows:
        pages[r[3]] += 1
        for x in {bare(x) for x in (r[1] or "").split("\n")} - {""}:
            lines[r[3]][x] += 1
    bad = {s: {x for x, n in c.items() if n >= least and n > ratio * pages[s]} for s, c in lines.items()}
    out = []
    for r in rows:
        if r[1] is None:
            out.append((r[0], None, 0))
            continue
        kept = [x for x in r[1].split("\n") if bare(x) not in bad.get(r[3], ())]
        out.append((r[0], "\n".join(kept), len(r[1].split("\n")) - len(kept)))
    return Counter(out)


def test_same_as_counting_by_hand(spark, monkeypatch):
    docs, rows = odd_docs(spark), odd_rows()
    want = brute(rows, 0.1, 3)
    assert any(n for _, _, n in want)
    for most in (10_000, 0):  # broadcast, and the salted join
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
        got = drop_boilerplate(docs, ratio=0.1)
        assert got.columns == [*docs.columns, "removed_lines"]
        assert Counter((r.doc_id, r.text, r.removed_lines) for r in got.collect()) == want


def test_empty_table_and_page_of_boilerplate(spark):
    docs = odd_docs(spark)
    assert drop_boilerplate(docs.limit(0)).count() == 0
    pages = spark.createDataFrame([(i, "Same\n  Same \r", "h") for i in range(5)], "doc_id long, text string, source string")
    assert {(r.text, r.removed_lines) for r in drop_boilerplate(pages).collect()} == {("", 2)}


def test_extra_columns_of_any_name(spark, monkeypatch):
    docs = odd_docs(spark)
    names = ["bad", "_bad", "bad_host", "salt", "host", "lines", "own_0", "own_1", "_salt"]
    more = docs.select("*", *[F.lit(f"mine {n}").alias(n) for n in names if n != "salt"])
    want = brute(odd_rows(), 0.1, 3)
    for most in (10_000, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
        got = drop_boilerplate(more, ratio=0.1)
        assert got.columns == [*more.columns, "removed_lines"]
        rows = got.collect()
        assert Counter((r.doc_id, r.text, r.removed_lines) for r in rows) == want
        assert {(r["_bad"], r["own_0"]) for r in rows} == {("mine _bad", "mine own_0")}
