import random

from helpers import odd_docs, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from epigrid.llm.token_counts import CountTree, PieceCounts, apply_edits, count_edited, count_trees, next_trees, packed, sample_edits, unpacked
from epigrid.llm.tokens import default_vocabulary, token_ids

COUNTS = PieceCounts(default_vocabulary())
ALPHABET = "ab 's'll've  \n\t1 2.,éß日　 they're I'm\r\n   x"


#: Also the string of the special token, whole and in parts.
BITS = st.one_of(st.text(ALPHABET, max_size=12), st.sampled_from(["<|endoftext|>", "<|end", "oftext|>", "<|endoftext|", ">", " <", "|"]))
TEXTS, FEW = st.lists(BITS, max_size=20).map("".join), st.lists(BITS, max_size=4).map("".join)


def whole(text):
    return len(token_ids(default_vocabulary(), text))


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.lists(st.tuples(st.integers(0, 220), st.integers(0, 60), FEW), max_size=4), st.sampled_from([1, 2, 5, 64]))
def test_edits_count_as_encoding_anew(text, edits, leaf):
    tree = CountTree(text, COUNTS, leaf)
    for start, removed, inserted in edits:
        tree.edit(start, removed, inserted)
        start = min(start, len(text))
        text = text[:start] + inserted + text[start + removed :]
        if leaf == 5:  # through the table's form
            tree = CountTree.kept(COUNTS, *tree.row(), leaf)
        assert tree.total == whole(text) == CountTree(text, COUNTS, leaf).total
        assert tree.n_pieces == CountTree(text, COUNTS, leaf).n_pieces and tree.text() == text


def test_only_the_region_is_encoded_again():
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(20_000))
    tree = CountTree(text, COUNTS)
    tree.edit(60_000, 7, "new words here")
    assert tree.reencoded < 20


def test_column_form(spark):
    docs = odd_docs(spark)
    from pyspark.sql import functions as F

    got = count_edited(docs.withColumn("edits", sample_edits(F.col("text"))), default_vocabulary()).toPandas()
    assert len(got) == len(odd_rows())
    first = {r[0]: r[1] or "" for r in odd_rows() if r[0] is not None}
    for r in got.itertuples():
        if r.doc_id != r.doc_id:
            continue
        t = first[int(r.doc_id)]
        assert r.n_tokens == whole(t)
        n, new = len(t), t
        for start, removed, inserted in ((n // 2, 12, ""), (n // 3, 0, t[:10]), (n // 5, 5, " they'll see 42 ")):
            new = new[:start] + inserted + new[start + removed :]
        assert r.n_tokens_edited == whole(new)
    none = count_edited(docs.withColumn("edits", F.lit(None).cast("array<struct<start:int,removed:int,inserted:string>>")), default_vocabulary())
    assert none.where("n_tokens <> n_tokens_edited or n_reencoded <> 0").count() == 0
    assert count_edited(docs.limit(0).withColumn("edits", sample_edits(F.col("text"))), default_vocabulary()).count() == 0


def test_leaves_come_back():
    for pieces in ([], ["a"], ["é", " 日本", "\n\n", "x" * 70_000]):
        assert unpacked(packed(pieces)) == pieces


def test_special_token_made_and_broken_by_edits():
    tree = CountTree("some words <|endoftext| and more", COUNTS)
    tree.edit(23, 0, ">")
    assert tree.text() == "some words <|endoftext|> and more" and tree.total == whole(tree.text())
    tree.edit(12, 1, "")
    assert tree.text() == "some words <endoftext|> and more" and tree.total == whole(tree.text())


def test_a_second_batch_of_edits_reads_no_whole_text(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma's", "42", "über"]) for _ in range(n)) for n in (20_000, 7, 0, 3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    batches = [[(5000, 9, " first edit"), (10, 0, "x" * 40 + " new" * 400)], [(12, 4, ""), (5100, 0, "<|endoftext|>")], [(0, 10**6, "gone")]]
    kind = "array<struct<start:int,removed:int,inserted:string>>"
    trees = count_trees(docs, default_vocabulary())
    for k, edits in enumerate(batches):
        text_edits = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("removed"), F.lit(c).alias("inserted")) for a, b, c in edits]).cast(kind)
        done = apply_edits(trees.withColumn("edits", text_edits), default_vocabulary())
        for r in done.collect():
            before, t = texts[r.doc_id], texts[r.doc_id]
            for a, b, c in edits:
                a = min(a, len(t))
                t = t[:a] + c + t[a + b :]
            assert (r.n_tokens, r.n_tokens_edited) == (whole(before), whole(t))
            assert r.n_pieces_edited == CountTree(t, COUNTS).n_pieces
            if r.doc_id == 0 and k < 2:
                assert r.n_unpacked <= 6 < len(r.leaves) / 20
            texts[r.doc_id] = t
        trees = next_trees(done)
