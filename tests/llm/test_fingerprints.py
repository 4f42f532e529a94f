import hashlib
import random

from helpers import odd_docs, odd_rows

from epigrid.llm.fingerprints import common_lengths, edited_with, fingerprint, fingerprint_report, similarities


def lcs(a, b):
    d = [0] * (len(b) + 1)
    for x in a:
        p = 0
        for j, y in enumerate(b):
            p, d[j + 1] = d[j + 1], p + 1 if x == y else max(d[j + 1], d[j])
    return d[-1]


def test_common_lengths_are_those_of_the_table():
    rng = random.Random(1)
    pairs = [tuple("".join(rng.choices("abcd", k=rng.randint(1, 128))) for _ in range(2)) for _ in range(100)]
    assert common_lengths(pairs).tolist() == [lcs(*p) for p in pairs]


def test_likeness_falls_with_edits():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij ") for _ in range(5000))
    other = "".join(rng.choice("abcdefghij ") for _ in range(5000))
    some, half = text[:2000] + "XYZ" + text[2000:], text[:2500] + other[2500:]
    a, b, c, d = (fingerprint(t.encode()) for t in (text, some, half, other))
    same, near, mid, far = similarities([(a, a), (a, b), (a, c), (a, d)])
    assert same == 1 and near > 0.9 and 0.35 < mid < 0.75 and far < 0.2


def test_report_against_brute_force(spark):
    docs = odd_docs(spark)
    got = fingerprint_report(docs).collect()
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert len(got) == len(rows)
    want = []
    for i, r in enumerate(rows):
        text, following = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
        new = edited_with(text, following).encode()
        own, theirs, changed = fingerprint(text.encode()), fingerprint(following.encode()), fingerprint(new)
        near = similarities([(own, changed), (own, theirs)])
        want.append((r[0], len(text), hashlib.sha256(new).hexdigest(), own, changed, float(near[0]), float(near[1])))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_small_tables(spark):
    docs = odd_docs(spark)
    assert fingerprint_report(docs.limit(0)).count() == 0
    one = fingerprint_report(docs.where("doc_id = 5")).first()
    assert one.near_next == 1.0
    assert fingerprint(b"") == "3::" and similarities([("3::", "3::")])[0] == 1


def test_periodic_texts_of_different_lengths_differ():
    unit = "one line that stands many times in a row, and nothing else\n"
    prints = {n: fingerprint((unit * n).encode()) for n in (40, 200, 201, 240, 2000, 5000, 5001)}
    assert len(set(prints.values())) == len(prints)
    assert all(max(map(len, p.split(":")[1:])) <= 128 for p in prints.values())
    assert (similarities([(prints[200], prints[201]), (prints[5000], prints[5001])]) < 1).all()
