"""A small corpus with everything odd in it, shared by the tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, salt int, length long, tree int, value string, hits string"


def odd_rows(seed=1, n=60):
    """Documents with nulls in any column, empty and long texts, ties, repeated rows and
    extra columns whose names the operators use themselves."""
    rng = random.Random(seed)
    words = ["the", "of", "and", "house", "river", "Stone", "über", "naïve", "42", "don't", "they'll", "日本", "x" * 50]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 20, 200])))
        rows.append((i if n <= 90 else 1000 + i, rng.choice([text, text + "\nShared footer line.", "\n".join(text.split())]), rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), len(text), 1, 2.0, 3, 4, 5, "v", "h"))
    rows += [(100, None, "en", "a", None, 1, 2.0, 3, 4, 5, "v", "h"), (101, "", None, None, 0, 1, 2.0, 3, 4, 5, "v", "h"), (102, " \n\t ", "en", "b", 4, None, None, None, None, None, None, None)]
    rows += [(103, "lang " * 40_000, "en", "a", 200_000, 1, 2.0, 3, 4, 5, "v", "h")]
    rows += [rows[0], rows[0], (None, "no id here", "en", "a", 10, 1, 2.0, 3, 4, 5, "v", "h")]
    rng.shuffle(rows)
    return rows


def odd_docs(spark, **options):
    return spark.createDataFrame(odd_rows(**options), SCHEMA).repartition(5)
