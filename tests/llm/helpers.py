"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

CLASHES = ["n", "size", "bytes", "score", "keys", "copies", "th", "h", "y", "row", "block", "cell", "label", "total", "part", "v", "gone", "id"]


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in df.columns])


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.choice([1, 2, 3]))) for _ in range(n))


def odd_texts(seed=1):
    r = random.Random(seed)
    base = words(r, 60)
    texts = [None, "", " \t\n ", "One", "one two", base, base, base.upper(), words(r, 4000), "é ß 中文 " * 30, "a " * 50, words(r, 8), base + " extra"]
    return list(enumerate(texts)) + [(None, base), (5, base), (5, "other text of five")]
