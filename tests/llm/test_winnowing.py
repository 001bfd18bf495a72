import hashlib
import random
import re

import pytest
from helpers import clashing, odd_texts, words

from sievework.llm.winnowing import winnow

ITEM, DOC = "item_id long, text string", "doc_id long, text string"


def cut(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, n=8):
    wins = {}
    for i, t in items:
        w = cut(t)
        k = min(n, len(w))
        if i is not None and k:
            for a in range(len(w) - k + 1):
                wins.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    out = set()
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for k in range(1, n + 1):
            for a in range(len(w) - k + 1):
                if (x := tuple(w[a : a + k])) in wins:
                    hit |= set(range(a, a + k))
                    found |= wins[x]
        out.add((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    r = random.Random(seed)
    items = [(i, words(r, k)) for i, k in enumerate([3, 7, 8, 9, 20, 40, 40, 8])] + [(20, "a a a a a a a a a a"), (21, None), (22, ""), (None, "one two"), (3, words(r, 12)), (23, "a, b! A")]
    docs = odd_texts(seed)
    for k in range(30):
        src = r.choice(items[:9])[1].split()
        a = r.randrange(len(src))
        docs.append((100 + k, " ".join([words(r, 5), *src[a : a + r.choice([2, 7, 8, 15])], words(r, 6)])))
    got = winnow(clashing(spark.createDataFrame(docs, DOC)), clashing(spark.createDataFrame(items, ITEM)))
    assert {tuple(x)[:5] for x in got.collect()} == brute(docs, items)


def test_empty_tables(spark):
    e, d = spark.createDataFrame([], ITEM), spark.createDataFrame([(1, "a b")], DOC)
    assert [tuple(x)[:4] for x in winnow(d, e).collect()] == [(1, 2, 0, 0)]
    assert winnow(spark.createDataFrame([], DOC), e).collect() == []
