import random

import numpy as np
import pyarrow as pa
import pytest

from sievework.llm import jaccard_tree as J


def brute(rows, n, num, den):
    def shingles(t):
        w = [x for x in (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").split(" ") if x]
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and den * len(s & t) >= num * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def corpus(seed, hot=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.choice([1, 2, 3])))
    texts = [None, "", "  \n", "One", "one", "a b", "A b", "é b c", "É b c"]
    for size in (5, 9, 12, 20, 40, 90, 300):
        for _ in range(6):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for _ in range(r.choice([0, 1, 3])):
                new = list(base)
                for _ in range(r.choice([0, 1, 2, size // 30 + 1])):
                    new[r.randrange(size)] = word()
                texts.append(" ".join(new))
    base = [word() for _ in range(70)]
    for _ in range(hot):
        new = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            new[r.randrange(len(new))] = word() + "x"
        texts.append("\n".join(new))
    texts.append("zz " * 5000 + " ".join(str(k) for k in range(4000)))
    texts.append("zz " * 5000 + " ".join(str(k) for k in range(4001)))
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("n,num,den,cell", [(3, 9, 10, 512), (3, 9, 10, 16), (5, 8, 10, 512), (2, 8, 10, 8)])
def test_matches_brute_force(spark, n, num, den, cell):
    rows = corpus(n * 100 + cell)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, n string, keys string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.ngram_jaccard_join(df, n, num, den, cell=cell).collect())
    assert got == brute(rows, n, num, den)


def test_edges_of_input(spark):
    schema = "doc_id long, text string"
    assert J.ngram_jaccard_join(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None), (3, "q r s t u v"), (4, "q r s t u v")]
    got = sorted(map(tuple, J.ngram_jaccard_join(spark.createDataFrame(rows, schema)).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None), (3, 0, 3), (3, 2, 3), (4, 2, 3)], key=str)


def near_copy_edges(size, n, num):
    """Distinct edges that the keys give for one group of near copies, without Spark."""
    r = random.Random(size)
    base = ["".join(r.choice("abcdefg") for _ in range(4)) for _ in range(120)]
    texts = []
    for i in range(size):
        new = list(base)
        for _ in range(r.choice([0, 1, 2])):
            new[r.randrange(len(new))] = f"x{i}"
        texts.append(" ".join(new).encode())
    sets, keys = J.shingle_sets(texts, n), J.Keys(num, 10)
    with np.errstate(over="ignore"):
        rows = sorted((k, i) for i, s in enumerate(sets) for k in keys.of(s).view(np.int64).tolist())
    met = [b for run in J._shared([pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["key", "set_id"])]) for b in run.to_pylist()]
    signed = pa.RecordBatch.from_pylist([{**m, "n": len(sets[m["set_id"]]), "bits": J.signature(sets[m["set_id"]])} for m in met])
    return {(e["a"], e["b"]) for out in J._may_link(num, 10)([signed]) for e in out.to_pylist()}


@pytest.mark.parametrize("n,num", [(5, 8), (3, 9)])
def test_near_copies_give_edges_in_proportion(spark, n, num):
    for size in (100, 400, 1600):
        edges = near_copy_edges(size, n, num)
        assert len(edges) < 6 * size and J._stars(spark.createDataFrame(sorted(edges), "a long, b long")).count() < 1.6 * size


def test_components_on_chains_stars_and_trees(spark):
    from sievework.llm.common import Scratch
    from sievework.llm.components import components

    r = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(90)] + [(None, 4), (5, 5), (101, 100)]
    edges += [(900 + a, 900 + b) for a, b in zip(r.sample(range(40), 40), r.sample(range(40), 40))]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()))
    parent = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}


@pytest.mark.parametrize("few", [0, 40, 10**6])
def test_components_contract_until_few_edges_are_left(spark, few):
    from sievework.llm.common import Scratch
    from sievework.llm.components import components

    r, wrote = random.Random(9), []
    ids = r.sample(range(10_000), 400)
    edges = list(zip(ids[:300], ids[1:300])) + [(r.choice(ids[300:]), r.choice(ids[300:])) for _ in range(60)] + [(None, 1), (2, None), (3, 3)]

    class Counted(Scratch):
        def keep(self, df, name="t"):
            wrote.append(name)
            return super().keep(df, name)

    rows = components(spark.createDataFrame(edges, "a long, b long"), Counted(spark, "t"), few).collect()
    got = dict(map(tuple, rows))
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for x in sorted(near):
        todo = [] if x in want else [x]
        while todo:
            if (y := todo.pop()) not in want:
                want[y] = x
                todo += near[y]
    assert len(rows) == len(got) and got == want
    assert ("parents" in wrote) == (few < len(edges)) and ("last" in wrote) == (few > 0)
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), few).collect() == []


def test_small_graphs_write_two_tables(spark):
    """The driver keeps plans and tasks of every table that is written: it ran out of memory over many small ones."""
    from sievework.llm.common import Scratch
    from sievework.llm.components import components

    scratch = Scratch(spark, "t")
    ids = random.Random(5).sample(range(1000), 200)
    assert {r.label for r in components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long"), scratch).collect()} == {min(ids)}
    assert scratch.n <= 2
