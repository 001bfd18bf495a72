import random
import zlib

import numpy as np
from helpers import clashing, odd_texts, words
from pyspark.sql import functions as F

from sievework.llm import maxent, ranking, toxicity

DOC, LABEL = "doc_id long, text string", "doc_id long, toxic int, quality int"


def labelled(spark, n=400):
    r = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = words(r, r.choice([40, 120]))
        if toxic:
            text = " ".join(x for w in text.split() for x in ((w, r.choice(["Idiot!", "clown", "moron"])) if r.random() < 0.05 else (w,))) + " idiot"
        poor = i % 4 == 0
        docs.append((i, " ".join(w + "%%%" for w in text.split()) if poor else text))
        labels.append((i, int(toxic), int(not poor)))
    labels += [(None, 1, 1), (3, None, None), (10**6, 1, 0)]
    return spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL), {i: (t, q) for i, t, q in labels}


def judge(rows, truth, k):
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    return np.mean([r.predicted == truth[r.doc_id][k] for r in held])


def test_toxicity(spark):
    docs, labels, truth = labelled(spark)
    model = toxicity.fit(clashing(docs), labels)
    rows = toxicity.score(clashing(docs), model).collect()
    assert judge(rows, truth, 0) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    odd = spark.createDataFrame(odd_texts(), DOC)
    assert toxicity.score(odd, model).count() == odd.count()
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() < docs.count()


def toy_texts():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abc") for _ in range(r.choice([1, 2, 5, 9, 12])))
    texts = [" ".join(word() for _ in range(30)) + (" nasty word nastier word" if i % 3 == 0 else "") for i in range(45)]
    return [t.encode() for t in texts] + [b"", b"one"], [int(i % 3 == 0) for i in range(45)] + [0, 1]


def plain_kneser_ney(texts, y):
    """p(word, before, class) by dictionaries, one formula after the other; before None is a start or unknown word."""
    hold = np.zeros(len(y), bool)
    hold[np.random.default_rng(7).permutation(len(y))[: len(y) // 4]] = True
    docs = [(toxicity.tokens(t), c) for t, c, h in zip(texts, y, hold) if not h]
    vocab = sorted({w for d, _ in docs for w in d})
    kinds = {c: {(a, b) for d, k in docs if k == c for a, b in zip(d, d[1:])} for c in (0, 1)}
    size = {c: max(1, len(kinds[c])) for c in (0, 1)}
    least = {w: min(sum(b == w for _, b in kinds[c]) * min(size.values()) / size[c] for c in (0, 1)) for w in vocab}
    taken = {w: min(n, 0.75) for w, n in least.items()}
    levels = [{w: w[:k] for w in vocab} for k in toxicity.STEMS]
    shares = 1 + len(vocab) + sum(len(set(v.values())) for v in levels)
    share = max(sum(taken.values()), 1.0) / shares
    q = {w: least[w] - taken[w] + share for w in vocab}
    q_of = []
    for k, level in enumerate(levels):
        here = {}
        for s in set(level.values()):
            below = [w for w in vocab if level[w] == s]
            here[s] = sum(q[w] for w in below) + share * sum(len({levels[j][w] for w in below}) for j in range(k, len(levels)))
        q_of.append(here)
    whole = sum(q.values()) + share * (shares - len(vocab))

    def count(c, of):
        n = {}
        for d, k in docs:
            if k == c:
                for x in set(of(d)):
                    n[x] = n.get(x, 0) + 1
        return n

    keep = lambda n: n - min(n, 1 + toxicity.DEVIATIONS * n**0.5)

    def word(w, c):
        """A known word, or an unknown one below its longest known stem."""
        p, above, frees = 1.0, whole, []
        for k, level in enumerate([*levels, {x: x for x in vocab}]):
            n = count(c, lambda d: [level[x] for x in d])
            total = sum(n.values())
            frees.append(1 - sum(map(keep, n.values())) / total if total else 1.0)
        out = p * share / above * np.prod(frees)
        for k, level in enumerate(levels):
            n, s = count(c, lambda d: [level[x] for x in d]), w[: toxicity.STEMS[k]]
            if s not in q_of[k]:
                continue
            p = keep(n.get(s, 0)) / max(sum(n.values()), 1) + frees[k] * p * q_of[k][s] / above
            above = q_of[k][s]
            out = p * share / above * np.prod(frees[k + 1 :])
        if w in q:
            n = count(c, lambda d: d)
            return keep(n.get(w, 0)) / max(sum(n.values()), 1) + frees[-1] * p * q[w] / above
        return out

    def both(w, v, c):
        n = count(c, lambda d: list(zip(d, d[1:])))
        after = {b: k for (a, b), k in n.items() if a == v}
        total = sum(after.values())
        if not total:
            return word(w, c)
        return keep(after.get(w, 0)) / total + (1 - sum(map(keep, after.values())) / total) * word(w, c)

    return vocab, both


def test_kneser_ney_matches_plain_formulas():
    texts, y = toy_texts()
    model = toxicity.train(texts, y)
    vocab, plain = plain_kneser_ney(texts, y)
    r = random.Random(1)
    pairs = [(r.choice([None, *vocab]), r.choice(vocab)) for _ in range(60)] + [(b"nasty", b"word"), (b"word", b"nastier"), (None, b"nastiest"), (None, b"zzz"), (b"word", b"abca")]
    for v, w in pairs:
        at = [np.array([0]) if x is None else model.numbers([x]) for x in (v, w)]
        got = model.probabilities(*at)[0]
        assert np.allclose(got, [plain(w, v, 0), plain(w, v, 1)], rtol=1e-5), (v, w)
    assert len(model.pairs) > 0


def test_few_rows_give_a_flat_curve_and_many_a_close_one():
    """Columns that say nothing must not flag new rows; a column that says much, over many rows, keeps its weight."""
    rng = np.random.default_rng(2)
    rows = lambda n: np.column_stack([rng.normal(size=(n, 10)), np.ones(n)])
    flagged = lambda c, x: (1 / (1 + np.exp(-x @ c)) >= 0.3).mean()
    x, y, new = rows(60), (np.arange(60) % 8 == 0).astype(int), rows(2000)
    assert flagged(toxicity.curve(x, y), new) < 0.05 < flagged(toxicity.logistic(x, y), new)
    x = rows(2000)
    y = (x[:, 0] + 0.1 * x[:, 1] > 1).astype(int)
    got = toxicity.curve(x, y)
    assert np.allclose(got, toxicity.logistic(x, y)) and np.mean((x @ got > 0) == y) > 0.99
    assert np.isfinite(toxicity.curve(x[:9], np.r_[1, np.zeros(8, int)])).all()


def test_kneser_ney_sums_to_one():
    for texts, y in (toy_texts(), ([b"a b c d", b"a b", b"c d a b", b"a b"], [0, 1, 0, 1])):
        model = toxicity.train(texts, y)
        for v in range(len(model.words) + 1):
            w = np.arange(len(model.unigram))
            assert np.allclose(model.probabilities(np.full(len(w), v), w).sum(0), 1, atol=1e-4)


def test_quality(spark):
    docs, labels, truth = labelled(spark)
    model = ranking.fit(clashing(docs), labels)
    rows = ranking.score(clashing(docs), model).collect()
    assert judge(rows, truth, 1) > 0.95
    odd = spark.createDataFrame(odd_texts(), DOC)
    assert ranking.score(odd, model).count() == odd.count()


def test_ranking_solves_its_pair_loss_and_cuts_at_the_quantile(spark):
    docs, labels, truth = labelled(spark)
    model = ranking.fit(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 0]
    x, y = np.array([ranking.describe(t.encode()) for _, t in rows]), np.array([truth[i][1] for i, _ in rows])
    z = model.expand(x)
    # the loss sum(log(1 + exp(-w (good - poor)))) + |w|^2 / 2 of the pairs has no slope at the weights
    a, b = ranking.preferences(np.flatnonzero(y == 1), np.flatnonzero(y == 0), ranking.PAIRS)
    slope = -sum((z[i] - z[j]) / (1 + np.exp((z[i] - z[j]) @ model.weights)) for i, j in zip(a, b)) + model.weights
    assert np.abs(slope).max() < 1e-3 * len(a) ** 0.5
    raw = np.sort(z @ model.weights)
    cut = [(raw[k] + raw[k + 1]) / 2 for k in range(len(raw) - 1)]
    at = int(np.argmin(np.abs(np.array(cut) - model.cut)))
    assert np.isclose(cut[at], model.cut) and abs(at + 1 - (y == 0).sum()) <= 1
    scores = {r.doc_id: r.score for r in ranking.score(docs, model).collect()}
    want = dict(zip((i for i, _ in rows), model.score(x, 0.3)))
    assert all(np.isclose(scores[i], s) for i, s in want.items())


def test_words_enter_the_ranking(spark):
    """Texts that differ in nothing but which words they use."""
    r = random.Random(8)
    words_of = (["amber", "birch", "cedar", "dunes"], ["ember", "baits", "cider", "danes"])
    docs, labels = [], []
    for i in range(300):
        good = i % 2
        docs.append((i, " ".join(r.choice(words_of[good]) for _ in range(60))))
        labels += [(i, 0, good), (i, 0, good)]
    docs, labels = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL)
    rows = ranking.score(docs, ranking.fit(docs, labels)).collect()
    assert np.mean([row.predicted == row.doc_id % 2 for row in rows if row.held_out]) > 0.95


def shuffled(spark):
    """Bytes that all stages so far wrote for a shuffle."""
    jvm = spark._jvm
    stages = spark._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_ranking_shuffles_no_texts(spark):
    """Above the bound for broadcasts, labels meet ids and ratings, not texts; each way gives the same scores."""
    docs, labels, _ = labelled(spark)
    junk = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda k: F.sha2(F.concat_ws("-", "doc_id", k), 256)))
    docs = docs.withColumn("text", F.concat_ws(" ", "text", junk)).unionByName(spark.createDataFrame([(None, "a b"), (3, "one more text of three"), (7, None)], DOC))
    docs = spark.createDataFrame(docs.collect(), DOC)
    size, was = docs.agg(F.sum(F.octet_length("text"))).first()[0], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        model = ranking.fit(docs, labels)
        assert shuffled(spark) - before < size / 20
        before = shuffled(spark)
        rows = ranking.rank(docs, labels).collect()
        assert shuffled(spark) - before < size / 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.score)
    want = sorted(ranking.score(docs, model).collect(), key=key)
    rows = sorted(rows, key=key)
    assert [(r.doc_id, r.held_out, r.predicted) for r in rows] == [(r.doc_id, r.held_out, r.predicted) for r in want]
    assert np.allclose([r.score for r in rows], [r.score for r in want])


def test_without_labels(spark):
    docs, labels, _ = labelled(spark, 20)
    none = labels.limit(0)
    for module, label in ((toxicity, "toxic"), (ranking, "quality")):
        rows = module.score(docs, module.fit(docs, none, label)).collect()
        assert len(rows) == 20 and len({r.score for r in rows}) == 1
        assert module.score(docs.limit(0), module.fit(docs.limit(0), none, label)).collect() == []


def test_language_model_counts_match(spark):
    docs = [*odd_texts(), *((100 + i, words(random.Random(i), 30)) for i in range(40))]
    rows = maxent.score(clashing(spark.createDataFrame(docs, DOC))).collect()
    assert len(rows) == len(docs)
    cut = lambda t: [*(t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").split(), "\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = {}
    for i, t in docs:
        if not held(i):
            for w in cut(t):
                count[w] = count.get(w, 0) + 1
    total, v = sum(count.values()), len(count)
    want = sorted((str(i), held(i), len(cut(t)), sum(w in count for w in cut(t)), round(sum(np.log10((count.get(w, 0) + 1) / (total + v + 1)) for w in cut(t)), 6)) for i, t in docs)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows)
    assert got == want and {r.train_tokens for r in rows} == {total} and all(r.score < 0 for r in rows)


def test_language_model_joins_rare_words(spark, monkeypatch):
    docs = spark.createDataFrame([(i, words(random.Random(i), 30)) for i in range(40)], DOC)
    key = lambda r: (r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 3))
    want = sorted(map(key, maxent.score(docs).collect()))
    monkeypatch.setattr(maxent, "COMMON", 5)
    got = sorted(map(key, maxent.score(docs).collect()))
    assert [g[:3] for g in got] == [w[:3] for w in want]


def test_probabilities_sum_to_one():
    r = np.random.default_rng(0)
    w = maxent.Weights(r.normal(size=(maxent.FEATURES, maxent.GROUPS)).astype(np.float32), r.normal(size=(maxent.FEATURES, maxent.GROUPS, maxent.CLASSES // maxent.GROUPS)).astype(np.float32))
    lp = maxent.log_probs(w, maxent.active(np.arange(0, 60000, 777)))
    assert np.allclose(np.exp(lp.astype(float)).sum(1), 1, atol=1e-4)


def plain_weights(history, seen, steps):
    """Weights by whole gradients over all histories, in one place; seen (histories, classes)."""
    want, at = maxent.Weights(), maxent.active(history)
    n = seen.sum(1)
    for _ in range(steps):
        p = np.exp(maxent.log_probs(want, at).astype(float)).reshape(len(history), maxent.GROUPS, -1)
        og, g = seen.reshape(p.shape).sum(2), p.sum(2)
        inside = p / g[:, :, None] * og[:, :, None]
        for w, o, e in ((want.group, og, g * n[:, None]), (want.cls, seen.reshape(p.shape), inside)):
            so, se = np.zeros(w.shape), np.zeros(w.shape)
            np.add.at(so, at, o[:, None])
            np.add.at(se, at, e[:, None])
            w += (maxent.RATE * (so - se - maxent.PRIOR * w) / (np.maximum(so, se) + maxent.PRIOR)).astype(np.float32)
    return want


def test_weight_table_and_steps_are_whole(spark):
    pairs = maxent.active(np.arange(maxent.CLASSES**2))[:, 3]
    assert len(np.unique(pairs)) > 15_000 and maxent.FEATURES >= 1 << 14 and maxent.STEPS >= 15
    r = np.random.default_rng(1)
    history, cls, n = r.permutation(maxent.CLASSES**2)[:300], r.integers(0, maxent.CLASSES, 300), r.integers(1, 9, 300)
    rows = [(int(h), [(int(c), int(k))]) for h, c, k in zip(history, cls, n)]
    counts = spark.createDataFrame(rows, "history long, next array<struct<cls:int,n:long>>").repartition(5)
    got, seen = maxent.train_weights(counts, 3), np.zeros((300, maxent.CLASSES))
    seen[np.arange(300), cls] = n
    want = plain_weights(history, seen, 3)
    assert np.allclose(got.group, want.group, atol=1e-3) and np.allclose(got.cls, want.cls, atol=1e-3)
    assert not maxent.train_weights(counts.limit(0), 1).group.any()


def test_language_model_score_matches_brute_force(spark):
    """Counts, classes, training and scores in plain Python over a corpus of more words than have a class of their own."""
    r = random.Random(12)
    vocab = [f"{r.choice(['ab', 'cd', 'ef'])}{i}{r.choice(['ing', 'tion', 'er', 'x'])}" for i in range(400)]
    docs = [(i, " ".join(vocab[r.choice([min(399, int(r.paretovariate(0.5))), r.randrange(400)])] for _ in range(40))) for i in range(60)] + [(900, ""), (901, "never seen words")]
    cut = lambda t: [*t.encode().split(), b"\n"]
    counts = {}
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for w in cut(t):
                counts[w] = counts.get(w, 0) + 1
    first = sorted((-c, maxent.word_hash(w), w) for w, c in counts.items() if w != b"\n")
    own = {b"\n": 0} | {w: k + 1 for k, (*_, w) in enumerate(first[: maxent.OWN - 1])}
    assert len(counts) > maxent.OWN
    of = lambda w: own.get(w, maxent.ending(w))
    room = {}
    for w, c in counts.items():
        if w not in own:
            n, v = room.get(of(w), (0, 0))
            room[of(w)] = n + c, v + 1

    def walk(t):
        one = two = 0
        for w in cut(t):
            yield one * maxent.CLASSES + two, w
            one, two = of(w), one

    after = {}
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for h, w in walk(t):
                after.setdefault(h, np.zeros(maxent.CLASSES))[of(w)] += 1
    history = np.array(sorted(after))
    w8 = plain_weights(history, np.stack([after[h] for h in history.tolist()]), maxent.STEPS)
    want = {}
    for i, t in docs:
        want[i] = 0.0
        for h, w in walk(t):
            want[i] += float(maxent.log_probs(w8, maxent.active(np.array([h])))[0, of(w)]) / np.log(10)
            if w not in own:
                n, v = room.get(of(w), (0, 0))
                want[i] += np.log10((counts.get(w, 0) + 1) / (n + v + 1))
    got = {x.doc_id: x.score for x in maxent.score(spark.createDataFrame(docs, DOC)).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-2 + 1e-3 * abs(want[i]) for i in want), {i: (got[i], want[i]) for i in want if abs(got[i] - want[i]) > 1e-2}
