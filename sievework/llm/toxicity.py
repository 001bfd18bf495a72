"""Toxicity by class-conditional Kneser-Ney models.

One interpolated bigram model for toxic and one for ordinary text. In a class c a word w after v has

    p_c(w | v) = max(n_c(v, w) - D, 0) / n_c(v) + b_c(v) * p_c(w)

with b the mass that the discounts D free. A word of its own backs off to its stems, its first STEMS bytes, the longest
first, and they to what both classes share:

    p_c(w) = max(n_c(w) - D, 0) / N_c + b_c * p_c(s) * q(w) / q(s)    and likewise for s and the next shorter stem.

q comes from continuation counts, in how many different contexts a word was seen, of which each word has the lesser of
its two classes' shares; one share goes to each word, and one to all unknown words below each stem. Counts are of
texts: a text that repeats an expression counts once. D takes one count and what chance may have added, so rare
expressions have nearly all their mass from shared counts and speak for neither class. Each model sums to one.

A text is judged by the difference of its two log-likelihoods per token. A logistic curve, fitted on sampled rows
that the counts have not seen, turns that difference, the same times the root of the length, and how much of it comes
from expressions that are far likelier in the toxic class, into a score from 0 to 1. How closely the curve may follow
those rows is chosen by the loss on rows that it was not fitted on, so that few rows give a flat curve.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import FOLD, arrow_batches
from sievework.llm.labelled import labelled_sample, remainder

#: Sampled training rows of each class at most; the model's size is bounded by them.
PER_CLASS = 3000
STRIP = b".,;:!?\"'()[]{}%*&$|<>-"
#: Bytes of a word's stems.
STEMS = (4, 5, 6, 7, 8, 10)
#: What chance may add to a class's count, in standard deviations.
DEVIATIONS = 1.0
#: Differences of log-likelihood from which on an expression counts as far likelier.
FAR = (1.0, 2.0, 3.0, 4.0)
#: Ridges that the curve is chosen from, by its loss over so many folds.
RIDGES, FOLDS = (1e-2, 1e-1, 1.0, 10.0), 5


def tokens(text: bytes) -> list[bytes]:
    """Words between white space, A-Z folded, punctuation at either end dropped; words of punctuation only go."""
    return [w for w in (x.strip(STRIP) for x in text.translate(FOLD).split()) if w]


class Numbered(dict):
    def __missing__(self, w: bytes) -> int:
        self[w] = n = len(self)
        return n


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(code of every token, tokens of each text, words by code)."""
    numbers, docs = Numbered(), [tokens(t) for t in texts]
    sizes = np.array([len(d) for d in docs], np.int64)
    return np.fromiter(map(numbers.__getitem__, chain.from_iterable(docs)), np.int64, int(sizes.sum())), sizes, list(numbers)


def discounted(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts after the discount of one and DEVIATIONS of a Poisson count, and what was taken."""
    d = np.minimum(n, 1 + DEVIATIONS * np.sqrt(n))
    return n - d, d


@dataclass
class Model:
    """Columns of each array: ordinary, toxic. words: sorted hashes, word k being row k + 1; row 0 is for unknown words
    without a known stem and, as a context, for anything but a known word. stems: for each length the sorted hashes
    and, in stem_rows, the rows of unknown words below them."""

    words: np.ndarray
    stems: list[np.ndarray]
    stem_rows: list[np.ndarray]
    unigram: np.ndarray
    backoff: np.ndarray
    pairs: np.ndarray
    pair_mass: np.ndarray
    curve: np.ndarray

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Rows of words; an unknown one has that of its longest known stem."""
        out = np.zeros(len(words), np.int64)
        found, at = look_up(self.words, hashes(words))
        out[found] = at[found] + 1
        left = np.flatnonzero(~found)
        for k, names, rows in reversed(list(zip(STEMS, self.stems, self.stem_rows))):
            found, at = look_up(names, hashes([words[i][:k] for i in left.tolist()]))
            out[left[found]] = rows[at[found]]
            left = left[~found]
        return out

    def probabilities(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """(n, 2): p(w | v) in either class."""
        v = np.where(v <= len(self.words), v, 0)
        p = self.backoff[v].astype(float) * self.unigram[w]
        both = np.flatnonzero((v > 0) & (w > 0) & (w <= len(self.words)))
        hit, at = look_up(self.pairs, v[both] * (len(self.words) + 1) + w[both])
        p[both[hit]] += self.pair_mass[at[hit]]
        return p

    def gaps(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(log p_toxic - log p_ordinary of every token, tokens of each text)."""
        flat, sizes, words = coded(texts)
        w = self.numbers(words)[flat]
        v = np.r_[0, w[:-1]] if len(w) else w
        v[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
        p = np.log(self.probabilities(v, w))
        return p[:, 1] - p[:, 0], sizes

    def features(self, texts: list[bytes]) -> np.ndarray:
        """For each text: difference of log-likelihoods per token, that times the root of the length, what is beyond
        each of FAR by the root of the length and as a logarithm, and 1."""
        gap, sizes = self.gaps(texts)
        ends, root = np.cumsum(sizes), np.sqrt(np.maximum(sizes, 1))

        def total(x: np.ndarray) -> np.ndarray:
            upto = np.r_[0.0, np.cumsum(x)]
            return upto[ends] - upto[ends - sizes]

        per = total(gap) / root**2
        far = [total(np.maximum(gap - least, 0)) for least in FAR]
        return np.column_stack([np.clip(per, -2, 2), np.clip(per * root, -20, 20), *(f(x) for x in far for f in (lambda x: np.clip(x / root, 0, 10), np.log1p)), np.ones(len(texts))])

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.curve, -30, 30)))


def look_up(names: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of wanted are among the sorted names, and where."""
    if not len(names):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return names[at] == wanted, at


def shared_counts(first: np.ndarray, then: np.ndarray, toxic: np.ndarray, rows: int) -> tuple[np.ndarray, float]:
    """Discounted continuation counts that both classes share of each word, and what the discounts free."""
    kinds = [np.bincount(np.unique(first[toxic == c] * rows + then[toxic == c]) % rows, minlength=rows) for c in (0, 1)]
    total = [max(1, k.sum()) for k in kinds]
    least = np.minimum(*(k * (min(total) / t) for k, t in zip(kinds, total)))
    d = np.minimum(least, 0.75)
    return least - d, max(float(d.sum()), 1.0)


def train(texts: list[bytes], y: list[int]) -> Model:
    """Counts from three quarters of the rows, the curve from the others. All counts are arrays over numbered words."""
    rng = np.random.default_rng(7)
    y_, hold = np.array(y, np.int64), np.zeros(len(y), bool)
    hold[rng.permutation(len(y))[: len(y) // 4]] = True
    flat, sizes, names = coded([t for t, h in zip(texts, hold) if not h])
    order = np.argsort(h := hashes(names))
    names = [names[i] for i in order.tolist()]
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(1, len(names) + 1)
    rows = len(names) + 1
    doc = np.repeat(np.arange(len(sizes)), sizes)
    cls, w = y_[~hold][doc], place[flat]
    inner = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    first, then = w[inner], w[inner + 1]

    # the tree of stems: for each length the hashes, and the node of each word
    tree = [np.unique(hashes([x[:k] for x in names]), return_inverse=True) for k in STEMS]
    counts, free = shared_counts(first, then, cls[inner], rows)
    starts = np.r_[rows, rows + np.cumsum([len(t[0]) for t in tree])]
    share = free / starts[-1]  # of each word, of the unknown ones below each stem, and of all others
    q = counts + share
    q_nodes = [np.bincount(at, q[1:], len(stem)) for stem, at in tree]
    ups = []  # each node's parent
    for k, (stem, at) in enumerate(tree):
        up = np.zeros(len(stem), np.int64)
        up[at] = tree[k - 1][1] if k else 0
        ups.append(up)
    for k in range(len(tree) - 1, -1, -1):
        q_nodes[k] = q_nodes[k] + share
        for j in range(k):
            at = ups[k]
            for i in range(k - 1, j, -1):
                at = ups[i][at]
            q_nodes[j] += np.bincount(at, np.full(len(at), share), len(q_nodes[j]))
    whole = q.sum() + share * (starts[-1] - rows)

    def texts_with(what: np.ndarray, some: np.ndarray, size: int) -> np.ndarray:
        """In how many of the texts of some tokens each of what is."""
        return np.bincount(np.unique(doc[some] * size + what[some]) % size, minlength=size) if len(doc) else np.zeros(size, np.int64)

    pairs, where = np.unique(first * rows + then, return_inverse=True)
    unigram, backoff, mass = np.zeros((starts[-1], 2)), np.ones((rows, 2)), np.zeros((len(pairs), 2))
    for c in (0, 1):
        own = cls == c
        above, q_above, rest = np.ones(1), np.array([whole]), np.array([share / whole])
        for k, (stem, at) in enumerate(tree):
            n, d = discounted(texts_with(at[w - 1], own, len(stem)))
            total = (n + d).sum()
            free = d.sum() / total if total else 1.0
            p = n / max(total, 1) + free * above[ups[k]] * q_nodes[k] / q_above[ups[k]]
            rest = np.r_[rest * free, p * share / q_nodes[k]]
            above, q_above = p, q_nodes[k]
        n, d = discounted(texts_with(w, own, rows))
        total = (n + d).sum()
        free = d.sum() / total if total else 1.0
        last = tree[-1][1]
        unigram[1:rows, c] = (n / max(total, 1))[1:] + free * above[last] * q[1:] / q_above[last]
        unigram[np.r_[0, rows : starts[-1]], c] = rest * free
        some = own[inner]
        n = np.bincount(np.unique(doc[inner][some] * len(pairs) + where[some]) % max(len(pairs), 1), minlength=len(pairs))
        after = np.bincount(pairs // rows, n, rows)
        n, d = discounted(n)
        mass[:, c] = n / np.maximum(after[pairs // rows], 1)
        backoff[:, c] = np.where(after > 0, np.bincount(pairs // rows, d, rows) / np.maximum(after, 1), 1.0)
    told = mass.any(1)  # pairs without mass of their own need no entry
    model = Model(h[order], [t[0] for t in tree], [np.arange(a, b) for a, b in zip(starts, starts[1:])], unigram.astype(np.float32), backoff.astype(np.float32), pairs[told], mass[told].astype(np.float32), np.array([0.0] * (2 + 2 * len(FAR)) + [-1.0]))
    if len(set(y_[hold])) == 2:
        model.curve = curve(model.features([t for t, h in zip(texts, hold) if h]), y_[hold])
    return model


def curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """logistic() with that of RIDGES that has the least loss on rows left out; each fold has its share of both classes."""
    part = np.empty(len(y), np.int64)
    for c in (0, 1):
        at = np.flatnonzero(y == c)
        part[at] = np.random.default_rng(11).permutation(len(at)) % FOLDS

    def loss(ridge: float) -> float:
        total = 0.0
        for k in range(FOLDS):
            s = np.clip(x[part == k] @ logistic(x[part != k], y[part != k], ridge), -30, 30)
            total += np.logaddexp(0, np.where(y[part == k] == 1, -s, s)).sum()
        return total

    return logistic(x, y, min(RIDGES, key=loss))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton steps on the logistic loss over standardised columns; the last column is constant and, but for the least
    of RIDGES, free."""
    scale = np.r_[x[:, :-1].std(0) + 1e-12, 1.0]
    z, w = x / scale, np.zeros(x.shape[1])
    ridge = np.r_[np.full(x.shape[1] - 1, ridge), RIDGES[0]]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(h, z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 4, held: int = 2, per_class: int = PER_CLASS) -> Model:
    """Model from labelled rows outside the held-out fold. With rows of
    one class, or none, the model knows no words and scores every text alike."""
    sample, counts = labelled_sample(docs, labels, label, mod, held, per_class)

    def run(batches):
        rows = sorted((i, t or b"", y) for b in batches for i, t, y in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()))
        model = train([t for _, t, _ in rows], [y for *_, y in rows])
        drawn = [sum(y == c for *_, y in rows) for c in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model, drawn))], pa.binary())], ["model"])

    # the sample is bounded, so one task holds it, and the driver only gets the model
    got = sample.select("doc_id", "text", "y").repartition(1).mapInArrow(run, "model binary").collect()
    model, drawn = pickle.loads(got[0]["model"]) if got else (train([], []), [0, 0])
    if counts.get(0) and counts.get(1) and all(drawn):  # the sample holds both classes in other shares than the labels do
        model.curve[-1] += np.log(counts[1] / drawn[1]) - np.log(counts[0] / drawn[0])
    return model


def score(docs: DataFrame, model: Model, mod: int = 4, held: int = 2, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs. Null texts are judged as empty ones; a null doc_id is
    not held out. Repeated rows are judged alike, each for itself. Other columns are ignored."""
    arrow_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shipped.value
        for b in batches:
            s = m.score([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", F.coalesce(remainder("doc_id", mod) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score below threshold."""
    arrow_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(text: pd.Series) -> pd.Series:
        return pd.Series(shipped.value.score([(t or "").encode() for t in text]))

    return docs.where(rate(F.col(text_col).cast("string")) < threshold)
