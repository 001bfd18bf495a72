"""Quality by Bradley-Terry pairwise ranking.

A document is described by shares and ratios of its whole text and by its words: the shares of its distinct words that
fall into each of LEXICAL hash buckets. Each share or ratio enters by itself and as a soft position among quantiles of
the training sample, so the score need not be monotone in it. Preference pairs set documents labelled good over
documents labelled poor; weights minimise the logistic loss of the pairs' feature differences, which is the likelihood
of the Bradley-Terry model. The cut is the quantile of the scores of all labelled documents outside the held-out fold
that leaves as large a share as is labelled good.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import FOLD, Scratch, arrow_batches
from sievework.llm.labelled import labelled_sample, marks, remainder
from sievework.llm.toxicity import logistic

PER_CLASS, PAIRS, KNOTS = 3000, 8, 6
#: Hash buckets of words, and their standard deviation beside 1 of the other features: the smaller, the more they are held to 0.
LEXICAL, LEXICAL_SCALE = 64, 0.1
RAISED = bytes(range(65, 91))
LETTERS = RAISED + bytes(range(97, 123)) + bytes(range(128, 256))
SYMBOLS = b"#$%&*@^~=+<>{}[]\\_"
FEATURES = ["log_words", "word_length", "raised", "symbols", "digits", "bars", "cries", "stops", "distinct", "top_word", "short", "log_line", "line_repeat", "word_repeat", "wide", "marks"]


def lexical(words) -> list[float]:
    """Shares of distinct words by hash bucket, A-Z folded."""
    kinds = {w.translate(FOLD) for w in words}
    at = np.fromiter((xxhash.xxh32_intdigest(w) % LEXICAL for w in kinds), np.int64, len(kinds))
    return (np.bincount(at, minlength=LEXICAL) / max(len(kinds), 1)).tolist()


def describe(text: bytes) -> list[float]:
    """The features of one text, whole: FEATURES, then LEXICAL of its words; all zero for an empty one."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * (len(FEATURES) + LEXICAL)
    gone = lambda chars: size - len(text.translate(None, chars))
    letters, raised, counts = gone(LETTERS), gone(RAISED), Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = sum(w.endswith(b".") for w in words)
    return [
        np.log1p(n), (size - n + 1) / n, raised / max(letters, 1), gone(SYMBOLS) / size, gone(b"0123456789") / size, text.count(b"|") / n, text.count(b"!") / n, ends / n,
        len(counts) / n**0.8, max(counts.values()) / n, sum(len(w) <= 3 for w in words) / n, np.log1p(n / max(len(lines), 1)), 1 - len(set(lines)) / max(len(lines), 1),
        sum(a == b for a, b in zip(words, words[1:])) / n, sum(text.count(bytes([c])) for c in (195, 197, 206, 208, 228)) / size, (size - letters) / size,
        *lexical(counts),
    ]


@dataclass
class Ranker:
    knots: np.ndarray
    centre: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Raw features, centred, and for each knot a smooth step at it; words enter as they are, centred."""
        z, f = (np.nan_to_num(x) - self.centre[0]) / self.centre[1], len(FEATURES)
        steps = [np.tanh((np.nan_to_num(x[:, :f]) - k) / self.centre[1, :f]) for k in self.knots]
        return np.hstack([z[:, :f], *steps, LEXICAL_SCALE * z[:, f:]])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray, threshold: float) -> np.ndarray:
        """Between 0 and 1; the cut is at threshold."""
        return self.scaled(self.raw(x), threshold)

    def scaled(self, raw: np.ndarray, threshold: float) -> np.ndarray:
        shift = np.log(threshold / (1 - threshold))
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw - self.cut) + shift, -30, 30)))


def preferences(good: np.ndarray, poor: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a good and a poor document, pairs of them for each of the larger class."""
    n, rng = pairs * max(len(good), len(poor)), np.random.default_rng(5)
    return rng.permutation(np.resize(good, n)), rng.permutation(np.resize(poor, n))


def train(x: np.ndarray, y: np.ndarray, good_share: float, pairs: int = PAIRS) -> Ranker:
    """x (rows, features), y 0/1. Each document of the rarer class meets pairs documents of the other."""
    x = np.nan_to_num(x)
    f = len(FEATURES)
    knots = np.quantile(x[:, :f], np.linspace(0.05, 0.95, KNOTS), axis=0) if len(x) else np.zeros((KNOTS, f))
    centre = np.stack([x.mean(0), x.std(0) + 1e-9]) if len(x) else np.stack([np.zeros(f + LEXICAL), np.ones(f + LEXICAL)])
    model = Ranker(knots, centre, np.zeros(f * (KNOTS + 1) + LEXICAL), 0.0, 1.0)
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(poor):
        return model
    z = model.expand(x)
    a, b = preferences(good, poor, pairs)
    diff = z[a] - z[b]
    w = np.zeros(z.shape[1])
    for _ in range(30):  # Newton steps; every pair has the good document first
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        h = (diff * (p * (1 - p))[:, None]).T @ diff + 1.0 * np.eye(len(w))
        step = np.linalg.solve(h, diff.T @ p - 1.0 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    s = z @ w
    weight = np.where(y == 1, good_share / len(good), (1 - good_share) / len(poor))
    order = np.argsort(s)
    at = np.searchsorted(np.cumsum(weight[order]), 1 - good_share)
    model.cut = float((s[order[min(at, len(s) - 1)]] + s[order[max(at - 1, 0)]]) / 2)
    model.slope = float(max(logistic(np.column_stack([s, np.ones(len(s))]), y)[0], 1e-3))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 5, held: int = 0, per_class: int = PER_CLASS) -> Ranker:
    """Ranker from a bounded sample of labelled rows outside the held-out fold; only features come to the driver. The
    cut is taken over all of the labelled rows outside it. With rows of one class, or none, every text has one score."""
    model, good = learn(docs, labels, label, mod, held, per_class)
    if model.weights.any():
        scratch = Scratch(docs.sparkSession, "ranking")
        rated = scratch.keep(rate(docs.where(remainder("doc_id", mod) != held), model), "rated")
        model.cut = cut_of(labelled(rated, labels, label, mod, held), good)
        scratch.drop(rated)
    return model


def rank(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 5, held: int = 0, per_class: int = PER_CLASS, threshold: float = 0.3) -> DataFrame:
    """score() of docs by the model that fit() makes of them. Each text is rated once, for the cut and for its score."""
    model, good = learn(docs, labels, label, mod, held, per_class)
    rated = Scratch(docs.sparkSession, "ranking").keep(rate(docs, model), "rated")
    if model.weights.any():
        model.cut = cut_of(labelled(rated, labels, label, mod, held), good)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            score = shipped.value.scaled(b.column(1).to_numpy(zero_copy_only=False), threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return verdicts(rated.mapInArrow(run, f"doc_id {rated.schema['doc_id'].dataType.simpleString()}, score double"), mod, held, threshold)


def learn(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, per_class: int) -> tuple[Ranker, float]:
    """Ranker with the cut of its sample, and the share labelled good of all labelled rows outside the held-out fold."""
    arrow_batches(docs.sparkSession)
    sample, counts = labelled_sample(docs, labels, label, mod, held, per_class)

    def run(batches):
        for b in batches:
            f = [describe(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(f, pa.list_(pa.float64()))], ["doc_id", "y", "f"])

    got = sample.mapInArrow(run, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, y int, f array<double>").toPandas().sort_values("doc_id", kind="stable")
    total = counts.get(0, 0) + counts.get(1, 0)
    good = counts.get(1, 0) / total if total else 0.5
    x = np.array(got["f"].tolist(), float).reshape(-1, len(FEATURES) + LEXICAL)
    return train(x, got["y"].to_numpy(int), good), good


def rate(docs: DataFrame, model: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, raw for each row of docs."""
    return each_text(docs, model, lambda m, x: m.raw(x), "raw", id_col, text_col)


def labelled(rated: DataFrame, labels: DataFrame, label: str, mod: int, held: int) -> DataFrame:
    """(raw) of the rows that are labelled and outside the held-out fold. Joined after rating, so that ids and numbers
    are shuffled and texts aren't."""
    return rated.join(marks(labels, label, mod, held, "doc_id"), F.col("doc_id") == F.col("_id"), "left_semi").select("raw")


def cut_of(rated: DataFrame, good: float) -> float:
    """The middle between the neighbours of the quantile that leaves the share good of rated (raw) above it."""
    at = rated.agg(F.percentile_approx("raw", 1 - good, 1_000_000)).first()[0]
    low, high = rated.agg(F.max(F.when(F.col("raw") <= at, F.col("raw"))), F.min(F.when(F.col("raw") > at, F.col("raw")))).first()
    return float(low if high is None else (low + high) / 2)


def score(docs: DataFrame, model: Ranker, mod: int = 5, held: int = 0, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs. Null texts are judged as empty ones; a null doc_id is
    not held out. Repeated rows are judged alike, each for itself; ties share a score. Other columns are ignored."""
    return verdicts(each_text(docs, model, lambda m, x: m.score(x, threshold), "score", id_col, text_col), mod, held, threshold)


def each_text(docs: DataFrame, model: Ranker, of, name: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id and of(model, features) for each row of docs."""
    arrow_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            x = np.array([describe(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()], float).reshape(-1, len(FEATURES) + LEXICAL)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of(shipped.value, x), pa.float64())], ["doc_id", name])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {name} double")


def verdicts(scored: DataFrame, mod: int, held: int, threshold: float) -> DataFrame:
    return scored.select("doc_id", F.coalesce(remainder("doc_id", mod) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
