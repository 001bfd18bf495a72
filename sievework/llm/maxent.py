"""Language-model scores by a hashed maximum-entropy model.

The vocabulary is factored into 256 classes in 16 groups: frequent words are classes of their own, the others share
classes by their ending. The model gives log P(group | history) + log P(class | group, history) as two softmaxes over
sums of weight rows, one row for each active feature: a bias, the word class before, the one before that (a skip
feature), and the hashed pair of both (an n-gram feature). Within a class a word has its share of the class's
training tokens, with one added to every count and one unseen word to every class.

Histories repeat, so the gradient over all training tokens is a sum over distinct histories with counts. Those are
counted once and dealt over tasks by their pair feature, so each task owns the weight rows of its pairs: it takes their
step itself and sends back their new weights. Of the bias, bigram and skip rows, which tasks share, it sends gradients,
which are summed before the step. Sizes of weights and of what comes to the driver follow from the constants here, not
from the corpus.
Word counts are a shuffled table of all words of all training texts; scoring looks up the commonest in memory and
joins the others.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import FOLD, Scratch, arrow_batches
from sievework.llm.labelled import remainder

CLASSES, GROUPS, OWN = 256, 16, 192
FEATURES = 1 << 14
PAIR_AT = 1 + 2 * CLASSES
MULTIPLIER = 2654435761
#: Tasks over the histories, of which there are CLASSES squared at most.
TASKS = 8
STEPS, RATE = 15, 0.5
#: Strength of the prior that draws weights to 0, for single classes and histories the more so the fewer their tokens.
PRIOR = 5.0
#: Words whose counts every task holds; all others are joined.
COMMON = 1 << 17
FLUSH = 1_000_000
END = b"\n"  # no word holds white space


def word_hash(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w) - (1 << 63)


def ending(w: bytes) -> int:
    """Class shared by all words with the same last bytes."""
    return OWN + crc32(w[-3:]) % (CLASSES - OWN)


class Codes(dict):
    """Words numbered as they come."""

    def __missing__(self, w: bytes) -> int:
        self[w] = n = len(self)
        return n


def coded(texts: list) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(code of every token, tokens of each text, words by code); each text ends with END."""
    codes, ends = Codes({END: 0}), [END]
    docs = [(t.translate(FOLD).split() if t else []) + ends for t in texts]
    sizes = np.array([len(d) for d in docs], np.int64)
    flat = np.fromiter(map(codes.__getitem__, chain.from_iterable(docs)), np.int64, int(sizes.sum()))
    return flat, sizes, list(codes)


@dataclass
class Lexicon:
    """own: frequent word -> class. common: sorted hashes of the commonest words, with counts. room: for each class
    log10(N_c + V_c + 1), 0 for a word's own class."""

    own: dict[bytes, int]
    common: np.ndarray
    counts: np.ndarray
    room: np.ndarray
    tokens: int
    words: int

    def classes(self, words: list[bytes]) -> np.ndarray:
        get = self.own.get
        return np.fromiter((c if (c := get(w)) is not None else ending(w) for w in words), np.int64, len(words))


def histories(cls: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Class before times CLASSES plus class before that; END stands before a text."""
    one, two = np.r_[0, cls[:-1]], np.r_[0, 0, cls[:-2]][: len(cls)]
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    one[starts] = 0
    two[starts] = 0
    second = starts + 1
    two[second[sizes > 1]] = 0
    return one * CLASSES + two


@dataclass
class Weights:
    group: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, GROUPS), np.float32))
    cls: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, GROUPS, CLASSES // GROUPS), np.float32))


def active(history: np.ndarray) -> np.ndarray:
    """Rows of the features of each history: bias, bigram, skip and hashed pair."""
    one, two = history // CLASSES, history % CLASSES
    pair = PAIR_AT + (history * MULTIPLIER >> 7) % (FEATURES - PAIR_AT)
    return np.stack([np.zeros_like(one), 1 + one, 1 + CLASSES + two, pair], 1)


def log_probs(w: Weights, rows: np.ndarray) -> np.ndarray:
    """(histories, CLASSES) of natural logarithms."""
    g, c = w.group[rows].sum(1), w.cls[rows].sum(1)
    g -= g.max(1, keepdims=True)
    g -= np.log(np.exp(g).sum(1, keepdims=True))
    c -= c.max(2, keepdims=True)
    c -= np.log(np.exp(c).sum(2, keepdims=True))
    return (g[:, :, None] + c).reshape(len(rows), CLASSES)


def _count_words(batches):
    """Counts of words, summed up in the task as far as memory is meant to go."""
    seen: Counter = Counter()

    def out():
        words = list(seen)
        return pa.RecordBatch.from_arrays([pa.array([word_hash(w) for w in words], pa.int64()), pa.array(words, pa.binary()), pa.array([seen[w] for w in words], pa.int64())], ["h", "w", "c"])

    for b in batches:
        for t in b.column(0).cast(pa.binary()).to_pylist():
            seen.update((t or b"").translate(FOLD).split())
        seen[END] += b.num_rows
        if len(seen) > FLUSH:
            yield out()
            seen = Counter()
    yield out()


def lexicon(train: DataFrame, scratch: Scratch) -> tuple[Lexicon, DataFrame]:
    """Word counts of all training texts as a table (h, c), and what fits every task of them."""
    counted = train.select("text").mapInArrow(_count_words, "h long, w binary, c long").groupBy("h").agg(F.sum("c").alias("c"), F.min("w").alias("w"))
    counted = scratch.keep(counted.withColumn("e", (F.crc32(F.unhex(F.expr("right(hex(w), 6)"))) % (CLASSES - OWN) + OWN).cast("int")), "words")
    total = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # counts by logarithmic steps tell from where on the commonest words are few enough
    step = F.floor(F.log2("c") * 16).cast("int")
    sizes = sorted(((r["s"], r["n"]) for r in counted.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)

    def above(most: int) -> DataFrame:
        total, low = 0, 1 << 30
        for s, n in sizes:
            total += n
            if total > most:
                break
            low = s
        return counted.where(step >= low)

    top = above(COMMON).select("h", "c").toPandas()
    first = sorted((-r["c"], r["h"], bytes(r["w"])) for r in above(4096).collect())
    first = [w for _, _, w in first if w != END]
    own = {END: 0} | {w: i + 1 for i, w in enumerate(first[: OWN - 1])}
    hashes = [word_hash(w) for w in own]
    room = np.zeros(CLASSES)
    for r in counted.where(~F.col("h").isin(hashes)).groupBy("e").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # a row for each class
        room[r["e"]] = r["n"] + r["v"]
    room = np.where(np.arange(CLASSES) < OWN, 0.0, np.log10(room + 1))
    order = np.argsort(top["h"].to_numpy(np.int64))
    return Lexicon(own, top["h"].to_numpy(np.int64)[order], top["c"].to_numpy(np.int64)[order], room, int(total[0]), int(total[1])), counted.select("h", "c")


def count_histories(train: DataFrame, lex: Lexicon, scratch: Scratch) -> DataFrame:
    """(history, n array<int, CLASSES>): how often each class follows, over all training texts."""
    shipped = train.sparkSession.sparkContext.broadcast(lex)

    def run(batches):
        seen = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            flat, sizes, words = coded(b.column(0).cast(pa.binary()).to_pylist())
            if len(flat):
                cls = shipped.value.classes(words)[flat]
                code, n = np.unique(histories(cls, sizes) * CLASSES + cls, return_counts=True)
                both, at = np.unique(np.r_[seen[0], code], return_inverse=True)
                seen = both, np.bincount(at, np.r_[seen[1], n]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(seen[0] // CLASSES), pa.array((seen[0] % CLASSES).astype(np.int32)), pa.array(seen[1])], ["history", "cls", "n"])

    rows = train.select("text").mapInArrow(run, "history long, cls int, n long").groupBy("history", "cls").agg(F.sum("n").alias("n"))
    whole = rows.groupBy("history").agg(F.collect_list(F.struct("cls", "n")).alias("next"))
    return scratch.keep(whole, "histories")


PACKED = "history binary, sizes binary, cls binary, n binary"


def _pack(batches):
    """A task's histories as one row."""
    held = [b for b in batches if b.num_rows]
    if held:
        b = pa.Table.from_batches(held).combine_chunks()
        cell = b.column("next").combine_chunks()
        inner = cell.flatten()
        arrays = [b.column("history").to_numpy(), cell.value_lengths().to_numpy(), inner.field("cls").to_numpy(zero_copy_only=False), inner.field("n").to_numpy(zero_copy_only=False)]
        kinds = (np.int64, np.int32, np.int32, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x, k).tobytes()], pa.binary()) for x, k in zip(arrays, kinds)], ["history", "sizes", "cls", "n"])


def sums(w: Weights, history: np.ndarray, sizes: np.ndarray, cls: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight rows that some histories touch, and for each: groups observed and expected, classes observed and expected."""
    out, touched = np.zeros((FEATURES, 2 * (GROUPS + CLASSES)), np.float32), np.zeros(FEATURES, bool)
    ends = np.cumsum(sizes)
    for lo in range(0, len(history), 2048):
        some = slice(lo, lo + 2048)
        inner = slice(ends[lo] - sizes[lo], ends[min(lo + 2048, len(history)) - 1])
        seen = np.zeros((len(history[some]), CLASSES), np.float32)
        seen[np.repeat(np.arange(len(seen)), sizes[some]), cls[inner]] = n[inner]
        rows = active(history[some])
        p = np.exp(log_probs(w, rows)).reshape(len(seen), GROUPS, -1)
        groups, told = p.sum(2), seen.reshape(p.shape).sum(2)
        inside = p / np.maximum(groups[:, :, None], 1e-30) * told[:, :, None]
        x = np.concatenate([told, groups * seen.sum(1, keepdims=True), seen, inside.reshape(len(seen), CLASSES)], 1)
        for k in range(rows.shape[1]):
            at, where = np.unique(rows[:, k], return_inverse=True)
            by = np.argsort(where, kind="stable")
            out[at] += np.add.reduceat(x[by], np.searchsorted(where[by], np.arange(len(at))), axis=0)
            touched[at] = True
    at = np.flatnonzero(touched)
    return at, out[at]


def step(w: Weights, at: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    """New weights of rows: a step along the summed gradient, each weight's scaled by the counts behind it."""
    og, eg, oc, ec = np.split(gradient, [GROUPS, 2 * GROUPS, 2 * GROUPS + CLASSES], 1)
    group, cls = w.group[at], w.cls[at].reshape(len(at), CLASSES)
    group = group + RATE * (og - eg - PRIOR * group) / (np.maximum(og, eg) + PRIOR)
    cls = cls + RATE * (oc - ec - PRIOR * cls) / (np.maximum(oc, ec) + PRIOR)
    return np.concatenate([group, cls], 1).astype(np.float32)


def _work(shipped):
    """For each row of packed histories the new weights of the rows of its pairs (own true), and for all of them the
    gradients of the rows that tasks share (own false)."""

    def run(batches):
        w, shared, touched = shipped.value, np.zeros((PAIR_AT, 2 * (GROUPS + CLASSES)), np.float32), np.zeros(PAIR_AT, bool)
        for b in batches:
            for r in b.to_pylist():
                at, got = sums(w, *(np.frombuffer(r[c], k) for c, k in (("history", np.int64), ("sizes", np.int32), ("cls", np.int32), ("n", np.int64))))
                own = at >= PAIR_AT
                shared[at[~own]] += got[~own]
                touched[at[~own]] = True
                yield from _rows(at[own], step(w, at[own], got[own]), True)
        yield from _rows(np.flatnonzero(touched), shared[touched], False)

    return run


def _rows(at: np.ndarray, data: np.ndarray, own: bool):
    for lo in range(0, len(at), 1000):
        some = slice(lo, lo + 1000)
        yield pa.RecordBatch.from_arrays([pa.array(at[some], pa.int64()), pa.array([own] * len(at[some])), pa.array([x.tobytes() for x in data[some]], pa.binary())], ["row", "own", "data"])


def train_weights(counts: DataFrame, steps: int = STEPS) -> Weights:
    """Weights after some steps over counts (history, next). A pair's row belongs to one task, whose histories are one
    row of a table, so no split of files parts them. What comes back is bounded by FEATURES and TASKS. Rows that no
    history touches stay 0."""
    spark, w = counts.sparkSession, Weights()
    scratch = Scratch(spark, "weights")
    pair = F.expr(f"shiftright(history * {MULTIPLIER}, 7) % {FEATURES - PAIR_AT}")
    packed = scratch.keep(counts.repartition(TASKS, pair).mapInArrow(_pack, PACKED), "packed")
    for _ in range(steps):
        shipped = spark.sparkContext.broadcast(w)
        got = packed.coalesce(TASKS).mapInArrow(_work(shipped), "row long, own boolean, data binary").toArrow()
        shipped.destroy()  # every step sends weights anew
        rows, own = got.column("row").to_numpy(), got.column("own").to_numpy()
        data = got.column("data")
        new = np.zeros((0, GROUPS + CLASSES), np.float32)
        shared = np.zeros((PAIR_AT, 2 * (GROUPS + CLASSES)), np.float32)
        seen = np.zeros(PAIR_AT, bool)
        mine = np.flatnonzero(own)
        if len(mine):
            new = np.stack([np.frombuffer(data[int(k)].as_buffer(), np.float32) for k in mine])
        for k in np.flatnonzero(~own):
            shared[rows[k]] += np.frombuffer(data[int(k)].as_buffer(), np.float32)
            seen[rows[k]] = True
        at = np.r_[rows[mine], np.flatnonzero(seen)].astype(np.int64)
        whole = np.concatenate([new, step(w, np.flatnonzero(seen), shared[seen])])
        del got, data
        w.group[at], w.cls[at] = whole[:, :GROUPS], whole[:, GROUPS:].reshape(len(at), GROUPS, CLASSES // GROUPS)
    scratch.drop(packed)
    return w


def score(docs: DataFrame, mod: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Null texts are empty ones: one token, the end. A null doc_id is not held out. Repeated rows are counted and scored
    each for itself. With no training text every word is unseen. Other columns are ignored."""
    spark = docs.sparkSession
    arrow_batches(spark)
    scratch = Scratch(spark, "maxent")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = F.coalesce(remainder("doc_id", mod) == held, F.lit(False))
    train = rows.where(~out)
    lex, words = lexicon(train, scratch)
    weights = train_weights(count_histories(train, lex, scratch))
    shipped = spark.sparkContext.broadcast((lex, weights))

    def run(batches):
        lex, w = shipped.value
        for b in batches:
            if not b.num_rows:
                continue
            flat, sizes, vocab = coded(b.column(1).cast(pa.binary()).to_pylist())
            cls_of, h = lex.classes(vocab), np.fromiter(map(word_hash, vocab), np.int64, len(vocab))
            count, known = np.zeros(len(vocab), np.int64), np.zeros(len(vocab), bool)
            if len(lex.common):
                at = np.minimum(np.searchsorted(lex.common, h), len(lex.common) - 1)
                known = lex.common[at] == h
                count = np.where(known, lex.counts[at], 0)
            cls = cls_of[flat]
            history, at = np.unique(histories(cls, sizes), return_inverse=True)
            lp = np.empty(len(flat))
            by = np.argsort(at, kind="stable")
            cut = np.searchsorted(at[by], np.arange(0, len(history) + 4096, 4096))
            for k, lo in enumerate(range(0, len(history), 4096)):
                some = by[cut[k] : cut[k + 1]]
                lp[some] = log_probs(w, active(history[lo : lo + 4096]))[at[some] - lo, cls[some]]
            gain = np.log10(count + 1.0)
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            of = lambda x: np.add.reduceat(x, starts)
            model = lp / np.log(10) + np.where(cls < OWN, 0, gain[flat]) - lex.room[cls]
            doc = np.repeat(np.arange(len(sizes)), sizes)
            rare = np.flatnonzero(~known[flat])
            pair, n = np.unique(doc[rare] * len(vocab) + flat[rare], return_counts=True)
            row, none = b.column(0).to_numpy(), len(pair)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[row, row[pair // len(vocab)]]),
                    pa.array(np.r_[row, h[pair % len(vocab)]]),
                    pa.array(np.r_[np.zeros(len(row), np.int64), n]),
                    pa.concat_arrays([b.column(2), pa.nulls(none, b.column(2).type)]),
                    *(pa.array(np.r_[x, np.zeros(none, x.dtype)]) for x in (sizes, of(known[flat].astype(np.int64)), of(gain[flat]), of(model))),
                ],
                ["row", "h", "n", "doc_id", "n_tokens", "n_known", "base", "model"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = rows.select("row", "text", "doc_id").mapInArrow(run, f"row long, h long, n long, doc_id {kind}, n_tokens long, n_known long, base double, model double")
    words = words.select(F.col("h").alias("wh"), "c")
    if len(lex.counts):
        words = words.where(F.col("c") < int(lex.counts.min()))
    found = parts.join(words, (parts.h == words.wh) & (parts.n > 0), "left")
    gain = F.coalesce(F.col("n") * F.log10(F.col("c") + 1.0), F.lit(0.0))
    whole = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"), F.sum(F.col("base") + gain).alias("base"), F.sum(F.col("model") + gain).alias("score"))
    per_token = float(np.log10(lex.tokens + lex.words + 1))
    return whole.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(lex.tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * per_token).alias("base_score"), "score")
