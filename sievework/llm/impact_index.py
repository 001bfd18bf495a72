"""Exact top-k search by an impact-ordered, score-at-a-time index.

Components are integers. A posting segment holds, for one component, one plane of its values: what they are rounded
down to in coarse steps, then what is left in finer steps. A query takes a block's segments in descending order of
impact, |query component| * greatest value of the segment, and adds to each vector's score. What open segments can
still add is bounded, above and below. The query stops only when the bound proves that all but a few vectors are out,
and those few are scored exactly.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sievework.llm.common import Scratch, arrow_batches

BLOCK_ROWS, QUERY_ROWS = 16_384, 1024
STEPS = (32, 8, 1)


def narrow(x: np.ndarray) -> np.ndarray:
    """x in the narrowest integers that hold it."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return np.ascontiguousarray(x, kind)


class Block:
    """Segments of one block of vectors. rows: a number for each vector; ids (n); vectors (n x d) of integers."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, segments: np.ndarray | None = None):
        self.rows, self.ids, self.vectors = rows, ids, vectors
        self.segments = narrow(self.cut(vectors)) if segments is None else segments
        self.dim = np.tile(np.arange(vectors.shape[1]), len(STEPS))
        self.low, self.high = self.segments.min(1).astype(float), self.segments.max(1).astype(float)

    @staticmethod
    def cut(vectors: np.ndarray) -> np.ndarray:
        """A row for each step and component: the part of each vector's value in that plane."""
        rest, planes = vectors, []
        for step in STEPS:
            part = rest // step * step
            planes.append(part)
            rest = rest - part
        return np.stack(planes).transpose(0, 2, 1).reshape(-1, vectors.shape[0])

    def packed(self) -> dict:
        v = narrow(self.vectors)
        return {"n": len(self.ids), "rows": self.rows.tobytes(), "ids": self.ids.tobytes(), "width": v.shape[1], "vkind": v.dtype.str, "vectors": v.tobytes(), "skind": self.segments.dtype.str, "segments": self.segments.tobytes()}

    @classmethod
    def unpacked(cls, r: dict) -> Block:
        whole = np.frombuffer(r["vectors"], r["vkind"]).reshape(r["n"], r["width"])
        return cls(np.frombuffer(r["rows"], np.int64), np.frombuffer(r["ids"], np.int64), whole, np.frombuffer(r["segments"], r["skind"]).reshape(-1, r["n"]))

    def top(self, q: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the block's k best but the row own, ties to smaller ids; segments read."""
        w = q.astype(float)[self.dim]
        most, least = np.maximum(w * self.low, w * self.high), np.minimum(w * self.low, w * self.high)
        order = np.argsort(-np.maximum(np.abs(most), np.abs(least)), kind="stable")
        above = np.r_[np.cumsum(most[order][::-1])[::-1], 0.0]
        below = np.r_[np.cumsum(least[order][::-1])[::-1], 0.0]
        acc, n, stop = np.zeros(len(self.ids)), len(self.ids), len(order)
        want, slack = min(n, k + (own is not None)), 1e-9 * (1 + np.abs(most).sum() + np.abs(least).sum())
        few = max(4 * k, n // 64)
        every = max(8, len(order) // 12)
        alive = np.arange(n)
        for at, s in enumerate(order):
            if at and at % every == 0 and above[at] - below[at] > 0:
                alive, bar = self.alive(acc, want, above[at] - below[at] + slack)
                if len(alive) <= few:
                    stop = at
                    break
            if w[s]:
                acc += w[s] * self.segments[s]
        else:
            alive, bar = self.alive(acc, want, slack)
        if own is not None:
            alive = alive[self.rows[alive] != own]
        ids, score = self.ids[alive], self.vectors[alive].astype(np.int64) @ q
        best = np.lexsort((ids, -score))[:k]
        return ids[best], score[best], stop

    @staticmethod
    def alive(acc: np.ndarray, want: int, gap: float) -> tuple[np.ndarray, float]:
        """Vectors that may still be among the want best if open segments differ by gap at most between vectors."""
        bar = np.partition(acc, len(acc) - want)[len(acc) - want] - gap
        return np.flatnonzero(acc >= bar), bar


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(row, vec_id, v array<bigint>): floor(scale * x); vectors that are null or hold null, NaN or infinite components
    go, as do rows without an id."""
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = df.where(F.col(id_col).isNotNull() & fine)
    return df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """The lists as rows of numbers, filled up with zeros."""
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), width), np.int64)
    out[row, col] = flat
    return out


PACKED = "n long, rows binary, ids binary, width long, vkind string, vectors binary, skind string, segments binary"


def build_index(rows: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """rows (row, vec_id, v) -> a table with a row for each block of BLOCK_ROWS vectors or fewer."""
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))

    def run(batches):
        held, n = [], 0

        def out():
            b = pa.Table.from_batches(held).combine_chunks()
            lists = b.column("v").combine_chunks() if b.num_rows else pa.array([], pa.list_(pa.int64()))
            block = Block(b.column("row").to_numpy(), b.column("vec_id").to_numpy(), matrix(lists, width))
            return pa.RecordBatch.from_pylist([block.packed()])

        for b in batches:
            while b.num_rows:
                some = b.slice(0, BLOCK_ROWS - n)
                b = b.slice(some.num_rows)
                held.append(some)
                n += some.num_rows
                if n == BLOCK_ROWS:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    return scratch.keep(rows.repartition(blocks, "row").mapInArrow(run, PACKED), "index")


def search(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every, its k highest inner products with
    all other rows (all of them, if fewer), ties to smaller ids.

    Rows that repeat an id are candidates each, and queries each, with equal query_id and a list of their own; only a
    query's very row is no candidate of it. Vectors of different lengths are compared as if padded with zeros. Null
    vectors, ids and components take no part. Other columns are ignored; an empty table gives an empty result. Scores
    must fit a long. Queries go out in blocks of about QUERY_ROWS and meet the index, whose blocks have BLOCK_ROWS rows
    at most; neither grows with the input."""
    spark = vectors.sparkSession
    arrow_batches(spark, 4000)
    scratch = Scratch(spark, "impact")
    rows = scratch.keep(quantised(vectors, id_col, vector_col, scale), "vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    index = build_index(rows, width, scratch)
    asked = scratch.keep(rows.where(F.pmod("vec_id", F.lit(every)) == 0), "queries")
    lots = max(1, -(-asked.count() // QUERY_ROWS))
    parts = []
    arrow_batches(spark, 1)  # a block is a row
    try:
        for lot in range(lots):
            some = asked.where(F.pmod(F.xxhash64("row"), F.lit(lots)) == lot).toArrow()
            lists = pa.chunked_array(some.column("v")).combine_chunks() if some.num_rows else pa.array([], pa.list_(pa.int64()))
            shipped = spark.sparkContext.broadcast((some.column("row").to_numpy(), some.column("vec_id").to_numpy(), matrix(lists, width)))

            def run(batches, shipped=shipped):
                numbers, names, queries = shipped.value
                for b in batches:
                    for r in b.to_pylist():
                        block, out = Block.unpacked(r), []
                        here = set(block.rows.tolist())
                        for number, name, q in zip(numbers.tolist(), names.tolist(), queries):
                            found, score, _ = block.top(q, number if number in here else None, k)
                            out.append((np.full(len(found), number), np.full(len(found), name), found, score))
                        if out:
                            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], ["query_row", "query_id", "vec_id", "score"])

            parts.append(scratch.keep(index.mapInArrow(run, "query_row long, query_id long, vec_id long, score long"), "best"))
            shipped.destroy()
    finally:
        arrow_batches(spark, 4000)
    best = reduce(DataFrame.union, parts)
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.row <> c.row),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
