"""Labelled training rows for the classifiers: a bounded, reproducible sample with the same bound for each class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import small


def remainder(id_col: str, mod: int):
    """crc32 of the id as text, modulo mod; null ids give null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def marks(labels: DataFrame, label: str, mod: int, held: int, id_col: str) -> DataFrame:
    """(_id, y) of labelled ids outside the held-out fold. Ids labelled twice take their greatest label; null labels and
    ids are ignored, as are labels other than 0 and 1."""
    marked = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    return marked.where((remainder("_id", mod) != held) & F.col("y").isin(0, 1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y), with about per_class rows of each class at most, and the count of each class among all
    labelled rows outside the held-out fold. Rows are taken by a hash of the id, so reruns take the same ones. Ids
    labelled twice take their greatest label; null labels and ids are ignored."""
    marked = marks(labels, label, mod, held, id_col)
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    share = lambda y: min(1.0, per_class / max(1, counts.get(y, 0)))
    draw = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    marked = marked.where(draw < F.when(F.col("y") == 1, share(1)).otherwise(share(0)))
    texts = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(small(marked, 4 * per_class), F.col("_doc") == F.col("_id")).select(F.col("_id").alias("doc_id"), "text", "y"), counts
