"""Corpus pipeline: toxicity, near duplicates, benchmark passages, source mix, shards, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's
docs. All but the last return the columns of documents; the last adds the shard of each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import jaccard_tree, mixing, sharding, toxicity, winnowing
from sievework.llm.common import Scratch, small, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; the model learns from labels.toxic."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids (gone)."""
    return docs.join(small(ids, 1_000_000), F.col("doc_id") == F.col("gone"), "left_anti")


def row_key(docs: DataFrame):
    """A long that rows of docs share only if they share doc_id and text, null ones included."""
    salt, exact = 0, F.struct("doc_id", F.md5("text").alias("t"))
    while True:
        key = F.xxhash64(F.lit(salt), F.col("doc_id").isNull(), F.col("text").isNull(), "doc_id", "text")
        met = docs.groupBy(key.alias("k")).agg(F.min(exact).alias("lo"), F.max(exact).alias("hi")).where("not (lo <=> hi)")
        if met.limit(1).count() == 0:
            return key
        salt += 1


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at a similarity of 0.8 or more, the one with the
    smallest doc_id stays; null ids come last, and of one id the smallest md5 of the text.

    A document is a doc_id with a text. Rows that repeat both are one document, of which the row with the smallest
    columns stays; rows that share only the doc_id, or have none, are documents of their own. Texts without words are
    alone."""
    scratch = Scratch(spark, "near")
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count() == 0:
        found = jaccard_tree.ngram_jaccard_join(docs, n=5, num=8, den=10)
        return drop_ids(docs, scratch.keep(found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")), "gone"))
    key = row_key(docs)
    found = jaccard_tree.ngram_jaccard_join(docs.select(key.alias("doc_id"), "text"), n=5, num=8, den=10)
    found = scratch.keep(found.select(F.col("doc_id").alias("k"), "component_id").distinct(), "found")
    names = docs.select(key.alias("_k"), "doc_id", F.md5("text").alias("t")).distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "k"))
    stay = scratch.keep(found.join(names, F.col("k") == F.col("_k")).groupBy("component_id").agg(first.alias("s")).select(F.col("s.k").alias("_stay")), "stay")
    kept = docs.withColumn("_row", key).join(small(stay, 1_000_000), F.col("_row") == F.col("_stay"), "left_semi")
    again = scratch.keep(kept.groupBy("_row").count().where("count > 1").select(F.col("_row").alias("_again")), "again")
    one = kept.join(small(again, 1_000_000), F.col("_row") == F.col("_again"), "left_semi").groupBy("_row").agg(F.min(F.struct(*docs.columns)).alias("s"))
    rest = kept.join(small(again, 1_000_000), F.col("_row") == F.col("_again"), "left_anti").select(*docs.columns)
    return rest.unionByName(one.select("s.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of some benchmark item go: every row with such a doc_id and text, null ids
    included. Other rows of the same doc_id stay, as do null and empty texts."""
    scratch = Scratch(spark, "leaks")
    found = winnowing.winnow(docs, table(spark, sf_dir, "benchmark")).where("n_items > 0")
    gone = scratch.keep(found.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct(), "gone")
    return docs.join(small(gone, 1_000_000), F.col("doc_id").eqNullSafe(F.col("_gone")) & (F.xxhash64("text") == F.col("_hash")), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of the curriculum."""
    return mixing.materialise(docs, mixing.mix(docs))


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard: depth, prefix, shard_bytes, part."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("sharding", shard_documents),
]

#: The toxicity model cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
