"""Queries opN_* and their SQL. Each is the operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import impact_index, jaccard_tree, maxent, mixing, ranking, reputation, sharding, toxicity, warc, winnowing
from sievework.llm.common import Scratch, table


def op1_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels.quality of the doc_id that equals page_id is a page's outcome."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return reputation.judge(table(spark, sf_dir, "pages"), outcomes)


def op2_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select("doc_id", "bytes", "depth", "prefix", "shard_bytes", "part")


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.winnow(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash").withColumn("contaminated", F.col("n_items") >= 2)


def op4_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_position")


def op6_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_jaccard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_tree.ngram_jaccard_join(table(spark, sf_dir, "documents"), n=3, num=9, den=10)
    return found.select("doc_id", "n_shingles", "component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "archive").path("pages")
    warc.archive_pages(table(spark, sf_dir, "pages"), path)
    return warc.page_index(spark, path)


def op10_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.search(table(spark, sf_dir, "embeddings"))


def llm_queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def llm_oracle_sql() -> dict[str, str]:
    return {
        "op1_host_reputation": reputation.ORACLE_SQL,
        "op2_extendible_sharding": sharding.ORACLE_SQL.format(limit=sharding.LIMIT_BYTES),
        "op3_winnowing": winnowing.ORACLE_SQL,
        "op5_curriculum_mix": mixing.ORACLE_SQL,
        "op8_jaccard_tree": jaccard_tree.ORACLE_SQL,
        "op9_warc": warc.ORACLE_SQL,
        "op10_impact_search": impact_index.ORACLE_SQL,
    }
