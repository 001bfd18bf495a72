"""Skill library: search, hit counts, tiers, environments, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.text import days_since, ranges_overlap, tier_advice, version_key


def skill_score(haystack: Column, keywords: Column, terms: list[str]) -> Column:
    """For each term: 1 if the haystack holds it, else, for terms of 4 or more, the keywords of 2 or more inside it."""

    def one(t: str) -> Column:
        inside = F.size(F.filter(keywords, lambda k: (F.length(k) >= 2) & F.lit(t).contains(F.lower(k))))
        return F.when(haystack.contains(t), 1).otherwise(inside if len(t) >= 4 else F.lit(0))

    parts = [one(t.lower()) for t in terms]
    return reduce(lambda a, b: a + b, parts)


def find(skills: DataFrame, terms: list[str], most: int | None = None) -> DataFrame:
    """Pure search, best first, then by hits and id; bump() records it."""
    hay = F.lower(F.concat_ws(" ", "id", "name", F.array_join("keywords", " "), "trigger"))
    out = skills.withColumn("score", skill_score(hay, F.col("keywords"), terms)).where("score > 0").orderBy(F.desc("score"), F.desc("hits"), "id")
    return out.limit(most) if most else out


def bump(skills: DataFrame, found: DataFrame, today: str, top: int = 3) -> DataFrame:
    """New snapshot: one hit more for the best top of found, seen today, archived ones cold again."""
    best = found.orderBy(F.desc("score"), F.desc("hits"), "id").limit(top).select(F.col("id").alias("_b"))
    df = skills.join(best, F.col("id") == F.col("_b"), "left")
    hit = F.col("_b").isNotNull()
    return df.withColumns({"hits": F.col("hits") + hit.cast("int"), "last_used": F.when(hit, F.lit(today).cast("date")).otherwise(F.col("last_used")), "tier": F.when(hit & (F.col("tier") == "archive"), "cold").otherwise(F.col("tier"))}).drop("_b")


def tiers(skills: DataFrame, today: str) -> DataFrame:
    age = days_since(F.col("last_used"), today)
    return skills.select("id", "tier", age.alias("age"), tier_advice(F.col("tier"), age, F.col("hits")).alias("advice"))


def by_domain(skills: DataFrame) -> DataFrame:
    return skills.groupBy("domain").agg(F.count("*").alias("skills"), F.sum("hits").alias("hits"))


def index_lines(skills: DataFrame) -> DataFrame:
    """Rows of the index, domain by domain, most used first."""
    return skills.withColumn("n", F.row_number().over(W.partitionBy("domain").orderBy(F.desc("hits"), "id"))).select("domain", "n", F.concat(F.lit("- "), "id", F.lit(" ("), F.col("hits").cast("string"), F.lit(") "), "name").alias("line"))


def environment_fits(env: DataFrame, os: str, versions: dict[str, str]) -> DataFrame:
    """env (id, tool, lo, hi, os): constraints that hold here. Ranges are half-open; null bounds, unknown tools and a
    null os fit."""
    fits = F.col("os").isNull() | (F.col("os") == os)
    for tool, v in versions.items():
        here = version_key(F.lit(v))
        inside = F.coalesce(version_key(F.col("lo")) <= here, F.lit(True)) & F.coalesce(here < version_key(F.col("hi")), F.lit(True))
        fits = fits & F.when((F.col("tool") == tool), (F.col("lo").isNull() | (version_key(F.col("lo")) <= here)) & (F.col("hi").isNull() | (here < version_key(F.col("hi")))) & inside.isNotNull()).otherwise(True)
    return env.withColumn("fits", fits)


def overlapping(env: DataFrame) -> DataFrame:
    """Pairs of constraints on one tool whose version ranges overlap."""
    key = lambda c: F.when(F.col(c).isNotNull(), version_key(F.col(c)))
    a = env.select("tool", F.col("id").alias("a"), key("lo").alias("lo1"), key("hi").alias("hi1"))
    b = env.select("tool", F.col("id").alias("b"), key("lo").alias("lo2"), key("hi").alias("hi2"))
    return a.join(b, "tool").where(F.col("a") < F.col("b")).where(ranges_overlap(F.col("lo1"), F.col("hi1"), F.col("lo2"), F.col("hi2"))).select("tool", "a", "b")
