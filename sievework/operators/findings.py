"""Findings: roll-ups, fingerprints, snapshots, drift, evaluation against labels, budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.text import fingerprint


def merge(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("level", "rule_id").agg(F.count("*").alias("n"))


def level_totals(findings: DataFrame, key: list[str]) -> DataFrame:
    return findings.groupBy(*key).agg(*[F.count_if(F.col("level") == x).alias(x.lower()) for x in ("P0", "P1", "P2", "P3")], F.count("*").alias("total"))


def rollup(findings: DataFrame, key: list[str]) -> DataFrame:
    """Counts on every prefix of key; an extension of the reports by level."""
    return findings.rollup(*key).agg(F.count("*").alias("n"), F.grouping_id().alias("grouping"))


def dedup(findings: DataFrame, order: list[str]) -> DataFrame:
    """One finding for each fingerprint, the first in order."""
    df = findings.withColumn("fingerprint", fingerprint(F.col("path"), F.col("rule_id"), F.col("line_no"), F.col("snippet")))
    return df.withColumn("_n", F.row_number().over(W.partitionBy("fingerprint").orderBy(*order))).where("_n = 1").drop("_n")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "fingerprint") -> DataFrame:
    """key, status: added, gone or kept."""
    a = old.select(F.col(key).alias("_a")).distinct()
    b = new.select(F.col(key).alias("_b")).distinct()
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "gone").otherwise("kept")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), status.alias("status"))


def drift(left: DataFrame, right: DataFrame, key: str, values: list[str]) -> DataFrame:
    """key, status: only_left, only_right, changed or same, by null-safe comparison of values."""
    r = right.select(F.col(key).alias("_k"), F.lit(True).alias("_there"), *[F.col(v).alias(f"_{v}") for v in values])
    same = reduce(lambda a, b: a & b, [F.col(v).eqNullSafe(F.col(f"_{v}")) for v in values])
    both = left.withColumn("_here", F.lit(True)).join(r, F.col(key) == F.col("_k"), "full_outer")
    status = F.when(F.col("_there").isNull(), "only_left").when(F.col("_here").isNull(), "only_right").when(same, "same").otherwise("changed")
    return both.select(F.coalesce(key, "_k").alias(key), status.alias("status"))


def evaluate(samples: DataFrame, key: str = "rule_id") -> DataFrame:
    """samples (rule_id, kind tp or fp, hit, null where not measured) -> recall, precision: pass, fail or unverified.
    All samples of a kind must pass; no sample, or one not measured, is unverified."""
    tp, fp = F.col("kind") == "tp", F.col("kind") == "fp"

    def verdict(kind, good):
        n, known, ok = F.count_if(kind), F.count_if(kind & F.col("hit").isNotNull()), F.count_if(kind & good)
        return F.when((n == 0) | (known < n), "unverified").when(ok == n, "pass").otherwise("fail")

    return samples.groupBy(key).agg(verdict(tp, F.col("hit")).alias("recall"), verdict(fp, ~F.col("hit")).alias("precision"))


def confusion(predicted: DataFrame, key: list[str]) -> DataFrame:
    """predicted (key, hit, truth) -> tp, fp, fn, tn, precision, recall; ratios are null without cases."""
    hit, truth = F.col("hit"), F.col("truth")
    out = predicted.groupBy(*key).agg(F.count_if(hit & truth).alias("tp"), F.count_if(hit & ~truth).alias("fp"), F.count_if(~hit & truth).alias("fn"), F.count_if(~hit & ~truth).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    return out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def budget(costs: DataFrame, batch: str, order: str, cost: str, limit: float) -> DataFrame:
    """Rows in order up to and including the one whose running cost reaches the limit, for each batch."""
    run = F.sum(cost).over(W.partitionBy(batch).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return costs.withColumn("spent", run).where(F.col("spent") - F.col(cost) < limit)


def degenerate(df: DataFrame, columns: list[str], least: int = 5) -> DataFrame:
    """Columns that hold one distinct value in least rows or more."""
    counts = df.agg(F.count("*").alias("n"), *[F.countDistinct(c).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("values")) for c in columns]))
    return counts.select("n", rows.alias("r")).select("r.column", "r.values", "n").where((F.col("values") == 1) & (F.col("n") >= least))


def mutation_score(outcomes: DataFrame, key: list[str]) -> DataFrame:
    """killed, survived and others, and killed / (killed + survived); null without either."""
    n = lambda x: F.count_if(F.col("result") == x)
    out = outcomes.groupBy(*key).agg(n("KILLED").alias("killed"), n("SURVIVED").alias("survived"), F.count_if(~F.col("result").isin("KILLED", "SURVIVED")).alias("other"))
    return out.withColumn("score", F.when(F.col("killed") + F.col("survived") > 0, F.col("killed") / (F.col("killed") + F.col("survived"))))


def stale_mutations(mutations: DataFrame, files: DataFrame) -> DataFrame:
    """mutations (id, target, old) whose old fragment the target file no longer holds."""
    f = files.select(F.col("path").alias("target"), "text")
    return mutations.join(f, "target", "left").where(~F.coalesce(F.expr("contains(text, old)"), F.lit(False))).select("id", "target")
