"""Sinks: findings, SARIF, reports, per-scene text, state, append-if-absent, monthly archives."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import fingerprint, severity


def write_findings(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


def sarif(findings: DataFrame, tool: str = "sievework", root: str | None = None) -> DataFrame:
    """One row per tool run with the SARIF 2.1.0 document as text. Results are put together by rule first, so that no
    task holds more than the document itself needs."""
    keyed = findings.withColumn("print", fingerprint(F.col("path"), F.col("rule_id"), F.col("line_no"), F.col("snippet")))
    keyed = keyed.groupBy("print").agg(*[F.min_by(c, F.struct("path", "line_no", "rule_id")).alias(c) for c in ("rule_id", "level", "path", "line_no", "snippet")])
    place = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line_no", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation")))
    result = F.struct("rule_id", "path", "line_no", F.struct(F.col("rule_id").alias("ruleId"), severity(F.col("level")).alias("level"), F.struct(F.substring(F.coalesce("snippet", F.lit("")), 1, 200).alias("text")).alias("message"), place.alias("locations"), F.struct(F.col("print").alias("primary/v1")).alias("fingerprints")).alias("r"))
    by_rule = keyed.groupBy("rule_id").agg(F.array_sort(F.collect_list(result)).alias("results"), F.min("level").alias("level"))
    rule = F.struct(F.col("rule_id").alias("id"), F.struct(severity(F.col("level")).alias("level")).alias("defaultConfiguration"))
    whole = by_rule.agg(F.array_sort(F.collect_list(rule)).alias("rules"), F.transform(F.array_sort(F.flatten(F.collect_list("results"))), lambda x: x["r"]).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"))
    return whole.select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))


def write_sarif(findings: DataFrame, path: str) -> None:
    sarif(findings).write.mode("overwrite").text(path)


def report(findings: DataFrame) -> DataFrame:
    """Text lines grouped by level and rule: a heading line with the count, then the places."""
    head = findings.groupBy("level", "rule_id").agg(F.count("*").alias("n")).select("level", "rule_id", F.lit("").alias("path"), F.lit(0).alias("line_no"), F.concat(F.lit("["), "level", F.lit("] "), "rule_id", F.lit(": "), "n").alias("text"))
    body = findings.select("level", "rule_id", "path", "line_no", F.concat(F.lit("  "), "path", F.lit(":"), "line_no", F.lit("  "), "snippet").alias("text"))
    return head.union(body).orderBy("level", "rule_id", "path", "line_no").select("text")


def write_by_scene(criteria: DataFrame, path: str) -> None:
    """Text of each scene in a folder of its own; needs columns scene and text."""
    criteria.repartition("scene").write.mode("overwrite").partitionBy("scene").text(path)


def append_absent(spark: SparkSession, new: DataFrame, path: str, key: list[str]) -> int:
    """Appends the rows whose key is not in the table at path yet; returns how many."""
    try:
        old = spark.read.parquet(path)
        new = new.join(old.select(*key).distinct(), key, "left_anti")
    except Exception as e:  # only a table that isn't there yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    new = new.dropDuplicates(key).cache()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def save_state(state: DataFrame, path: str, version: int) -> None:
    """Checkpoint state as a versioned snapshot; the latest version is the state."""
    state.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/version={version:08d}")


def load_state(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("basePath", path).parquet(path)
    latest = df.agg(F.max("version")).first()[0]
    return df.where(F.col("version") == latest)


def archive(entries: DataFrame, path: str, day: str = "day") -> int:
    """Moves entries to monthly folders and checks that none is lost, of these or of those there before; returns their
    number. Entries are only gone from where they came from once this returns, so a loss raises an error."""
    spark = entries.sparkSession

    def held() -> int:
        try:
            return spark.read.parquet(path).count()
        except AnalysisException as e:  # nothing archived yet
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return 0

    before, n = held(), entries.count()
    entries.withColumn("month", F.date_format(day, "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)
    if (after := held()) != before + n:
        raise RuntimeError(f"archive holds {after} entries, {before} were there and {n} were written")
    return n


def propose(current: DataFrame, wanted: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Plan (key, action, old, new) that turns one table into the other: add, drop, change; equal rows need nothing."""
    as_text = F.to_json(F.struct(*values))
    old = current.select(F.col(key).alias("_k"), as_text.alias("old"))
    new = wanted.select(F.col(key).alias("_n"), as_text.alias("new"))
    both = old.join(new, F.col("_k") == F.col("_n"), "full").where("not (old <=> new)")
    action = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "drop").otherwise("change")
    return both.select(F.coalesce("_k", "_n").alias(key), action.alias("action"), "old", "new")


def apply_plan(current: DataFrame, plan: DataFrame, path: str, version: int, key: str, values: list[str]) -> None:
    """Writes the table after a plan as a new version and the plan beside it as its log; versions before stay as backup."""
    kept = current.join(plan.select(F.col(key).alias("_p")), F.col(key) == F.col("_p"), "left_anti").select(key, *values)
    shape = ", ".join(f"`{c}` {current.schema[c].dataType.simpleString()}" for c in values)
    new = plan.where("new is not null").select(key, F.from_json("new", shape).alias("v")).select(key, "v.*")
    save_state(kept.unionByName(new), path, version)
    plan.write.mode("overwrite").parquet(f"{path}_log/version={version:08d}")


def undo(spark: SparkSession, path: str, version: int, to: int) -> None:
    """Makes an earlier version the latest again, as a new version."""
    save_state(spark.read.parquet(f"{path}/version={to:08d}"), path, version)
