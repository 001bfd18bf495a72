"""Routing: signals to evidence, scores, ranks and batches; domains by keywords; coverage."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.text import glob_regex, let, scene_score, word_pattern


@dataclass(frozen=True)
class Signal:
    """kind: dir, file (glob of the path), ext, or rx (pattern in the text)."""

    scene: str
    kind: str
    pattern: str
    label: str
    strong: bool = False


SIGNALS = [
    Signal("s-boundary", "rx", "0\\.0\\.0\\.0|addEventListener|postMessage", "network or message boundary", True),
    Signal("s-sandbox", "rx", "(exec|spawn|eval|system)\\(", "runs commands", True),
    Signal("s-state", "rx", "localStorage|sessionStorage", "keeps state"),
    Signal("s-numerics", "rx", "Math\\.|>>> *0|parseFloat", "numeric code"),
    Signal("s-concurrency", "rx", "\\.lock\\(|Mutex|go func|threading", "concurrent code", True),
    Signal("s-build", "file", "**/package.json", "node package", True),
    Signal("s-architecture", "dir", "src/**", "sources in src"),
    Signal("p-python", "ext", "py", "python files", True),
    Signal("p-rust", "ext", "rs", "rust files", True),
    Signal("p-go", "ext", "go", "go files", True),
    Signal("p-java", "ext", "java", "java files", True),
    Signal("p-cpp", "ext", "cpp", "c++ files", True),
    Signal("p-godot", "ext", "gd", "godot scripts", True),
]


def fires(s: Signal, path: Column, text: Column) -> Column:
    if s.kind == "rx":
        return text.rlike(s.pattern)
    if s.kind == "ext":
        return path.endswith(f".{s.pattern}")
    return path.rlike(glob_regex(s.pattern))


def evidence(files: DataFrame, signals: list[Signal], path: str = "path", text: str = "text") -> DataFrame:
    """scene, kind, label, strong, n: files in which each signal fires. Files are read once for all signals."""
    hit = F.array_compact(F.array(*[F.when(fires(s, F.col(path), F.col(text)), F.struct(F.lit(s.scene).alias("scene"), F.lit(s.kind).alias("kind"), F.lit(s.label).alias("label"), F.lit(s.strong).alias("strong"))) for s in signals]))
    return files.select(F.explode(hit).alias("h")).groupBy("h.scene", "h.kind", "h.label", "h.strong").agg(F.count("*").alias("n"))


def rank_scenes(found: DataFrame) -> DataFrame:
    """scene, score, rank: 1000 for a strong label, 100 for a weak one, 30 for each kind, and a damped file count."""
    sums = found.groupBy("scene").agg(F.count_if("strong").alias("strong"), F.count_if(~F.col("strong")).alias("weak"), F.countDistinct("kind").alias("kinds"), F.sum("n").alias("files"))
    scored = sums.withColumn("score", scene_score(F.col("strong"), F.col("weak"), F.col("kinds"), F.col("files")))
    return scored.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "scene")))


def batches(df: DataFrame, order: list[str], size: int = 4, partition: str | None = None) -> DataFrame:
    """Adds batch: rows in order, size at a time; nothing is cut off."""
    w = (W.partitionBy(partition) if partition else W.partitionBy()).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def keyword_scores(texts: DataFrame, key: str, text: str, domains: dict[str, list[str]], generic: tuple[str, ...] = ()) -> DataFrame:
    """key, domain, score: total length of a domain's keywords in the text, generic ones left out."""

    def total(words: list[str], low: Column) -> Column:
        out = F.lit(0)
        for w in words:
            if w not in generic:
                if not w.isascii():
                    hit = low.contains(w)
                elif re.fullmatch(r"\w+", w):  # the cheap look first: most words are in few texts
                    hit = low.contains(w) & low.rlike(word_pattern(w))
                else:
                    hit = low.rlike(f"(^|[^a-z0-9_]){w}([^a-z0-9_]|$)")
                out = out + F.when(hit, len(w)).otherwise(0)
        return out

    rows = let(F.lower(F.col(text)), lambda x: F.array(*[F.struct(F.lit(d).alias("domain"), total(ws, x).alias("score")) for d, ws in sorted(domains.items())]))
    return texts.select(key, F.explode(F.filter(rows, lambda r: r.score > 0)).alias("r")).select(key, "r.domain", "r.score")


def keyword_counts(texts: DataFrame, key: str, text: str, domains: dict[str, list[str]]) -> DataFrame:
    """key, domain, hits: how many of a domain's keywords the text holds."""
    low = F.lower(F.col(text))
    counted = [F.struct(F.lit(d).alias("domain"), sum((F.when(low.contains(w), 1).otherwise(0) for w in ws), F.lit(0)).alias("hits")) for d, ws in sorted(domains.items())]
    return texts.select(key, F.explode(F.array(*counted)).alias("r")).select(key, "r.domain", "r.hits").where("hits > 0")


def route(scores: DataFrame, key: str, all_keys: DataFrame, core: int = 8) -> DataFrame:
    """Best domain of each key with its outcome: no_match, ambiguous (a tie), core_hit, or weak_match."""
    w = W.partitionBy(key).orderBy(F.desc("score"), "domain")
    top = scores.withColumns({"n": F.row_number().over(w), "second": F.lead("score").over(w)}).where("n = 1").select(F.col(key).alias("_k"), "domain", "score", "second")
    outcome = F.when(F.col("score").isNull(), "no_match").when(F.col("score") == F.col("second"), "ambiguous").when(F.col("score") >= core, "core_hit").otherwise("weak_match")
    return all_keys.join(top, F.col(key) == F.col("_k"), "left").select(key, "domain", F.coalesce("score", F.lit(0)).alias("score"), outcome.alias("outcome"))


def coverage(df: DataFrame, concept: str, core: str, head: str, n: str, suspect: int = 3) -> DataFrame:
    """tier of each concept: covered (core and in a heading), suspect (often, no heading), mention, or blank."""
    tier = F.when(F.col(core) & F.col(head), "covered").when(F.col(n) >= suspect, "suspect").when(F.col(n) > 0, "mention").otherwise("blank")
    return df.select(concept, n, tier.alias("tier"))
