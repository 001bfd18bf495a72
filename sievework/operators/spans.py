"""Method spans and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def brace_depth(ls: DataFrame, key: list[str], opened: str = r"\{", closed: str = r"\}") -> DataFrame:
    """Adds depth after each line: running sum of opening less closing marks."""
    step = F.regexp_count("line", F.lit(opened)) - F.regexp_count("line", F.lit(closed))
    return ls.withColumn("depth", F.sum(step).over(W.partitionBy(*key).orderBy("line_no")))


def brace_spans(ls: DataFrame, key: list[str], header: str = r"^\s*(?:[a-z]+ )*([A-Za-z_][A-Za-z0-9_]*)\s*\([^;]*\)[^;]*\{", cap: int | None = None) -> DataFrame:
    """key, name, s, e (0-based, half-open): from a header line up to the line where its depth comes back; with cap at
    most so many lines. An unclosed span ends with the file."""
    df = brace_depth(ls, key)
    before = F.coalesce(F.lag("depth").over(W.partitionBy(*key).orderBy("line_no")), F.lit(0))
    df = df.withColumn("before", before)
    heads = df.where(F.col("line").rlike(header)).select(*key, F.regexp_extract("line", header, 1).alias("name"), F.col("line_no").alias("hs"), F.col("before").alias("hd"))
    ends = df.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("line_no").alias("ln"), "depth")
    same = [F.col(k) == F.col(f"_{k}") for k in key]
    joined = heads.join(ends, [*same, F.col("ln") >= F.col("hs"), F.col("depth") <= F.col("hd"), *([F.col("ln") < F.col("hs") + cap] if cap else [])], "left")
    last = df.groupBy(*[F.col(k).alias(f"l_{k}") for k in key]).agg(F.max("line_no").alias("last"))
    spans = joined.groupBy(*key, "name", "hs").agg(F.min("ln").alias("ln"))
    spans = spans.join(last, [F.col(k) == F.col(f"l_{k}") for k in key])
    end = F.coalesce("ln", F.least(F.col("last"), F.col("hs") + cap - 1) if cap else F.col("last"))
    return spans.select(*key, "name", (F.col("hs") - 1).alias("s"), end.alias("e"))


def indent_spans(ls: DataFrame, key: list[str], header: str = r"^([ \t]*)func +([A-Za-z_][A-Za-z0-9_]*)") -> DataFrame:
    """Spans of languages with significant indentation: up to the next line that isn't blank and is indented no more
    than the header."""
    width = F.length(F.regexp_extract("line", r"^([ \t]*)", 1))
    df = ls.withColumn("width", width)
    heads = df.where(F.col("line").rlike(header)).select(*key, F.regexp_extract("line", header, 2).alias("name"), F.col("line_no").alias("hs"), F.col("width").alias("hw"))
    tails = df.where(F.trim("line") != "").select(*[F.col(k).alias(f"_{k}") for k in key], F.col("line_no").alias("ln"), "width")
    cond = [*[F.col(k) == F.col(f"_{k}") for k in key], F.col("ln") > F.col("hs"), F.col("width") <= F.col("hw")]
    last = df.groupBy(*[F.col(k).alias(f"l_{k}") for k in key]).agg(F.max("line_no").alias("last"))
    spans = heads.join(tails, cond, "left").groupBy(*key, "name", "hs").agg(F.min("ln").alias("ln"))
    return spans.join(last, [F.col(k) == F.col(f"l_{k}") for k in key]).select(*key, "name", (F.col("hs") - 1).alias("s"), F.coalesce(F.col("ln") - 1, F.col("last")).alias("e"))


def in_spans(points: DataFrame, spans: DataFrame, key: list[str], at: str = "line_no", first: bool = True) -> DataFrame:
    """Points with the span that holds them (s < at <= e); with first the innermost one alone."""
    right = spans.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("name").alias("span"), "s", "e")
    out = points.join(right, [*[F.col(k) == F.col(f"_{k}") for k in key], F.col(at) > F.col("s"), F.col(at) <= F.col("e")]).drop(*[f"_{k}" for k in key])
    if not first:
        return out
    w = W.partitionBy(*key, at).orderBy(F.desc("s"), "e", "span")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def once_per_span(hits: DataFrame, key: list[str]) -> DataFrame:
    """First hit of each rule in each span."""
    w = W.partitionBy(*key, "span", "s", "rule_id").orderBy("line_no")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def unpaired(registered: DataFrame, cleaned: DataFrame, key: list[str]) -> DataFrame:
    """Registrations without a clean-up of the same key in the spans that should hold it."""
    return registered.join(cleaned.select(*key).distinct(), key, "left_anti")


def later_hit(first: DataFrame, then: DataFrame, key: list[str], at: str = "line_no") -> DataFrame:
    """Rows of first with a row of then further down in the same file (a semi join by inequality on the last one)."""
    last = then.groupBy(*key).agg(F.max(at).alias("_last"))
    return first.join(last, key).where(F.col(at) < F.col("_last")).drop("_last")
