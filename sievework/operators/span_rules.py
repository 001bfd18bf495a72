"""Rules that need method spans: banned calls inside frame callbacks, acquisitions without a clean-up, long bodies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import snippet
from sievework.operators import spans

#: Fixed table: rule, level, pattern of the span's name, pattern of the banned line.
BANNED = [
    ("GD107", "P1", r"^_(physics_)?process$", r"print\("),
    ("GD11", "P1", r"^_(physics_)?process$", r"get_node\(|\$[A-Z]"),
    ("GD12", "P1", r"^_(physics_)?process$", r"\.instantiate\(\)"),
    ("GD13", "P2", r"^_(physics_)?process$", r"\.text *="),
    ("GD91", "P0", r"^_(physics_)?process$", r"[^a-z]load\("),
    ("GD92", "P1", r"^_(physics_)?process$", r"\"[^\"]*\" *[+%]"),
    ("GD96", "P0", r"^_physics_process$", r"await "),
    ("GD14", "P1", r"^_process$", r"move_and_slide\(|apply_(force|impulse)\("),
    ("CC-16", "P1", r"^update$", r"(find|getComponent|instantiate)\("),
    ("TS-Y01", "P1", r"^(update|tick|onFrame)$", r"(querySelector|getElementById|find)\("),
    ("TS-Y02", "P1", r"^(update|tick|onFrame)$", r"new [A-Z]|\[\]|\{ *\}"),
]
#: Fixed table: rule, level, acquiring line, clean-up span, releasing line.
PAIRED = [
    ("GD15", "P1", r"\.connect\(", r"^_exit_tree$", r"\.disconnect\("),
    ("CC-11", "P0", r"\.on\(", r"^(onDestroy|onDisable)$", r"\.off\("),
    ("CC-12", "P0", r"resources\.load\(", r"^(onDestroy|onDisable)$", r"\.(release|decRef)\("),
    ("CC-13", "P0", r"repeatForever\(", r"^(onDestroy|onDisable)$", r"\.stop"),
]
LONG = 80


def scan_spans(ls: DataFrame, sp: DataFrame, key: list[str]) -> DataFrame:
    """Findings of banned lines, once for each rule and span. Lines meet spans once for all rules."""
    inside = spans.in_spans(ls, sp, key)
    hit = F.explode(F.array_compact(F.array(*[F.when(F.col("span").rlike(n) & F.col("line").rlike(p), F.struct(F.lit(r).alias("rule_id"), F.lit(lv).alias("level"))) for r, lv, n, p in BANNED])))
    found = inside.select(*key, "line_no", "line", "span", "s", hit.alias("r")).select(*key, "line_no", "line", "span", "s", "r.rule_id", "r.level")
    return spans.once_per_span(found, key).select("rule_id", "level", *key, "line_no", snippet(F.col("line")).alias("snippet"))


def scan_pairs(ls: DataFrame, sp: DataFrame, key: list[str]) -> DataFrame:
    """First acquisition of each file whose clean-up spans hold no release."""
    inside = spans.in_spans(ls, sp, key, first=False)

    def one(rule, level, take, name, give) -> DataFrame:
        took = ls.where(F.col("line").rlike(take)).groupBy(*key).agg(F.min("line_no").alias("line_no"), F.min_by("line", "line_no").alias("line"))
        gave = inside.where(F.col("span").rlike(name) & F.col("line").rlike(give)).select(*key)
        return spans.unpaired(took, gave, key).select(F.lit(rule).alias("rule_id"), F.lit(level).alias("level"), *key, "line_no", snippet(F.col("line")).alias("snippet"))

    return reduce(DataFrame.unionByName, [one(*p) for p in PAIRED])


def long_spans(sp: DataFrame, key: list[str], most: int = LONG) -> DataFrame:
    return sp.where(F.col("e") - F.col("s") > most).select(F.lit("GD99").alias("rule_id"), F.lit("P2").alias("level"), *key, (F.col("s") + 1).alias("line_no"), F.col("name").alias("snippet"))
