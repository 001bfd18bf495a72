"""Registry of rules and criteria: mapping cascade, gaps, look-ups, expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.text import jaccard, name_tokens, norm_id, occurrences

#: Fixed limits of the mapping.
ACCEPT, REVIEW, MARGIN, POINTER_TOKENS, XREFS = 0.50, 0.32, 0.08, 60, 3


def best_two(scored: DataFrame, key: str, value: str, score: str) -> DataFrame:
    """Best value of each key with its lead over the second best."""
    w = W.partitionBy(key).orderBy(F.desc(score), value)
    df = scored.withColumns({"_n": F.row_number().over(w), "_next": F.lead(score).over(w)}).where("_n = 1")
    return df.select(key, value, score, (F.col(score) - F.coalesce("_next", F.lit(0.0))).alias("margin"))


def rarest(sets: DataFrame, key: str, tokens: str, df: DataFrame, least: float) -> DataFrame:
    """key, t: the rarest tokens of each set, so many that a set with a Jaccard index of least or more to it shares one
    of them. df (t, df) holds each token's frequency; equally frequent ones are taken in the order of their text."""
    one = sets.select(key, F.explode(tokens).alias("t"), F.size(tokens).alias("n")).join(df, "t", "left")
    kept = F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)) + 1
    rank = F.row_number().over(W.partitionBy(key).orderBy("df", "t"))
    return one.withColumn("_r", rank).where(F.col("_r") <= kept).select(key, "t")


def name_candidates(rules: DataFrame, items: DataFrame, least: float = 0.0) -> DataFrame:
    """rule_id, item, score by the Jaccard index of name tokens, of at least least, for (rule_id, tokens), (id, tokens).
    With least above 0 pairs meet on the rarest tokens of either side alone, which any such pair shares, and are then
    compared; at 0 every shared token counts."""
    i = items.select(F.col("id").alias("item"), F.col("tokens").alias("itokens"))
    if least > 0:
        every = rules.select(F.explode("tokens").alias("t")).union(i.select(F.explode("itokens").alias("t")))
        df = every.groupBy("t").agg(F.count("*").alias("df"))
        met = rarest(rules, "rule_id", "tokens", df, least).join(rarest(i, "item", "itokens", df, least), "t").select("rule_id", "item").distinct()
        both = met.join(rules.select("rule_id", "tokens"), "rule_id").join(i, "item")
        return both.select("rule_id", "item", jaccard(F.col("tokens"), F.col("itokens")).alias("score")).where(F.col("score") >= least)
    r = rules.select("rule_id", F.explode("tokens").alias("t"), F.size("tokens").alias("a"))
    i = i.select("item", F.explode("itokens").alias("t"), F.size("itokens").alias("b"))
    both = r.join(i, "t").groupBy("rule_id", "item", "a", "b").agg(F.count("*").alias("c"))
    return both.select("rule_id", "item", (F.col("c") / (F.col("a") + F.col("b") - F.col("c"))).alias("score"))


def map_candidates(rules: DataFrame, items: DataFrame) -> DataFrame:
    """rules (rule_id, title, and scene or not), items (id, name, and keywords, scene, body or not) -> rule_id, item,
    score: the Jaccard index of name tokens, 0.07 for each keyword in the title up to 0.20, 0.08 for the same scene,
    0.15 times the share of title tokens found in the body; 1 at most. Pairs share a token or a keyword; all others
    stay below REVIEW. Letters are compared folded, as in name_tokens."""
    has = set(items.columns)
    tokens = name_tokens(F.col("title"))
    plain = not has & {"keywords", "body"} and not ("scene" in has and "scene" in rules.columns)
    pairs = name_candidates(rules.select("rule_id", tokens.alias("tokens")), items.select("id", name_tokens(F.col("name")).alias("tokens")), REVIEW if plain else 0.0)
    if plain:  # what is below REVIEW is never proposed, and too far from an accepted one to make it doubtful
        return pairs
    if "keywords" in has:
        words = items.select(F.col("id").alias("item"), F.explode("keywords").alias("k")).where("k <> ''")
        hits = rules.join(words, F.lower("title").contains(F.lower("k"))).groupBy("rule_id", "item").agg(F.count("*").alias("hits"))
        pairs = pairs.join(hits, ["rule_id", "item"], "full")
    else:
        pairs = pairs.withColumn("hits", F.lit(0))
    r = rules.select("rule_id", F.filter(tokens, lambda w: F.length(w) >= 2).alias("core"), (F.col("scene") if "scene" in rules.columns else F.lit(None)).alias("r_scene"))
    i = items.select(F.col("id").alias("item"), (F.lower("body") if "body" in has else F.lit("")).alias("body"), (F.col("scene") if "scene" in has else F.lit(None)).alias("i_scene"))
    both = pairs.join(r, "rule_id").join(i, "item")
    inside = F.size(F.filter("core", lambda w: F.coalesce(F.col("body"), F.lit("")).contains(w)))
    score = F.coalesce("score", F.lit(0.0)) + F.least(F.lit(0.20), F.coalesce("hits", F.lit(0)) * F.lit(0.07))
    score += F.when((F.col("r_scene") != "") & (F.col("r_scene") == F.col("i_scene")), 0.08).otherwise(0.0)
    score += F.when(F.size("core") > 0, inside / F.size("core") * F.lit(0.15)).otherwise(0.0)
    return both.select("rule_id", "item", F.least(F.lit(1.0), score).alias("score"))


def map_rules(rules: DataFrame, items: DataFrame, known: DataFrame, manual: DataFrame) -> DataFrame:
    """rules (rule_id, title), items (id, name), known (rule_id, item), manual (rule_id, item or null) -> rule_id, item,
    how. In this order: an item with the rule's own id, a known pair, a manual one, a manual none, the best score
    (map_candidates) at or above ACCEPT; from REVIEW on it is proposed; else it is open."""
    own = items.select(F.col("id").alias("own"))
    k = known.select(F.col("rule_id").alias("k_rule"), F.col("item").alias("k_item"))
    m = manual.select(F.col("rule_id").alias("m_rule"), F.col("item").alias("m_item"))
    df = rules.join(own, F.col("rule_id") == F.col("own"), "left").join(k, F.col("rule_id") == F.col("k_rule"), "left").join(m, F.col("rule_id") == F.col("m_rule"), "left")
    left = df.where("own is null and k_item is null and m_rule is null").select(*rules.columns)
    said = F.struct(*[c for c in ("title", "scene") if c in rules.columns])  # all that a score knows of a rule, so equal ones are scored once
    one = left.select(said.alias("rule_id")).distinct().select("rule_id", "rule_id.*")
    best = best_two(map_candidates(one, items), "rule_id", "item", "score")
    best = best.select(F.col("rule_id").alias("b_said"), F.col("item").alias("b_item"), "score", "margin")
    df = df.withColumn("_said", said).join(best, F.col("_said") == F.col("b_said"), "left")
    how = (
        F.when(F.col("own").isNotNull(), "id").when(F.col("k_item").isNotNull(), "known").when(F.col("m_item").isNotNull(), "manual").when(F.col("m_rule").isNotNull(), "manual_none")
        .when(F.col("score") >= ACCEPT, F.when(F.col("margin") < MARGIN, "name_low_margin").otherwise("name")).when(F.col("score") >= REVIEW, "review").otherwise("open")
    )
    item = F.coalesce("own", "k_item", "m_item", F.when(F.col("m_rule").isNull() & (F.col("score") >= REVIEW), F.col("b_item")))
    return df.select("rule_id", item.alias("item"), how.alias("how"))


def match_findings(findings: DataFrame, items: DataFrame, mapping: DataFrame, same: float = 0.20, any_: float = 0.45) -> DataFrame:
    """findings (rule_id, name) -> item: by mapping, else the item with the same normalised id and a similar name, else
    the most similar name."""
    f = findings.select("rule_id", "name").distinct().join(mapping.select(F.col("rule_id").alias("_r"), F.col("item").alias("mapped")), F.col("rule_id") == F.col("_r"), "left")
    it = items.select("id", F.col("name").alias("iname"), norm_id(F.col("id")).alias("nid"))
    by_id = f.join(it, norm_id(F.col("rule_id")) == F.col("nid"), "left").withColumn("sim", jaccard(name_tokens(F.col("name")), name_tokens(F.col("iname"))))
    by_id = by_id.groupBy("rule_id", "name").agg(F.first("mapped").alias("mapped"), F.max_by(F.when(F.col("sim") >= same, F.col("id")), F.coalesce("sim", F.lit(0.0))).alias("near"))
    cand = name_candidates(f.select("rule_id", name_tokens(F.col("name")).alias("tokens")), items.select("id", name_tokens(F.col("name")).alias("tokens")), any_)
    best = best_two(cand.where(F.col("score") >= any_), "rule_id", "item", "score").select(F.col("rule_id").alias("_b"), F.col("item").alias("best"))
    return by_id.join(best, F.col("rule_id") == F.col("_b"), "left").select("rule_id", "name", F.coalesce("mapped", "near", "best").alias("item"))


def gaps(items: DataFrame, mapping: DataFrame, classes: DataFrame) -> DataFrame:
    """Items that no rule covers, with their class (to do unless said otherwise)."""
    open_ = items.join(mapping.where("item is not null").select(F.col("item").alias("_i")).distinct(), F.col("id") == F.col("_i"), "left_anti")
    return open_.join(classes.select(F.col("item_id").alias("_c"), "machine"), F.col("id") == F.col("_c"), "left").select("id", F.coalesce("machine", F.lit("todo")).alias("machine"))


def query(items: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Items by 3 for a name that holds text and one for each occurrence in name and body."""
    q = text.lower()
    name, body = F.lower(F.col("name")), F.lower(F.coalesce("body", F.lit("")))
    score = F.when(name.contains(q), 3).otherwise(0) + occurrences(F.concat_ws(" ", name, body), q)
    out = items.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "id")
    return out.limit(limit) if limit else out


def expand_xrefs(chosen: DataFrame, items: DataFrame, most: int = XREFS, pointer: int = POINTER_TOKENS, level: str | None = "P0") -> DataFrame:
    """Targets one reference away from chosen items that are mere pointers, the first most of each; of level alone."""
    refs = chosen.where(F.col("tokens") < pointer).select(F.col("id").alias("source"), F.posexplode("xrefs").alias("pos", "target"))
    to = items.select(F.col("id").alias("target"), F.col("level").alias("tlevel"))
    hit = refs.join(to, "target").where((F.col("tlevel") == level) if level else F.lit(True))
    return hit.withColumn("n", F.row_number().over(W.partitionBy("source").orderBy("pos"))).where(F.col("n") <= most).select("source", "target", "n")


def needed_sections(items: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections of the items' scenes that are required, about false positives, or refer to a chosen item."""
    ids = items.groupBy(F.col("scene").alias("_s")).agg(F.collect_set("id").alias("ids"))
    return sections.join(ids, F.col("scene") == F.col("_s")).where(F.col("is_fp") | F.col("is_required") | F.arrays_overlap("refs", "ids")).drop("_s", "ids")


def item_stats(items: DataFrame) -> DataFrame:
    return items.groupBy("scene", "level").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.expr("sum(tokens) div count(*)").alias("mean_tokens"))


def with_cwe(rules: DataFrame, groups: DataFrame, overrides: DataFrame) -> DataFrame:
    """cwe of each rule: its override if there is one, an empty list included, else its group's; null if neither."""
    o = overrides.select(F.col("rule_id").alias("_o"), F.col("cwe").alias("_own"))
    g = groups.select(F.col("family").alias("_g"), F.col("cwe").alias("_group"))
    df = rules.join(o, F.col("rule_id") == F.col("_o"), "left").join(g, F.col("family") == F.col("_g"), "left")
    return df.withColumn("cwe", F.when(F.col("_o").isNotNull(), F.col("_own")).otherwise(F.col("_group"))).drop("_o", "_own", "_g", "_group")
