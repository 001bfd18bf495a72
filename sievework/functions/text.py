"""Scalar text functions as column expressions. All stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "[\u4e00-\u9fff]"
#: Severity of each level, and words that say nothing about a topic.
SEVERITY = {"P0": "error", "P1": "warning", "P2": "note", "P3": "note"}
STOP_WORDS = ("the", "and", "for", "with", "that", "this", "from", "are", "was", "not", "but", "you", "all", "can", "has", "have", "when", "use")
NUMERALS = "一二三四五六七八九十"


def let(value: Column, use) -> Column:
    """use(value) with value worked out once. An expression that a lambda only mentions is worked out anew for each element
    that the lambda gets; its arguments aren't."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_pattern(word: str) -> str:
    """A word between word boundaries in folded text. The word comes first, so that a place without it costs one look."""
    w = re.escape(word)
    return f"{w}(?<![a-z0-9_]{w})(?![a-z0-9_])"


def cjk_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(CJK))


def token_estimate(c: Column) -> Column:
    """1.5 for each CJK character, a quarter for each other one, truncated."""
    return (cjk_count(c) * 1.5 + (F.length(c) - cjk_count(c)) / 4).cast("int")


def token_runs(c: Column) -> Column:
    """CJK characters, runs of word characters, and other visible characters one by one."""
    return cjk_count(c) + F.regexp_count(c, F.lit("[A-Za-z0-9_]+")) + F.regexp_count(c, F.lit("[^A-Za-z0-9_ \\t\\n\\r\u4e00-\u9fff]"))


def snippet(c: Column, n: int = 120) -> Column:
    return F.substring(F.trim(c), 1, n)


def occurrences(c: Column, part: str) -> Column:
    """How often part occurs, without overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def norm_id(c: Column) -> Column:
    """TS-C1, C-1 and C1 are C01."""
    letter, digits = (F.regexp_extract(F.upper(c), r"^(?:[A-Z]+-)?([A-Z])-?([0-9]+)$", k) for k in (1, 2))
    return F.when(letter != "", F.concat(letter, F.lpad(digits, 2, "0"))).otherwise(F.upper(c))


def unified_id(rule: Column, scanner: Column, known=("TS-", "APP-", "PY-", "RS-", "GO-", "JV-", "CPP-", "CC-", "GD")) -> Column:
    """The rule id with the prefix of its scanner, unless it has one."""
    has = F.lit(False)
    for p in known:
        has = has | rule.startswith(p)
    return F.when(has, rule).when(scanner == "scan-ts", F.concat(F.lit("TS-"), rule)).when(scanner == "scan-app", F.concat(F.lit("APP-"), rule)).otherwise(rule)


def severity(level: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[level], F.lit("note"))


def level_of(sev: Column) -> Column:
    """The way back; notes come back as P2."""
    return F.when(sev == "error", "P0").when(sev == "warning", "P1").otherwise("P2")


def fingerprint(path: Column, rule: Column, line_no: Column | None, text: Column) -> Column:
    """16 hex digits over path, rule, line and the first 120 characters of the snippet. Null parts count as empty;
    with line_no None the fingerprint survives moved lines."""
    parts = [path, rule, *([line_no] if line_no is not None else []), F.substring(F.coalesce(text, F.lit("")), 1, 120)]
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 16)


def rule_signature(native: Column, level: Column, title: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (native, level, title)])), 1, 8)


def ascii_tokens(c: Column, least: int = 1) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"[a-z0-9_]{{{least},}}"), F.lit(0))


def cjk_grams(c: Column, n: int = 2) -> Column:
    """n-grams inside runs of CJK characters; a shorter run stands for itself. Found by looking ahead from each character, so
    that a long run costs its length."""
    short = rf"|(?<!{CJK}){CJK}{{1,{n - 1}}}(?!{CJK})" if n > 1 else ""
    return F.regexp_extract_all(c, F.lit(rf"(?=({CJK}{{{n}}}{short}))"), F.lit(1))


def bigram_features(c: Column) -> Column:
    """Distinct ASCII tokens without stop words, and CJK bigrams."""
    return F.array_distinct(F.concat(F.array_except(ascii_tokens(c), F.array(*map(F.lit, STOP_WORDS))), cjk_grams(c)))


def name_tokens(c: Column) -> Column:
    """CJK characters and ASCII tokens of two or more."""
    return F.array_distinct(F.concat(F.regexp_extract_all(c, F.lit(CJK), F.lit(0)), ascii_tokens(c, 2)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def related_score(a: Column, b: Column, least: int = 2) -> Column:
    """The Jaccard index of two sets that share least members or more, else 0."""
    return F.when(F.size(F.array_intersect(a, b)) < least, 0.0).otherwise(jaccard(a, b))


def similarity_of_counts(shared: Column, a: Column, b: Column, least: int = 5) -> Column:
    """0.65 of the overlap coefficient and 0.35 of the Jaccard index; 0 below least shared features."""
    return F.when(shared < least, 0.0).otherwise(0.65 * shared / F.least(a, b) + 0.35 * shared / (a + b - shared))


def scene_score(strong: Column, weak: Column, kinds: Column, files: Column) -> Column:
    return strong * 1000 + weak * 100 + kinds * 30 + F.floor(10 * F.sqrt(1 + files / 100)).cast("long")


def version_key(c: Column) -> Column:
    """Three numbers that compare in order; missing ones are 0."""
    part = lambda k: F.coalesce(F.get(F.split(c, r"\."), F.lit(k)).try_cast("int"), F.lit(0))
    return F.array(part(0), part(1), part(2))


def ranges_overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Half-open version ranges; a null bound is open."""
    return F.coalesce(lo1 < hi2, F.lit(True)) & F.coalesce(lo2 < hi1, F.lit(True))


def days_since(day: Column, today: str) -> Column:
    """Age in days; 9999 where the day is unknown."""
    return F.coalesce(F.datediff(F.lit(today).cast("date"), day.try_cast("date")), F.lit(9999))


def tier_advice(tier: Column, age: Column, hits: Column) -> Column:
    return F.when(age >= 90, "archive").when((tier == "hot") & (age >= 30), "cold").when(hits >= 10, "hot").otherwise(tier)


def relative_path(path: Column, root: str) -> Column:
    """Absolute paths below root made relative, leading ./ and ../ dropped."""
    root = root.rstrip("/") + "/"
    inside = F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)
    return F.regexp_replace(inside, r"^(\.{1,2}/)+", "")


def posix_normal(path: Column) -> Column:
    """Drops . and resolves .. segments; leading .. that lead out stay."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    start = F.array().cast("array<string>")
    merge = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, start, merge), "/")


def module_of(path: Column) -> Column:
    """First segment below the root, or (root)."""
    return F.when(path.contains("/"), F.split_part(path, F.lit("/"), F.lit(1))).otherwise("(root)")


def glob_regex(glob: str) -> str:
    """** is any path, * any part of a segment, ? one character."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return f"^{out}$"


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """Keywords that occur: ASCII ones between word boundaries, others anywhere; those inside a longer hit go."""
    one = lambda low, k: low.contains(k.lower()) & low.rlike(word_pattern(k.lower())) if k.isascii() else low.contains(k)
    hits = let(F.lower(text), lambda low: F.array_compact(F.array(*[F.when(one(low, k), F.lit(k)) for k in keywords])))
    return let(hits, lambda found: F.filter(found, lambda h: ~F.exists(found, lambda o: (F.length(o) > F.length(h)) & o.contains(h))))


def numeral(c: Column) -> Column:
    """CJK numerals from one to ninety-nine as integers; null for others."""
    digit = lambda x: F.when(x == "", 1).otherwise(F.instr(F.lit(NUMERALS), x))
    tens = F.regexp_extract(c, "^([一二三四五六七八九]?)十([一二三四五六七八九]?)$", 1)
    ones = F.regexp_extract(c, "^([一二三四五六七八九]?)十([一二三四五六七八九]?)$", 2)
    return F.when(c.rlike("^[一二三四五六七八九]$"), F.instr(F.lit(NUMERALS), c)).when(c.rlike("^[一二三四五六七八九]?十[一二三四五六七八九]?$"), digit(tens) * 10 + F.when(ones == "", 0).otherwise(F.instr(F.lit(NUMERALS), ones)))


#: Fixed kinds of facts, tried in this order.
FACTS = (("abs_path", r"(?:^|[\s`(])/(?:home|usr|opt|var|etc)/[A-Za-z0-9_./-]+"), ("drive_path", r"[A-Za-z]:\\[A-Za-z0-9_.\\-]+"), ("file_name", r"[A-Za-z0-9_-]+\.(?:py|ts|js|md|json|rs|go|java)\b"), ("date", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"))


def fact_kind(c: Column) -> Column:
    """The first kind of hard fact that a text holds: a path, a file name, a date."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(FACTS):
        out = F.when(c.rlike(pattern), kind).otherwise(out)
    return out


def missing_trio(c: Column) -> Column:
    """Which of source, evidence and consequence a draft doesn't name."""
    low = F.lower(c)
    return F.array_compact(F.array(*[F.when(~low.contains(k), F.lit(k)) for k in ("source", "evidence", "consequence")]))


def numeric_claims(c: Column, nouns=("files", "rules", "items", "tests", "checks")) -> Column:
    """Digits followed by a unit noun."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"[0-9]+ (?:{'|'.join(nouns)})"), F.lit(0))


def feature_words(c: Column, least: int = 3) -> Column:
    """Identifiers of least or more letters, and CJK grams of 2 to 4 characters."""
    return F.array_distinct(F.concat(ascii_tokens(c, least), cjk_grams(c, 2), cjk_grams(c, 3), cjk_grams(c, 4)))


def keywords_of(code: Column, name: Column, most: int = 40) -> Column:
    """Identifiers of 3 or more characters in code and CJK runs of the name, sorted, most at most."""
    return F.slice(F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(code, F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)), F.regexp_extract_all(name, F.lit(f"{CJK}+"), F.lit(0))))), 1, most)


def domain_counts(text: Column, domains: dict[str, str]) -> Column:
    """Map of how often each domain's pattern occurs, zeros left out."""
    pairs = F.array(*[F.struct(F.lit(d).alias("key"), F.regexp_count(text, F.lit(p)).alias("value")) for d, p in sorted(domains.items())])
    return F.map_from_entries(F.filter(pairs, lambda x: x["value"] > 0))
