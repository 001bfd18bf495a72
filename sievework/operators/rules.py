"""Detection rules as data, evaluated as column expressions over lines and files."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.comments import strip_comments
from sievework.functions.text import glob_regex, let, snippet

PRAGMA = r"audit[^\n]*ignore"


@dataclass(frozen=True)
class Rule:
    """A rule of one of the forms L (line), W (line with a guard in a window), F (whole text).

    pattern must hit; absent and present, where given, must not and must hit in the window of win lines around the hit
    (or, with win 0, anywhere in the file). first_only keeps a file's first hit; every, on form F, takes all hits and not the first alone. langs empty: any
    language."""

    rule_id: str
    level: str
    title: str
    pattern: str
    langs: tuple[str, ...] = ()
    form: str = "L"
    absent: str = ""
    present: str = ""
    win: int = 0
    first_only: bool = False
    fix: str = ""
    cwe: tuple[str, ...] | None = None
    scene: str = ""
    paths: tuple[str, ...] = field(default=())
    every: bool = False


def applies(rule: Rule, lang: Column, path: Column | None = None) -> Column:
    ok = lang.isin(*rule.langs) if rule.langs else F.lit(True)
    if rule.paths and path is not None:
        ok = ok & reduce(lambda a, b: a | b, [path.rlike(glob_regex(g)) for g in rule.paths])
    return ok


#: Languages whose gates are read without comments while lines are hit as they stand; in all others comments are
#: blanked first where scan() is told to.
RAW_LINES = ("rust", "go", "java", "cpp")


def without_comments(c: Column) -> Column:
    """Text without block and line comments, for gates; strings aren't looked at."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")


def exempt_lines(text: Column, pragma: str | None) -> Column:
    """Array of (line, exempt) of a text: a line is exempt if it or the one before holds the pragma."""
    plain = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.lit(False).alias("exempt")))
    if not pragma:
        return plain
    told = let(F.split(text, "\n"), lambda cut: F.transform(cut, lambda x, i: F.struct(x.alias("line"), (x.rlike(pragma) | F.coalesce(F.get(cut, i - 1).rlike(pragma), F.lit(False))).alias("exempt"))))
    return F.when(text.rlike(pragma), told).otherwise(plain)


def needed(pattern: str) -> list[set[str]]:
    """Sets of strings of which each hit of a pattern holds one, sets with marks first, as prose has few of them."""
    from re import _constants as ops, _parser

    def walk(seq) -> list[set[str]]:
        out, run = [], ""
        for op, arg in seq:
            if op is ops.LITERAL:
                run += chr(arg)
                continue
            out, run = [*out, *([{run}] if run else [])], ""
            if op is ops.SUBPATTERN:
                out += walk(arg[-1])
            elif op is ops.MAX_REPEAT and arg[0] > 0:
                out += walk(arg[2])
            elif op is ops.BRANCH:
                best = [max(found, key=rank, default=None) for found in map(walk, arg[1])]
                out += [set().union(*best)] if all(best) else []
        return [*out, *([{run}] if run else [])]

    rank = lambda x: (all(re.search(r"[^A-Za-z0-9 .,]", w) for w in x), min(map(len, x)))
    return sorted((x for x in walk(_parser.parse(pattern)) if len(x) <= 12), key=rank, reverse=True)


def may_hit(text: Column, pattern: str) -> Column:
    """False only if the pattern hits no line of the text: a hit on a line is one in the text with anchors at line ends.
    Patterns that look around, set flags or match nothing aren't judged, nor are line ends of two characters."""
    try:
        judged = not re.search(r"\(\?(?!:)|\\[AzZGRQ1-9]|[*+?}]\+", pattern) and not re.search(pattern, "")
    except re.error:
        judged = False
    if not judged:
        return F.lit(True)
    found = text.rlike(f"(?m){pattern}")
    found = found | text.contains("\r\n") if "$" in pattern else found
    held = [reduce(lambda a, b: a | b, [text.contains(w) for w in sorted(x)]) for x in needed(pattern)]
    return reduce(lambda a, b: a & b, [*held[:3], found])


def near(ls: DataFrame, key: list[str], pattern: str, before: int = 3, after: int = 1) -> DataFrame:
    """Adds seen: the pattern occurs on one of the before lines above a line, on it, or on the after lines below."""
    return ls.withColumn("seen", F.max(F.col("line").rlike(pattern)).over(W.partitionBy(*key).orderBy("line_no").rowsBetween(-before, after)))


def whole_matches(text: Column, pattern: str) -> Column:
    """Array of (line_no, hit) of every match of a pattern in a text; the pattern must not match nothing."""
    newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.slice(between, 1, F.size(hits)), hits, lambda b, h: F.struct(newlines(b).alias("b"), newlines(h).alias("h"), h.alias("hit")))
    empty = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<line_no:int,hit:string>>").alias("out"))
    add = lambda a, x: F.struct((a.at + x.b + x.h).alias("at"), F.concat(a.out, F.array(F.struct((a.at + x.b).alias("line_no"), x.hit.alias("hit")))).alias("out"))
    return F.aggregate(steps, empty, add, lambda a: a.out)


def scan(files: DataFrame, rules: list[Rule], key: list[str], lang: str = "lang", text: str = "text", pragma: str | None = PRAGMA, blank: bool = False) -> DataFrame:
    """Findings (rule_id, level, key..., line_no, snippet) of all rules over files, each of which is looked at by itself.

    A rule first asks of the whole text whether its pattern can hit at all, and only then looks at lines; gates and
    guards are read where a line is hit. So what a text costs is one search for each rule, no row is made for a line and
    nothing is shuffled but the hits of rules that keep a file's first one. A line is exempt if it or the one before holds
    the pragma. Whole-text rules report the line of their first hit. Null texts give nothing; a rule without a language
    list applies to files whose language is null as well.

    In the languages of RAW_LINES gates are read without comments, while lines count as they stand. With blank comments
    of all other files are blanked first (an Arrow UDF), except for the pragma."""
    found = []
    gated = F.when(F.col(lang).isin(*RAW_LINES), without_comments(F.col(text))).otherwise(F.col(text))
    marked = F.col(text)
    if blank:
        raw = files.where(F.col(lang).isin(*RAW_LINES) | F.col(lang).isNull()).withColumn("_marked", F.col(text))
        rest = files.where(~F.col(lang).isin(*RAW_LINES)).withColumn("_marked", F.col(text))
        files, marked = raw.unionByName(rest.withColumn(text, strip_comments(F.col(text), F.col(lang)))), F.col("_marked")
    line_rules = [r for r in rules if r.form in ("L", "W")]
    whole = [r for r in rules if r.form == "F"]
    if blank and pragma:  # pragmas stand in comments, so they are looked for in the text as it was
        told = F.transform(exempt_lines(marked, pragma), lambda x: x.exempt)
        cut = F.zip_with(F.split(F.col(text), "\n"), told, lambda a, b: F.struct(a.alias("line"), b.alias("exempt")))
    else:
        cut = exempt_lines(F.col(text), pragma)

    def hits(r: Rule) -> Column:
        """Array of a rule's hits on the lines of a text."""

        def guarded(x: Column, i: Column, ls: Column) -> Column:
            ok = x.line.rlike(r.pattern) & ~x.exempt
            if r.win:
                from_ = F.greatest(i - (r.win - 1), F.lit(0))  # lines n - win + 1 to n + win around line n
                around = F.slice(ls, from_ + 1, i + r.win - from_ + 1)
                for kind, p in (("absent", r.absent), ("present", r.present)):
                    if p:
                        seen = F.exists(around, lambda y: y.line.rlike(p))
                        ok = ok & (~seen if kind == "absent" else seen)
            return ok

        told = [F.lit(r.rule_id).alias("rule_id"), F.lit(r.level).alias("level")]
        at = let(cut, lambda ls: F.transform(F.filter(F.transform(ls, lambda x, i: F.struct(F.when(guarded(x, i, ls), i + 1).alias("n"), x.line.alias("line"))), lambda y: y.n.isNotNull()), lambda y: F.struct(*told, y.n.alias("line_no"), snippet(y.line).alias("snippet"))))
        ok = applies(r, F.col(lang), F.col(key[0])) & may_hit(F.col(text), r.pattern)
        for kind, p in (("absent", r.absent), ("present", r.present)):
            if p and not r.win:
                ok = ok & (~gated.rlike(p) if kind == "absent" else gated.rlike(p))
        return F.when(ok, F.slice(at, 1, 1) if r.first_only else at).otherwise(none)

    none = F.array().cast("array<struct<rule_id:string,level:string,line_no:int,snippet:string>>")
    for once in (False, True):
        some = [r for r in line_rules if r.first_only == once]
        if some:
            hit = files.select(*key, F.explode(F.concat(*map(hits, some))).alias("r")).select("r.rule_id", "r.level", *key, "r.line_no", "r.snippet")
            found.append(first_hits(hit, ["rule_id", *key]).select(*hit.columns) if once else hit)
    if whole:

        def at(r: Rule) -> Column:
            ok = applies(r, F.col(lang), F.col(key[0])) & F.col(text).rlike(r.pattern)
            for kind, p in (("absent", r.absent), ("present", r.present)):
                if p:
                    ok = ok & (~gated.rlike(p) if kind == "absent" else gated.rlike(p))
            told = [F.lit(r.rule_id).alias("rule_id"), F.lit(r.level).alias("level")]
            if r.every:
                return F.when(ok, F.transform(whole_matches(F.col(text), r.pattern), lambda m: F.struct(*told, m.line_no.alias("line_no"), snippet(m.hit).alias("snippet")))).otherwise(none)
            before = F.substring(F.col(text), F.lit(1), F.regexp_instr(F.col(text), F.lit(r.pattern)) - 1)
            hit = F.regexp_substr(F.col(text), F.lit(r.pattern))
            return F.when(ok, F.array(F.struct(*told, (F.regexp_count(before, F.lit("\n")) + 1).alias("line_no"), snippet(hit).alias("snippet")))).otherwise(none)

        ws = files.select(*key, F.explode(F.concat(*map(at, whole))).alias("r"))
        found.append(ws.select("r.rule_id", "r.level", *key, "r.line_no", "r.snippet"))
    return reduce(DataFrame.unionByName, found)


def first_hits(findings: DataFrame, key: list[str]) -> DataFrame:
    """The hit with the smallest line number for each key."""
    others = [c for c in findings.columns if c not in key]
    best = findings.groupBy(*key).agg(F.min(F.struct("line_no", *[c for c in others if c != "line_no"])).alias("s"))
    return best.select(*key, *[F.col(f"s.{c}").alias(c) for c in others])


def first_hit_and_count(findings: DataFrame, key: list[str]) -> DataFrame:
    return findings.groupBy(*key).agg(F.min("line_no").alias("line_no"), F.count("*").alias("hits"))


def drop_pragma_lines(ls: DataFrame, key: list[str], pragma: str = PRAGMA) -> DataFrame:
    """Lines that neither hold the pragma nor follow one that does."""
    w = W.partitionBy(*key).orderBy("line_no")
    ls = ls.withColumn("_before", F.coalesce(F.lag("line").over(w).rlike(pragma), F.lit(False)))
    return ls.where(~F.col("line").rlike(pragma) & ~F.col("_before")).drop("_before")


def look_back(ls: DataFrame, key: list[str], pattern: str, rows: int = 40) -> DataFrame:
    """Adds seen: the pattern occurs on the line or on the rows - 1 before it."""
    return ls.withColumn("seen", F.max(F.col("line").rlike(pattern)).over(W.partitionBy(*key).orderBy("line_no").rowsBetween(-(rows - 1), 0)))


def merge_rules(*tables: DataFrame) -> DataFrame:
    """Rule tables one after the other; of rules with one id the last definition wins."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn("_pos", F.lit(i)) for i, t in enumerate(tables)])
    return whole.withColumn("_n", F.row_number().over(W.partitionBy("rule_id").orderBy(F.desc("_pos")))).where("_n = 1").drop("_n", "_pos")


def rule_errors(rules: list[Rule]) -> list[tuple[str, str]]:
    """Rules whose pattern doesn't compile, with the reason; scan() gets the others."""
    bad = []
    for r in rules:
        for p in (r.pattern, r.absent, r.present):
            try:
                re.compile(p.replace("(?<", "(?P<") if "(?<" in p and "(?<=" not in p and "(?<!" not in p else p)
            except re.error as e:
                bad.append((r.rule_id, str(e)))
    return bad


def scan_scope(files: DataFrame, lang: str = "lang") -> DataFrame:
    """Files seen for each language, so that no findings isn't mistaken for nothing scanned."""
    return files.groupBy(F.coalesce(F.col(lang), F.lit("(unsupported)")).alias("lang")).agg(F.count("*").alias("files"))
