"""Consistency of what documents claim with what there is: indexes, twin documents, counts, open points, statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.text import CJK, cjk_grams
from sievework.operators.lint import issue
from sievework.sources.corpus import with_positions

#: Fixed limits: characters from which on a name may be part of another, lines of a statement.
PART, STATEMENT = 6, 12


def index_consistency(table: DataFrame, blocks: DataFrame, files: DataFrame, refs: DataFrame) -> DataFrame:
    """table (id, path or null): what an index says; blocks (id): what exists; files (path); refs (id, path): what files
    really refer to -> kind, id, path: unknown_id, orphan (a block the index lacks), broken_path, not_referenced (the
    index names a file that doesn't refer), undeclared (a file refers, the index doesn't name it)."""
    none = F.lit(None).cast("string")
    rows = table.select(F.col("id").cast("string").alias("id"), F.col("path").cast("string").alias("path")).distinct()
    have = blocks.select(F.col("id").cast("string").alias("b")).distinct()
    disk = files.select(F.col("path").cast("string").alias("f")).distinct()
    used = refs.select(F.col("id").cast("string").alias("ri"), F.col("path").cast("string").alias("rp")).distinct()
    ids, named = rows.select("id").distinct(), rows.where("path is not null")
    same = (F.col("id") == F.col("ri")) & (F.col("path") == F.col("rp"))
    parts = [
        ids.join(have, F.col("id") == F.col("b"), "left_anti").select(F.lit("unknown_id").alias("kind"), "id", none.alias("path")),
        have.join(ids, F.col("b") == F.col("id"), "left_anti").select(F.lit("orphan").alias("kind"), F.col("b").alias("id"), none.alias("path")),
        named.join(disk, F.col("path") == F.col("f"), "left_anti").select(F.lit("broken_path").alias("kind"), "id", "path"),
        named.join(disk, F.col("path") == F.col("f"), "left_semi").join(used, same, "left_anti").select(F.lit("not_referenced").alias("kind"), "id", "path"),
        used.join(named, same, "left_anti").select(F.lit("undeclared").alias("kind"), F.col("ri").alias("id"), F.col("rp").alias("path")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def technical(tok: Column, noise: tuple[str, ...] = ()) -> Column:
    """Whether a word looks like a name in code: with a dot, an underscore, raised throughout, or Camel case."""
    shape = F.when(tok.contains("."), F.length(tok) > 3).when(tok.contains("_"), F.length(tok) > 5).when(tok.rlike("^[A-Z][A-Z0-9_]{3,}$"), F.lit(True)).when(tok.rlike("^[A-Z][A-Za-z0-9]*$"), F.length(tok) >= 5).otherwise(F.lit(False))
    return shape & ~tok.rlike("^GD[0-9]+$") & (~tok.isin(*noise) if noise else F.lit(True))


def uncovered(told: DataFrame, pool: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """told (doc, tok), pool (doc, tok), common (tok) -> rows of told whose name neither the document's pool nor the
    common one holds: as it is, with or without a final 2D or 3D, or, from PART characters on both sides, inside another
    name or around it.

    Equal names go first, by an anti join. Of two names one inside the other, the first PART characters of the shorter
    are among the runs of PART characters of the longer: so the rest is an equality join on such runs, and no pair
    without a common run is looked at."""
    told = told.select("doc", "tok").distinct()
    pool = pool.select(F.col("doc").alias("pd"), F.col("tok").alias("pt")).distinct()
    stems = F.array("tok", F.concat("tok", F.lit("2D")), F.concat("tok", F.lit("3D")), F.regexp_replace("tok", "[23]D$", ""))
    runs = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - (PART - 1)), lambda i: F.substring(c, i, F.lit(PART)))

    def without(left: DataFrame, names: DataFrame, by_doc: bool) -> DataFrame:
        same = [F.col("doc") == F.col("pd")] if by_doc else []
        wide = left.select("doc", "tok", F.explode(F.array_distinct(stems)).alias("s"))
        left = left.join(wide.join(names, [*same, F.col("s") == F.col("pt")], "left_semi").select(F.col("doc").alias("hd"), F.col("tok").alias("ht")), (F.col("doc") == F.col("hd")) & (F.col("tok") == F.col("ht")), "left_anti")
        long, others = left.where(F.length("tok") >= PART), names.where(F.length("pt") >= PART)
        key = ["pd", "pt"] if by_doc else ["pt"]
        inside = long.withColumn("run", F.substring("tok", 1, PART)).join(others.select(*key, F.explode(F.array_distinct(runs(F.col("pt")))).alias("prun")), [*same, F.col("run") == F.col("prun"), F.contains("pt", "tok")], "left_semi")
        around = long.select("doc", "tok", F.explode(F.array_distinct(runs(F.col("tok")))).alias("run")).join(others.withColumn("prun", F.substring("pt", 1, PART)), [*same, F.col("run") == F.col("prun"), F.contains("tok", "pt")], "left_semi")
        gone = inside.select("doc", "tok").union(around.select("doc", "tok")).select(F.col("doc").alias("hd"), F.col("tok").alias("ht")).distinct()
        return left.join(gone, (F.col("doc") == F.col("hd")) & (F.col("tok") == F.col("ht")), "left_anti")

    out = without(told, pool, True)
    return without(out, common.select(F.col("tok").alias("pt")).distinct(), False) if common is not None else out


def claims(claimed: DataFrame, disk: DataFrame, links: DataFrame) -> DataFrame:
    """claimed (id, n), disk (id, file), links (id, file) -> kind, id, detail: ghost (claimed, not there), miscount,
    unregistered (there, not claimed), missing (a claimed id links a file that isn't there)."""
    have = disk.groupBy(F.col("id").alias("d")).agg(F.countDistinct("file").alias("m"))
    both = claimed.select("id", "n").join(have, F.col("id") == F.col("d"), "full")
    kind = F.when(F.col("d").isNull(), "ghost").when(F.col("id").isNull(), "unregistered").when(F.col("n") != F.col("m"), "miscount")
    rows = both.select(kind.alias("kind"), F.coalesce("id", "d").cast("string").alias("id"), F.when(kind == "miscount", F.concat_ws(" of ", F.col("m").cast("string"), F.col("n").cast("string"))).otherwise("").alias("detail")).where("kind is not null")
    known = links.join(claimed.select(F.col("id").alias("c")).distinct(), F.col("id") == F.col("c"), "left_semi")
    gone = known.join(disk.select(F.col("id").alias("d"), F.col("file").alias("df")).distinct(), (F.col("id") == F.col("d")) & (F.col("file") == F.col("df")), "left_anti")
    return rows.unionByName(gone.select(F.lit("missing").alias("kind"), F.col("id").cast("string").alias("id"), F.col("file").cast("string").alias("detail")).distinct())


def evaluation_distribution(rules: DataFrame) -> DataFrame:
    """recall, precision, n: how many rules have each pair of verdicts; what was never measured is unverified."""
    verdict = lambda c: F.coalesce(c, F.lit("unverified")).alias(c)
    return rules.groupBy(verdict("recall"), verdict("precision")).agg(F.count("*").alias("n"))


def verification_counts(items: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """items (id), state (id, result verified, refuted or skipped; of several the last by at) -> total, open and each
    result, by columns of items."""
    last = state.groupBy(F.col("id").alias("sid")).agg(F.max_by("result", "at").alias("result"))
    n = lambda x: F.count_if(F.col("result") == x).alias(x)
    return items.join(last, F.col("id") == F.col("sid"), "left").groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("result").isNull()).alias("open"), n("verified"), n("refuted"), n("skipped"))


def numbered_points(ls: DataFrame, pattern: str, doc: str = "path") -> DataFrame:
    """Open points on lines (doc, line_no, line): id V, two digits or more for the document's place among all documents
    with lines, and two or more for the point's place in it; the pattern's first group is the claim."""
    order = with_positions(ls.select(F.col(doc).alias("_doc")).distinct(), "_doc").select("_doc", (F.col("position") + 1).alias("_no"))
    hits = ls.where(F.col("line").rlike(pattern)).withColumn("_seq", F.row_number().over(W.partitionBy(doc).orderBy("line_no")))
    two = lambda c: F.when(F.col(c) < 10, F.concat(F.lit("0"), F.col(c).cast("string"))).otherwise(F.col(c).cast("string"))
    return hits.join(order, F.col(doc) == F.col("_doc")).select(F.concat(F.lit("V"), two("_no"), two("_seq")).alias("id"), doc, "line_no", F.trim(F.regexp_extract("line", pattern, 1)).alias("claim"))


def statements(ls: DataFrame, key: list[str], pattern: str, most: int = STATEMENT) -> DataFrame:
    """Each line that the pattern hits with its statement: the lines from it on, most at most, up to the one where open
    parentheses are balanced and a semicolon or a closing one stands. The frame holds most lines, so no file is gathered."""
    ahead = F.collect_list("line").over(W.partitionBy(*key).orderBy("line_no").rowsBetween(0, most - 1))
    count = lambda x, p: F.length(x) - F.length(F.replace(x, F.lit(p), F.lit("")))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("out"))

    def step(a, x):
        depth = a.depth + count(x, "(") - count(x, ")")
        ends = (depth <= 0) & (x.contains(";") | x.contains(")"))
        return F.when(a.done, a).otherwise(F.struct(depth.alias("depth"), ends.alias("done"), F.array_append(a.out, x).alias("out")))

    hits = ls.withColumn("_ahead", ahead).where(F.col("line").rlike(pattern))
    return hits.select(*key, "line_no", F.array_join(F.aggregate("_ahead", start, step, lambda a: a.out), " ").alias("statement"))


def untracked(files: DataFrame, tracked: DataFrame) -> DataFrame:
    """files (path) that the list of tracked files (path) lacks."""
    return files.join(tracked.select(F.col("path").alias("_t")).distinct(), F.col("path") == F.col("_t"), "left_anti")


def domains_in_repo(roots: DataFrame, links: DataFrame, assets: DataFrame, tracked: DataFrame) -> DataFrame:
    """roots (domain, root), links (path, target), assets (path), tracked (path) -> issues: roots and link targets that
    are absolute, links that are tracked, assets that aren't."""
    away = issue(roots.where(F.col("root").rlike("^(/|~|[A-Za-z]:)")), "domain", "warn", F.concat(F.lit("root is absolute: "), F.col("root")))
    target = issue(links.where(F.col("target").rlike("^(/|[A-Za-z]:)")), "path", "error", F.concat(F.lit("link to an absolute path: "), F.col("target")))
    seen = links.join(tracked.select(F.col("path").alias("_t")).distinct(), F.col("path") == F.col("_t"), "left_semi")
    kept = assets.where(~F.col("path").rlike(r"(^|/)\.|INDEX\.md$"))
    return away.unionByName(target).unionByName(issue(seen, "path", "error", "link is tracked")).unionByName(issue(untracked(kept, tracked), "path", "warn", "asset isn't tracked"))


def flow_entry(flows: DataFrame, entries: DataFrame) -> DataFrame:
    """flows (file, type), entries (text): texts that readers come to first -> procedures whose file name none holds."""
    name = F.regexp_extract("file", "([^/]+)$", 1)
    procedures = flows.where("type = 'procedure'").withColumn("_name", name)
    told = entries.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_.-]+\.md"), F.lit(0))).alias("_told")).distinct()
    return issue(procedures.join(told, F.col("_name") == F.col("_told"), "left_anti"), "file", "warn", "procedure without an entry")


def check_coverage(checks: DataFrame, tests: DataFrame, indirect: DataFrame, prefix: str = "check_", itself: str = "check_check_coverage") -> DataFrame:
    """checks (name, file), tests (text of the self-test), indirect (name, reason) -> checks that no self-test calls; only
    noted where a reason is given."""
    called = tests.select(F.explode(F.regexp_extract_all("text", F.lit(rf"({prefix}[A-Za-z0-9_]+)\("), F.lit(1))).alias("_called")).distinct()
    left = checks.where((F.col("name").startswith(prefix)) & (F.col("name") != itself)).join(called, F.col("name") == F.col("_called"), "left_anti")
    left = left.join(indirect.select(F.col("name").alias("_n"), "reason"), F.col("name") == F.col("_n"), "left")
    noted = left.where(F.length(F.trim(F.coalesce("reason", F.lit("")))) > 0)
    bare = left.where(F.length(F.trim(F.coalesce("reason", F.lit("")))) == 0)
    text = F.concat(F.lit("no self-test calls "), F.col("name"))
    return issue(bare, "file", "warn", text).unionByName(issue(noted, "file", "info", text))


def functions_of(sources: DataFrame, prefix: str = "check_") -> DataFrame:
    """sources (path, text) of Python -> file, name, body of each top-level function whose name begins with prefix: from
    its header to the next line that isn't indented."""
    blocks = F.explode(F.split("text", r"\n(?=[^\s#)\]}])"))
    name = F.regexp_extract("body", r"^def (\w+)", 1)
    return sources.select(F.col("path").alias("file"), blocks.alias("body")).withColumn("name", name).where(F.col("name").startswith(prefix)).select("file", "name", "body")


def scan_scope_of_checks(sources: DataFrame, exempt: DataFrame, entry: str = "SKILL.md", whole: tuple[str, ...] = ("base", "ROOT")) -> DataFrame:
    """Checks over Markdown folders that leave out the entry file: their globs take .md, none starts at the root and the
    entry file isn't named. exempt (name, reason): a reason is needed."""
    f = functions_of(sources)
    globs = F.regexp_extract_all("body", F.lit(r"([\w.]+|\([^()]*\))\.r?glob\(([^)]*)\)"), F.lit(1))
    kinds = F.regexp_extract_all("body", F.lit(r"\.r?glob\(([^)]*)\)"), F.lit(1))
    f = f.withColumns({"at": globs, "kinds": kinds}).where(F.exists("kinds", lambda k: k.contains(".md")) & ~F.exists("at", lambda r: r.isin(*whole)) & ~F.col("body").contains(entry))
    why = exempt.where(F.length(F.trim("reason")) > 0).select(F.col("name").alias("_n")).distinct()
    return issue(f.join(why, F.col("name") == F.col("_n"), "left_anti"), "file", "info", F.concat(F.lit("scan leaves out the entry file: "), F.col("name")))


def scope_selfreport(sources: DataFrame, passed: str = r"✓|\b(passed|all good|healthy|clean)\b", scope: str = r"%d|\{[^}]*\}|\bscanned\b|\bin total\b") -> DataFrame:
    """Functions that report success without saying over how much: on an empty set that says nothing."""
    f = functions_of(sources, "")
    lines = F.filter(F.split("body", "\n"), lambda x: x.contains("print("))
    f = f.withColumn("said", lines).where(F.exists("said", lambda x: x.rlike(passed)) & ~F.exists("said", lambda x: x.rlike(scope)))
    return issue(f, "file", "info", F.concat(F.lit("success without its scope: "), F.col("name")))


def recommend(hits: DataFrame, key: str, all_keys: DataFrame, current: str | None = None) -> DataFrame:
    """hits (key, domain, hits) -> key, domain, hits, confidence: one more for the current domain where it is hit at all.
    A lone candidate is high from two on, else medium; a leading one is high from a lead of two on, else medium; a tie
    is undecided; no hit none. Of equals the current domain comes first, then the smaller name."""
    mine = F.col("domain") == F.lit(current) if current else F.lit(False)
    df = hits.where("hits > 0").withColumn("hits", F.col("hits") + F.when(mine, 1).otherwise(0))
    w = W.partitionBy(key).orderBy(F.desc("hits"), F.desc(mine.cast("int")), "domain")
    top = df.withColumns({"n": F.row_number().over(w), "second": F.lead("hits").over(w)}).where("n = 1").select(F.col(key).alias("_k"), "domain", "hits", "second")
    lead = F.col("hits") - F.col("second")
    sure = F.when(F.col("hits").isNull(), "none").when(F.col("second").isNull(), F.when(F.col("hits") >= 2, "high").otherwise("medium")).when(lead == 0, "undecided").when(lead >= 2, "high").otherwise("medium")
    return all_keys.join(top, F.col(key) == F.col("_k"), "left").select(key, "domain", F.coalesce("hits", F.lit(0)).alias("hits"), sure.alias("confidence"))


def draft_fingerprint(text: Column) -> Column:
    """16 hex digits of a draft file's SHA-1; empty where there is none."""
    return F.coalesce(F.substring(F.sha1(text), 1, 16), F.lit("empty"))


#: Fixed words and constraints of the environment hint, in this order.
SYSTEMS = (("mac", "os:darwin"), ("macos", "os:darwin"), ("win", "os:windows"), ("windows", "os:windows"), ("linux", "os:linux"))


def environment_hint(text: Column) -> Column:
    """The constraint that a draft names: its [env: ...] tag, else a system's word, else a Python version, else empty."""
    tag = F.trim(F.regexp_extract(text, r"(?i)\[(?:env|环境)\s*[:：]?\s*([^\]]+)\]", 1))
    out = F.regexp_extract(text, r"(?i)py(?:thon)?\s*(?:>=|<=|==|>|<)\s*[0-9.]+", 0)
    for word, spec in reversed(SYSTEMS):
        out = F.when(F.lower(text).contains(word), spec).otherwise(out)
    return F.coalesce(F.when(tag != "", tag).otherwise(out), F.lit(""))


def sibling_tokens(text: Column) -> Column:
    """Distinct names in backticks, with underscores, in Camel case, lower-case words of four letters or more, and CJK
    bigrams."""
    found = [(r"`([A-Za-z_][A-Za-z0-9_.]*)`", 1), (r"[a-z0-9]+(?:_[a-z0-9]+)+", 0), (r"[A-Z][a-z0-9]+(?:[A-Z][A-Za-z0-9]*)+", 0), (r"\b[a-z]{4,}\b", 0)]
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in found], F.filter(cjk_grams(text), lambda x: x.rlike(f"^{CJK}{{2}}$"))))
