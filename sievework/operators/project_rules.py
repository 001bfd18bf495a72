"""Rules over a whole project, as findings (rule_id, level, path, line_no, snippet)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import posix_normal, snippet
from sievework.operators.project import anti, imports_of, reachable
from sievework.operators.rules import Rule
from sievework.sources.corpus import lines

#: Own policy: what an ignore list should name, where a CI lives, which scripts check, which files are entries.
IGNORED = ("node_modules", "dist", ".env")
CI = r"^(\.github/workflows/.*\.ya?ml|\.gitlab-ci\.yml|Jenkinsfile|\.circleci/config\.yml)$"
CHECKING = r"(?i)test|lint|typecheck|check"
ENTRY = r"(^|/)(index|main|app|cli|setup|vite\.config|webpack\.config)\.[a-z]+$|\.(test|spec)\.[a-z]+$"
EXPORT = r"^\s*export +(?:default +)?(?:async +)?(?:function\*?|class|const|let|var|interface|type|enum) +([A-Za-z_$][A-Za-z0-9_$]*)"
NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"


def finding(df: DataFrame, rule: str, level: str, line: Column | int = 1, text: Column | str = "") -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(F.lit(rule).alias("rule_id"), F.lit(level).alias("level"), "path", lit(line).cast("int").alias("line_no"), snippet(lit(text)).alias("snippet"))


def exports_of(files: DataFrame) -> DataFrame:
    """path, line_no, name of what files (path, text) export by a declaration."""
    found = lines(files, ["path"]).withColumn("name", F.regexp_extract("line", EXPORT, 1))
    return found.where("name <> ''").select("path", "line_no", "name")


def unreferenced_exports(files: DataFrame) -> DataFrame:
    """APP-G09: exported names that no other file holds. Only names that are exported somewhere are counted, once a file."""
    out = exports_of(files)
    used = files.select(F.col("path").alias("user"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(NAME), F.lit(0)))).alias("name"))
    used = used.join(out.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.count("*").alias("n"))
    df = out.join(used, "name", "left").where("coalesce(n, 0) <= 1")  # the exporting file holds it itself
    return finding(df, "APP-G09", "P2", F.col("line_no"), F.col("name"))


def resolved_imports(files: DataFrame, exts=("", ".ts", ".tsx", ".js", "/index.ts", "/index.js")) -> DataFrame:
    """path, line_no, spec, target: every file that a relative import may mean."""
    i = imports_of(lines(files, ["path"]))
    base = posix_normal(F.concat(F.regexp_replace("path", "[^/]*$", ""), "spec"))
    tried = i.where(F.col("spec").startswith(".")).withColumn("target", F.explode(F.array(*[F.concat(base, F.lit(e)) for e in exts])))
    return tried.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi")


def unimported_files(files: DataFrame) -> DataFrame:
    """APP-P02: source files that no other file imports, entries and tests aside."""
    source = files.where(F.col("path").rlike(r"\.(ts|tsx|js)$") & ~F.col("path").rlike(r"\.d\.ts$") & ~F.col("path").rlike(ENTRY))
    used = resolved_imports(files).where("target <> path")
    return finding(anti(source, used, "path", "target"), "APP-P02", "P2")


def repeated_imports(files: DataFrame) -> DataFrame:
    """APP-G08: one module imported by several statements of a file; the second one is told."""
    i = imports_of(lines(files, ["path"]))
    twice = i.groupBy("path", "spec").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("line_no")).alias("at")).where("n > 1")
    return finding(twice, "APP-G08", "P2", F.get("at", F.lit(1)), F.col("spec"))


def checks_without_ci(files: DataFrame) -> DataFrame:
    """APP-P03: a package with scripts that check, in a project without CI. Broken package files tell nothing."""
    scripts = F.map_keys(F.from_json("text", "scripts map<string,string>").scripts)
    packs = files.where("path = 'package.json'").withColumn("names", F.array_sort(F.filter(scripts, lambda k: k.rlike(CHECKING))))
    there = files.where(F.col("path").rlike(CI)).select(F.lit("package.json").alias("_ci")).distinct()
    df = packs.where(F.size("names") > 0).join(there, F.col("path") == F.col("_ci"), "left_anti")
    return finding(df, "APP-P03", "P2", 1, F.array_join(F.slice("names", 1, 4), ", "))


def ignore_gaps(files: DataFrame) -> DataFrame:
    """APP-P01: entries that the ignore list at the root lacks."""
    listed = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(F.trim(x), "^/|/$", ""))
    df = files.where("path = '.gitignore'").withColumn("gap", F.explode(F.array_except(F.array(*map(F.lit, IGNORED)), listed)))
    return finding(df, "APP-P01", "P2", 1, F.col("gap"))


def unreachable_modules(files: DataFrame) -> DataFrame:
    """APP-R08: Rust files that no mod statement leads to from main.rs or lib.rs."""
    rs = files.where(F.col("path").endswith(".rs"))
    names = lines(rs, ["path"]).withColumn("name", F.regexp_extract("line", r"^\s*(?:pub(?:\([a-z]+\))? +)?mod +([A-Za-z0-9_]+) *;", 1)).where("name <> ''")
    own = F.regexp_replace("path", r"(?:(?:main|lib|mod)\.rs|\.rs)$", "")
    folder = F.when(F.col("path").rlike(r"(^|/)(main|lib|mod)\.rs$"), own).otherwise(F.concat(own, F.lit("/")))
    edges = names.select(F.col("path").alias("src"), F.explode(F.array(F.concat(folder, "name", F.lit(".rs")), F.concat(folder, "name", F.lit("/mod.rs")))).alias("dst"))
    edges = edges.join(rs.select(F.col("path").alias("dst")), "dst", "left_semi").select("src", "dst")
    seen = reachable(edges, rs.where(F.col("path").rlike(r"(^|/)(main|lib)\.rs$|(^|/)(tests|benches|examples|bin)/|(^|/)build\.rs$")).select(F.col("path").alias("node")))
    return finding(anti(rs, seen, "path", "node"), "APP-R08", "P2")


def project_findings(files: DataFrame) -> DataFrame:
    """All rules over the whole of a project's files (path, text)."""
    out = unreferenced_exports(files)
    for f in (unimported_files, repeated_imports, checks_without_ci, ignore_gaps, unreachable_modules):
        out = out.unionByName(f(files))
    return out


def rules_from_json(text: str) -> list[Rule]:
    """Rules of a project's own, from a JSON list or an object with one under rules: id and pattern are needed; level,
    title, languages, form, absent, present, win, fix, cwe, scene, paths and first_only may be there. What isn't an
    object, lacks one of the two or has a form that isn't known is left out."""
    data = json.loads(text)
    rows = data.get("rules", []) if isinstance(data, dict) else data
    out = []
    for r in rows:
        if isinstance(r, dict) and r.get("id") and r.get("pattern") and r.get("form", "L") in ("L", "W", "F"):
            cwe = r.get("cwe")
            out.append(Rule(str(r["id"]), r.get("level", "P2"), r.get("title", ""), r["pattern"], tuple(r.get("languages", ())), r.get("form", "L"), r.get("absent", ""), r.get("present", ""), int(r.get("win", 0)), bool(r.get("first_only", False)), r.get("fix", ""), tuple(cwe) if cwe is not None else None, r.get("scene", ""), tuple(r.get("paths", ()))))
    return out
