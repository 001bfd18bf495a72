"""Document lint: each check takes tables and gives issues (level, file, issue, hint).

Checks of lines take lines (file, line_no, line) or documents (file, text). Documents are looked at one by one, which
sorts and shuffles nothing; lines of a file meet in a window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.text import NUMERALS, let, numeral, token_runs
from sievework.sources.corpus import lines
from sievework.sources.markdown import cells_of, fenced, fences, marked, tables


def issue(df: DataFrame, file: str, level: str, what, hint="") -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(F.lit(level).alias("level"), F.col(file).cast("string").alias("file"), lit(what).alias("issue"), lit(hint).alias("hint"))


def united(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def size(docs: DataFrame, file: str, text: str, most_lines: int = 500, most_tokens: int = 8192, exempt: str = r"lint: *size-exempt") -> DataFrame:
    """Files above their limits; exempt ones are told as info."""
    n, t = F.size(F.split(F.col(text), "\n")), token_runs(F.col(text))
    over = docs.select(file, n.alias("n"), t.alias("t"), F.col(text).rlike(exempt).alias("ok")).where((F.col("n") > most_lines) | (F.col("t") > most_tokens))
    return over.select(F.when(F.col("ok"), "info").otherwise("error").alias("level"), F.col(file).cast("string").alias("file"), F.concat(F.col("n"), F.lit(" lines, "), F.col("t"), F.lit(" tokens")).alias("issue"), F.lit("split the file").alias("hint"))


def shape(docs: DataFrame, file: str, text: str, most_lines: int = 500, share: float = 0.8, most_sections: int = 20) -> DataFrame:
    """Files near their limit, or with many sections."""
    n, s = F.size(F.split(F.col(text), "\n")), F.regexp_count(F.col(text), F.lit("(?m)^#{1,3} "))
    near = docs.select(file, n.alias("n"), s.alias("s")).where(((F.col("n") >= share * most_lines) & (F.col("n") <= most_lines)) | (F.col("s") > most_sections))
    return issue(near, file, "warn", F.concat(F.col("n"), F.lit(" lines, "), F.col("s"), F.lit(" sections")), "near the limit")


def headings(ls: DataFrame, file: str) -> DataFrame:
    """Doubled marks and indented headings outside fences."""
    df = fenced(ls, file).where(~F.col("in_fence"))
    doubled, indented = F.col("line").rlike(r"^#+ +#+ "), F.col("line").rlike(r"^ {1,3}#{1,6} ")
    return issue(df.where(doubled | indented), file, "warn", F.concat(F.when(doubled, "doubled heading mark").otherwise("indented heading"), F.lit(", line "), F.col("line_no")))


def duplicate_headings(ls: DataFrame, file: str) -> DataFrame:
    name = lambda x: F.trim(F.regexp_replace(x, "^#+", ""))
    if "line" not in ls.columns:
        heads = F.transform(F.filter(marked(F.col("text")), lambda x: ~x.in_fence & x.line.rlike("^#{1,6} ")), lambda x: name(x.line))
        more = let(F.array_sort(heads), lambda h: F.array_distinct(F.filter(h, lambda x, i: F.coalesce(F.get(h, i - 1) == x, F.lit(False)))))
        return issue(ls.select(file, F.explode(more).alias("h")), file, "warn", F.concat(F.lit("heading repeated: "), F.col("h")))
    df = fenced(ls, file).where(~F.col("in_fence") & F.col("line").rlike("^#{1,6} ")).withColumn("h", name(F.col("line")))
    return issue(df.groupBy(file, "h").agg(F.count("*").alias("n")).where("n > 1"), file, "warn", F.concat(F.lit("heading repeated: "), F.col("h")))


def heading_numbers(ls: DataFrame, file: str) -> DataFrame:
    """Ordinals that repeat among the headings of one level."""
    pattern = f"^#+ +[{NUMERALS}]+、"
    depth = lambda x: F.length(F.regexp_extract(x, "^(#+)", 1)).alias("depth")
    no = lambda x: numeral(F.regexp_extract(x, f"^#+ +([{NUMERALS}]+)、", 1)).alias("no")
    if "line" not in ls.columns:
        heads = F.transform(F.filter(marked(F.col("text")), lambda x: ~x.in_fence & x.line.rlike(pattern)), lambda x: F.struct(depth(x.line), no(x.line)))
        more = let(F.array_sort(heads), lambda h: F.array_distinct(F.filter(h, lambda x, i: (i > 0) & F.get(h, i - 1).eqNullSafe(x))))
        df = ls.select(file, F.explode(more.no).alias("no"))
    else:
        df = fences(ls, [file]).where(~F.col("in_fence") & F.col("line").rlike(pattern)).select(file, depth(F.col("line")), no(F.col("line")))
        df = df.groupBy(file, "depth", "no").agg(F.count("*").alias("n")).where("n > 1")
    return issue(df, file, "error", F.concat(F.lit("number repeated: "), F.col("no")))


def table_columns(ls: DataFrame, file: str) -> DataFrame:
    """Rows whose cells differ in number from their table's first row; tables are runs of neighbouring lines with bars."""
    if "line" not in ls.columns:
        rows = F.transform("rows", lambda x: F.struct(x.line_no.alias("line_no"), F.size(cells_of(x.line)).alias("cells")))
        odd = let(rows, lambda r: F.transform(F.filter(r, lambda y: y.cells != F.get(r, F.lit(0)).cells), lambda y: F.struct(y.line_no.alias("line_no"), y.cells.alias("cells"), F.get(r, F.lit(0)).cells.alias("want"))))
        df = tables(ls, file, marked(F.col("text"))).select(file, F.explode(odd).alias("r")).select(file, "r.*")
        return issue(df, file, "error", F.concat(F.lit("line "), F.col("line_no"), F.lit(": "), F.col("cells"), F.lit(" cells, not "), F.col("want")))
    df = fenced(ls, file).where(~F.col("in_fence") & F.col("line").rlike(r"^\s*\|"))
    df = df.withColumn("island", F.col("line_no") - F.row_number().over(W.partitionBy(file).orderBy("line_no"))).withColumn("cells", F.size(cells_of(F.col("line"))))
    df = df.withColumn("want", F.first("cells").over(W.partitionBy(file, "island").orderBy("line_no")))
    return issue(df.where("cells <> want"), file, "error", F.concat(F.lit("line "), F.col("line_no"), F.lit(": "), F.col("cells"), F.lit(" cells, not "), F.col("want")))


def lone_table_rows(ls: DataFrame, file: str) -> DataFrame:
    if "line" not in ls.columns:
        has = lambda x: F.coalesce(x.line.rlike(r"^\s*\|"), F.lit(False))
        alone = let(marked(F.col("text")), lambda a: F.filter(a, lambda x, i: has(x) & ~x.in_fence & ~has(F.get(a, i - 1)) & ~has(F.get(a, i + 1))))
        return issue(ls.select(file, F.explode(alone.line_no).alias("line_no")), file, "warn", F.concat(F.lit("row without a table, line "), F.col("line_no")))
    w = W.partitionBy(file).orderBy("line_no")
    bar = F.col("line").rlike(r"^\s*\|")
    near = F.coalesce(F.lag("line").over(w).rlike(r"^\s*\|"), F.lit(False)) | F.coalesce(F.lead("line").over(w).rlike(r"^\s*\|"), F.lit(False))
    df = fences(ls.withColumn("near", near), [file])
    return issue(df.where(bar & ~F.col("near") & ~F.col("in_fence")), file, "warn", F.concat(F.lit("row without a table, line "), F.col("line_no")))


def missing_refs(refs: DataFrame, files: DataFrame, file: str, target: str, path: str, level: str = "error", what: str = "missing target: ") -> DataFrame:
    """References whose target isn't among the paths: files, anchors, flags, symbols, block ids alike."""
    have = files.select(F.col(path).alias("_p")).distinct()
    return issue(refs.join(have, F.col(target) == F.col("_p"), "left_anti"), file, level, F.concat(F.lit(what), F.col(target)))


def orphans(files: DataFrame, refs: DataFrame, path: str, target: str, level: str = "warn") -> DataFrame:
    """Files that nothing refers to."""
    used = refs.select(F.col(target).alias("_t")).distinct()
    return issue(files.join(used, F.col(path) == F.col("_t"), "left_anti"), path, level, "nothing refers to it")


def mirror_pairs(refs: DataFrame, a: str, b: str) -> DataFrame:
    """References that their target doesn't return."""
    back = refs.select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
    return issue(refs.select(a, b).distinct().join(back, (F.col(a) == F.col("_b")) & (F.col(b) == F.col("_a")), "left_anti"), a, "error", F.concat(F.lit("not returned by "), F.col(b)))


def identical_files(docs: DataFrame, file: str, text: str, least: int = 40) -> DataFrame:
    groups = docs.where(F.length(text) >= least).groupBy(F.md5(text).alias("d")).agg(F.count("*").alias("n"), F.min(file).alias("file")).where("n > 1")
    return issue(groups, "file", "error", F.concat(F.col("n"), F.lit(" files with equal contents")))


def front_matter(fm: DataFrame, file: str, docs: DataFrame, required: tuple[str, ...] = ("id", "name", "trigger")) -> DataFrame:
    """Required keys that are missing, and ids used twice."""
    want = docs.select(file, F.explode(F.array(*map(F.lit, required))).alias("name"))
    lacking = issue(want.join(fm.select(file, "name"), [file, "name"], "left_anti"), file, "error", F.concat(F.lit("no "), F.col("name")))
    ids = fm.where("name = 'id'").select(file, F.get("values", F.lit(0)).alias("id"))
    twice = ids.groupBy("id").agg(F.count("*").alias("n"), F.min(file).alias("file")).where("n > 1")
    return lacking.unionByName(issue(twice, "file", "error", F.concat(F.lit("id used twice: "), F.col("id"))))


def degenerate_columns(cells: DataFrame, file: str, least: int = 5) -> DataFrame:
    """cells (file, table_no, column, value): columns of least rows or more that hold one value."""
    df = cells.groupBy(file, "table_no", "column").agg(F.count("*").alias("n"), F.countDistinct("value").alias("v")).where((F.col("n") >= least) & (F.col("v") == 1))
    return issue(df, file, "info", F.concat(F.lit("one value in column "), F.col("column")))


def volatile_counts(ls: DataFrame, file: str) -> DataFrame:
    return issue(ls.where(F.col("line").rlike(r"[0-9]+ (files|rules|checks|items)")), file, "warn", F.concat(F.lit("count written out, line "), F.col("line_no")))


def covered_share(have: DataFrame, want: DataFrame, key: str, value: str, share: float = 0.6) -> DataFrame:
    """Documents that hold share or more of a constant list: undeclared copies of it."""
    n = want.select(value).distinct().count()
    hit = have.join(want.select(value).distinct(), value, "left_semi").groupBy(key).agg(F.countDistinct(value).alias("n"))
    return issue(hit.where(F.col("n") >= share * n), key, "warn", F.concat(F.lit("holds "), F.col("n"), F.lit(f" of {n} values")))


def spec_drift(doc: DataFrame, code: DataFrame, value: str) -> DataFrame:
    """Values that only the document or only the code has."""
    a, b = doc.select(F.col(value).alias("_a")).distinct(), code.select(F.col(value).alias("_b")).distinct()
    df = a.join(b, F.col("_a") == F.col("_b"), "full_outer").where("_a is null or _b is null")
    return df.select(F.lit("error").alias("level"), F.coalesce("_a", "_b").cast("string").alias("file"), F.when(F.col("_a").isNull(), "not in the document").otherwise("not in the code").alias("issue"), F.lit("").alias("hint"))


def links(docs: DataFrame, file: str, text: str) -> DataFrame:
    """file, target of links in Markdown, anchors cut off."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\]\(([^)#\s]+)(?:#[^)]*)?\)"), F.lit(1)))
    return docs.select(file, found.alias("target"))


def check_documents(docs: DataFrame, file: str = "path", text: str = "text") -> DataFrame:
    """The checks that need nothing but the documents, united."""
    ls, docs = lines(docs, [file], text), docs.select(file, F.col(text).alias("text"))
    text = "text"
    lk = links(docs, file, text).where(~F.col("target").rlike("^[a-z]+:"))
    return united(size(docs, file, text), shape(docs, file, text), headings(docs, file), duplicate_headings(docs, file), heading_numbers(docs, file), table_columns(docs, file), lone_table_rows(docs, file), identical_files(docs, file, text), volatile_counts(ls, file), missing_refs(lk, docs, file, "target", file))
