"""Markdown as tables: front matter, items, sections, table rows, drafts, heading blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.text import let, token_estimate
from sievework.sources.corpus import lines


def fences(df: DataFrame, key: list[str], fence: str = "^[ \t]*```") -> DataFrame:
    """Adds in_fence: the line lies in a fenced block (fence lines count as inside)."""
    mark = F.col("line").rlike(fence).cast("int")
    upto = F.sum(mark).over(W.partitionBy(*key).orderBy("line_no"))
    return df.withColumn("in_fence", (upto % 2 == 1) | (mark == 1))


def comments(df: DataFrame, key: list[str]) -> DataFrame:
    """Adds in_comment: an HTML comment is open on the line or is on it."""
    opened = F.regexp_count("line", F.lit("<!--")) - F.regexp_count("line", F.lit("-->"))
    after = F.sum(opened).over(W.partitionBy(*key).orderBy("line_no"))
    return df.withColumn("in_comment", (after > 0) | F.col("line").contains("<!--") | F.col("line").contains("-->"))


FENCE = "[ \t]*```"


def marked(text: Column, fence: str = FENCE) -> Column:
    """Array of (line_no, line, in_fence) of a text. The text is cut before each line that begins with a fence, and parts
    are inside or outside by turns, so a text costs its length and its lines meet nothing of other texts. The fence must
    match inside a line, from its start on."""

    def part(parts: Column, p: Column, k: Column, first: Column) -> Column:
        n = k + first  # fence lines up to here; one with an even number closes
        own = F.when(k < F.size(parts) - 1, F.left(p, F.length(p) - 1)).otherwise(p)  # without the newline before the next part
        return F.transform(F.split(own, "\n"), lambda x, i: F.struct(x.alias("line"), ((n % 2 == 1) | ((i == 0) & (n > 0))).alias("in_fence")))

    cut = F.split(text, f"(?<![^\n])(?={fence})", -1)
    first = F.when(text.rlike(f"^{fence}"), 1).otherwise(0)
    ls = let(F.struct(cut.alias("parts"), first.alias("first")), lambda c: F.flatten(F.transform(c.parts, lambda p, k: part(c.parts, p, k, c["first"]))))
    return F.when(text.isNotNull(), F.transform(ls, lambda x, i: F.struct((i + 1).alias("line_no"), x.line.alias("line"), x.in_fence.alias("in_fence"))))


def fenced(df: DataFrame, key: str) -> DataFrame:
    """key, line_no, line, in_fence of documents with a text, each by itself, or of lines, which meet in a window."""
    if "line" in df.columns:
        return fences(df, [key])
    return df.select(key, F.explode(marked(F.col("text"))).alias("l")).select(key, "l.*")


def runs(ls: Column) -> Column:
    """Array of arrays: lines (line_no first) cut where their numbers leave a gap."""
    at = let(ls, lambda a: F.transform(a, lambda x, i: F.struct(i.alias("i"), ((i > 0) & (F.get(a, i - 1).line_no == x.line_no - 1)).alias("joined"))))
    starts = F.filter(at, lambda x: ~x.joined)
    return let(F.struct(ls.alias("a"), starts.alias("s")), lambda c: F.transform(c.s, lambda x, t: F.slice(c.a, x.i + 1, F.coalesce(F.get(c.s, t + 1).i, F.size(c.a)) - x.i)))


def uncommented(ls: Column) -> Column:
    """Lines on which no HTML comment is open, begins or ends."""
    holds = lambda x: x.line.contains("<!--") | x.line.contains("-->")
    opened = lambda x: F.regexp_count(x.line, F.lit("<!--")) - F.regexp_count(x.line, F.lit("-->"))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<i:int,n:int>>").alias("out"))
    add = lambda acc, m: F.struct((acc.n + m.n).alias("n"), F.concat(acc.out, F.array(F.struct(m.i.alias("i"), (acc.n + m.n).alias("n")))).alias("out"))

    def between(a: Column) -> Column:
        marks = F.filter(F.transform(a, lambda x, i: F.when(holds(x), F.struct(i.alias("i"), opened(x).alias("n")))), lambda m: m.isNotNull())
        stop = lambda m, t: F.coalesce(F.get(m, t).i, F.size(a))
        free = lambda m: F.transform(m, lambda x, t: F.when(x.n > 0, F.slice(a, 1, 0)).otherwise(F.slice(a, x.i + 2, stop(m, t + 1) - x.i - 1)))
        return let(F.aggregate(marks, start, add, lambda acc: acc.out), lambda m: F.when(F.size(m) == 0, a).otherwise(F.concat(F.slice(a, 1, F.get(m, F.lit(0)).i), F.flatten(free(m)))))

    return let(ls, between)


def front_matter(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, name, values: the entries of a leading --- block; [a, b] gives several values."""
    block = F.regexp_extract(F.col(text), r"^---\n([\s\S]*?)\n---", 1)
    rows = docs.select(key, F.explode(F.split(block, "\n")).alias("line")).where(F.col("line").rlike("^[A-Za-z_][A-Za-z0-9_-]*:"))
    value = F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1))
    values = F.when(value.rlike(r"^\[.*\]$"), F.filter(F.transform(F.split(F.regexp_replace(value, r"^\[|\]$", ""), ","), lambda x: F.trim(x)), lambda x: x != "")).otherwise(F.array(value))
    return rows.select(key, F.regexp_extract("line", "^([^:]*):", 1).alias("name"), values.alias("values"))


def sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, section_no, title, level, body, tokens: text from one heading up to the next; section 0 is the preamble.
    Headings inside fences don't count."""

    def cut(a: Column) -> Column:
        heads = F.filter(F.transform(a, lambda x, i: F.when(x.line.rlike("^#{1,6} ") & ~x.in_fence, i)), lambda i: i.isNotNull())
        body = lambda from_, upto: F.array_join(F.transform(F.slice(a, from_ + 1, upto - from_), lambda x: x.line), "\n")
        one = lambda no, h, b: F.struct(no.cast("long").alias("section_no"), h.alias("h"), b.alias("body"))

        def by(hs: Column) -> Column:
            first = F.coalesce(F.get(hs, F.lit(0)), F.size(a))
            preamble = F.when(first > 0, F.array(one(F.lit(0), F.lit(None).cast("string"), body(F.lit(0), first))))
            rest = F.transform(hs, lambda i, t: one(t + 1, F.get(a, i).line, body(i + 1, F.coalesce(F.get(hs, t + 1), F.size(a)))))
            return F.when(first > 0, F.concat(preamble, rest)).otherwise(rest)

        return let(heads, by)

    out = docs.select(key, F.explode(let(marked(F.col(text)), cut)).alias("s")).select(key, "s.*")
    return out.select(key, "section_no", F.regexp_replace("h", "^#+ +", "").alias("title"), F.length(F.regexp_extract("h", "^(#+)", 1)).alias("level"), "body", token_estimate(F.col("body")).alias("tokens"))


def items(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Criterion items: headings `### ID name`, or table rows whose first cell is an id (two or three columns)."""
    part = sections(docs, key, text).where(F.col("title").rlike("^[A-Z]+-?[0-9]+ "))
    found = part.select(key, F.regexp_extract("title", "^([A-Z]+-?[0-9]+) ", 1).alias("id"), F.regexp_extract("title", "^[A-Z]+-?[0-9]+ +(.*)$", 1).alias("name"), "body")
    cells = table_rows(docs, key, text).where(F.size("cells").isin(2, 3) & F.get("cells", F.lit(0)).rlike("^[A-Z]+-?[0-9]+$"))
    rows = cells.select(key, F.get("cells", F.lit(0)).alias("id"), F.get("cells", F.lit(1)).alias("name"), F.coalesce(F.get("cells", F.lit(2)), F.lit("")).alias("body"))
    xrefs = F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b([A-Z]+-[0-9]+)\b"), F.lit(1)))
    return found.union(rows).withColumns({"xrefs": xrefs, "tokens": token_estimate(F.col("body"))})


def cells_of(line: Column) -> Column:
    """Cells of a table row; an escaped bar doesn't part cells."""
    inner = F.regexp_replace(F.regexp_replace(F.replace(F.trim(line), F.lit("\\|"), F.lit("\u0001")), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.replace(F.trim(c), F.lit("\u0001"), F.lit("|")))


def table_rows(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, table_no, line_no, header, cells: the data rows of tables. A table is a run of neighbouring lines with bars,
    outside comments and fences; its first line is the header and separator lines are left out."""
    separator = r"^[\s|:-]+$"
    df = tables(docs, key, uncommented(marked(F.col(text)))).select(key, "table_no", F.get("rows", F.lit(0)).line.alias("head"), F.explode(F.slice("rows", 2, F.size("rows"))).alias("r"))
    return df.where(~F.col("r.line").rlike(separator)).select(key, "table_no", "r.line_no", cells_of(F.col("head")).alias("header"), cells_of(F.col("r.line")).alias("cells"))


def tables(docs: DataFrame, key: str, ls: Column) -> DataFrame:
    """key, table_no, rows: runs of neighbouring lines with bars outside fences, among the lines of an array."""
    bars = F.filter(ls, lambda x: x.line.rlike(r"^\s*\|") & ~x.in_fence)
    return docs.select(key, F.posexplode(runs(bars)).alias("_t", "rows")).select(key, (F.col("_t") + 1).alias("table_no"), "rows")


def drafts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Draft lines: captures in comments that begin with a tag in brackets, and plain lines outside comments, tables
    and headings."""
    df = comments(lines(docs, [key], text), [key])
    tagged = F.regexp_extract("line", r"<!-- *(\[[A-Z]\][^>]*?) *-->", 1)
    plain = ~F.col("in_comment") & ~F.col("line").rlike(r"^\s*(\||#|$)")
    return df.select(key, "line_no", F.when(tagged != "", tagged).when(plain, F.trim("line")).alias("draft")).where("draft is not null")


def blocks(docs: DataFrame, key: str, text: str = "text", least: int = 12, keep: int = 300) -> DataFrame:
    """Heading blocks of least characters or more, their first keep characters."""
    return sections(docs, key, text).where(F.length(F.trim("body")) >= least).select(key, "section_no", "title", F.substring(F.trim("body"), 1, keep).alias("block"))
