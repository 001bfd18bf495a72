"""Benchmark decontamination by winnowing, with DataFrame functions only.

Both sides hash their k-grams of words and keep, for each window of w consecutive k-grams, the smallest hash. Any
span of w + k - 1 shared words holds the same window on both sides and so the same smallest hash: no shared span of
that length is missed. Fingerprints are joined; a hit is extended to the windows that the fingerprint stands for,
and only equal windows count.

A run of neighbouring windows with one and the same smallest hash is one fingerprint, with the k-gram hashes of the
run beside it. A window of w + k - 1 words is named by the hashes of its first and last k-gram, which cover it
(2k >= w + k - 1), so a fingerprint carries all that extending needs and texts are read and cut once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import GAP_ALNUM, Scratch, small, words

SPAN, GRAM = 8, 5
#: Benchmark fingerprints up to this many are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 2_000_000


def _gram(w: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(w, i + j) for j in range(k)])


def _shift(a: Column, start: int, less: int) -> Column:
    return F.slice(a, start, F.greatest(F.size(a) - less, F.lit(0)))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fingerprints(w: Column, span: int, gram: int) -> Column:
    """Array of (v smallest hash, s first window, hs k-gram hashes of the run) of the words w."""
    width = span - gram + 1

    def runs(h: Column, m: Column, at: Column) -> Column:
        return F.transform(at, lambda i, j: F.struct(F.get(m, i).alias("v"), i.alias("s"), F.slice(h, i + 1, F.coalesce(F.get(at, j + 1), F.size(m)) - i + width - 1).alias("hs")))

    def smallest(m: Column, have: int, then) -> Column:
        if have == width:
            return then(m)
        step = min(have, width - have)  # of 1, 2, 4 ... neighbours, the last step overlapping
        return let(F.zip_with(_shift(m, 1, step), _shift(m, step + 1, step), lambda a, b: F.least(a, b)), lambda x: smallest(x, have + step, then))

    starts = lambda m: F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - gram), lambda i: _gram(w, i, gram))
    found = let(grams, lambda h: smallest(h, 1, lambda m: let(starts(m), lambda at: runs(h, m, at))))
    return F.when(F.size(w) >= span, found).otherwise(F.array().cast("array<struct<v:bigint,s:int,hs:array<bigint>>>"))


def short_grams(w: Column, n: int) -> Column:
    """Array like fingerprints(), of every n-gram of the words w as one window."""
    one = lambda i: F.struct(F.xxhash64(F.lit(n), F.slice(w, i + 1, n)).alias("v"), i.alias("s"), F.array(F.lit(n).cast("long")).alias("hs"))
    return F.transform(F.sequence(F.lit(0), F.size(w) - n), one)


def _windows(hs: Column, span: int, gram: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(hs) - (span - gram) - 1), lambda j: F.xxhash64(F.get(hs, j), F.get(hs, j + span - gram)))


def winnow(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 for each document.

    A word is hit inside any occurrence of an item's window of span words; an item of fewer words, but not none, is
    one window. Null and empty texts have no words and no hits. Each row of docs gives one; rows that repeat a doc_id are
    judged by their own text each. Items without an item_id are ignored, items that share one
    are one item. Other columns are ignored, whatever their names. Empty tables on either side are fine."""
    assert 2 * gram >= span > gram
    scratch = Scratch(docs.sparkSession, "winnow")
    bench = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col), GAP_ALNUM).alias("w"))
    long = bench.where(F.size("w") >= span).select("item", F.explode(fingerprints(F.col("w"), span, gram)).alias("f"))
    long = long.select("item", F.lit(span).alias("len"), F.col("f.v").alias("v"), F.explode(_windows(F.col("f.hs"), span, gram)).alias("x"))
    brief = bench.where((F.size("w") < span) & (F.size("w") > 0)).select("item", F.size("w").alias("len"), F.xxhash64(F.size("w"), "w").alias("v"), F.lit(0).cast("long").alias("x"))
    windows = scratch.keep(long.union(brief).distinct(), "windows")
    lengths = [r[0] for r in windows.where(F.col("len") < span).select("len").distinct().sort("len").collect()]  # span - 1 numbers at most
    marks = scratch.keep(windows.select("v").distinct(), "marks")

    none = F.array(F.struct(F.lit(None).cast("long").alias("v"), F.lit(-1).alias("s"), F.array(F.lit(0).cast("long")).alias("hs")))

    def marked(w: Column) -> Column:
        # the first row stands for the document and counts its words; short items look up every n-gram of their length
        parts = [F.array(F.struct(F.lit(None).cast("long").alias("v"), F.lit(-1).alias("s"), F.array(F.size(w).cast("long")).alias("hs"))), fingerprints(w, span, gram)]
        for n in lengths:
            parts.append(F.when(F.size(w) >= n, short_grams(w, n)).otherwise(F.slice(none, 1, 0)))
        return F.concat(*parts)

    cut = docs.select(F.col(doc_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.explode(let(words(F.col(text_col), GAP_ALNUM), marked)).alias("f"))
    rows = cut.select("doc_id", "th", F.coalesce("f.v", F.xxhash64("doc_id", "th")).alias("v"), "f.s", "f.hs")
    met = small(marks.select(F.col("v").alias("mv"), F.lit(True).alias("met")), BROADCAST_ROWS)
    found = scratch.keep(rows.join(met, rows.v == F.col("mv"), "left").where("s < 0 or met").drop("mv", "met"), "found")

    known = windows.select(F.col("v").alias("wv"), F.col("x").alias("wx"), F.col("len")).distinct()
    wide = found.where(f"s >= 0 and size(hs) >= {span - gram + 1}").select("doc_id", "th", "v", "s", F.posexplode(_windows(F.col("hs"), span, gram)).alias("j", "x")).select("doc_id", "th", "v", (F.col("s") + F.col("j")).alias("s"), "x")
    brief = found.where("s >= 0 and size(hs) = 1").select("doc_id", "th", "v", "s", F.lit(0).cast("long").alias("x"))
    hits = wide.union(brief)
    hits = scratch.keep(hits.join(small(known, BROADCAST_ROWS), (hits.v == F.col("wv")) & (hits.x == F.col("wx"))).select("doc_id", "th", "v", "x", "s", "len").distinct(), "hits")
    cover = F.size(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("s", "len")), lambda p: F.sequence(p.s, p.s + p.len - 1)))))
    covered = hits.groupBy("doc_id", "th").agg(cover.cast("long").alias("n_hit"), F.lit(None).cast("array<string>").alias("items"))
    # a window is named by the set of items that hold it, and a document takes each set once, however many windows name it
    owners = windows.groupBy(F.col("v").alias("wv"), F.col("x").alias("wx")).agg(F.sort_array(F.collect_set("item")).alias("items"))
    owners = scratch.keep(owners.withColumn("set", F.sha2(F.to_json("items"), 256)), "owners")
    sets = owners.groupBy(F.col("set").alias("_set")).agg(F.first("items").alias("items"))
    named = hits.join(small(owners.select("wv", "wx", "set"), BROADCAST_ROWS), (hits.v == F.col("wv")) & (hits.x == F.col("wx"))).select("doc_id", "th", "set").distinct()
    named = named.join(small(sets, BROADCAST_ROWS), F.col("set") == F.col("_set")).groupBy("doc_id", "th").agg(F.lit(None).cast("long").alias("n_hit"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    base = found.where("s < 0").select("doc_id", "th", F.lit(1).alias("rows"), F.get("hs", F.lit(0)).alias("n_words"), F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("array<string>").alias("items"))
    rest = covered.unionByName(named).withColumns({"n_words": F.lit(None).cast("long"), "rows": F.lit(0)})
    whole = base.unionByName(rest).groupBy("doc_id", "th").agg(F.sum("rows").cast("int").alias("rows"), F.max("n_words").alias("n_words"), F.coalesce(F.max("n_hit"), F.lit(0).cast("long")).alias("n_hit"), F.coalesce(F.first("items", True), F.array().cast("array<string>")).alias("items"))
    whole = whole.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return whole.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), F.col("th").alias("text_hash"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 8) AS n, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS x
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, text, n, i, array_to_string(w[i : i + n - 1], ' ') AS x
       FROM (SELECT doc_id, text, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, text, i, n, item FROM dw JOIN bw USING (n, x)),
c AS (SELECT doc_id, text, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, text, unnest(range(i, i + n)) AS p FROM h) GROUP BY ALL),
t AS (SELECT doc_id, text, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY ALL)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(len(items), 0) >= 2 AS contaminated
FROM d LEFT JOIN c ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.text IS NOT DISTINCT FROM c.text
       LEFT JOIN t ON d.doc_id IS NOT DISTINCT FROM t.doc_id AND d.text IS NOT DISTINCT FROM t.text
"""
