"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target number of words. Its weight over training time t in [0, 1] is target * (1 + ramp * (2t - 1));
the integral up to t is its cumulative demand. A source's documents stand in an order of their own (by hash), their
words cover that demand one after the other, and the inverse of the demand at a document's middle is the time at which
it is trained on. Range-sorting the copies by that time gives the order of training, in which each has its place.

Cumulative words come from sums over hash ranges, so that no source, however large, is summed up in one task; places
come from the rows of the sorted ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sievework.llm.common import WORD_WS, Scratch, small

WEIGHTS, CAP = (1, 2, 3), 3
#: For each weight in turn: how its share changes along training; negative fades, positive grows.
RAMPS = (-0.5, 0.0, 0.5)
RANGE_ROWS = 256


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP, ramps=RAMPS) -> DataFrame:
    """sizes (source, source_size) with a row for each source -> target, ramp too. The sum of all sizes is shared by
    weight; a source's target stops at cap times its size and the excess is reshared until none is above. The windows
    run over one row for each source."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), ((F.col("rn") - 1) % len(values) + 1).cast("int"))
    df = sizes.withColumn("rn", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")))
    df = df.withColumns({"weight": pick(weights), "ramp": pick(ramps)}).withColumn("total", F.sum("source_size").over(W.partitionBy()))
    # sources reach their cap in the order of size by weight
    full = W.orderBy(F.col("source_size") / F.col("weight"), "rn")
    df = df.withColumns({"before": F.coalesce(F.sum("source_size").over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "after": F.sum("weight").over(full.rowsBetween(0, W.unboundedFollowing))})
    df = df.withColumn("capped", cap * F.col("source_size") * F.col("after") <= F.col("weight") * (F.col("total") - cap * F.col("before")))
    df = df.withColumns({"full": F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))).over(W.partitionBy()), F.lit(0)), "rest": F.sum(F.when(~F.col("capped"), F.col("weight"))).over(W.partitionBy())})
    target = F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise((F.col("weight") * (F.col("total") - cap * F.col("full"))).cast("double") / F.col("rest").cast("double"))
    return df.select("source", "source_size", target.alias("target"), "ramp")


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, ramps=RAMPS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, first_position, first_place, and copies, th, source, start, ramp for
    materialise(); a row for each of docs, in the order of training by its first copy, rows that aren't taken last.

    Each source takes floor(target / size) copies of everything, then one more of the documents that come first in its
    order, up to the remainder: what it takes is within half a document of its target. Null and empty texts have
    size 0 and are taken 0 times their size; a null source is a source of its own, the last. Rows that repeat doc_id
    and text stand side by side in the order and are told apart by nothing else; null doc_ids are ordinary ids. The
    order is by md5 of doc_id and text, so reruns agree. A source without words has target 0 and first_position null,
    as has a document that isn't taken; first_place is null for the latter alone. Other columns are ignored. An empty
    table gives an empty result."""
    each = sequence(docs, weights, cap, ramps, id_col, text_col, source_col).where("coalesce(copy, 0) = 0")
    first = F.when((F.col("copies") > 0) & (F.col("target") > 0), F.col("position"))
    each = each.repartitionByRange("place").sortWithinPartitions("place")
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), first.alias("first_position"), F.when(F.col("copies") > 0, F.col("place")).alias("first_place"), "copies", "th", "source", "start", "ramp")


def sequence(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, ramps=RAMPS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each copy that the mix takes: copy (from 0) of doc_id, size, source_size, target, copies, th, source,
    start, ramp, its position in [0, 1] and its place, from 0, in the order of training. Copies of one position stand by
    th, source, copy; those of a source without words have position 1. A document that isn't taken has one row with
    copy and position null, at a place after all copies."""
    scratch = Scratch(docs.sparkSession, "sequence")
    rows = planned(docs, weights, cap, ramps, id_col, text_col, source_col)
    copies = F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    rows = rows.withColumn("copy", F.explode_outer(copies))
    rows = rows.withColumn("position", F.when(F.col("copy").isNotNull(), F.coalesce(F.when(F.col("target") > 0, position(F.col("copy"))), F.lit(1.0))))
    by = [F.col(c).asc_nulls_last() for c in ("position", "th", "source", "copy", "start", "doc_id")]
    ranked = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    # the number of a row in its range; ranges are numbered in their order
    ranked = ranked.withColumns({"prange": F.spark_partition_id(), "pnumber": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    ranked = scratch.keep(ranked, "ranked")
    before = F.coalesce(F.sum("n").over(W.orderBy("orange").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = ranked.groupBy(F.col("prange").alias("orange")).agg(F.count("*").alias("n")).select("orange", before.alias("before"))
    ranked = ranked.join(F.broadcast(offsets), F.col("prange") == F.col("orange")).withColumn("place", F.col("before") + F.col("pnumber"))
    return ranked.drop("prange", "pnumber", "orange", "before")


def planned(docs: DataFrame, weights, cap: int, ramps, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, size, source_size, target, copies, th, source, start, ramp: how often each row of docs is taken, and the
    words of its source before it."""
    scratch = Scratch(docs.sparkSession, "mix")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.md5(text)))
    base = scratch.keep(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD_WS)).cast("long").alias("size"), key.alias("th")), "sizes")
    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sums = scratch.keep(sums, "sums")
    largest = sums.agg(F.max("n")).first()[0] or 1
    bits = min(20, max(0, (largest // RANGE_ROWS).bit_length()))
    ranged = base.withColumn("cell", F.conv(F.substring("th", 1, 8), 16, 10).cast("long").bitwiseAND(0xFFFFFFFF))
    ranged = ranged.withColumn("cell", F.shiftright("cell", 32 - bits).cast("int"))
    cells = ranged.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    upto = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = scratch.keep(cells.select(F.col("source").alias("csource"), F.col("cell").alias("ccell"), upto.alias("upto")), "cells")
    goal = scratch.keep(targets(sums.select("source", "source_size"), weights, cap, ramps).withColumnRenamed("source", "gsource"), "targets")
    within = F.coalesce(F.sum("size").over(W.partitionBy("source", "cell").orderBy("th", "size", "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = ranged.withColumn("within", within)
    rows = rows.join(small(cells, 1_000_000), F.col("source").eqNullSafe(F.col("csource")) & (F.col("cell") == F.col("ccell")))
    rows = rows.join(small(goal, 1_000_000), F.col("source").eqNullSafe(F.col("gsource"))).withColumn("start", F.col("upto") + F.col("within"))
    size = F.col("source_size").cast("double")
    rows = rows.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long"))
    more = (F.col("start") + F.col("size") / 2.0) <= (F.col("target") - F.col("whole") * size)
    rows = rows.withColumn("copies", F.when(more & (F.col("whole") < cap), F.col("whole") + 1).otherwise(F.col("whole")))
    return rows.select("doc_id", "size", "source_size", "target", "copies", "th", "source", "start", "ramp")


def position(copy):
    """Time in [0, 1] at which a copy is trained on: the inverse of its source's demand, r t^2 + (1 - r) t, at the
    share of the target that lies before the copy's middle."""
    q = F.least(F.lit(1.0), (copy * F.col("source_size") + F.col("start") + F.col("size") / 2.0) / F.col("target"))
    r = F.col("ramp")
    return F.when(r == 0, q).otherwise((r - 1 + F.sqrt((1 - r) * (1 - r) + 4 * r * q)) / (2 * r))


def materialise(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_position: bool = False) -> DataFrame:
    """The rows of docs, each as often as mix() takes it, range-sorted by position. Rows that repeat id, text and
    source are taken as one row, with the smallest columns, as often as all of them."""
    scratch = Scratch(docs.sparkSession, "mixed")
    plan = scratch.keep(mixed.where("copies > 0").select("source", "th", "size", "copies", "source_size", "start", "target", "ramp"), "plan")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    left = docs.withColumns({"_key": F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.md5(text))), "_source": F.col(source_col)})
    again = scratch.keep(plan.groupBy("th", "source").count().where("count > 1").select(F.col("th").alias("_ath"), F.col("source").alias("_asource")), "again")
    if again.limit(1).count():
        same, few = (F.col("_key") == F.col("_ath")) & F.col("_source").eqNullSafe(F.col("_asource")), small(again, 400_000)
        one = left.join(few, same, "left_semi").groupBy("_key", "_source").agg(F.min(F.struct(*docs.columns)).alias("s")).select("s.*", "_key", "_source")
        left = left.join(few, same, "left_anti").unionByName(one)
    plan = plan.select(F.col("th").alias("_th"), F.col("source").alias("_of"), "size", "source_size", "start", "target", "ramp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    plan = plan.select("_th", "_of", F.coalesce(F.when(F.col("target") > 0, position(F.col("copy"))), F.lit(1.0)).alias("_at"))
    out = left.join(small(plan, 400_000), (F.col("_key") == F.col("_th")) & F.col("_source").eqNullSafe(F.col("_of"))).drop("_key", "_th", "_source", "_of").repartitionByRange("_at").sortWithinPartitions("_at")
    return out.withColumnRenamed("_at", "position") if keep_position else out.drop("_at")


ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', md5(coalesce(text, '')))) AS th
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") AS rn, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s0),
s2 AS (SELECT *, (rn - 1) % 3 + 1 AS weight, ((rn - 1) % 3 - 1) * CAST(0.5 AS DOUBLE) AS ramp FROM s1),
s3 AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM s2),
s4 AS (SELECT *, 3 * source_size * after <= weight * (total - 3 * before) AS capped FROM s3),
s5 AS (SELECT *, coalesce(sum(source_size) FILTER (capped) OVER (), 0) AS filled, sum(weight) FILTER (NOT capped) OVER () AS rest FROM s4),
s6 AS (SELECT source, source_size, ramp, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(weight * (total - 3 * filled) AS DOUBLE) / CAST(rest AS DOUBLE) END AS target FROM s5),
r AS (SELECT b.*, coalesce(CAST(sum(size) OVER (PARTITION BY b.source ORDER BY th, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start, source_size, ramp, target
      FROM base b JOIN s6 ON b.source IS NOT DISTINCT FROM s6.source),
w AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / CAST(source_size AS DOUBLE)) AS BIGINT) ELSE 0 END AS whole FROM r),
c AS (SELECT *, CASE WHEN start + CAST(size AS DOUBLE) / 2 <= target - whole * CAST(source_size AS DOUBLE) AND whole < 3 THEN whole + 1 ELSE whole END AS copies,
        least(1.0::DOUBLE, (start + CAST(size AS DOUBLE) / 2) / nullif(target, 0)) AS q FROM w)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken,
       CASE WHEN copies > 0 AND target > 0 THEN CASE WHEN ramp = 0 THEN q ELSE (ramp - 1 + sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * q)) / (2 * ramp) END END AS first_position
FROM c
"""
