"""Sharding by extendible hashing, with DataFrame functions only.

A shard holds the rows whose hash begins with its prefix of bits. Only a shard above the byte limit is split, on one
more bit, until every shard fits. The directory maps a hash prefix of fixed length to the shard that it lies in.
Sums of bytes by prefix are all that is shuffled; documents find their shard by a look-up in the directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sievework.llm.common import Scratch, small

BITS = 60
LIMIT_BYTES = 1 << 20
#: Ranges by which repeated rows are numbered.
CELLS = 4096


def _hash(id_col: str, text_col: str):
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.md5(text))), 1, 15), 16, 10).cast("long")


def _prefix(h, depth: int):
    return F.shiftright(h, BITS - depth) if depth else F.lit(0).cast("long")


def directory(rows: DataFrame, limit: int, scratch: Scratch) -> list[tuple[int, DataFrame]]:
    """rows (h, bytes) -> [(bits, table)], one for each round: cell (the first bits of h), depth, prefix, shard_bytes.
    A round looks some bits further than the shards need on average; only prefixes still above the limit go on."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    bits, found, open_ = min(BITS, max(0, -(-total // limit) - 1).bit_length() + 3), [], None
    while True:
        cell = _prefix(F.col("h"), bits)
        part = rows
        if open_ is not None:
            was, table = open_
            part = rows.join(small(table.select(F.col("cell").alias("ocell")), 1_000_000), _prefix(F.col("h"), was) == F.col("ocell"), "left_semi")
        cells = scratch.keep(part.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi")), "cells")
        start = 0 if open_ is None else was + 1
        # every depth at once: a shard is the shortest prefix that fits, or that holds one hash only
        deep = cells.select("*", F.explode(F.sequence(F.lit(start), F.lit(bits))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
        nodes = deep.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        fits = scratch.keep(nodes.where((F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi"))).select("depth", "prefix", "shard_bytes"), "fits")
        both = (deep.depth == F.col("fd")) & (deep.prefix == F.col("fp"))
        named = deep.join(small(fits.select(F.col("depth").alias("fd"), F.col("prefix").alias("fp"), "shard_bytes"), 1_000_000), both).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("s"))
        table = scratch.keep(named.select("cell", "s.*"), "directory")
        found.append((bits, table))
        left = scratch.keep(cells.join(table.select(F.col("cell").alias("tcell")), F.col("cell") == F.col("tcell"), "left_anti").select("cell"), "open")
        if bits == BITS or left.limit(1).count() == 0:
            return found
        open_, bits = (bits, left), min(BITS, bits + 6)


def shard(docs: DataFrame, limit: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with bytes (of the UTF-8 text), depth and prefix (the shard: so many first bits of the hash),
    shard_bytes and part. Columns of these names in docs are replaced.

    The hash is of id and text, null as empty. A null text has 0 bytes. A row above the limit is a shard of its own.
    Rows that repeat both id and text cannot be told apart by bits: where they alone exceed the limit, part numbers
    the full pieces they are cut into, the last one perhaps less than full; elsewhere it is 0. An empty table gives an empty result."""
    scratch = Scratch(docs.sparkSession, "shards")
    keep = [c for c in docs.columns if c not in ("bytes", "depth", "prefix", "shard_bytes", "part")]
    sized = docs.select(*[F.col(f"`{c}`") for c in keep], F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("bytes"), _hash(id_col, text_col).alias("_h"))
    rows = scratch.keep(sized.select(F.col("_h").alias("h"), "bytes"), "hashes")
    out = None
    for bits, table in directory(rows, limit, scratch):
        entry = table.select(F.col("cell").alias("_cell"), "depth", "prefix", "shard_bytes")
        some = sized.join(small(entry, 1_000_000), _prefix(F.col("_h"), bits) == F.col("_cell")).drop("_cell")
        out = some if out is None else out.unionByName(some)
    alike = scratch.keep(rows.groupBy("h").agg(F.sum("bytes").alias("b"), F.count("*").alias("c")).where((F.col("b") > limit) & (F.col("c") > 1)).select(F.col("h").alias("_same")), "alike")
    if alike.limit(1).count() == 0:
        return out.drop("_h").withColumn("part", F.lit(0).cast("long"))
    # rows of one hash have one id and text: which of them is in which piece doesn't matter, so they are numbered in
    # ranges, and a row repeated without end is no single task's work
    hot = out.join(small(alike, 1_000_000), F.col("_h") == F.col("_same")).drop("_same")
    hot = scratch.keep(hot.withColumn("_cell", F.pmod(F.monotonically_increasing_id(), F.lit(CELLS))), "hot")
    starts = hot.groupBy("_h", "_cell").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("_h").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    starts = scratch.keep(starts.select(F.col("_h").alias("_sh"), F.col("_cell").alias("_sc"), "_before"), "starts")
    hot = hot.join(small(starts, 1_000_000), (F.col("_h") == F.col("_sh")) & (F.col("_cell") == F.col("_sc"))).drop("_sh", "_sc")
    fit = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1))))
    number = F.col("_before") + F.row_number().over(W.partitionBy("_h", "_cell").orderBy("bytes")) - 1
    hot = hot.withColumn("part", F.floor(number / fit)).drop("_cell", "_before")
    pieces = scratch.keep(hot.groupBy("_h", "part").agg(F.sum("bytes").alias("_bytes")).select(F.col("_h").alias("_sh"), F.col("part").alias("_sp"), "_bytes"), "pieces")
    hot = hot.drop("shard_bytes").join(small(pieces, 1_000_000), (F.col("_h") == F.col("_sh")) & (F.col("part") == F.col("_sp"))).withColumn("shard_bytes", F.col("_bytes")).drop("_sh", "_sp", "_bytes")
    rest = out.join(small(alike, 1_000_000), F.col("_h") == F.col("_same"), "left_anti").withColumn("part", F.lit(0).cast("long"))
    return rest.unionByName(hot).drop("_h")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One Parquet folder for each shard, each written by one task, named by depth, prefix and part."""
    sharded.repartition("depth", "prefix", "part").write.partitionBy("depth", "prefix", "part").parquet(path)


ORACLE_SQL = r"""
WITH rows AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes,
         CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS h
  FROM documents),
nodes AS (SELECT d AS depth, h >> CAST(60 - d AS BIGINT) AS prefix, CAST(sum(bytes) AS BIGINT) AS shard_bytes, min(h) = max(h) AS one
          FROM rows, range(0, 41) t(d) GROUP BY 1, 2),
fit AS (SELECT depth, prefix, shard_bytes FROM nodes WHERE shard_bytes <= {limit} OR one),
pick AS (SELECT r.doc_id, r.bytes, r.h, min(f.depth) AS depth FROM rows r JOIN fit f ON f.prefix = r.h >> CAST(60 - f.depth AS BIGINT) GROUP BY ALL)
SELECT p.doc_id, p.bytes, CAST(p.depth AS INTEGER) AS depth, f.prefix, f.shard_bytes, CAST(0 AS BIGINT) AS part
FROM pick p JOIN fit f ON f.depth = p.depth AND f.prefix = p.h >> CAST(60 - p.depth AS BIGINT)
"""
