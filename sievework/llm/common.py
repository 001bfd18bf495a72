"""What the operators for training data share: folding, scratch tables, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table for the same folding.
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
WORD_WS = r"[^\x20\x09-\x0D]+"
GAP_WS = r"[\x20\x09-\x0D]+"
WORD_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

__all__ = ["StorageLevel"]


def fold(c: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column, gap: str = GAP_WS, folded: bool = True) -> Column:
    """Array of the words of a text; null and empty texts have none."""
    c = F.coalesce(c, F.lit(""))
    return F.filter(F.split(fold(c) if folded else c, gap), lambda w: w != "")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; a temporary one where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='scratch-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """Tables written to the shared folder. They cut lineage, so that a lost executor costs one stage,
    and they carry exact statistics, so that Spark's own rules choose broadcasts and split skewed joins."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n}-{name}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """df marked for broadcast if it holds at most max_rows rows and 64 bytes for each of so many; otherwise as it is,
    for a shuffled join. Rows and bytes are summed up where they lie; one row comes to the driver."""
    wide, fixed = [], 0
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            wide.append(F.octet_length(c))
        elif kind == "array":
            of = f.dataType.elementType.typeName()
            wide.append(F.octet_length(F.array_join(c, "")) if of in ("string", "binary") else F.size(c) * 8)
        fixed += 8
    size = sum((F.coalesce(x, F.lit(0)).cast("long") for x in wide), F.lit(fixed).cast("long"))
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and total <= 64 * max_rows else df


def arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what one Arrow batch holds, as texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
