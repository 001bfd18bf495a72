"""Audit of files as they arrive: an extension, as the programs that it stands for run in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.rules import Rule, scan


def audit_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, rules: list[Rule], key: list[str], lang: str = "lang", text: str = "text", once: bool = True):
    """Scans new Parquet files below source and writes findings to sink, each micro-batch to a folder of its own, so
    that a batch that is tried again replaces what it wrote. Returns the query."""

    def each(batch: DataFrame, number: int) -> None:
        scan(batch, rules, key, lang, text, blank=True).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling windows; on a stream late rows are dropped beyond the watermark."""
    df = events.withWatermark(ts, late) if events.isStreaming else events
    return df.groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
