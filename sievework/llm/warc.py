"""WARC as a PySpark Python data source: spark.read.format("warc"), df.write.format("warc").

Reading plans partitions over files, takes predicates on the record type and on headers into the scan, parses a
record's headers first and goes past the payload by its length where no column needs it. Writing gives each task a
file of its own in a temporary folder; the commit moves the files of successful tasks into place, so lost executors
and repeated attempts leave nothing behind. Payloads may be stored with a gzip content encoding, which a reader that
doesn't want the payload never undoes. Paths go through pyarrow's file systems, so any store that it knows will do.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from sievework.llm.common import Scratch, arrow_batches, small

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes bigint, content_length bigint, headers map<string,string>, payload binary"
#: Fixed names of the format.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Extension header with the length of the payload before any content encoding.
LENGTH = "X-Payload-Length"
PLANNED_BYTES, FILE_BYTES, SPLIT_ROWS = 128 << 20, 128 << 20, 10_000
#: Fixed alphabet of base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def file_system(path: str):
    return pafs.FileSystem.from_uri(path if re.match(r"[A-Za-z][\w+.-]*:/", path) else f"file://{path}")


@dataclass
class Files(D.InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        self.paths = paths


@dataclass
class Written(D.WriterCommitMessage):
    paths: list[str]


class WarcSource(D.DataSource):
    """Options: path; compress (true) on writing: store payloads with a gzip content encoding."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], self.options.get("compress", "true").lower() == "true", overwrite)


def holds(f, values: dict) -> bool:
    """A pushed filter on a record's columns, with SQL's meaning of null."""
    v = values.get(f.attribute[0])
    if isinstance(f, D.IsNull):
        return v is None
    if isinstance(f, D.IsNotNull):
        return v is not None
    if isinstance(f, D.EqualNullSafe):
        return v == f.value
    if v is None:
        return False
    if isinstance(f, D.EqualTo):
        return v == f.value
    if isinstance(f, D.In):
        return v in f.value
    if isinstance(f, D.StringStartsWith):
        return v.startswith(f.value)
    if isinstance(f, D.StringEndsWith):
        return v.endswith(f.value)
    return f.value in v  # StringContains


TAKEN = (D.IsNull, D.IsNotNull, D.EqualNullSafe, D.EqualTo, D.In, D.StringStartsWith, D.StringEndsWith, D.StringContains)


class WarcReader(D.DataSourceReader):
    """A schema without payload never decodes one; a schema without headers builds no maps."""

    def __init__(self, path: str, schema):
        self.path, self.names, self.filters = path, schema.fieldNames(), []
        self.arrow = [{"bigint": pa.int64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}.get(f.dataType.simpleString(), pa.string()) for f in schema.fields]

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, TAKEN) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        """Small files share a partition, up to PLANNED_BYTES."""
        fs, at = file_system(self.path)
        info = fs.get_file_info(at)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(at, allow_not_found=True, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and re.search(r"\.warc(\.gz)?$", f.path) and "/_temporary" not in f.path)
        out, room = [], 0
        for path, size in files:
            if size > room or not out:
                out.append([])
                room = PLANNED_BYTES
            out[-1].append(path)
            room -= size
        return [Files(x) for x in out] or [Files([])]

    def read(self, partition):
        fs, _ = file_system(self.path)
        rows, room = [], 16 << 20
        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                f = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
                for row, size in self.records(f):
                    rows.append(row)
                    room -= size
                    if room < 0 or len(rows) >= SPLIT_ROWS:
                        yield self.batch(rows)
                        rows, room = [], 16 << 20
        if rows:
            yield self.batch(rows)

    def batch(self, rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(self.arrow)], self.names)

    def records(self, f):
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                if line.strip():
                    raise ValueError(f"not a WARC record: {line[:60]!r}")
                continue
            raw = parse_headers(f)
            low = {k.lower(): v for k, v in raw}
            length = int(low["content-length"])
            values = {c: low.get(h.lower()) for c, h in HEADERS.items()}
            if not all(holds(x, values) for x in self.filters):
                f.seek(length, 1)
                continue
            payload = None
            if "payload" in self.names:
                payload = decode(f.read(length), low.get("content-type", ""))
            else:
                f.seek(length, 1)
            size = low.get(LENGTH.lower())
            values |= {"payload_bytes": int(size) if size is not None else None, "content_length": length, "headers": raw if "headers" in self.names else None, "payload": payload}
            yield tuple(values.get(n) for n in self.names), 500 + len(payload or b"")


def parse_headers(f) -> list[tuple[str, str]]:
    """Name and value of each line up to the empty one; folded lines are joined, a repeated name keeps the last."""
    out: dict[str, str] = {}
    last = None
    while (line := f.readline()) and line.strip():
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[0] in " \t" and last:
            out[last] += " " + text.strip()
        elif ":" in text:
            last, _, value = text.partition(":")
            out[last] = value.strip()
    return list(out.items())


def decode(block: bytes, kind: str) -> bytes:
    """The payload of a block: after the HTTP headers, with a gzip content encoding undone."""
    if not kind.startswith("application/http"):
        return block
    head, _, body = block.partition(b"\r\n\r\n")
    return gzip.decompress(body) if b"content-encoding: gzip" in head.lower() and body else body


def clean(v) -> str:
    """A header's value in one line: control characters percent-encoded."""
    return re.sub(r"[\x00-\x1F\x7F]", lambda m: f"%{ord(m[0]):02X}", str(v))


def record(row: dict, compress: bool) -> bytes:
    """row: record_type, record_id, target_uri, date, payload_digest, refers_to, payload_bytes, payload (None on revisits)."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\n"
    body = row["payload"] or b""
    if body and compress:
        body = gzip.compress(body, 1, mtime=0)
        http += b"Content-Encoding: gzip\r\n"
    block = http + b"\r\n" + body
    head = ["WARC/1.1", *(f"{h}: {clean(row[c])}" for c, h in HEADERS.items() if row.get(c) is not None)]
    if row["record_type"] == "revisit":
        head.append(f"WARC-Profile: {PROFILE}")
    head += [f"{LENGTH}: {row['payload_bytes']}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcWriter(D.DataSourceArrowWriter):
    def __init__(self, path: str, compress: bool, overwrite: bool):
        self.path, self.compress, self.overwrite = path, compress, overwrite
        self.temporary = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator):
        fs, at = file_system(self.path)
        fs.create_dir(f"{at}/{self.temporary}", recursive=True)
        done, out = [], None
        try:
            for b in iterator:
                for row in b.to_pylist():
                    if out is None:
                        done.append(f"{at}/{self.temporary}/part-{uuid.uuid4().hex}.warc")
                        out = fs.open_output_stream(done[-1], buffer_size=1 << 20)
                    out.write(record(row, self.compress))
                    if out.tell() >= FILE_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(done)

    def commit(self, messages):
        fs, at = file_system(self.path)
        fs.create_dir(at, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(at)):
                if f.is_file:
                    fs.delete_file(f.path)
        for path in (p for m in messages if m for p in m.paths):
            fs.move(path, f"{at}/{path.rpartition('/')[2]}")
        self.abort(messages)

    def abort(self, messages):
        fs, at = file_system(self.path)
        if fs.get_file_info(f"{at}/{self.temporary}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{at}/{self.temporary}")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    arrow_batches(spark)
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame, scratch: Scratch, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Rows for the writer. Of pages with equal payloads of least_bytes or more the one with the smallest page_id is
    the response and the others revisit it; all else are responses. Null html is an empty payload, a null url gives no
    target. A null page_id revisits like any other, and is a response where no payload like it has an id; rows that
    repeat the smallest id with its payload are responses too. Other columns are ignored."""
    five = lambda sha, i: F.conv(F.substring(sha, 5 * (i // 4) + 1, 5), 16, 10).cast("long")  # noqa: E731  20 bits, four letters
    base32 = lambda c: F.concat(*[F.substring(F.lit(BASE32), F.shiftright(five(F.col(c), i), 15 - 5 * (i % 4)).bitwiseAND(31).cast("int") + 1, F.lit(1)) for i in range(32)])
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    pages = pages.select("page_id", F.col("url").cast("string").alias("target_uri"), html.alias("payload"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("sha"))
    first = pages.where(F.col("payload_bytes") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    first = scratch.keep(first.select(F.col("sha").alias("_sha"), "first"), "first")
    df = pages.join(small(first, 1_000_000), F.col("sha") == F.col("_sha"), "left").withColumn("again", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return df.select(
        F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"),
        name(F.col("page_id")).alias("record_id"),
        "target_uri",
        F.lit(date).alias("date"),
        F.concat(F.lit("sha1:"), base32("sha")).alias("payload_digest"),
        F.when(F.col("again"), name(F.col("first"))).alias("refers_to"),
        "payload_bytes",
        F.when(~F.col("again"), F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    spark = pages.sparkSession
    register(spark)
    page_records(pages, Scratch(spark, "warc"), least_bytes).write.format("warc").mode("append").save(path)


def page_index(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of archives, read from headers alone."""
    register(spark)
    index = spark.read.format("warc").schema("record_type string, record_id string, payload_digest string, refers_to string, payload_bytes bigint").load(path)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) as bigint)")
    index = index.where(F.col("record_type").isin("response", "revisit"))
    return index.select(number("record_id").alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(s, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM p
"""
