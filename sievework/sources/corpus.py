"""Corpora as tables: files, lines, samples of files, JSON settings."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.text import module_of, posix_normal

#: Fixed limits and names of the scans.
MAX_BYTES, MAX_BYTES_LANGUAGE, SAMPLE_FILES = 600 * 1024, 2 * 1024 * 1024, 400
SKIPPED_DIRS = ("node_modules", "dist", "build", "target", "vendor", "__pycache__")
LANGUAGES = {"ts": "ts", "tsx": "ts", "js": "js", "py": "py", "rs": "rust", "go": "go", "java": "java", "cpp": "cpp", "cc": "cpp", "h": "cpp", "gd": "gd", "cs": "cs", "gdshader": "shader", "md": "md", "html": "html", "json": "json"}


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)


def language(path: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.lower(extension(path))]


def read_files(spark: SparkSession, root: str, exts: tuple[str, ...] | None = None, max_bytes: int = MAX_BYTES, exclude: tuple[str, ...] = (), tests: bool = True) -> DataFrame:
    """files below root: path (relative), module, lang, bytes, text. Skips hidden and generated folders, minified and
    large files; exclude holds path prefixes. Size and name are filtered before contents are decoded."""
    base = root.rstrip("/") + "/"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.element_at(F.split(F.col("path"), F.lit("\\Q" + base + "\\E"), 2), -1)
    df = df.where(F.col("length") <= max_bytes).withColumn("path", F.regexp_replace(rel, "^file:/*", "/"))
    df = df.where(~F.col("path").rlike(r"(^|/)(\.|(" + "|".join(SKIPPED_DIRS) + r")/)") & ~F.col("path").rlike(r"\.min\.js$"))
    if exts:
        df = df.where(F.lower(extension(F.col("path"))).isin(*exts))
    if not tests:
        df = df.where(~F.col("path").rlike(r"(^|/)tests?/|[._-](test|spec)\.|(^|/)test_"))
    df = df.where(~excluded(F.col("path"), exclude))
    return df.select("path", module_of(F.col("path")).alias("module"), language(F.col("path")).alias("lang"), F.col("length").alias("bytes"), F.decode("content", "UTF-8").alias("text"))


#: Names of generated sources by language, which scans of that language leave out.
GENERATED = {"ts": r"\.d\.ts$|\.(gen|generated)\.tsx?$", "cs": r"\.g\.cs$|\.Designer\.cs$", "go": r"\.pb\.go$|_gen\.go$", "cpp": r"\.pb\.(h|cc)$"}


def read_language(spark: SparkSession, root: str, lang: str, exclude: tuple[str, ...] = (), tests: bool = False) -> DataFrame:
    """Files of one language: up to MAX_BYTES_LANGUAGE, without tests unless they are asked for, without generated ones."""
    exts = tuple(e for e, x in LANGUAGES.items() if x == lang)
    df = read_files(spark, root, exts, MAX_BYTES_LANGUAGE, exclude, tests)
    return df.where(~F.col("path").rlike(GENERATED[lang])) if lang in GENERATED else df


def excluded(path: Column, prefixes) -> Column:
    """A path is excluded if it is a prefix or lies below one."""
    out = F.lit(False)
    for p in prefixes:
        p = p.rstrip("/")
        out = out | (path == p) | path.startswith(p + "/")
    return out


def one_level(files: DataFrame, flat: bool = False) -> DataFrame:
    """Files directly below a module, or with flat only those of the root."""
    depth = F.size(F.split("path", "/"))
    return files.where(depth == 1 if flat else depth <= 2)


def dedup_links(files: DataFrame) -> DataFrame:
    """Files reached by several paths count once, by the first path; needs a column real_path."""
    first = F.row_number().over(W.partitionBy("real_path").orderBy("path"))
    return files.withColumn("_n", first).where("_n = 1").drop("_n")


def lines(files: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """One row for each line, numbered from 1; an ending newline leaves an empty last line, null text has no lines."""
    return files.select(*key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).select(*key, (F.col("pos") + 1).alias("line_no"), "line")


def spread(df: DataFrame, key: str, tasks: int = 4) -> DataFrame:
    """Rows dealt out by a key to so many tasks a core: a small file of many rows comes as few tasks, however much is made
    of each row."""
    return df.repartition(tasks * df.sparkSession.sparkContext.defaultParallelism, key)


def systematic_sample(files: DataFrame, order: str, most: int = SAMPLE_FILES) -> DataFrame:
    """Every step-th file in order once there are more than most, step being their number by most. Positions come from
    counts by range, so no single task orders everything."""
    n = files.count()
    if n <= most:
        return files
    step = n // most
    ranked = with_positions(files, order)
    return ranked.where((F.col("position") % step == 0) & (F.floor(F.col("position") / step) < most)).drop("position")


def with_positions(df: DataFrame, order: str, cells: int = 1024) -> DataFrame:
    """position from 0 in the order of a column whose values are unique: rows are numbered inside ranges, and ranges
    start where the ones before end. Numbers are cut at quantiles. Text is cut by its eight characters after the start
    that all values share, compared byte by byte; a null comes first."""
    if df.schema[order].dataType.typeName() in ("long", "integer", "double"):
        cuts = df.select(F.percentile_approx(order, [i / cells for i in range(1, cells)], 10_000)).first()[0]
        cell = F.coalesce(F.array_size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col(order))), F.lit(0)) if cuts else F.lit(0)
    else:
        first, last = df.agg(F.min(order), F.max(order)).first()
        shared = len(os.path.commonprefix([first or "", last or ""]))
        cell = F.rpad(F.hex(F.substring(F.coalesce(F.col(order).cast("string"), F.lit("")), shared + 1, 8)), 64, "0")
    df = df.withColumn("_cell", cell)
    inside = F.row_number().over(W.partitionBy("_cell").orderBy(order)) - 1
    starts = df.groupBy("_cell").count().select(F.col("_cell").alias("_c"), (F.sum("count").over(W.orderBy("_cell")) - F.col("count")).alias("_start"))
    return df.withColumn("_in", inside).join(starts, F.col("_cell") == F.col("_c")).withColumn("position", F.col("_start") + F.col("_in")).drop("_cell", "_c", "_start", "_in")


def first_files(files: DataFrame, order: str, most: int = 400) -> DataFrame:
    return files.orderBy(order).limit(most)


def read_json_setting(spark: SparkSession, files: DataFrame, names: list[str], schema: str) -> DataFrame:
    """The first of names that exists, parsed; a broken file gives null, not an error."""
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("path"))
    return files.where(rank > 0).orderBy(rank).limit(1).select("path", F.from_json("text", schema, {"mode": "PERMISSIVE"}).alias("value"))


def parse_settings(text: str) -> tuple[dict, list[str]]:
    """Two-level settings: `key: value`, `key:` with indented `sub: value` or `- item`, lists in brackets that may run
    over lines. Returns values and errors (repeated keys, lines that belong nowhere)."""
    merged, buffer = [], ""
    for raw in text.split("\n"):
        line = raw.split(" #")[0].rstrip()
        buffer = f"{buffer} {line.strip()}" if buffer else line
        if buffer.count("[") <= buffer.count("]"):
            merged.append(buffer)
            buffer = ""
    out: dict = {}
    errors: list[str] = []
    top = None
    for line in [*merged, buffer]:
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        key, colon, value = body.partition(":")
        parsed = [x.strip().strip("'\"") for x in value.strip()[1:-1].split(",") if x.strip()] if value.strip().startswith("[") else value.strip().strip("'\"")
        if line[0] not in " -":
            if not colon:
                errors.append(f"orphan: {body}")
                continue
            if key in out:
                errors.append(f"repeated: {key}")
            top, out[key] = key, parsed
        elif top is None:
            errors.append(f"orphan: {body}")
        elif body.startswith("- "):
            out[top] = [*(out[top] or []), body[2:].strip()]
        elif colon:
            into = out[top] = out[top] if isinstance(out[top], dict) else {}
            if key in into:
                errors.append(f"repeated: {top}.{key}")
            into[key] = parsed
        else:
            errors.append(f"orphan: {body}")
    return out, errors


def findings_of_sarif(spark: SparkSession, path: str) -> DataFrame:
    """SARIF 2.1.0 files as findings."""
    schema = "runs array<struct<results: array<struct<ruleId: string, level: string, message: struct<text: string>, locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>>>>>>>"
    df = spark.read.schema(schema).option("multiLine", "true").json(path)
    r = df.select(F.explode("runs").alias("run")).select(F.explode("run.results").alias("r"))
    at = F.get("r.locations", F.lit(0))["physicalLocation"]
    level = F.when(F.col("r.level") == "error", "P0").when(F.col("r.level") == "warning", "P1").otherwise("P2")
    return r.select(F.col("r.ruleId").alias("rule_id"), level.alias("level"), posix_normal(at["artifactLocation"]["uri"]).alias("path"), at["region"]["startLine"].alias("line_no"), F.col("r.message.text").alias("snippet"))
