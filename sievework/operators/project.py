"""Checks over whole projects: missing targets, orphans, forks, duplicates, reachability, module graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.text import posix_normal


def anti(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of left whose key right lacks; null keys are lacking."""
    keys = right.where(F.col(right_key).isNotNull()).select(F.col(right_key).alias("_k")).distinct()
    return left.join(keys, F.col(left_key) == F.col("_k"), "left_anti")


def missing_imports(imports: DataFrame, files: DataFrame, exts=("", ".ts", ".js", "/index.ts", "/index.js")) -> DataFrame:
    """imports (path, spec): relative ones for which no candidate file exists."""
    folder = F.regexp_replace("path", "[^/]*$", "")
    rel = imports.where(F.col("spec").startswith(".")).withColumn("base", posix_normal(F.concat(folder, "spec")))
    tried = rel.select("path", "spec", F.explode(F.array(*[F.concat("base", F.lit(e)) for e in exts])).alias("candidate"))
    found = tried.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate", "left_semi").select("path", "spec").distinct()
    return rel.select("path", "spec").join(found, ["path", "spec"], "left_anti")


def imports_of(ls: DataFrame) -> DataFrame:
    spec = F.regexp_extract("line", r"(?:from|import|require\()\s*['\"]([^'\"]+)['\"]", 1)
    return ls.select("path", "line_no", spec.alias("spec")).where("spec <> ''")


def repeated(df: DataFrame, key: list[str], least: int = 2) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def forks(df: DataFrame, key: list[str], value: str, least: int = 2) -> DataFrame:
    """Keys with several different values."""
    return df.groupBy(*key).agg(F.countDistinct(value).alias("values"), F.count("*").alias("n")).where(F.col("values") >= least)


def identical(files: DataFrame, key: str, text: str = "text", least: int = 40) -> DataFrame:
    """Groups of files of least characters or more with equal contents: digest, n, first."""
    return files.where(F.length(text) >= least).groupBy(F.md5(text).alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")


def positional_ratio(a, b):
    """Share of positions at which two texts agree, of the longer one's length."""
    x, y = F.split(a, ""), F.split(b, "")
    same = F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    return same / F.greatest(F.length(a), F.length(b), F.lit(1))


def basename_forks(files: DataFrame, low: float = 0.55, high: float = 0.995) -> DataFrame:
    """Files of one name: the first two, if they agree in low to high of their positions."""
    name = F.element_at(F.split("path", "/"), -1)
    two = files.withColumn("name", name).withColumn("n", F.row_number().over(W.partitionBy("name").orderBy("path"))).where("n <= 2")
    pair = two.groupBy("name").agg(F.min_by("path", "n").alias("a"), F.max_by("path", "n").alias("b"), F.min_by("text", "n").alias("x"), F.max_by("text", "n").alias("y"), F.count("*").alias("c")).where("c = 2")
    return pair.withColumn("ratio", positional_ratio(F.col("x"), F.col("y"))).where((F.col("ratio") >= low) & (F.col("ratio") < high)).select("name", "a", "b", "ratio")


def reachable(edges: DataFrame, roots: DataFrame, checkpoint=None) -> DataFrame:
    """node, depth: all that edges (src, dst) lead to from roots (node). The frontier alone is joined in each round;
    rounds are written to spark.checkpoint.dir, so that the lineage stays short."""
    spark = edges.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='reach-')}"
    path, depth = f"{base}/reach-{uuid.uuid4().hex}", 0
    roots.select(F.col("node")).where("node is not null").distinct().withColumn("depth", F.lit(0)).write.parquet(f"{path}/round=0")
    while True:
        seen = spark.read.parquet(path).select("node", "depth")
        front = seen.where(F.col("depth") == depth).select(F.col("node").alias("src"))
        new = edges.join(front, "src", "left_semi").select(F.col("dst").alias("node")).where("node is not null").distinct()
        new = new.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth + 1))
        new.write.parquet(f"{path}/round={depth + 1}")
        if spark.read.schema("node string").parquet(f"{path}/round={depth + 1}").limit(1).count() == 0:
            return spark.read.parquet(path).select("node", "depth")
        depth += 1


def unreachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    return anti(nodes, reachable(edges, roots), "node", "node")


def dependencies(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """module, used_by (distinct modules that depend on it), uses."""
    in_ = edges.groupBy(F.col("dst").alias("m1")).agg(F.countDistinct("src").alias("used_by"))
    out = edges.groupBy(F.col("src").alias("m2")).agg(F.countDistinct("dst").alias("uses"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return modules.join(in_, F.col("module") == F.col("m1"), "left").join(out, F.col("module") == F.col("m2"), "left").select("module", zero("used_by"), zero("uses"))


def forbidden(edges: DataFrame, infra: DataFrame) -> DataFrame:
    """Edges between modules that bypass the infrastructure, and edges out of it."""
    keys = infra.select(F.col("module").alias("_m")).distinct()
    from_ = edges.join(keys, F.col("src") == F.col("_m"), "left_semi").withColumn("why", F.lit("infrastructure depends on a module"))
    rest = edges.join(keys, F.col("src") == F.col("_m"), "left_anti").join(keys, F.col("dst") == F.col("_m"), "left_anti")
    return rest.withColumn("why", F.lit("modules depend on each other")).unionByName(from_.join(keys, F.col("dst") == F.col("_m"), "left_anti"))


def unmatched_handlers(added: DataFrame, removed: DataFrame) -> DataFrame:
    """added, removed (path, event, handler): events whose removed handlers are none of those added."""
    a = added.groupBy("path", "event").agg(F.collect_set("handler").alias("on"))
    b = removed.groupBy("path", "event").agg(F.collect_set("handler").alias("off"))
    return a.join(b, ["path", "event"]).where(~F.arrays_overlap("on", "off"))


def rare_fields(fields: DataFrame, ls: DataFrame, most: int = 1) -> DataFrame:
    """fields (module, field) that occur most times or less among the tokens of their module's lines."""
    tokens = ls.select("module", F.explode(F.regexp_extract_all("line", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("field"))
    used = tokens.join(fields.select("field").distinct(), "field", "left_semi").groupBy("module", "field").agg(F.count("*").alias("n"))
    return fields.join(used, ["module", "field"], "left").select("module", "field", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") <= most)


def promised(claims: DataFrame, files: DataFrame) -> DataFrame:
    """claims (doc, path) that no file meets, by full path or else by name."""
    rest = anti(claims, files, "path", "path")
    names = files.select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return anti(rest.withColumn("_name", F.element_at(F.split("path", "/"), -1)), names, "_name", "name").drop("_name")


def deliverables(modules: DataFrame, docs: DataFrame) -> DataFrame:
    """modules (module) with has_doc: some docs (path) name holds the module's name, marks aside."""
    plain = lambda c: F.lower(F.regexp_replace(c, "[-_]", ""))
    tokens = docs.select(F.explode(F.split(F.lower(F.regexp_replace("path", "[-_]", "")), "[/.]")).alias("_d")).distinct()
    return modules.join(tokens, plain(F.col("module")) == F.col("_d"), "left").select("module", F.col("_d").isNotNull().alias("has_doc"))
