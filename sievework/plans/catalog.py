"""Every query over the driver's tables, with the SQL that checks it.

documents stand for files (source for module), conversations for drafts, benchmark for the reference corpus, labels
for the truth about samples, events for the log of findings, the star schema for registries and edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import comments, text as T
from sievework.operators import findings as FI
from sievework.operators import lint, project, registry, routing, rules, similar, skills, spans
from sievework.operators.rulebook import RULES
from sievework.sources import corpus, markdown, sinks
from sievework.streaming.audit import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


LINES = "l AS (SELECT doc_id, source, lang, CAST(i AS INTEGER) AS line_no, x[i] AS line FROM (SELECT doc_id, source, lang, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS x FROM documents)))"
DOC_RULES = [r for r in RULES if r.rule_id.startswith("DOC-")]
HITS = rf"""
WITH {LINES},
g AS (SELECT doc_id, regexp_matches(text, '\|-{{3}}') AS gate FROM documents),
m AS (SELECT *, coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY line_no), '') AS above FROM l),
h AS (SELECT m.*, r.rule_id, r.level FROM m JOIN g USING (doc_id), (VALUES ('DOC-01','P2'), ('DOC-02','P1'), ('DOC-03','P2'), ('DOC-04','P2')) r(rule_id, level)
      WHERE NOT regexp_matches(line, 'audit.*ignore') AND NOT regexp_matches(above, 'audit.*ignore') AND CASE rule_id WHEN 'DOC-01' THEN regexp_matches(line, '(TODO|FIXME|XXX)[: ]')
        WHEN 'DOC-02' THEN regexp_matches(line, '(TOKEN|SECRET|PASSWORD|API_KEY) *= *"[A-Za-z0-9]{{16,}}"')
        WHEN 'DOC-03' THEN regexp_matches(line, ' \| .* \| ') AND NOT gate ELSE regexp_matches(line, '^[A-Z!,. ]{{20,}}$') END)
"""


def doc_hits(spark, d):
    return rules.scan(t(spark, d, "documents"), DOC_RULES, ["doc_id"])


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n_lines, max(length(line)) AS longest FROM l GROUP BY doc_id")
def corpus_lines(spark, d):
    ls = corpus.lines(t(spark, d, "documents"), ["doc_id"])
    return ls.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.length("line")).cast("long").alias("longest"))


@query(f"{HITS} SELECT rule_id, level, doc_id, line_no, substr(trim(line), 1, 120) AS snippet FROM h")
def rule_findings(spark, d):
    return doc_hits(spark, d)


@query(f"{HITS} SELECT rule_id, level, source, count(*) AS n FROM h GROUP BY ALL")
def findings_by_source(spark, d):
    return doc_hits(spark, d).join(t(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("rule_id", "level", "source").agg(F.count("*").alias("n"))


@query(f"{HITS} SELECT source, count(*) FILTER (level = 'P0') AS p0, count(*) FILTER (level = 'P1') AS p1, count(*) FILTER (level = 'P2') AS p2, count(*) FILTER (level = 'P3') AS p3, count(*) AS total FROM h GROUP BY source")
def findings_level_totals(spark, d):
    return FI.level_totals(doc_hits(spark, d).join(t(spark, d, "documents").select("doc_id", "source"), "doc_id"), ["source"])


@query(f"{HITS} SELECT level, rule_id, count(*) AS n, CAST(grouping(level, rule_id) AS BIGINT) AS grouping FROM h GROUP BY ROLLUP (level, rule_id)")
def findings_rollup(spark, d):
    return FI.rollup(doc_hits(spark, d), ["level", "rule_id"])


@query(f"{HITS} SELECT count(DISTINCT source) AS modules, count(DISTINCT rule_id) AS rules, count(DISTINCT doc_id) AS files FROM h")
def findings_distinct(spark, d):
    return doc_hits(spark, d).join(t(spark, d, "documents").select("doc_id", "source"), "doc_id").agg(F.countDistinct("source").alias("modules"), F.countDistinct("rule_id").alias("rules"), F.countDistinct("doc_id").alias("files"))


@query(f"""WITH {LINES}, w AS (SELECT *, max(CASE WHEN regexp_matches(line, 'with') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS near FROM l)
SELECT 'X-W1' AS rule_id, 'P1' AS level, doc_id, line_no, substr(trim(line), 1, 120) AS snippet FROM w WHERE regexp_matches(line, '^The ') AND near = 0""")
def rule_guard_window(spark, d):
    r = rules.Rule("X-W1", "P1", "line without its guard", "^The ", form="W", absent="with", win=2)
    return rules.scan(t(spark, d, "documents"), [r], ["doc_id"], pragma=None)


@query(f"""WITH {LINES}, g AS (SELECT doc_id, regexp_matches(text, 'TOKEN') AS has FROM documents)
SELECT 'X-F1' AS rule_id, 'P0' AS level, doc_id, line_no, substr(trim(line), 1, 120) AS snippet FROM l JOIN g USING (doc_id) WHERE NOT has AND regexp_matches(line, '[A-Z]{{6,}}')""")
def rule_file_gate(spark, d):
    return rules.scan(t(spark, d, "documents"), [rules.Rule("X-F1", "P0", "raised word in a file without tokens", "[A-Z]{6,}", absent="TOKEN")], ["doc_id"], pragma=None)


@query(r"""SELECT 'X-T1' AS rule_id, 'P2' AS level, doc_id, CAST(1 + length(substr(text, 1, instr(text, m) - 1)) - length(replace(substr(text, 1, instr(text, m) - 1), chr(10), '')) AS INTEGER) AS line_no, m AS snippet
FROM (SELECT doc_id, text, regexp_extract(text, '[a-z_]+ = "[A-Za-z0-9_-]+"') AS m FROM documents) WHERE m <> ''""")
def rule_whole_text(spark, d):
    return rules.scan(t(spark, d, "documents"), [rules.Rule("X-T1", "P2", "assignment of a constant", '[a-z_]+ = "[A-Za-z0-9_-]+"', form="F")], ["doc_id"])


@query(f"{HITS} SELECT doc_id, rule_id, min(line_no) AS line_no, count(*) AS hits FROM h GROUP BY ALL")
def rule_first_hit_count(spark, d):
    return rules.first_hit_and_count(doc_hits(spark, d), ["doc_id", "rule_id"])


@query(f"{HITS} SELECT doc_id, rule_id, line_no, level, substr(trim(line), 1, 120) AS snippet FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY line_no) = 1")
def rule_first_hit(spark, d):
    return rules.first_hits(doc_hits(spark, d), ["doc_id", "rule_id"])


@query(f"""WITH {LINES}, w AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM l)
SELECT doc_id, count(*) AS n FROM w WHERE NOT regexp_matches(line, 'idiot|moron') AND NOT coalesce(regexp_matches(p, 'idiot|moron'), false) GROUP BY doc_id""")
def pragma_lines(spark, d):
    ls = rules.drop_pragma_lines(corpus.lines(t(spark, d, "documents"), ["doc_id"]), ["doc_id"], "idiot|moron")
    return ls.groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"""WITH {LINES}, w AS (SELECT *, max(CASE WHEN regexp_matches(line, 'with') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS seen FROM l)
SELECT doc_id, count(*) FILTER (seen = 1) AS covered FROM w GROUP BY doc_id""")
def look_back_40(spark, d):
    return rules.look_back(corpus.lines(t(spark, d, "documents"), ["doc_id"]), ["doc_id"], "with").groupBy("doc_id").agg(F.count_if("seen").alias("covered"))


TAGS = "l AS (SELECT page_id, CAST(i AS INTEGER) AS line_no, x[i] AS line FROM (SELECT page_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT page_id, string_split(replace(html, '<', chr(10) || '<'), chr(10)) AS x FROM pages)))"
TAG_DEPTH = f"WITH {TAGS}, s AS (SELECT *, sum(len(regexp_extract_all(line, '^<(ul|nav|div|section)[ >]')) - len(regexp_extract_all(line, '^</(ul|nav|div|section)>'))) OVER (PARTITION BY page_id ORDER BY line_no) AS depth FROM l)"


def tag_lines(spark, d):
    return corpus.lines(t(spark, d, "pages").withColumn("text", F.replace("html", F.lit("<"), F.lit("\n<"))), ["page_id"])


@query(f"{TAG_DEPTH} SELECT page_id, CAST(max(depth) AS BIGINT) AS deepest FROM s GROUP BY page_id")
def tag_depth(spark, d):
    s = spans.brace_depth(tag_lines(spark, d), ["page_id"], "^<(ul|nav|div|section)[ >]", "^</(ul|nav|div|section)>")
    return s.groupBy("page_id").agg(F.max("depth").alias("deepest"))


@query(f"""WITH {LINES}, p AS (SELECT doc_id, line_no, line FROM l WHERE regexp_matches(line, 'tion')),
h AS (SELECT doc_id, 'h' || line_no AS name, line_no - 1 AS s, line_no + 3 AS e FROM l WHERE regexp_matches(line, '^The '))
SELECT p.doc_id, p.line_no, h.name AS span FROM p JOIN h ON p.doc_id = h.doc_id AND line_no > s AND line_no <= e QUALIFY row_number() OVER (PARTITION BY p.doc_id, p.line_no ORDER BY s DESC, e, name) = 1""")
def span_interval_join(spark, d):
    ls = corpus.lines(t(spark, d, "documents"), ["doc_id"])
    sp = ls.where(F.col("line").rlike("^The ")).select("doc_id", F.concat(F.lit("h"), "line_no").alias("name"), (F.col("line_no") - 1).alias("s"), (F.col("line_no") + 3).alias("e"))
    return spans.in_spans(ls.where(F.col("line").rlike("tion")), sp, ["doc_id"]).select("doc_id", "line_no", "span")


@query(f"""WITH {LINES}, b AS (SELECT doc_id, max(line_no) AS last FROM l WHERE regexp_matches(line, 'with') GROUP BY doc_id)
SELECT doc_id, count(*) AS n FROM l JOIN b USING (doc_id) WHERE regexp_matches(line, '^The ') AND line_no < last GROUP BY doc_id""")
def later_hit(spark, d):
    ls = corpus.lines(t(spark, d, "documents"), ["doc_id"])
    return spans.later_hit(ls.where(F.col("line").rlike("^The ")), ls.where(F.col("line").rlike("with")), ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"""WITH {LINES}, w AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^The ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS u FROM l)
SELECT doc_id, count(*) FILTER (u % 2 = 1 OR regexp_matches(line, '^The ')) AS inside FROM w GROUP BY doc_id""")
def fence_state(spark, d):
    return markdown.fences(corpus.lines(t(spark, d, "documents"), ["doc_id"]), ["doc_id"], "^The ").groupBy("doc_id").agg(F.count_if("in_fence").alias("inside"))


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)")
def orphan_parts(spark, d):
    used = t(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45")
    return project.anti(t(spark, d, "part"), used, "p_partkey", "l_partkey").select("p_partkey", "p_name")


EDGES = "e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"


def graph(spark, d):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = t(spark, d, "nation").select(tag("r", "n_regionkey").alias("src"), tag("n", "n_nationkey").alias("dst"))
    e = e.union(t(spark, d, "customer").select(tag("n", "c_nationkey"), tag("c", "c_custkey")))
    return e.union(t(spark, d, "orders").select(tag("c", "o_custkey"), tag("o", "o_orderkey")))


@query(f"WITH RECURSIVE {EDGES}, c AS (SELECT 'r1' AS node, 0 AS depth UNION SELECT e.dst, depth + 1 FROM c JOIN e ON e.src = c.node) SELECT node, depth FROM c")
def reachable_nodes(spark, d):
    return project.reachable(graph(spark, d), spark.createDataFrame([("r1",)], "node string")).select("node", F.col("depth").cast("int").alias("depth"))


@query(f"WITH {EDGES}, m AS (SELECT src AS module FROM e UNION SELECT dst FROM e) SELECT module, coalesce(used_by, 0) AS used_by, coalesce(uses, 0) AS uses FROM m LEFT JOIN (SELECT dst, count(DISTINCT src) AS used_by FROM e GROUP BY 1) a ON module = dst LEFT JOIN (SELECT src, count(DISTINCT dst) AS uses FROM e GROUP BY 1) b ON module = src")
def module_degrees(spark, d):
    e = graph(spark, d)
    return project.dependencies(e, e.select(F.col("src").alias("module")).union(e.select("dst")).distinct())


@query(f"WITH {EDGES}, i AS (SELECT DISTINCT 'n' || n_nationkey AS m FROM nation) SELECT src, dst, 'modules depend on each other' AS why FROM e WHERE src NOT IN (SELECT m FROM i) AND dst NOT IN (SELECT m FROM i) UNION ALL SELECT src, dst, 'infrastructure depends on a module' FROM e WHERE src IN (SELECT m FROM i) AND dst NOT IN (SELECT m FROM i)")
def forbidden_edges(spark, d):
    return project.forbidden(graph(spark, d), t(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("module")))


@query("SELECT p_brand, p_size, count(DISTINCT p_type) AS \"values\", count(*) AS n FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_type) >= 2")
def const_forks(spark, d):
    return project.forks(t(spark, d, "part"), ["p_brand", "p_size"], "p_type")


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2")
def duplicate_imports(spark, d):
    return project.repeated(t(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


@query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents WHERE length(text) >= 40 GROUP BY 1 HAVING count(*) > 1")
def identical_documents(spark, d):
    return project.identical(t(spark, d, "documents"), "doc_id")


@query("SELECT * FROM (SELECT 'r_name' AS \"column\", count(DISTINCT r_name) AS \"values\", count(*) AS n FROM region UNION ALL SELECT 'k', 1, count(*) FROM region) WHERE \"values\" = 1 AND n >= 5")
def degenerate_columns(spark, d):
    return FI.degenerate(t(spark, d, "region").withColumn("k", F.lit(1)), ["r_name", "k"])


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () // 100 AS step FROM documents) WHERE p % step = 0 AND p // step < 100")
def systematic_sample(spark, d):
    return corpus.systematic_sample(t(spark, d, "documents"), "doc_id", 100).select("doc_id", "source")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 120")
def first_files(spark, d):
    return corpus.first_files(t(spark, d, "documents"), "doc_id", 120).select("doc_id", "lang")


@query("SELECT coalesce(lang, '(unsupported)') AS lang, count(*) AS files FROM documents GROUP BY 1")
def scan_scope(spark, d):
    return rules.scan_scope(t(spark, d, "documents"))


SIGNALS = [routing.Signal("s-a", "rx", "TOKEN", "tokens", True), routing.Signal("s-a", "rx", "[0-9]{3}", "numbers"), routing.Signal("s-b", "rx", "the ", "english", True), routing.Signal("s-c", "rx", "\\|", "bars"), routing.Signal("s-c", "ext", "7", "ends in seven", True)]


@query(r"""WITH e AS (SELECT 's-a' AS scene, 'rx' AS kind, true AS strong, count(*) AS n FROM documents WHERE regexp_matches(text, 'TOKEN') HAVING count(*) > 0
UNION ALL SELECT 's-a', 'rx', false, count(*) FROM documents WHERE regexp_matches(text, '[0-9]{3}') HAVING count(*) > 0
UNION ALL SELECT 's-b', 'rx', true, count(*) FROM documents WHERE regexp_matches(text, 'the ') HAVING count(*) > 0
UNION ALL SELECT 's-c', 'rx', false, count(*) FROM documents WHERE contains(text, '|') HAVING count(*) > 0
UNION ALL SELECT 's-c', 'ext', true, count(*) FROM documents WHERE doc_id % 10 = 7 HAVING count(*) > 0),
s AS (SELECT scene, count(*) FILTER (strong) * 1000 + count(*) FILTER (NOT strong) * 100 + count(DISTINCT kind) * 30 + CAST(floor(10 * sqrt(1 + sum(n) / 100)) AS BIGINT) AS score FROM e GROUP BY scene)
SELECT scene, score, CAST(row_number() OVER (ORDER BY score DESC, scene) AS INTEGER) AS rank FROM s""")
def route_scenes(spark, d):
    files = t(spark, d, "documents").select(F.concat(F.lit("doc."), F.col("doc_id") % 10).alias("path"), "text")
    return routing.rank_scenes(routing.evidence(files, SIGNALS)).select("scene", "score", "rank")


@query("SELECT n_regionkey, n_name, CAST((row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1) // 4 AS INTEGER) AS batch FROM nation")
def scene_batches(spark, d):
    return routing.batches(t(spark, d, "nation").select("n_regionkey", "n_name"), ["n_name"], 4, "n_regionkey")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice) AS BIGINT) + 60 AS cost FROM orders), r AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS spent FROM o)
SELECT o_orderkey, o_custkey, cost, spent FROM r WHERE spent - cost < 400000""")
def budget_prefix(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", (F.floor("o_totalprice") + 60).alias("cost"))
    return FI.budget(o, "o_custkey", "o_orderkey", "cost", 400_000)


@query(r"SELECT page_id, regexp_matches(url, '^https://[^/]*/en/(?:.*/)?[^/]*\.html$') AS hit FROM pages")
def glob_match(spark, d):
    return t(spark, d, "pages").select("page_id", F.col("url").rlike(T.glob_regex("https://*/en/**/*.html")).alias("hit"))


@query(r"""SELECT doc_id, CAST(trunc(c * 1.5::DOUBLE + (length(text) - c) / 4) AS INTEGER) AS tokens, c + len(regexp_extract_all(text, '[A-Za-z0-9_]+')) + len(regexp_extract_all(text, '[^A-Za-z0-9_ \t\n\r\x{4e00}-\x{9fff}]')) AS runs
FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) AS c FROM documents)""")
def token_estimates(spark, d):
    return t(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), T.token_runs(F.col("text")).cast("long").alias("runs"))


FP = "substr(sha1(concat(coalesce(event_type, ''), '|', coalesce(CAST(user_id AS VARCHAR), ''), '|', coalesce(CAST(hour(ts) AS VARCHAR), ''), '|', substr(coalesce(props, ''), 1, 120))), 1, 16)"


def event_findings(spark, d):
    e = t(spark, d, "events")
    return e.select("event_id", "ts", F.col("event_type").alias("path"), F.col("user_id").cast("string").alias("rule_id"), F.hour("ts").alias("line_no"), F.col("props").alias("snippet"))


@query(f"SELECT event_id, {FP} AS fingerprint FROM events QUALIFY row_number() OVER (PARTITION BY {FP} ORDER BY event_id) = 1")
def fingerprint_dedup(spark, d):
    return FI.dedup(event_findings(spark, d), ["event_id"]).select("event_id", "fingerprint")


@query("""WITH k AS (SELECT concat(event_type, '/', user_id) AS fingerprint, event_id % 2 AS half FROM events), a AS (SELECT DISTINCT fingerprint FROM k WHERE half = 0), b AS (SELECT DISTINCT fingerprint FROM k WHERE half = 1)
SELECT coalesce(a.fingerprint, b.fingerprint) AS fingerprint, CASE WHEN a.fingerprint IS NULL THEN 'added' WHEN b.fingerprint IS NULL THEN 'gone' ELSE 'kept' END AS status FROM a FULL JOIN b ON a.fingerprint = b.fingerprint""")
def snapshot_diff(spark, d):
    k = t(spark, d, "events").select(F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("fingerprint"), (F.col("event_id") % 2).alias("half"))
    return FI.snapshot_diff(k.where("half = 0"), k.where("half = 1"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderkey % 8 AS v FROM orders WHERE o_orderkey % 10 <> 3), b AS (SELECT l_orderkey AS k, count(*) AS v FROM lineitem GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_left' WHEN a.k IS NULL THEN 'only_right' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.k = b.k""")
def registry_drift(spark, d):
    a = t(spark, d, "orders").where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 8).alias("v"))
    b = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("v"))
    return FI.drift(a, b, "k", ["v"])


NAME = "list_distinct(list_concat(regexp_extract_all({c}, '[\\x{{4e00}}-\\x{{9fff}}]'), regexp_extract_all(lower({c}), '[a-z0-9_]{{2,}}')))"


@query(rf"""WITH i AS (SELECT DISTINCT 'N' || p_name AS id, p_name AS name, string_split(p_name, ' ') AS kw, '' AS body FROM part
  UNION ALL SELECT 'B' || item_id, text, [], text FROM benchmark),
r AS (SELECT 'P' || p_partkey AS rule_id, concat(p_name, ' ', p_type) AS title FROM part),
k AS (SELECT 'P' || p_partkey AS rule_id, 'B0' AS item FROM part WHERE p_size = 1),
m AS (SELECT 'P' || p_partkey AS rule_id, CASE WHEN p_size = 2 THEN 'B1' END AS item FROM part WHERE p_size IN (2, 3)),
p AS (SELECT rule_id, id AS item, {NAME.format(c='title')} AS a, {NAME.format(c='name')} AS b, len(list_filter(kw, lambda k: k <> '' AND contains(lower(title), lower(k)))) AS hits, lower(body) AS body FROM r, i),
s AS (SELECT rule_id, item, least(1::DOUBLE, len(list_intersect(a, b))::DOUBLE / greatest(1, len(a) + len(b) - len(list_intersect(a, b))) + least(0.20::DOUBLE, hits * 0.07::DOUBLE) + 0::DOUBLE
  + coalesce(len(list_filter(a, lambda w: length(w) >= 2 AND contains(body, w)))::DOUBLE / nullif(len(list_filter(a, lambda w: length(w) >= 2)), 0) * 0.15::DOUBLE, 0)) AS score FROM p WHERE hits > 0 OR len(list_intersect(a, b)) > 0),
b AS (SELECT rule_id, item, score, score - coalesce(lead(score) OVER w, 0) AS margin, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY rule_id ORDER BY score DESC, item))
SELECT r.rule_id, coalesce(k.item, m.item, CASE WHEN m.rule_id IS NULL AND score >= 0.32::DOUBLE THEN b.item END) AS item,
  CASE WHEN k.item IS NOT NULL THEN 'known' WHEN m.item IS NOT NULL THEN 'manual' WHEN m.rule_id IS NOT NULL THEN 'manual_none' WHEN score >= 0.5::DOUBLE THEN CASE WHEN margin < 0.08::DOUBLE THEN 'name_low_margin' ELSE 'name' END WHEN score >= 0.32::DOUBLE THEN 'review' ELSE 'open' END AS how
FROM r LEFT JOIN k ON r.rule_id = k.rule_id LEFT JOIN m ON r.rule_id = m.rule_id LEFT JOIN b ON r.rule_id = b.rule_id AND b.n = 1""")
def map_cascade(spark, d):
    """All parts to the distinct part names and the benchmark, with every part of the score but the scene. Parts of
    size 1 are known pairs, those of 2 and 3 are mapped by hand or left out by hand."""
    part = t(spark, d, "part")
    rs = part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("rule_id"), F.concat_ws(" ", "p_name", "p_type").alias("title"))
    names = part.select("p_name").distinct().select(F.concat(F.lit("N"), F.col("p_name")).alias("id"), F.col("p_name").alias("name"), F.split("p_name", " ").alias("keywords"), F.lit("").alias("body"))
    items = names.union(t(spark, d, "benchmark").select(F.concat(F.lit("B"), F.col("item_id").cast("string")), "text", F.array().cast("array<string>"), "text"))
    known = part.where("p_size = 1").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("rule_id"), F.lit("B0").alias("item"))
    manual = part.where("p_size in (2, 3)").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("rule_id"), F.when(F.col("p_size") == 2, "B1").alias("item"))
    return registry.map_rules(rs, items, known, manual)


def expand_lines(lines, orders):
    refs = lines.groupBy(F.col("l_partkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))), lambda x: x["l_orderkey"]).alias("xrefs")).withColumn("tokens", F.lit(10))
    items = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority").startswith("1"), "P0").otherwise("P1").alias("level"))
    return registry.expand_xrefs(refs, items)


@query("""WITH x AS (SELECT l_partkey AS source, l_orderkey AS target, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS pos FROM lineitem),
o AS (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'P0' ELSE 'P1' END AS lv FROM orders)
SELECT source, target, CAST(n AS INTEGER) AS n FROM (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY pos) AS n FROM x JOIN o ON target = o_orderkey WHERE lv = 'P0') WHERE n <= 3""")
def xref_expand(spark, d):
    """The references of every part."""
    return expand_lines(t(spark, d, "lineitem"), t(spark, d, "orders"))


@query("SELECT doc_id, CASE WHEN contains(lower(source), 'src1') THEN 3 ELSE 0 END + CAST((length(lower(source || ' ' || text)) - length(replace(lower(source || ' ' || text), 'src1', ''))) // 4 AS INTEGER) AS score FROM documents WHERE contains(lower(source || ' ' || text), 'src1')")
def item_query(spark, d):
    items = t(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("source").alias("name"), F.col("text").alias("body"))
    return registry.query(items, "src1").select("doc_id", "score")


@query("""WITH i AS (SELECT lang AS scene, list(DISTINCT source) AS ids FROM documents WHERE doc_id % 3 = 0 GROUP BY lang)
SELECT d.doc_id FROM documents d JOIN i ON d.lang = i.scene WHERE doc_id % 11 = 0 OR doc_id % 13 = 0 OR list_contains(ids, source)""")
def needed_sections(spark, d):
    docs = t(spark, d, "documents")
    items = docs.where("doc_id % 3 = 0").select(F.col("lang").alias("scene"), F.col("source").alias("id"))
    sections = docs.select("doc_id", F.col("lang").alias("scene"), (F.col("doc_id") % 11 == 0).alias("is_fp"), (F.col("doc_id") % 13 == 0).alias("is_required"), F.array("source").alias("refs"))
    return registry.needed_sections(items, sections).select("doc_id")


@query("SELECT lang AS scene, source AS level, count(*) AS items, CAST(sum(n_chars) AS BIGINT) AS tokens, CAST(sum(n_chars) // count(*) AS BIGINT) AS mean_tokens FROM documents GROUP BY 1, 2")
def item_stats(spark, d):
    return registry.item_stats(t(spark, d, "documents").select(F.col("lang").alias("scene"), F.col("source").alias("level"), F.col("n_chars").alias("tokens")))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'manual' ELSE 'todo' END AS machine FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def criteria_gaps(spark, d):
    items = t(spark, d, "part").select(F.col("p_partkey").alias("id"))
    mapping = t(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("item"))
    return registry.gaps(items, mapping, items.where("id % 4 = 0").select(F.col("id").alias("item_id"), F.lit("manual").alias("machine")))


@query("""WITH p AS (SELECT source, regexp_matches(text, 'idiot|moron|clown|worthless|pathetic') AS hit, toxic = 1 AS truth FROM documents JOIN labels USING (doc_id))
SELECT source, count(*) FILTER (hit AND truth) AS tp, count(*) FILTER (hit AND NOT truth) AS fp, count(*) FILTER (NOT hit AND truth) AS fn, count(*) FILTER (NOT hit AND NOT truth) AS tn,
 count(*) FILTER (hit AND truth) / nullif(count(*) FILTER (hit), 0) AS precision, count(*) FILTER (hit AND truth) / nullif(count(*) FILTER (truth), 0) AS recall FROM p GROUP BY source""")
def cross_audit(spark, d):
    p = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select("source", F.col("text").rlike("idiot|moron|clown|worthless|pathetic").alias("hit"), (F.col("toxic") == 1).alias("truth"))
    return FI.confusion(p, ["source"])


@query("""WITH s AS (SELECT source AS rule_id, CASE WHEN toxic = 1 THEN 'tp' ELSE 'fp' END AS kind, CASE WHEN doc_id % 50 <> 0 THEN regexp_matches(text, 'idiot|moron|clown') END AS hit FROM documents JOIN labels USING (doc_id)),
a AS (SELECT rule_id, count(*) FILTER (kind = 'tp') AS n1, count(hit) FILTER (kind = 'tp') AS k1, count(*) FILTER (kind = 'tp' AND hit) AS o1, count(*) FILTER (kind = 'fp') AS n2, count(hit) FILTER (kind = 'fp') AS k2, count(*) FILTER (kind = 'fp' AND NOT hit) AS o2 FROM s GROUP BY 1)
SELECT rule_id, CASE WHEN n1 = 0 OR k1 < n1 THEN 'unverified' WHEN o1 = n1 THEN 'pass' ELSE 'fail' END AS recall, CASE WHEN n2 = 0 OR k2 < n2 THEN 'unverified' WHEN o2 = n2 THEN 'pass' ELSE 'fail' END AS precision FROM a""")
def fixture_evaluation(spark, d):
    s = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select(F.col("source").alias("rule_id"), F.when(F.col("toxic") == 1, "tp").otherwise("fp").alias("kind"), F.when(F.col("doc_id") % 50 != 0, F.col("text").rlike("idiot|moron|clown")).alias("hit"))
    return FI.evaluate(s)


FEATURES = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: NOT list_contains(['the','and','for','with','that','this','from','are','was','not','but','you','all','can','has','have','when','use'], x)))"
PAIRS = f"""WITH a AS (SELECT conv_id * 1000 + turn AS id, {FEATURES} AS f FROM conversations), b AS (SELECT item_id AS id, {FEATURES} AS f FROM benchmark),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.f, b.f)) AS shared, len(a.f) AS na, len(b.f) AS nb FROM a, b),
s AS (SELECT a, b, shared, CASE WHEN shared < 5 THEN 0 ELSE 0.65::DOUBLE * shared / least(na, nb) + 0.35::DOUBLE * shared / (na + nb - shared) END AS score FROM p)"""


def draft_pairs(spark, d):
    a = t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return a, similar.similar_pairs(similar.features(a, "id", "text"), similar.features(t(spark, d, "benchmark").withColumnRenamed("item_id", "id"), "id", "text"))


@query(f"{PAIRS} SELECT a, b, shared, score FROM s WHERE score >= 0.05")
def similar_pairs(spark, d):
    return draft_pairs(spark, d)[1]


@query(f"{PAIRS}, m AS (SELECT a, max(score) AS best FROM s WHERE score >= 0.05 GROUP BY a) SELECT id, CASE WHEN best >= 0.30 THEN 'duplicate' WHEN best >= 0.05 THEN 'related' ELSE 'fresh' END AS kind FROM (SELECT conv_id * 1000 + turn AS id FROM conversations) LEFT JOIN m ON id = a")
def near_dup_classify(spark, d):
    drafts, pairs = draft_pairs(spark, d)
    return similar.classify(drafts, "id", pairs)


@query("SELECT conv_id, turn, list_filter(['source', 'evidence', 'consequence'], lambda k: NOT contains(lower(text), k)) AS missing FROM conversations")
def draft_trio(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", T.missing_trio(F.col("text")).alias("missing"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?:^|[\s`(])/(?:home|usr|opt|var|etc)/[A-Za-z0-9_./-]+') THEN 'abs_path' WHEN regexp_matches(text, '[A-Za-z]:\\[A-Za-z0-9_.\\-]+') THEN 'drive_path'
WHEN regexp_matches(text, '[A-Za-z0-9_-]+\.(?:py|ts|js|md|json|rs|go|java)\b') THEN 'file_name' WHEN regexp_matches(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date' END AS fact FROM documents""")
def fact_scan(spark, d):
    return t(spark, d, "documents").select("doc_id", T.fact_kind(F.col("text")).alias("fact"))


def user_skills(spark, d):
    e = t(spark, d, "events")
    return e.groupBy(F.col("user_id").cast("string").alias("id")).agg(F.count("*").cast("int").alias("hits"), F.max(F.to_date("ts")).alias("last_used"), F.min("event_type").alias("domain"), F.max("event_type").alias("name")).withColumns({"tier": F.when(F.col("hits") >= 15, "hot").otherwise("cold"), "keywords": F.array("domain", "name"), "trigger": F.lit("")})


SKILLS = "s AS (SELECT CAST(user_id AS VARCHAR) AS id, CAST(count(*) AS INTEGER) AS hits, max(CAST(ts AS DATE)) AS last_used, min(event_type) AS domain, max(event_type) AS name, CASE WHEN count(*) >= 15 THEN 'hot' ELSE 'cold' END AS tier FROM events GROUP BY user_id)"


@query(f"WITH {SKILLS}, a AS (SELECT id, tier, hits, coalesce(date_diff('day', last_used, DATE '2024-12-31'), 9999) AS age FROM s) SELECT id, tier, CAST(age AS INTEGER) AS age, CASE WHEN age >= 90 THEN 'archive' WHEN tier = 'hot' AND age >= 30 THEN 'cold' WHEN hits >= 10 THEN 'hot' ELSE tier END AS advice FROM a")
def skill_tiers(spark, d):
    return skills.tiers(user_skills(spark, d), "2024-12-31")


@query(f"WITH {SKILLS} SELECT domain, count(*) AS skills, CAST(sum(hits) AS BIGINT) AS hits FROM s GROUP BY domain")
def skills_by_domain(spark, d):
    return skills.by_domain(user_skills(spark, d))


@query(f"""WITH {SKILLS}, h AS (SELECT *, lower(concat_ws(' ', id, name, domain || ' ' || name, '')) AS hay FROM s), q AS (SELECT id, CAST(CASE WHEN contains(hay, 'click') THEN 1 ELSE len(list_filter([domain, name], lambda k: length(k) >= 2 AND contains('click', lower(k)))) END
 + CASE WHEN contains(hay, '12') THEN 1 ELSE 0 END AS INTEGER) AS score FROM h) SELECT id, score FROM q WHERE score > 0""")
def skill_find(spark, d):
    return skills.find(user_skills(spark, d), ["click", "12"]).select("id", "score")


DOMAINS = {"art": ["les", "dans"], "core": ["the", "with"], "net": ["der", "und", "nicht"]}


@query("""WITH s AS (SELECT doc_id, d.domain, list_sum(list_transform(d.w, lambda k: CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])' || k || '([^a-z0-9_]|$)') THEN length(k) ELSE 0 END)) AS score
 FROM documents, (VALUES ('art', ['les', 'dans']), ('core', ['the', 'with']), ('net', ['der', 'und', 'nicht'])) d(domain, w)),
r AS (SELECT doc_id, domain, score, lead(score) OVER w AS second, row_number() OVER w AS n FROM s WHERE score > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, domain))
SELECT d.doc_id, domain, CAST(coalesce(score, 0) AS INTEGER) AS score, CASE WHEN score IS NULL THEN 'no_match' WHEN score = second THEN 'ambiguous' WHEN score >= 8 THEN 'core_hit' ELSE 'weak_match' END AS outcome
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND n = 1""")
def domain_route(spark, d):
    docs = t(spark, d, "documents")
    return routing.route(routing.keyword_scores(docs, "doc_id", "text", DOMAINS), "doc_id", docs.select("doc_id"))


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM documents), n AS (SELECT count(DISTINCT doc_id) AS n FROM w)
SELECT word, count(*) AS df FROM w GROUP BY word HAVING count(*) >= greatest(6, CAST(floor(0.2 * (SELECT n FROM n)) AS BIGINT))""")
def df_stopwords(spark, d):
    words = t(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.ascii_tokens(F.col("text")))).alias("word"))
    n = t(spark, d, "documents").where(F.col("text").rlike("[A-Za-z0-9_]")).select("doc_id").distinct().count()
    return similar.frequent_words(words, "doc_id", "word", documents=n)


@query("""WITH c AS (SELECT source, count(*) FILTER (regexp_matches(text, 'TOKEN')) AS n, bool_or(regexp_matches(text, '^The ')) AS head FROM documents GROUP BY source)
SELECT source, n, CASE WHEN n > 1 AND head THEN 'covered' WHEN n >= 3 THEN 'suspect' WHEN n > 0 THEN 'mention' ELSE 'blank' END AS tier FROM c""")
def coverage_tiers(spark, d):
    c = t(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("text").rlike("TOKEN")).alias("n"), F.bool_or(F.col("text").rlike("^The ")).alias("head")).withColumn("core", F.col("n") > 1)
    return routing.coverage(c, "source", "core", "head", "n")


@query(f"""WITH {LINES}, r AS (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM l WHERE contains(line, '|'))
SELECT doc_id, island, count(*) AS n, min(line_no) AS first FROM r GROUP BY ALL""")
def table_islands(spark, d):
    from pyspark.sql import Window as W

    ls = corpus.lines(t(spark, d, "documents"), ["doc_id"]).where(F.col("line").contains("|"))
    ls = ls.withColumn("island", (F.col("line_no") - F.row_number().over(W.partitionBy("doc_id").orderBy("line_no"))).cast("long"))
    return ls.groupBy("doc_id", "island").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))


@query(r"""WITH r AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS target FROM pages), p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]*)', 1) AS path FROM pages)
SELECT page_id, target FROM r WHERE target NOT IN (SELECT path FROM p)""")
def url_refs_missing(spark, d):
    pages = t(spark, d, "pages")
    refs = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1))).alias("target")).distinct()
    return project.anti(refs, pages.select(F.regexp_extract("url", "^[a-z]+://[^/]*/([^/?#]*)", 1).alias("path")), "target", "path")


@query("""WITH e(id, tool, lo, hi) AS (VALUES ('a', 'py', [3,8,0], [3,10,0]), ('b', 'py', [3,9,0], NULL), ('c', 'py', NULL, [3,8,0]), ('d', 'go', [1,0,0], [2,0,0]), ('e', 'go', [2,0,0], NULL))
SELECT x.tool, x.id AS a, y.id AS b FROM e x JOIN e y ON x.tool = y.tool AND x.id < y.id WHERE coalesce(x.lo < y.hi, true) AND coalesce(y.lo < x.hi, true)""")
def version_overlap(spark, d):
    rows = [("a", "py", "3.8", "3.10"), ("b", "py", "3.9", None), ("c", "py", None, "3.8"), ("d", "go", "1", "2.0"), ("e", "go", "2", None)]
    return skills.overlapping(spark.createDataFrame(rows, "id string, tool string, lo string, hi string"))


OUTCOME = "CASE event_id % 7 WHEN 0 THEN 'SURVIVED' WHEN 1 THEN 'NOT_APPLIED' WHEN 2 THEN 'NOT_COVERED' ELSE 'KILLED' END"


@query(f"SELECT event_type, count(*) FILTER (r = 'KILLED') AS killed, count(*) FILTER (r = 'SURVIVED') AS survived, count(*) FILTER (r NOT IN ('KILLED', 'SURVIVED')) AS other, count(*) FILTER (r = 'KILLED') / nullif(count(*) FILTER (r IN ('KILLED', 'SURVIVED')), 0) AS score FROM (SELECT event_type, {OUTCOME} AS r FROM events) GROUP BY 1")
def mutation_score(spark, d):
    return FI.mutation_score(t(spark, d, "events").select("event_type", F.expr(OUTCOME).alias("result")), ["event_type"])


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_events(spark, d):
    return windowed_counts(t(spark, d, "events"))


@query("""SELECT CASE WHEN contains(text, 'lint: size-exempt') THEN 'info' ELSE 'error' END AS level, CAST(doc_id AS VARCHAR) AS file, concat(n, ' lines, ', k, ' tokens') AS issue, 'split the file' AS hint
FROM (SELECT doc_id, text, len(string_split(text, chr(10))) AS n, len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) + len(regexp_extract_all(text, '[A-Za-z0-9_]+')) + len(regexp_extract_all(text, '[^A-Za-z0-9_ \\t\\n\\r\\x{4e00}-\\x{9fff}]')) AS k FROM documents) WHERE n > 60 OR k > 2000""".replace("\\\\", "\\"))
def lint_size(spark, d):
    return lint.size(t(spark, d, "documents"), "doc_id", "text", 60, 2000)


@query("SELECT 'error' AS level, CAST(min(doc_id) AS VARCHAR) AS file, concat(count(*), ' files with equal contents') AS issue, '' AS hint FROM documents WHERE length(text) >= 40 GROUP BY md5(text) HAVING count(*) > 1")
def lint_identical(spark, d):
    return lint.identical_files(t(spark, d, "documents"), "doc_id", "text")


@query("""WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS a, CAST(s_nationkey AS VARCHAR) AS b FROM customer JOIN supplier ON c_custkey % 97 = s_suppkey % 97), e AS (SELECT DISTINCT a, b FROM c)
SELECT 'error' AS level, a AS file, 'not returned by ' || b AS issue, '' AS hint FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.a = e.b AND f.b = e.a)""")
def lint_mirror_pairs(spark, d):
    """Only which nations meet counts, so each side comes to the join with one row for a nation and a remainder."""
    side = lambda name, key, nation, as_: t(spark, d, name).select((F.col(key) % 97).alias("k"), F.col(nation).cast("string").alias(as_)).distinct()
    c = side("customer", "c_custkey", "c_nationkey", "a").join(side("supplier", "s_suppkey", "s_nationkey", "b"), "k")
    return lint.mirror_pairs(c.select("a", "b"), "a", "b")


@query("""WITH a AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM orders), b AS (SELECT CAST(c_custkey AS VARCHAR) AS v FROM customer WHERE c_custkey % 3 <> 0)
SELECT 'error' AS level, coalesce(a.v, b.v) AS file, CASE WHEN a.v IS NULL THEN 'not in the document' ELSE 'not in the code' END AS issue, '' AS hint FROM a FULL JOIN b ON a.v = b.v WHERE a.v IS NULL OR b.v IS NULL""")
def lint_spec_drift(spark, d):
    return lint.spec_drift(t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("v")), t(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("v")), "v")


@query("WITH r AS (SELECT CAST(l_orderkey AS VARCHAR) AS f, l_partkey AS p FROM lineitem WHERE l_quantity > 49) SELECT 'error' AS level, f AS file, concat('missing target: ', p) AS issue, '' AS hint FROM r WHERE p NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def lint_missing_refs(spark, d):
    refs = t(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("f"), F.col("l_partkey").alias("p"))
    return lint.missing_refs(refs, t(spark, d, "part").where("p_size < 40"), "f", "p", "p_partkey")


DOC_CELLS = r"len(string_split(regexp_replace(regexp_replace(trim(line), '^\\|', ''), '\\|$', ''), '|'))"


@query(rf"""WITH {LINES}, m AS (SELECT *, regexp_matches(line, '^[ \t]*```') AS mark, lag(line) OVER w AS above, lead(line) OVER w AS below FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
x AS (SELECT *, mark OR sum(CASE WHEN mark THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 1 AS fenced FROM m),
z AS (SELECT doc_id, text, len(string_split(text, chr(10))) AS n, len(regexp_extract_all(text, '[\x{{4e00}}-\x{{9fff}}]')) + len(regexp_extract_all(text, '[A-Za-z0-9_]+')) + len(regexp_extract_all(text, '[^A-Za-z0-9_ \t\n\r\x{{4e00}}-\x{{9fff}}]')) AS k, len(regexp_extract_all(text, '(?m)^#{{1,3}} ')) AS s FROM documents),
b AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island, {DOC_CELLS} AS cells FROM x WHERE NOT fenced AND regexp_matches(line, '^\s*\|')), c AS (SELECT *, first_value(cells) OVER (PARTITION BY doc_id, island ORDER BY line_no) AS want FROM b),
o AS (SELECT doc_id, length(regexp_extract(line, '^(#+)', 1)) AS depth, instr('一二三四五六七八九十', regexp_extract(line, '^#+ +([一二三四五六七八九十])、', 1)) AS no FROM x WHERE NOT fenced AND regexp_matches(line, '^#+ +[一二三四五六七八九十]、'))
SELECT level, doc_id AS file, issue, hint FROM (
SELECT CASE WHEN regexp_matches(text, 'lint: *size-exempt') THEN 'info' ELSE 'error' END AS level, CAST(doc_id AS VARCHAR) AS doc_id, concat(n, ' lines, ', k, ' tokens') AS issue, 'split the file' AS hint FROM z WHERE n > 500 OR k > 8192
UNION ALL SELECT 'warn', doc_id, concat(n, ' lines, ', s, ' sections'), 'near the limit' FROM z WHERE n >= 400 AND n <= 500 OR s > 20
UNION ALL SELECT 'warn', doc_id, concat(CASE WHEN regexp_matches(line, '^#+ +#+ ') THEN 'doubled heading mark' ELSE 'indented heading' END, ', line ', line_no), '' FROM x WHERE NOT fenced AND (regexp_matches(line, '^#+ +#+ ') OR regexp_matches(line, '^ {{1,3}}#{{1,6}} '))
UNION ALL SELECT 'warn', doc_id, 'heading repeated: ' || trim(regexp_replace(line, '^#+', '')), '' FROM x WHERE NOT fenced AND regexp_matches(line, '^#{{1,6}} ') GROUP BY doc_id, trim(regexp_replace(line, '^#+', '')) HAVING count(*) > 1
UNION ALL SELECT 'error', doc_id, concat('number repeated: ', no), '' FROM o GROUP BY doc_id, depth, no HAVING count(*) > 1
UNION ALL SELECT 'error', doc_id, concat('line ', line_no, ': ', cells, ' cells, not ', want), '' FROM c WHERE cells <> want
UNION ALL SELECT 'warn', doc_id, concat('row without a table, line ', line_no), '' FROM x WHERE NOT fenced AND regexp_matches(line, '^\s*\|') AND NOT coalesce(regexp_matches(above, '^\s*\|'), false) AND NOT coalesce(regexp_matches(below, '^\s*\|'), false)
UNION ALL SELECT 'error', min(CAST(doc_id AS VARCHAR)), concat(count(*), ' files with equal contents'), '' FROM documents WHERE length(text) >= 40 GROUP BY md5(text) HAVING count(*) > 1
UNION ALL SELECT 'warn', doc_id, concat('count written out, line ', line_no), '' FROM l WHERE regexp_matches(line, '[0-9]+ (files|rules|checks|items)')
UNION ALL SELECT 'error', doc_id, 'missing target: ' || target, '' FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\]\(([^)#\s]+)(?:#[^)]*)?\)', 1)) AS target FROM documents) WHERE NOT regexp_matches(target, '^[a-z]+:') AND target NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents))""")
def lint_documents(spark, d):
    return lint.check_documents(t(spark, d, "documents").withColumn("path", F.col("doc_id").cast("string")), "path", "text")


@query("SELECT p_partkey AS k FROM part WHERE p_size < 25 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def set_difference(spark, d):
    return t(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("k")).subtract(t(spark, d, "lineitem").where("l_quantity > 49").select("l_partkey"))


@query("SELECT p_partkey AS k FROM part WHERE p_size < 25 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def set_intersection(spark, d):
    return t(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("k")).intersect(t(spark, d, "lineitem").where("l_quantity > 49").select("l_partkey"))


@query("SELECT p_partkey AS rule_id, coalesce(b.p_size, a.p_size) AS p_size FROM part a LEFT JOIN (SELECT p_partkey, -p_size AS p_size FROM part WHERE p_partkey % 5 = 0) b USING (p_partkey)")
def rules_last_wins(spark, d):
    a = t(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), "p_size")
    return rules.merge_rules(a, a.where("rule_id % 5 = 0").withColumn("p_size", -F.col("p_size")))


@query("""SELECT p_partkey AS rule_id, p_brand AS family, CASE WHEN p_partkey % 10 = 0 THEN CASE WHEN p_partkey % 20 = 0 THEN [] ELSE NULL END WHEN p_brand IN ('Brand#11', 'Brand#12') THEN ['CWE-1'] END::VARCHAR[] AS cwe FROM part""")
def rules_with_cwe(spark, d):
    rs = t(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("family"))
    groups = spark.createDataFrame([("Brand#11", ["CWE-1"]), ("Brand#12", ["CWE-1"])], "family string, cwe array<string>")
    over = rs.where("rule_id % 10 = 0").select("rule_id", F.when(F.col("rule_id") % 20 == 0, F.array().cast("array<string>")).alias("cwe"))
    return registry.with_cwe(rs, groups, over)


@query()
def sarif_document(spark, d):
    f = doc_hits(spark, d).withColumn("path", F.col("doc_id").cast("string"))
    return sinks.sarif(f.select("rule_id", "level", "path", "line_no", "snippet"))


@query("SELECT page_id, CAST(length(html) AS INTEGER) AS length, CAST(length(html) AS INTEGER) AS was FROM pages")
def pages_without_comments(spark, d):
    """Blanking keeps every character's place; what is left is compared in comment_blanking."""
    return t(spark, d, "pages").select("page_id", F.length(comments.strip_comments(F.col("html"), F.lit("js"))).alias("length"), F.length("html").alias("was"))


@query()
def rulebook_findings(spark, d):
    """All built-in rules over all texts, as if every language could be any."""
    return rules.scan(t(spark, d, "documents").withColumn("any", F.lit(None).cast("string")), [rules.Rule(**{**r.__dict__, "langs": ()}) for r in RULES], ["doc_id"], lang="any")


from sievework.plans import catalog_docs, catalog_more, catalog_sinks  # noqa: E402, F401  their queries join the others
