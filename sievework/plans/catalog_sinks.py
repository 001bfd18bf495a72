"""Queries over what sinks write and read again, orders, merged findings, comments, twins by name, code facts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions import comments
from sievework.functions import text as T
from sievework.operators import findings as FI
from sievework.operators import lint_more, project, rules, skills
from sievework.plans.catalog import HITS, SKILLS, doc_hits, query, t, user_skills
from sievework.sources import sinks


def shared_folder(spark) -> str:
    """A new folder in spark.checkpoint.dir, or in a temporary one where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='sinks-')}"
    return f"{base.rstrip('/')}/sinks-{uuid.uuid4().hex}"


@query("""SELECT 'state' AS kind, c_mktsegment AS part, count(*) AS n FROM customer WHERE c_nationkey < 9 GROUP BY 2
UNION ALL SELECT 'appended', c_mktsegment, count(*) FROM customer WHERE c_nationkey < 15 GROUP BY 2
UNION ALL SELECT 'archived', strftime(o_orderdate, '%Y-%m'), count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'scene', n_name, 1 FROM nation""")
def sink_roundtrip(spark, d):
    """State of two versions, rows appended if absent, twice, monthly archives, and text by scene, as read again."""
    path, c, o = shared_folder(spark), t(spark, d, "customer"), t(spark, d, "orders")
    sinks.save_state(c.where("c_nationkey < 5"), f"{path}/state", 1)
    sinks.save_state(c.where("c_nationkey < 9"), f"{path}/state", 2)
    for most in (10, 10, 15):
        sinks.append_absent(spark, c.where(F.col("c_nationkey") < most), f"{path}/rows", ["c_custkey"])
    sinks.archive(o.select("o_orderkey", "o_orderdate"), f"{path}/archive", "o_orderdate")
    sinks.write_by_scene(t(spark, d, "nation").select(F.col("n_name").alias("scene"), F.concat(F.lit("# "), "n_name").alias("text")), f"{path}/scenes")
    counted = lambda df, kind, part: df.groupBy(F.lit(kind).alias("kind"), F.col(part).cast("string").alias("part")).agg(F.count("*").alias("n"))
    out = counted(sinks.load_state(spark, f"{path}/state"), "state", "c_mktsegment").union(counted(spark.read.parquet(f"{path}/rows"), "appended", "c_mktsegment"))
    month = spark.read.parquet(f"{path}/archive").withColumn("m", F.date_format("o_orderdate", "yyyy-MM"))
    return out.union(counted(month, "archived", "m")).union(counted(spark.read.text(f"{path}/scenes").where("value like '# %'"), "scene", "scene"))


@query(f"""{HITS} SELECT source, rule_id, doc_id, line_no, CAST(row_number() OVER (PARTITION BY source ORDER BY level, rule_id, doc_id, line_no) AS INTEGER) AS place FROM h WHERE level < 'P2' OR rule_id <> 'DOC-03'""")
def finding_order(spark, d):
    """Findings of all rules but one, in the order of reports, by source."""
    f = doc_hits(spark, d).where("level < 'P2' or rule_id <> 'DOC-03'").join(t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    place = F.row_number().over(W.partitionBy("source").orderBy("level", "rule_id", "doc_id", "line_no"))
    return f.select("source", "rule_id", "doc_id", "line_no", place.alias("place"))


@query(f"""{HITS}, u AS (SELECT 'docs' AS scanner, rule_id, doc_id FROM h UNION ALL SELECT 'words', 'X-1', doc_id FROM l WHERE regexp_matches(line, '[A-Z]{{8,}}'))
SELECT scanner, rule_id, count(*) AS n, count(DISTINCT doc_id) AS files FROM u GROUP BY 1, 2""")
def merged_findings(spark, d):
    """Findings of two scanners put together, one of them without a scene, counted by scanner."""
    a = doc_hits(spark, d).withColumns({"scanner": F.lit("docs"), "scene": F.lit("s")})
    b = rules.scan(t(spark, d, "documents"), [rules.Rule("X-1", "P3", "raised word", "[A-Z]{8,}")], ["doc_id"], pragma=None).withColumn("scanner", F.lit("words"))
    return FI.merge(a, b).groupBy("scanner", "rule_id").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("files"))


@query(r"""SELECT page_id, length(regexp_replace(regexp_replace(html, '("(?:\\.|[^"\\\n])*"|''(?:\\.|[^''\\\n])*''|`(?:\\.|[^`\\])*`)|//[^\n]*|(?s:/\*.*?(?:\*/|\z))', '\1', 'g'), '\s', '', 'g')) AS kept, length(html) AS size,
 length(regexp_replace(regexp_replace(html, '("(?:\\.|[^"\\\n])*"|''(?:\\.|[^''\\\n])*'')|#[^\n]*', '\1', 'g'), '\s', '', 'g')) AS hashed FROM pages""")
def comment_blanking(spark, d):
    """What is left of a text besides white space once comments are blanked, and that no character went."""
    c, h = (comments.strip_comments(F.col("html"), F.lit(x)) for x in ("ts", "py"))
    kept = lambda x: F.length(F.regexp_replace(x, r"\s", "")).cast("long")
    return t(spark, d, "pages").select("page_id", kept(c).alias("kept"), F.length(c).cast("long").alias("size"), kept(h).alias("hashed"))


@query("""WITH g AS (SELECT concat(lang, '/', doc_id % 40, '.md') AS path, doc_id % 40 || '.md' AS name, min(text) AS text FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path COLLATE "C") AS n FROM g), p AS (SELECT a.name, a.path AS a, b.path AS b, a.text AS x, b.text AS y FROM n a JOIN n b ON a.name = b.name AND a.n = 1 AND b.n = 2),
r AS (SELECT name, a, b, CAST(len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: x[i] = y[i])) AS DOUBLE) / greatest(length(x), length(y), 1) AS ratio FROM p)
SELECT name, a, b, ratio FROM r WHERE ratio >= 0.04 AND ratio < 0.995""")
def basename_forks(spark, d):
    """Files of one name that agree in part; a path's text is the first of its documents' in their order."""
    x = t(spark, d, "documents").select(F.concat("lang", F.lit("/"), F.col("doc_id") % 40, F.lit(".md")).alias("path"), "text").where("lang is not null and text is not null")
    return project.basename_forks(x.groupBy("path").agg(F.min("text").alias("text")), 0.04)


PY_TEXT = "concat('ZONES = [', CASE WHEN p_size % 5 = 0 THEN '\"a/\", \"b/\"' ELSE '\"a/\"' END, ']', chr(10), 'def test_a', p_partkey, '(x):', chr(10), '    assert ', CASE p_size % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'x == x' WHEN 2 THEN 'len(x) >= 0' ELSE 'x == 1' END, chr(10), CASE WHEN p_size % 3 = 0 THEN concat('def test_bad', p_partkey, '():', chr(10), '    pass', chr(10)) ELSE '' END, 'def check_b', p_partkey, '():', chr(10), '    return check_b', p_partkey + p_size, '()', chr(10))"


@query("""SELECT 'error' AS level, concat('f', p_partkey, '.py') AS file, 'always true, line 3' AS issue, '' AS hint FROM part WHERE p_size % 4 <> 3
UNION ALL SELECT 'warn', concat('f', p_partkey, '.py'), 'folders written out, line 1', '' FROM part WHERE p_size % 5 = 0
UNION ALL SELECT 'warn', concat('f', p_partkey, '.py'), 'tests of one sense only', '' FROM part WHERE p_size % 3 <> 0
UNION ALL SELECT 'error', concat('f', p_partkey, '.py'), concat('never called: check_b', p_partkey), '' FROM part WHERE p_partkey NOT IN (SELECT p_partkey + p_size FROM part)
UNION ALL SELECT 'error', concat('f', p_partkey, '.py'), concat('not defined: check_b', p_partkey + p_size), '' FROM part WHERE p_partkey + p_size NOT IN (SELECT p_partkey FROM part)""")
def lint_code(spark, d):
    """Assertions that always hold, folders written out, checks without calls and calls without checks."""
    return lint_more.code_checks(t(spark, d, "part").select(F.concat(F.lit("f"), "p_partkey", F.lit(".py")).alias("path"), F.expr(PY_TEXT).alias("text")))


@query(f"""WITH {SKILLS}, b AS (SELECT id FROM s ORDER BY hits DESC, id COLLATE "C" LIMIT 3)
SELECT id, CAST(hits + CASE WHEN id IN (SELECT id FROM b) THEN 1 ELSE 0 END AS INTEGER) AS hits, CASE WHEN id IN (SELECT id FROM b) THEN DATE '2025-01-02' ELSE last_used END AS last_used FROM s""")
def skill_bump(spark, d):
    """A snapshot after a search: its best three are hit once more, today."""
    s = user_skills(spark, d)
    return skills.bump(s, s.withColumn("score", F.lit(1)), "2025-01-02").select("id", "hits", "last_used")


@query(r"""WITH a AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9_]+')) AS x, list_distinct(regexp_extract_all(lower(p_type || ' ' || p_brand), '[a-z0-9_]+')) AS y FROM part)
SELECT p_partkey, CASE WHEN len(list_intersect(x, y)) < 2 THEN 0 ELSE len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) END AS score FROM a""")
def related_names(spark, d):
    words = lambda *c: F.array_distinct(T.ascii_tokens(F.concat_ws(" ", *c)))
    return t(spark, d, "part").select("p_partkey", T.related_score(words("p_name", "p_brand"), words("p_type", "p_brand")).alias("score"))
