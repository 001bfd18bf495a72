"""Queries over Markdown that is written from the parts table, and over registries written from the other tables.

MD is one expression for both engines; what is found in the text is worked out by each for itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import findings as FI
from sievework.operators import lint, lint_more, project, registry, similar, skills, spans
from sievework.plans.catalog import query, t
from sievework.sources import corpus, markdown

MD = """concat('---', chr(10), 'id: X', p_size, chr(10), 'name: ', p_name, chr(10), CASE WHEN p_partkey % 3 = 0 THEN concat('trigger: [a, ', p_size, ']', chr(10)) ELSE '' END, '---', chr(10),
 CASE WHEN p_partkey % 11 = 0 THEN '# Overview ' ELSE '# Procedure ' END, p_brand, chr(10), 'source: ', CASE WHEN p_partkey % 4 = 0 THEN 'nothing' ELSE 'a/b.md' END, chr(10),
 '## AB-', p_size, ' ', p_type, chr(10), 'see #EC-', p_size * 2, ' and [x](n', p_partkey + p_size, '.md#ec-', p_partkey, '-block) or n', p_size, '.md item ', p_size % 4, chr(10),
 CASE WHEN p_partkey % 5 = 0 THEN concat('## AB-', p_size, ' ', p_type, chr(10), '  ## indented', chr(10), '# # doubled', chr(10)) ELSE '' END,
 '## 二、a', chr(10), CASE WHEN p_partkey % 6 = 0 THEN concat('## 二、b', chr(10)) ELSE '' END, CASE WHEN p_partkey % 9 = 0 THEN concat('## Seam', chr(10)) ELSE '' END,
 '## EC-', p_partkey, ' block', chr(10), '1. one', chr(10), '2) two', chr(10), '```', chr(10), '# not a heading', chr(10), 'run a/b', p_size, '.py', chr(10), '```', chr(10),
 '| k | v |', chr(10), '|---|---|', chr(10), '| AB-', p_size, ' | x', p_size, CASE WHEN p_partkey % 7 = 0 THEN ' | extra' ELSE '' END, ' |', chr(10), '| k2 | y |', chr(10), chr(10), '| lone |', chr(10),
 p_size, ' files here', chr(10), '<!-- lint: foo-exempt ', CASE WHEN p_partkey % 2 = 0 THEN 'because of history' ELSE '' END, ' -->', chr(10), '<!-- [A] draft ', p_size, ' -->', chr(10), 'plain end')"""
DOCS = f"d AS (SELECT concat('n', p_partkey, '.md') AS path, {MD} AS text FROM part)"
LINED = f"""{DOCS}, l0 AS (SELECT path, CAST(i AS INTEGER) AS line_no, x[i] AS line FROM (SELECT path, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT path, string_split(text, chr(10)) AS x FROM d))),
l AS (SELECT *, regexp_matches(line, '^[ \\t]*```') OR sum(CASE WHEN regexp_matches(line, '^[ \\t]*```') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) % 2 = 1 AS fenced, lag(line) OVER (PARTITION BY path ORDER BY line_no) AS above, lead(line) OVER (PARTITION BY path ORDER BY line_no) AS below FROM l0)"""
CELLS = r"list_transform(string_split(regexp_replace(regexp_replace(trim({c}), '^\|', ''), '\|$', ''), '|'), lambda x: trim(x))"
ROWS = rf"""{LINED}, b AS (SELECT *, line_no - row_number() OVER (PARTITION BY path ORDER BY line_no) AS island FROM l WHERE regexp_matches(line, '^\s*\|') AND NOT fenced),
r AS (SELECT *, {CELLS.format(c="line")} AS cells, first_value({CELLS.format(c="line")}) OVER (PARTITION BY path, island ORDER BY line_no) AS header, row_number() OVER (PARTITION BY path, island ORDER BY line_no) AS n, dense_rank() OVER (PARTITION BY path ORDER BY island) AS table_no FROM b)"""


def docs(spark, d):
    """Dealt out as parts, which are small, before their texts are written."""
    part = corpus.spread(t(spark, d, "part"), "p_partkey")
    return part.select(F.concat(F.lit("n"), "p_partkey", F.lit(".md")).alias("path"), F.expr(MD).alias("text"))


@query(rf"""WITH {DOCS}, e AS (SELECT path, unnest(string_split(regexp_extract(text, '^---\n([\s\S]*?)\n---', 1), chr(10))) AS line FROM d)
SELECT path, regexp_extract(line, '^([^:]*):', 1) AS name, CASE WHEN regexp_matches(trim(regexp_extract(line, '^[^:]*:(.*)$', 1)), '^\[.*\]$') THEN list_transform(string_split(regexp_extract(line, '\[(.*)\]', 1), ','), lambda x: trim(x)) ELSE [trim(regexp_extract(line, '^[^:]*:(.*)$', 1))] END AS "values"
FROM e WHERE regexp_matches(line, '^[A-Za-z_][A-Za-z0-9_-]*:')""")
def md_front_matter(spark, d):
    return markdown.front_matter(docs(spark, d), "path")


SECTIONS = rf"""{LINED}, s AS (SELECT *, regexp_matches(line, '^#{{1,6}} ') AND NOT fenced AS head FROM l), n AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS no FROM s),
sec AS (SELECT path, CAST(no AS BIGINT) AS section_no, max(CASE WHEN head THEN regexp_replace(line, '^#+ +', '') END) AS title, max(CASE WHEN head THEN length(regexp_extract(line, '^(#+)', 1)) END) AS level, coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY line_no), '') AS body FROM n GROUP BY path, no)"""


@query(rf"""WITH {SECTIONS} SELECT path, section_no, title, CAST(level AS INTEGER) AS level, md5(body) AS body, CAST(trunc(len(regexp_extract_all(body, '[\x{{4e00}}-\x{{9fff}}]')) * 1.5::DOUBLE + (length(body) - len(regexp_extract_all(body, '[\x{{4e00}}-\x{{9fff}}]'))) / 4) AS INTEGER) AS tokens FROM sec""")
def md_sections(spark, d):
    return markdown.sections(docs(spark, d), "path").withColumn("body", F.md5("body"))


@query(rf"""WITH {SECTIONS} SELECT path, section_no, title, substr(trim(body), 1, 300) AS block FROM sec WHERE length(trim(body)) >= 12""")
def md_blocks(spark, d):
    return markdown.blocks(docs(spark, d), "path")


@query(rf"""WITH {SECTIONS}, rr AS (SELECT path, {CELLS.format(c="line")} AS cells FROM (SELECT *, line_no - row_number() OVER (PARTITION BY path ORDER BY line_no) AS island FROM l WHERE regexp_matches(line, '^\s*\|') AND NOT fenced)
 QUALIFY row_number() OVER (PARTITION BY path, island ORDER BY line_no) > 1)
SELECT path, regexp_extract(title, '^([A-Z]+-?[0-9]+) ', 1) AS id, regexp_extract(title, '^[A-Z]+-?[0-9]+ +(.*)$', 1) AS name, length(body) AS size FROM sec WHERE regexp_matches(title, '^[A-Z]+-?[0-9]+ ')
UNION ALL SELECT path, cells[1], cells[2], length(coalesce(cells[3], '')) FROM rr WHERE len(cells) IN (2, 3) AND regexp_matches(cells[1], '^[A-Z]+-?[0-9]+$')""")
def md_items(spark, d):
    return markdown.items(docs(spark, d), "path").select("path", "id", "name", F.length("body").cast("long").alias("size"))


@query(rf"""WITH {ROWS} SELECT path, CAST(table_no AS INTEGER) AS table_no, line_no, header, cells FROM r WHERE n > 1 AND NOT regexp_matches(line, '^[\s|:-]+$')""")
def md_table_rows(spark, d):
    return markdown.table_rows(docs(spark, d), "path")


@query(rf"""WITH {LINED} SELECT path, line_no, CASE WHEN regexp_matches(line, '<!-- *\[[A-Z]\][^>]*? *-->') THEN regexp_extract(line, '<!-- *(\[[A-Z]\][^>]*?) *-->', 1) ELSE trim(line) END AS draft FROM l
WHERE regexp_matches(line, '<!-- *\[[A-Z]\][^>]*? *-->') OR NOT contains(line, '<!--') AND NOT regexp_matches(line, '^\s*(\||#|$)')""")
def md_drafts(spark, d):
    return markdown.drafts(docs(spark, d), "path")


@query(rf"""WITH {LINED}, o AS (SELECT path, length(regexp_extract(line, '^(#+)', 1)) AS depth, instr('一二三四五六七八九十', regexp_extract(line, '^#+ +([一二三四五六七八九十]+)、', 1)) AS no FROM l WHERE NOT fenced AND regexp_matches(line, '^#+ +[一二三四五六七八九十]+、'))
SELECT 'warn' AS level, path AS file, concat(CASE WHEN regexp_matches(line, '^#+ +#+ ') THEN 'doubled heading mark' ELSE 'indented heading' END, ', line ', line_no) AS issue, '' AS hint FROM l WHERE NOT fenced AND (regexp_matches(line, '^#+ +#+ ') OR regexp_matches(line, '^ {{1,3}}#{{1,6}} '))
UNION ALL SELECT 'warn', path, 'heading repeated: ' || trim(regexp_replace(line, '^#+', '')), '' FROM l WHERE NOT fenced AND regexp_matches(line, '^#{{1,6}} ') GROUP BY path, trim(regexp_replace(line, '^#+', '')) HAVING count(*) > 1
UNION ALL SELECT 'error', path, concat('number repeated: ', no), '' FROM o GROUP BY path, depth, no HAVING count(*) > 1""")
def lint_headings(spark, d):
    ls = docs(spark, d)
    return lint.united(lint.headings(ls, "path"), lint.duplicate_headings(ls, "path"), lint.heading_numbers(ls, "path"))


@query(rf"""WITH {ROWS}, hd AS (SELECT DISTINCT path, table_no, header FROM r WHERE n > 1 AND NOT regexp_matches(line, '^[\s|:-]+$')),
dg AS (SELECT path, table_no, c, count(*) AS n, count(DISTINCT cells[c]) AS v FROM r, range(1, 3) t(c) WHERE n > 1 AND len(cells) >= c GROUP BY ALL)
SELECT 'error' AS level, path AS file, concat('line ', line_no, ': ', len(cells), ' cells, not ', len(header)) AS issue, '' AS hint FROM r WHERE len(cells) <> len(header)
UNION ALL SELECT 'warn', path, concat('row without a table, line ', line_no), '' FROM l WHERE regexp_matches(line, '^\s*\|') AND NOT fenced AND NOT coalesce(regexp_matches(above, '^\s*\|'), false) AND NOT coalesce(regexp_matches(below, '^\s*\|'), false)
UNION ALL SELECT 'warn', path, concat('header of another form in table ', table_no), '' FROM hd WHERE header <> ['a', 'b']""")
def lint_tables(spark, d):
    ls = docs(spark, d)
    return lint.united(lint.table_columns(ls, "path"), lint.lone_table_rows(ls, "path"), lint_more.antipattern_tables(ls, [["a", "b"]]))


@query(rf"""WITH {LINED}, ec AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?m)^#+ .*\b(EC-[0-9]+)', 1)) AS id FROM d), er AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '#(EC-[0-9]+)', 1)) AS ref FROM d),
hs AS (SELECT path, unnest(regexp_extract_all(text, '(?m)^#{{1,6}} +(.*)$', 1)) AS h FROM d), ha AS (SELECT DISTINCT path || '#' || replace(regexp_replace(lower(trim(h)), '[^a-z0-9一-鿿 _-]', '', 'g'), ' ', '-') AS id FROM hs),
lk AS (SELECT path, unnest(regexp_extract_all(text, '\]\(([^)\s]*#[^)\s]+)\)', 1)) AS tg FROM d), lr AS (SELECT DISTINCT path, CASE WHEN starts_with(tg, '#') THEN path ELSE string_split(tg, '#')[1] END || '#' || string_split(tg, '#')[-1] AS ref FROM lk),
nr AS (SELECT DISTINCT path, replace(m, ' item ', '#') AS ref FROM (SELECT path, unnest(regexp_extract_all(text, '[A-Za-z0-9_/-]+\.md item [0-9]+')) AS m FROM d)), nh AS (SELECT path || '#' || unnest(regexp_extract_all(text, '(?m)^([0-9]+)[.)] ', 1)) AS id FROM d),
cp AS (SELECT DISTINCT path, unnest(regexp_extract_all(line, '(?:^|[\s''"])((?:[A-Za-z0-9_-]+/)+[A-Za-z0-9_-]+\.[a-z]{{1,4}})', 1)) AS ref FROM l WHERE fenced)
SELECT 'error' AS level, path AS file, 'block missing: ' || ref AS issue, '' AS hint FROM er WHERE ref NOT IN (SELECT id FROM ec)
UNION ALL SELECT 'error', path, 'anchor missing: ' || ref, '' FROM lr WHERE ref NOT IN (SELECT id FROM ha)
UNION ALL SELECT 'error', path, 'item missing: ' || ref, '' FROM nr WHERE ref NOT IN (SELECT id FROM nh)
UNION ALL SELECT 'warn', path, 'path in a block missing: ' || ref, '' FROM cp WHERE ref NOT IN (SELECT 'a/b' || s_suppkey || '.py' FROM supplier)""")
def lint_references(spark, d):
    have = t(spark, d, "supplier").select(F.concat(F.lit("a/b"), "s_suppkey", F.lit(".py")).alias("path"))
    x = docs(spark, d)
    return lint.united(lint_more.block_refs(x), lint_more.anchor_refs(x), lint_more.numbered_refs(x), lint_more.code_block_paths(x, have))


@query(rf"""WITH {LINED}, f AS (SELECT path, regexp_extract(x, '^([^:]*):', 1) AS name, trim(regexp_extract(x, '^[^:]*:(.*)$', 1)) AS v FROM (SELECT path, unnest(string_split(regexp_extract(text, '^---\n([\s\S]*?)\n---', 1), chr(10))) AS x FROM d) WHERE regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_-]*:')),
ex AS (SELECT path, line_no, regexp_extract(line, 'lint: *([a-z-]+)-exempt', 1) AS name, trim(regexp_extract(line, '-exempt *(.*?)(?:-->)?\s*$', 1)) AS why FROM l WHERE regexp_matches(line, 'lint: *([a-z-]+)-exempt')),
sh AS (SELECT path, len(string_split(text, chr(10))) AS n, len(regexp_extract_all(text, '(?m)^#{{1,3}} ')) AS s FROM d)
SELECT 'error' AS level, path AS file, 'no ' || name AS issue, '' AS hint FROM (SELECT path, name FROM d, (VALUES ('id'), ('name'), ('trigger')) k(name)) w WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.path = w.path AND f.name = w.name)
UNION ALL SELECT 'error', min(path), 'id used twice: ' || v, '' FROM f WHERE name = 'id' GROUP BY v HAVING count(*) > 1
UNION ALL SELECT 'warn', path, concat('count written out, line ', line_no), '' FROM l WHERE regexp_matches(line, '[0-9]+ (files|rules|checks|items)')
UNION ALL SELECT 'warn', path, 'exemption that no check reads: ' || name, '' FROM ex UNION ALL SELECT 'warn', path, 'exemption without a reason: ' || name, '' FROM ex WHERE length(why) < 10
UNION ALL SELECT 'warn', path, 'procedure without a seam', '' FROM d WHERE regexp_matches(text, '(?m)^# *Procedure') AND NOT regexp_matches(text, '(?mi)^#+ *(seam|hand-over)')
UNION ALL SELECT 'warn', path, concat('source without a path, line ', line_no), '' FROM l WHERE regexp_matches(line, '(?i)^\s*>? *source:') AND NOT regexp_matches(line, '[A-Za-z0-9_-]+/[A-Za-z0-9_.-]+|https?://')
UNION ALL SELECT 'warn', path, concat(n, ' lines, ', s, ' sections'), 'near the limit' FROM sh WHERE n >= 28 AND n <= 35 OR s > 6""")
def lint_notes(spark, d):
    x = docs(spark, d)
    ls = corpus.lines(x, ["path"])
    readers = x.select(F.lit("bar").alias("name")).limit(1)
    return lint.united(lint.front_matter(markdown.front_matter(x, "path"), "path", x), lint.volatile_counts(ls, "path"), lint_more.exemptions(ls, readers), lint_more.seams(x), lint_more.provenance(ls), lint.shape(x, "path", "text", 35, 0.8, 6))


@query("""WITH f AS (SELECT n_name || '/f.md' AS path, CASE WHEN n_nationkey % 3 = 0 THEN 'sys.exit(1)' WHEN n_nationkey % 3 = 1 THEN '# Entry' ELSE 'exitcode sys.exit(2)' END AS text FROM nation UNION ALL SELECT n_name || '/README.md', CASE WHEN n_nationkey % 2 = 0 THEN '# Entry' ELSE 'none' END FROM nation WHERE n_regionkey < 3),
z AS (SELECT DISTINCT string_split(path, '/')[1] AS zone FROM f), dm AS (SELECT s_suppkey AS domain, CASE WHEN s_suppkey % 5 = 0 THEN 'none' || s_suppkey ELSE n_name END AS root FROM supplier JOIN nation ON s_nationkey = n_nationkey),
st AS (SELECT concat('flow', o_custkey % 40) AS file, CAST(row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS INTEGER) AS line_no, concat('s', o_orderkey % 23) AS step_id, CASE WHEN o_orderkey % 9 = 0 THEN 'dance' ELSE 'do' END AS type, o_orderkey % 23 AS no FROM orders),
gp AS (SELECT *, lag(no) OVER (PARTITION BY file ORDER BY no) AS was FROM st)
SELECT 'error' AS level, CAST(domain AS VARCHAR) AS file, 'root missing: ' || root AS issue, '' AS hint FROM dm WHERE root NOT IN (SELECT zone FROM z)
UNION ALL SELECT 'error', file, 'step id repeated: ' || step_id, '' FROM st GROUP BY file, step_id HAVING count(*) > 1 UNION ALL SELECT 'error', file, 'unknown step type: ' || type, '' FROM st WHERE type <> 'do' UNION ALL SELECT 'warn', file, 'step missing before ' || step_id, '' FROM gp WHERE no - was > 1
UNION ALL SELECT 'warn', path, 'exits without the table of codes', '' FROM f WHERE contains(text, 'sys.exit(') AND NOT contains(text, 'exitcode')
UNION ALL SELECT 'error', r_name, 'zone is empty', '' FROM region WHERE r_name NOT IN (SELECT zone FROM z) UNION ALL SELECT 'warn', zone, 'zone is not declared', '' FROM z WHERE zone NOT IN (SELECT r_name FROM region)
UNION ALL SELECT 'warn', n_name, CASE WHEN n_regionkey >= 3 THEN 'no index' ELSE 'index without an entry section' END, '' FROM nation WHERE n_regionkey >= 3 OR n_nationkey % 2 = 1
UNION ALL SELECT 'error', CAST(min(l_suppkey) AS VARCHAR), concat('limits differ: ', l_partkey), '' FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_quantity) > 1""")
def lint_registries(spark, d):
    n = t(spark, d, "nation")
    text = F.when(F.col("n_nationkey") % 3 == 0, "sys.exit(1)").when(F.col("n_nationkey") % 3 == 1, "# Entry").otherwise("exitcode sys.exit(2)")
    f = n.select(F.concat("n_name", F.lit("/f.md")).alias("path"), text.alias("text")).union(n.where("n_regionkey < 3").select(F.concat("n_name", F.lit("/README.md")), F.when(F.col("n_nationkey") % 2 == 0, "# Entry").otherwise("none")))
    s = t(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    dm = s.select(F.col("s_suppkey").alias("domain"), F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("none"), "s_suppkey")).otherwise(F.col("n_name")).alias("root"))
    no = F.col("o_orderkey") % 23
    st = t(spark, d, "orders").select(F.concat(F.lit("flow"), F.col("o_custkey") % 40).alias("file"), F.lit(1).alias("line_no"), F.concat(F.lit("s"), no).alias("step_id"), F.when(F.col("o_orderkey") % 9 == 0, "dance").otherwise("do").alias("type"))
    zone = t(spark, d, "region").select(F.col("r_name").alias("zone"))
    limits = t(spark, d, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("place"), F.col("l_quantity").alias("value"))
    return lint.united(lint_more.roots(dm, f), lint_more.flow_steps(st), lint_more.exit_code_adoption(f), lint_more.zones(zone, f), lint_more.zone_index(f), lint_more.sibling_limits(limits))


@query("""WITH w AS (SELECT DISTINCT p_size FROM part WHERE p_size <= 10), h AS (SELECT p_brand, count(DISTINCT p_size) AS n FROM part WHERE p_size IN (SELECT p_size FROM w) GROUP BY 1), k AS (SELECT count(*) AS n FROM w)
SELECT 'warn' AS level, p_brand AS file, concat('holds ', h.n, ' of ', k.n, ' values') AS issue, '' AS hint FROM h, k WHERE h.n >= 0.6 * k.n
UNION ALL SELECT 'warn', CAST(s_suppkey AS VARCHAR), 'info without a check', '' FROM supplier WHERE s_nationkey % 2 = 0 AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)
UNION ALL SELECT 'error', CAST(c_nationkey AS VARCHAR), concat('never called: ', c_custkey), '' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def lint_coverage(spark, d):
    part, s = t(spark, d, "part"), t(spark, d, "supplier")
    copies = lint.covered_share(part, part.where("p_size <= 10"), "p_brand", "p_size")
    issues = s.select(F.when(F.col("s_nationkey") % 2 == 0, "info").otherwise("warn").alias("level"), F.col("s_suppkey").alias("file"), F.col("s_nationkey").alias("check"))
    unwired = lint_more.unwired(t(spark, d, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("name")), t(spark, d, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("name")))
    return lint.united(copies, lint_more.attributable(issues, t(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("name"))), unwired)


@query("SELECT p_partkey AS id, 'f' || p_size AS target FROM part WHERE NOT contains(coalesce((SELECT max(n_comment) FROM (SELECT 'f' || n_nationkey AS f, 'old ' || n_name || ' text' AS n_comment FROM nation) x WHERE f = 'f' || p_size), ''), 'old') OR p_size > 24")
def stale_mutations(spark, d):
    m = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("f"), "p_size").alias("target"), F.lit("old").alias("old"))
    return FI.stale_mutations(m, t(spark, d, "nation").select(F.concat(F.lit("f"), "n_nationkey").alias("path"), F.concat(F.lit("old "), "n_name", F.lit(" text")).alias("text")))


IDS = "concat(CASE p_size % 4 WHEN 0 THEN 'TS-C' WHEN 1 THEN 'C-' WHEN 2 THEN 'GD' ELSE 'x' END, p_size)"


@query(rf"""WITH i AS (SELECT p_partkey, {IDS} AS id, CASE p_size % 3 WHEN 0 THEN 'scan-ts' WHEN 1 THEN 'scan-app' ELSE 'scan-py' END AS scanner, concat('P', p_size % 5) AS level, p_name FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(upper(id), '^(?:[A-Z]+-)?([A-Z])-?([0-9]+)$') THEN regexp_extract(upper(id), '^(?:[A-Z]+-)?([A-Z])-?([0-9]+)$', 1) || lpad(regexp_extract(upper(id), '^(?:[A-Z]+-)?([A-Z])-?([0-9]+)$', 2), 2, '0') ELSE upper(id) END AS norm,
 CASE WHEN regexp_matches(id, '^(TS-|APP-|PY-|RS-|GO-|JV-|CPP-|CC-|GD)') THEN id WHEN scanner = 'scan-ts' THEN 'TS-' || id WHEN scanner = 'scan-app' THEN 'APP-' || id ELSE id END AS unified,
 CASE level WHEN 'P0' THEN 'error' WHEN 'P1' THEN 'warning' ELSE 'note' END AS severity, CASE level WHEN 'P0' THEN 'P0' WHEN 'P1' THEN 'P1' ELSE 'P2' END AS back, substr(md5(id || '|' || level || '|' || p_name), 1, 8) AS signature FROM i""")
def rule_ids(spark, d):
    scanner = F.when(F.col("p_size") % 3 == 0, "scan-ts").when(F.col("p_size") % 3 == 1, "scan-app").otherwise("scan-py")
    i = t(spark, d, "part").select("p_partkey", "p_name", F.expr(IDS).alias("id"), scanner.alias("scanner"), F.concat(F.lit("P"), F.col("p_size") % 5).alias("level"))
    sev = T.severity(F.col("level"))
    return i.select("p_partkey", T.norm_id(F.col("id")).alias("norm"), T.unified_id(F.col("id"), F.col("scanner")).alias("unified"), sev.alias("severity"), T.level_of(sev).alias("back"), T.rule_signature(F.col("id"), F.col("level"), F.col("p_name")).alias("signature"))


PATHS = "concat(CASE p_size % 5 WHEN 0 THEN '/repo/' WHEN 1 THEN './' WHEN 2 THEN '../' ELSE '' END, 'm', p_size % 7, CASE WHEN p_partkey % 2 = 0 THEN concat('/x/../y', p_size, '/./') ELSE '' END, CASE WHEN p_size % 6 = 5 THEN '.md' ELSE '/f.ts' END)"


@query(rf"""WITH p AS (SELECT p_partkey, {PATHS} AS path FROM part), r AS (SELECT p_partkey, path, regexp_replace(CASE WHEN starts_with(path, '/repo/') THEN substr(path, 7) ELSE path END, '^(\.{{1,2}}/)+', '') AS rel FROM p)
SELECT p_partkey, rel, CASE WHEN contains(rel, '/') THEN string_split(rel, '/')[1] ELSE '(root)' END AS module, CASE regexp_extract(rel, '\.([A-Za-z0-9]+)$', 1) WHEN 'ts' THEN 'ts' WHEN 'md' THEN 'md' END AS lang, regexp_replace(replace(replace(rel, '/x/../', '/'), '/./', '/'), '/+', '/', 'g') AS normal, rel = 'm3' OR starts_with(rel, 'm3/') OR starts_with(rel, 'm4/') AS excluded FROM r""")
def path_functions(spark, d):
    rel = T.relative_path(F.expr(PATHS), "/repo")
    r = t(spark, d, "part").select("p_partkey", rel.alias("rel"))
    return r.select("p_partkey", "rel", T.module_of(F.col("rel")).alias("module"), corpus.language(F.col("rel")).alias("lang"), T.posix_normal(F.col("rel")).alias("normal"), corpus.excluded(F.col("rel"), ("m3", "m4/")).alias("excluded"))


@query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{3,}'))) AS features, len(list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}'))) AS identifiers, len(regexp_extract_all(lower(text), '[0-9]+ (?:files|rules|items|tests|checks)')) AS claims,
 len(regexp_extract_all(text, 'the ')) AS the, len(regexp_extract_all(text, 'und')) AS und, list_filter(['the', 'then', 'and', 'under'], lambda k: regexp_matches(lower(text), '(?:^|[^a-z0-9_])' || k || '(?:[^a-z0-9_]|$)')) AS raw FROM documents""")
def word_functions(spark, d):
    c = F.col("text")
    counts = T.domain_counts(c, {"the": "the ", "und": "und"})
    hits = T.keyword_hits(c, ["the", "then", "and", "under"])  # a hit inside a longer one goes; put back for the comparison
    the = c.rlike(r"(?i)(?:^|[^a-zA-Z0-9_])the(?:[^a-zA-Z0-9_]|$)")
    raw = T.let(hits, lambda h: F.filter(F.array(*[F.lit(k) for k in ("the", "then", "and", "under")]), lambda k: F.array_contains(h, k) | ((k == "the") & F.array_contains(h, F.lit("then")) & the)))
    sized = lambda x: F.size(x).cast("long")
    return t(spark, d, "documents").select("doc_id", sized(T.feature_words(c)).alias("features"), sized(T.keywords_of(c, F.lit(""), 1 << 20)).alias("identifiers"), sized(T.numeric_claims(c)).alias("claims"), F.coalesce(counts["the"], F.lit(0)).cast("long").alias("the"), F.coalesce(counts["und"], F.lit(0)).cast("long").alias("und"), raw.alias("raw"))


@query("""WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, concat('d', s_nationkey % 4) AS domain, s_suppkey % 9 AS hits FROM supplier)
SELECT domain, CAST(row_number() OVER (PARTITION BY domain ORDER BY hits DESC, id COLLATE "C") AS INTEGER) AS n, concat('- ', id, ' (', hits, ') ', name) AS line FROM s""")
def skill_index(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("d"), F.col("s_nationkey") % 4).alias("domain"), (F.col("s_suppkey") % 9).alias("hits"))
    return skills.index_lines(s)


@query("""SELECT s_suppkey AS id, (s_nationkey % 3 <> 0 OR s_nationkey % 2 = 0) AND CASE WHEN s_suppkey % 2 = 0 THEN 8 + s_suppkey % 5 <= 10 AND (s_suppkey % 4 = 0 OR 10 < 10 + s_suppkey % 3) ELSE true END AS fits FROM supplier""")
def environment_fits(spark, d):
    s = t(spark, d, "supplier")
    os = F.when(F.col("s_nationkey") % 3 != 0, F.when(F.col("s_nationkey") % 3 == 1, "linux")).otherwise(F.when(F.col("s_nationkey") % 2 == 0, "linux").otherwise("mac"))
    e = s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "py").otherwise("go").alias("tool"), F.concat(F.lit("3."), 8 + F.col("s_suppkey") % 5).alias("lo"), F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("3."), 10 + F.col("s_suppkey") % 3)).alias("hi"), os.alias("os"))
    return skills.environment_fits(e, "linux", {"py": "3.10.0"}).select("id", "fits")


@query("""WITH a AS (SELECT c_custkey % 300 AS path, c_nationkey AS event, c_custkey % 5 AS handler FROM customer), r AS (SELECT o_custkey % 300 AS path, o_orderkey % 25 AS event, o_orderkey % 5 AS handler FROM orders),
x AS (SELECT path, event FROM a INTERSECT SELECT path, event FROM r)
SELECT path, event FROM x WHERE NOT EXISTS (SELECT 1 FROM a JOIN r ON a.path = r.path AND a.event = r.event AND a.handler = r.handler WHERE a.path = x.path AND a.event = x.event)""")
def unmatched_handlers(spark, d):
    a = t(spark, d, "customer").select((F.col("c_custkey") % 300).alias("path"), F.col("c_nationkey").cast("long").alias("event"), (F.col("c_custkey") % 5).alias("handler"))
    r = t(spark, d, "orders").select((F.col("o_custkey") % 300).alias("path"), (F.col("o_orderkey") % 25).alias("event"), (F.col("o_orderkey") % 5).alias("handler"))
    return project.unmatched_handlers(a, r).select("path", "event")


@query("""WITH f AS (SELECT concat('m', p_size, '/f', p_partkey % 17, CASE WHEN p_partkey % 3 = 0 THEN '.ts' WHEN p_partkey % 3 = 1 THEN '/index.ts' ELSE '.js' END) AS path FROM part),
i AS (SELECT DISTINCT concat('m', l_suppkey % 50, '/a.ts') AS path, concat('../m', l_partkey % 50, '/./f', l_orderkey % 19) AS spec, concat('m', l_partkey % 50, '/f', l_orderkey % 19) AS base FROM lineitem)
SELECT path, spec FROM i WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.path IN (base, base || '.ts', base || '.js', base || '/index.ts', base || '/index.js'))""")
def missing_imports(spark, d):
    f = t(spark, d, "part").select(F.concat(F.lit("m"), "p_size", F.lit("/f"), F.col("p_partkey") % 17, F.when(F.col("p_partkey") % 3 == 0, ".ts").when(F.col("p_partkey") % 3 == 1, "/index.ts").otherwise(".js")).alias("path"))
    i = t(spark, d, "lineitem").select(F.concat(F.lit("m"), F.col("l_suppkey") % 50, F.lit("/a.ts")).alias("path"), F.concat(F.lit("../m"), F.col("l_partkey") % 50, F.lit("/./f"), F.col("l_orderkey") % 19).alias("spec")).distinct()
    return project.missing_imports(i, f)


@query("""WITH f AS (SELECT concat(lang, '/', source, '/', doc_id % 60, '.md') AS path, concat(source, '/', doc_id) AS real FROM documents), n AS (SELECT real, min(path) AS path FROM f GROUP BY real), c AS (SELECT DISTINCT concat('x/', doc_id % 90, '.md') AS path FROM documents)
SELECT path FROM c WHERE string_split(path, '/')[-1] NOT IN (SELECT string_split(path, '/')[-1] FROM n WHERE path IS NOT NULL)""")
def promised_paths(spark, d):
    """Paths that no file meets; files that several paths lead to count once."""
    x = t(spark, d, "documents")
    f = corpus.dedup_links(x.select(F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id") % 60, F.lit(".md")).alias("path"), F.concat("source", F.lit("/"), "doc_id").alias("real_path")))
    return project.promised(x.select(F.concat(F.lit("x/"), F.col("doc_id") % 90, F.lit(".md")).alias("path")).distinct(), f).select("path")


@query(r"""WITH f AS (SELECT DISTINCT source AS module, unnest(['the', 'token', 'Schriebe', 'nowhere', 'SECRET', 'Zu']) AS field FROM documents),
k AS (SELECT source AS module, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS field FROM documents), n AS (SELECT module, field, count(*) AS n FROM k GROUP BY ALL)
SELECT f.module, f.field, coalesce(n, 0) AS n FROM f LEFT JOIN n ON f.module = n.module AND f.field = n.field WHERE coalesce(n, 0) <= 1""")
def rare_fields(spark, d):
    x = t(spark, d, "documents")
    f = x.select(F.col("source").alias("module"), F.explode(F.array(*map(F.lit, ["the", "token", "Schriebe", "nowhere", "SECRET", "Zu"]))).alias("field")).distinct()
    return project.rare_fields(f, x.select(F.col("source").alias("module"), F.col("text").alias("line")))


@query("""WITH r AS (SELECT DISTINCT concat('T', p_size) AS rule_id, p_type AS name FROM part), it AS (SELECT DISTINCT concat('T-', p_size) AS id, p_type AS name FROM part QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) = 1)
SELECT rule_id, name FROM r WHERE name IN (SELECT name FROM it WHERE id = 'T-' || substr(r.rule_id, 2))""")
def matched_by_id(spark, d):
    """Findings whose item has the same number and the same name."""
    from pyspark.sql import Window as W

    part = t(spark, d, "part")
    it = part.withColumn("n", F.row_number().over(W.partitionBy("p_size").orderBy("p_partkey"))).where("n = 1").select(F.concat(F.lit("T-"), "p_size").alias("id"), F.col("p_type").alias("name"))
    r = part.select(F.concat(F.lit("T"), "p_size").alias("rule_id"), F.col("p_type").alias("name")).distinct()
    none = r.select("rule_id", F.lit(None).cast("string").alias("item")).limit(0)
    found = registry.match_findings(r, it, none)
    return found.join(it.select(F.col("id").alias("item"), F.col("name").alias("iname")), "item").where("name = iname and substring(item, 3) = substring(rule_id, 2)").select("rule_id", "name")


@query("""WITH a AS (SELECT p_partkey, string_split(p_name, ' ') AS x, string_split(lower(p_type), ' ') AS y FROM part)
SELECT p_partkey FROM a WHERE len(list_filter(list_intersect(list_distinct(x), list_distinct(y)), lambda w: w <> 'small')) >= 1""")
def relevant_links(spark, d):
    links = t(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("x"), F.split(F.lower("p_type"), " ").alias("y"))
    return similar.relevant(links, "x", "y", ["small"]).select("p_partkey")


CODE = "concat('func a', p_size, '():', chr(10), chr(9), 'x', chr(10), chr(10), chr(9), 'hit', chr(10), CASE WHEN p_partkey % 2 = 0 THEN concat(chr(9), 'hit', chr(10)) ELSE '' END, 'func b():', chr(10), chr(9), 'hit')"


@query(rf"""WITH l AS (SELECT p_partkey, CAST(i AS INTEGER) AS line_no, x[i] AS line FROM (SELECT p_partkey, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT p_partkey, string_split({CODE}, chr(10)) AS x FROM part))),
h AS (SELECT p_partkey, regexp_extract(line, '^func +([A-Za-z0-9_]+)', 1) AS name, line_no AS hs, lead(line_no) OVER (PARTITION BY p_partkey ORDER BY line_no) AS nx FROM l WHERE regexp_matches(line, '^func ')),
e AS (SELECT p_partkey, max(line_no) AS last FROM l GROUP BY 1)
SELECT h.p_partkey, name AS span, CAST(hs - 1 AS INTEGER) AS s, CAST(coalesce(nx - 1, last) AS INTEGER) AS e, (SELECT min(line_no) FROM l WHERE l.p_partkey = h.p_partkey AND line LIKE '%hit' AND line_no > hs AND line_no <= coalesce(nx - 1, last)) AS line_no FROM h JOIN e ON h.p_partkey = e.p_partkey""")
def indent_span_hits(spark, d):
    """The first hit in each body of a language with significant indentation."""
    ls = corpus.lines(t(spark, d, "part").select("p_partkey", F.expr(CODE).alias("text")), ["p_partkey"])
    hits = ls.where(F.col("line").endswith("hit")).withColumn("rule_id", F.lit("X"))
    return spans.once_per_span(spans.in_spans(hits, spans.indent_spans(ls, ["p_partkey"]), ["p_partkey"]), ["p_partkey"]).select("p_partkey", "span", "s", "e", "line_no")


BRACES = "concat('f', p_size, '() {', chr(10), ' if (x) {', chr(10), ' }', chr(10), CASE WHEN p_partkey % 2 = 0 THEN concat(' on(a)', chr(10)) ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN concat(' off(a)', chr(10)) ELSE '' END, '}', chr(10), 'g() {', chr(10), ' off(a)', chr(10), '}')"


@query("""SELECT p_partkey, concat('f', p_size) AS span, CAST(4 AS INTEGER) AS line_no FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0""")
def unpaired_registrations(spark, d):
    """Registrations without a clean-up in their own body of at most twelve lines."""
    ls = corpus.lines(t(spark, d, "part").select("p_partkey", F.expr(BRACES).alias("text")), ["p_partkey"])
    body = spans.brace_spans(ls, ["p_partkey"], r"^([a-z][0-9]*)\(\) \{", cap=12)
    on, off = (spans.in_spans(ls.where(F.col("line").contains(w)), body, ["p_partkey"]) for w in (" on(", " off("))
    return spans.unpaired(on, off, ["p_partkey", "span"]).select("p_partkey", "span", "line_no")
