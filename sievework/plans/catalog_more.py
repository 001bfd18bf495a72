"""Further queries of the catalog: consistency, verification, statements, whole-text matches, plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import consistency as C
from sievework.operators import findings as FI
from sievework.operators import project_rules, registry, routing, rules
from sievework.plans.catalog import DOMAINS, HITS, LINES, doc_hits, query, t
from sievework.sources import corpus, sinks


@query("""WITH tab AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS id, CAST(l_suppkey AS VARCHAR) AS path FROM lineitem WHERE l_quantity > 20),
blk AS (SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_size < 48), fil AS (SELECT CAST(s_suppkey AS VARCHAR) AS path FROM supplier WHERE s_acctbal > 0),
ref AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS id, CAST(l_suppkey AS VARCHAR) AS path FROM lineitem WHERE l_quantity < 40)
SELECT DISTINCT 'unknown_id' AS kind, id, CAST(NULL AS VARCHAR) AS path FROM tab WHERE id NOT IN (SELECT id FROM blk)
UNION ALL SELECT 'orphan', id, NULL FROM blk WHERE id NOT IN (SELECT id FROM tab)
UNION ALL SELECT 'broken_path', id, path FROM tab WHERE path NOT IN (SELECT path FROM fil)
UNION ALL SELECT 'not_referenced', id, path FROM (SELECT * FROM tab WHERE path IN (SELECT path FROM fil) EXCEPT SELECT * FROM ref)
UNION ALL SELECT 'undeclared', id, path FROM (SELECT * FROM ref EXCEPT SELECT * FROM tab)""")
def index_consistency(spark, d):
    """Parts stand for blocks, suppliers for files, line items for what an index says and for what files refer to."""
    line = t(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("path"), "l_quantity")
    blocks = t(spark, d, "part").where("p_size < 48").select(F.col("p_partkey").alias("id"))
    files = t(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("path"))
    return C.index_consistency(line.where("l_quantity > 20"), blocks, files, line.where("l_quantity < 40"))


TOK = "[a-z0-9_]{5,}"


@query(f"""WITH told AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS doc, unnest(regexp_extract_all(lower(text), '{TOK}')) AS tok FROM conversations WHERE role = 'assistant'),
pool AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS doc, unnest(regexp_extract_all(lower(text), '{TOK}')) AS tok FROM conversations WHERE role <> 'assistant'),
common AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{TOK}')) AS tok FROM benchmark)
SELECT doc, tok FROM told WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.doc = told.doc AND (p.tok IN (told.tok, told.tok || '2D', told.tok || '3D') OR length(told.tok) >= 6 AND length(p.tok) >= 6 AND (contains(p.tok, told.tok) OR contains(told.tok, p.tok))))
AND tok NOT IN (SELECT tok FROM common) AND NOT EXISTS (SELECT 1 FROM common p WHERE length(told.tok) >= 6 AND length(p.tok) >= 6 AND (contains(p.tok, told.tok) OR contains(told.tok, p.tok)))""")
def twin_coverage(spark, d):
    """Words of the answers of a conversation that neither its other turns nor the benchmark hold, names inside names
    counted."""
    words = lambda df: df.withColumn("tok", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TOK), F.lit(0))))
    conv = words(t(spark, d, "conversations").withColumn("doc", F.col("conv_id").cast("string")))
    return C.uncovered(conv.where("role = 'assistant'"), conv.where("role <> 'assistant'"), words(t(spark, d, "benchmark")))


@query("""WITH c AS (SELECT c_custkey AS id, c_custkey % 20 AS n FROM customer WHERE c_nationkey <> 3), k AS (SELECT o_custkey AS id, o_orderkey AS file FROM orders WHERE o_orderpriority NOT LIKE '5%'),
m AS (SELECT id AS d, count(DISTINCT file) AS m FROM k GROUP BY id), l AS (SELECT DISTINCT o_custkey AS id, o_orderkey AS file FROM orders WHERE o_orderstatus = 'O')
SELECT kind, CAST(id AS VARCHAR) AS id, detail FROM (SELECT CASE WHEN d IS NULL THEN 'ghost' WHEN id IS NULL THEN 'unregistered' WHEN n <> m THEN 'miscount' END AS kind, coalesce(id, d) AS id, CASE WHEN n <> m THEN concat(m, ' of ', n) ELSE '' END AS detail FROM c FULL JOIN m ON id = d) WHERE kind IS NOT NULL
UNION ALL SELECT 'missing', CAST(l.id AS VARCHAR), CAST(l.file AS VARCHAR) FROM l WHERE l.id IN (SELECT id FROM c) AND NOT EXISTS (SELECT 1 FROM k WHERE k.id = l.id AND k.file = l.file)""")
def claimed_counts(spark, d):
    """Customers claim numbers of orders; orders are what is there, open ones are linked."""
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("file"), "o_orderpriority", "o_orderstatus")
    claimed = t(spark, d, "customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 20).alias("n"))
    return C.claims(claimed, o.where("o_orderpriority not like '5%'").select("id", "file"), o.where("o_orderstatus = 'O'").select("id", "file"))


@query("""WITH s AS (SELECT concat(source, '/', lang) AS rule_id, CASE WHEN toxic = 1 THEN 'tp' ELSE 'fp' END AS kind, regexp_matches(text, 'idiot|moron|clown') AS hit FROM documents JOIN labels USING (doc_id)),
a AS (SELECT rule_id, count(*) FILTER (kind = 'tp') AS n1, count(*) FILTER (kind = 'tp' AND hit) AS o1, count(*) FILTER (kind = 'fp') AS n2, count(*) FILTER (kind = 'fp' AND NOT hit) AS o2 FROM s GROUP BY 1),
v AS (SELECT DISTINCT concat(source, '/', lang) AS rule_id FROM documents)
SELECT recall, precision, count(*) AS n FROM (SELECT CASE WHEN coalesce(n1, 0) = 0 THEN 'unverified' WHEN o1 = n1 THEN 'pass' ELSE 'fail' END AS recall, CASE WHEN coalesce(n2, 0) = 0 THEN 'unverified' WHEN o2 = n2 THEN 'pass' ELSE 'fail' END AS precision FROM v LEFT JOIN a USING (rule_id)) GROUP BY 1, 2""")
def evaluation_distribution(spark, d):
    docs = t(spark, d, "documents").withColumn("rule_id", F.concat("source", F.lit("/"), "lang"))
    s = docs.join(t(spark, d, "labels"), "doc_id").select("rule_id", F.when(F.col("toxic") == 1, "tp").otherwise("fp").alias("kind"), F.col("text").rlike("idiot|moron|clown").alias("hit"))
    return C.evaluation_distribution(docs.select("rule_id").distinct().where("rule_id is not null").join(FI.evaluate(s), "rule_id", "left"))


@query("""WITH r AS (SELECT user_id AS id, CASE event_type WHEN 'click' THEN 'refuted' WHEN 'view' THEN 'verified' ELSE 'skipped' END AS result FROM events WHERE value > 5 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT c_nationkey, count(*) AS total, count(*) FILTER (result IS NULL) AS open, count(*) FILTER (result = 'verified') AS verified, count(*) FILTER (result = 'refuted') AS refuted, count(*) FILTER (result = 'skipped') AS skipped FROM customer LEFT JOIN r ON c_custkey = id GROUP BY 1""")
def verification_counts(spark, d):
    items = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    result = F.when(F.col("event_type") == "click", "refuted").when(F.col("event_type") == "view", "verified").otherwise("skipped")
    state = t(spark, d, "events").where("value > 5").select(F.col("user_id").alias("id"), result.alias("result"), F.struct("ts", "event_id").alias("at"))
    return C.verification_counts(items, state, ["c_nationkey"])


@query(f"""WITH {LINES}, w AS (SELECT *, max(CASE WHEN regexp_matches(line, 'with') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS seen FROM l)
SELECT doc_id, count(*) FILTER (seen = 1) AS n FROM w GROUP BY doc_id""")
def context_lines(spark, d):
    return rules.near(corpus.lines(t(spark, d, "documents"), ["doc_id"]), ["doc_id"], "with").groupBy("doc_id").agg(F.count_if("seen").alias("n"))


@query(f"""WITH {LINES}, h AS (SELECT doc_id, line_no AS hn FROM l WHERE regexp_matches(line, '^The |\\('))
, j AS (SELECT h.doc_id, hn, l.line_no AS n, line, sum(length(line) - length(replace(line, '(', '')) - length(line) + length(replace(line, ')', ''))) OVER (PARTITION BY h.doc_id, hn ORDER BY l.line_no) AS depth
  FROM h JOIN l ON h.doc_id = l.doc_id AND l.line_no BETWEEN hn AND hn + 11),
e AS (SELECT doc_id, hn, min(n) AS last FROM j WHERE depth <= 0 AND (contains(line, ';') OR contains(line, ')')) GROUP BY ALL)
SELECT j.doc_id, CAST(j.hn AS INTEGER) AS line_no, md5(string_agg(line, ' ' ORDER BY n)) AS digest FROM j LEFT JOIN e ON j.doc_id = e.doc_id AND j.hn = e.hn WHERE n <= coalesce(last, 1000000000) GROUP BY ALL""")
def statement_spans(spark, d):
    found = C.statements(corpus.lines(t(spark, d, "documents"), ["doc_id"]), ["doc_id"], r"^The |\(")
    return found.select("doc_id", "line_no", F.md5("statement").alias("digest"))


@query(f"""WITH {LINES}, o AS (SELECT doc_id, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) AS no FROM (SELECT DISTINCT doc_id FROM l)),
h AS (SELECT doc_id, line_no, trim(regexp_extract(line, 'with (.*)', 1)) AS claim, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS seq FROM l WHERE regexp_matches(line, 'with (.*)'))
SELECT 'V' || CASE WHEN no < 10 THEN '0' ELSE '' END || no || CASE WHEN seq < 10 THEN '0' ELSE '' END || seq AS id, CAST(h.doc_id AS VARCHAR) AS path, line_no, claim FROM h JOIN o USING (doc_id)""")
def numbered_points(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return C.numbered_points(corpus.lines(docs, ["path"]), "with (.*)")


@query("""WITH s AS (SELECT doc_id, d.domain, len(list_filter(d.w, lambda k: contains(lower(text), k))) AS hits FROM documents, (VALUES ('art', ['les', 'dans']), ('core', ['the', 'with']), ('net', ['der', 'und', 'nicht'])) d(domain, w)),
b AS (SELECT doc_id, domain, hits + CASE WHEN domain = 'core' THEN 1 ELSE 0 END AS hits FROM s WHERE hits > 0),
r AS (SELECT *, lead(hits) OVER w AS second, row_number() OVER w AS n FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY hits DESC, CASE WHEN domain = 'core' THEN 0 ELSE 1 END, domain))
SELECT d.doc_id, domain, CAST(coalesce(hits, 0) AS INTEGER) AS hits, CASE WHEN hits IS NULL THEN 'none' WHEN second IS NULL THEN CASE WHEN hits >= 2 THEN 'high' ELSE 'medium' END WHEN hits = second THEN 'undecided' WHEN hits - second >= 2 THEN 'high' ELSE 'medium' END AS confidence
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND n = 1""")
def domain_recommend(spark, d):
    docs = t(spark, d, "documents")
    return C.recommend(routing.keyword_counts(docs, "doc_id", "text", DOMAINS), "doc_id", docs.select("doc_id"), "core")


@query(r"""SELECT conv_id, turn, coalesce(substr(sha1(text), 1, 16), 'empty') AS fingerprint,
  CASE WHEN contains(lower(text), 'mac') THEN 'os:darwin' WHEN contains(lower(text), 'win') THEN 'os:windows' WHEN contains(lower(text), 'linux') THEN 'os:linux' ELSE coalesce(regexp_extract(text, '(?i)py(?:thon)?\s*(?:>=|<=|==|>|<)\s*[0-9.]+'), '') END AS env,
  len(list_distinct(list_concat(regexp_extract_all(text, '`([A-Za-z_][A-Za-z0-9_.]*)`', 1), regexp_extract_all(text, '[a-z0-9]+(?:_[a-z0-9]+)+'), regexp_extract_all(text, '[A-Z][a-z0-9]+(?:[A-Z][A-Za-z0-9]*)+'), list_filter(regexp_extract_all(text, '[A-Za-z0-9_\x{80}-\x{10ffff}]+'), lambda w: regexp_matches(w, '^[a-z]{4,}$'))))) AS names
FROM conversations""")
def draft_marks(spark, d):
    """Fingerprint, environment and number of names of each turn; its text has no [env: ...] tags and no CJK."""
    plain = F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_\\x{80}-\\x{10ffff}]+"), F.lit(0)), lambda w: w.rlike("^[a-z]{4,}$"))
    names = F.array_union(F.filter(C.sibling_tokens(F.col("text")), lambda w: ~w.rlike("^[a-z]{4,}$")), F.array_union(plain, F.regexp_extract_all("text", F.lit("`([a-z]{4,})`"), F.lit(1))))
    return t(spark, d, "conversations").select("conv_id", "turn", C.draft_fingerprint(F.col("text")).alias("fingerprint"), C.environment_hint(F.col("text")).alias("env"), F.size(names).cast("long").alias("names"))


@query(r"""WITH m AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, x, string_split_regex(text, '(the|tion)\s+[a-z]+') AS p FROM (SELECT doc_id, text, regexp_extract_all(text, '(?:the|tion)\s+[a-z]+') AS x FROM documents)),
p AS (SELECT doc_id, i, x[i] AS hit, array_to_string(p[1:i], '') || array_to_string(x[1:i-1], '') AS before FROM m)
SELECT doc_id, CAST(1 + length(before) - length(replace(before, chr(10), '')) AS INTEGER) AS line_no, count(*) AS n, min(hit) AS first FROM p GROUP BY ALL""")
def whole_text_matches(spark, d):
    """Every match that may run over lines, with the line it begins on."""
    found = t(spark, d, "documents").select("doc_id", F.explode(rules.whole_matches(F.col("text"), r"(?:the|tion)\s+[a-z]+")).alias("m"))
    return found.groupBy("doc_id", "m.line_no").agg(F.count("*").alias("n"), F.min("m.hit").alias("first"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_custkey AS c FROM orders WHERE o_orderpriority NOT LIKE '1%'), b AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS s, o_custkey AS c FROM orders WHERE o_orderpriority NOT LIKE '2%')
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'add' WHEN b.k IS NULL THEN 'drop' ELSE 'change' END AS action FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s IS DISTINCT FROM b.s OR a.c IS DISTINCT FROM b.c""")
def change_plan(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("c"), "o_orderpriority")
    wanted = o.where("o_orderpriority not like '2%'").withColumn("s", F.when(F.col("c") % 4 == 0, "X").otherwise(F.col("s")))
    return sinks.propose(o.where("o_orderpriority not like '1%'"), wanted, "k", ["s", "c"]).select("k", "action")


@query("""WITH p AS (SELECT concat(url, '#', page_id) AS path FROM pages), o AS (SELECT path, row_number() OVER (ORDER BY path COLLATE "C") - 1 AS n, count(*) OVER () // 30 AS step FROM p)
SELECT path FROM o WHERE n % step = 0 AND n // step < 30""")
def sampled_paths(spark, d):
    """The systematic sample over paths, which share long beginnings."""
    return corpus.systematic_sample(t(spark, d, "pages").select(F.concat("url", F.lit("#"), "page_id").alias("path")), "path", 30)


@query("""WITH f AS (SELECT 'flow/n' || p_partkey || '.md' AS file FROM part WHERE p_size < 30), e AS (SELECT 'n' || s_suppkey || '.md' AS name FROM supplier)
SELECT 'warn' AS level, file, 'procedure without an entry' AS issue, '' AS hint FROM f WHERE substr(file, 6) NOT IN (SELECT name FROM e)""")
def lint_flow_entry(spark, d):
    flows = t(spark, d, "part").select(F.concat(F.lit("flow/n"), "p_partkey", F.lit(".md")).alias("file"), F.when(F.col("p_size") < 30, "procedure").otherwise("table").alias("type"))
    return C.flow_entry(flows, t(spark, d, "supplier").select(F.concat(F.lit("For this, go to [n"), "s_suppkey", F.lit(".md](flow).")).alias("text")))


@query("""WITH c AS (SELECT 'check_' || p_partkey AS name FROM part), s AS (SELECT 'check_' || s_suppkey AS name FROM supplier), i AS (SELECT 'check_' || c_custkey AS name FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT CASE WHEN name IN (SELECT name FROM i) THEN 'info' ELSE 'warn' END AS level, 'lint.py' AS file, 'no self-test calls ' || name AS issue, '' AS hint FROM c WHERE name NOT IN (SELECT name FROM s)""")
def lint_check_coverage(spark, d):
    checks = t(spark, d, "part").select(F.concat(F.lit("check_"), "p_partkey").alias("name"), F.lit("lint.py").alias("file"))
    tests = t(spark, d, "supplier").select(F.concat(F.lit("assert check_"), "s_suppkey", F.lit("(cfg) == []")).alias("text"))
    why = t(spark, d, "customer").select(F.concat(F.lit("check_"), "c_custkey").alias("name"), F.when(F.col("c_mktsegment") == "BUILDING", "by another check").otherwise(" ").alias("reason"))
    return C.check_coverage(checks, tests, why)


@query("""WITH k AS (SELECT DISTINCT 'a/' || l_suppkey AS path FROM lineitem WHERE l_quantity > 49)
SELECT 'warn' AS level, n_name AS file, 'root is absolute: /' || n_name AS issue, '' AS hint FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 'error', 'a/' || s_suppkey, 'link to an absolute path: /x/' || s_suppkey, '' FROM supplier WHERE s_nationkey < 5
UNION ALL SELECT 'error', 'a/' || s_suppkey, 'link is tracked', '' FROM supplier WHERE 'a/' || s_suppkey IN (SELECT path FROM k)
UNION ALL SELECT 'warn', 'a/' || p_partkey, 'asset isn''t tracked', '' FROM part WHERE 'a/' || p_partkey NOT IN (SELECT path FROM k)""")
def lint_domains_in_repo(spark, d):
    roots = t(spark, d, "nation").select(F.col("n_name").alias("domain"), F.concat(F.when(F.col("n_regionkey") == 1, "/").otherwise("d/"), "n_name").alias("root"))
    links = t(spark, d, "supplier").select(F.concat(F.lit("a/"), "s_suppkey").alias("path"), F.concat(F.when(F.col("s_nationkey") < 5, "/x/").otherwise("../"), "s_suppkey").alias("target"))
    tracked = t(spark, d, "lineitem").where("l_quantity > 49").select(F.concat(F.lit("a/"), "l_suppkey").alias("path"))
    return C.domains_in_repo(roots, links, t(spark, d, "part").select(F.concat(F.lit("a/"), "p_partkey").alias("path")), tracked)


@query(f"""{HITS}, s AS (SELECT rule_id, level, CAST(doc_id AS VARCHAR) AS path, line_no, substr(trim(line), 1, 120) AS snippet FROM h)
SELECT '[' || level || '] ' || rule_id || ': ' || count(*) AS text FROM s GROUP BY level, rule_id UNION ALL SELECT '  ' || path || ':' || line_no || '  ' || snippet FROM s""")
def findings_report(spark, d):
    f = doc_hits(spark, d).withColumn("path", F.col("doc_id").cast("string"))
    return sinks.report(f.select("rule_id", "level", "path", "line_no", "snippet"))


@query(f"""{HITS} SELECT DISTINCT rule_id, CAST(doc_id AS VARCHAR) AS uri, line_no, substr(trim(line), 1, 120) AS snippet FROM h""")
def sarif_roundtrip(spark, d):
    """What a reader finds in the SARIF document of the findings."""
    f = doc_hits(spark, d).withColumn("path", F.col("doc_id").cast("string"))
    shape = "runs array<struct<results array<struct<ruleId string, message struct<text string>, locations array<struct<physicalLocation struct<artifactLocation struct<uri string>, region struct<startLine int>>>>>>>>"
    doc = sinks.sarif(f.select("rule_id", "level", "path", "line_no", "snippet")).select(F.from_json("document", shape).alias("d"))
    r = doc.select(F.explode("d.runs").alias("run")).select(F.explode("run.results").alias("r"))
    place = F.col("r.locations")[0].physicalLocation
    return r.select(F.col("r.ruleId").alias("rule_id"), place.artifactLocation.uri.alias("uri"), place.region.startLine.alias("line_no"), F.col("r.message.text").alias("snippet"))


NAMES = "list_distinct(list_concat(regexp_extract_all({c}, '[\\x{{4e00}}-\\x{{9fff}}]'), regexp_extract_all(lower({c}), '[a-z0-9_]{{2,}}')))"


@query(rf"""WITH p AS (SELECT DISTINCT p_type AS name FROM part), r AS (SELECT 'R' || p_partkey AS rule_id, p_name || ' ' || p_type AS title FROM part),
i AS (SELECT 'T' || row_number() OVER (ORDER BY name COLLATE "C") AS id, name FROM p),
s AS (SELECT rule_id, id, len(list_intersect({NAMES.format(c="title")}, {NAMES.format(c="name")})) AS c, len({NAMES.format(c="title")}) + len({NAMES.format(c="name")}) AS n FROM r, i)
SELECT rule_id, id AS item, c::DOUBLE / (n - c) AS score FROM s WHERE c::DOUBLE / (n - c) >= 0.32::DOUBLE""")
def name_pairs(spark, d):
    """Names with a Jaccard index of 0.32 or more, by a prefix filter on rare tokens."""
    from pyspark.sql import Window as W

    part = t(spark, d, "part")
    rs = part.select(F.concat(F.lit("R"), "p_partkey").alias("rule_id"), T.name_tokens(F.concat_ws(" ", "p_name", "p_type")).alias("tokens"))
    kinds = part.select(F.col("p_type").alias("name")).distinct()  # a kind for each type, few
    items = kinds.select(F.concat(F.lit("T"), F.row_number().over(W.orderBy("name"))).alias("id"), T.name_tokens(F.col("name")).alias("tokens"))
    return registry.name_candidates(rs, items, registry.REVIEW)


TS_TEXT = "concat('import { a', p_size, ' } from ', chr(39), './f', p_size, chr(39), ';', chr(10), 'import x from ', chr(39), './f', p_size % 7, chr(39), ';', chr(10), 'export const v', p_partkey, ' = a', p_size, ';', chr(10), 'export function g', p_partkey % 90, '() { return v', (p_partkey + 1) % 50, ' }')"


@query(f"""WITH f AS (SELECT concat('src/f', p_partkey, '.ts') AS path, p_partkey, p_size, {TS_TEXT} AS text FROM part),
e AS (SELECT path, unnest([3, 4]) AS line_no, unnest([concat('v', p_partkey), concat('g', p_partkey % 90)]) AS name FROM f),
k AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')) AS name FROM f), n AS (SELECT name, count(*) AS n FROM k GROUP BY 1),
i AS (SELECT path, unnest([1, 2]) AS line_no, unnest([concat('./f', p_size), concat('./f', p_size % 7)]) AS spec FROM f)
SELECT 'APP-G09' AS rule_id, 'P2' AS level, path, CAST(line_no AS INTEGER) AS line_no, e.name AS snippet FROM e JOIN n ON e.name = n.name WHERE n <= 1
UNION ALL SELECT 'APP-P02', 'P2', path, 1, '' FROM f WHERE path NOT IN (SELECT concat('src/', substr(spec, 3), '.ts') FROM i WHERE concat('src/', substr(spec, 3), '.ts') <> i.path)
UNION ALL SELECT 'APP-G08', 'P2', path, 2, spec FROM i GROUP BY path, spec HAVING count(*) > 1
UNION ALL SELECT 'APP-P03', 'P2', 'package.json', 1, 'check, lint' UNION ALL SELECT 'APP-P01', 'P2', '.gitignore', 1, unnest(['node_modules', '.env'])
UNION ALL SELECT 'APP-R08', 'P2', concat('r/m', s_suppkey, '.rs'), 1, '' FROM supplier WHERE s_suppkey % 3 <> 0""")
def project_findings(spark, d):
    """Whole-project rules over sources written from parts, and a Rust tree from suppliers."""
    f = t(spark, d, "part").select(F.concat(F.lit("src/f"), "p_partkey", F.lit(".ts")).alias("path"), F.expr(TS_TEXT).alias("text"))
    s = t(spark, d, "supplier")
    rust = s.select(F.concat(F.lit("r/m"), "s_suppkey", F.lit(".rs")).alias("path"), F.lit("fn f() {}").alias("text"))
    uses = s.where("s_suppkey % 3 = 0").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("pub mod m"), "s_suppkey", F.lit(";")))), "\n").alias("text"))
    fixed = spark.createDataFrame([("package.json", '{"scripts": {"lint": "x", "check": "y", "build": "z"}}'), (".gitignore", "/dist/\n*.log")], "path string, text string")
    return project_rules.project_findings(f.union(rust).union(uses.select(F.lit("r/main.rs").alias("path"), "text")).union(fixed))
