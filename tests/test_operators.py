import pytest
from pyspark.sql import functions as F

from sievework.operators import lint, project, registry, routing, rulebook, rules, skills, spans
from sievework.sources import corpus, markdown, sinks
from sievework.streaming.audit import audit_stream


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, lang string, text string")


SAMPLES = [  # (rule, language, hits, misses)
    ("TS-A05", "ts", "x = y >>> 0;", "x = y >> 1;"),
    ("APP-J01", "ts", "w.addEventListener('message', f)", "w.addEventListener('message', e => e.origin)"),
    ("APP-J03", "ts", "p.postMessage(x, '*')", "p.postMessage(x, host)"),
    ("PY-L02", "py", "except Exception:\n    pass", "except Exception:\n    raise"),
    ("PY-L07", "py", "run(a, shell=True)", "run(a)"),
    ("RS-03", "rust", "unsafe { x }", "// SAFETY: checked\nunsafe { x }"),
    ("GO-01", "go", "go func() { f() }()", "go func() { <-ctx.Done() }()"),
    ("JV-01", "java", "catch (E e) { }", "catch (E e) { log(e); }"),
    ("CPP-01", "cpp", "strcpy(a, b);", "strncpy(a, b, n);"),
    ("GD08", "gd", "x.instance()", "x.instantiate()"),
]


def test_rules_hit_and_miss(spark):
    rows = [(f"{r}/{k}", lang, text) for r, lang, *ts in SAMPLES for k, text in zip(("tp", "fp"), ts)]
    got = {(r.path, r.rule_id) for r in rules.scan(files(spark, rows), rulebook.RULES, ["path"]).collect()}
    for r, *_ in SAMPLES:
        assert (f"{r}/tp", r) in got and (f"{r}/fp", r) not in got, r


def test_rulebook_is_sound():
    assert rules.rule_errors(rulebook.RULES) == [] and len({r.rule_id for r in rulebook.RULES}) == len(rulebook.RULES)


def test_pragma_first_hit_and_nulls(spark):
    rows = [("a", "py", "run(shell=True) # audit: ignore\nrun(shell=True)\nx\nrun(shell=True)"), ("b", "py", None), ("c", None, "run(shell=True)")]
    got = rules.scan(files(spark, rows), [r for r in rulebook.RULES if r.rule_id in ("PY-L07", "PY-L02")], ["path"]).collect()
    assert sorted((r.path, r.line_no) for r in got if r.rule_id == "PY-L07") == [("a", 4)]
    assert rules.scan(files(spark, []), rulebook.RULES, ["path"]).count() == 0


def test_spans(spark):
    text = "class A {\n foo() {\n  if (x) {\n  }\n }\n bar() {\n }\n}"
    ls = corpus.lines(files(spark, [("a", "ts", text)]), ["path"])
    got = sorted((r.name, r.s, r.e) for r in spans.brace_spans(ls, ["path"], r"^\s*(foo|bar)\(\) \{").collect())
    assert got == [("bar", 5, 7), ("foo", 1, 5)]
    hits = spans.in_spans(ls.where("line like '%if%'"), spans.brace_spans(ls, ["path"], r"^\s*(foo|bar)\(\) \{"), ["path"]).collect()
    assert [h.span for h in hits] == ["foo"]
    gd = corpus.lines(files(spark, [("a", "gd", "func a():\n\tx\n\n\ty\nfunc b():\n\tz")]), ["path"])
    assert sorted((r.name, r.s, r.e) for r in spans.indent_spans(gd, ["path"]).collect()) == [("a", 0, 4), ("b", 4, 6)]


def test_project_checks(spark):
    imp = spark.createDataFrame([("a/x.ts", "./y"), ("a/x.ts", "../z"), ("a/x.ts", "lib")], "path string, spec string")
    fs = spark.createDataFrame([("a/y.ts",), ("b/z.ts",)], "path string")
    assert [tuple(r) for r in project.missing_imports(imp, fs).collect()] == [("a/x.ts", "../z")]
    two = spark.createDataFrame([("a/m.ts", "abcdefgh"), ("b/m.ts", "abcdefgX"), ("c/o.ts", "q")], "path string, text string")
    assert [(r.name, r.ratio) for r in project.basename_forks(two).collect()] == [("m.ts", 0.875)]
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert sorted(map(tuple, project.reachable(e, roots).collect())) == [("a", 0), ("b", 1), ("c", 2)]
    nodes = spark.createDataFrame([("a",), ("d",)], "node string")
    assert [r.node for r in project.unreachable(nodes, e, roots).collect()] == ["d"]


def test_markdown(spark):
    text = "---\nid: a\nkeys: [x, y]\n---\npre\n# T\nbody\n```\n# no\n```\n## A-1 name\nsee B-2\n| id | n |\n|---|---|\n| C-3 | na\\|me |"
    docs = spark.createDataFrame([("f", text)], "path string, text string")
    fm = {r.name: r["values"] for r in markdown.front_matter(docs, "path").collect()}
    assert fm == {"id": ["a"], "keys": ["x", "y"]}
    assert [r.title for r in markdown.sections(docs, "path").orderBy("section_no").collect()] == [None, "T", "A-1 name"]
    got = {r.id: (r.name, r.xrefs) for r in markdown.items(docs, "path").collect()}
    assert got["A-1"][0] == "name" and "B-2" in got["A-1"][1] and got["C-3"][0] == "na|me"
    d = spark.createDataFrame([("f", "<!-- [A] idea -->\n<!-- gone\nstill -->\nplain\n# h\n| t |")], "path string, text string")
    assert [r.draft for r in markdown.drafts(d, "path").orderBy("line_no").collect()] == ["[A] idea", "plain"]


def test_settings():
    value, errors = corpus.parse_settings("a: 1\nb:\n  c: [x,\n   y]\n  c: 2\nd:\n  - e\n  - f\nlost\na: 3")
    assert value["d"] == ["e", "f"] and errors == ["repeated: b.c", "orphan: lost", "repeated: a"]


def test_sources(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.py").write_text("x = 1")
    (tmp_path / "m" / "test_a.py").write_text("y")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "b.py").write_text("z")
    (tmp_path / "c.min.js").write_text("q")
    got = [(r.path, r.module, r.lang, r.text) for r in corpus.read_files(spark, str(tmp_path), tests=False).collect()]
    assert got == [("m/a.py", "m", "py", "x = 1")]


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([("R1", "P0", "a", 3, "s"), ("R1", "P0", "a", 3, "s"), ("R2", "P2", "b", 1, "t")], "rule_id string, level string, path string, line_no int, snippet string")
    sinks.write_sarif(f, str(tmp_path / "sarif"))
    back = corpus.findings_of_sarif(spark, str(tmp_path / "sarif")).orderBy("rule_id").collect()
    assert [(r.rule_id, r.level, r.path, r.line_no) for r in back] == [("R1", "P0", "a", 3), ("R2", "P2", "b", 1)]
    log = str(tmp_path / "log")
    assert sinks.append_absent(spark, f.select("rule_id", "path"), log, ["rule_id"]) == 2
    assert sinks.append_absent(spark, f.select("rule_id", "path"), log, ["rule_id"]) == 0
    sinks.save_state(spark.range(2), str(tmp_path / "st"), 1)
    sinks.save_state(spark.range(3), str(tmp_path / "st"), 2)
    assert sinks.load_state(spark, str(tmp_path / "st")).count() == 3
    days = spark.createDataFrame([("2024-01-03",), ("2024-02-01",)], "d string").select(F.to_date("d").alias("day"))
    assert sinks.archive(days, str(tmp_path / "ar")) == 2


def test_lint(spark):
    docs = spark.createDataFrame([("a.md", "# A\n# A\n ## x\n|a|b|\n|1|\n\n|lone|\n[l](b.md) [m](no.md)\n# 一、q\n# 一、r"), ("b.md", "ok")], "path string, text string")
    issues = {(r.file, r.issue) for r in lint.check_documents(docs).collect()}
    for what in ("heading repeated: A", "indented heading, line 3", "line 5: 1 cells, not 2", "row without a table, line 7", "missing target: no.md", "number repeated: 1"):
        assert ("a.md", what) in issues, (what, issues)
    assert not [i for i in issues if "b.md" in i[1]]


def test_skills(spark):
    s = spark.createDataFrame([("a", "sort rows", "x", "archive", ["sort"], "", 1), ("b", "other", "x", "hot", ["q"], "", 20)], "id string, name string, domain string, tier string, keywords array<string>, trigger string, hits int").withColumn("last_used", F.lit("2024-01-01").cast("date"))
    found = skills.find(s, ["sorting"])
    assert [(r.id, r.score) for r in found.collect()] == [("a", 1)]
    bumped = {r.id: (r.hits, r.tier) for r in skills.bump(s, found, "2024-02-01").collect()}
    assert bumped == {"a": (2, "cold"), "b": (20, "hot")}
    assert {r.id: r.advice for r in skills.tiers(s, "2024-02-15").collect()} == {"a": "archive", "b": "cold"}
    env = spark.createDataFrame([("1", "py", "3.8", "3.10", None), ("2", "py", "3.11", None, None), ("3", "rg", None, None, "mac")], "id string, tool string, lo string, hi string, os string")
    assert [r.fits for r in skills.environment_fits(env, "linux", {"py": "3.9"}).orderBy("id").collect()] == [True, False, False]


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "in")
    files(spark, [("a", "py", "run(shell=True)")]).write.parquet(src)
    run = lambda: audit_stream(spark, src, "path string, lang string, text string", str(tmp_path / "out"), str(tmp_path / "cp"), rulebook.RULES, ["path"]).awaitTermination()
    run()
    files(spark, [("b", "py", "run(shell=True)")]).write.mode("append").parquet(src)
    run()
    assert sorted(r.path for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_routing(spark):
    fs = files(spark, [("a.py", "py", "eval(x)"), ("package.json", "json", "{}"), ("sub/package.json", "json", "{}")])
    got = {r.scene: r.score for r in routing.rank_scenes(routing.evidence(fs, routing.SIGNALS)).collect()}
    assert got["p-python"] == 1040 and got["s-sandbox"] == 1040 and got["s-build"] == 1040


def test_mapping_prefers_ids(spark):
    r = spark.createDataFrame([("A", "x"), ("B", "alpha beta"), ("C", "zz")], "rule_id string, title string")
    i = spark.createDataFrame([("A", "other"), ("Q", "alpha beta gamma")], "id string, name string")
    none = spark.createDataFrame([], "rule_id string, item string")
    assert sorted(map(tuple, registry.map_rules(r, i, none, none).collect())) == [("A", "A", "id"), ("B", "Q", "name"), ("C", None, "open")]


@pytest.mark.parametrize("glob,path,hit", [("**/*.ts", "a/b.ts", True), ("*.ts", "a/b.ts", False), ("src/**", "src/a/b", True)])
def test_globs(spark, glob, path, hit):
    from sievework.functions.text import glob_regex

    assert spark.range(1).select(F.lit(path).rlike(glob_regex(glob))).first()[0] is hit


def test_syntax_tree_rules(spark):
    from sievework.operators import python_rules

    bad = "import pickle, os\nSTATE = []\ndef f(a=[]):\n    a.append(1)\n    STATE.append(a)\n    try:\n        pickle.loads(a)\n    except Exception:\n        pass\n    os.system('x')\n    assert a\n    f = open('x')\n    print(password)\n"
    good = "import pytest\ndef f(a=None):\n    with open('x') as g:\n        return g\n    assert a\n"
    got = {(r.path, r.rule_id) for r in python_rules.scan_python(files(spark, [("bad", "py", bad), ("good", "py", good), ("broken", "py", "def ("), ("none", "py", None)])).collect()}
    assert {r for p, r in got if p == "bad"} == {"PY-01", "PY-08", "PY-05", "PY-02", "PY-10", "PY-09", "PY-03", "PY-06"} and not [r for p, r in got if p != "bad"]
    assert [r.path for r in python_rules.rule_errors(files(spark, [("broken", "py", "def ("), ("ok", "py", "x")])).collect()] == ["broken"]


def test_span_rules(spark):
    from sievework.operators import span_rules

    text = "func _process(d):\n\tprint(1)\n\tprint(2)\nfunc other():\n\tprint(3)\n\ta.connect(b)"
    ls = corpus.lines(files(spark, [("a", "gd", text), ("b", "gd", text + "\nfunc _exit_tree():\n\ta.disconnect(b)")]), ["path"])
    sp = spans.indent_spans(ls, ["path"])
    assert sorted((r.path, r.rule_id, r.line_no) for r in span_rules.scan_spans(ls, sp, ["path"]).collect()) == [("a", "GD107", 2), ("b", "GD107", 2)]
    assert [(r.path, r.rule_id) for r in span_rules.scan_pairs(ls, sp, ["path"]).collect()] == [("a", "GD15")]
    assert span_rules.long_spans(sp, ["path"], 2).count() == 4


def test_map_score_counts_keywords_scene_and_body(spark):
    r = spark.createDataFrame([("A", "alpha beta", "s"), ("B", "gamma delta", "t")], "rule_id string, title string, scene string")
    i = spark.createDataFrame([("X", "alpha", ["beta"], "s", "Alpha and BETA"), ("Y", "other", ["gam", "elt", "ta", ""], "t", "Delta"), ("Z", "none", None, "t", None)], "id string, name string, keywords array<string>, scene string, body string")
    got = {(x.rule_id, x.item): round(x.score, 6) for x in registry.map_candidates(r, i).collect()}
    assert got == {("A", "X"): round(0.5 + 0.07 + 0.08 + 0.15, 6), ("A", "Y"): 0.07, ("B", "Y"): round(0.20 + 0.08 + 0.075, 6)}
    none = r.select("rule_id", r.title.alias("item")).limit(0)
    assert sorted(map(tuple, registry.map_rules(r, i, none, none).collect())) == [("A", "X", "name"), ("B", "Y", "review")]


def test_rules_over_lines_without_rows_of_lines(spark):
    """Hits, guards at both ends of their window, pragmas, first hits and gates against plain Python, in a plan that makes
    no row of a line and shuffles only for first hits."""
    import re

    texts = ["x = eval(a)\nfor y\n" + "z\n" * 3 + "eval(b)\n\nsafe", "eval(a)\r\nend$\r\n", "# audit ignore\neval(q)\neval(r)\n", "", "tail\n", "a\n\n", "eval(1)\n" * 3 + "gate", None]
    rs = [
        rules.Rule("A", "P0", "", r"eval\(", (), "W", absent="safe", win=3),
        rules.Rule("B", "P1", "", r"eval\(", (), "W", present="for ", win=2),
        rules.Rule("C", "P1", "", r"d[^a-z]+$"),
        rules.Rule("D", "P2", "", r"^$"),
        rules.Rule("E", "P2", "", r"eval\(", first_only=True),
        rules.Rule("F", "P2", "", r"^(eval|tail)", absent="gate"),
        rules.Rule("G", "P2", "", r"(?i)^EVAL\((?!1)"),
    ]
    want = set()
    for k, text in enumerate(texts):
        cut = (text or "").split("\n") if text is not None else []
        for r in rs:
            hit = lambda p, x: re.search(p, x) is not None
            found = []
            for i, x in enumerate(cut):
                around = cut[max(i - r.win + 1, 0) : i + r.win + 1] if r.win else cut
                free = not any(hit(rules.PRAGMA, y) for y in cut[max(i - 1, 0) : i + 1])
                if free and hit(r.pattern, x) and not (r.absent and any(hit(r.absent, y) for y in around)) and (not r.present or any(hit(r.present, y) for y in around)):
                    found.append((r.rule_id, k, i + 1))
            want |= set(found[:1] if r.first_only else found)
    files = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("lang", F.lit(None).cast("string"))
    got = rules.scan(files, rs, ["k"])
    assert sorted(tuple(r) for r in got.select("rule_id", "k", "line_no").collect()) == sorted(want) and len(want) > 15
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "posexplode" not in plan


def test_needed_strings():
    assert rules.needed(r"^ *(subprocess\.(run|call)|child_process\.exec)\(")[:2] == [{"("}, {"child_process.exec", "subprocess."}]
    assert rules.needed("a*|b") == [] and rules.needed("(ab)+c?") == [{"ab"}] and rules.needed("[ab]x{0,2}") == []


def test_keywords_fold_a_text_once(spark):
    d = spark.createDataFrame([(1, "The und"), (2, "undo a_the the2"), (3, "x\nDER.")], "k int, text string")
    scores = routing.keyword_scores(d, "k", "text", {"a": ["the"], "b": ["und", "der"]})
    assert sorted(tuple(r) for r in scores.collect()) == [(1, "a", 3), (1, "b", 3), (3, "b", 3)]
    assert scores._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1


def test_equal_titles_are_scored_once(spark, monkeypatch):
    seen = []
    score = registry.map_candidates
    monkeypatch.setattr(registry, "map_candidates", lambda rs, its: seen.append(rs.count()) or score(rs, its))
    rs = spark.createDataFrame([(f"r{i}", ("red ring", "blue bolt", None)[i % 3]) for i in range(30)], "rule_id string, title string")
    items = spark.createDataFrame([("i1", "red ring"), ("i2", "blue")], "id string, name string")
    none = spark.createDataFrame([], "rule_id string, item string")
    got = registry.map_rules(rs, items, none, none).collect()
    assert seen == [3] and sorted({(int(r.rule_id[1:]) % 3, r.item, r.how) for r in got}) == [(0, "i1", "name"), (1, "i2", "name"), (2, None, "open")] and len(got) == 30


def test_pairs_are_counted_in_one_place(spark):
    """Against every pair compared; after the features are dealt out by id nothing but the right side moves."""
    from sievework.operators import similar

    text = lambda n: " ".join(f"w{(n * k) % 23}" for k in range(1, 9 + n % 5))
    left = spark.createDataFrame([(i, text(i)) for i in range(40)], "id int, text string")
    right = spark.createDataFrame([(i, text(i * 3)) for i in range(15)], "id int, text string")
    feats = [similar.features(x, "id", "text") for x in (left, right)]
    found = similar.similar_pairs(*feats)
    sets = [{r.id: set(r.text.split()) for r in x.collect()} for x in (left, right)]
    want = {(a, b): len(x & y) for a, x in sets[0].items() for b, y in sets[1].items() if len(x & y) >= 5}
    assert {(r.a, r.b): r.shared for r in found.collect()} == want and want
    found = found.drop("x")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "Window" not in plan
