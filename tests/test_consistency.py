import pytest
from pyspark.sql import functions as F

from sievework.operators import consistency as C
from sievework.operators import registry, rulebook, rules
from sievework.sources import corpus, sinks


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, lang string, text string")


def test_pragma_exempts_its_line_and_the_next_whatever_the_rules(spark):
    text = "# audit: ignore\nrun(shell=True)\nrun(shell=True)\nrun(shell=True) # audit: ignore"
    for ids in (("PY-L07",), ("PY-L07", "PY-L02")):
        got = rules.scan(files(spark, [("a", "py", text)]), [r for r in rulebook.RULES if r.rule_id in ids], ["path"]).collect()
        assert [r.line_no for r in got if r.rule_id == "PY-L07"] == [3]


def test_comments_are_blanked_and_gates_read_code(spark):
    only = [r for r in rulebook.RULES if r.rule_id in ("PY-L07", "RS-01", "RS-03")]
    rows = [("a", "py", "# run(shell=True)\nx = 'shell=True'\nrun(shell=True)  # audit: ignore"), ("b", "py", "# audit: ignore\nrun(shell=True)\n\nrun(shell=True)"), ("c", "rust", "// #[cfg(test)]\nx.unwrap()"), ("d", "rust", "#[cfg(test)]\nx.unwrap()"), ("e", None, "x")]
    got = sorted((r.path, r.rule_id, r.line_no) for r in rules.scan(files(spark, rows), only, ["path"], blank=True).collect())
    assert got == [("a", "PY-L07", 2), ("b", "PY-L07", 4), ("c", "RS-01", 2)]


def test_every_match_of_a_whole_text(spark):
    r = rules.Rule("X", "P1", "two lines", r"a\s+b", form="F", every=True)
    got = rules.scan(files(spark, [("p", "x", "a b\nc a\nb a\n\nb"), ("q", "x", None), ("r", "x", "none")]), [r], ["path"]).collect()
    assert sorted((g.path, g.line_no) for g in got) == [("p", 1), ("p", 2), ("p", 3)]


def test_positions_of_paths(spark):
    paths = ["b", "c/d", "aaaaaaaa1", "a", "é", "Z", "c", "", "src/deep/" + "x" * 30, "src/deep/a"]
    for some in (paths, ["same/long/prefix/" + p for p in paths]):
        got = {r.path: r.position for r in corpus.with_positions(spark.createDataFrame([(p,) for p in some], "path string"), "path").collect()}
        assert sorted(some, key=str.encode) == sorted(some, key=got.get)


def test_archive_notices_a_loss(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "archive")
    entries = spark.createDataFrame([("2024-01-05", 1), ("2024-02-05", 2)], "day string, n int").withColumn("day", F.to_date("day"))
    assert sinks.archive(entries, path) == 2 and sinks.archive(entries, path) == 2 and spark.read.parquet(path).count() == 4
    lost = entries.limit(1)
    lost.count = lambda: 2  # one of two is not written
    with pytest.raises(RuntimeError):
        sinks.archive(lost, path)


def test_plan_apply_undo(spark, tmp_path):
    path = str(tmp_path / "state")
    old = spark.createDataFrame([(1, "a", 1.5), (2, "b", None), (3, "c", 0.0)], "k int, s string, x double")
    new = spark.createDataFrame([(2, "b", None), (3, "C", 0.0), (4, None, 2.0)], "k int, s string, x double")
    sinks.save_state(old, path, 1)
    plan = sinks.propose(old, new, "k", ["s", "x"])
    assert sorted((r.k, r.action) for r in plan.collect()) == [(1, "drop"), (3, "change"), (4, "add")]
    sinks.apply_plan(old, plan, path, 2, "k", ["s", "x"])
    assert sorted(tuple(r)[:3] for r in sinks.load_state(spark, path).select("k", "s", "x").collect()) == [(2, "b", None), (3, "C", 0.0), (4, None, 2.0)]
    sinks.undo(spark, path, 3, 1)
    assert sorted(r.k for r in sinks.load_state(spark, path).collect()) == [1, 2, 3]


def test_uncovered_names(spark):
    told = spark.createDataFrame([("d", t) for t in ("combo_scaling", "Particles", "Particles2D", "abcdefgh", "xabcdefghx", "short", "lonely_name", "common_one")], "doc string, tok string")
    pool = spark.createDataFrame([("d", "combo_scaling_x"), ("d", "Particles3D"), ("d", "abcdefghi"), ("d", "shor"), ("e", "lonely_name")], "doc string, tok string")
    common = spark.createDataFrame([("common_one",)], "tok string")
    got = {r.tok for r in C.uncovered(told, pool, common).collect()}
    assert got == {"short", "lonely_name", "xabcdefghx", "Particles2D"}


def test_technical_names(spark):
    names = {"a.b": False, "a.bc": True, "_ab": False, "set_cell": True, "READY": True, "Abc": False, "Camel": True, "GD123": False, "plain": False}
    df = spark.createDataFrame([(k,) for k in names], "t string").select("t", C.technical(F.col("t")).alias("ok"))
    assert {r.t: r.ok for r in df.collect()} == names


def test_statement_ends_where_parentheses_close(spark):
    text = "on(EVT, (a) => {\n  b;\n})\nx\non(y);\non(\n" + "z\n" * 20
    ls = corpus.lines(files(spark, [("a", "ts", text)]), ["path"])
    got = {r.line_no: r.statement for r in C.statements(ls, ["path"], r"^on\(").collect()}
    assert got[1] == "on(EVT, (a) => {   b; })" and got[5] == "on(y);" and got[6].count("z") == 11


CHECKS = '''
def check_a(cfg):
    for f in (base / "reference").rglob("*.md"):
        print("✓ passed")


def check_b(cfg):
    for f in base.rglob("*.md"):
        print("✓ passed, %d scanned" % n)


def check_c(cfg):
    for f in [*folder.glob("*.md"), root / "SKILL.md"]:
        pass


def check_d(cfg):
    return folder.glob("*.py")


def check_e(cfg):
    return folder.glob("*.md")
'''


def test_checks_about_checks(spark):
    sources = spark.createDataFrame([("lint.py", CHECKS), ("none.py", None)], "path string, text string")
    exempt = spark.createDataFrame([("check_e", "tables only"), ("check_a", " ")], "name string, reason string")
    assert [r.issue for r in C.scan_scope_of_checks(sources, exempt).collect()] == ["scan leaves out the entry file: check_a"]
    assert [r.issue for r in C.scope_selfreport(sources).collect()] == ["success without its scope: check_a"]


def test_hints_and_marks(spark):
    rows = {"[env: py3.8] win": "py3.8", "on macOS": "os:darwin", "Windows only": "os:windows", "needs python >= 3.10": "python >= 3.10", "none": "", None: ""}
    df = spark.createDataFrame([(k,) for k in rows], "t string").select("t", C.environment_hint(F.col("t")).alias("h"), C.draft_fingerprint(F.col("t")).alias("f"))
    got = {r.t: r for r in df.collect()}
    assert {k: v.h for k, v in got.items()} == rows and got[None].f == "empty" and len(got["none"].f) == 16
    names = spark.createDataFrame([("use `Foo.bar` and set_cell in CamelCase with 中文字 of",)], "t string").select(C.sibling_tokens(F.col("t"))).first()[0]
    assert set(names) == {"Foo.bar", "set_cell", "CamelCase", "with", "中文", "文字"}


def test_prefix_filter_finds_every_pair(spark):
    import random

    r = random.Random(3)
    sets = lambda n, p: [(f"{p}{i}", sorted({f"t{int(r.paretovariate(0.7)) % 40}" for _ in range(r.randrange(1, 9))})) for i in range(n)]
    a, b = sets(60, "r"), sets(60, "i")
    got = registry.name_candidates(spark.createDataFrame(a, "rule_id string, tokens array<string>"), spark.createDataFrame(b, "id string, tokens array<string>"), 0.32)
    want = {(x, y) for x, s in a for y, t in b if len(set(s) & set(t)) / len(set(s) | set(t)) >= 0.32}
    assert {(g.rule_id, g.item) for g in got.collect()} == want


def test_recommendation(spark):
    hits = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "a", 2), (3, "b", 2), (4, "a", 3), (4, "b", 1), (5, "a", 2), (5, "cur", 1), (6, "a", 3), (6, "b", 2)], "k int, domain string, hits int")
    keys = spark.createDataFrame([(i,) for i in range(1, 8)], "k int")
    got = {r.k: (r.domain, r.confidence) for r in C.recommend(hits, "k", keys, "cur").collect()}
    assert got == {1: ("a", "medium"), 2: ("a", "high"), 3: ("a", "undecided"), 4: ("a", "high"), 5: ("cur", "undecided"), 6: ("a", "medium"), 7: (None, "none")}


def test_project_rules(spark):
    from sievework.operators import project_rules as P

    rows = [("package.json", '{"scripts": {"test": "x"}}'), (".gitignore", "node_modules/\ndist\n.env"), ("src/index.ts", "import { a } from './a'\nimport { b } from './a'"), ("src/a.ts", "export const a = 1\nexport function lonely() {}\nexport class b {}"), ("src/unused.ts", "x"), ("r/main.rs", "mod a;"), ("r/a.rs", "pub mod b;"), ("r/a/b.rs", ""), ("r/c.rs", "mod a;"), ("bad", None)]
    got = sorted((r.rule_id, r.path, r.line_no, r.snippet) for r in P.project_findings(spark.createDataFrame(rows, "path string, text string")).collect())
    assert got == [("APP-G08", "src/index.ts", 2, "./a"), ("APP-G09", "src/a.ts", 2, "lonely"), ("APP-P02", "src/unused.ts", 1, ""), ("APP-P03", "package.json", 1, "test"), ("APP-R08", "r/c.rs", 1, "")]
    with_ci = spark.createDataFrame([*rows, (".github/workflows/x.yml", "")], "path string, text string")
    assert P.checks_without_ci(with_ci).count() == 0
    own = P.rules_from_json('{"rules": [{"id": "X1", "pattern": "foo", "languages": ["py"], "cwe": []}, {"id": "X2"}, 3, {"id": "X3", "pattern": "y", "form": "Q"}]}')
    assert [(r.rule_id, r.langs, r.cwe) for r in own] == [("X1", ("py",), ())]
    assert rules.scan(files(spark, [("a", "py", "foo"), ("b", "ts", "foo")]), own, ["path"]).count() == 1


def test_language_scan(spark, tmp_path):
    for name, text in (("src/a.ts", "x"), ("src/a.d.ts", "x"), ("src/b.gen.ts", "x"), ("src/a.test.ts", "x"), ("big.ts", "y" * (corpus.MAX_BYTES + 1)), ("huge.ts", "y" * (corpus.MAX_BYTES_LANGUAGE + 1))):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path for r in corpus.read_language(spark, str(tmp_path), "ts").collect()}
    assert got == {"src/a.ts", "big.ts"}
