from pyspark.sql import functions as F

from sievework.functions import comments as C
from sievework.functions import text as T


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()[0]


def test_ids_and_paths(spark):
    ids = [one(spark, T.norm_id(F.col("a")), a=a) for a in ("TS-C1", "C-01", "C1", "nothing")]
    assert ids == ["C01", "C01", "C01", "NOTHING"]
    assert one(spark, T.posix_normal(F.col("a")), a="a/./b/../c//d") == "a/c/d"
    assert one(spark, T.posix_normal(F.col("a")), a="../x") == "../x"
    assert one(spark, T.relative_path(F.col("a"), "/r"), a="/r/a/b") == "a/b"
    assert one(spark, T.module_of(F.col("a")), a="x.py") == "(root)"
    assert one(spark, T.unified_id(F.lit("A01"), F.col("a")), a="scan-ts") == "TS-A01"
    assert [one(spark, T.severity(F.col("a")), a=a) for a in ("P0", "P1", "P3", "P9")] == ["error", "warning", "note", "note"]


def test_tokens(spark):
    assert one(spark, T.cjk_count(F.col("a")), a="中文a") == 2
    assert one(spark, T.token_estimate(F.col("a")), a="中文abcd") == 4
    assert sorted(one(spark, T.bigram_features(F.col("a")), a="the 中文字 x")) == ["x", "中文", "文字"]
    assert one(spark, T.keyword_hits(F.col("a"), ["art", "artist", "图"]), a="an Artist draws 图") == ["artist", "图"]
    assert [one(spark, T.numeral(F.col("a")), a=a) for a in ("三", "十", "十二", "二十", "x")] == [3, 10, 12, 20, None]
    assert one(spark, T.version_key(F.col("a")), a="3.10") == [3, 10, 0]
    assert one(spark, T.fact_kind(F.col("a")), a="see /etc/hosts and a.py") == "abs_path"
    assert one(spark, T.numeric_claims(F.col("a")), a="12 Files, 3 rules") == ["12 files", "3 rules"]
    assert one(spark, T.domain_counts(F.col("a"), {"x": "x", "y": "y"}), a="xx") == {"x": 2}


def test_fingerprint_keeps_nulls_apart(spark):
    a = one(spark, T.fingerprint(F.lit("p"), F.lit(None), F.lit(1), F.lit("s")))
    b = one(spark, T.fingerprint(F.lit("p"), F.lit("1"), F.lit(None), F.lit("s")))
    assert a != b and len(a) == 16


def test_comments_keep_lines_and_columns(spark):
    src = 'a = "//x"; // c\n/* b\n */ d'
    out = C.blank_c(src)
    assert out.count("\n") == 2 and len(out) == len(src) and '"//x"' in out and "b" not in out and out.endswith("d")
    assert C.blank_hash("x = '#' # y") == "x = '#'    "
    assert C.python_noncode_lines('"""a\nb"""\nx = 1\n# c\n') == [1, 2, 4]
    assert C.python_noncode_lines("def (") == []
    assert C.regex_skeleton(r"(?<!a)foo\.bar[0-9]+") == "foobar" and C.regex_skeleton(r"eval\((?!safe)") == "eval"
    df = spark.createDataFrame([("x // y", "ts"), (None, "ts")], "a string, l string").select(C.strip_comments("a", "l"))
    assert [r[0] for r in df.collect()] == ["x     ", None]


def test_what_several_places_need_is_worked_out_once(spark):
    """Mentioned inside a lambda, the patterns were searched for again with each keyword and each hit."""
    words = ["the", "then", "and", "under", "图"]
    shown = spark.createDataFrame([("x",)], "a string").select(T.keyword_hits(F.col("a"), words).alias("h"))._jdf.queryExecution().analyzed().toString()
    assert shown.count("RLIKE") == 4 and shown.count("lower(") == 1
    assert one(spark, T.keyword_hits(F.col("a"), words), a="The_x then; AND 图 unders") == ["then", "and", "图"]


def test_grams_of_long_runs(spark):
    text = "x中 文字典y" + "一二三四五" * 40_000 + " 图"
    grams = lambda n: [g for run in ("中", "文字典", "一二三四五" * 40_000, "图") for g in ([run[i : i + n] for i in range(len(run) - n + 1)] or [run])]
    for n in (1, 2, 3, 4):
        assert one(spark, T.cjk_grams(F.col("a"), n), a=text) == grams(n)
    assert "substring" not in spark.range(1).select(T.cjk_grams(F.lit("一"), 3).alias("g"))._jdf.queryExecution().analyzed().toString()
