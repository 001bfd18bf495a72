import re

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_work_on_what_is_left(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        assert docs.columns[: len(columns)] == columns and (k == len(cp.STAGES) - 1 or docs.columns == columns)
        if k < 3:
            assert docs.select("doc_id").distinct().count() == sizes[-1] <= sizes[-2]
    assert sizes[4] == sizes[5] > 0


def test_insults_go_and_clean_texts_stay(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    kept = {r.doc_id for r in cp.drop_toxic(spark, docs, LARGER).collect()}
    rows = docs.collect()
    insulting = {r.doc_id for r in rows if len(re.findall(r"(?i)\b(idiot|moron|worthless|clown|pathetic|scum|loser|stupid)\b", r.text)) >= 3}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    clean = {i for i, t in toxic.items() if t == 0}
    assert len(insulting & kept) <= 0.1 * len(insulting) and len(clean & kept) >= 0.98 * len(clean)


def test_run_equals_the_stages(spark):
    rows = cp.run(spark, SF)
    assert rows.count() > 0 and {"doc_id", "text", "depth", "prefix", "shard_bytes"} <= set(rows.columns)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_awkward_documents(spark):
    rows = [(None, "a b c", None, None, None), (1, None, "x", None, 0), (1, "", "x", "s", 0), (2, "w " * 3000, None, "s", None), (2, "w " * 3000, None, "s", None), (3, "one two three four five six", "x", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sizes = [docs.count()]
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        sizes.append(docs.count())
    assert sizes[1:4] == [6, 5, 5] and sizes[5] == sizes[4] > 0
    assert {r.text for r in docs.collect()} <= {t for _, t, *_ in rows}
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def test_rows_are_judged_by_id_and_text(spark):
    """Repeated and null ids: what a row's text says decides about that row, not about others with its id."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    plain = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"other{i}" for i in range(40))
    docs = spark.createDataFrame([(5, plain, "x", "s", 1), (5, other, "x", "s", 2), (None, plain, "y", "s", 3), (7, plain + " end", "z", "s", 4), (None, other, "x", "t", 5), (9, "", "a", "s", 6), (9, "", "b", "s", 7), (None, None, "a", "s", 8)], SCHEMA)
    kept = sorted((str(r.doc_id), r.text or "", r.lang) for r in cp.drop_near_duplicates(spark, docs, SF).collect())
    assert kept == sorted([("5", plain, "x"), ("5", other, "x"), ("9", "", "a"), ("None", "", "a")])
    docs = spark.createDataFrame([(5, plain, "x", "s", 1), (5, plain + " " + item, "x", "s", 2), (None, item, "y", "s", 3), (None, other, "y", "s", 4)], SCHEMA)
    kept = sorted((str(r.doc_id), r.n_chars) for r in cp.drop_contaminated(spark, docs, SF).collect())
    assert kept == [("5", 1), ("None", 4)]
    docs = spark.createDataFrame([(5, plain, "x", "s", 1), (5, plain, "x", "t", 2), (5, plain, "x", "u", 3), (6, other, "x", "s", 4)], SCHEMA)
    mixed = cp.mix_sources(spark, docs, SF)
    assert {r.source for r in mixed.collect() if r.doc_id == 5} >= {"t", "u"} and {(r.source, r.n_chars) for r in mixed.collect()} <= {("s", 1), ("t", 2), ("u", 3), ("s", 4)}


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_filter_stages_match_brute_force(spark):
    """Near duplicates and benchmark passages against plain Python over the whole small table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    first = {i: i for i in sets}

    def find(x):
        while first[x] != x:
            x = first[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                first[max(a, b)] = min(a, b)
    unique = {i for i in sets if find(i) == i}
    assert len(unique) < len(sets)
    kept = cp.drop_near_duplicates(spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == unique
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = cut(r.text)
        windows |= {tuple(w[k : k + min(8, len(w))]) for k in range(max(1, len(w) - 7))} if w else set()
    sizes = {len(w) for w in windows}
    clean = {i for i, t in rows if i in unique and not any(tuple(w[k : k + n]) in windows for w in [cut(t)] for n in sizes for k in range(len(w) - n + 1))}
    assert {r.doc_id for r in cp.drop_contaminated(spark, kept, SF).collect()} == clean and len(clean) < len(unique)
