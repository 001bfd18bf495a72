import base64
import hashlib
import random

import numpy as np
from helpers import clashing
from pyspark.sql import functions as F

from sievework.llm import impact_index, reputation, warc
from sievework.llm.common import Scratch

PAGE = "page_id long, url string, html string"


def pages():
    return [(5, "http://a.example.org/x", "same"), (2, "http://b.com", "same"), (9, None, "same"), (1, "u\r\nX: y", ""), (3, "http://c.net/", None), (4, "http://d/", "é" * 5000), (None, "http://n/", "same"), (2, "http://b.com", "same"), (7, "http://e/", "WARC/1.1\r\n\r\nalone")]


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.archive_pages(clashing(spark.createDataFrame(pages(), PAGE)).repartition(3), path)
    rows = warc.page_index(spark, path).collect()
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    same, empty = 2, 1
    want = sorted(str((i, len((h or "").encode()), sha(h), "revisit" if (h == "same" and i != same) or (not h and i != empty) else "response", same if h == "same" and i != same else empty if not h and i != empty else None)) for i, _, h in pages())
    assert sorted(str(tuple(r)) for r in rows) == want
    full = spark.read.format("warc").load(path)
    for r in full.where("record_type = 'response'").collect():
        assert base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest[5:] and len(r.payload) == r.payload_bytes
    some = full.where(F.col("record_type") == "revisit").where(F.col("target_uri").startswith("http://a"))
    assert [r.record_id for r in some.collect()] == ["<urn:page:5>"]
    assert full.where("target_uri is null").count() == 1


def test_least_bytes_and_empty(spark, tmp_path):
    warc.archive_pages(spark.createDataFrame(pages(), PAGE), str(tmp_path / "a"), least_bytes=5)
    assert {r.record_type for r in warc.page_index(spark, str(tmp_path / "a")).collect()} == {"response"}
    warc.archive_pages(spark.createDataFrame([], PAGE), str(tmp_path / "b"))
    assert warc.page_index(spark, str(tmp_path / "b")).collect() == []


def test_reads_gzip_members(spark, tmp_path):
    import gzip

    row = {"record_type": "response", "record_id": "<r>", "target_uri": "http://x/", "date": "d", "payload_digest": None, "refers_to": None, "payload_bytes": 3, "payload": b"abc"}
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(warc.record(row | {"record_id": f"<{k}>"}, k == 1)) for k in range(3)))
    warc.register(spark)
    got = spark.read.format("warc").load(str(tmp_path)).orderBy("record_id").collect()
    assert [(r.record_id, bytes(r.payload)) for r in got] == [("<0>", b"abc"), ("<1>", b"abc"), ("<2>", b"abc")]


def test_rules_and_reputation(spark):
    rows = [(1, "http://EXAMPLE.org/es/a?q"), (2, "https://x.example.org/en/1x"), (3, "http://y.org/"), (4, "http://y.org"), (5, "http://a.com/fr/"), (6, "http://com/de/x"), (7, None), (8, "nothing"), (9, "x://h.net:80/p#f"), (9, "x://h.net:80/p#f")]
    rows += [(100 + i, f"http://good.net/{i}") for i in range(60)] + [(300 + i, f"http://bad.net/{i}") for i in range(60)]
    outcomes = spark.createDataFrame([*((100 + i, 1) for i in range(50)), *((300 + i, int(i % 5 == 0)) for i in range(50)), (None, 1), (1, None)], "page_id long, good int")
    got = {r.page_id: r for r in reputation.judge(clashing(spark.createDataFrame(rows, "page_id long, url string")), outcomes).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (1, 2, 3, 5, 6)] == [("example.org", "/es/a", "example.org/es/", "block"), ("x.example.org", "/en/1x", "example.org/en/1", "block"), ("y.org", "/", "org/", "allow"), ("a.com", "/fr/", "com/fr/", "allow"), ("com", "/de/x", "com/de/", "block")]
    assert got[4].rule is None and (got[7].host, got[7].path) == ("", "") == (got[8].host, got[8].path)
    assert got[9].host == "h.net:80" and got[9].path == "/p"
    assert got[155].verdict == "allow" and got[355].verdict == "block"
    empty = spark.createDataFrame([], "page_id long, url string")
    assert reputation.judge(empty, outcomes).collect() == [] and reputation.judge(spark.createDataFrame(rows, "page_id long, url string"), outcomes.limit(0)).count() == len(rows)


def test_domains_and_suffixes(spark):
    want = {"a.b.co.uk:8080": ("a.b.co.uk", "b.co.uk", "co.uk"), "10.0.0.1": ("10.0.0.1", "10.0.0.1", "(address)"), "[::1]:80": ("[::1]", "[::1]", "(address)"), "u@x.example.org.": ("x.example.org", "example.org", "org"), "co.uk": ("co.uk", "co.uk", "co.uk"), "localhost": ("localhost", "localhost", "localhost"), "shop.com.au": ("shop.com.au", "shop.com.au", "com.au"), "a.com.example": ("a.com.example", "com.example", "example"), "": ("", "", "")}
    name = reputation.name_of(F.col("host"))
    rows = spark.createDataFrame([(h,) for h in want], "host string").select("host", name, reputation.domain_of(name), reputation.suffix_of(name)).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == want


def test_hosts_under_one_suffix_are_apart(spark):
    """co.uk is no domain: what is known of bad.co.uk's pages doesn't judge good.co.uk's hosts; ports make no hosts."""
    pages = [(i, f"https://h{i % 3}.{'bad' if i % 2 else 'good'}.co.uk:{i}/p") for i in range(400)] + [(900, "http://new.good.co.uk/"), (901, "http://new.bad.co.uk/")]
    outcomes = spark.createDataFrame([(i, 1 - i % 2) for i in range(400)], "page_id long, good int")
    got = {r.page_id: r for r in reputation.judge(spark.createDataFrame(pages, "page_id long, url string"), outcomes).collect()}
    assert got[0].verdict == "allow" and got[1].verdict == "block" and got[0].host_labels > 60 and got[901].verdict == "block"
    rates = reputation.host_rates(spark.createDataFrame([(i, reputation_name) for i, reputation_name in ((0, "new.good.co.uk"), (1, "x.bad.co.uk"), (2, "y.good.co.uk"))], "page_id long, name string"), outcomes, Scratch(spark, "t"))
    mean = {r.name: r.a / (r.a + r.b) for r in rates.collect()}
    assert mean["new.good.co.uk"] > mean["x.bad.co.uk"]


def brute(rows, k=5, every=50):
    vs = [(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(vs):
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for n, (j, v) in enumerate(vs) if n != at)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_search_matches_brute_force(spark):
    r = random.Random(2)
    rows = [(i, [float(np.float32(r.gauss(0, 0.2))) for _ in range(16)]) for i in range(400)]
    rows += [(1000 + i, list(rows[3][1])) for i in range(40)]
    rows += [(50, list(rows[0][1])), (None, rows[0][1]), (2000, None), (2001, [None] * 16), (2002, [float("nan")] * 16), (2003, [float("inf")] * 16), (2050, []), (2100, [0.5] * 3), (7, list(rows[7][1])), (1003, list(rows[9][1]))]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(tuple(x) for x in impact_index.search(df).collect()) == brute(rows)
    assert impact_index.search(df.limit(0)).collect() == []
    assert sorted(tuple(x) for x in impact_index.search(df.where("vec_id in (50, 51, 52)")).collect()) == brute([x for x in rows if x[0] in (50, 51, 52)])


def test_search_stops_early_on_proof():
    r = np.random.default_rng(1)
    v = np.floor(r.normal(size=(5000, 64)) * 32).astype(np.int64)
    b = impact_index.Block.unpacked(impact_index.Block(np.arange(5000) + 10**6, np.arange(5000), v).packed())
    stops = []
    for q in range(0, 5000, 500):
        ids, score, stop = b.top(v[q], q + 10**6, 5)
        want = np.lexsort((np.arange(5000), -np.where(np.arange(5000) == q, -(10**9), v @ v[q])))[:5]
        assert ids.tolist() == want.tolist()
        stops.append(stop)
    assert max(stops) < len(b.segments)
