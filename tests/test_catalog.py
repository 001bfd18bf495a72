"""Every catalog query against its SQL on the smallest tables."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sievework.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted("|".join(map(plain, r)) for r in df.select(*cols).collect())
    if name in catalog.ORACLES:
        found = duck.execute(catalog.ORACLES[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted("|".join(plain(r[i]) for i in at) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_references_of_every_part(spark, duck):
    got = {r[0] for r in catalog.QUERIES["xref_expand"](spark, SF).select("source").distinct().collect()}
    want = duck.execute("select distinct l_partkey from lineitem join orders on l_orderkey = o_orderkey where o_orderpriority like '1%'").fetchall()
    assert got == {k for (k,) in want} and max(got) >= 60


def test_mirror_pairs_meet_as_nations(spark):
    """Customers met suppliers one by one, which grows with the square of the tables."""
    plan = catalog.QUERIES["lint_mirror_pairs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    inner = [i for i, x in enumerate(plan) if "Join Inner" in x]
    assert inner and all("Aggregate" in plan[i + 1] for i in inner)
