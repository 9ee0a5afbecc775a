"""Every query with an SQL equivalent against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quadloom.plans.queries import ORACLES, QUERIES

TESTDATA = "/root/testdata/sf0.001"


def normal(df):
    columns = sorted(df.columns)
    return [tuple(None if x is None or x != x else x for x in r) for r in df[columns].astype(object).itertuples(index=False, name=None)], columns


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(TESTDATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{TESTDATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, TESTDATA).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    a, names = normal(got)
    b, wanted = normal(duck.sql(ORACLES[name]).df())
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert names == wanted and sorted(a, key=key) == sorted(b, key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_html_links_odd_pages(spark, tmp_path):
    link = '<a href="/x?a=1&amp;b=2">y</a><br>'
    odd = ["<title>a &am</title>", "a &amp<b>c &lt d</b>", "&#12 &#x1F z", "&# a; &# b; ", "<?pi x?><![CDATA[ & ]]><![if x]>", "<p title=\"it's\" class=x></P >", "&"]
    pages = [(i, None if t is None else t + link + t) for i, t in enumerate([*odd, "", None])]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = {r.page_id: r.html for r in QUERIES["html_links"](spark, str(tmp_path)).collect()}
    assert got == dict(c.execute(ORACLES["html_links"]).fetchall()) and len(got) == len(pages)
