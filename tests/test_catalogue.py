"""Every query of the catalogue against its SQL in DuckDB, and the contract of the entry point."""

import os

import duckdb
import pytest

from ragloom.plans import catalogue

TABLES = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables are not here")


def plain(v):
    if isinstance(v, float):
        return round(v, 8)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{TABLES}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    got = QUERIES[name](spark, TABLES)
    want = duck.sql(SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = sorted(repr(plain(tuple(r))) for r in got.select(*names).collect())
    assert rows == sorted(repr(plain(r)) for r in want.select(*names).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, TABLES).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).columns[0] == "strategy"


def test_nothing_outside_imports_the_training_data_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    apart = "ragloom." + "llm"
    for folder, _, files in os.walk(os.path.join(root, "ragloom")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert apart not in open(os.path.join(folder, f)).read(), f


@pytest.mark.parametrize("name", ["chunk_paragraph", "chunk_structured", "chunk_structured_words", "html_extract", "long_pages", "page_metadata"])
def test_pages_with_references_cut_short_give_what_the_sql_gives(spark, tmp_path, name):
    """Titles of the larger tables end anywhere, so in &quot without its semicolon too."""
    page = '<!DOCTYPE html><html><head><title>{0}</title></head><body><article><h1>{0}</h1><p>{0} &quot9c &amp; &amp;quot; &amp more &quot;end&quot; ' + "words and words. " * 60 + "</p></article></body></html>"
    rows = [(i, f"http://a.org/en/{i % 2 or ''}", page.format(f"token = {end}")) for i, end in enumerate(["&quot", "&quo", "&am", "&amp", "&copy", "&", "&middot;"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)), con.sql(SQL[name])
    rows = sorted(repr(plain(tuple(r))) for r in got.select(*want.columns).collect())
    assert rows and rows == sorted(repr(plain(r)) for r in want.fetchall())
