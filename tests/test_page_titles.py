"""Titles of pages against the SQL of their query, on pages that the smallest tables do not have."""

import duckdb

from adlens.catalogue import load

PAGES = [
    "<title>token = &quot;5aa2&quot;</title>", "<title>cut at the end &amp;&amp;&amp</title>", "<title> \n two\t lines &#39;here&#39; &nbsp;&eacute;</title>", "<title>&amp;lt; &lt;b&gt; &AMP; &amp;quot;</title>",
    "<title></title>", "<title>never closed", "<p>no title <a href='/x'>one link</a>", "", None, "<title>first</title><title>second</title>", "<title lang='en'>of a language</title>", "<TITLE>in capitals</TITLE>",
]


def test_titles_are_those_of_the_sql(spark, tmp_path):
    run, sql = load()["page_meta"]
    rows = [(k, f"https://a.example/{k}", x) for k, x in enumerate(PAGES)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(map(tuple, run(spark, str(tmp_path)).collect())) == sorted(con.sql(sql).fetchall())
