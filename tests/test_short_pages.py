"""A page that shows little is a script shell only if something says that scripts fill it."""

from pyspark.sql import functions as F

from tidepool.operators import analysis, extract
from tidepool.sources import html


def test_short_pages_with_a_script(spark):
    page = lambda head, body="": f"<html><head><title>One</title>{head}</head><body><nav><a href='/a'>One</a></nav><article><h1>One</h1><p>Two words.</p></article>{body}</body></html>"
    plain = page("<script>track(7);</script>")
    shells = [page("<script>track(7);</script>" * 5), page("<script>window.__NEXT_DATA__={}</script>"), page("", '<div id="root"></div>'), page("<script>var plans = [{\"name\":\"Pro\"}];</script>"), page(f"<style>{'p' * 80000}</style>")]
    long = page("<script>window.__NEXT_DATA__={}</script>", "<section><p>" + "word " * 40 + "</p></section>")
    pages = spark.createDataFrame(list(enumerate([plain, long, *shells, None, ""])), "page_id bigint, html string").select("page_id", F.lit("https://a.test/").alias("url"), F.lit("unknown").alias("page_type"), F.lit(200).alias("status_code"), "html")
    want = ["ok", "ok", *["script_shell"] * len(shells), "missing", "missing"]
    assert [r.validity for r in analysis.analyse(analysis.parsed(pages)).orderBy("page_id").collect()] == want
    found = html.evidence_blocks(pages, "page_id", "html", ["url", "page_type"])
    assert [r.validity for r in extract.page_validity(pages, found).orderBy("page_id").collect()] == want
