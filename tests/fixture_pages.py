"""Pages of invented products, in the shapes that matter: cards, tables, testimonials, shells, blocked pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CARDS = """<html><head><title>Brightloom pricing</title></head><body><nav><a href="/login">Log in</a></nav>
<section class="hero"><h1>Plan your week in one place</h1><p>For small teams that juggle many calendars</p><a href="/signup">Start free</a></section>
<article class="plan-card"><h3>Starter</h3><p>{starter} per month</p><p>Up to 3 projects</p><button>Start free</button></article>
<article class="plan-card"><h3>Pro</h3><p>{pro} per month billing</p><p>10 users</p><button>Get Pro</button></article>
<article class="plan-card"><h3>Enterprise</h3><p>Custom pricing</p><button>Contact sales</button></article>
<article class="testimonial"><p>This tool saved our team $2,500 a month</p></article>
<footer><p>All rights reserved</p></footer></body></html>"""
TABLE = """<html><body><table><tr><th>Plan</th><th>Price</th></tr><tr><td>Basic plan</td><td>Basic plan €9,99 per month billing</td></tr>
<tr><td>Team plan</td><td>Team plan €1.249,00 per year billing, 50.000 requests</td></tr></table></body></html>"""
STORIES = """<html><body><article class="case-study"><h2>How Norrland won</h2><p>Their campaign budget was $40,000 per month</p></article>
<section class="feature-grid"><h2>Automatic schedules</h2><p>Plans fill themselves from what your team already knows</p></section>
<section class="feature-grid"><h2>Shared calendars</h2><p>Everybody sees the same week, wherever they are</p></section>
<section><h2>Changelog</h2><p>Changelog: March 3, 2024 faster search</p><p>2024-02-11 dark mode</p></section></body></html>"""
SHELL = '<html><body><div id="root"></div><script src="a.js"></script></body></html>'


def pages(spark: SparkSession, starter: str = "$0", pro: str = "$29") -> DataFrame:
    """(page_id, url, page_type, status_code, html)."""
    rows = [
        (1, "https://brightloom.test/pricing", "pricing", 200, CARDS.replace("{starter}", starter).replace("{pro}", pro)),
        (2, "https://tablekind.test/pricing", "pricing", 200, TABLE),
        (3, "https://norrland.test/features", "features", 200, STORIES),
        (4, "https://shellac.test/", "homepage", 200, SHELL),
        (5, "https://walled.test/pricing", "pricing", 403, "<html><body><p>Forbidden</p></body></html>"),
        (6, "https://gone.test/pricing", "pricing", 404, ""),
    ]
    return spark.createDataFrame(rows, "page_id bigint, url string, page_type string, status_code int, html string")
