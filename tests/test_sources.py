import time

import pytest
from pyspark.sql import functions as F

from tidepool.operators import blocks
from tidepool.sources import dom, html, robots

PAGE = """<html><head><title>Acme | tools</title><meta name="Description" content="All tools"><script>var x = "<p>no</p>";</script></head>
<body><nav><a href="/login">Log in</a></nav><h1>Build &amp; ship</h1><p>First<p>Second <b>part<br>two</b><ul><li>One<li>Two</ul>
<a href="../plans/#x">Plans</a> <a href="https://other.org/a">Other</a><a href="mailto:a@b.c">Mail</a><a href="#top">Top</a>
<section class="pricing-card"><h2>Pro</h2><p>$29 / month</p></section><p>First</p><footer>&copy; Acme</footer></body></html>"""


def pages(spark):
    return spark.createDataFrame([(1, "https://acme.com/a/b", PAGE), (2, "https://acme.com/", None), (3, "https://acme.com/", "")], "page_id bigint, url string, html string")


def test_segments_and_metadata(spark):
    found = html.elements(pages(spark), carry=["url"])
    assert [r.text for r in html.segments(found).orderBy("ord").collect()] == ["Build & ship", "First", "Second parttwo", "One", "Two", "Pro", "$29 / month"]
    meta = html.metadata(found).first()
    assert (meta.title, meta.description, meta.h1, meta.scripts) == ("Acme | tools", "All tools", "Build & ship", 1)


def test_links_have_reasons(spark):
    rows = html.links(html.elements(pages(spark), carry=["url"]), "url").orderBy("ord").collect()
    assert [(r.text, r.rejected) for r in rows] == [("Log in", "excluded_path"), ("Plans", None), ("Other", "external_domain"), ("Mail", "scheme"), ("Top", "anchor")]
    assert rows[0].target == "https://acme.com/login" and rows[1].target.startswith("https://acme.com/a/")


BLOCKS = """<html><body><nav class="menu"><a href="/a">Home</a></nav><main><h1>Acme</h1><section><h2>Plans</h2>
<div class="plan-grid"><div class="card"><h3>Pro</h3><p>$29 / month</p><button>Get Pro</button></div><div class="card"><h3>Team</h3><p>$99 / month</p><a href="/buy" aria-label="x">Buy now</a></div></div></section>
<table><tr><th>Plan</th><th>Price</th></tr><tr><td>Pro</td><td>$29</td></tr></table><section class="cookie-note">Accept all cookies</section><section aria-hidden="true"><blockquote>Five stars, rated by customers</blockquote></section>
<dialog><p>Sign up now</p></dialog></main><footer>All rights reserved</footer></body></html>"""


def test_blocks_have_roles_and_structure(spark):
    rows = dom.part(dom.parsed(spark.createDataFrame([(1, BLOCKS)], "page_id bigint, html string"), parts=("blocks",)), "blocks")
    found = blocks.older_kind(blocks.evidence(blocks.classified(rows, F.lit("pricing")))).orderBy("place").collect()
    by = [(r.tag, r.role, r.heading, r.inside, r.visibility) for r in found]
    assert by == [
        ("nav", "navigation", None, None, "visible"), ("main", "testimonial", "Acme", None, "visible"), ("section", "pricing_card", "Plans", 1, "visible"), ("div", "pricing_card", "Pro", 2, "visible"), ("div", "pricing_card", "Pro", 3, "visible"),
        ("div", "pricing_card", "Team", 3, "visible"), ("table", "pricing_table", None, 1, "visible"), ("section", "testimonial", None, 1, "aria_hidden"), ("dialog", "cta_section", None, 1, "modal"), ("footer", "footer", None, None, "visible"),
    ]
    card = found[4]
    assert card.text == "Pro\n$29 / month\nGet Pro" and card.heading_chain == ["Acme", "Plans", "Pro"] and card.buttons == ["Get Pro"] and card.sibling_group == "plan-grid" and (card.prices, card.plan_words) == (["$29"], ["Pro", "Pro"])
    assert found[5].link_urls == ["/buy"] and found[5].sibling_index == 1 and card.dom_path.endswith("div.plan-grid:nth(2) > div.card:nth(1)") and found[6].table_rows == found[6].table_columns == 2
    assert [r.kind for r in found][:2] == ["nav", "pricing"] and found[7].block_score == 0.25 and found[3].child_count == 2
    kept = dom.part(dom.parsed(spark.createDataFrame([(1, BLOCKS)], "page_id bigint, html string"), parts=("blocks",)), "blocks").transform(lambda d: blocks.classified(d, F.lit("x")))
    assert [kept.filter(f()).count() for f in (blocks.is_card, blocks.is_modal, blocks.is_table)] == [4, 1, 1]
    groups = {r.sibling_group: (r.blocks, dict(r.roles)) for r in blocks.sibling_groups(kept).collect()}
    assert groups["plan-grid"] == (2, {"pricing_card": 2}) and groups["BODY"][0] == 3
    assert {r.place: r.parent_heading for r in blocks.tree(kept).collect()}[4] == "Plans"


def test_headings_hold_what_stands_under_them():
    markup = "<main><h2>Pro</h2><p>$9 a month</p><h3>Limits</h3><p>3 users</p><h2>Team</h2><div><p>$19</p></div></main><p>outside</p>"
    assert [(x["heading"], x["cells"]) for x in dom.structures_of(dom.tree_of(markup))] == [("Pro", ["$9 a month"]), ("Limits", ["3 users"]), ("Team", ["$19"])]


@pytest.mark.parametrize("markup", ["<div>x ", "<span>x ", "<p><b>x ", "<h1>x ", "<a href=x>y ", "<nav>", "</b></p></div>", "<ul><li>x "])
def test_a_page_takes_time_in_proportion(markup):
    def seconds(n):
        began = time.process_time()
        tree = dom.tree_of(markup * n)
        for reader in dom.READERS.values():
            reader(tree)
        return time.process_time() - began

    assert seconds(20_000) < 12 * max(0.3, seconds(5_000))


def test_elements_end_where_others_begin():
    tree = dom.tree_of("<p>a<p><b>b<div>c</div><ul><li>d<li>e<ul><li>f</ul></ul><table><tr><td>g<td>h<tr><td>i</table><a>j<a>k")
    found = [(e["tag"], e["text"]) for e in dom.elements_of(tree)]
    assert found == [("p", "a"), ("p", "b"), ("div", "c"), ("li", "d"), ("li", "e"), ("li", "f"), ("table", "ghi"), ("td", "g"), ("td", "h"), ("td", "i"), ("a", "j"), ("a", "k")]


def test_robots_and_sitemap(spark):
    text = "User-agent: *\nDisallow: /private\nAllow: /private/open\n\nUser-agent: other\nDisallow: /\n# note\nDisallow:\n"
    rules = robots.rules(spark.createDataFrame([("acme.com", text)], "site string, text string"), "site", "text")
    assert [(r.agent, r.allow, r.path) for r in rules.orderBy("line_no").collect()] == [("*", False, "/private"), ("*", True, "/private/open"), ("other", False, "/")]
    paths = spark.createDataFrame([("acme.com", p) for p in ("/a", "/private/x", "/private/open/y")], "site string, path string")
    allowed = {r.path: r.allowed for r in robots.allowed(paths, rules, "site", "path", "tidebot").collect()}
    assert allowed == {"/a": True, "/private/x": False, "/private/open/y": True}
    xml = '<urlset><url><loc>https://a/1</loc></url><url><loc> https://a/2 </loc></url><url><loc>https://a/1</loc></url></urlset>'
    locations = robots.sitemap(spark.createDataFrame([("acme.com", xml), ("b", "<broken"), ("c", None)], "site string, xml string"), "site", "xml")
    assert sorted(r.url for r in locations.collect()) == ["https://a/1", "https://a/2"]


def test_meaningful_texts(spark):
    page = '<html><head><title>Acme</title></head><body><p>Open 9:30 am <span>to</span><span>day</span></p><div class="cookie-bar"><p>Accept</p></div><li>One<ul><li>Two</li></ul></li><p hidden>no</p><a>Privacy</a><p>Acme</p>First one. Second one! © 2024 Acme</body></html>'
    rows = html.meaningful(dom.parsed(spark.createDataFrame([(1, page), (2, None), (3, "<p>" + "</p><p>".join(f"word {'abcdefghij'[k]}" for k in range(9)) + "</p>Not added. Really")], "page_id int, html string"), parts=("meaningful",)))
    found = {}
    for r in rows.orderBy("page_id", "place").collect():
        found.setdefault(r.page_id, []).append(r.text)
    assert found[1][:4] == ["Acme", "Open today", "One", "Two"] and found[1][-1] == "Second one! © 2024 Acme" and not any("Accept" == t or t == "Privacy" for t in found[1])
    assert len(found[3]) == 9 and 2 not in found
