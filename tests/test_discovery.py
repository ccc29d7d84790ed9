"""Finding a site's pages in nested sitemaps, links and usual paths; currencies from elsewhere."""

from tidepool.operators import discovery


def loc(*urls):
    return "<urlset>" + "".join(f"<url><loc> {u} </loc></url>" for u in urls) + "</urlset>"


def test_nested_sitemaps_are_read_once(spark):
    a, b = "https://a.test", "https://b.test"
    files = [
        (f"{a}/sitemap.xml", loc(f"{a}/sitemap-1.xml", f"{a}/x", f"{a}/feed.xml", "https://c.test/sitemap-9.xml", "https://c.test/y")), (f"{a}/sitemap-1.xml", loc(f"{a}/sitemap.xml", f"{a}/sitemap-2.xml?p=1", f"{a}/one")),
        (f"{a}/sitemap-2.xml?p=1", loc(f"{a}/sitemap-1.xml", f"{a}/two", f"{a}/one", f"{a}/sitemap-3.xml")), ("https://c.test/sitemap-9.xml", loc("https://c.test/z")), (f"{b}/sitemap_index.xml", "<broken"), (f"{b}/sitemap.xml", None),
    ]
    roots = spark.createDataFrame([("a.test", a), ("b.test", b), ("d.test", "https://d.test")], "site string, origin string")
    found = discovery.sitemap_pages(roots, spark.createDataFrame(files, "url string, xml string")).collect()
    assert sorted((r.site, r.url) for r in found) == [("a.test", f"{a}/one"), ("a.test", f"{a}/two"), ("a.test", f"{a}/x")]


def test_candidates_are_ranked_fetched_and_judged_again(spark):
    o = "https://a.test"
    sites = spark.createDataFrame([("a.test", o)], "site string, origin string")
    links = spark.createDataFrame([("a.test", f"{o}/plans/", "Plans"), ("a.test", f"{o}/login", "Log in"), ("a.test", "https://other.test/pricing", "x"), ("a.test", f"{o}/tour", "Product tour"), ("a.test", f"{o}/about", None)], "site string, url string, text string")
    sitemap = spark.createDataFrame([("a.test", f"{o}/plans"), ("a.test", f"{o}/docs/api?utm_source=x")] + [("a.test", f"{o}/p{k}") for k in range(30)], "site string, url string")
    submitted = spark.createDataFrame([("a.test", f"{o}/deep/offer")], "site string, url string")
    found = discovery.scored(discovery.candidates(sites, links, sitemap, submitted))
    by = {r.url: r for r in found.collect()}
    assert (by[f"{o}/plans"].source, by[f"{o}/plans"].page_type, by[f"{o}/plans"].relevance) == ("homepage_link", "pricing", 16 + 14 + 7)
    assert by[o].page_type == "homepage" and by[f"{o}/docs/api"].source == "sitemap" and f"{o}/login" not in by and by[f"{o}/tour"].page_type == "product"
    chosen = discovery.selected(found).orderBy("place").collect()
    assert len(chosen) == 15 and [r.url for r in chosen[:2]] == [f"{o}/deep/offer", o] and sum(r.page_type == "pricing" for r in chosen[:5]) == 3
    fetched = spark.createDataFrame(
        [(o, "Home", None, 39, True), (f"{o}/plans", "Plans", None, 5000, True), (f"{o}/pricing", "Pricing plans", "billing", 900, True), (f"{o}/tour", "Tour", None, 79, True), (f"{o}/docs/api", "Docs", None, 400, False)],
        "url string, title string, description string, text_length int, ok boolean",
    )
    kept = {r.page_type: (r.url, r.relevance) for r in discovery.discovered(discovery.selected(found), fetched).collect()}
    assert kept == {"pricing": (f"{o}/plans", 16 + 14 + 7 + 8 + 8)}


def test_currencies_of_the_own_origin_only(spark):
    script = "<script>fetch('{}').then(r=>r.json()).then(data=>{{currency = data.currency}});x={{currency: 'USD'}};y={{currency: \"GBP\"}}</script>"
    pages = [(k, "https://a.test/p/x", script.format(e)) for k, e in enumerate(("/api/currency", "currency.json", "https://b.test/currency", "/none/currency", "/odd/currency"))] + [(9, "https://a.test/", None), (10, "nonsense", script.format("/api/currency"))]
    said = [("https://a.test/api/currency", " € "), ("https://a.test/p/currency.json", "$"), ("https://b.test/currency", "€"), ("https://a.test/odd/currency", "CHF")]
    rows = discovery.with_currency(spark.createDataFrame(pages, "page_id int, url string, html string"), spark.createDataFrame(said, "url string, currency string"))
    found = {r.page_id: r.html for r in rows.collect()}
    assert "currency: '€'};y={currency: \"GBP\"}" in found[0] and "currency: '$'" in found[1]
    assert all(found[k] == pages[k][2] for k in (2, 3, 4)) and found[9] is None and found[10] == pages[6][2] and rows.columns == ["page_id", "url", "html"]
