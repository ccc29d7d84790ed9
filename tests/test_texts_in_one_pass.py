"""The meaningful text of pages comes from one parse of them."""

from tidepool.sources import dom, html


def test_pages_are_parsed_once(spark):
    few = "<html><body><h1>One</h1><p>One</p><div>Two words. Three words! One</div></body></html>"
    many = "<html><body>" + "".join(f"<p>Text {i % 9}</p>" for i in range(20)) + "</body></html>"
    rows = html.meaningful(dom.parsed(spark.createDataFrame([(1, few), (2, many), (3, None), (4, "")], "page_id int, html string"), parts=("meaningful",)))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {}
    for r in rows.orderBy("page_id", "place").collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[1][0] == "One" and len(got[1]) == len(set(got[1])) > 1 and got[2] == [f"Text {i}" for i in range(9)] and set(got) == {1, 2}
