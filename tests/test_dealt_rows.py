"""Pages made of narrow rows are dealt to tasks by their number, and prices are found in one pass over them."""

from pyspark.sql import functions as F

from tidepool.operators import analysis, extract
from tidepool.plans.analysis import _pages


def test_made_pages_are_dealt_by_their_number(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.1/supplier.parquet")
    more = rows.unionByName(rows.withColumn("s_suppkey", F.col("s_suppkey") + 1000)).coalesce(1)
    more.write.parquet(f"{tmp_path}/supplier.parquet")
    pages = _pages(spark, str(tmp_path))
    assert pages.rdd.getNumPartitions() == 4
    assert pages.count() == 2000 and pages.agg(F.count_distinct("page_id")).first()[0] == 2000
    rows.limit(0).write.parquet(f"{tmp_path}/none/supplier.parquet")
    assert _pages(spark, f"{tmp_path}/none").count() == 0


def test_lines_beside_a_price_need_no_shuffle(spark):
    lines = [["Pro", "$9", "per month"], ["$5 a month for one team"], ["a"], [], ["$7"], ["x", "9 EUR"]]
    rows = spark.createDataFrame([(1, f"1:{i}", "pricing", "pricing", i, x) for i, x in enumerate(lines)], "page_id int, block_id string, role string, page_type string, ord int, lines array<string>")
    found = extract.prices(rows)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in found.orderBy("block_id").select("block_id", "line_no", "price_text", "context", "period").collect()]
    assert got == [("1:0", 1, "$9", "Pro\n$9\nper month", "month"), ("1:1", 0, "$5", "$5 a month for one team", "unknown"), ("1:4", 0, "$7", "$7", "unknown"), ("1:5", 1, "9 EUR", "x\n9 EUR", "unknown")]


def test_an_analysis_searches_its_lines_for_prices_once(spark, monkeypatch):
    written, stored = [], analysis.stored
    monkeypatch.setattr(analysis, "stored", lambda rows, name: written.append(name) or stored(rows, name))
    rows = analysis.analyse(analysis.parsed(_pages(spark, "/root/testdata/sf0.001")))
    assert written == ["parsed-pages", "priced"] and rows.count() > 0
