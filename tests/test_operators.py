import datetime as dt

import pandas as pd
import fixture_pages as fixtures
import pytest
from pyspark.sql import functions as F

from tidepool.operators import evaluate, extract, recommend, rollups, scoring, usage, validate, versions
from tidepool.sources import html
from tidepool.streaming import live, runs


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_versions(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (2, 1, "b")], "k int, t int, v string")
    assert rows_of(versions.latest(rows, ["k"], [F.desc("t")]), "k", "t") == [(1, 4), (2, 1)]
    assert rows_of(versions.beyond(rows, ["k"], [F.desc("t")], F.lit(2)), "k", "t") == [(1, 1), (1, 2)]
    pairs = versions.with_previous(rows, ["k"], [F.col("t")], ["v"]).withColumn("c", versions.changed(["v"]))
    assert rows_of(pairs, "k", "t", "is_first", "c") == [(1, 1, True, True), (1, 2, False, False), (1, 3, False, True), (1, 4, False, False), (2, 1, True, True)]
    assert rows_of(versions.last_value_first_place(rows.filter("v is not null"), ["k"], "t", "v"), "k", "t", "v") == [(1, 1, "a"), (2, 1, "b")]


def test_keyed_diff(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None)], "k string, v double")
    new = spark.createDataFrame([("b", 3.0), ("c", None), ("d", 4.0)], "k string, v double")
    assert rows_of(versions.keyed_diff(old, new, ["k"], ["v"]), "k", "change") == [("a", "removed"), ("b", "changed"), ("c", "same"), ("d", "added")]


def test_streak_starts_again_after_success(spark):
    rows = spark.createDataFrame([(1, t, f) for t, f in enumerate([1, 1, 0, 1, 1, 1])], "k int, t int, f int")
    assert [s for _, s in rows_of(versions.streak(rows, ["k"], [F.col("t")], F.col("f") == 1), "t", "streak")] == [1, 2, 0, 1, 2, 3]


def test_scan_decision_names_the_first_guard(spark):
    rows = spark.createDataFrame([(25.0, 1, 0, False), (1.0, 80, 9, False), (1.0, 1, 5, False), (1.0, 1, 4, False), (99.0, 99, 99, True)], "cost double, every int, own int, admin boolean")
    found = rows.select(usage.scan_decision(F.col("cost"), F.col("every"), F.col("own"), F.lit(5), admin=F.col("admin")).alias("d"))
    assert [r.d for r in found.collect()] == ["budget", "global_limit", "user_limit", "allowed", "allowed"]


@pytest.mark.parametrize("mean, needed", [(0.95, 1), (0.9, 1), (0.75, 2), (0.6, 3), (0.59, 4)])
def test_supporters_needed(spark, mean, needed):
    assert spark.range(1).select(scoring.supporters_needed(F.lit(mean)).alias("n")).first().n == needed


def test_recommendations(spark):
    others = spark.createDataFrame([(1, e, "price", f"v{e}", 0.8) for e in range(3)] + [(1, 9, "demo", "x", 0.95), (1, 8, "rare", "x", 0.6), (1, 7, "low", "x", 0.2)], "user_id int, entity_id int, field string, value string, score double")
    own = spark.createDataFrame([(1, "demo", 0.9), (1, "price", 0.3)], "user_id int, field string, score double")
    found = recommend.ranked(recommend.supported_gaps(own, others)).collect()
    assert [(r.field, r.supporters, r.rank) for r in found] == [("price", 3, 1)]
    assert found[0].confidence == 91 and found[0].visibility == "highlight"


def test_scorecard_and_percentiles(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "p boolean, e boolean")
    assert tuple(evaluate.scorecard(rows, "p", "e").first()) == (4, 0.5, 0.5, 0.5)
    assert tuple(evaluate.scorecard(rows.limit(0), "p", "e").first()) == (0, None, None, None)
    numbers = spark.createDataFrame([(float(x),) for x in range(1, 11)], "x double")
    assert numbers.agg(evaluate.nearest_rank("x", 95)).first()[0] == 10.0


def test_models_of_invented_pages(spark):
    blocks = html.evidence_blocks(fixtures.pages(spark), carry=["page_type"])
    found = extract.prices(blocks)
    assert {(r.price_text, r.accepted) for r in found.collect()} >= {("$29", True), ("$2,500", False), ("$40,000", False)}
    model = {r.page_id: r for r in extract.pricing_models(blocks, found, extract.plans(blocks, found)).collect()}
    assert model[1].plan_names == ["Enterprise", "Pro"] and model[2].highest == pytest.approx(1249 / 12, abs=1e-3)
    assert 0 <= model[3].completeness <= model[1].completeness <= 100


def test_failure_kinds(spark):
    text = spark.createDataFrame([("Timeout after 31 s at https://a.b/c",), ('Timeout after 9 s at https://x.y/"q"',)], "m string")
    assert text.select(rollups.failure_kind(F.col("m")).alias("k")).distinct().count() == 1


def test_stream_over_several_triggers_equals_one(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    frame = pd.DataFrame([(p, 10 * t + p, start + dt.timedelta(hours=t), "x" if t % 3 else "y") for t in range(9) for p in range(3)], columns=["page", "id", "at", "content"])
    for k in range(3):
        spark.createDataFrame(frame[k * 9 : (k + 1) * 9]).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    found = []
    for per in (1, None):
        stream = runs.files(spark, f"file://{tmp_path}/in", per)
        found.append(rows_of(runs.drained(live.version_changes(stream, "page", "id", "at", F.col("content"))), "page_id", "snapshot_id", "change"))
    assert found[0] == found[1] and len(found[0]) == 27
    assert [c for p, i, c in found[0] if p == 0] == ["first", "changed", "same", "changed", "changed", "same", "changed", "changed", "same"]


def test_analysis_order(spark):
    """Preferred roles first, each part by place; no navigation; a page without blocks is one block of its own."""
    pages = spark.createDataFrame([(1, "whole one"), (2, None), (3, "")], "page_id int, text string")
    blocks = spark.createDataFrame(
        [(1, 0, "nav", "n", 0.9), (1, 1, "feature", "f", 0.8), (1, 2, "pricing", "p", 0.8), (1, 3, None, "x", None), (1, 4, "pricing", "q", 0.8), (2, 0, "footer", "z", 0.9)],
        "page_id int, ord int, role string, text string, confidence double",
    )
    found = validate.analysis_blocks(pages, blocks, ("pricing",)).orderBy("page_id", "rank").collect()
    assert [(r.page_id, r.rank, r.text, r.source) for r in found] == [
        (1, 1, "p", "model"), (1, 2, "q", "model"), (1, 3, "f", "model"), (1, 4, "x", "model"), (2, 1, None, "fallback"), (3, 1, "", "fallback"),
    ]
    assert validate.analysis_blocks(pages.limit(0), blocks.limit(0), ("pricing",)).count() == 0
    text = validate.block_text(F.lit(None).cast("string"), F.lit("a"), F.array(F.lit(""), F.lit("b")), F.array(F.lit("c")))
    assert spark.range(1).select(text.alias("t")).first().t == "a\nb\nc"
