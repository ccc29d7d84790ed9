"""Writers that can run again: merged batches, runs over stored pages; and whole pages analysed at once."""

import fixture_pages as fixtures
import pytest
from pyspark.sql import functions as F

from tidepool.operators import analysis, sinks

SCHEMA = "id bigint, email string, joined string, at int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def batch(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_merge_again_changes_nothing(spark, tmp_path):
    path, order = f"file://{tmp_path}/users", [F.desc("at")]
    first = batch(spark, *[(k, f"a{k}", "mon", 1) for k in range(50)], (7, "late", "tue", 2), (None, "none", "mon", 1))
    second = batch(spark, (3, "new", "wed", 5), (99, "fresh", "wed", 5))
    sinks.merge(first, path, ["id"], order, 1)
    wanted = sorted([(k, f"a{k}", "mon", 1, 1) for k in range(50) if k not in (3, 7)] + [(7, "late", "tue", 2, 1), (3, "new", "mon", 5, 2), (99, "fresh", "wed", 5, 2)], key=str)
    for _ in range(2):
        assert rows_of(sinks.merge(second, path, ["id"], order, 2, update=["email", "at"])) == wanted
    assert rows_of(sinks.merge(batch(spark, (3, "other", "x", 9)), path, ["id"], order, 2)) == wanted
    assert rows_of(sinks.merge(batch(spark), path, ["id"], order, 3)) == wanted


def test_only_touched_folders_are_written(spark, tmp_path):
    path = f"file://{tmp_path}/users"
    sinks.merge(batch(spark, *[(k, "a", "m", 1) for k in range(200)]), path, ["id"], [F.col("at")], 1)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "users").glob("_folder=*/*.parquet")}
    before = files()
    sinks.merge(batch(spark, (5, "b", "m", 2)), path, ["id"], [F.col("at")], 2)
    assert len(before) == 16 and len(set(before.items()) & set(files().items())) == 15


def test_merge_after_a_failure_between_its_steps(spark, tmp_path):
    """The staged rows replace folders that a failure has emptied."""
    path, order = f"file://{tmp_path}/users", [F.col("at")]
    sinks.merge(batch(spark, *[(k, "a", "m", 1) for k in range(40)]), path, ["id"], order, 1)
    whole = rows_of(sinks.merge(batch(spark, (1, "b", "m", 2)), path, ["id"], order, 2))
    touched = next(p for p in (tmp_path / "users").glob("_folder=*") if any(r.id == 1 for r in spark.read.parquet(f"file://{p}").collect()))
    for f in touched.glob("*.parquet"):
        f.unlink()
    spark.createDataFrame([(1,)], "batch bigint").write.mode("overwrite").parquet(f"{path}-merged")
    assert rows_of(sinks.merge(batch(spark, (1, "b", "m", 2)), path, ["id"], order, 2)) == whole


def test_a_run_that_stopped_goes_on(spark, tmp_path):
    path, done = f"file://{tmp_path}/runs", spark.sparkContext.accumulator(0)
    pages = spark.createDataFrame([(k, f"v{k}") for k in range(100)], "page_id bigint, html string")

    def work(version, fail_at=None):
        calls = []

        def run(rows):
            calls.append(1)
            if fail_at is not None and len(calls) > fail_at:
                raise RuntimeError("stopped")
            return rows.select("page_id", F.lit(version).alias("version"))

        return run, calls

    assert analysis.latest_run(spark, path) is None
    run, calls = work(1, 3)
    with pytest.raises(RuntimeError):
        analysis.rerun(pages, "page_id", path, 1, run, parts=6)
    assert analysis.latest_run(spark, path) is None
    run, calls = work(1)
    found = analysis.rerun(pages, "page_id", path, 1, run, parts=6)
    assert len(calls) == 3 and rows_of(found) == sorted([(k, 1) for k in range(100)], key=str)
    run, calls = work(2, 2)
    with pytest.raises(RuntimeError):
        analysis.rerun(pages, "page_id", path, 2, run, parts=6)
    assert {r.version for r in analysis.latest_run(spark, path).collect()} == {1}
    run, calls = work(2)
    assert {r.version for r in analysis.rerun(pages, "page_id", path, 2, run, parts=6).collect()} == {2} and len(calls) == 4
    run, calls = work(2)
    assert analysis.rerun(pages, "page_id", path, 2, run, parts=6).count() == 100 and not calls
    assert done.value == 0


def test_one_parse_for_every_section(spark):
    found = analysis.parsed(fixtures.pages(spark))
    rows = analysis.analyse(found)
    assert "InArrow" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {r.page_id: r for r in rows.collect()}
    assert {k: r.validity for k, r in got.items()} == {1: "ok", 2: "ok", 3: "ok", 4: "script_shell", 5: "blocked", 6: "missing"}
    assert [(p.plan, p.price, p.found_in) for p in got[1].plans] == [("Starter", 0.0, "structure"), ("Pro", 29.0, "both"), ("Enterprise", None, "both")]
    assert got[1].pricing.status == "public_pricing" and [a.label for a in got[1].actions] == ["Start free", "Start free", "Get Pro", "Contact sales"] and got[1].features == []
    assert got[5].plans == got[6].actions == [] and got[5].pricing.status == "unknown" and "plans:page_type_not_verified" in got[5].warnings
    assert [f.name for f in got[3].features] == ["Automatic schedules", "Shared calendars"]
    views = {r.page_id: r for r in analysis.views(rows).collect()}
    assert [o.price_text for o in views[1].pricing.options] == ["Free", "$29 / month", "Contact sales"] and views[5].pricing.state == "not_detected" and views[3].features.status == "unavailable"
    assert analysis.analyse(analysis.parsed(fixtures.pages(spark).limit(0))).count() == 0
