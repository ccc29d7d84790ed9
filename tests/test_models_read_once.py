"""Pricing models parse their pages once, though plans, prices and models read them again and again."""

import __spark_entry__


def test_changes_of_models_read_what_was_parsed(spark):
    rows = __spark_entry__.queries()["pricing_model_changes"](spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and rows.count() > 0
