"""Steps that make segments comparable leave alone what they can't find anything in, and find the same as without that."""

from pyspark.sql import functions as F

from tidepool.functions import text as T

ODD = [
    None, "", "\n\n", "a", "Plain words here", "<b>Bold</b> &amp;lt; &#36; 5 , then\nid='x' data-a=\"1\" CLASS='Y'", "BUILD-abcdef12 next_1234567 Webpack:zzzzzzz", "0123456789ABCDEF01 deadbeefdeadbeef", "a​b‌c‍d﻿e",
    "‘q’ “w”", "at 10:30 PM or 9:05:10", "$ 5 5 € £  7", "5 / MO 6 / Yearly / month", "PER  Month per\tYEAR Monthly YEARLY Annually", "Accept\nCookie notice\nALL RIGHTS RESERVED\nx\nKept line\nkept  line", "İd=\"q\" Kelvin/mo",
]


def test_steps_are_left_out_without_another_result(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "id int, text string")
    each = F.transform(F.split(F.coalesce("text", F.lit("")), r"\n+"), T.comparable)
    plain = F.array_join(F.array_sort(F.array_distinct(F.filter(each, lambda s: ~T.is_boilerplate(s)))), "\n")
    found = rows.select("id", T.canonical_content(F.col("text")).alias("got"), plain.alias("want"))
    assert [(r.id, r.got) for r in found.collect()] == [(r.id, r.want) for r in found.collect()]
    steps = rows.select(T.canonical_content(F.col("text")))._jdf.queryExecution().analyzed().toString()
    assert steps.count("CASE WHEN") >= len(T.COMPARABLE)
