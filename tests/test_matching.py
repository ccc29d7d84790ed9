"""Lines that contexts hold, orders of readers, and the gate before recommendations."""

import random

from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.operators import compare, matching, recommend, versions


def test_first_lines_match_brute_force(spark):
    rng = random.Random(1)
    words = ["pro", "plan", "a", "pro plan", "é", "plan a", "$9", ""]
    groups = [(k, [rng.choice(words) for _ in range(rng.randrange(8))], [" ".join(rng.choice(words) for _ in range(rng.randrange(4))) for _ in range(5)]) for k in range(60)]
    groups += [(100, None, ["x"]), (101, ["x"], None), (102, ["x", None], [None, "x"]), (103, [f"line {k}" for k in range(3000)], [f"see line {k} here" for k in range(3000)])]
    wanted = []
    for key, lines, contexts in groups:
        for n, text in enumerate(contexts or []):
            found = next((i for i, line in enumerate(lines or []) if line and text and line in text), None)
            if found is not None:
                wanted.append((key, n + 1, found + 1, lines[found], (lines[found - 1] or "") if found else None))
    df = spark.createDataFrame(groups, "id bigint, ls array<string>, cs array<string>")
    assert sorted(map(tuple, matching.first_lines(df, "id", "ls", "cs").collect()), key=str) == sorted(wanted, key=str)


def test_order_of_readers(spark):
    words = ["Zeta", "éclair", "Eclair", "eclair", "apple", "Äpfel", "zeta", "Apfel"]
    df = spark.createDataFrame([(1, w) for w in words] + [(2, None)], "page int, value string")
    rows = compare.compact_order(df, "page", F.lit("cta"), F.col("value")).orderBy("page", "place").collect()
    assert [r.value for r in rows] == ["Apfel", "Äpfel", "apple", "eclair", "Eclair", "éclair", "zeta", "Zeta", None]
    assert df.select(F.sort_array(F.collect_list(T.by_locale(F.col("value")))).alias("v")).first().v[0] == "Apfel"


def test_only_what_passes_the_gate_is_recommended(spark):
    schema = "user_id int, field string, supporters int, signals int, mean double, confidence int"
    rows = [(1, "pricing", 4, 3, 0.9, 92), (1, "cta", 1, 1, 0.6, 60), (1, "weak", 2, 1, 0.6, 78), (2, "none", 3, 0, 0.9, 90)]
    found = recommend.ranked(spark.createDataFrame(rows, schema)).collect()
    assert [(r.user_id, r.field, r.tier, r.rank) for r in found] == [(1, "pricing", "prioritize", 1)]
    reviewed = {r.field: r for r in recommend.reviewed(spark.createDataFrame(rows, schema).withColumns({"title": F.lit("add pricing"), "novelty": F.lit(0.7), "priority": F.lit(40)})).collect()}
    assert reviewed["cta"].tier == "reject" and not reviewed["none"].survives


def test_neighbours_over_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), k) for k in range(2000)] + [(f"s{k}", 5000 + k) for k in range(40)]
    rng.shuffle(rows)
    found = {r.id: r.before for r in versions.with_neighbour(spark.createDataFrame(rows, "source string, id bigint"), "source", "id", "before").collect()}
    wanted, last = {}, {}
    for source, i in sorted(rows, key=lambda r: r[1]):
        wanted[i], last[source] = last.get(source), i
    assert found == wanted
    assert versions.with_neighbour(spark.createDataFrame([], "source string, id bigint"), "source", "id", "before").collect() == []


def test_groups_meet_their_rows_however_large(spark):
    rows = spark.createDataFrame([("hot", k) for k in range(900)] + [(f"k{k}", k) for k in range(1500)] + [(None, 1)], "site string, id int")
    groups = spark.createDataFrame([("hot", 900, "a")] + [(f"k{k}", 1, "b") for k in range(1400)], "site string, n int, v string")
    found = versions.attached(rows, groups, "site", "n").select("site", "id", "v").collect()
    assert sorted(map(tuple, found)) == sorted([("hot", k, "a") for k in range(900)] + [(f"k{k}", k, "b") for k in range(1400)])
    assert versions.attached(rows.limit(0), groups.limit(0), "site", "n").collect() == []
