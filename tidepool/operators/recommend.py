"""Recommendations from what other products' facts have in common and one's own lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepool.operators import scoring

#: Gates of a recommendation that is shown: confidence, value, novelty, priority; fixed values.
LEAST_CONFIDENCE, LEAST_VALUE, LEAST_NOVELTY, LEAST_PRIORITY, LEAST_FACT = 75, 60, 0.6, 35, 0.55
#: A recommendation that can be acted on, of the usual impact and effort; fixed values.
ACTIONABLE, IMPACT, EFFORT = 0.86, 0.62, 0.7
#: Titles that name an action, weights of the parts of a review, and what survives it; fixed values.
ACTS = r"(?i)\b(?:test|make|clarify|surface|reduce|compare|add|show|replace|tighten)\b"
PLAIN, SPECIFIC, OTHER, LEAST_WORDS = 3.0, 9.0, 7.0, 4
EACH_PROOF, MEAN_PROOF, PER_PRIORITY, MOST_SUPPORT, PER_SPECIFIC = 1.7, 4, 15, 3, 4
LEAST_TOTAL, LEAST_PROOF, LEAST_SURE = 45, 6, 6
GENERIC = ("improve cta", "add pricing", "clarify positioning", "improve onboarding", "add features")


def novelty(title: Column, signals: Column, supporters: Column) -> Column:
    """Low for titles that fit any product, else higher with distinct signals and supporters."""
    return F.when(F.lower(title).isin(*GENERIC), 0.2).otherwise(F.least(F.lit(0.94), 0.54 + signals * 0.12 + supporters * 0.06))


def priority(actionability: Column, impact: Column, effort: Column, confidence: Column) -> Column:
    """0 to 100: how much comes of it for the effort, as far as it is sure."""
    return F.least(F.lit(100), F.floor(actionability * impact * (confidence / 100) / effort * 100 + 0.5)).cast("int")


def confidence(supporters: Column, own_score: Column, mean: Column) -> Column:
    """At most 96: a base, supporters up to four, one's own fact, and how sure the supporters' facts are."""
    raw = 48 + F.least(supporters, F.lit(4)) * 9 + own_score * 14 + mean * 20
    return F.least(F.lit(96), F.floor(F.round(raw, 6) + 0.5)).cast("int")


def tier(value: Column) -> Column:
    return F.when(value >= 60, "prioritize").when(value >= 52, "show").when(value >= 45, "hide").otherwise("reject")


def visibility(confidence: Column) -> Column:
    return F.when(confidence >= 90, "highlight").when(confidence >= 75, "normal").otherwise("collapsed")


def reviewed(rows: DataFrame) -> DataFrame:
    """Recommendations (title, supporters, signals, mean, confidence, novelty, priority) with value (0 to 70), tier and
    whether they survive the review: enough value and proof, sure enough, something the supporters say."""
    ten = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.round(x, 1)))
    generic = F.lower("title").isin(*GENERIC[:3]) | (F.size(F.filter(F.split("title", r"\s+"), lambda w: w != "")) < LEAST_WORDS)
    specific = F.when(generic, PLAIN).when(F.col("title").rlike(ACTS), SPECIFIC).otherwise(OTHER)
    proof = ten(F.least(F.lit(10.0), (F.col("supporters") + 1) * EACH_PROOF + F.col("mean") * MEAN_PROOF))
    useful = ten(F.col("priority") / PER_PRIORITY + F.least(F.lit(MOST_SUPPORT), F.col("supporters")) + specific / PER_SPECIFIC)
    sure = ten(F.col("confidence") / 10)
    total = F.floor(F.round(specific + proof + ten(F.lit(ACTIONABLE * 10)) + ten(F.col("novelty") * 10) + ten(F.lit(IMPACT * 10)) + useful + sure, 6) + 0.5).cast("int")
    rows = rows.withColumns({"value": total, "_proof": proof, "_sure": sure})
    survives = (F.col("value") >= LEAST_TOTAL) & (F.col("_proof") >= LEAST_PROOF) & (F.col("_sure") >= LEAST_SURE) & (F.col("signals") > 0)
    return rows.withColumns({"tier": tier(F.col("value")), "survives": survives}).drop("_proof", "_sure")


def final(rows: DataFrame) -> DataFrame:
    """The reviewed recommendations that may be shown."""
    return rows.filter(passes(F.col("confidence"), F.col("value"), F.col("novelty"), F.col("priority")) & (F.col("tier") == "prioritize") & F.col("survives"))


def passes(confidence: Column, value: Column, novel: Column, rank: Column) -> Column:
    return (confidence >= LEAST_CONFIDENCE) & (value >= LEAST_VALUE) & (novel >= LEAST_NOVELTY) & (rank >= LEAST_PRIORITY)


def supported_gaps(own: DataFrame, others: DataFrame) -> DataFrame:
    """Fields that enough others state reliably and one's own facts don't: (user_id, field, supporters,
    signals, confidence, needed).

    own: (user_id, field, score); others: (user_id, entity_id, field, value, score), the entities a user
    watches. One pass of grouping by user and field, then an anti-join with what the user has.
    """
    reliable = others.filter(F.col("score") >= LEAST_FACT)
    rows = reliable.groupBy("user_id", "field").agg(
        F.count_distinct("entity_id").alias("supporters"), F.count_distinct(F.lower(F.trim("value"))).alias("signals"), F.avg("score").alias("_mean"),
    )
    rows = rows.withColumn("needed", scoring.supporters_needed(F.col("_mean"))).filter(F.col("supporters") >= F.col("needed"))
    has = own.filter(F.col("score") >= LEAST_FACT).select("user_id", "field").distinct()
    rows = rows.join(has, ["user_id", "field"], "left_anti")
    return rows.withColumn("confidence", confidence(F.col("supporters"), F.lit(0.0), F.col("_mean"))).withColumnRenamed("_mean", "mean")


def ranked(gaps: DataFrame, most: int = 3) -> DataFrame:
    """The best gaps of each user that pass the final gate, with novelty, priority, value and visibility."""
    title = F.concat(F.lit("Show "), F.col("field"), F.lit(" as "), F.col("supporters").cast("string"), F.lit(" others do"))
    rows = gaps.withColumn("title", title).withColumn("novelty", F.round(novelty(F.col("title"), F.col("signals"), F.col("supporters")), 4))
    rows = rows.withColumn("priority", priority(F.lit(ACTIONABLE), F.lit(IMPACT), F.lit(EFFORT), F.col("confidence")))
    rows = final(reviewed(rows))
    order = W.partitionBy("user_id").orderBy(F.desc("novelty"), F.desc("priority"), F.desc("confidence"), "field")
    rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return rows.withColumn("visibility", visibility(F.col("confidence")))


def baseline(facts: DataFrame, rules: dict[str, Column], key: str = "user_id") -> DataFrame:
    """(key, rule) for each rule that a user's own facts call for."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), name) for name, when in rules.items()]))
    return facts.select(key, F.explode(found).alias("rule"))


def by_rule(counts: DataFrame, rules: list[str], least: int = 2, key: str = "user_id") -> DataFrame:
    """(key, others, rule, supporters) of the rules that enough others support, from a row of counts a user."""
    rows = counts.select(key, "others", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("supporters")) for r in rules])).alias("_r"))
    return rows.select(key, "others", "_r.*").filter(F.col("supporters") >= least)
