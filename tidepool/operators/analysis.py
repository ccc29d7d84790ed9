"""Whole pages analysed at once from one stored parse, what is shown of them, and runs over stored pages that resume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as K

from tidepool.functions import money
from tidepool.operators import compare, display, extract, scoring, structured
from tidepool.operators.sinks import known, stored
from tidepool.sources import dom, html

PLAN = "struct<place:int,plan:string,price:double,currency:string,billing_period:string,limits:array<string>,found_in:string>"
ACTION = "struct<place:int,label:string,intent:string,score:double>"
FEATURE = "struct<place:int,name:string,description:string,score:double>"
RELEASE = "struct<place:int,heading:string,released:string>"
CLAIM = "struct<place:int,headline:string,support:string,score:double>"
#: Sections of an analysis: the list that fills each and the gate that lets it run.
SECTIONS = {"plans": (PLAN, "run_pricing"), "actions": (ACTION, "run_cta"), "features": (FEATURE, "run_features"), "releases": (RELEASE, "run_momentum"), "claims": (CLAIM, "run_positioning")}
#: Why a section has nothing; features are shown from so many on, options up to so many; fixed values.
GATED, NOTHING = "page_type_not_verified", "not_detected"
LEAST_FEATURES, MOST_OPTIONS = 3, 6


def parsed(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, page_type, status_code, html) parsed once and written, with what their scripts hold."""
    markup = F.coalesce("html", F.lit(""))
    rows = pages.withColumns({"shell": extract.shell_signs(markup), "n_chars": F.char_length(markup), "arrays": structured.script_arrays(F.col("html"))})
    return stored(dom.parsed(rows, carry=["url", "page_type", "status_code", "shell", "n_chars", "arrays"], parts=("elements", "block_places", "evidence", "structures")), "parsed-pages")


def validity(rows: DataFrame) -> Column:
    """blocked, missing, script_shell or ok, from status and what a parsed page shows."""
    few = F.aggregate("evidence", F.lit(0), lambda n, e: n + F.char_length(F.array_join(e["lines"], "\n"))) < extract.LITTLE
    return (
        F.when(F.col("status_code").isin(401, 403, 429), "blocked").when((F.col("status_code") >= 400) | (F.col("n_chars") == 0), "missing")
        .when(few & F.col("shell"), "script_shell").otherwise("ok")
    )


def analyse(found: DataFrame) -> DataFrame:
    """One row per parsed page: validity, metadata, every section as a typed list, a pricing model and warnings.

    All extractors read the stored parse, and the plans the prices that are written from it; what they find meets in one aggregation by page. Sections that may not run
    on the page's type, or on a page that isn't valid, are empty lists, and say so in warnings.
    """
    evidence = html.with_roles(dom.part(found.select("page_id", "url", "page_type", "evidence"), "evidence"))
    #: Read by three branches of the plans, each of which would search all lines again.
    priced = stored(extract.prices(evidence), "priced")
    from_text = extract.plans(evidence, priced)
    from_structure = structured.plans_of(dom.part(found.select("page_id", "structures"), "structures"), structured.plans_of_arrays(found.select("page_id", "arrays")))
    plans = structured.merged(from_structure, from_text)
    month = money.monthly(F.col("price"), F.col("billing_period"))
    place = F.row_number().over(W.partitionBy("page_id").orderBy(month.asc_nulls_last(), "plan")).alias("place")
    plans = plans.select("page_id", place, "plan", "price", "currency", "billing_period", "limits", "found_in")
    actions = extract.calls_to_action(evidence).filter("rejected is null").select("page_id", F.col("rank").alias("place"), "label", "intent", "score")
    named = extract.features(evidence).withColumnRenamed("rank", "place")
    releases = extract.releases(evidence).select("page_id", F.col("rank").alias("place"), "heading", "released")
    claims = extract.positioning(evidence).withColumn("place", F.lit(1))
    models = structured.model(structured.merged(from_structure, from_text)).select("page_id", F.struct("status", "plans", "lowest", "highest", "completeness").alias("pricing"))

    row = lambda kind: F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in _fields(kind)])
    parts = [rows.select("page_id", row(SECTIONS[name][0]).alias(name)) for name, rows in (("plans", plans), ("actions", actions), ("features", named), ("releases", releases), ("claims", claims))]
    about = html.metadata(dom.part(found.select("page_id", "elements"), "elements")).select("page_id", F.struct("title", "description", "h1").alias("metadata"))
    own = found.select("page_id", F.struct("url", "page_type", "status_code", validity(found).alias("validity"), F.size("block_places").alias("blocks")).alias("page"))
    every = own
    for part in (about, models, *parts):
        every = every.unionByName(part, allowMissingColumns=True)
    one = lambda c: F.first(c, ignorenulls=True).alias(c)
    rows = every.groupBy("page_id").agg(one("page"), one("metadata"), one("pricing"), *[F.array_sort(F.collect_list(c)).alias(f"_{c}") for c in SECTIONS])
    return _gated(rows)


def _fields(kind: str) -> list[K.StructField]:
    return K.StructType.fromDDL(kind.removeprefix("struct<").removesuffix(">")).fields


def _gated(rows: DataFrame) -> DataFrame:
    rows = rows.select("*", *display.gates(F.col("page.page_type"), F.col("page.validity") == "ok"))
    lists = [F.when(F.col(gate), F.col(f"_{name}")).otherwise(F.array().cast(f"array<{kind}>")).alias(name) for name, (kind, gate) in SECTIONS.items()]
    none = F.struct(F.lit("unknown").alias("status"), F.lit(0).cast("long").alias("plans"), F.lit(None).cast("double").alias("lowest"), F.lit(None).cast("double").alias("highest"), F.lit(0).alias("completeness"))
    pricing = F.when(F.col("run_pricing") & F.col("pricing").isNotNull(), F.col("pricing")).otherwise(none).alias("pricing")
    why = F.array_compact(F.array(*[F.when(~F.col(gate), F.lit(f"{name}:{GATED}")).when(F.size(f"_{name}") == 0, F.lit(f"{name}:{NOTHING}")) for name, (_, gate) in SECTIONS.items()]))
    return rows.select("page_id", "page.*", "metadata", pricing, *lists, why.alias("warnings"))


def views(analyses: DataFrame) -> DataFrame:
    """What is shown of each analysed page: state and options of pricing, the primary action and others, features from
    three on, the latest release, one sentence for an overview, and notes on what is missing."""
    options = F.slice(F.filter("plans", lambda p: ~p["plan"].rlike(r"(?i)^(unnamed|plan \d+)$")), 1, MOST_OPTIONS)
    options = F.transform(options, lambda p: F.struct(p["plan"].alias("plan"), display.money_text(p["price"], p["currency"], p["billing_period"]).alias("price_text"), p["limits"].alias("limits")))
    state = F.when(F.exists("plans", lambda p: p["price"].isNotNull()), "public").when(F.size("plans") > 0, "contact_sales").otherwise("not_detected")
    features = F.when(F.size("features") >= LEAST_FEATURES, F.transform("features", lambda f: f["name"])).otherwise(F.array().cast("array<string>"))
    labels = F.transform("actions", lambda a: a["label"])
    said = F.array_compact(F.array(F.get("claims", F.lit(0))["headline"], F.when(F.col("pricing.lowest").isNotNull(), F.concat(F.lit("from "), F.format_string("%.2f", "pricing.lowest"))), F.get(labels, F.lit(0))))
    return analyses.select(
        "page_id", "url", "validity",
        F.struct(state.alias("state"), options.alias("options"), F.col("pricing.completeness").alias("completeness"), F.array_distinct(F.transform("plans", lambda p: p["billing_period"])).alias("modes")).alias("pricing"),
        F.struct(F.get(labels, F.lit(0)).alias("primary"), F.slice(labels, 2, 5).alias("others")).alias("actions"),
        F.struct(F.when(F.size(features) > 0, "found").otherwise("unavailable").alias("status"), features.alias("names")).alias("features"),
        F.get(F.transform("releases", lambda r: r["released"]), F.lit(0)).alias("latest_release"), F.array_join(said, " · ").alias("overview"), "warnings",
    )


#: What changed between two analyses, in sentences with names, each with its confidence; fixed values.
CHANGES = {
    "pricing_plan_added": ("New pricing plan added: {name}.", 0.84), "pricing_model_changed": ("{name} plan changed from {old} to {new}.", 0.9), "pricing_plan_removed": ("Pricing plan removed: {name}.", 0.82),
    "cta_changed": ('Primary CTA changed from "{old}" to "{new}".', None), "positioning_changed": ('Homepage headline changed from "{old}" to "{new}".', 0.86), "target_customer_changed": ('Target customer changed from "{old}" to "{new}".', 0.82),
    "feature_added": ('New feature signal added: "{name}".', 0.76), "feature_removed": ('Feature signal removed: "{name}".', 0.76),
}
SUPPRESSED = {
    "low_confidence_model": ("alert_suppressed", "No user-facing alert because one business model is low confidence."),
    "low_confidence_pricing_model": ("pricing_alert_suppressed", "No pricing alert because pricing model confidence was low."),
}
#: Confidence of a call to action that is sure, and of one that isn't; confidence from which a change is written, changes of
#: a page at most; fixed values.
SURE, UNSURE, WRITTEN, MOST_CHANGES, HIGH = 0.9, 0.7, 0.82, 8, 0.8


def _amount(plan: Column) -> Column:
    number = F.regexp_replace(F.format_string("%.2f", plan["price"]), r"\.?0+$", "")
    return F.concat(F.coalesce(plan["currency"], F.lit("")), F.lit(" "), F.coalesce(number, F.lit("custom")))


def _change(kind: str, confidence: Column | None = None, told: str | None = None, **named: Column) -> Column:
    sentence, sure = CHANGES[kind]
    return F.struct(
        F.lit(told or kind).alias("type"), compare.filled(sentence, **named).alias("summary"), (confidence if confidence is not None else F.lit(sure)).cast("double").alias("confidence"),
        F.lit(False).alias("suppressed"), F.lit(None).cast("string").alias("reason"),
    )


def _no_alert(reason: str) -> Column:
    kind, sentence = SUPPRESSED[reason]
    return F.struct(F.lit(kind).alias("type"), F.lit(sentence).alias("summary"), F.lit(0.0).alias("confidence"), F.lit(True).alias("suppressed"), F.lit(reason).alias("reason"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(page_id, place, type, summary, confidence, suppressed, reason, severity, written) of two analyses of each page: plans
    by name, then the primary call to action, the claim, the first feature that came and the first that went.

    Nothing but a suppressed alert comes of a pair in which a page isn't valid, and of prices if one side has none.
    Written are the first eight changes that are sure enough and aren't suppressed."""
    side = lambda df, p: df.select("page_id", F.struct("validity", "pricing", *SECTIONS).alias(p))
    rows = side(old, "o").join(side(new, "n"), "page_id")
    none = F.array().cast("array<struct<type:string,summary:string,confidence:double,suppressed:boolean,reason:string>>")
    by = lambda plans, name: F.get(F.filter(plans, lambda x: F.lower(x["plan"]) == F.lower(name)), F.lit(0))
    key = lambda p: F.concat_ws(":", p["plan"], F.coalesce(p["currency"], F.lit("")), F.coalesce(p["price"].cast("string"), F.lit("custom")), F.coalesce(p["billing_period"], F.lit("")))

    def of_new(p: Column) -> Column:
        was = by(F.col("o.plans"), p["plan"])
        return F.when(was.isNull(), _change("pricing_plan_added", name=p["plan"])).when(key(was) != key(p), _change("pricing_model_changed", name=p["plan"], old=_amount(was), new=_amount(p)))

    plans = F.array_compact(F.concat(F.transform("n.plans", of_new), F.transform("o.plans", lambda p: F.when(by(F.col("n.plans"), p["plan"]).isNull(), _change("pricing_plan_removed", name=p["plan"])))))
    first = lambda p, section, field: F.get(F.col(f"{p}.{section}"), F.lit(0))[field]
    differ = lambda section, field: first("o", section, field) != first("n", section, field)
    sure = lambda p: F.when(first(p, "actions", "score") >= HIGH, SURE).otherwise(UNSURE)
    names = lambda p: F.transform(f"{p}.features", lambda f: F.lower(f["name"]))
    lacking = lambda a, b: F.get(F.filter(f"{a}.features", lambda f: ~F.array_contains(names(b), F.lower(f["name"]))), F.lit(0))
    both_named = (F.size("o.features") > 0) & (F.size("n.features") > 0)
    told = lambda kind, section, field, confidence=None: F.when(differ(section, field), _change(kind, confidence, old=first("o", section, field), new=first("n", section, field)))
    rest = F.array_compact(F.array(
        told("cta_changed", "actions", "label", F.least(sure("o"), sure("n"))), told("positioning_changed", "claims", "headline"), told("target_customer_changed", "claims", "support"),
        F.when(both_named & lacking("n", "o").isNotNull(), _change("feature_added", told="feature_model_changed", name=lacking("n", "o")["name"])),
        F.when(both_named & lacking("o", "n").isNotNull(), _change("feature_removed", told="feature_model_changed", name=lacking("o", "n")["name"])),
    ))
    priced = (F.col("o.pricing.status") != "unknown") & (F.col("n.pricing.status") != "unknown")
    valid = (F.col("o.validity") == "ok") & (F.col("n.validity") == "ok")
    every = F.when(~valid, F.array(_no_alert("low_confidence_model"))).otherwise(F.concat(F.when(priced, plans).otherwise(F.array(_no_alert("low_confidence_pricing_model"))), rest, none))
    rows = rows.select("page_id", F.posexplode(every).alias("_i", "_c")).select("page_id", (F.col("_i") + 1).alias("place"), "_c.*")
    kept = ~F.col("suppressed") & (F.col("confidence") >= WRITTEN)
    order = F.sum(kept.cast("int")).over(W.partitionBy("page_id").orderBy("place"))
    return rows.withColumns({"severity": scoring.severity(F.col("confidence")), "written": kept & (order <= MOST_CHANGES)})


def rerun(pages: DataFrame, key: str, path: str, run: int, work: Callable[[DataFrame], DataFrame], parts: int = 8) -> DataFrame:
    """Analyse stored pages again, part by part, and give the rows of the last run that ended.

    Pages are dealt once to `parts` folders by a hash of their key. A part counts as done when its number stands in
    the run's log, which is written behind the part; a run that starts again leaves such parts alone and writes the
    others anew. When all are done, one row is added to the list of runs: until then readers see the run before.
    """
    spark = pages.sparkSession
    dealt, rows, done, ended = f"{path}/input/run={run}", f"{path}/rows/run={run}", f"{path}/done", f"{path}/ended"
    logged = lambda n: spark.createDataFrame([(run, n)], "run int, part int").coalesce(1).write.mode("append").parquet(done)
    finished = {r.part for r in known(spark, done, "run int, part int").filter(F.col("run") == run).collect()}
    if -1 not in finished:
        pages.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).repartition(parts, "_part").write.mode("overwrite").partitionBy("_part").parquet(dealt)
        logged(-1)
    given = spark.read.schema(K.StructType([*pages.schema.fields, K.StructField("_part", K.IntegerType())])).parquet(dealt)
    for n in range(parts):
        if n not in finished:
            work(given.filter(F.col("_part") == n).drop("_part")).write.mode("overwrite").parquet(f"{rows}/part={n}")
            logged(n)
    if known(spark, ended, "run int").filter(F.col("run") == run).isEmpty():
        spark.createDataFrame([(run,)], "run int").coalesce(1).write.mode("append").parquet(ended)
    return latest_run(spark, path)


def latest_run(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of the last run that ended; None if none has."""
    run = known(spark, f"{path}/ended", "run int").agg(F.max("run")).first()[0]
    return None if run is None else spark.read.parquet(f"{path}/rows/run={run}").drop("part")
