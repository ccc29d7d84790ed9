"""robots.txt rules and sitemaps as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def rules(files: DataFrame, site_col: str, text_col: str) -> DataFrame:
    """(site, line_no, agent, allow, path) of every rule: the agent is the one named last before it."""
    lines = F.transform(F.split(F.coalesce(text_col, F.lit("")), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    rows = files.select(F.col(site_col).alias("site"), F.posexplode(lines).alias("line_no", "_line"))
    rows = rows.select("site", "line_no", F.lower(F.trim(F.regexp_extract("_line", "^([^:]*):", 1))).alias("_key"), F.trim(F.regexp_extract("_line", "^[^:]*:(.*)$", 1)).alias("_value"))
    agent = F.last(F.when(F.col("_key") == "user-agent", F.lower("_value")), ignorenulls=True).over(W.partitionBy("site").orderBy("line_no"))
    rows = rows.withColumn("agent", agent).filter(F.col("_key").isin("allow", "disallow") & (F.col("_value") != "") & F.col("agent").isNotNull())
    return rows.select("site", "line_no", "agent", (F.col("_key") == "allow").alias("allow"), F.col("_value").alias("path"))


def allowed(paths: DataFrame, found: DataFrame, site_col: str, path_col: str, bot: str) -> DataFrame:
    """The paths with allowed: of the rules for all bots or this one whose path begins it, the longest
    decides, of equals the first; without any the path is allowed."""
    mine = found.filter((F.col("agent") == "*") | F.lit(bot.lower()).contains(F.col("agent")))
    mine = mine.groupBy("site").agg(F.collect_list(F.struct(F.length("path").alias("n"), (-F.col("line_no")).alias("l"), "allow", "path")).alias("_rules"))
    rows = paths.join(mine.withColumnRenamed("site", "_site"), F.col(site_col) == F.col("_site"), "left")
    best = F.array_max(F.filter("_rules", lambda r: F.col(path_col).startswith(r["path"])))
    return rows.select(*paths.columns, F.coalesce(best["allow"], F.lit(True)).alias("allowed"))


def sitemap(files: DataFrame, site_col: str, xml_col: str) -> DataFrame:
    """Distinct locations of sitemaps; what isn't XML has none that end properly."""
    found = F.regexp_extract_all(F.coalesce(xml_col, F.lit("")), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    return files.select(F.col(site_col).alias("site"), F.explode(found).alias("url")).distinct()
