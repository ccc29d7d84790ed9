"""Usage: costs, plans, limits over rolling days, and the decision to run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Plans with their scans a day, owners' limits, hours between checks and versions kept; fixed values.
PLANS = (("free", 1, 3, 168, 15), ("pro", 5, 20, 12, 30), ("business", 25, 999, 6, 60))
PAGE_COST, TOKEN_COST, MONTHLY_BUDGET, GLOBAL_SCANS, MONTHLY_TOKENS = 0.0005, 0.0002, 20.0, 80, 400_000
DEFERRED = "Analysis deferred due to usage limits. It will retry later."


def plans(spark) -> DataFrame:
    """One row a plan; three rows, so a join with it broadcasts."""
    kinds = T.StructType([T.StructField("plan", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("scans_per_day", "owner_limit", "interval_hours", "versions_kept")]])
    return spark.createDataFrame(list(PLANS), kinds)


def page_cost(pages: Column) -> Column:
    return F.round(F.greatest(F.lit(0), pages).cast("double") * PAGE_COST, 6)


def token_cost(tokens: Column) -> Column:
    return F.round(F.greatest(F.lit(0), tokens).cast("double") / 1000 * TOKEN_COST, 6)


def text_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.char_length(F.coalesce(text, F.lit(""))) / 4)


def within_hours(ts: Column, now: Column, hours: int) -> Column:
    return (ts > now - F.expr(f"INTERVAL {hours} HOURS")) & (ts <= now)


def scan_decision(month_cost: Column, scans_global: Column, scans_user: Column, limit: Column, budget: float = MONTHLY_BUDGET, most: int = GLOBAL_SCANS, admin: Column | None = None) -> Column:
    """allowed, or the first guard that says no: budget, global_limit, user_limit; admins pass."""
    out = F.when(admin if admin is not None else F.lit(False), "allowed")
    return out.when(month_cost >= budget, "budget").when(scans_global >= most, "global_limit").when(scans_user >= limit, "user_limit").otherwise("allowed")


def retry_minutes(attempts: Column) -> Column:
    return F.least(F.lit(60), attempts * 5)


def job_state(attempts: Column, deferred: Column, ok: Column) -> Column:
    """What becomes of a running job: completed, deferred, failed after three attempts, else queued again."""
    return F.when(ok, "completed").when(deferred, "deferred").when(attempts >= 3, "failed").otherwise("queued")
