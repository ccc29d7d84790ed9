"""How good a scan, a validation case or an evaluation is: scores, statuses, reasons, availability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds that each stage may take, and scores of a first useful insight by its time; fixed values.
BUDGETS = (("fetch", 2000), ("discovery", 2000), ("extraction", 2000), ("scoring", 1000), ("render", 1000))
SPEED = ((1500, 20), (3000, 18), (5000, 14), (8000, 8))
CRITICAL = ("pricing", "positioning", "cta", "features")


def speed_score(insight_ms: Column) -> Column:
    """20 at best, 0 without an insight."""
    out = F.when(insight_ms.isNull(), 0)
    for most, score in SPEED:
        out = out.when(insight_ms <= most, score)
    return out.otherwise(3)


def delivery_status(pages: Column, positioning: Column, cta: Column, more: Column) -> Column:
    return F.when(pages == 0, "failed").when(positioning & cta & more, "useful").otherwise("limited")


def scan_score(delivery: Column, completed: Column, missing: Column, warnings: Column, confidence: Column, insight_ms: Column) -> Column:
    """0 to 100: usefulness 35, clarity 25, correctness 20, speed 20, less warnings."""
    useful = F.when(delivery == "useful", 35.0).when(delivery == "limited", F.greatest(F.lit(12.0), completed / len(CRITICAL) * 28)).otherwise(0.0)
    clarity = F.greatest(F.lit(0.0), F.lit(25.0) - missing * 3 - F.least(F.lit(8), warnings))
    penalty = F.least(F.lit(10.0), warnings * 1.5)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.round(useful + clarity + confidence * 20 + speed_score(insight_ms) - penalty * 0.4, 6) + 0.5))).cast("int")


def completeness(score: Column, pages: Column, failed: Column, missing: Column) -> Column:
    return F.when((pages == 0) | (score < 55), "limited").when((score >= 80) & (failed == 0) & (missing <= 1), "complete").otherwise("partial")


def over_budget(stage: Column, duration_ms: Column) -> Column:
    """Whether a stage took longer than it may."""
    budget = F.lit(None).cast("int")
    for name, most in BUDGETS:
        budget = F.when(stage == name, most).otherwise(budget)
    return duration_ms > budget


def count_confidence(high: Column, medium: Column) -> Column:
    """high from three high facts, medium from three high or medium ones."""
    return F.when(high >= 3, "high").when(high + medium >= 3, "medium").otherwise("low")


def mean_completeness(homepage: Column, pricing: Column, features: Column, has_cta: Column) -> Column:
    return F.floor((homepage + pricing + features + F.when(has_cta, 80).otherwise(20)) / 4 + 0.5).cast("int")


def user_value(status: Column, pricing: Column, positioning: Column, cta: Column, features: Column, baseline: Column, evidence: Column, duration_ms: Column) -> Column:
    """0 to 10: what a user gets out of an analysis."""
    useful = lambda c, w: F.when(c == "useful", w).otherwise(0.0)
    score = (
        F.when(status == "pass", 2.0).when(status == "partial", 1.0).otherwise(0.0) + F.when(pricing.isin("found", "contact_sales"), 1.5).otherwise(0.0) + useful(positioning, 1.5) + useful(cta, 1.0) + useful(features, 1.0) + useful(baseline, 1.0)
        + F.when(evidence == "complete", 1.0).when(evidence == "partial", 0.5).otherwise(0.0) + F.when(duration_ms < 3000, 1.0).when(duration_ms < 8000, 0.5).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.round(score, 1)))


def friction(clarity: Column, weak: Column, cases: Column) -> Column:
    """0 to 100: the higher, the more stands between a user and a decision."""
    score = 100 - (clarity + 100 - weak * 100.0 / cases) / 2
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(score, 2)))


def availability(ok: Column, redirected: Column, status: Column, error: Column) -> Column:
    """The state of an address from what fetching it gave."""
    says = lambda p: F.coalesce(error.rlike(p), F.lit(False))
    return (
        F.when(ok & redirected, "redirected").when(ok, "live").when(status.isin(404, 410), "not_found").when(status.isin(401, 403), "blocked").when(status >= 500, "server_error").when(says("(?i)timeout|abort"), "timeout")
        .when(says("(?i)dns|enotfound|getaddrinfo"), "dns_error").when(says("(?i)ssl|certificate|tls"), "ssl_error").when(says("(?i)robot|blocked|forbidden|403"), "blocked").when(F.coalesce(error, F.lit("")) != "", "inaccessible").otherwise("unknown_error")
    )


def relevance(page_type: Column) -> Column:
    return F.when(page_type == "pricing", "high").when(page_type.isin("changelog", "features"), "medium").otherwise("low")
