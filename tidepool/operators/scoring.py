"""Scores, labels and gates of facts, changes, scans and recommendations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confidence at which a change counts as trusted; how different a text must be; fixed values.
TRUSTED = 0.72
#: What evidence of a trusted change doesn't speak of.
UNTRUSTED_EVIDENCE = r"(?i)(utm_|tracking|duplicate_homepage)"


def trusted(confidence: Column, evidence: Column | None = None) -> Column:
    good = F.coalesce(confidence, F.lit(0.0)) >= TRUSTED
    return good if evidence is None else good & ~F.coalesce(evidence.rlike(UNTRUSTED_EVIDENCE), F.lit(False))


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")


def clamped_confidence(level: Column, score: Column) -> Column:
    """A fact's score inside the range of its level."""
    return F.when(level == "high", F.greatest(score, F.lit(0.8))).when(level == "medium", F.greatest(score, F.lit(0.55))).otherwise(F.least(score, F.lit(0.54)))


def supporters_needed(mean_confidence: Column) -> Column:
    return F.when(mean_confidence >= 0.9, 1).when(mean_confidence >= 0.75, 2).when(mean_confidence >= 0.6, 3).otherwise(4)


def quality_label(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 60, "medium").otherwise("limited")


def monitoring_quality(checked: Column, failed: Column, warnings: Column, changed: Column, speed: Column) -> Column:
    """0 to 100: share of pages checked, a bonus for changes found, speed, less failures and warnings."""
    total = F.greatest(checked + failed, F.lit(1))
    score = checked / total * 35 + 25 + F.when(changed > 0, 20).otherwise(12) + speed - failed * 8 - F.least(F.lit(10.0), warnings * 1.5)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def severity(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.82, "medium").otherwise("low")


def severity_rank(level: Column) -> Column:
    return F.when(level == "high", 3).when(level == "medium", 2).otherwise(1)


def alerts(quality: Column, limited: Column, confidence: Column, level: Column) -> Column:
    return (quality >= 80) & ~limited & (confidence >= TRUSTED) & level.isin("medium", "high")


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """A percentage; 0 of nothing."""
    return F.when(whole == 0, 0.0).otherwise(F.round(part * 100.0 / whole, digits))
