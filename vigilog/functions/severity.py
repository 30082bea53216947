"""Severity words, ranks and risk levels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilog.functions.text import literal_map, lookup
from vigilog.values import ABUSE_CATEGORIES, LEVEL_RANK, SEVERITY_RANK, STIX_CONFIDENCE


def severity_rank(severity) -> Column:
    """5 for critical to 1 for informational, 0 for any other word."""
    return F.coalesce(lookup(SEVERITY_RANK, F.col(severity) if isinstance(severity, str)
                             else severity), F.lit(0))


def level_rank(level) -> Column:
    return F.coalesce(lookup(LEVEL_RANK, F.col(level)), F.lit(2))


def ml_severity(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.70, "medium").otherwise("low")


def stix_confidence(severity: Column) -> Column:
    return F.coalesce(lookup(STIX_CONFIDENCE, severity), F.lit(50))


def risk_level(is_private: Column, abuse_score: Column) -> Column:
    return (
        F.when(is_private, "internal").when(abuse_score.isNull(), "unknown")
        .when(abuse_score >= 75, "high").when(abuse_score >= 25, "medium").otherwise("low")
    )


def abuse_labels(reports: Column) -> Column:
    """Sorted distinct labels of the category ids in the first ten reports."""
    names = literal_map(ABUSE_CATEGORIES)
    ids = F.flatten(F.slice(reports, 1, 10))
    return F.array_sort(F.array_distinct(F.array_compact(
        F.transform(ids, lambda i: F.try_element_at(names, i)))))
