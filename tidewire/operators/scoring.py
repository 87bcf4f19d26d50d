"""Event scores: authority of a source, importance of an event, tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How much a source group counts when the lead of an event is picked.
GROUP_AUTHORITY = {
    "vendor-official": 100, "media": 80, "research": 80, "newsletter": 50, "policy": 50, "market": 50, "podcast": 40, "product": 40, "social": 20,
}

#: Least importance of each tier.
TIERS = (("p1", 85), ("featured", 72), ("all", 40))


def tier_of(importance: str) -> str:
    """SQL for the tier of an importance."""
    return "CASE " + " ".join(f"WHEN {importance} >= {least} THEN '{tier}'" for tier, least in TIERS) + " ELSE 'excluded' END"


def authority(group: str, priority: str, importance: str) -> Column:
    """Ten times the authority score, a whole number: group base, 20 for each step of priority below 2, a tenth of the importance."""
    base = F.coalesce(F.create_map([F.lit(x) for kv in GROUP_AUTHORITY.items() for x in kv])[F.col(group)], F.lit(0))
    return base * 10 + (F.lit(2) - F.col(priority)) * 200 + F.coalesce(F.col(importance), F.lit(0))


def event_importance(importance: str) -> Column:
    """Aggregate: the highest importance of the members, and a boost by their number, at most 100."""
    boost = F.round(F.log2(F.count("*") + F.lit(1)) * 6).cast("int")
    return F.least(F.max(F.coalesce(F.col(importance), F.lit(0))) + boost, F.lit(100))
