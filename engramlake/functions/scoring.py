"""Features, importance, tiers, expiry and ranking signals as DataFrame expressions.

The weights, limits and half-lives are fixed values. ``now`` is always given: no expression reads a clock.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engramlake.functions import rules

POSITIVE = "amazing best enjoy favorite favourite good great happy like love prefer".split()
NEGATIVE = "angry bad dislike hate poor sad terrible upset worst".split()
#: Weights of the importance score, in the order of summation.
WEIGHTS = {
    "access_frequency": 0.08, "category_episodic": 0.20, "category_preference": 0.38, "category_procedural": 0.34, "category_semantic": 0.38, "category_task": 0.38,
    "entity_density": 0.08, "has_deadline": 0.09, "interaction_signal": 0.08, "preference_signal": 0.12, "recency": 0.08, "sentiment_strength": 0.05, "task_signal": 0.12, "word_count_norm": 0.06,
}
WORKING_BELOW, LONG_FROM = 0.25, 0.42
ARCHIVE_DAYS, GRACE_HOURS = 90, 24
DURABLE = ("semantic", "preference", "procedural")
CATEGORY_PRIOR = {"semantic": 1.0, "preference": 1.0, "procedural": 0.9, "task": 0.9, "episodic": 0.6, "temporary": 0.1}
TIER_PRIOR = {"long_term": 1.0, "short_term": 0.7, "working": 0.4, "archive": 0.2}
RANK_WEIGHTS = {"keyword": 0.65, "category": 0.10, "tier": 0.05, "recency": 0.10, "importance": 0.10}
HALF_LIFE_DAYS = 30.0


def seconds_between(start: Column, end: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(end) - micros(start)) / 1e6


def features(text: Column, category: Column, created_at: Column, now: Column, access_count: Column, interaction: Column) -> dict[str, Column]:
    """The signals by name. An interaction below zero counts as zero."""
    low, w = F.lower(text), rules.words(text)
    count = lambda those: F.size(F.filter(w, lambda x: x.isin(*those)))
    pos, neg = count(POSITIVE), count(NEGATIVE)
    entities = F.size(F.regexp_extract_all(text, F.lit(r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"), 0))
    flag = lambda c: c.cast("double")
    return {
        "access_frequency": F.least(access_count / 10.0, F.lit(1.0)),
        **{f"category_{c}": flag(category == c) for c in ("episodic", "preference", "procedural", "semantic", "task", "temporary")},
        "entity_density": F.least(entities / F.greatest(F.size(w), F.lit(1)), F.lit(1.0)),
        "has_deadline": flag((category == "task") & rules.deadline(low) & ~rules.completed(low)),
        "interaction_signal": F.greatest(F.lit(0.0), F.least(interaction, F.lit(1.0))),
        "preference_signal": flag(low.rlike(r"\b(like|love|prefer|favorite|favourite|dislike|hate)\b") | rules.constraint(low)),
        "recency": F.greatest(F.lit(0.0), 1.0 - F.least(F.greatest(F.lit(0.0), seconds_between(created_at, now)) / 86400.0, F.lit(1.0))),
        "sentiment_strength": F.coalesce(F.abs((pos - neg) / F.nullif(pos + neg, F.lit(0))), F.lit(0.0)),
        "task_signal": flag(low.rlike(r"\b(remind|todo|to-do|task|follow up|need to|please)\b")),
        "word_count_norm": F.least(F.size(w) / 80.0, F.lit(1.0)),
    }


def importance(signals: dict[str, Column]) -> Column:
    """Weighted sum, a quarter of it for temporary texts, to four places, in [0, 1]."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + signals[name] * weight
    total = total * F.when(signals["category_temporary"] > 0, 0.25).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(total, 4)))


def hybrid_importance(model: Column, heuristic: Column, category: Column) -> Column:
    """A quarter of a model's score (itself a quarter for temporary texts) and three quarters of the rules'."""
    return F.round(0.25 * model * F.when(category == "temporary", 0.25).otherwise(1.0) + 0.75 * heuristic, 4)


def last_activity(created: str, accessed: str, observed: str) -> Column:
    return F.greatest(F.col(created), F.coalesce(accessed, created), F.coalesce(observed, created))


def should_archive(now: Column, active_at: Column, category: Column, access_count: Column, score: Column) -> Column:
    """Idle for 90 days, not a task, and once used or important enough."""
    idle = seconds_between(active_at, now) >= ARCHIVE_DAYS * 86400
    return (category != "task") & idle & ((access_count > 0) | (score >= LONG_FROM))


def tier(category: Column, score: Column, closed: Column, recurs: Column, archive: Column) -> Column:
    return (
        F.when((category == "task") & closed, "archive")
        .when(archive, "archive")
        .when((category == "temporary") | (score < WORKING_BELOW), "working")
        .when((category == "task") & ~recurs, "short_term")
        .when(category.isin(*DURABLE, "task") & (score >= LONG_FROM), "long_term")
        .otherwise("short_term")
    )


def expiry(category: Column, tier: Column, closed: Column, recurs: Column, due: Column, base: Column, disclosing: Column) -> Column:
    hours = lambda c, n: c + F.make_dt_interval(hours=F.lit(n))
    none = F.lit(None).cast("timestamp_ntz")
    return (
        F.when((category == "task") & (closed | recurs), none)
        .when(due.isNotNull(), hours(due, GRACE_HOURS))
        .when(tier == "working", hours(base, 1))
        .when((tier == "short_term") & (category == "episodic") & disclosing, hours(base, 90 * 24))
        .when(tier == "short_term", hours(base, 14 * 24))
        .otherwise(none)
    )


def half_life(at: Column, now: Column, days: float = HALF_LIFE_DAYS) -> Column:
    """1 now, one half after ``days``; the future counts as now."""
    return F.pow(F.lit(2.0), -F.greatest(F.lit(0.0), seconds_between(at, now) / 86400.0) / days)


def prior(column: Column, values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[column]


def rank_score(coverage: Column, category: Column, tier: Column, recency: Column, importance: Column, weights: dict[str, float] = RANK_WEIGHTS) -> Column:
    total = sum(weights.values())
    if set(weights) != set(RANK_WEIGHTS) or min(weights.values()) < 0 or not total > 0:
        raise ValueError("five weights that are not negative and have a positive sum are needed")
    parts = {"keyword": coverage, "category": prior(category, CATEGORY_PRIOR), "tier": prior(tier, TIER_PRIOR), "recency": recency, "importance": F.greatest(F.lit(0.0), F.least(importance, F.lit(1.0)))}
    out = F.lit(0.0)
    for name, weight in weights.items():
        out = out + weight * parts[name]
    return out / total


def pool_size(limit: int, reranked: bool, override: int | None = None) -> int:
    if not reranked:
        return min(200, max(20, 4 * limit))
    return max(limit, min(200, override if override is not None else max(100, 4 * limit)))
