"""Scoring formulas as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the formulas.
RELEVANCE, CONTENT, POPULARITY = 0.6, 0.25, 0.15
BANDIT, OUTCOME, Q = 0.55, 0.25, 0.05
POSTERIOR_SHARE, OUTCOME_SHARE = 0.65, 0.35
DIVERSITY_FLOOR, DIVERSITY_DECAY = 0.55, 0.72
UCB_ALPHA, UCB_CAP, COLD_BOOST, WARM_PRIOR, COLD_PRIOR = 0.75, 0.25, 1.35, 2.0, 1.35 * 4


def clamp(x: Column) -> Column:
    """x in [0, 1]; what is not finite is 0."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def offline_blend(relevance: Column, content: Column, popularity: Column) -> Column:
    return clamp(RELEVANCE * relevance + CONTENT * content + POPULARITY * popularity)


def posterior_mean(base: Column, clicks: Column, impressions: Column, cold: Column) -> Column:
    prior = F.when(cold, max(WARM_PRIOR, COLD_PRIOR)).otherwise(WARM_PRIOR)
    a = 1.0 + clamp(base) * prior + clicks
    b = 1.0 + (1.0 - clamp(base)) * prior + F.greatest(impressions - clicks, F.lit(0))
    return clamp(a / (a + b))


def ucb_bonus(impressions: Column, total: Column, cold: Column) -> Column:
    prior = F.when(cold, max(WARM_PRIOR, COLD_PRIOR)).otherwise(WARM_PRIOR)
    bonus = UCB_ALPHA * F.sqrt(F.log(total + 2.0) / (2.0 * (impressions + prior + 1.0)))
    return F.least(F.when(cold, bonus * COLD_BOOST).otherwise(bonus), F.lit(UCB_CAP))


def weighted_outcome(relevance: Column, content: Column, popularity: Column, clicks: Column, impressions: Column) -> Column:
    ctr = F.when(impressions <= 0, 0.0).otherwise(clicks / impressions)
    smoothed = (clicks + 1.0) / (impressions + 4.0)
    novelty = 1.0 / (impressions + 1.0)
    base = -1.15 + 1.20 * clamp(relevance) + 0.85 * clamp(content) + 0.65 * clamp(popularity) + 0.55 * smoothed + 0.20 * novelty
    positive = (
        0.30 * sigmoid(base - 0.05 + 0.20 * relevance)
        + 0.22 * sigmoid(base - 0.15 + 0.15 * content)
        + 0.18 * sigmoid(base + 0.35 * ctr)
        + 0.22 * sigmoid(base + 0.10 + 0.25 * content)
        + 0.08 * sigmoid(base - 0.70 + 0.20 * novelty)
    )
    return clamp(positive - 0.35 * sigmoid(-base - 0.40 + 0.25 * F.greatest(F.lit(0.0), 0.08 - smoothed)))


def prediction(bandit: Column, outcome: Column, q: Column, bonus: Column) -> Column:
    return clamp(BANDIT * bandit + OUTCOME * outcome + Q * clamp(q) + bonus)


def estimated_reward(posterior: Column, outcome: Column) -> Column:
    return clamp(POSTERIOR_SHARE * posterior + OUTCOME_SHARE * outcome)


def diversity_multiplier(position: Column) -> Column:
    """Of the item that is the position-th (from 0) of its group."""
    return (1.0 - DIVERSITY_FLOOR) * F.pow(F.lit(DIVERSITY_DECAY), position) + DIVERSITY_FLOOR


def dot(a: Column, b: Column) -> Column:
    """Inner product of arrays of doubles; null where the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def packed(features: Column) -> Column:
    """An array of doubles as one text behind the version of its layout."""
    return F.concat(F.lit("v2:"), F.array_join(F.transform(features, lambda x: x.cast("string")), ","))
