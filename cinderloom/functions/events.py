"""Predicates, labels and weights of events, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Durations (ms) from which a view or a dwell counts, and the event types known.
LONG_VIEW, LONG_DWELL = 30_000, 10_000
TYPES = ("view", "watch", "click", "like", "rating", "order", "purchase", "search", "dwell")
ORDERS, VIEWS = ("order", "purchase"), ("view", "watch")

def _type() -> Column:
    return F.col("event_type")


def valid() -> Column:
    return (F.col("user_id") > 0) & (F.trim("event_id") != "")


def long_view() -> Column:
    return _type().isin(*VIEWS) & (F.col("watch_ms") >= LONG_VIEW)


def long_dwell() -> Column:
    return (_type() == "dwell") & (F.col("watch_ms") >= LONG_DWELL)


def updates_history() -> Column:
    return (F.col("movie_id") > 0) & (_type().isin("click", "like", "rating", *ORDERS) | long_view() | long_dwell())


def engagement_weight(rating: Column | None = None) -> Column:
    rated = F.lit(0) if rating is None else F.when(rating >= 4, 4).otherwise(0)
    w = F.when(_type().isin(*ORDERS), 8).when(_type() == "like", 3).when(_type() == "rating", rated)
    return w.when(_type() == "click", 2).when(long_view() | long_dwell(), 1).otherwise(0).cast("long")


def training_label(rating: Column | None = None) -> Column:
    good = (_type() == "like") if rating is None else (_type() == "like") | ((_type() == "rating") & (rating >= 4))
    return F.when(_type().isin(*ORDERS), 3).when(good, 2).when(_type().isin("click", "search") | long_view() | long_dwell(), 1).otherwise(0)


def known_type() -> Column:
    return F.when(F.lower(F.trim(_type())).isin(*TYPES), F.lower(F.trim(_type())))


def metric_kind() -> Column:
    kind = F.when(_type().isin(*ORDERS), "orders").when(_type() == "like", "likes").when(_type() == "rating", "ratings")
    kind = kind.when(_type() == "click", "clicks").when(_type() == "dwell", "dwells").when(_type().isin(*VIEWS), "views")
    return F.when(F.col("movie_id") > 0, F.concat(kind, F.lit("_1h")))


def alive_at(reference_ms: Column, ttl_seconds: int) -> Column:
    return F.col("ts_ms") + max(1, ttl_seconds) * 1000 > reference_ms
