"""Event features as streams: the batch operators' results, kept up to date."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cinderloom.functions import events as E
from cinderloom.operators import folds
from cinderloom.operators import ranking as R

DELAY = "5 seconds"
TTL_MS = 86_400_000


def timed(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Events with their time as ``ts`` and the watermark on it."""
    return events.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay)


def deduplicated(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """The first of each user and event id inside the watermark, without Python; invalid events go. stateful.once() keeps ids for a day."""
    return timed(events.filter(E.valid()), delay).dropDuplicatesWithinWatermark(["user_id", "event_id"])


def metric_counts(events: DataFrame, window: str = "10 seconds") -> DataFrame:
    """(window_start, movie_id, metric, n); a window comes out when the watermark has passed its end."""
    e = events.withColumn("metric", E.metric_kind()).filter("metric is not null")
    n = e.groupBy(F.window("ts", window).alias("w"), "movie_id", "metric").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.unix_millis("w.start").alias("window_start"), "movie_id", "metric", "n")


def arrival_counts(events: DataFrame, window: str = "10 seconds") -> DataFrame:
    """(window_start, movie_id, metric, n) by the time at which events come in, not their own: what is counted late is still counted once."""
    e = events.withColumn("metric", E.metric_kind()).filter("metric is not null").withColumn("arrived", F.current_timestamp())
    n = e.groupBy(F.window("arrived", window).alias("w"), "movie_id", "metric").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.unix_millis("w.start").alias("window_start"), "movie_id", "metric", "n")


def window_scores(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """(window_start, movie_id, score): the first of two stages of the trending list."""
    s = events.filter("movie_id > 0").groupBy(F.window("ts", window).alias("w"), "movie_id").agg(F.sum(E.engagement_weight()).alias("score"))
    return s.select(F.unix_millis("w.start").alias("window_start"), "movie_id", "score").filter("score > 0")


def partial_tops(scores: DataFrame, k: int, buckets: int = 16) -> DataFrame:
    """First stage of a list: k movies of each window and bucket of movies, so a window of any size is many tasks' work."""
    b = scores.withColumn("bucket", F.pmod(F.xxhash64("movie_id"), F.lit(buckets)))
    return R.top_k(b, ["window_start", "bucket"], k, F.desc("score"), F.asc("movie_id")).drop("rank", "bucket")


def merged_tops(partials: DataFrame, k: int) -> DataFrame:
    """Second stage: partial lists put together, the scores of a movie summed, k movies a window."""
    s = partials.groupBy("window_start", "movie_id").agg(F.sum("score").alias("score"))
    return R.top_k(s, ["window_start"], k, F.desc("score"), F.asc("movie_id"))


def top_of_windows(scores: DataFrame, k: int) -> DataFrame:
    """Both stages, on the finished windows of a micro-batch (inside foreachBatch): k movies a window."""
    return merged_tops(partial_tops(scores, k), k)


def write_trending(scores: DataFrame, path: str, checkpoint: str, k: int = 10):
    """Starts the query that appends each finished window's list; a repeated batch writes the same folder again."""

    def sink(batch: DataFrame, epoch: int) -> None:
        top_of_windows(batch, k).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return scores.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


def replayed(features: DataFrame, checkpoint: str, mode: str = "update"):
    """Starts a query that builds the same state and writes nowhere: a new job reads the past before its sinks are put on."""
    return features.writeStream.format("noop").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_features(events: DataFrame, keep: str = "1 day") -> DataFrame:
    """(user_id, session_id, counts, engagement, last movie and type) after each micro-batch; a session's state goes ``keep`` behind the watermark.

    Events come through timed(); a session lies in one ``keep`` of time. stateful.sessions() ends them by inactivity instead.
    """
    t, last = F.col("event_type"), F.struct("ts_ms", "event_id")
    s = events.filter(E.valid()).groupBy(F.window("ts", keep).alias("w"), "user_id", "session_id").agg(
        F.count(F.lit(1)).alias("events"),
        *[F.count_if(t.isin(*kinds)).alias(name) for name, kinds in (("clicks", ("click",)), ("watches", ("view", "watch")), ("likes", ("like",)), ("searches", ("search",)))],
        F.sum(E.engagement_weight()).alias("engagement"),
        F.max_by("movie_id", last).alias("last_movie"),
        F.max_by("event_type", last).alias("last_type"),
    )
    return s.drop("w")


Step = Callable[[tuple | None, pd.DataFrame], tuple]


def _kept(events: DataFrame, key: str, columns: list[str], step: Step, show: Callable[[object, tuple], dict], out: str, state: str, ttl_ms: int) -> DataFrame:
    """``show`` of each key after each micro-batch, from a state that ``step`` makes of the one before (None: none) and the batch's rows, a chunk of them in order after the other.

    State is removed when the watermark is ``ttl_ms`` beyond the last event that wrote it; none is ever read after that.
    """

    def run(own: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        made, last = held.get if held.exists else None, 0
        # A key with very many rows, as in a replay, comes in several chunks, of which one is held at a time.
        for rows in batches:
            if len(rows):
                made, last = step(made, rows.sort_values(["ts_ms", "event_id"])), max(last, int(rows["ts_ms"].max()))
        held.update(made)
        held.setTimeoutTimestamp(max(last + ttl_ms, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({c: [v] for c, v in {key: own[0], **show(own[0], made)}.items()})

    kept = timed(events.select(key, "event_id", "ts_ms", *columns))
    return kept.groupBy(key).applyInPandasWithState(run, out, state, "update", GroupStateTimeout.EventTimeTimeout)


def recent_movies(events: DataFrame, k: int = 3, ttl_ms: int = TTL_MS) -> DataFrame:
    """(user_id, movies, ts_ms) after each micro-batch: the last k different movies of a user, oldest first.

    Events older than the last one kept are passed over; a list idle for ``ttl_ms`` starts again.
    """

    def step(state: tuple | None, rows: pd.DataFrame) -> tuple:
        movies, last = (list(state[0]), state[1]) if state else ([], -1)
        for movie, ts in zip(rows["movie_id"], rows["ts_ms"], strict=True):
            if ts < last:
                continue
            if last >= 0 and ts - last > ttl_ms:
                movies = []
            movies = [m for m in movies if m != movie][-(k - 1) :] + [int(movie)] if k > 1 else [int(movie)]
            last = int(ts)
        return movies, last

    kept = events.filter(E.valid() & E.updates_history())
    show = lambda _, s: {"movies": ",".join(map(str, s[0])), "ts_ms": s[1]}
    return _kept(kept, "user_id", ["movie_id"], step, show, "user_id long, movies string, ts_ms long", "movies array<long>, last long", ttl_ms)


def user_vectors(events: DataFrame, dims: int = 16, ttl_ms: int = TTL_MS) -> DataFrame:
    """(user_id, vector, ts_ms) after each micro-batch: weights summed by movie modulo ``dims``. State holds the raw sums; what is shown has length one.

    Events older than the last one counted are passed over; a vector idle for ``ttl_ms`` starts again.
    """

    def step(state: tuple | None, rows: pd.DataFrame) -> tuple:
        sums, last = (list(state[0]), state[1]) if state else ([0.0] * dims, -1)
        for movie, weight, ts in zip(rows["movie_id"], rows["weight"], rows["ts_ms"], strict=True):
            if ts < last:
                continue
            if last >= 0 and ts - last > ttl_ms:
                sums = [0.0] * dims
            sums[int(movie) % dims] += max(1, int(weight))
            last = int(ts)
        return sums, last

    def show(_, s: tuple) -> dict:
        norm = sum(x * x for x in s[0]) ** 0.5
        return {"vector": [x / norm for x in s[0]] if norm else list(s[0]), "ts_ms": s[1]}

    kept = events.filter(E.valid() & E.updates_history()).withColumn("weight", E.engagement_weight())
    return _kept(kept, "user_id", ["movie_id", "weight"], step, show, "user_id long, vector array<double>, ts_ms long", "sums array<double>, last long", ttl_ms)


def item_bias(events: DataFrame, ttl_ms: int = 30 * TTL_MS) -> DataFrame:
    """(movie_id, bias) after each micro-batch: the learner's steps over the events in the order in which they come, as the served learner takes them. The
    batch form goes by event time, so the two differ where an event comes later than a younger one of an earlier micro-batch."""

    def step(state: tuple | None, rows: pd.DataFrame) -> tuple:
        b = state[0] if state else 0.0
        for label in rows["label"]:
            b = max(-folds.BIAS_LIMIT, min(folds.BIAS_LIMIT, b + folds.RATE * (label / 3.0 - 1.0 / (1.0 + math.exp(-b)) - folds.DECAY * b)))
        return (b,)

    kept = events.filter("movie_id > 0").withColumn("label", E.training_label())
    return _kept(kept, "movie_id", ["label"], step, lambda _, s: {"bias": s[0]}, "movie_id long, bias double", "bias double", ttl_ms)
