"""Keyed state with timers of its own: what windows and aggregates cannot say about event streams.

The queries need the RocksDB state store (``store()``). Their time is that of the events; the watermark comes with timed(). Events
that come after the watermark are dropped by Spark before they meet any state.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from cinderloom.functions import events as E

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS, IDLE_MS, SWEEP_MS = 86_400_000, 1_800_000, 3_600_000


def store(spark: SparkSession) -> None:
    """Sets the state store that these queries need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Once(StatefulProcessor):
    """Lets the first of each (user, event id) through; one that comes before the last one's expiry goes.

    The state of a bucket is a map from user and event id to its expiry. Expired ids are swept by a timer, once in SWEEP_MS of event time.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.expiry = handle.getMapState("expiry", "user_id long, event_id string", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() // SWEEP_MS * SWEEP_MS + SWEEP_MS)
        for chunk in rows:
            chunk = chunk.sort_values(["ts_ms", "event_id"], kind="stable")
            passed, fresh = [], {}
            for user, event, ts in zip(chunk["user_id"], chunk["event_id"], chunk["ts_ms"], strict=True):
                own = (int(user), event)
                held = fresh[own] if own in fresh else (self.expiry.getValue(own) or (None,))[0]
                passed.append(held is None or held <= ts)
                if passed[-1]:
                    fresh[own] = int(ts) + self.ttl_ms
            for own, at in fresh.items():
                self.expiry.updateValue(own, (at,))
            yield chunk[passed].drop(columns="bucket")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        gone, left = [], False
        for own, at in self.expiry.iterator():
            if at[0] <= now:
                gone.append(own)
            else:
                left = True
        for own in gone:
            self.expiry.removeKey(own)
        if left:
            self.handle.registerTimer(now // SWEEP_MS * SWEEP_MS + SWEEP_MS)
        yield from ()

    def close(self) -> None:
        pass


def once(events: DataFrame, ttl_ms: int = DAY_MS, buckets: int = 64) -> DataFrame:
    """``events`` (timed) without invalid ones and without those whose user and event id came before and have not expired: an id expires ``ttl_ms`` after the
    time of the event that was let through.

    State is dealt to ``buckets`` by user and event id, so a user with a third of all events is all tasks' work.
    """
    e = events.filter(E.valid())
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in e.schema.fields]
    dealt = e.withColumn("bucket", F.pmod(F.xxhash64("user_id", "event_id"), F.lit(buckets)).cast("int"))
    out = dealt.groupBy("bucket").transformWithStateInPandas(Once(ttl_ms), ", ".join(kept), "Append", "EventTime", eventTimeColumnName="ts")
    return out.select(*events.columns)


_COUNTS = ("events", "clicks", "watches", "likes", "searches", "engagement")
_SESSION = ", ".join(f"{c} long" for c in _COUNTS) + ", last_movie long, last_type string, updated long"


class Sessions(StatefulProcessor):
    """Counts of each session, from the first event after its last one expired; events older than the last one counted are passed over."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", _SESSION)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        before = held and held[-1]
        for chunk in rows:
            chunk = chunk.sort_values(["ts_ms", "event_id"], kind="stable")
            for kind, movie, weight, ts in zip(chunk["event_type"], chunk["movie_id"], chunk["weight"], chunk["ts_ms"], strict=True):
                if held is not None and ts >= held[-1] + self.idle_ms:
                    held = None
                if held is not None and ts < held[-1]:
                    continue
                new = (1, kind == "click", kind in E.VIEWS, kind == "like", kind == "search", weight)
                sums = tuple(int(a) + int(b) for a, b in zip(held[: len(_COUNTS)] if held else (0,) * len(_COUNTS), new, strict=True))
                held = (*sums, int(movie), kind, int(ts))
        if held[-1] != before:
            if before is not None:
                self.handle.deleteTimer(before + self.idle_ms)
            self.handle.registerTimer(held[-1] + self.idle_ms)
        self.state.update(held)
        yield pd.DataFrame({"user_id": [key[0]], "session_id": [key[1]], **{c: [v] for c, v in zip((*_COUNTS, "last_movie", "last_type", "updated"), held, strict=True)}})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def sessions(events: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """(user_id, session_id, counts, engagement, last movie and type, updated) after each micro-batch.

    A session's state goes ``idle_ms`` after its last event, whatever the day; an event from then on starts it again.
    """
    e = events.filter(E.valid()).withColumn("weight", E.engagement_weight())
    slim = e.select("user_id", "session_id", "event_id", "event_type", F.coalesce("movie_id", F.lit(0)).alias("movie_id"), "weight", "ts_ms", "ts")
    return slim.groupBy("user_id", "session_id").transformWithStateInPandas(Sessions(idle_ms), f"user_id long, session_id string, {_SESSION}", "Update", "EventTime")


_SCORED = "movie_id long, score long"


def best(scores: dict[int, int], k: int) -> list[tuple[int, int]]:
    """The k movies of greatest score (ties: least id) as (movie, score), by a heap of k."""
    return [(m, s) for s, m in ((-s, m) for s, m in heapq.nsmallest(k, ((-s, m) for m, s in scores.items())))]


class Partial(StatefulProcessor):
    """The best k of a window's bucket, sent on by a timer at the window's end. State never holds more than k movies."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle) -> None:
        self.handle = handle
        self.top = handle.getListState("top", _SCORED)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = dict(self.top.get()) if self.top.exists() else {}
        for chunk in rows:
            held.update(zip(map(int, chunk["movie_id"]), map(int, chunk["score"]), strict=True))
            held = dict(best(held, self.k))
        self.top.put(list(held.items()))
        self.handle.registerTimer(int(key[0]))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = list(self.top.get())
        self.top.clear()
        # A row that is sent on must not be older than the watermark.
        at = pd.Timestamp(max(int(key[0]), timerValues.getCurrentWatermarkInMs()), unit="ms")
        yield pd.DataFrame({"window_end": int(key[0]), "movie_id": [m for m, _ in found], "score": [s for _, s in found], "ts": at})

    def close(self) -> None:
        pass


class Final(StatefulProcessor):
    """Partial lists of a window put together: one list, by a timer at the window's end, and none again.

    Partials of a window whose list is out are counted in ``late`` and change nothing; a second timer, ``lateness_ms`` after the end, forgets the window. Where
    the watermark passes both times at once, the list comes out all the same.
    """

    def __init__(self, k: int, lateness_ms: int):
        self.k, self.lateness_ms = k, max(1, lateness_ms)

    def init(self, handle) -> None:
        self.handle = handle
        self.scores = handle.getMapState("scores", "movie_id long", "score long")
        self.out = handle.getValueState("out", "late long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        end = int(key[0])
        if self.out.exists():
            n = self.out.get()[0] + sum(len(chunk) for chunk in rows)
            self.out.update((n,))
            yield pd.DataFrame({"window_end": [end], "rank": [0], "movie_id": [0], "score": [0], "late": [n]})
            return
        for chunk in rows:
            for m, s in zip(chunk["movie_id"], chunk["score"], strict=True):
                held = self.scores.getValue((int(m),))
                self.scores.updateValue((int(m),), (int(s) + (held[0] if held else 0),))
        self.handle.registerTimer(end)
        self.handle.registerTimer(end + self.lateness_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = int(key[0])
        if not self.out.exists() and self.scores.exists():
            top = best({m[0]: s[0] for m, s in self.scores.iterator()}, self.k)
            self.out.update((0,))
            yield pd.DataFrame({"window_end": end, "rank": range(1, len(top) + 1), "movie_id": [m for m, _ in top], "score": [s for _, s in top], "late": 0})
        self.scores.clear()
        if expiredTimerInfo.getExpiryTimeInMs() > end:
            self.out.clear()

    def close(self) -> None:
        pass


def partial_tops(events: DataFrame, k: int, window: str = "1 hour", buckets: int = 16) -> DataFrame:
    """(window_end, movie_id, score, ts): first stage. Scores are summed by window and movie, and of each bucket of movies the best k go on when the window ends."""
    e = events.filter(E.valid() & (F.col("movie_id") > 0))
    s = e.groupBy(F.window("ts", window).alias("w"), "movie_id").agg(F.sum(E.engagement_weight()).alias("score")).filter("score > 0")
    s = s.select(F.unix_millis("w.end").alias("window_end"), "movie_id", "score", F.window_time("w").alias("ts"), F.pmod(F.xxhash64("movie_id"), F.lit(buckets)).cast("int").alias("bucket"))
    return s.groupBy("window_end", "bucket").transformWithStateInPandas(Partial(k), f"window_end long, {_SCORED}, ts timestamp", "Append", "EventTime", eventTimeColumnName="ts")


def final_tops(partials: DataFrame, k: int, lateness_ms: int = 5_000) -> DataFrame:
    """(window_end, rank, movie_id, score, late): second stage. Rows of rank 0 tell of partial rows that came too late, how many in all."""
    return partials.groupBy("window_end").transformWithStateInPandas(Final(k, lateness_ms), f"window_end long, rank long, {_SCORED}, late long", "Append", "EventTime")


def trending(events: DataFrame, k: int = 10, window: str = "1 hour", buckets: int = 16, lateness_ms: int = 5_000) -> DataFrame:
    """Both stages: the list of each window of timed events, once, when the watermark has passed its end."""
    return final_tops(partial_tops(events, k, window, buckets), k, lateness_ms)


class Experience(StatefulProcessor):
    """What a user did with one request's items, sent on by a timer ``wait_ms`` after the first event. State has a row for each item."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "movie_id long", "label int, ts_ms long, event_id string, type string, first_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        started = self.items.exists()
        for chunk in rows:
            for movie, *new, kind in zip(*(chunk[c] for c in ("movie_id", "label", "ts_ms", "event_id", "event_type")), strict=True):
                best, own = (int(new[0]), int(new[1]), new[2], kind), (int(movie),)
                held = self.items.getValue(own)
                first = min(held[4], best[1]) if held else best[1]
                self.items.updateValue(own, (*max(best, tuple(held[:4]) if held else best), first))
        if not started:
            self.handle.registerTimer(min(v[4] for _, v in self.items.iterator()) + self.wait_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = sorted((v[4], m[0], v[0], v[3]) for m, v in self.items.iterator())
        self.items.clear()
        slate = ",".join(f"{m}:{label}:{kind}" for _, m, label, kind in found)
        yield pd.DataFrame({"user_id": [key[0]], "request_id": [key[1]], "label": [max(x[2] for x in found)], "first_ms": [found[0][0]], "items": [len(found)], "slate": [slate]})

    def close(self) -> None:
        pass


def experience(events: DataFrame, wait_ms: int = DAY_MS) -> DataFrame:
    """(user_id, request_id, label, first_ms, items, slate) of each request of timed events with a ``request_id``, once, when the watermark is ``wait_ms`` beyond its first event.

    Of an item the greatest label counts, with the type of the event that gave it (the latest of several). Events later than that find the request closed: they are
    behind the watermark, and Spark drops them.
    """
    s = events.filter(E.valid()).withColumn("label", E.training_label())
    slim = s.select("user_id", F.col("request_id").cast("long").alias("request_id"), F.coalesce("movie_id", F.lit(0)).cast("long").alias("movie_id"), "label", "ts_ms", "event_id", "event_type", "ts")
    out = "user_id long, request_id long, label int, first_ms long, items long, slate string"
    return slim.groupBy("user_id", "request_id").transformWithStateInPandas(Experience(wait_ms), out, "Append", "EventTime")
