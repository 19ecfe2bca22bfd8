"""Streams with timers against their batch forms: late, repeated and idle keys."""

import pytest
from pyspark.sql import functions as F

from cinderloom.functions import events as E
from cinderloom.sources import tables
from cinderloom.streaming import features, stateful

SCHEMA = "event_id string, user_id long, movie_id long, event_type string, watch_ms long, ts_ms long, session_id string"
DAY = 86_400_000


@pytest.fixture(autouse=True)
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    stateful.store(spark)
    yield
    spark.conf.set(key, before)


def batches(spark, tmp_path, parts, schema=SCHEMA):
    """A stream that reads each list of rows as a micro-batch of its own."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in/*"))


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return df.sparkSession.table(name), q


def event(event_id, ts, user=1, movie=1, kind="click", session="s"):
    return (event_id, user, movie, kind, 0, ts, session)


def test_once_keeps_ids_for_a_day(spark, tmp_path):
    """Repeats in a batch, six seconds and almost a day later go; one from the expiry on passes; state shrinks when ids have expired."""
    t = 10 * DAY
    parts = [
        [event("a", t), event("a", t), event("b", t), event("a", t, user=2), event("bad", t, user=0)],
        [event("a", t + 6_000), event("c", t + 60_000)],
        [event("a", t + DAY - 1), event("b", t + DAY)],
        [event("z", t + 4 * DAY)],
        [event("y", t + 4 * DAY + 10_000)],
        [event("x", t + 4 * DAY + 20_000)],
    ]
    got, q = run(stateful.once(features.timed(batches(spark, tmp_path, parts)), buckets=2), tmp_path, "once")
    assert sorted((r.event_id, r.user_id, r.ts_ms - t) for r in got.collect()) == [("a", 1, 0), ("a", 2, 0), ("b", 1, 0), ("b", 1, DAY), ("c", 1, 60_000), ("x", 1, 4 * DAY + 20_000), ("y", 1, 4 * DAY + 10_000), ("z", 1, 4 * DAY)]
    rows = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert rows[-1] < max(rows)


def test_once_is_the_batch_form(spark, sf, tmp_path):
    """Events, and a tenth of them again an hour later: the batch query's rows."""
    from cinderloom.plans import QUERIES

    e = tables.events(spark, sf)
    again = e.filter(F.substring("event_id", 5, 30).cast("long") % 10 == 0).withColumn("ts_ms", F.col("ts_ms") + 3_600_000)
    both = e.union(again).sort("ts_ms").toPandas()
    n = len(both) // 3 + 1
    parts = [[tuple(r) for r in both.iloc[i : i + n].astype(object).itertuples(index=False)] for i in range(0, len(both), n)]
    got, _ = run(stateful.once(features.timed(batches(spark, tmp_path, parts), "40 days")), tmp_path, "once_batch")
    want = QUERIES["t2_dedup"](spark, sf).filter("user_id > 0")
    assert sorted((r.user_id, r.event_id, r.ts_ms) for r in got.collect()) == sorted((r.user_id, r.event_id, r.ts_ms) for r in want.collect())


def test_sessions_end_by_inactivity(spark, tmp_path):
    """A session over midnight stays one; half an hour without an event ends it; an event older than the last is passed over; another session is apart."""
    t = 20 * DAY - 1_000  # a second before midnight
    parts = [
        [event("a", t, kind="click"), event("b", t + 2_000, kind="like", movie=3), event("o", t, session="other")],
        [event("c", t + 1_801_000, kind="search", movie=4)],
        [event("d", t + 1_800_000, kind="like"), event("e", t + 1_802_000, kind="order", movie=5)],
        [event("f", t + 1_802_000 + 1_800_000, kind="view")],
    ]
    got, _ = run(stateful.sessions(features.timed(batches(spark, tmp_path, parts), "1 hour")), tmp_path, "idle", "update")
    last = {}
    for r in got.orderBy("updated").collect():
        last.setdefault(r.session_id, []).append((r.events, r.clicks, r.likes, r.searches, r.engagement, r.last_movie, r.updated - t))
    assert last["other"] == [(1, 1, 0, 0, 2, 1, 0)]
    assert last["s"] == [(2, 1, 1, 0, 5, 3, 2_000), (3, 1, 1, 1, 5, 4, 1_801_000), (4, 1, 1, 1, 13, 5, 1_802_000), (1, 0, 0, 0, 0, 1, 3_602_000)]


def test_sessions_are_the_batch_form(spark, sf, tmp_path):
    from cinderloom.plans import QUERIES

    rows = sorted((tuple(r) for r in tables.events(spark, sf).collect()), key=lambda r: r[5])
    got, _ = run(stateful.sessions(features.timed(batches(spark, tmp_path, [rows[:400], rows[400:]])), idle_ms=40 * DAY), tmp_path, "sessions", "update")
    last = {}
    for r in got.orderBy("updated", "events").collect():
        last[r.user_id, r.session_id] = f"eventCount={r.events},clicks={r.clicks},watches={r.watches},likes={r.likes},searches={r.searches},engagement={r.engagement},lastMovie={r.last_movie},lastType={r.last_type}"
    assert last == {(r.user_id, r.session_id): r.features for r in QUERIES["t5_a11_p2_session_features"](spark, sf).collect()}


def test_trending_is_the_batch_form(spark, sf, tmp_path):
    """Events out of order inside the watermark's delay, in several batches: each window's list comes once and is the batch query's."""
    from cinderloom.plans import QUERIES

    rows = sorted((tuple(r) for r in tables.events(spark, sf).collect()), key=lambda r: r[5] + (r[5] * 7919) % 600_000)
    n = len(rows) // 4 + 1
    end = max(r[5] for r in rows) + 10 * 3_600_000
    parts = [rows[i : i + n] for i in range(0, len(rows), n)] + [[event("end", end, kind="share")], [event("end2", end + 1, kind="share")]]
    got, _ = run(stateful.trending(features.timed(batches(spark, tmp_path, parts), "15 minutes")), tmp_path, "trending")
    got = [(r.window_end - 3_600_000, r.movie_id, r.score, r["rank"]) for r in got.collect()]
    assert sorted(got) == sorted(tuple(r) for r in QUERIES["a9_a10_w1_t7_t8_trending_windows"](spark, sf).select("window_start", "movie_id", "score", "rank").collect())


def test_late_partials_change_nothing(spark, tmp_path):
    """Partials of several buckets are one list; partials after it are counted and change nothing; another window is untouched."""
    schema = "window_end long, movie_id long, score long, at long"
    parts = [
        [(100_000, 8, 3, 90_000), (100_000, 4, 2, 90_000)],
        [(100_000, 8, 4, 95_000), (100_000, 2, 7, 95_000), (100_000, 3, 7, 95_000)],
        [(900_000, 1, 1, 101_000)],
        [(900_000, 1, 2, 101_500)],
        [(100_000, 9, 50, 102_000), (100_000, 9, 1, 102_000)],
        [(900_000, 5, 9, 102_500)],
    ]
    s = batches(spark, tmp_path, parts, schema).withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", "0 seconds")
    got, _ = run(stateful.final_tops(s, 3, lateness_ms=10_000), tmp_path, "late")
    rows = [tuple(r) for r in got.collect()]
    assert rows == [(100_000, 1, 2, 7, 0), (100_000, 2, 3, 7, 0), (100_000, 3, 8, 7, 0), (100_000, 0, 0, 0, 2)]


def test_best_is_a_sort():
    """A heap of k is the head of the sorted list: score downwards, then id."""
    import random

    rng = random.Random(731)
    scores = {m: rng.randint(-15, 14) for m in range(1, 201)}
    for k in (0, 1, 2, 10, 199, 200, 201):
        assert stateful.best(scores, k) == sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_experience_is_the_batch_form(spark, sf, tmp_path):
    """Requests in several batches, each sent on once by its timer; an event after that changes nothing."""
    from cinderloom.plans import QUERIES

    rows = sorted((tuple(r) for r in tables.events(spark, sf).collect()), key=lambda r: r[5] + (r[5] * 7919) % 600_000)
    end = max(r[5] for r in rows) + 3 * DAY
    n = len(rows) // 3 + 1
    parts = [rows[i : i + n] for i in range(0, len(rows), n)] + [[event("end", end)], [event("end2", end + 1), (*rows[0][:5], rows[0][5] + 1, "late")], [event("end3", end + 2)]]
    s = features.timed(batches(spark, tmp_path, parts), "15 minutes").withColumn("request_id", F.floor(F.col("ts_ms") / DAY))
    got, _ = run(stateful.experience(s), tmp_path, "experience")
    want = QUERIES["a12_j7_experience"](spark, sf).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
