"""Streams over files against the batch form."""

from pyspark.sql import functions as F

from cinderloom.functions import events as E
from cinderloom.operators import recall
from cinderloom.sources import tables
from cinderloom.streaming import features

SCHEMA = "event_id string, user_id long, movie_id long, event_type string, watch_ms long, ts_ms long, session_id string"


def _stream(spark, sf, tmp_path):
    e = tables.events(spark, sf)
    late = spark.createDataFrame([("end", 1, 1, "view", 0, 9_999_999_999_999, "s")], SCHEMA)
    e.repartition(1).sortWithinPartitions("ts_ms").write.parquet(str(tmp_path / "in/a"))
    late.write.parquet(str(tmp_path / "in/b"))
    return e, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def test_counts_and_trending(spark, sf, tmp_path):
    e, s = _stream(spark, sf, tmp_path)
    q = features.metric_counts(features.timed(s)).writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = e.withColumn("metric", E.metric_kind()).filter("metric is not null").groupBy((F.floor(F.col("ts_ms") / 10000) * 10000).alias("window_start"), "movie_id", "metric").count()
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in want.collect()}
    features.write_trending(features.window_scores(features.deduplicated(s)), str(tmp_path / "out"), str(tmp_path / "c2"), 5).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    valid = e.filter(E.valid() & (F.col("movie_id") > 0)).groupBy((F.floor(F.col("ts_ms") / 3_600_000) * 3_600_000).alias("window_start"), "movie_id").agg(F.sum(E.engagement_weight()).alias("score"))
    want = features.top_of_windows(valid.filter("score > 0"), 5)
    cols = ["window_start", "movie_id", "score"]
    assert {tuple(r) for r in got.select(cols).collect()} == {tuple(r) for r in want.select(cols).collect()}


def test_recent_movies(spark, sf, tmp_path):
    e, s = _stream(spark, sf, tmp_path)
    q = features.recent_movies(s.filter("event_id <> 'end'"), ttl_ms=10**15).writeStream.format("memory").queryName("recent").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.user_id: r.movies for r in spark.table("recent").orderBy("ts_ms").collect()}
    kept = e.filter(E.valid() & E.updates_history()).withColumnRenamed("movie_id", "item_id")
    want: dict = {}
    for r in recall.recent_items(kept, 3).orderBy(F.desc("rank")).collect():
        want.setdefault(r.user_id, []).append(str(r.item_id))
    assert got == {u: ",".join(m) for u, m in want.items()}


def _run(df, tmp_path, name, mode="update"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(180)
    return df.sparkSession.table(name)


def test_user_vectors_and_bias(spark, sf, tmp_path):
    """Streamed vectors and biases end where the batch forms do."""
    from cinderloom.plans import QUERIES

    e, s = _stream(spark, sf, tmp_path)
    s = s.filter("event_id <> 'end'")
    last: dict = {}
    for r in _run(features.user_vectors(s, ttl_ms=10**15), tmp_path, "vectors").collect():
        last[r.user_id] = r.vector
    want: dict = {}
    for r in QUERIES["v18_t4_x32_user_vectors"](spark, sf).collect():
        want.setdefault(r.user_id, [0.0] * 16)[r.dim] = r.x
    assert {u: [round(x, 6) for x in v] for u, v in last.items()} == want
    got = {r.movie_id: r.bias for r in _run(features.item_bias(s, ttl_ms=10**15), tmp_path, "biases").collect()}
    batch = {r.movie_id: r.bias for r in QUERIES["t12_item_bias"](spark, sf).collect()}
    assert got.keys() == batch.keys() and all(abs(got[m] - b) < 1e-6 for m, b in batch.items())


def test_sessions_and_replay(spark, sf, tmp_path):
    from cinderloom.plans import QUERIES

    _, s = _stream(spark, sf, tmp_path)
    s = s.filter("event_id <> 'end'")
    got: dict = {}
    for r in _run(features.session_features(features.timed(s)), tmp_path, "sessions").collect():
        got[r.user_id, r.session_id] = f"eventCount={r.events},clicks={r.clicks},watches={r.watches},likes={r.likes},searches={r.searches},engagement={r.engagement},lastMovie={r.last_movie},lastType={r.last_type}"
    assert got == {(r.user_id, r.session_id): r.features for r in QUERIES["t5_a11_p2_session_features"](spark, sf).collect()}
    q = features.replayed(features.recent_movies(s, ttl_ms=10**15), str(tmp_path / "replay"))
    q.awaitTermination(180)
    assert q.exception() is None and sum(p.numInputRows for p in q.recentProgress) > 0


def test_counts_by_arrival(spark, sf, tmp_path):
    """Every event is counted once, in windows of the time at which its file was read, whatever its own time."""
    import time

    e, s = _stream(spark, sf, tmp_path)
    before = time.time() * 1000
    q = features.arrival_counts(s.filter("event_id <> 'end'")).writeStream.format("memory").queryName("arrived").outputMode("complete").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("arrived")
    want = e.withColumn("metric", E.metric_kind()).filter("metric is not null").groupBy("movie_id", "metric").count()
    assert {tuple(r) for r in got.groupBy("movie_id", "metric").agg(F.sum("n")).collect()} == {tuple(r) for r in want.collect()}
    assert got.filter(F.col("window_start") < before - 10_000).count() == 0


def test_idle_state_goes(spark, tmp_path):
    """A list idle for longer than its time starts again; one event later than the last is passed over."""
    rows = [(1, "a", 10, 1000), (1, "b", 11, 1500), (1, "c", 12, 900), (1, "d", 13, 9000), (2, "e", 14, 1000)]
    for i, r in enumerate(rows):
        spark.createDataFrame([(r[1], r[0], r[2], "click", 0, r[3], "s")], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    s = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in/*"))
    got = {r.user_id: r.movies for r in _run(features.recent_movies(s, ttl_ms=5000), tmp_path, "idle").collect()}
    assert got == {1: "13", 2: "14"}


def test_two_stage_lists(spark):
    """Partial lists by bucket and their merge are the list of all movies."""
    rows = [(w, m, (m * 37 + w) % 11) for w in range(3) for m in range(-150, 151)]
    scores = spark.createDataFrame(rows, "window_start long, movie_id long, score long")
    got = {(r.window_start, r["rank"]): r.movie_id for r in features.merged_tops(features.partial_tops(scores, 20, 17), 20).collect()}
    want = {(w, k + 1): m for w in range(3) for k, (_, m) in enumerate(sorted((-s, m) for v, m, s in rows if v == w)[:20])}
    assert got == want
