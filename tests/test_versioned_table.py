"""The keyed sink: repeated, late and equal-time batches, replays, two writers, broken writes."""

from pyspark.sql import functions as F

from cinderloom.sources import tables
from cinderloom.streaming import sinks

SCHEMA = "key string, ts_ms long, event_id string, value string"


def rows(table):
    return sorted((tuple(r) for r in table.read().select("key", "ts_ms", "event_id", "value").collect()), key=repr)


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_only_newer_versions_change_it(spark, tmp_path):
    t = sinks.VersionedTable(spark, str(tmp_path / "t"), ["key"])
    assert t.read() is None
    assert t.write(frame(spark, [("a", 10, "e1", "x"), ("a", 20, "e2", "y"), ("b", 5, "e3", "z"), (None, 1, "e", "n")]), 0)
    want = [("a", 20, "e2", "y"), ("b", 5, "e3", "z"), (None, 1, "e", "n")]
    assert rows(t) == want
    assert not t.write(frame(spark, [("a", 99, "e9", "again")]), 0)  # the batch is in
    t.write(frame(spark, [("a", 15, "late", "old"), ("b", 5, "e2", "equal time, lesser id"), (None, None, "f", "no time")]), 1)
    assert rows(t) == want
    t.write(frame(spark, [("b", 5, "e4", "equal time, greater id")]), 2)
    assert rows(t)[1] == ("b", 5, "e4", "equal time, greater id")
    assert [r.key for r in t.read(alive_at_ms=30, ttl_ms=11).collect()] == ["a"]


def test_a_replay_changes_nothing(spark, tmp_path):
    """The same batches from a writer without memory, compaction in between: equal rows."""
    t = sinks.VersionedTable(spark, str(tmp_path / "t"), ["key"], most_deltas=2)
    parts = [[(f"k{i % 4}", (i * 7) % 11, f"e{i:02d}", f"v{i}") for i in range(n, n + 6)] for n in range(0, 24, 6)]
    for n, part in enumerate(parts):
        t.write(frame(spark, part), n, "first")
    before = rows(t)
    assert before == sorted((max((r for p in parts for r in p if r[0] == k), key=lambda r: r[1:3]) for k in ("k0", "k1", "k2", "k3")), key=repr)
    for n, part in enumerate(parts[::-1]):
        t.write(frame(spark, part), n, "second")
    assert rows(t) == before and t.manifest()["base"] and len(t.manifest()["deltas"]) <= 2
    assert t.vacuum() > 0 and rows(t) == before


def test_a_broken_write_is_not_seen(spark, tmp_path, monkeypatch):
    t = sinks.VersionedTable(spark, str(tmp_path / "t"), ["key"])
    t.write(frame(spark, [("a", 1, "e", "x")]), 0)
    put = t._put
    monkeypatch.setattr(t, "_put", lambda m: (_ for _ in ()).throw(OSError("lost")))
    try:
        t.write(frame(spark, [("a", 2, "f", "y")]), 1)
    except OSError:
        pass
    monkeypatch.setattr(t, "_put", put)
    assert rows(t) == [("a", 1, "e", "x")]
    assert t.write(frame(spark, [("a", 2, "f", "y")]), 1) and rows(t) == [("a", 2, "f", "y")]


def test_writers_that_meet(spark, tmp_path):
    """A commit whose number is taken is repeated on what the other writer left."""
    one, two = (sinks.VersionedTable(spark, str(tmp_path / "t"), ["key"]) for _ in range(2))
    taken, put = [], one._put

    def late(manifest):
        if not taken:
            taken.append(two.write(frame(spark, [("b", 1, "e", "two")]), 0, "two"))
        return put(manifest)

    one._put = late
    one.write(frame(spark, [("a", 1, "e", "one")]), 0, "one")
    assert rows(one) == [("a", 1, "e", "one"), ("b", 1, "e", "two")]


def test_streams_and_lineage(spark, sf, tmp_path):
    """A stream in several batches, and the same once more from its beginning: the batch queries' values and histories."""
    from cinderloom.plans import QUERIES

    e = tables.events(spark, sf).select(F.col("user_id").alias("key"), "ts_ms", "event_id", F.col("event_type").alias("value"))
    e.repartition(5).write.parquet(str(tmp_path / "in"))
    t = sinks.VersionedTable(spark, str(tmp_path / "t"), ["key"], keep=5, most_deltas=3)
    for run in ("a", "b"):
        s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = t.stream(s, str(tmp_path / run), run)
        q.awaitTermination(300)
        assert q.exception() is None
    found = {r.key: r for r in sinks.lineage(t).collect()}
    assert {k: r.event_history for k, r in found.items()} == {r.user_id: r.history for r in QUERIES["k2_lineage"](spark, sf).collect()}
    assert {k: r.value for k, r in found.items()} == {r.user_id: r.value for r in QUERIES["k1_k3_latest_value"](spark, sf).collect()}
    assert all(r.event_history.split(",")[-1] == r.last_event for r in found.values())


def test_event_keys(spark):
    made = frame(spark, [("u", 1, "e", "x"), ("s", 1, "e", "x"), ("u", 1, "e", "x"), ("u", 2, "f", "x")])
    assert {r.event_id: r["keys"] for r in sinks.event_keys(made).collect()} == {"e": "s,u", "f": "u"}
