"""Operators against hand-computed fixtures, and registered queries against their SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderloom.functions import events as E
from cinderloom.operators import folds, ranking, recall, statistics, vectors
from cinderloom.plans import QUERIES, SQL
from cinderloom.sources import files

RATINGS = [
    *[(123, i, r, t) for i, r, t in ((1, 5.0, 0), (2, 5.0, 800), (3, 4.5, 1600), (4, 4.0, 2400))],
    *[(124, i, r, t) for i, r, t in ((5, 5.0, 100), (6, 4.5, 900), (3, 4.0, 1700), (1, 3.0, 2500))],
    *[(125, i, r, t) for i, r, t in ((7, 5.0, 200), (8, 4.5, 1000), (12, 3.5, 1800), (11, 3.0, 2600))],
    *[(126, i, r, t) for i, r, t in ((9, 5.0, 300), (10, 5.0, 1100), (11, 4.0, 1900), (2, 3.0, 2700))],
    *[(127, i, r, t) for i, r, t in ((11, 5.0, 400), (12, 4.5, 1200), (2, 4.0, 2000), (4, 3.5, 2800))],
]


@pytest.fixture(scope="module")
def ratings(spark):
    return spark.createDataFrame(RATINGS, "user_id long, item_id long, rating double, ts long")


def test_co_rating_counts(ratings):
    n = {(r.item_id, r.other_id): r.n for r in recall.co_rating(ratings).collect()}
    assert n[2, 4] == n[4, 2] == 2 and n[1, 3] == 2 and n[11, 12] == 2 and (1, 1) not in n


def test_similar_users_rank_candidates(spark):
    rows = [(1, 10, 5.0, 0), (1, 11, 3.0, 0), (2, 10, 5.0, 0), (2, 11, 3.0, 0), (2, 12, 4.0, 0), (3, 10, 1.0, 0), (3, 13, 5.0, 0), (4, 14, 5.0, 0)]
    c = recall.from_similar_users(spark.createDataFrame(rows, "user_id long, item_id long, rating double, ts long"))
    got = {r.item_id: r.score for r in c.filter("user_id = 1").collect()}
    assert set(got) == {12, 13} and got[12] > got[13]


def test_top_k_ties_by_id(spark):
    df = spark.createDataFrame([(0, 3, 2), (0, 1, 2), (0, 2, 1)], "w int, movie int, score int")
    assert [r.movie for r in ranking.top_k(df, ["w"], 2, F.desc("score"), F.asc("movie")).orderBy("rank").collect()] == [1, 3]


def test_quota_merge_fills_the_gap(spark):
    rows = [(1, i, 1.0 - i / 10, "a") for i in range(3)] + [(1, 0, 0.95, "b"), (1, 7, 0.9, "b"), (1, 8, 0.2, "b"), (2, 5, 0.5, "b")]
    got = recall.quota_merge(spark.createDataFrame(rows, "request_id long, item_id long, score double, channel string"), [("a", 2), ("b", 1)], 4).collect()
    assert [r.item_id for r in sorted(got, key=lambda r: (r.request_id, r.rank))] == [0, 1, 7, 2, 5]


def test_quota_slots_round_half_up():
    assert recall.quota_slots([("x", 0.45), ("y", 0.125)], "z", 20) == [("x", 9), ("y", 3), ("z", 8)]


def test_event_weights(spark):
    rows = [("order", 0, 8), ("like", 0, 3), ("click", 0, 2), ("view", 30_000, 1), ("view", 29_999, 0), ("dwell", 10_000, 1), ("error", 99_999, 0)]
    df = spark.createDataFrame(rows, "event_type string, watch_ms long, want long").withColumn("w", E.engagement_weight())
    assert all(r.w == r.want for r in df.collect())


def test_k_core_is_stable(spark, ratings):
    left = recall.k_core(ratings, 2, 2)
    for key in ("item_id", "user_id"):
        assert left.groupBy(key).count().filter("count < 2").count() == 0


def test_item_bias_is_the_loop(spark):
    e = spark.createDataFrame([(1, 5, "b", 3), (1, 4, "a", 1), (2, 1, "c", 0)], "movie_id int, ts_ms long, event_id string, label int")
    got = {r.movie_id: r.bias for r in folds.item_bias(e, F.col("label")).collect()}
    b = 0.0
    for t in (1 / 3, 1.0):
        b += 0.08 * (t - 1 / (1 + math.exp(-b)) - 0.001 * b)
    assert abs(got[1] - b) < 1e-12


def test_fnv_known_values(spark):
    def want(x):
        h = 0xCBF29CE484222325
        for c in x.encode():
            h = (h ^ c) * 0x100000001B3 % 2**64
        for f in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ h >> 33) * f % 2**64
        h ^= h >> 33
        return h - 2**64 if h >= 2**63 else h

    words = ["", "a", "foobar", "é" * 40]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", folds.fnv1a_mixed(F.col("w")).alias("h"))
    assert {r.w: r.h for r in df.collect()} == {w: want(w) for w in words}


def test_vector_search_against_brute_force(spark, monkeypatch):
    """Exact search in blocks and broadcast, with what a query skips; few, narrow and repeated vectors; empty tables."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(90)] + [(500, [1.0, 2.0]), (501, [0.0] * 5), (502, [0.0] * 5)]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    q = v.filter("id % 10 = 0 and id < 90").select(F.col("id").alias("query_id"), "vec").withColumn("skip", F.array(F.col("query_id") + 1))
    data = {i: np.array(x) for i, x in rows if len(x) == 5}
    want = {i: sorted((-float(data[i] @ x), j) for j, x in data.items() if j not in (i, i + 1))[:4] for i in range(0, 90, 10)}
    for most, block, chunk in ((4096, 4096, 16_384), (3, 4, 20)):
        for name, value in (("BROADCAST_QUERIES", most), ("QUERY_BLOCK", block), ("CHUNK", chunk)):
            monkeypatch.setattr(vectors, name, value)
        got: dict = {}
        for r in vectors.exact_top_k(v, q, 4, skip="skip").orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((-r.score, r.id))
        assert got == want
    assert vectors.exact_top_k(v, q.limit(0), 4).count() == 0 and vectors.lsh_top_k(v.limit(0), q, 5, 4).count() == 0
    assert vectors.lsh_top_k(v, q, 5, 4).count() == 36


def test_ranks_over_ranges(spark):
    """Ranks of one group of all rows, and of a few, as plain numbering has them; ties by id, null groups."""
    rows = [(i, i * 7919 % 13, None if i % 4 == 3 else i % 4) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, x long, g long")
    got = {r.id: r["rank"] for r in ranking.placed(df, F.desc("x"), F.asc("id")).collect()}
    assert got == {i: k + 1 for k, (i, x, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    groups: dict = {}
    for i, x, g in sorted(rows, key=lambda r: (r[1], -r[0])):
        groups.setdefault(g, []).append(i)
    got = {r.id: r.n for r in ranking.placed(df, F.asc("x"), F.desc("id"), by=("g",), name="n").collect()}
    assert got == {i: k + 1 for own in groups.values() for k, i in enumerate(own)} and ranking.placed(df.limit(0), F.asc("x")).count() == 0


def test_k_core_of_a_long_chain(spark):
    """A chain that hangs on a core of two users and two items falls away one link a round, over 50 rounds long."""
    core = [(u, i) for u in (-1, -2) for i in (0, -1)]
    chain = [(u, i) for u in range(52) for i in (u, u + 1)]
    left = recall.k_core(spark.createDataFrame(core + chain, "user_id long, item_id long").coalesce(1), 2, 2)
    assert sorted((r.user_id, r.item_id) for r in left.collect()) == sorted(core)


def test_preferences(spark):
    rows = [(1, " Drama", 1.0), (1, "drama ", 2.0), (1, " ", 3.0), (1, None, 3.0), (1, "War", float("nan")), (1, "War", float("inf")), (1, "War", 0.0), (1, "x", None)]
    got = recall.preferences(spark.createDataFrame(rows, "user_id long, name string, score double"), ["user_id"]).collect()
    assert [tuple(r) for r in got] == [(1, "drama", 2.0)]


def test_ranked_list_cursor(spark):
    kind = "l array<struct<score:double,item_id:long>>, a struct<score:double,item_id:long>"
    df = spark.createDataFrame([([(3.0, 1), (2.0, 4), (2.0, 7), (1.0, 2)], (2.0, 4)), ([(1.0, 1)], (1.0, 1)), ([], (1.0, 1))], kind)
    got = [([x.item_id for x in r.page], r.has_more) for r in ranking.cursor_page(df, "l", "a", 1).collect()]
    assert got == [([7], True), ([], False), ([], False)]
    with pytest.raises(Exception, match="out of order"):
        ranking.cursor_page(spark.createDataFrame([([(1.0, 1), (2.0, 4)], (2.0, 4))], kind), "l", "a", 1).collect()


def test_beta_draws(spark):
    df = spark.range(20_000).withColumn("d", folds.beta_draw(F.col("id"), F.lit(3.0), F.lit(5.0)))
    r = df.agg(F.avg("d").alias("m"), F.var_samp("d").alias("v"), F.min("d").alias("lo"), F.max("d").alias("hi")).first()
    assert abs(r.m - 3 / 8) < 0.005 and abs(r.v - 15 / (64 * 9)) < 0.002 and 0 < r.lo < r.hi < 1
    assert df.orderBy("id").limit(3).collect() == spark.range(3).withColumn("d", folds.beta_draw(F.col("id"), F.lit(3.0), F.lit(5.0))).orderBy("id").collect()


def _mixed(x):
    h = 0xCBF29CE484222325
    for c in x.encode():
        h = (h ^ c) * 0x100000001B3 % 2**64
    for f in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ h >> 33) * f % 2**64
    return h ^ h >> 33


def test_ring_and_slots_against_brute_force(spark, sf):
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    ring = sorted((signed(_mixed(f"v{v}:{s}")), s) for s in range(16) for v in range(150))
    events = [r.event_id for r in spark.read.parquet(f"{sf}/events.parquet").select("event_id").collect()]
    want: dict = {}
    for e in events:
        h = signed(_mixed(f"evt-{e}"))
        shard = next((s for p, s in ring if p >= h), ring[0][1])
        want[shard] = want.get(shard, 0) + 1
    assert {r.shard: r.n for r in QUERIES["x22_x24_a29_ring_shards"](spark, sf).collect()} == {s: want.get(s, 0) for s in range(16)}
    for r in QUERIES["x23_experiment_slots"](spark, sf).collect():
        slot = _mixed(f"{r.user_id}:home") % 10_000
        assert (r.slot, r.variant) == (slot, "A" if slot < 3000 else "B" if slot < 6000 else "default")


def test_bootstrap_interval(spark, sf):
    """The resampled interval is about two standard errors to each side of the mean."""
    from cinderloom.sources import tables

    r = tables.ratings(spark, sf).join(tables.load(spark, sf, "customer").selectExpr("c_custkey user_id", "c_mktsegment segment"), "user_id")
    want = {x.segment: x for x in r.groupBy("segment").agg(F.avg("rating").alias("m"), (F.stddev_samp("rating") / F.sqrt(F.count(F.lit(1)))).alias("se")).collect()}
    for x in QUERIES["a16_bootstrap"](spark, sf).collect():
        w = want[x.segment]
        assert abs((x.low + x.high) / 2 - w.m) < 0.6 * w.se and 3 < (x.high - x.low) / w.se < 5


def test_thompson_by_hand(spark, sf):
    """The query's draws and bonuses from counts, each draw made again for one row alone with whole numbers."""
    mask = 2**64 - 1

    def uniform(key, purpose):
        x = (key * 0x9E3779B97F4A7C15 + purpose * 0x632BE59BD9B4E019 + 42) & mask
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor & mask
        return ((x ^ x >> 31) >> 11) * 2.0**-53 + 2.0**-54

    def gamma(key, shape, place):
        d = shape - 1 / 3
        while True:
            u, r, t = (uniform(key, place + i) for i in range(3))
            x = math.sqrt(-2 * math.log(r)) * math.cos(2 * math.pi * t)
            v = (1 + x / math.sqrt(9 * d)) ** 3
            if v > 0 and math.log(u) < 0.5 * x * x + d - d * v + d * math.log(v):
                return d * v
            place += 3

    from cinderloom.sources import tables

    counts: dict = {}
    for e in tables.events(spark, sf).filter("movie_id > 0").collect():
        n = counts.setdefault(e.movie_id, [0, 0])
        n[0] += 1
        n[1] += e.event_type == "click"
    got = {r.item_id: r for r in QUERIES["x12_thompson"](spark, sf).collect()}
    assert got.keys() == counts.keys()
    for item, (n, clicks) in counts.items():
        a, b = 1 + clicks, 1 + n - clicks
        x, y = gamma(item, a, 0), gamma(item, b, 1 << 20)
        assert abs(got[item].sampled - x / (x + y)) < 1e-9 and abs(got[item].bonus - min(0.25, abs(x / (x + y) - a / (a + b)))) < 1e-9


def test_bootstrap_draws(spark):
    """Every resample has as many draws as rows, over one block or many; one row is always itself; counts spread like draws with replacement; reruns agree."""
    rows = [("a", i, float(i % 9)) for i in range(900)] + [("one", 1, 5.0), (None, 1, 2.0), (None, 2, 4.0)]
    df = spark.createDataFrame(rows, "g string, id long, x double")
    size = {"a": 900, "one": 1, None: 2}
    for block in (40, 1 << 16):
        made = statistics.bootstrap_means(df.repartition(3), "g", ["id"], "x", 60, 7, block)
        got = sorted(map(tuple, made.collect()), key=repr)
        assert len(got) == 180 and all(d == size[g] for g, _, d, _ in got) and all(m == 5.0 for g, _, _, m in got if g == "one")
        assert got == sorted(map(tuple, statistics.bootstrap_means(df.coalesce(1), "g", ["id"], "x", 60, 7, block).collect()), key=repr)
        means = np.array([m for g, _, _, m in got if g == "a"])
        spread = np.std([i % 9 for i in range(900)]) / 30
        assert abs(means.mean() - np.mean([i % 9 for i in range(900)])) < 0.5 * spread and 0.7 < means.std() / spread < 1.35


def test_quantiles_of_groups(spark):
    """Interpolated between the neighbours as numpy does; ties, one row, nulls, null groups."""
    rng = np.random.default_rng(2)
    groups = {"a": rng.integers(0, 50, 333).tolist(), "b": [3], None: rng.random(10).tolist()}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("gone", None)]
    shares = {"low": 0.025, "mid": 0.5, "top": 1.0, "least": 0.0}
    got = {r.g: r for r in statistics.quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", shares).collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        assert all(abs(got[g][n] - np.quantile(xs, q)) < 1e-9 for n, q in shares.items())
    got = {r.g: r for r in statistics.nearest_ranks(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", shares).collect()}
    for g, xs in groups.items():
        assert all(got[g][n] == sorted(xs)[max(1, math.ceil(q * len(xs))) - 1] for n, q in shares.items())


@pytest.mark.parametrize("block", [7, 4096])
def test_neighbours_in_blocks(spark, monkeypatch, block):
    """Users in many blocks and strips, an item that all rated, ties at the cut, users that share nothing: all pairs by hand."""
    monkeypatch.setattr(recall, "STRIP", 3)
    monkeypatch.setattr(recall, "PRODUCTS", 10)
    rng = np.random.default_rng(1)
    rated = {(u, 0): 3.0 for u in range(40)} | {(int(u), int(i)): float(rng.integers(1, 11)) / 2 for u, i in zip(rng.integers(0, 40, 150), rng.integers(1, 30, 150), strict=True)} | {(99, 77): 4.0, (98, 78): 2.0}
    df = spark.createDataFrame([(u, i, r) for (u, i), r in rated.items()], "user_id long, item_id long, rating double")
    got: dict = {}
    for r in recall.neighbours(df, 5, block).orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append((-r.sim, r.other_id))
    users = sorted({u for u, _ in rated})
    vec = {u: {i: r for (v, i), r in rated.items() if v == u} for u in users}
    norm = {u: math.sqrt(sum(r * r for r in vec[u].values())) for u in users}
    for u in users:
        sims = [(-round(sum(r * vec[v].get(i, 0) for i, r in vec[u].items()) / (norm[u] * norm[v]), 9), v) for v in users if v != u]
        assert got.get(u, []) == sorted(x for x in sims if x[0] < 0)[:5]



def test_file_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,title,year,genres\n1,A,1999,Drama|War\n2,B,2000\nx\n")
    got = {r.id: r.genres for r in files.movies_csv(spark, str(tmp_path / "m.csv")).collect()}
    assert got == {1: ["Drama", "War"], 2: []}
    (tmp_path / "v.csv").write_text("1,0.5 1e1\n2,0.1 NaN\n3\n")
    assert [(r.id, r.vec) for r in files.embeddings_text(spark, str(tmp_path / "v.csv")).collect()] == [(1, [0.5, 10.0])]
    (tmp_path / "e.json").write_text('{"event_id":"a","user_id":"user_12","item_id":"movie_3","event_type":" Click ","timestamp_ms":5}\n\n{bad\n')
    r = files.events_ndjson(spark, str(tmp_path / "e.json")).filter("event_id is not null").collect()
    assert [(x.user_id, x.movie_id, x.event_type, x.ts_ms) for x in r] == [(12, 3, "click", 5)]


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v
    return sorted((tuple(str(norm(r[i])) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(SQL[name])
    want_columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(want_columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(want_columns, want)


def test_item_vectors_from_sequences(spark, sf):
    """One vector of 16 numbers with eight decimals for each item that someone liked, the same at every run of one sequence order."""
    from cinderloom.sources import tables

    got = {r.item_id: r.vector.split(" ") for r in QUERIES["v15_word2vec"](spark, sf).collect()}
    liked = {r.item_id for r in tables.ratings(spark, sf).filter("rating >= 3.5").select("item_id").distinct().collect()}
    assert got.keys() == liked and all(len(v) == 16 and all(len(x.split(".")[1]) == 8 for x in v) for v in got.values())
    assert len({tuple(v) for v in got.values()}) == len(got)
