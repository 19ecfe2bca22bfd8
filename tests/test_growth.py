"""Operators that must not grow faster than their input: what they shuffle and hold, and their results by hand."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderloom.operators import products, recall, skipgram, vectors


def written_to_shuffles(spark, work) -> tuple[int, int]:
    """Rows and bytes that the stages of ``work`` write to shuffles."""

    def total():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return np.array([(s.shuffleWriteRecords(), s.shuffleWriteBytes()) for s in (stages.apply(i) for i in range(stages.size()))]).sum(axis=0)

    before = total()
    work()
    rows, size = total() - before
    return int(rows), int(size)


def rated(spark, copies, users=300, items=400, each=12):
    rng = np.random.default_rng(5)
    pairs = sorted({(u, int(i)) for u in range(users) for i in rng.integers(0, items, each)})
    rows = [(u + c * users, i + c * items, float(1 + (u * 7 + i) % 10) / 2, u % 50) for c in range(copies) for u, i in pairs]
    return spark.createDataFrame(rows, "user_id long, item_id long, rating double, ts long").repartition(4)


def test_neighbours_shuffle_in_proportion(spark):
    """five copies side by side shuffle about five times as much, not each block against each."""
    one, five = rated(spark, 1), rated(spark, 5)
    a = written_to_shuffles(spark, lambda: recall.neighbours(one, 5, 400).count())[0]
    b = written_to_shuffles(spark, lambda: recall.neighbours(five, 5, 400).count())[0]
    assert b < 7 * a


def test_candidates_of_similar_users_are_no_rows(spark):
    """the ratings of neighbours are summed in tasks; a shuffle has fewer rows than they are."""
    r = rated(spark, 1)
    n = recall.neighbours(r, 50).count()
    rows = written_to_shuffles(spark, lambda: recall.from_similar_users(r, best=20).count())[0]
    assert rows < n * 12
    every = {(x.user_id, x.item_id): (x.score, x.n_neighbours) for x in recall.from_similar_users(r).collect()}
    best = {(x.user_id, x.item_id): (x.score, x.n_neighbours) for x in recall.from_similar_users(r, best=20).collect()}
    seen = {(x.user_id, x.item_id) for x in r.collect()}
    assert not seen & every.keys()
    for u in (0, 17, 299):
        want = sorted((-s, i) for (v, i), (s, _) in every.items() if v == u)[:20]
        assert [(-s, i) for s, i in want] == sorted(((best[v, i][0], i) for v, i in best if v == u), key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize("limits", [{}, {"block": 40, "cell": 50, "strip": 2, "products": 7}])
def test_best_products_by_hand(spark, limits):
    """Many blocks and parts, a row of very many products, ties at the cut, columns that the other side lacks."""
    rng = np.random.default_rng(2)
    entries = {(0, c): 1 for c in range(30)} | {(int(r), int(c)): 1 for r, c in zip(rng.integers(0, 60, 300), rng.integers(0, 40, 300), strict=True)}
    left = spark.createDataFrame([(r, c, 1, 1) for r, c in entries], "row long, col long, w int, a int")
    right = spark.createDataFrame([(c, r, 1, 1) for r, c in entries if c != 39], "col long, id long, v int, b int")
    got: dict = {}
    for x in products.best_products(left, right, 4, **limits).collect():
        got.setdefault(x.row, []).append((-x.n, x.id))
    cols = {r: {c for q, c in entries if q == r and c != 39} for r in {r for r, _ in entries}}
    for r, own in cols.items():
        want = sorted((-len(own & other), s) for s, other in cols.items() if s != r and own & other)[:4]
        assert sorted(got.get(r, []))[:4] == want


def test_similar_items_shuffle_no_pairs(spark):
    """of 200 users x 40 items come 156,000 pairs; fewer rows than half of them are shuffled. Chosen items alone give what they give among all."""
    rng = np.random.default_rng(3)
    r = spark.createDataFrame([(u, int(i), 1.0, 0) for u in range(200) for i in rng.permutation(900)[:40]], "user_id long, item_id long, rating double, ts long")
    assert written_to_shuffles(spark, lambda: recall.similar_items(r, 5).count())[0] < 156_000
    every = {(x.item_id, x.other_id, x.n, x.rank) for x in recall.similar_items(r, 5).collect()}
    some = spark.range(0, 900, 9).select(F.col("id").alias("item_id"))
    assert {(x.item_id, x.other_id, x.n, x.rank) for x in recall.similar_items(r, 5, of=some).collect()} == {x for x in every if x[0] % 9 == 0}
    assert all(x.item_id % 9 == 0 == x.other_id % 9 for x in recall.similar_items(r, 5, of=some, among=some).collect())


def test_max_sim_by_matrices(spark, monkeypatch):
    """bags of several widths and sizes, empty ones, broadcast and in blocks, some scores at a time."""
    rng = np.random.default_rng(4)
    bags = {i: [rng.integers(-3, 4, 2 if i % 11 == 0 else 3).astype(float).tolist() for _ in range(i % 4)] for i in range(60)}
    b = spark.createDataFrame(list(bags.items()), "id long, bag array<array<double>>")
    q = b.filter("id % 7 = 1").select(F.col("id").alias("query_id"), F.col("bag").alias("qbag"))

    def score(x, y):
        best = [max((float(np.dot(s, t)) for t in y if len(s) == len(t)), default=-math.inf) for s in x]
        return sum(best) if best else -math.inf

    want = {i: sorted((-score(bags[i], y), j) for j, y in bags.items() if j != i and score(bags[i], y) > -math.inf)[:3] for i in range(1, 60, 7)}
    for most in (4096, 3):
        for name, value in (("BROADCAST_QUERIES", most), ("QUERY_BLOCK", 4), ("CHUNK", 20), ("CELLS", 64)):
            monkeypatch.setattr(vectors, name, value)
        got: dict = {i: [] for i in want}
        for x in vectors.max_sim_top_k(q, b, 3).orderBy("query_id", "rank").collect():
            got[x.query_id].append((-x.score, x.id))
        assert got == want


def test_exact_search_holds_few_scores(spark, monkeypatch):
    """Scores are held CELLS at a time, with the same rows as at once."""
    rng = np.random.default_rng(6)
    v = spark.createDataFrame([(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(200)], "id long, vec array<double>")
    q = v.filter("id % 5 = 0").select(F.col("id").alias("query_id"), "vec").withColumn("skip", F.array(F.col("query_id") + 1, F.col("query_id") + 2))
    at_once = {tuple(r) for r in vectors.exact_top_k(v, q, 4, skip="skip").collect()}
    monkeypatch.setattr(vectors, "CELLS", 300)
    assert all((s.stop - s.start) * 100 <= 300 for s in vectors._strips(40, 100))
    assert {tuple(r) for r in vectors.exact_top_k(v, q, 4, skip="skip").collect()} == at_once


@pytest.mark.parametrize(
    "name, most",
    [("c12_fallback_pool", 20_000), ("c2_u3_u5_u8_genre_history", 15_000), ("v14_vector_fallback", 15_000), ("v14_user_vectors", 10_000), ("e2_e6_a15_w23_policy_evaluation", 20_000), ("k6_evaluation_csv", 20_000),
     ("e2_candidate_pools", 15_000), ("u2_c8_w2_w3_quota_merge", 20_000), ("x33_taste_profile", 10_000)],
)
def test_rows_shuffled(spark, sf, name, most):
    """rows written to shuffles on the smallest tables, which were half as many again or more."""
    from cinderloom.plans import QUERIES

    assert written_to_shuffles(spark, lambda: QUERIES[name](spark, sf).count())[0] < most


def test_genre_histories_in_either_way(spark, sf, monkeypatch):
    """Lists in one row and, for very many genres, by a join give the same."""
    from cinderloom.sources import tables

    r, m = tables.ratings(spark, sf), tables.movies(spark, sf)
    best = m.select(F.explode("genres").alias("genre"), "item_id").distinct().filter("item_id % 5 = 0")
    rows = lambda: {(x.user_id, frozenset(x.seen), frozenset(x.own)) for x in recall.genre_histories(r, m, best, F.col("rating") >= 4.5).collect()}
    few = rows()
    monkeypatch.setattr(recall, "FEW_GENRES", 0)
    assert rows() == few and any(own for _, _, own in few)


def test_means_of_several_widths(spark):
    rows = spark.createDataFrame([(1, 1.0, [1.0, 2.0]), (1, 2.0, [4.0]), (2, 1.0, [3.0]), (3, 1.0, [])], "u long, w double, vec array<double>")
    got = {(x.u, x.d): x.x for x in vectors.weighted_means(rows, rows, "u").collect()}
    assert got == {(1, 0): 3.0, (1, 1): 2.0, (2, 0): 3.0}


def test_content_overlap_shuffles_ratings_once(spark, sf):
    """the ratings of the smallest tables, joined and grouped by user once; 11,450 rows before."""
    from cinderloom.plans import QUERIES

    assert written_to_shuffles(spark, lambda: QUERIES["x17_content_overlap"](spark, sf).count())[0] < 8_000


def test_k_core_rounds_shuffle_what_is_dropped(spark):
    """a core of 1,600 ratings and a chain that loses a link a round: the ratings are not shuffled again in each of the rounds (over 40,000 rows before)."""
    core = [(u, i) for u in range(100, 140) for i in range(100, 140)]
    chain = [(u, i) for u in range(14) for i in (u, u + 1)] + [(100, 0)]
    r = spark.createDataFrame(core + chain + [(None, 100), (100, None)], "user_id long, item_id long").coalesce(1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left: list = []
        assert written_to_shuffles(spark, lambda: left.extend(tuple(x) for x in recall.k_core(r, 2, 2).collect()))[0] < 10_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(left) == sorted(core)


def test_k_core_with_many_dropped(spark, monkeypatch):
    """where the dropped ones are too many to go to all tasks, the same is left; repeated ratings count each time."""
    rng = np.random.default_rng(7)
    pairs = list(zip(rng.integers(0, 60, 400).tolist(), rng.integers(0, 80, 400).tolist(), range(400), strict=True))
    r = spark.createDataFrame(pairs, "user_id long, item_id long, ts long")
    few = {tuple(x) for x in recall.k_core(r, 4, 4).collect()}
    want = pairs
    while True:
        fewer = [p for p in want if sum(q[1] == p[1] for q in want) >= 4]
        fewer = [p for p in fewer if sum(q[0] == p[0] for q in fewer) >= 4]
        if fewer == want:
            break
        want = fewer
    assert few == set(want) and 0 < len(want) < 400
    monkeypatch.setattr(recall, "FEW_GONE", 0)
    assert {tuple(x) for x in recall.k_core(r, 4, 4).collect()} == few
    assert recall.k_core(r, 100, 100).count() == recall.k_core(r.limit(0), 2, 2).count() == 0


def spread(spark, users=2000, items=2600, each=12):
    """Ratings where neighbouring ids share nothing, so that each block meets most items."""
    rng = np.random.default_rng(11)
    pairs = sorted({(u, int(i)) for u in range(users) for i in rng.integers(0, items, each)})
    return spark.createDataFrame([(u * 977, i * 31, float(1 + (u * 7 + i) % 10) / 2, u % 50) for u, i in pairs], "user_id long, item_id long, rating double, ts long").repartition(4)


def test_similar_users_shuffle_few_bytes(spark):
    """a rating goes packed to the blocks that need it, neighbours as lists: bytes a rating (364 and 136 before)."""
    r = spread(spark).cache()
    n = r.count()
    assert written_to_shuffles(spark, lambda: recall.from_similar_users(r, best=20).count())[1] < 150 * n
    assert written_to_shuffles(spark, lambda: recall.neighbours(r, 50).count())[1] < 80 * n


def test_similar_items_shuffle_few_bytes(spark):
    """a user's items go packed to the blocks that need them (44 bytes a rating before)."""
    r = spread(spark).cache()
    n = r.count()
    assert written_to_shuffles(spark, lambda: recall.similar_items(r, 5).count())[1] < 25 * n


@pytest.mark.parametrize("name, most", [("c5_j4_a6_user_similarity", 10_000), ("j3_a5_w7_neighbours", 10_000), ("c6_w9_recent_history", 10_000), ("a2_j2_w4_similar_items", 10_000)])
def test_rows_shuffled_for_similarity(spark, sf, name, most):
    """Rows written to shuffles on the smallest tables: 56,786, 30,032, 41,083 and 23,282 before."""
    from cinderloom.plans import QUERIES

    assert written_to_shuffles(spark, lambda: QUERIES[name](spark, sf).count())[0] < most


@pytest.mark.parametrize("limits", [{}, {"block": 40, "cell": 50, "strip": 2, "products": 7}])
def test_best_of_lists_by_hand(spark, limits, monkeypatch):
    """Ids among themselves and rows with a column of their own that is left out; many blocks and parts, ids below zero and far apart, values that are no short numbers, columns that no row has or no list."""
    monkeypatch.setattr(products, "LEAST", 100)
    rng = np.random.default_rng(12)
    far = lambda x: (x - 30) * 2**40 if x % 7 == 0 else x - 30
    entries = {(far(int(i)), int(c)): float(rng.integers(1, 1000)) for i, c in zip(rng.integers(0, 60, 400), rng.integers(0, 45, 400), strict=True)}
    ids = {i for i, _ in entries}
    rated = {i: {c: v for (j, c), v in entries.items() if j == i} for i in ids}
    lists = spark.createDataFrame([(c, [i for i, d in entries if d == c], [v for (_, d), v in entries.items() if d == c]) for c in {c for _, c in entries}], "col long, ids array<long>, v array<float>")
    lists = lists.withColumn("b", F.transform("ids", lambda i: i.cast("double") / 3))
    got = {x.row: [(y.low, y.id, y.n) for y in x.best] for x in products.in_order(products.best_of_lists(lists, 4, **limits), 4).collect()}
    dot = {i: sorted((-sum(v * rated[j][c] for c, v in rated[i].items() if c in rated[j]), j, len(rated[i].keys() & rated[j].keys())) for j in ids if j != i and rated[i].keys() & rated[j].keys()) for i in ids}
    assert got == {i: x[:4] for i, x in dot.items() if x}
    top = products.best_of_lists(lists, 1, score=lambda x, a, b: x * 0 + 1 + (a + b > 0), near=1e-8, **limits).collect()
    assert all(max(x.scores) == 1 + (max(j for _, j, _ in dot[x.row]) + x.row > 0) for x in top)

    left = {r: {int(c): int(rng.integers(1, 9)) for c in rng.integers(0, 60, 6)} for r in range(40)}
    rows = spark.createDataFrame([(r, list(x), list(x.values())) for r, x in left.items()], "row long, col array<long>, w array<long>")
    got = {x.row: [(y.low, y.id, y.n) for y in x.best] for x in products.in_order(products.best_of_lists(lists, 3, rows, apart=False, never=True, **limits), 3).collect()}
    want = {}
    for r, x in left.items():
        sums: dict = {}
        for c, w in x.items():
            for i in ids:
                if c in rated[i] and r not in rated[i]:
                    s, n = sums.get(i, (0, 0))
                    sums[i] = s - w * rated[i][c], n + 1
        if sums:
            want[r] = sorted((s, i, n) for i, (s, n) in sums.items())[:3]
    assert got == want


def test_similar_users_without_ids_or_ratings(spark):
    """Rows without a user or an item are nobody's; one without a rating adds nothing, and is rated all the same."""
    rows = [(1, 10, 4.0, 0), (1, 12, None, 0), (2, 10, 3.0, 0), (2, 12, 4.0, 0), (2, 13, 2.0, 0), (None, 10, 5.0, 0), (3, None, 5.0, 0), (4, None, 5.0, 0)]
    r = spark.createDataFrame(rows, "user_id long, item_id long, rating double, ts long")
    assert [(x.user_id, x.other_id) for x in recall.neighbours(r).orderBy("user_id").collect()] == [(1, 2), (2, 1)]
    assert [(x.user_id, x.item_id) for x in recall.from_similar_users(r).collect()] == [(1, 13)]
    assert {(x.item_id, x.other_id, x.n) for x in recall.similar_items(r).filter("item_id = 10").collect()} == {(10, 12, 2), (10, 13, 1)}


def test_huffman_tree_by_hand():
    """a tree over counts, not items, is as short as one built item by item, and its codes differ."""
    rng = np.random.default_rng(8)
    for case in range(60):
        counts = sorted(rng.integers(1, 9 if case % 2 else 2000, int(rng.integers(1, 60))).tolist())
        rows = skipgram.tree([(c, counts.count(c)) for c in sorted(set(counts))])
        codes = []
        for x in range(len(counts)):
            code = ""
            while x != 2 * len(counts) - 2:
                (x,), (c,) = skipgram._parents(rows, np.array([x]))
                code += str(c)
            codes.append(code[::-1])
        heap, want = counts[:], 0
        while len(heap) > 1:
            joined = heapq.heappop(heap) + heapq.heappop(heap)
            want += joined
            heapq.heappush(heap, joined)
        assert sum(c * len(code) for c, code in zip(counts, codes, strict=True)) == want and len(set(codes)) == len(counts)


def test_item_vectors_tell_groups_apart(spark):
    """over several blocks, items that go together are near; an item without neighbours has a vector too."""
    rng = np.random.default_rng(9)
    rows = [(u, int(10 * (u % 2) + i), t) for u in range(240) for t, i in enumerate(rng.permutation(10)[:8])] + [(999, 5000, 0)]
    got = skipgram.item_vectors(spark.createDataFrame(rows, "user_id long, item_id long, ts long"), 16, 5, 5, 0.1, 42, block=200)
    v = {r.item_id: np.array(r.vector) / np.linalg.norm(r.vector) for r in got.collect()}
    assert v.keys() == {i for _, i, _ in rows} and all(len(x) == 16 for x in v.values())
    mean = lambda a, b: np.mean([v[i] @ v[j] for i in a for j in b if i != j])
    assert mean(range(10), range(10)) > mean(range(10), range(10, 20)) + 0.3


def test_word2vec_reruns_agree(spark, sf):
    """tasks do not step weights that they share, so two runs give the same numbers."""
    from cinderloom.plans import QUERIES

    once, again = ({tuple(r) for r in QUERIES["v15_word2vec"](spark, sf).collect()} for _ in range(2))
    assert once == again


def test_item_vectors_learn_as_much_in_many_blocks(spark):
    """items of 20 groups among as many strange ones, in one block and in 40: steps of blocks are added up, where means of 40 blocks learn a fortieth."""
    rng = np.random.default_rng(13)
    rows = [(u, int(10 * (u % 20) + i) if rng.random() < 0.5 else int(rng.integers(0, 200)), t) for u in range(2400) for t, i in enumerate(rng.integers(0, 10, 12))]
    df = spark.createDataFrame(rows, "user_id long, item_id long, ts long").cache()

    def near(block: int) -> float:
        got = {r.item_id: np.array(r.vector) for r in skipgram.item_vectors(df, 16, 5, 10, 0.025, 42, block=block).collect()}
        v = np.array([got[i] / np.linalg.norm(got[i]) for i in range(200)])
        likeness = v @ v.T - 9 * np.eye(200)
        return float((np.argsort(-likeness, axis=1)[:, :5] // 10 == np.arange(200)[:, None] // 10).mean())

    assert near(720) > 0.6
