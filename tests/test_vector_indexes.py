"""Both vector indexes against the exact search: recall, what they read, and the invariants of maintenance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderloom.operators import inverted_file as I
from cinderloom.operators import vectors as V
from cinderloom.plans import recall_and_rank as P
from cinderloom.sources import tables


def table(spark, x, first=0):
    return spark.createDataFrame([(i + first, y) for i, y in enumerate(np.asarray(x).tolist())], "id long, vec array<double>")


def queries(v):
    return v.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vec")


def pairs(df):
    return {(r.query_id, r.id) for r in df.collect()}


@pytest.fixture(scope="module")
def mixture(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 64))[rng.integers(60, size=6000)] + 0.4 * rng.standard_normal((6000, 64))
    return table(spark, x / np.linalg.norm(x, axis=1, keepdims=True)).cache()


@pytest.fixture(scope="module")
def given(spark):
    return tables.vectors(spark, "/root/testdata/sf0.1").cache()


def test_hashing_on_a_mixture(mixture):
    """Recall of 0.9, a fifth of the rows met at most, and no query left to the scan."""
    q = queries(mixture)
    found, state = V.lsh_search(mixture, q, 64, 10)
    exact, n = pairs(V.exact_top_k(mixture, q, 10)), mixture.count()
    rows = state.collect()
    assert len(pairs(found) & exact) >= 0.9 * len(exact) and found.count() == len(exact)
    assert max(r.touched for r in rows) <= n / 5 and sum(not r.settled for r in rows) <= 0.05 * len(rows)


def test_hashing_knows_where_it_fails(given):
    """Vectors without clusters: most queries are not settled, are searched exactly, and recall holds."""
    q = queries(given)
    found, state = V.lsh_search(given, q, 64, 10)
    exact = pairs(V.exact_top_k(given, q, 10))
    assert len(pairs(found) & exact) >= 0.9 * len(exact) and found.count() == len(exact)
    assert state.filter("not settled").count() >= 0.5 * q.count() and state.filter(f"touched > {given.count() // 5}").count() == 0


def test_probability_of_meeting(spark):
    """The share of vectors at a cosine that are in probed buckets is what sure_to_meet() says."""
    rng = np.random.default_rng(11)
    q = rng.standard_normal(16)
    q /= np.linalg.norm(q)
    x = rng.standard_normal((4000, 16))
    x -= np.outer(x @ q, q)
    x = 0.8 * q + 0.6 * x / np.linalg.norm(x, axis=1, keepdims=True)
    one = spark.createDataFrame([(-1, q.tolist())], "query_id long, vec array<double>")
    met = V.buckets(table(spark, x), 16, 2).join(V.probed_buckets(one, 16, 2, 9), "key").select("id").distinct().count()
    said = one.select(V.sure_to_meet(16, 2, 9)("vec", F.lit(0.8)).alias("p")).first().p
    assert abs(met / 4000 - said) < 0.06 and 0.05 < said < 0.95


def test_inverted_file_on_given_vectors(given):
    """The registered query's parameters: recall of 0.9 without reading all clusters, though the vectors have none."""
    q = queries(given)
    index = I.build(given, P.FINE)
    exact = pairs(V.exact_top_k(given, q, 10))
    assert len(pairs(I.search(index, q, 10, P.PROBED)) & exact) >= 0.9 * len(exact)
    assert I.probed(index, q, 10, P.PROBED).groupBy("query_id").count().agg(F.max("count")).first()[0] <= 0.6 * index.centres.count()


def test_inverted_file_on_a_mixture(mixture):
    """Recall of 0.9 with a tenth of the clusters probed; more clusters until k are held; fewer rows than k."""
    q = queries(mixture)
    index = I.build(mixture)
    n = index.centres.count()
    exact = pairs(V.exact_top_k(mixture, q, 10))
    got = I.search(index, q, 10, n // 10)
    assert len(pairs(got) & exact) >= 0.9 * len(exact) and got.count() == len(exact)
    probed = I.probed(index, q, 10, n // 10).join(index.centres, ["cell", "cluster"]).groupBy("query_id").agg(F.count("n").alias("c"), F.sum("n").alias("n"))
    assert probed.filter(f"c > {n // 10}").count() == 0 and probed.agg(F.avg("n")).first()[0] < 0.2 * mixture.count()
    few = I.probed(index, q, 300, 1).join(index.centres, ["cell", "cluster"]).groupBy("query_id").agg(F.sum("n").alias("n"))
    assert few.filter("n <= 300").count() == 0
    plan = index.postings.filter(F.col("grp").isin([1, 2]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [grp" in plan


def check(index, rows, posting):
    """Every live vector has one main entry, no posting is over its bound, sizes are right."""
    alive = index.alive().collect()
    main = {r.id: r.vec for r in alive if r.main}
    assert sum(r.main for r in alive) == len(main) and {i: np.round(v, 9).tolist() for i, v in main.items()} == {i: np.round(v, 9).tolist() for i, v in rows.items()}
    sizes: dict = {}
    for r in alive:
        sizes.setdefault((r.cell, r.cluster), []).append(r.main)
    assert max(map(len, sizes.values())) <= posting
    assert {(r.cell, r.cluster): r.n for r in index.centres.collect() if r.n} == {k: sum(v) for k, v in sizes.items() if sum(v)}
    return sizes


def test_cells_and_equal_vectors(spark, monkeypatch):
    """More vectors than a cell holds, a third of them equal: cells and postings stay in their bounds."""
    monkeypatch.setattr(I, "CELL", 100)
    monkeypatch.setattr(I, "FAN", 4)
    rng = np.random.default_rng(3)
    x = np.concatenate((np.ones((400, 6)), rng.standard_normal((800, 6))))
    v = table(spark, x)
    index = I.build(v, posting=16)
    assert index.alive().filter("main").groupBy("cell").count().agg(F.max("count")).first()[0] <= 100
    check(index, dict(enumerate(x)), 16)
    assert {r.id for r in I.search(index, v.filter("id = 0").select(F.col("id").alias("query_id"), "vec"), 20, 100).collect()} != set()


def test_maintenance(spark):
    """Rounds of upserts and deletes: moved, new and gone vectors, splits, merges and a compaction; the search sees each state."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((8, 12)) * 5
    x = centres[rng.integers(8, size=600)] + rng.standard_normal((600, 12))
    rows = {i: y for i, y in enumerate(x)}
    index = I.build(table(spark, x), posting=32)
    check(index, rows, 32)
    for step in range(3):
        new = {int(i): centres[step] + rng.standard_normal(12) for i in [*rng.choice(600, 40, replace=False), *range(1000 + 100 * step, 1080 + 100 * step)]}
        gone = [int(i) for i in rng.choice(600, 120, replace=False) if int(i) not in new]
        up = spark.createDataFrame([(i, y.tolist()) for i, y in new.items()], "id long, vec array<double>")
        index = I.changed(index, up, spark.createDataFrame([(i,) for i in gone], "id long"))
        rows = {i: y for i, y in {**rows, **new}.items() if i not in gone}
        some = next(iter(new))
        near = I.search(index, up.filter(f"id = {some}").select((-F.col("id")).alias("query_id"), "vec"), 1, 40).first()
        assert near.id in rows and near.score >= float(new[some] @ new[some]) - 1e-6
        index, done = I.maintained(index, least=6)
        assert done["compacted"] and done["splits"] + done["merges"] > 0
        sizes = check(index, rows, 32)
        assert index.newest.count() == 0 and sum(sum(v) < 6 for v in sizes.values()) <= len(sizes) // 4
    again, done = I.maintained(index, least=1)
    assert not done["compacted"] and done["dead"] == 0 and again.postings.count() == index.postings.count()
