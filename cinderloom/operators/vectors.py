"""Vector search: exact, hyperplane hashing, Euclidean hashing, and multi-vector. The clustered index is in inverted_file."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderloom.functions.scores import dot
from cinderloom.operators.inverted_file import products
from cinderloom.operators.lineage import written
from cinderloom.operators.ranking import top_k

#: Planes of a table, tables, and the seed of their normals.
PLANES, TABLES, SEED = 16, 16, 42
#: Buckets of a table that a query probes, and the probability with which a settled query meets a vector as good as its k-th.
PROBES, SURE = 17, 0.9
#: Queries that are broadcast at most, queries in one block and vectors in one chunk beyond that.
BROADCAST_QUERIES, QUERY_BLOCK, CHUNK = 4096, 4096, 16_384

#: Scores that a task holds at once.
CELLS = 1 << 22


def _against(queries: DataFrame, vectors: DataFrame, prepare: Callable[[pd.DataFrame], object], work: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` of every query (query_id, ...), as ``prepare`` leaves them, and every row (id, ...) of ``vectors``, block by block.

    Up to BROADCAST_QUERIES queries are broadcast, and vectors are not shuffled. More are dealt to blocks and vectors
    to chunks; a task works one block against one chunk, so memory is bounded and nothing passes through the driver.
    """
    if (n := queries.limit(BROADCAST_QUERIES + 1).count()) <= BROADCAST_QUERIES:
        own = queries.toPandas()
        if not n:
            return vectors.sparkSession.createDataFrame([], schema)
        shared = vectors.sparkSession.sparkContext.broadcast(prepare(own))  # BROADCAST_QUERIES rows

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield work(shared.value, b)

        return vectors.mapInPandas(run, schema)

    n_blocks, n_chunks = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-vectors.count() // CHUNK))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).alias("block"), upto(n_chunks).alias("chunk"), *queries.columns)
    right = vectors.select(upto(n_blocks).alias("block"), F.pmod(F.xxhash64("id"), F.lit(n_chunks)).alias("chunk"), *vectors.columns)

    def both(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        return work(prepare(qs), vs) if len(qs) and len(vs) else pd.DataFrame()

    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(both, schema)


def _kept(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each row's best k finite scores and of what ties with the last."""
    m = min(k, score.shape[1])
    cut = np.partition(score, score.shape[1] - m, axis=1)[:, score.shape[1] - m]
    return np.nonzero((score >= cut[:, None] - 1e-6) & np.isfinite(score))


def _strips(n: int, width: int) -> Iterator[slice]:
    """Ranges of n rows of so many scores, CELLS at once."""
    step = max(1, CELLS // max(1, width))
    return (slice(i, min(n, i + step)) for i in range(0, n, step))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, skip: str | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the k highest inner products of each query, itself and the ids in its array ``skip`` left out; ties by id.

    Widths other than the first query's are left out. Each batch keeps the best k of a query and what ties with the last; queries meet it some at a time, so that CELLS scores are held.
    Queries are (query_id, vec).
    """

    def stacked(ids: pd.Series, rows: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok = rows.map(len).to_numpy() == width
        return ids.to_numpy()[ok], np.array(rows[ok].tolist()).reshape(int(ok.sum()), width), ok

    def prepare(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list]:
        ids, q, ok = stacked(f["query_id"], f["q"], len(f["q"].iloc[0]))
        return ids, q, [np.asarray(x, dtype=np.int64) for x in f["skip"][ok]]

    def best(own: tuple[np.ndarray, np.ndarray, list], f: pd.DataFrame) -> pd.DataFrame:
        ids, q, out = own
        got, v, _ = stacked(f["id"], f["v"], q.shape[1])
        order = np.argsort(got, kind="stable")
        got, v, found = got[order], v[order], []
        for at in _strips(len(ids), len(got)) if len(got) else ():
            s = q[at] @ v.T
            for i, without in enumerate(out[at]):
                without = np.append(without, ids[at.start + i])
                lo, hi = np.searchsorted(got, without), np.searchsorted(got, without, side="right")
                for x, y in zip(lo[lo < hi], hi[lo < hi], strict=True):
                    s[i, x:y] = -np.inf
            i, j = _kept(s, k)
            found.append((ids[at][i], got[j], s[i, j]))
        return pd.DataFrame({c: np.concatenate([f[n] for f in found]) for n, c in enumerate(("query_id", "id", "score"))}) if found else pd.DataFrame()

    skipped = F.coalesce(skip, F.array().cast("array<long>")) if skip else F.array().cast("array<long>")
    found = _against(queries.select("query_id", F.col("vec").alias("q"), skipped.alias("skip")), vectors.select("id", F.col("vec").alias("v")), prepare, best, "query_id long, id long, score double")
    return top_k(found.withColumn("score", F.round("score", 6)), ["query_id"], k, F.desc("score"), F.asc("id"))


def planes(dims: int, n: int = PLANES, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n, dims))


def _signs(rows: np.ndarray, normals: np.ndarray, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Products with the planes of each table, and the table's bucket: bit i is set where the product with plane i is not negative."""
    x = (rows @ normals.T).reshape(len(rows), tables, PLANES)
    return x, ((x >= 0) << np.arange(PLANES)).sum(axis=2)


def buckets(vectors: DataFrame, dims: int, tables: int = TABLES) -> DataFrame:
    """(key, id): a row for each table's bucket of each vector (id, vec) of the given width; others are left out."""
    normals = planes(dims, PLANES * tables)

    @F.pandas_udf("array<int>")
    def keys(rows: pd.Series) -> pd.Series:
        found = _signs(np.stack(rows.to_numpy()), normals, tables)[1] if len(rows) else np.empty((0, tables))
        return pd.Series(list((found + (np.arange(tables) << PLANES)).astype(np.int32)))

    return vectors.filter(F.size("vec") == dims).select("id", F.explode(keys("vec")).alias("key")).select("key", "id")


def _flip_sets(margins: np.ndarray, probes: int) -> list[tuple[int, ...]]:
    """The ``probes`` sets of planes of least summed margin, the empty one first: single planes and pairs."""
    order = np.argsort(margins, kind="stable")
    sets = [(0.0, ())] + [(margins[i], (int(i),)) for i in order] + [(margins[i] + margins[j], (int(i), int(j))) for n, i in enumerate(order) for j in order[n + 1 :]]
    return [s for _, s in sorted(sets, key=lambda x: x[0])[:probes]]


def probed_buckets(queries: DataFrame, dims: int, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(key, query_id): of each table the query's own bucket and those whose planes it lies nearest to."""
    normals = planes(dims, PLANES * tables)

    @F.pandas_udf("array<int>")
    def keys(rows: pd.Series) -> pd.Series:
        out = []
        for x, own in zip(*_signs(np.stack(rows.to_numpy()), normals, tables), strict=True) if len(rows) else ():
            out.append(np.array([int(own[t]) ^ sum(1 << i for i in flips) | t << PLANES for t in range(tables) for flips in _flip_sets(x[t] ** 2, probes)], dtype=np.int32))
        return pd.Series(out)

    return queries.filter(F.size("vec") == dims).select("query_id", F.explode(keys("vec")).alias("key")).select("key", "query_id")


def sure_to_meet(dims: int, tables: int = TABLES, probes: int = PROBES):
    """A function of columns (vec, cosine): the probability that a vector at that cosine to ``vec`` is in one of its probed buckets.

    For a vector of one length at cosine s the product with a plane that the query has margin m to is normal, of mean s m and variance
    1 - s^2, so it keeps the plane's side with probability Phi(|m| s / sqrt(1 - s^2)).
    """
    normals = planes(dims, PLANES * tables)

    @F.pandas_udf("double")
    def sure(vecs: pd.Series, cosines: pd.Series) -> pd.Series:
        out = []
        for q, s in zip(vecs, cosines, strict=True):
            if s is None or not s > 0:
                out.append(0.0)
                continue
            x = np.abs(normals @ (np.asarray(q) / np.linalg.norm(q))).reshape(tables, PLANES)
            side = np.array([[0.5 * math.erfc(-m * s / math.sqrt(2 * max(1e-12, 1 - s * s))) for m in row] for row in x])
            missed = 1.0
            for t in range(tables):
                own = side[t].prod()
                missed *= 1 - min(1.0, sum(own * math.prod((1 - side[t][i]) / max(side[t][i], 1e-300) for i in flips) for flips in _flip_sets(x[t] ** 2, probes)))
            out.append(1 - missed)
        return pd.Series(out)

    return sure


def lsh_search(vectors: DataFrame, queries: DataFrame, dims: int, k: int, tables: int = TABLES, probes: int = PROBES, sure: float = SURE) -> tuple[DataFrame, DataFrame]:
    """((query_id, id, score, rank), (query_id, touched, settled)): about the k highest inner products of vectors of one length.

    Vectors are dealt to buckets and meet the queries that probe them in an equi-join; those met are scored exactly. A query is settled if it has
    k of them and a vector as good as the k-th would be met with probability ``sure`` or more, so of its true k at least that share is
    expected. The others, which hashing cannot serve, are searched exactly.
    """
    own = written(queries.filter(F.size("vec") == dims).select("query_id", "vec"), "queries")
    pairs = buckets(vectors, dims, tables).join(probed_buckets(own, dims, tables, probes), "key").filter("id <> query_id").select("id", "query_id")
    pairs = written(pairs.distinct(), "met")
    scored = products(pairs, vectors.select("id", "vec"), ["id"], own, ["id"], k)
    top = written(top_k(scored.withColumn("score", F.round("score", 6)), ["query_id"], k, F.desc("score"), F.asc("id")), "found")
    last = top.filter(F.col("rank") == k).select("query_id", F.col("score").alias("last"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    longest = vectors.filter(F.size("vec") == dims).agg(F.max(norm).alias("longest"))
    held = own.join(last, "query_id", "left").join(F.broadcast(longest))  # one row
    cosine = F.when(F.col("last").isNotNull(), F.least(F.col("last") / (norm * F.col("longest")), F.lit(1.0)))
    met = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("touched"))
    state = held.select("query_id", "vec", F.coalesce(sure_to_meet(dims, tables, probes)("vec", F.coalesce(cosine, F.lit(0.0))) >= sure, F.lit(False)).alias("settled"))
    state = written(state.join(met, "query_id", "left").withColumn("touched", F.coalesce("touched", F.lit(0))), "state")
    rest = state.filter(~F.col("settled")).select("query_id", "vec")
    found = top.join(state.filter("settled").select("query_id"), "query_id", "left_semi").unionByName(exact_top_k(vectors, rest, k).select(top.columns))
    return found, state.select("query_id", "touched", "settled")


def lsh_top_k(vectors: DataFrame, queries: DataFrame, dims: int, k: int, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(query_id, id, score, rank): the rows of lsh_search()."""
    return lsh_search(vectors, queries, dims, k, tables, probes)[0]


def euclidean_near(vectors: DataFrame, point: list[float], k: int, normals: list[list[float]], width: float) -> DataFrame:
    """(id, distance, rank) of the k nearest to ``point`` among vectors that share a bucket with it in one of the tables; a
    bucket is the product with the table's normal over ``width``, rounded down."""
    at = [int(np.floor(np.dot(point, n) / width)) for n in normals]
    p = F.array(*[F.lit(float(x)) for x in point])
    shared = [F.floor(dot(F.col("vec"), F.array(*[F.lit(float(x)) for x in n])) / width) == b for n, b in zip(normals, at, strict=True)]
    near = vectors.filter(F.greatest(*[F.coalesce(s, F.lit(False)) for s in shared]))
    apart = F.zip_with("vec", p, lambda x, y: (x - y) * (x - y))
    near = near.select("id", F.round(F.sqrt(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x)), 6).alias("distance"))
    return top_k(near.withColumn("g", F.lit(0)), ["g"], k, F.asc("distance"), F.asc("id")).drop("g")


def weighted_means(rows: DataFrame, vectors: DataFrame, by: str) -> DataFrame:
    """(by, d, x): weighted mean of each place d of the vectors of a key, of rows (by, w, vec) whose vectors are from ``vectors`` (vec).

    A row is shuffled once with its vector and not once for each place; sums are cut into places when they are done.
    """
    low, high = vectors.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()  # one row
    sums = [F.sum(F.get("vec", F.lit(d)) * F.col("w")) for d in range(high or 0)]
    s = rows.filter(F.size("vec") > 0).groupBy(by, F.size("vec").alias("width")).agg(F.sum("w").alias("w"), F.array(*sums).alias("s"))
    s = s.select(by, "w", F.posexplode(F.slice("s", F.lit(1), F.col("width"))).alias("d", "x"))
    if low != high:  # keys with vectors of several widths
        s = s.groupBy(by, "d").agg(F.sum("w").alias("w"), F.sum("x").alias("x"))
    return s.select(by, F.col("d").cast("long").alias("d"), (F.col("x") / F.col("w")).alias("x"))


def max_sim_top_k(queries: DataFrame, bags: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k bags (id, bag) of highest MaxSim with each query (query_id, qbag), itself left out; ties by id.

    Tokens of all queries and bags are multiplied as matrices, CELLS products at a time; a batch keeps a query's best k and what ties with the last.
    """

    def flat(ids: pd.Series, bags_of: pd.Series) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Ids, the place of each token's bag, and the tokens; bags without tokens are left out."""
        sizes = bags_of.map(len).to_numpy()
        return ids.to_numpy()[sizes > 0], np.repeat(np.arange(int((sizes > 0).sum())), sizes[sizes > 0]), [np.asarray(x) for bag in bags_of for x in bag]

    def by_width(tokens: list[np.ndarray]) -> dict[int, np.ndarray]:
        widths = np.array([len(x) for x in tokens])
        return {int(w): np.flatnonzero(widths == w) for w in np.unique(widths)}

    def prepare(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        return flat(f["query_id"], f["qbag"])

    def best(own: tuple[np.ndarray, np.ndarray, list[np.ndarray]], f: pd.DataFrame) -> pd.DataFrame:
        (ids, of, tokens), (got, theirs, others) = own, flat(f["id"], f["bag"])
        if not len(ids) or not len(got):
            return pd.DataFrame()
        stacks = {w: (at, theirs[at], np.stack([others[i] for i in at])) for w, at in by_width(others).items()}
        ends, found = np.searchsorted(of, np.arange(len(ids) + 1)), []
        step = max(1, CELLS // max(1, len(others) * max(1, -(-len(tokens) // len(ids)))))
        for first in range(0, len(ids), step):
            last = min(len(ids), first + step)
            mine = tokens[ends[first] : ends[last]]
            high = np.full((len(mine), len(got)), -np.inf)
            for w, at in by_width(mine).items():
                if w in stacks:
                    _, bag, v = stacks[w]
                    new = np.flatnonzero(np.concatenate(([True], bag[1:] != bag[:-1])))
                    high[np.ix_(at, bag[new])] = np.maximum.reduceat(np.stack([mine[i] for i in at]) @ v.T, new, axis=1)
            s = np.add.reduceat(high, ends[first:last] - ends[first], axis=0)
            s[ids[first:last, None] == got[None, :]] = -np.inf
            i, j = _kept(s, k)
            found.append((ids[first + i], got[j], s[i, j]))
        return pd.DataFrame({c: np.concatenate([f[n] for f in found]) for n, c in enumerate(("query_id", "id", "score"))})

    found = _against(queries.select("query_id", "qbag"), bags.select("id", "bag"), prepare, best, "query_id long, id long, score double")
    return top_k(found.withColumn("score", F.round("score", 6)), ["query_id"], k, F.desc("score"), F.asc("id"))


def max_sim(query: str, bag: str):
    """Sum over the query's vectors of their highest product with a vector of the bag."""
    best = F.transform(F.col(query), lambda x: F.array_max(F.transform(F.col(bag), lambda y: dot(x, y))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)
