"""An inverted file over vectors: postings of bounded size, read by the clusters that a query probes and no others.

Building. All vectors are one cell at first. Cells of more than CELL vectors are cut in up to FAN by centroids fitted on a bounded sample
of their own members, and only members of cut cells are assigned again; vectors that no centroid tells apart are dealt by a hash of
their ids. A cell is then one task's work, which cuts it in two, again and again, into clusters of at most ``posting`` vectors. A vector
near the border of two clusters is in both as far as the second has room.

Postings are Parquet partitioned by cell group, so a search reads the groups it probes. Centroids of clusters are a table; only those of cells
pass through the driver, SLICE at a time.

Maintenance. Upserts and deletes are deltas: a vector goes to its best cluster as a new entry, and an id's entries before its newest number are
dead. maintain() cuts clusters that are too large, moves members of the four nearest clusters that are nearer to a new centroid,
joins clusters that are too small to their nearest, and rewrites the postings where half of the entries are dead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderloom.operators.lineage import written
from cinderloom.operators.ranking import top_k

#: Vectors of a cell, children of a cut, sampled members of a cell that is cut, cell centroids that the driver sends out at once, partitions.
CELL, FAN, SAMPLE, SLICE, GROUPS = 8_192, 32, 4_096, 32_768, 64
POSTING, LEAST, NEIGHBOURS, DEAD = 128, 16, 4, 0.5
#: A second cluster within this factor of the nearest's distance gets a copy.
BORDER = 1.02
#: Cells whose clusters a query looks at.
BEAM = 8
QUERY_BLOCK, SEED = 4096, 42

_ENTRY = "cell long, cluster long, id long, vec array<double>, main boolean, centre array<double>"


def two_means(rows: np.ndarray, rounds: int = 8) -> np.ndarray:
    """0 or 1 for each row, from the row farthest from the mean and the row farthest from that; one label only where all rows are equal."""
    far = rows[((rows - rows.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    c = np.stack((far, rows[((rows - far) ** 2).sum(axis=1).argmax()]))
    for _ in range(rounds):
        own = nearest(rows, c)
        if own.min() == own.max():
            break
        c = np.stack([rows[own == j].mean(axis=0) for j in (0, 1)])
    return nearest(rows, c)


def nearest(rows: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest of the centroids by squared distance; ties to the first."""
    return ((c * c).sum(axis=1)[None, :] - 2 * rows @ c.T).argmin(axis=1)


def fitted(rows: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's centroids from k-means++ starts; an empty cluster keeps its centroid."""
    rng = np.random.default_rng(SEED)
    c = rows[[int(rng.integers(len(rows)))]]
    far = ((rows - c[0]) ** 2).sum(axis=1)
    while len(c) < k and far.max() > 1e-18:
        c = np.vstack((c, rows[int(rng.choice(len(rows), p=far / far.sum()))]))
        far = np.minimum(far, ((rows - c[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        own = nearest(rows, c)
        c = np.array([rows[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c


def cut_small(rows: np.ndarray, most: int) -> np.ndarray:
    """A cluster number for each row, no cluster larger than ``most``: cut in two until they fit, rows that are equal by order."""
    out, todo, n = np.zeros(len(rows), dtype=np.int64), [np.arange(len(rows))], 0
    while todo:
        at = todo.pop()
        if len(at) <= most:
            out[at] = n
            n += 1
            continue
        side = two_means(rows[at])
        if side.min() == side.max():
            side = np.arange(len(at)) >= len(at) // 2
        todo += [at[side == 1], at[side == 0]]
    return out


def _hashed(ids: np.ndarray, salt: int) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64)


def _entries(cell: int, ids: np.ndarray, rows: np.ndarray, own: np.ndarray, most: int, first: int = 0) -> pd.DataFrame:
    """Entries of the clusters ``own`` (numbers from 0), border copies where there is room; each cluster's centroid stands at its first member."""
    n = int(own.max()) + 1
    c = np.array([rows[own == j].mean(axis=0) for j in range(n)])
    size = np.bincount(own, minlength=n)
    centre = np.full(len(ids), None, dtype=object)
    for j in range(n):
        centre[int(np.flatnonzero(own == j)[0])] = c[j].tolist()
    at, to = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    if n > 1:
        d = (rows * rows).sum(axis=1)[:, None] - 2 * rows @ c.T + (c * c).sum(axis=1)[None, :]
        d[np.arange(len(ids)), own] = np.inf
        second, mine = d.argmin(axis=1), ((rows - c[own]) ** 2).sum(axis=1)
        close = np.flatnonzero(d.min(axis=1) <= mine * BORDER**2)
        order = close[np.argsort(d.min(axis=1)[close], kind="stable")]
        place = pd.Series(second[order]).groupby(second[order]).cumcount().to_numpy()
        ok = place < np.maximum(most - size, 0)[second[order]]
        at, to = order[ok], second[order][ok]
    vecs = np.array([*rows, None], dtype=object)[:-1]
    none = np.full(len(at), None, dtype=object)
    return pd.DataFrame({
        "cell": cell, "cluster": np.concatenate((own, to)) + first, "id": np.concatenate((ids, ids[at])), "vec": np.concatenate((vecs, vecs[at])),
        "main": np.arange(len(ids) + len(at)) < len(ids), "centre": np.concatenate((centre, none)),
    })


def products(pairs: DataFrame, rows: DataFrame, key: list[str], queries: DataFrame, keep: list[str], best: int | None = None) -> DataFrame:
    """(query_id, *keep, score): inner products of the pairs (*key, query_id) of rows (*key, vec, *keep) and queries (query_id, vec).

    With ``best``, only what may be among a query's so many best comes out of a batch: the best of the batch and all that ties with the last. Each row is sent on once with the queries that meet it; the queries are broadcast in blocks of about QUERY_BLOCK. Rows of another width than a query are left out.
    """
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    lists = pairs.groupBy(*key, block("query_id").alias("block")).agg(F.collect_set("query_id").alias("qs"))
    if blocks > 1:
        lists = written(lists, "lists")
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    out = None
    for b in range(blocks):
        own = queries.filter(block("query_id") == b).select("query_id", "vec").collect()  # about QUERY_BLOCK rows
        shared = rows.sparkSession.sparkContext.broadcast((np.array([r["query_id"] for r in own], dtype=np.int64), [np.array(r["vec"]) for r in own]))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids_of, q = shared.value
            order_of, q_width = np.argsort(ids_of), np.array([len(x) for x in q], dtype=np.int64)
            names = ids_of[order_of]
            for f in frames:
                if not len(f):
                    continue
                widths = f["vec"].map(len).to_numpy()
                for width in np.unique(widths):
                    mine = np.flatnonzero(widths == width)
                    vecs, qs = np.stack(f["vec"].to_numpy()[mine]), f["qs"].to_numpy()[mine]
                    at = np.repeat(np.arange(len(mine)), [len(x) for x in qs])
                    ids = np.concatenate(qs)
                    spot = order_of[np.searchsorted(names, ids)]
                    ok = q_width[spot] == width
                    at, ids, spot = at[ok], ids[ok], spot[ok]
                    order = np.argsort(spot, kind="stable")
                    at, ids, spot = at[order], ids[order], spot[order]
                    score, kept = np.empty(len(at)), np.ones(len(at), dtype=bool)
                    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(spot)) + 1):
                        if len(part):
                            score[part] = vecs[at[part]] @ q[spot[part[0]]]
                            if best and len(part) > best:
                                kept[part] = score[part] >= np.partition(score[part], len(part) - best)[len(part) - best] - 1e-6
                    at, ids, score = at[kept], ids[kept], score[kept]
                    yield pd.DataFrame({"query_id": ids, **{c: f[c].to_numpy()[mine[at]] for c in keep}, "score": score})

        met = lists.filter(F.col("block") == b).join(rows, key).select("vec", "qs", *keep)
        part = met.mapInPandas(run, f"query_id long, {types}, score double")
        out = part if out is None else out.unionByName(part)
    return out


@dataclass(frozen=True)
class InvertedFile:
    """``cells`` (cell, vec), ``centres`` (cell, cluster, vec, n), ``postings`` (cell, cluster, id, vec, main, seq; partitioned by grp), ``newest`` (id, seq, gone) of
    what was upserted or deleted since the postings were written; ``seq`` is the next number."""

    cells: DataFrame
    centres: DataFrame
    postings: DataFrame
    newest: DataFrame
    posting: int
    seq: int = 1

    def alive(self) -> DataFrame:
        """Entries whose id has no newer number."""
        last = self.newest.select("id", F.col("seq").alias("last"), "gone")
        return self.postings.join(last, "id", "left").filter(F.col("last").isNull() | (F.col("seq") == F.col("last")) & ~F.col("gone")).drop("last", "gone")


def _by_group(entries: DataFrame) -> DataFrame:
    return written(entries.withColumn("grp", F.pmod("cell", F.lit(GROUPS)).cast("int")).repartition("grp", "cell").sortWithinPartitions("grp", "cell", "cluster"), "postings", by=("grp",))


def _cells(vectors: DataFrame) -> DataFrame:
    """(id, vec, cell): cells of at most CELL vectors. A round works on the members of cells that are too large, and on no others."""
    active, next_cell, done = vectors.select("id", "vec", F.lit(0).cast("long").alias("cell")), 1, []
    while True:
        active = written(active, "cells")
        over = written(active.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL), "over")
        done.append(active.join(over.select("cell"), "cell", "left_anti").select("id", "vec", "cell"))
        large = {r["cell"]: r["n"] for r in over.limit(SLICE // FAN).collect()}  # further ones wait for the next round
        if not large:
            break
        own = active.filter(F.col("cell").isin(list(large)))
        waiting = active.join(over.select("cell"), "cell", "left_semi").filter(~F.col("cell").isin(list(large))).select("id", "vec", "cell")
        share = F.create_map(*[F.lit(x) for c, n in large.items() for x in (c, min(1.0, SAMPLE / n))])
        sample = own.filter(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) < share[F.col("cell")] * (1 << 30))

        def fit(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
            c = fitted(np.array(f["vec"].tolist()), min(FAN, -(-2 * large[key[0]] // CELL)))
            return pd.DataFrame({"cell": key[0], "vec": c.tolist()})

        children: dict[int, list] = {}
        for r in sample.groupBy("cell").applyInPandas(fit, "cell long, vec array<double>").collect():  # SLICE rows at most
            children.setdefault(r["cell"], []).append(r["vec"])
        shared, at = {}, next_cell
        for c, n in large.items():
            found = children.get(c, [])
            # One centroid alone: equal vectors, dealt by id.
            parts = len(found) if len(found) > 1 else -(-2 * n // CELL)
            shared[c] = (at, np.array(found) if len(found) > 1 else None, parts)
            at += parts
        next_cell, sent = at, vectors.sparkSession.sparkContext.broadcast(shared)

        @F.pandas_udf("long")
        def child(ids: pd.Series, vecs: pd.Series, cells: pd.Series) -> pd.Series:
            out = cells.to_numpy().copy()
            for c in np.unique(out):
                if c in sent.value:
                    first, centres, parts = sent.value[c]
                    mine = np.flatnonzero(cells.to_numpy() == c)
                    out[mine] = first + (nearest(np.array(vecs.iloc[mine].tolist()), centres) if centres is not None else _hashed(ids.to_numpy()[mine], first) % parts)
            return pd.Series(out)

        active = own.select("id", "vec", child("id", "vec", "cell").alias("cell")).unionByName(waiting)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def build(vectors: DataFrame, posting: int = POSTING) -> InvertedFile:
    """The index of vectors (id, vec). Null and empty vectors are left out; vectors of several widths are an error of the cell they meet in."""
    own = _cells(vectors.filter(F.size("vec") > 0).select("id", "vec"))

    def cluster(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        rows = np.array(f["vec"].tolist())
        return _entries(key[0], f["id"].to_numpy(), rows, cut_small(rows, max(1, posting // 2)), posting)

    found = written(own.groupBy("cell").applyInPandas(cluster, _ENTRY), "entries")
    return _indexed(found, posting)


def _indexed(found: DataFrame, posting: int) -> InvertedFile:
    sizes = found.groupBy("cell", "cluster").agg(F.count_if("main").alias("n"))
    centres = found.filter("centre is not null").select("cell", "cluster", F.col("centre").alias("vec")).join(sizes, ["cell", "cluster"])
    centres = written(centres, "centres")
    postings = _by_group(found.select("cell", "cluster", "id", "vec", "main", F.lit(0).cast("long").alias("seq")))
    newest = found.sparkSession.createDataFrame([], "id long, seq long, gone boolean")
    return InvertedFile(_cell_centres(centres), centres, postings, newest, posting)


def _cell_centres(centres: DataFrame) -> DataFrame:
    """(cell, vec): mean of the cells' clusters, weighed by their members."""
    parts = centres.select("cell", F.greatest("n", F.lit(1)).alias("n"), F.posexplode("vec").alias("d", "x"))
    means = parts.groupBy("cell", "d").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"))
    return written(means.groupBy("cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("vec")), "cell-centres")


def _best_cells(index: InvertedFile, queries: DataFrame, beam: int, by_distance: bool) -> DataFrame:
    """(query_id, cell): each query's best cells, by inner product or by distance. Cell centroids are sent out SLICE at a time."""
    n = index.cells.count()
    slices, out = max(1, -(-n // SLICE)), None
    for s in range(slices):
        rows = index.cells.filter(F.pmod(F.xxhash64("cell"), F.lit(slices)) == s).collect()  # about SLICE rows
        shared = queries.sparkSession.sparkContext.broadcast((np.array([r["cell"] for r in rows]), np.array([r["vec"] for r in rows])))

        @F.pandas_udf("array<struct<cell:long,score:double>>")
        def best(vecs: pd.Series) -> pd.Series:
            cells, c = shared.value
            if not len(cells):
                return pd.Series([[] for _ in vecs])
            q = np.array(vecs.tolist())
            score = 2 * q @ c.T - (c * c).sum(axis=1)[None, :] if by_distance else q @ c.T
            top = np.argsort(-score, axis=1, kind="stable")[:, :beam]
            return pd.Series([[{"cell": int(cells[j]), "score": float(score[i, j])} for j in row] for i, row in enumerate(top)])

        found = queries.select("query_id", F.explode(best("vec")).alias("x")).select("query_id", "x.*")
        out = found if out is None else out.unionByName(found)
    return top_k(out, ["query_id"], beam, F.desc("score"), F.asc("cell")).select("query_id", "cell")


def probed(index: InvertedFile, queries: DataFrame, k: int, probes: int, beam: int = BEAM) -> DataFrame:
    """(query_id, cell, cluster): the ``probes`` best clusters of the best ``beam`` cells, and further ones until they hold k vectors beside the query."""
    pairs = _best_cells(index, queries, beam, False)
    # A cluster holds a member at least, so the best of each batch are enough.
    scored = products(pairs, index.centres, ["cell"], queries, ["cell", "cluster", "n"], probes + k + 1)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("cell"), F.asc("cluster"))
    w = scored.withColumn("place", F.row_number().over(order)).withColumn("held", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return w.filter((F.col("place") <= probes) | (F.col("held") <= k)).select("query_id", "cell", "cluster")


def search(index: InvertedFile, queries: DataFrame, k: int, probes: int, beam: int = BEAM) -> DataFrame:
    """(query_id, id, score, rank) of about the k highest inner products of each query (query_id, vec), itself left out; ties by id."""
    queries = written(queries.filter(F.size("vec") > 0).select("query_id", "vec"), "queries")
    pairs = written(probed(index, queries, k, probes, beam), "probed")
    groups = [r["grp"] for r in pairs.select(F.pmod("cell", F.lit(GROUPS)).cast("int").alias("grp")).distinct().collect()]  # GROUPS at most
    alive = replace(index, postings=index.postings.filter(F.col("grp").isin(groups))).alive()
    found = products(pairs, alive.select("cell", "cluster", "id", "vec"), ["cell", "cluster"], queries, ["id"], 2 * (k + 1)).filter("query_id <> id")
    # An id has two entries at most, so twice as many of each batch hold the best k beside the query itself.
    once = found.groupBy("query_id", "id").agg(F.round(F.max("score"), 6).alias("score"))
    return top_k(once, ["query_id"], k, F.desc("score"), F.asc("id"))


# Maintenance


def _placed(index: InvertedFile, rows: DataFrame, beam: int = 4) -> DataFrame:
    """(id, cell, cluster) of rows (id, vec): the cluster of nearest centroid in the ``beam`` nearest cells."""
    q = rows.select(F.col("id").alias("query_id"), "vec")
    pairs = _best_cells(index, q, beam, True)
    near = products(pairs, index.centres.withColumn("norm", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)), ["cell"], q, ["cell", "cluster", "norm"])
    near = near.withColumn("closeness", 2 * F.col("score") - F.col("norm"))
    return top_k(near, ["query_id"], 1, F.desc("closeness"), F.asc("cell"), F.asc("cluster")).select(F.col("query_id").alias("id"), "cell", "cluster")


def changed(index: InvertedFile, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> InvertedFile:
    """The index after a batch of upserts (id, vec), one row an id, and deletes (id); an id in both is deleted. Sizes are counted by maintain()."""
    seq, newest, postings = index.seq, index.newest, index.postings
    touched = None
    if upserts is not None:
        new = written(upserts.filter(F.size("vec") > 0).select("id", "vec"), "upserts")
        entries = new.join(_placed(index, new), "id").select("cell", "cluster", "id", "vec", F.lit(True).alias("main"), F.lit(seq).cast("long").alias("seq"))
        postings = postings.unionByName(_by_group(entries))
        touched = new.select("id", F.lit(seq).cast("long").alias("seq"), F.lit(False).alias("gone"))
    if deletes is not None:
        gone = deletes.select("id", F.lit(seq).cast("long").alias("seq"), F.lit(True).alias("gone"))
        touched = gone if touched is None else touched.unionByName(gone)
    if touched is not None:
        newest = newest.unionByName(touched).groupBy("id").agg(F.max(F.struct("seq", "gone")).alias("x")).select("id", "x.seq", "x.gone")
    return replace(index, postings=postings, newest=written(newest, "newest"), seq=seq + 1)


def maintained(index: InvertedFile, least: int = LEAST) -> tuple[InvertedFile, dict]:
    """The index with sizes counted anew, large clusters cut, small ones joined to their nearest, and compacted where half of the entries are dead; and what was done.

    Cut and joined clusters are rewritten whole; a cell whose live members exceed CELL is cut into cells as in building, so no task's work grows with the table.
    """
    total = index.postings.count()
    alive = written(index.alive(), "alive")
    n_alive = alive.count()
    sizes = written(alive.groupBy("cell", "cluster").agg(F.count(F.lit(1)).alias("n")), "sizes")
    large, small = sizes.filter(F.col("n") > index.posting), sizes.filter(F.col("n") < least)
    done = {"splits": large.count(), "merges": small.count(), "dead": 0.0 if not total else 1 - n_alive / total}
    done["compacted"] = bool(done["splits"] or done["merges"] or done["dead"] >= DEAD)
    if not done["compacted"]:
        counted = index.centres.drop("n").join(sizes, ["cell", "cluster"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
        return replace(index, centres=written(counted, "centres")), done
    main = alive.filter("main").select("id", "vec", "cell", "cluster")
    crowded = main.groupBy("cell").count().filter(F.col("count") > 2 * CELL).select("cell")
    spread = crowded.count()
    top = index.cells.agg(F.max("cell")).first()[0] or 0
    if spread:
        fresh = _cells(main.join(crowded, "cell", "left_semi").select("id", "vec"))
        moved = fresh.select("id", "vec", (F.col("cell") + top + 1).alias("cell"), F.lit(-1).cast("long").alias("cluster"))
        main = main.join(crowded, "cell", "left_anti").unionByName(moved)
    marked = main.join(index.centres.select("cell", "cluster", F.col("vec").alias("centre")), ["cell", "cluster"], "left")
    posting = index.posting

    def tidy(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        rows, own = np.array(f["vec"].tolist()), f["cluster"].to_numpy().copy()
        if (own < 0).any():
            own = cut_small(rows, max(1, posting // 2))
            return _entries(key[0], f["id"].to_numpy(), rows, own, posting)
        names, own = np.unique(own, return_inverse=True)
        c = np.array([f["centre"].iloc[int(np.flatnonzero(own == j)[0])] for j in range(len(names))])
        # Small ones go to the nearest other centroid, which stays as it is.
        for j in np.flatnonzero(np.bincount(own) < least):
            size = np.bincount(own, minlength=len(c))
            if 0 < size[j] < least and (size > 0).sum() > 1:
                d = ((c - c[j]) ** 2).sum(axis=1)
                d[(size == 0) | (np.arange(len(c)) == j)] = np.inf
                own[own == j] = int(d.argmin())
        for j in np.flatnonzero(np.bincount(own, minlength=len(c)) > posting):
            at = np.flatnonzero(own == j)
            side = cut_small(rows[at], posting)
            first = len(c)
            c = np.vstack((c, *[rows[at[side == s]].mean(axis=0)[None, :] for s in range(side.max() + 1)]))
            own[at] = first + side
            new = np.arange(first, len(c))
            c[j] = np.inf
            # Members of the nearest clusters go over to a new centroid that is nearer, while it has room.
            for s in new:
                d = ((np.where(np.isfinite(c), c, 1e150) - c[s]) ** 2).sum(axis=1)
                d[new] = np.inf
                around = np.flatnonzero(np.isin(own, np.argsort(d, kind="stable")[:NEIGHBOURS]))
                live = np.flatnonzero(np.isfinite(c[:, 0]))
                over = around[live[nearest(rows[around], c[live])] == s] if len(around) else around
                own[over[: max(0, posting - int((own == s).sum()))]] = s
        return _entries(key[0], f["id"].to_numpy(), rows, np.unique(own, return_inverse=True)[1], posting)

    found = written(marked.groupBy("cell").applyInPandas(tidy, _ENTRY), "entries")
    return replace(_indexed(found, posting), seq=index.seq), done
